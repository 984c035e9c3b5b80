"""Bounded walks over the knowledge graph: what an event at some entities may reach, and the cascade of a trend."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import HOP_DECAY, HUB_DEGREE, MIN_CONFIDENCE

#: Links that a walk gives, nodes it may have seen when it goes on, hops, and an order's ceiling.
MOST_LINKS, MOST_NODES, HOPS, MOST_ORDER = 40, 400, 3, 4
#: Seeds of a walk, tickers a story gives it, entities of the window; links of a trend's cascade, claims of its telling and their confidence.
SEEDS, STORY_TICKERS, TOP_ENTITIES = 25, 4, 15
CASCADE_LINKS, CLAIMS, CLAIM_CONFIDENCE = 20, 6, 0.35


def walk_seeds(stories: DataFrame, mentions: DataFrame) -> DataFrame:
    """(node): the first tickers of the window's stories (id, tickers) and its most mentioned nodes (node, mentions), the first SEEDS by name."""
    named = stories.select(F.explode(F.slice("tickers", 1, STORY_TICKERS)).alias("node"))
    top = mentions.orderBy(F.desc("mentions"), "node").limit(TOP_ENTITIES).select("node")
    return named.unionByName(top).where("node <> ''").distinct().orderBy("node").limit(SEEDS)


def mechanism(forward: str = "forward"):  # type: ignore[no-untyped-def]
    """What an edge says, in words; against its direction it is an exposure."""
    said = F.concat_ws(" ", "subject", F.replace(F.coalesce(F.nullif("predicate", F.lit("")), F.lit("related_to")), F.lit("_"), F.lit(" ")), "object")
    return F.when(F.col(forward), said).otherwise(F.concat(said, F.lit(" (reverse exposure)")))


def impact_links(edges: DataFrame, seeds: DataFrame, cut: Callable[[DataFrame], DataFrame], hops: int = HOPS, most_links: int = MOST_LINKS, most_nodes: int = MOST_NODES, hub_degree: int = HUB_DEGREE, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(subject, predicate, object, forward, order, confidence, mechanism): the strongest ``most_links`` edges that a breadth-first walk from seeds (node) meets.

    Nodes are left in the order in which they were met (seeds by name; a node's edges by subject, predicate, object), an edge counts once, from the end
    left first.  A node is left only while fewer than ``most_links`` edges and ``most_nodes`` nodes are known, and if it is a seed or has ``hub_degree`` edges at
    most.  Confidence falls by HOP_DECAY a hop.  A level is one join with a frontier of fewer than ``most_nodes`` rows; the driver sees counts a node.
    """
    edges = cut(edges.select("subject", "predicate", "object", "confidence"))
    strong = edges.where(F.col("confidence") >= min_confidence)
    key = ["subject", "predicate", "object"]
    front = cut(seeds.where("node IS NOT NULL").select("node").distinct().orderBy("node").limit(most_nodes).withColumn("pos", F.row_number().over(Window.orderBy("node"))))
    visited, found, n_links, n_seen = front.select("node"), None, 0, front.count()
    for hop in range(hops):
        if n_links >= most_links or n_seen >= most_nodes:
            break
        leaving = front
        if hop:
            ends = edges.select(F.col("subject").alias("node")).unionByName(edges.select(F.col("object").alias("node"))).join(F.broadcast(front.select("node")), "node")
            leaving = front.join(F.broadcast(ends.groupBy("node").count().where(F.col("count") > hub_degree).select("node")), "node", "left_anti")
        small = F.broadcast(leaving)
        out = strong.join(small, F.col("subject") == F.col("node")).select(*key, "confidence", "pos", F.lit(True).alias("forward"), F.col("object").alias("other"))
        back = strong.where("subject <> object").join(small, F.col("object") == F.col("node")).select(*key, "confidence", "pos", F.lit(False).alias("forward"), F.col("subject").alias("other"))
        met = out.unionByName(back)
        met = met.join(F.broadcast(found.select(*key)), key, "left_anti") if found is not None else met  # fewer than most_links rows
        owned = cut(met.groupBy(*key).agg(F.min(F.struct("pos", "forward", "other", "confidence")).alias("x")).select(*key, "x.*"))
        fresh = owned.where("other IS NOT NULL").join(F.broadcast(visited), F.col("other") == F.col("node"), "left_anti").groupBy("other").agg(F.min(F.struct("pos", *key)).alias("at"))
        fresh = cut(fresh)
        counts = dict(owned.groupBy("pos").count().collect())
        newly = dict(fresh.groupBy(F.col("at.pos").alias("pos")).count().collect())
        last = 0
        for pos in sorted(counts):
            if n_links >= most_links or n_seen >= most_nodes:
                break
            last, n_links, n_seen = pos, n_links + counts[pos], n_seen + newly.get(pos, 0)
        level = owned.where(F.col("pos") <= last).withColumn("hop", F.lit(hop))
        found = level if found is None else found.unionByName(level)
        if n_links < most_links and n_seen < most_nodes:
            front = cut(fresh.where(F.col("at.pos") <= last).select(F.col("other").alias("node"), F.row_number().over(Window.orderBy("at")).alias("pos")))
            visited = cut(visited.unionByName(front.select("node")))
    if found is None:
        found = strong.limit(0).select(*key, F.lit(0).alias("pos"), F.lit(True).alias("forward"), F.col("object").alias("other"), "confidence", F.lit(0).alias("hop"))
    told = found.select(*key, "forward", F.least(F.col("hop") + 1, F.lit(MOST_ORDER)).alias("order"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") * F.pow(F.lit(HOP_DECAY), F.col("hop")))).alias("confidence"), mechanism().alias("mechanism"))
    return told.orderBy(F.desc("confidence"), "order", *key).limit(most_links)


def trend_cascades(trends: DataFrame, links: DataFrame, most: int = CASCADE_LINKS) -> DataFrame:
    """(id, place, from_entity, to_entity, mechanism, order, confidence): the cascade of each trend (id, name, named, claims), ``most`` links at most.

    Links (at most MOST_LINKS, strongest first) that touch an entity the trend names, whatever the case, or all if it names none; then the telling's own
    claims (entity, mechanism, order), CLAIMS of them, without those that lack an entity or a mechanism, of order 2 to MOST_ORDER.
    """
    rank = F.row_number().over(Window.orderBy(F.desc("confidence"), "order", "subject", "predicate", "object"))
    listed = links.withColumn("rank", rank).select("rank", F.col("subject").alias("from_entity"), F.col("object").alias("to_entity"), "mechanism", "order", "confidence")
    lower = F.array_distinct(F.filter(F.transform(F.concat(F.coalesce("named", F.array().cast("array<string>")), F.coalesce(F.transform("claims", lambda c: c["entity"]), F.array().cast("array<string>"))), F.lower), lambda x: x.isNotNull() & (x != "")))
    own = trends.select("id", "name", "claims", lower.alias("names"))
    ends = listed.select("rank", F.explode(F.array_distinct(F.array(F.lower("from_entity"), F.lower("to_entity")))).alias("n"))
    touched = own.where(F.size("names") > 0).select("id", F.explode("names").alias("n")).join(F.broadcast(ends), "n").select("id", "rank").distinct()
    claims = own.select("id", "name", F.posexplode(F.slice("claims", 1, CLAIMS)).alias("pos", "c")).where("trim(c.entity) <> '' AND trim(c.mechanism) <> ''")
    order = F.greatest(F.lit(2), F.least(F.lit(MOST_ORDER), F.coalesce(F.nullif("c.order", F.lit(0)), F.lit(2))))
    said = claims.select("id", (F.col("pos") + MOST_LINKS + 1).alias("rank"), F.substring(F.coalesce(F.nullif("name", F.lit("")), F.lit("trend")), 1, 120).alias("from_entity"), F.trim("c.entity").alias("to_entity"), F.trim("c.mechanism").alias("mechanism"), order.alias("order"), F.lit(CLAIM_CONFIDENCE).alias("confidence"))
    told = ["from_entity", "to_entity", "mechanism", "order", "confidence"]
    placed = touched.unionByName(said, allowMissingColumns=True).withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("rank"))).where(F.col("place") <= most)  # ranks of links, not their texts, are sorted
    link = F.broadcast(listed.select("rank", F.struct(*told).alias("link")))
    named = placed.join(link, "rank", "left").select("id", "place", *[F.coalesce(f"link.{c}", c).alias(c) for c in told])
    silent = own.where(F.size("names") == 0).select("id").crossJoin(F.broadcast(listed.where(F.col("rank") <= most))).select("id", F.col("rank").alias("place"), *told)  # it has no claim either
    return named.unionByName(silent)
