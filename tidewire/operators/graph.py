"""The knowledge graph: degrees, merges, cascades, paths and shocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the walks.
HUB_DEGREE = 40
MIN_CONFIDENCE = 0.35
HOP_DECAY = 0.75
PATH_CONFIDENCE = 0.4


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, out_degree)."""
    ends = edges.select(F.col("subject").alias("node"), F.lit(1).alias("out")).unionByName(edges.select(F.col("object").alias("node"), F.lit(0).alias("out")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("out").alias("out_degree"))


def merge_edges(rows: DataFrame) -> DataFrame:
    """One row an edge (subject, predicate, object): highest confidence, all story ids, no self-loops."""
    kept = rows.where("subject IS NOT NULL AND object IS NOT NULL AND subject <> object")
    return kept.groupBy("subject", "predicate", "object").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("story_id")).alias("story_ids"), F.count("*").alias("seen"))


def prune(nodes: DataFrame, edges: DataFrame, since: Column) -> tuple[DataFrame, DataFrame]:
    """Edges changed since a moment, and the nodes these touch."""
    kept = edges.where(F.col("updated_at") >= since)
    used = kept.select(F.col("subject").alias("id")).unionByName(kept.select(F.col("object").alias("id"))).distinct()
    return nodes.join(used, "id", "left_semi"), kept


def cascade(edges: DataFrame, seeds: DataFrame, cut: Callable[[DataFrame], DataFrame], hops: int = 3, hub_degree: int = HUB_DEGREE, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Edges reached from seeds (node) in either direction: subject, predicate, object, hop, impact.

    A node of more than hub_degree edges is reached but not crossed, unless it is a seed.  Each edge comes with its
    least hop; impact is confidence * HOP_DECAY ** hop.  Rounds find the nodes that are left and their hops, by the ends
    of edges alone, and stop where none is new; edges get the lesser hop of their ends once, after the last.
    """
    edges = cut(edges)
    strong = edges.where(F.col("confidence") >= min_confidence)
    ends = strong.select(F.col("subject").alias("here"), F.col("object").alias("there")).unionByName(strong.where("subject <> object").select(F.col("object").alias("here"), F.col("subject").alias("there")))
    hubs = cut(degrees(edges).where(F.col("degree") > hub_degree).select("node"))
    frontier = cut(seeds.where("node IS NOT NULL").select("node", F.lit(0).alias("hop")).distinct())
    left = frontier
    for hop in range(1, hops):
        met = ends.join(frontier.select(F.col("node").alias("here")), "here").select(F.col("there").alias("node")).where("node IS NOT NULL")
        frontier = cut(met.join(hubs, "node", "left_anti").distinct().join(left, "node", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        left = left.unionByName(frontier)
    hop_at = lambda end, name: left.select(F.col("node").alias(end), F.col("hop").alias(name))
    found = strong.join(hop_at("subject", "ahead"), "subject", "left").join(hop_at("object", "back"), "object", "left")
    found = found.withColumn("hop", F.least("ahead", F.when(F.col("subject").isNotNull(), F.col("back")))).where("hop IS NOT NULL")
    best = found.groupBy("subject", "predicate", "object").agg(F.min("hop").alias("hop"), F.max("confidence").alias("confidence"))
    return best.select("subject", "predicate", "object", "hop", F.round(F.col("confidence") * F.pow(F.lit(HOP_DECAY), F.col("hop")), 4).alias("impact"))


def beam_paths(edges: DataFrame, seeds: DataFrame, depth: int = 3, fan_out: int = 4, hub_degree: int = HUB_DEGREE, min_confidence: float = PATH_CONFIDENCE) -> DataFrame:
    """The best directed path from each seed (node): longest, then most likely, then first by name; path, hops, joint.

    A node is left by its fan_out strongest edges of min_confidence at least; no node comes twice.  A path may start or
    end at a node of more than hub_degree edges, but does not lead through it.
    """
    place = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("confidence"), "object"))
    hubs = degrees(edges).where(F.col("degree") > hub_degree).select(F.col("node").alias("end"))
    beam = edges.where(F.col("confidence") >= min_confidence).withColumn("place", place).where(F.col("place") <= fan_out).select(F.col("subject").alias("end"), F.col("object").alias("next"), F.col("confidence").alias("c"))
    paths = seeds.select(F.col("node").alias("seed"), F.array("node").alias("path"), F.lit(1.0).alias("joint"), F.col("node").alias("end"))
    found = None
    for hop in range(depth):
        paths = (paths.join(hubs, "end", "left_anti") if hop else paths).join(beam, "end").where(~F.array_contains("path", F.col("next"))).select("seed", F.concat("path", F.array("next")).alias("path"), (F.col("joint") * F.col("c")).alias("joint"), F.col("next").alias("end"))
        found = paths if found is None else found.unionByName(paths)
    ranked = found.select("seed", F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("hops"), F.round("joint", 6).alias("joint"))
    first = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("hops"), F.desc("joint"), "path"))
    return ranked.withColumn("place", first).where("place = 1").drop("place")


def shocked(base: Column, shock: Column) -> Column:
    """A chain's probability after a shock of so many percent, within 0.1 to 0.98."""
    x = shock / 100.0
    moved = F.when(x >= 0, base + (1 - base) * 0.4 * x).otherwise(base * (1 + 0.5 * x))
    return F.least(F.lit(0.98), F.greatest(F.lit(0.1), moved))
