"""Stories kept up with their events: upserts that absorb what they supersede, and stories split into their subjects."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import absorb
from .components import connected_components
from .similarity import term_counts

#: A story without an event continues an event that shares half of the smaller one's articles, unless it is a blob beside it.
LEAST_OVERLAP, BLOB_TIMES, BLOB_LEAST = 0.5, 3, 12
#: Two articles tell of one subject at this cosine, or at the lesser one if they share an anchor.
LINK_COS, ANCHOR_LINK_COS = 0.45, 0.05
#: Articles of a story that are compared in one pass; larger stories are cut into tiles of so many.
TILE = 512


def upsert(prior: DataFrame, events: DataFrame, live_trends: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What an ingest does to stories: (story_id, event_id, action, article_ids, trend_ids, absorbed_by).

    prior: id, event_id (null in old rows), article_ids, trend_ids; events: event_id, article_ids, trend_ids (themes it belongs to).
    An event continues the story of its event_id; else the first one without an event that shares LEAST_OVERLAP of the smaller
    set of articles and is not BLOB_TIMES its size (BLOB_LEAST at least), one to one in order of events.  Actions: update (it
    brings articles the story lacks), relabel (none, but a theme the story lacks), keep, insert, covered (no story of its own, but
    every article is in some), absorb (a story that continues no event, whose articles are all in an updated or new story that has a theme,
    and none of whose own themes lives).
    """
    rows = cut(prior.select("id", "event_id", F.array_distinct("article_ids").alias("aids"), F.coalesce("trend_ids", F.array().cast("array<string>")).alias("tids")))
    own = cut(events.select("event_id", F.array_distinct("article_ids").alias("ids"), F.coalesce("trend_ids", F.array().cast("array<string>")).alias("themes")).where(F.size("ids") > 0))
    by_event = rows.where("event_id IS NOT NULL").groupBy("event_id").agg(F.min("id").alias("story_id"))
    named = own.join(by_event, "event_id").select("event_id", "story_id")
    rest = own.join(named, "event_id", "left_anti")
    members = lambda r, key, ids: r.select(F.col(key).alias("id"), F.explode(ids).alias("member"))
    old = rows.where("event_id IS NULL")
    near = absorb.contained(members(rest, "event_id", "ids"), members(old, "id", "aids"), LEAST_OVERLAP)
    near = near.join(rest.select(F.col("event_id").alias("a"), F.size("ids").alias("na")), "a").join(old.select(F.col("id").alias("b"), F.size("aids").alias("nb")), "b")
    near = near.where(F.col("nb") <= F.greatest(F.col("na") * BLOB_TIMES, F.lit(BLOB_LEAST))).select("a", "b")
    continued = cut(named.unionByName(absorb.first_matches(near, cut).select(F.col("a").alias("event_id"), F.col("b").alias("story_id"))))
    told = rows.select(F.col("id").alias("story_id"), "aids", "tids")
    done = rows.select(F.explode("aids").alias("member")).distinct()
    fresh = members(own, "event_id", "ids").join(done, "member", "left_anti").select("id").distinct().select(F.col("id").alias("event_id"), F.lit(True).alias("fresh"))
    both = own.join(continued, "event_id", "left").join(told, "story_id", "left").join(fresh, "event_id", "left")
    more, themes = F.size(F.array_except("ids", "aids")) > 0, F.size(F.array_except("themes", "tids")) > 0
    action = F.when(F.col("story_id").isNotNull(), F.when(more, "update").when(themes, "relabel").otherwise("keep")).when(F.col("fresh").isNull(), "covered").otherwise("insert")
    empty = F.array().cast("array<string>")
    acted = cut(both.select("story_id", "event_id", action.alias("action"), F.when(F.col("story_id").isNull(), F.col("ids")).otherwise(F.array_union("aids", "ids")).alias("article_ids"), F.array_union(F.coalesce("tids", empty), "themes").alias("trend_ids"), (F.size("themes") > 0).alias("themed")))
    tellers = acted.where("action IN ('update', 'insert') AND themed")
    left = rows.join(continued.select(F.col("story_id").alias("id")), "id", "left_anti")
    live = live_trends.select(F.col("id").alias("theme"))
    alive = left.select("id", F.explode("tids").alias("theme")).join(live, "theme", "left_semi").select("id").distinct()
    idle = left.join(alive, "id", "left_anti").where(F.size("aids") > 0)
    whole = absorb.contained(members(idle, "id", "aids"), members(tellers, "event_id", "article_ids"), 1.0, directed=True)
    gone = whole.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("absorbed_by"))
    rested = left.join(gone, "id", "left").select(F.col("id").alias("story_id"), "event_id", F.when(F.col("absorbed_by").isNotNull(), "absorb").otherwise("keep").alias("action"), F.col("aids").alias("article_ids"), F.col("tids").alias("trend_ids"), "absorbed_by")
    out = acted.select("story_id", "event_id", "action", "article_ids", "trend_ids", F.lit(None).cast(own.schema["event_id"].dataType).alias("absorbed_by")).unionByName(rested)
    return out.withColumns({c: F.array_sort(c) for c in ("article_ids", "trend_ids")})


def rarity(articles: DataFrame) -> DataFrame:
    """How rare terms and anchors are in a reference corpus (id, title, summary): (kind 'term' or 'anchor', term, df, idf), and a row of kind 'articles' with their number.

    Saved with sources.versions, it is applied to batches it has not seen: a term it lacks has idf 1 and df 1.
    """
    n = articles.count()
    terms = term_counts(articles).select(F.lit("term").alias("kind"), "term")
    named = articles.select(F.lit("anchor").alias("kind"), F.explode(F.array_distinct(F.concat(T.anchors(F.col("title")), T.anchors(F.substring("summary", 1, 200))))).alias("term"))
    counts = terms.unionByName(named).groupBy("kind", "term").agg(F.count("*").alias("df"))
    known = counts.withColumn("idf", F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1)
    return known.unionByName(articles.sparkSession.range(1).select(F.lit("articles").alias("kind"), F.lit("").alias("term"), F.lit(n).cast("long").alias("df"), F.lit(0.0).alias("idf")))


def rare_lists(articles: DataFrame, model: DataFrame) -> DataFrame:
    """(id, terms, ws): an article's terms and their weights, of unit length; sublinear counts times the model's idf."""
    known = model.where("kind = 'term'").select("term", "idf")
    weights = term_counts(articles).join(known, "term", "left").select("id", F.struct("term", ((1 + F.log("tf")) * F.coalesce("idf", F.lit(1.0))).alias("w")).alias("v"))
    listed = weights.groupBy("id").agg(F.collect_list("v").alias("v")).select("id", F.col("v.term").alias("terms"), F.col("v.w").alias("ws"))
    norm = F.sqrt(F.aggregate("ws", F.lit(0.0), lambda done, w: done + w * w))
    return listed.withColumn("norm", norm).select("id", "terms", F.transform("ws", lambda w: w / F.col("norm")).alias("ws"))


def rare_vectors(articles: DataFrame, model: DataFrame) -> DataFrame:
    """(id, term, w) of rare_lists, a row a term."""
    return rare_lists(articles, model).select("id", F.explode(F.arrays_zip("terms", "ws")).alias("v")).select("id", F.col("v.terms").alias("term"), F.col("v.ws").alias("w"))


def _linked(rows: pd.DataFrame, across: bool) -> list[tuple[int, int]]:
    """Each place of rows with the least that links connect it to, those between two tiles only where ``across``; cosines come by postings."""
    up = list(range(len(rows)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
    anchors, tiles = [set(a) for a in rows["anchors"]], rows["tile"].tolist()
    for i, (terms, weights) in enumerate(zip(rows["terms"], rows["ws"], strict=True)):
        cos: dict[int, float] = defaultdict(float)
        for term, w in zip(terms, weights, strict=True):
            for j, x in postings[term]:
                cos[j] += w * x
            postings[term].append((i, w))
        for j, c in cos.items():
            if (not across or tiles[i] != tiles[j]) and (c >= LINK_COS - 1e-9 or (c >= ANCHOR_LINK_COS - 1e-9 and anchors[i] & anchors[j])):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [(root(i), i) for i in range(len(rows))]


def subjects(articles: DataFrame, model: DataFrame, cut: Callable[[DataFrame], DataFrame], tile: int = TILE) -> DataFrame:
    """(story, id, subject, keeps): the articles of each story (story, id, title, summary) by subject, named by its least article.

    Two articles are linked by the cosine of their rare_vectors, LINK_COS, or ANCHOR_LINK_COS if they share an anchor; links close transitively.
    The largest subject (then the least) keeps the story's row; the others leave it.  A story of up to ``tile`` articles is settled in one grouped
    pass; a larger one is cut into tiles, pairs of which are compared in passes of their own, and only what each article is least linked to is joined up.
    """
    own = articles.select("story", "id", F.array_distinct(F.concat(T.anchors(F.col("title")), T.anchors(F.substring("summary", 1, 200)))).alias("anchors"))
    listed = rare_lists(articles.select("id", "title", "summary"), model)
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    rows = own.join(listed, "id", "left").select("story", "id", "anchors", empty("terms", "string"), empty("ws", "double"))
    sizes = own.groupBy("story").agg(F.count("*").alias("n"))
    rows = cut(rows.join(sizes, "story").withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")).withColumn("tile", F.pmod(F.xxhash64("id"), "tiles").cast("int")))
    others = F.sequence(F.lit(0), F.col("tiles") - 1)
    pairs = F.transform(others, lambda o: F.struct(F.least("tile", o).alias("x"), F.greatest("tile", o).alias("y")))
    spread = rows.select("story", "id", "anchors", "terms", "ws", "tile", F.explode(pairs).alias("p")).select("*", "p.x", "p.y").drop("p")

    def links(part: pd.DataFrame) -> pd.DataFrame:
        x, y = int(part["x"].iloc[0]), int(part["y"].iloc[0])
        part = part.sort_values("id").reset_index(drop=True)
        ids, story = part["id"].tolist(), part["story"].iloc[0]
        return pd.DataFrame([(story, ids[i], ids[j]) for i, j in _linked(part, x != y) if x == y or i != j], columns=["story", "a", "b"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("story", "id")}
    found = cut(spread.groupBy("story", "x", "y").applyInPandas(links, f"story {kinds['story']}, a {kinds['id']}, b {kinds['id']}"))
    node = lambda c: F.struct("story", F.col(c).alias("id"))
    parts = connected_components(found.select(node("a").alias("a"), node("b").alias("b")), cut).select("node.story", "node.id", F.col("component.id").alias("subject"))
    largest = parts.groupBy("story", "subject").agg(F.count("*").alias("n")).groupBy("story").agg(F.min(F.struct((-F.col("n")).alias("n"), "subject")).alias("first"))
    return parts.join(largest.select("story", F.col("first.subject").alias("first")), "story").select("story", "id", "subject", (F.col("subject") == F.col("first")).alias("keeps"))
