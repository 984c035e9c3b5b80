"""How stories and trends come together: labels, attachments, groups, dimensions, graph builds."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from . import tiles

#: Where a chain's step stands in time.
STEP_HORIZON = ("Immediate (days)", "Weeks", "1-3 months", "3-6 months", "6-12 months")
#: Entities and cosine that an article shares with the trend it continues.
ATTACH_ENTITIES, ATTACH_COSINE = 2, 0.30
#: Trends of an article whose cosines are taken at once.
BATCH = 32
#: Order of live cards by type.
TYPE_RANK = {"breaking": 0, "event": 1, "score": 2, "market": 3}


def with_members(groups: DataFrame, ids: str, members: DataFrame, key: str) -> DataFrame:
    """Each id of an array column with its place, joined to its row in members."""
    placed = groups.select(*[c for c in groups.columns if c != ids], F.posexplode(ids).alias("pos", key))
    return placed.join(members, key)


def labelled_or_overlapping(labelled: DataFrame, overlapping: DataFrame, group: str) -> DataFrame:
    """Rows of ``labelled``, and of ``overlapping`` for the groups that have none there."""
    return labelled.unionByName(overlapping.join(labelled.select(group).distinct(), group, "left_anti"))


def summed_maps(rows: DataFrame, group: str, column: str) -> DataFrame:
    """(group, key, n): maps of counts added up by key."""
    return rows.select(group, F.explode(column).alias("key", "n")).groupBy(group, "key").agg(F.sum("n").alias("n"))


def count_map(values: Column) -> Column:
    """{value: how often} of an array, in the order of values."""
    distinct = F.array_sort(F.array_distinct(values))
    return F.map_from_entries(F.transform(distinct, lambda v: F.struct(v, F.size(F.filter(values, lambda x: x == v)))))


def best_attachment(rows: DataFrame, item: str, group: str, least_shared: int, least_score: float) -> DataFrame:
    """One group an item: of (item, group, shared, score) the best score among those that reach both bounds, ties to the lesser group."""
    fit = rows.where((F.col("shared") >= least_shared) & (F.col("score") >= least_score))
    return fit.groupBy(item).agg(F.max_by(group, F.struct("score", -F.col(group))).alias(group), F.max("score").alias("score"))


def unit_vectors(texts: DataFrame) -> DataFrame:
    """(id, term, w) of texts (id, text): counts of trend words, of unit length."""
    words = texts.select("id", F.explode(T.trend_tokens(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    norms = words.groupBy("id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    return words.join(norms, "id").select("id", "term", (F.col("tf") / F.col("norm")).alias("w"))


def continued_trends(articles: DataFrame, trends: DataFrame, least_shared: int = ATTACH_ENTITIES, least_cosine: float = ATTACH_COSINE) -> DataFrame:
    """(article, trend, shared, cos): the trend (id, text, entities) that an article (id, text, entities) continues, if any.

    Both must share ``least_shared`` entities and texts of ``least_cosine``; the likest trend wins, ties to the lesser id.  Articles meet trends in pairs
    of tiles: postings count shared entities, and cosines are taken exactly in the order of their bounds, until no bound reaches the best.  Only the best
    of each tile moves on.
    """
    kind = articles.schema["id"].dataType.simpleString()
    worded = lambda rows: rows.select("id", F.array_distinct("entities").alias("entities"), T.trend_tokens(F.col("text")).alias("words")).where((F.size("entities") >= least_shared) & (F.size("words") > 0))
    side = lambda rows: worded(rows).withColumn("words", F.array_join("words", " "))
    columns = ("id", "entities", "words")

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in chain.from_iterable(p.itertuples(index=False) for p in parts):
            n, (ids, entities, words) = len(part[0]), (list(chain(*sides)) for sides in zip(part[:3], part[3:], strict=True))
            counts, named = tiles.Counts([w.split(" ") for w in words]), tiles.Counts(entities)
            one, other = np.arange(n), n + np.array(sorted(range(len(ids) - n), key=lambda j: ids[n + j]), dtype=np.int64)
            postings = named.postings(other)
            out = []
            for i, bound in tiles.bounds(counts, one, other):
                shared = np.bincount(np.concatenate([postings[c] for c in named.of(one[i]) if c in postings] or [np.empty(0, dtype=np.int64)]), minlength=len(other))
                met = np.flatnonzero((shared >= least_shared) & (bound >= least_cosine - tiles.SLACK))
                met = met[np.argsort(-bound[met], kind="stable")]
                best = None
                for start in range(0, len(met), BATCH):
                    some = met[start : start + BATCH]
                    if best is not None and bound[some[0]] + tiles.SLACK < best[0]:
                        break
                    for j, cos in zip(some, counts.cosines(one[i], other[some]), strict=True):
                        if cos >= least_cosine - 1e-12 and (best is None or (round(cos, 9), -j) > best[:2]):
                            best = (round(cos, 9), -j, cos)
                if best is not None:
                    out.append((ids[one[i]], ids[other[-best[1]]], shared[-best[1]], best[2]))
            yield pd.DataFrame(out, columns=["article", "trend", "shared", "cos"])

    spread = tiles.paired(side(articles), side(trends)).select(*[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("one", "other") for c in columns])
    found = spread.mapInPandas(compare, f"article {kind}, trend {kind}, shared long, cos double")
    best = F.max_by(F.struct("trend", "shared", "cos"), F.struct(F.round("cos", 9), -F.col("trend")))
    return found.groupBy("article").agg(best.alias("x")).select("article", "x.*")


def inherited_groups(components: DataFrame, prior: DataFrame) -> DataFrame:
    """(id, group_id): a component takes the group of its earliest member that has one, else its own number.

    components: id, component; prior: id, group_id (null: none), at.
    """
    known = components.join(prior.where("group_id IS NOT NULL"), "id").groupBy("component").agg(F.min_by("group_id", F.struct("at", "id")).alias("old"))
    return components.join(known, "component", "left").select("id", F.coalesce("old", F.col("component").cast("string")).alias("group_id"))


def first_by_substring(rows: DataFrame, text: str, dimension: DataFrame, longest: bool = False) -> DataFrame:
    """Rows with ``value`` of the dimension's first key (by place), or longest one, that the text contains; null if none.

    The dimension (key, value, place) is a file of a few hundred lines and travels with each row as one array.
    """
    order = F.struct((-F.length("key") if longest else F.col("place")).alias("o"), "place", "key", "value")
    keys = dimension.agg(F.array_sort(F.collect_list(order)).alias("__keys"))
    hit = F.filter("__keys", lambda k: F.contains(F.lower(F.col(text)), F.lower(k["key"])))
    return rows.crossJoin(F.broadcast(keys)).withColumn("value", F.try_element_at(hit, F.lit(1))["value"]).drop("__keys")


def unambiguous(index: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of keys that name one value only."""
    return index.groupBy(key).agg(F.min(value).alias(value), F.countDistinct(value).alias("__n")).where("__n = 1").drop("__n")


def merged_nodes(mentions: DataFrame) -> DataFrame:
    """Nodes out of mentions (node, type, ticker, at): how often, the first ticker, and the first type that says more than organization, else the last."""
    vague = F.col("type").isin("", "organization")
    return mentions.groupBy("node").agg(
        F.count("*").alias("mentions"), F.min_by("ticker", F.when(F.col("ticker").isNotNull(), F.col("at"))).alias("ticker"),
        F.coalesce(F.min_by("type", F.when(~vague, F.col("at"))), F.max_by("type", "at")).alias("type"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
    )


def chain_steps(paths: DataFrame) -> DataFrame:
    """Steps of paths (seed, nodes, confidences): order, node, elasticity (1, then the confidence of the edge before) and horizon."""
    horizon = F.array(*[F.lit(h) for h in STEP_HORIZON])
    steps = paths.select("seed", F.array_join("nodes", ">").alias("signature"), "confidences", F.posexplode("nodes").alias("step", "node"))
    return steps.select("seed", "signature", "step", "node", F.when(F.col("step") == 0, 1.0).otherwise(F.round(F.get("confidences", F.col("step") - 1), 3)).alias("elasticity"), F.get(horizon, F.least("step", F.lit(len(STEP_HORIZON) - 1))).alias("horizon"))


def connections(entities: DataFrame, cosine: DataFrame, seen: DataFrame, limit: int = 12, most: float = 0.3) -> DataFrame:
    """The pairs (a, b, shared) that share most entities (id, key) though their texts are unlike and that were not seen before.

    cosine: (a, b, cos) of pairs whose texts share a word; a pair without a row has 0.
    """
    left, right = entities.select("key", F.col("id").alias("a")), entities.select("key", F.col("id").alias("b"))
    shared = left.join(right, "key").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    apart = shared.join(cosine, ["a", "b"], "left").where(F.coalesce("cos", F.lit(0.0)) <= most + 1e-12).drop("cos")
    return apart.join(seen, ["a", "b"], "left_anti").orderBy(F.desc("shared"), "a", "b").limit(limit)


def live_cards(cards: DataFrame, limit: int = 12) -> DataFrame:
    """Cards (id, type, priority) in their order: by type, then priority."""
    rank = F.coalesce(*[F.when(F.col("type") == k, v) for k, v in TYPE_RANK.items()], F.lit(9))
    return cards.withColumn("rank", rank).orderBy("rank", F.desc("priority"), "id").limit(limit)


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last run of each stage (stage, status, at, id)."""
    last = F.max_by(F.struct("status", "at"), F.struct("at", "id"))
    return runs.groupBy("stage").agg(last.alias("last"), F.count_if(F.col("status") == "error").alias("errors"), F.count("*").alias("runs")).select("stage", "last.*", "errors", "runs")


def verdict(status: Column, age_hours: Column, interval_hours: float) -> Column:
    """Whether a stage works: never run, gated, failing, stale after two intervals, or healthy."""
    return F.when(status.isNull(), "never_run").when(status == "skipped", "gated").when(status == "error", "failing").when(age_hours > 2 * interval_hours, "stale").otherwise("healthy")
