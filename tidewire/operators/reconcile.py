"""Snapshots that absorb new rows: upserts, retirement, retention, greedy matches."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connected_components


def merge_counters(stored: DataFrame, fresh: DataFrame, keys: list[str], sums: list[str], first: str | None = None, last: str | None = None) -> DataFrame:
    """Counters of both, added up by key; the earliest ``first`` and the latest ``last``."""
    measures = [F.sum(c).alias(c) for c in sums]
    measures += [F.min(first).alias(first)] if first else []
    measures += [F.max(last).alias(last)] if last else []
    return stored.unionByName(fresh, allowMissingColumns=True).groupBy(*keys).agg(*measures)


def reconcile(stored: DataFrame, fresh: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, action, values): insert what is new, update what changed, keep what did not, retire what is gone; retired rows keep their values."""
    old = stored.select(key, F.struct(*values).alias("__old"))
    new = fresh.select(key, F.struct(*values).alias("__new"))
    joined = old.join(new, key, "full")
    action = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "retire").when(F.col("__old").eqNullSafe(F.col("__new")), "keep").otherwise("update")
    return joined.select(key, action.alias("action"), F.coalesce("__new", "__old").alias("__row")).select(key, "action", "__row.*")


def retire(rows: DataFrame, updated: str, now: Column, days: int) -> DataFrame:
    """Live rows not changed for so many days get retired_at = now; no row goes."""
    old = F.col(updated) < F.timestamp_seconds(F.unix_timestamp(now) - days * 86_400)
    return rows.withColumn("retired_at", F.when(F.col("retired_at").isNull() & old, now).otherwise(F.col("retired_at")))


def keep_since(rows: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Rows of the last so many days: hard retention on rewrite."""
    return rows.where(F.col(at) >= F.timestamp_seconds(F.unix_timestamp(now) - days * 86_400))


def touching(edges: DataFrame, nodes: DataFrame, a: str, b: str) -> DataFrame:
    """Edges with an end among nodes (id): two equi-joins, not one with OR."""
    left = edges.join(nodes.select(F.col("id").alias(a)), a, "left_semi")
    right = edges.join(nodes.select(F.col("id").alias(b)), b, "left_semi")
    return left.select(*edges.columns).unionByName(right.select(*edges.columns)).distinct()


def overlaps(members: DataFrame, group: str, member: str, least: int) -> DataFrame:
    """Pairs (a, b, shared) of groups that share members, a < b; members of one group only join nothing."""
    own = members.select(group, member).distinct()
    several = own.groupBy(member).agg(F.count("*").alias("n")).where("n > 1").select(member)
    kept = own.join(several, member, "left_semi")
    pairs = kept.select(member, F.col(group).alias("a")).join(kept.select(member, F.col(group).alias("b")), member).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def best_match(candidates: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """Pairs that are the best of both their ends, ties to the lesser id."""
    place = lambda by, other: F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), other))
    return candidates.withColumn("__l", place(left, right)).withColumn("__r", place(right, left)).where("__l = 1 AND __r = 1").drop("__l", "__r")


def _in_components(pairs: DataFrame, a: Column, b: Column, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs with the component of the graph that they hang in; only pairs of one component can bear on each other."""
    groups = connected_components(pairs.select(a.alias("a"), b.alias("b")), cut)
    return pairs.join(groups.withColumnsRenamed({"node": "__node", "component": "__component"}), a == F.col("__node")).drop("__node")


#: Candidates that one task may settle at once.
SMALL_MATCH = 200_000


def _mutual_bests(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """Rows that come first for both their ends: highest score, then lesser left, then right id."""
    best = lambda by, other: pairs.groupBy(by).agg(F.max_by(F.struct(*pairs.columns), F.struct(score, -F.col(other))).alias("x")).select("x.*")
    return best(left, right).join(best(right, left).select(left, right), [left, right]).select(*pairs.columns)


def greedy_match(candidates: DataFrame, left: str, right: str, score: str, cut: Callable[[DataFrame], DataFrame], small: int = SMALL_MATCH) -> DataFrame:
    """One to one, highest score first, ties to the lesser left, then right id (ids are numbers).

    A pair that comes first for both its ends is taken whatever the others are; without its ends, others come first.  Rounds of that take the
    greedy matching; once ``small`` candidates are left, each component of them is settled in one grouped pass.
    """
    pairs, columns = cut(candidates.where(F.col(left).isNotNull() & F.col(right).isNotNull())), list(candidates.columns)
    rounds = []
    while (n := pairs.count()) > small:
        taken = cut(_mutual_bests(pairs, left, right, score))
        rounds.append(taken)
        pairs = cut(pairs.join(taken.select(left), left, "left_anti").join(taken.select(right), right, "left_anti").select(*columns))
    node = lambda side, c: F.struct(F.lit(side).alias("side"), F.col(c).alias("id"))

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([score, left, right], ascending=[False, True, True], kind="stable")
        one, other, taken = set(), set(), []
        for a, b in zip(rows[left], rows[right], strict=True):
            free = a not in one and b not in other
            taken.append(free)
            if free:
                one.add(a)
                other.add(b)
        return rows.loc[taken, columns]

    rest = _in_components(pairs, node(0, left), node(1, right), cut).groupBy("__component").applyInPandas(settle, pairs.schema) if n else pairs
    return reduce(DataFrame.unionByName, rounds, rest)


def keep_first(rows: DataFrame, conflicts: DataFrame, key: str, order: list[Column], cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows kept when taken in order (key must settle ties) and each is left out that conflicts with one kept before: (key, kept_by), the row itself or the first kept one it conflicts with.

    conflicts: pairs (a, b) of keys, in either direction.  Each component of conflicts is settled in one grouped pass over ids and order; a row without any is kept.
    """
    turn = [f"__o{i}" for i in range(len(order) + 1)]
    ranked = cut(rows.select(F.col(key).alias("id"), *[c.alias(o) for o, c in zip(turn, [*order, F.col(key)], strict=True)]))
    pairs = conflicts.select("a", "b").unionByName(conflicts.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    met = cut(_in_components(cut(pairs), F.col("a"), F.col("b"), cut).join(ranked.withColumnRenamed("id", "a"), "a"))
    kind = ranked.schema["id"].dataType.simpleString()

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(turn, kind="stable")
        partners = part.groupby("a", sort=False)["b"].agg(list)
        place = {a: i for i, a in enumerate(partners.index)}
        kept, out = set(), []
        for a, others in partners.items():
            before = min((b for b in others if b in kept), key=place.__getitem__, default=None)
            if before is None:
                kept.add(a)
            out.append((a, a if before is None else before))
        return pd.DataFrame(out, columns=["id", "kept_by"])

    found = met.groupBy("__component").applyInPandas(settle, f"id {kind}, kept_by {kind}")
    return ranked.select("id").join(found, "id", "left").select(F.col("id").alias(key), F.coalesce("kept_by", "id").alias("kept_by"))


def keep_best(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """One row a key, the first in order."""
    place = F.row_number().over(Window.partitionBy("__key").orderBy(*order))
    return rows.withColumn("__key", key).withColumn("__place", place).where("__place = 1").drop("__key", "__place")
