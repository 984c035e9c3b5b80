"""Change logs: what changed, where it peaked, how far it fell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Points of credibility lost from the peak from which a story counts as weakened.
WEAKENED_DROP = 8.0


def changes(log: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Rows whose columns differ from the row before them in the key's order (null-safe); the first row of a key is one."""
    by = Window.partitionBy(key).orderBy(*order)
    before = F.lag(F.struct(*columns)).over(by)
    first = F.row_number().over(by) == 1
    return log.withColumn("__before", before).withColumn("__first", first).where(F.col("__first") | ~F.struct(*columns).eqNullSafe(F.col("__before"))).drop("__before", "__first")


def latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, by one aggregate: no sort of whole groups."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(key, "__row.*")


def corrections(log: DataFrame) -> DataFrame:
    """(story_id, kind, delta, peak, now) of stories that are contested, conflicting or weakened since their peak.

    log: story_id, at, seq, credibility, disputed, conflicts.  The peak is the first highest credibility; contested:
    more disputes than at first; conflicting: more conflicts than at first without a drop; weakened: a drop of
    WEAKENED_DROP points or more.
    """
    order = F.struct("at", "seq")
    shape = log.groupBy("story_id").agg(
        F.max("credibility").alias("peak"), F.max_by("credibility", order).alias("now"), F.min_by("disputed", order).alias("d0"), F.max_by("disputed", order).alias("d1"),
        F.min_by("conflicts", order).alias("c0"), F.max_by("conflicts", order).alias("c1"), F.count("*").alias("n"),
    ).where("n > 1")
    kind = F.when(F.col("d1") > F.col("d0"), "contested").when(F.col("peak") - F.col("now") >= WEAKENED_DROP, "weakened").when(F.col("c1") > F.col("c0"), "conflicting")
    return shape.select("story_id", kind.alias("kind"), F.round(F.col("now") - F.col("peak"), 2).alias("delta"), "peak", "now").where("kind IS NOT NULL")


def progress(events: DataFrame, finished: float = 0.9) -> DataFrame:
    """Reading progress from events (user_id, story_id, at, progress): the highest, when it was first finished, opens."""
    reached = F.when(F.col("progress") >= finished, F.col("at"))
    return events.groupBy("user_id", "story_id").agg(F.max("progress").alias("progress"), F.min(reached).alias("completed_at"), F.count("*").alias("updates"))
