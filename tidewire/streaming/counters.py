"""Streaming counterparts of the running counters, views and change logs.

Inputs are streaming frames of visits or usage; every operator keeps its state
bounded by a watermark.  A sink is a function of a batch, so that a batch that
is written again after a failure leaves the same table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: Entries older than this when they arrive are dropped.
LATE = "12 hours"


def daily_hits(visits: DataFrame, late: str = LATE) -> DataFrame:
    """Hits by day and route, as events arrive."""
    return visits.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day").alias("w"), "path").agg(F.count("*").alias("hits")).select(F.to_date("w.start").alias("day"), "path", "hits")


def usage_counters(usage: DataFrame, late: str = LATE) -> DataFrame:
    """Calls and tokens by day, provider and model; usage has at (timestamp)."""
    keyed = usage.withWatermark("at", late).groupBy(F.window("at", "1 day").alias("w"), "provider", "model")
    return keyed.agg(F.count("*").alias("calls"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.min("at").alias("first_at"), F.max("at").alias("last_at")).withColumn("day", F.to_date("w.start")).drop("w")


def velocity(visits: DataFrame, late: str = LATE) -> DataFrame:
    """Counts in overlapping windows of 72 hours, one beginning each day."""
    return visits.withWatermark("created_at", late).groupBy(F.window("created_at", "72 hours", "24 hours").alias("w"), "path").agg(F.count("*").alias("n")).select("w.start", "w.end", "path", "n")


def first_arrivals(articles: DataFrame, late: str = LATE) -> DataFrame:
    """Each URL once, whatever is read again within the watermark."""
    return articles.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["url"])


_PROGRESS = "user_id long, story_id long, progress double, completed_at timestamp, updates long, ended boolean"


class _Progress(StatefulProcessor):
    """The state of one reader and story: best progress, when it was completed, how many updates, and the timer that ends it."""

    def __init__(self, finished: float, idle_ms: int) -> None:
        self.finished, self.idle_ms = finished, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "progress double, completed_at long, updates long, until long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best, done, n, until = self.best.get() if self.best.exists() else (0.0, None, 0, None)
        last = 0
        for frame in rows:
            at = frame["at"].astype("int64") // (1000 if str(frame["at"].dtype).startswith("datetime64[us") else 1_000_000)
            n += len(frame)
            last = max(last, int(at.max()))
            best = max(best, float(frame["progress"].max()))
            reached = at[frame["progress"] >= self.finished]
            if len(reached):
                done = int(reached.min()) if done is None else min(done, int(reached.min()))
        if until is None or last + self.idle_ms > until:
            if until is not None:
                self.handle.deleteTimer(until)
            until = last + self.idle_ms
            self.handle.registerTimer(until)
        self.best.update((best, done, n, until))
        yield self._row(key, best, done, n, False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best, done, n, _ = self.best.get()
        self.best.clear()
        yield self._row(key, best, done, n, True)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key: tuple, best: float, done: int | None, n: int, ended: bool) -> pd.DataFrame:
        at = pd.to_datetime([done], unit="ms")
        return pd.DataFrame({"user_id": [key[0]], "story_id": [key[1]], "progress": [best], "completed_at": at, "updates": [n], "ended": [ended]})


def reading_progress(events: DataFrame, finished: float = 0.9, idle_hours: int = 72, late: str = LATE) -> DataFrame:
    """Progress that never goes back and is completed once: (user_id, story_id, progress, completed_at, updates, ended) whenever it changes.

    events: user_id, story_id, at (timestamp), progress.  A reader and story without news for ``idle_hours`` of event time end with a
    row ``ended`` and hold no state any more; events behind the watermark are dropped.  Needs the RocksDB state store
    (with_rocksdb).
    """
    keyed = events.withWatermark("at", late).groupBy("user_id", "story_id")
    return keyed.transformWithStateInPandas(_Progress(finished, idle_hours * 3_600_000), _PROGRESS, "update", "eventTime")


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """The state store that timers need; for applications, which own their session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def changed_rows(read_last: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], key: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands on the rows that differ from the last snapshot."""

    def emit(batch: DataFrame, _: int) -> None:
        last = read_last()
        if last is None:
            write(batch)
            return
        rest = [c for c in batch.columns if c != key]
        old = last.select(F.col(key), F.struct(*rest).alias("__old"))
        joined = batch.join(old, key, "left").where(~F.struct(*rest).eqNullSafe(F.col("__old")))
        write(joined.drop("__old"))

    return emit
