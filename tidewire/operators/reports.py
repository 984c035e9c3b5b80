"""Audience, traffic, user and model-spend reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_start(now: Column, days: int) -> Column:
    """The beginning of a report of so many days that ends now; 1 to 365 days."""
    days = min(max(days, 1), 365)
    return F.timestamp_seconds(F.unix_timestamp(now) - (days - 1) * 86_400)


def dense_days(daily: DataFrame, now: Column, days: int, zero: list[str]) -> DataFrame:
    """A row for each day of the window; measures of days without rows are 0."""
    last = F.to_date(now)
    calendar = daily.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    return calendar.join(daily, "day", "left").select("day", *[F.coalesce(c, F.lit(0)).alias(c) for c in zero])


def audience_totals(visits: DataFrame, now: Column, days: int) -> DataFrame:
    """Devices and views in the window; new devices are those first seen in it, over all history."""
    start = window_start(now, days)
    totals = visits.where(F.col("created_at") >= start).agg(F.countDistinct("device").alias("devices"), F.count("*").alias("views"))
    fresh = visits.groupBy("device").agg(F.min("created_at").alias("first")).where(F.col("first") >= start).agg(F.count("*").alias("new_devices"))
    return totals.join(F.broadcast(fresh)).withColumn("returning", F.greatest(F.lit(0), F.col("devices") - F.col("new_devices")))  # one row each


def audience_daily(visits: DataFrame, now: Column, days: int) -> DataFrame:
    daily = visits.where(F.col("day") >= F.to_date(window_start(now, days))).groupBy("day").agg(F.countDistinct("device").alias("devices"), F.count("*").alias("views"))
    return dense_days(daily, now, days, ["devices", "views"])


def top_values(visits: DataFrame, column: str, now: Column, days: int, n: int = 15) -> DataFrame:
    kept = visits.where((F.col("created_at") >= window_start(now, days)) & (F.col(column) != ""))
    return kept.groupBy(column).agg(F.count("*").alias("views"), F.countDistinct("device").alias("devices")).orderBy(F.desc("views"), column).limit(n)


def loyalty(visits: DataFrame, now: Column, days: int) -> DataFrame:
    per_device = visits.where(F.col("created_at") >= window_start(now, days)).groupBy("device").agg(F.countDistinct("day").alias("days"))
    return per_device.agg(F.round(F.avg("days"), 4).alias("avg_days"), F.max("days").alias("max_days"))


def traffic(hits: DataFrame, days: int) -> DataFrame:
    """From (day, route, hits): total, mean a day, busiest day (the first of the busiest)."""
    daily = hits.groupBy("day").agg(F.sum("hits").alias("hits"))
    return daily.agg(F.sum("hits").alias("total"), F.round(F.sum("hits") / days, 4).alias("per_day"), F.max_by("day", F.struct("hits", -F.unix_date("day"))).alias("busiest_day"))


def spend(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """Usage with its cost: fresh input, output and cached input at the card's rates per million, twice at peak; null if unpriced."""
    priced = usage.withColumn("key", F.concat_ws("/", "provider", "model")).join(F.broadcast(rates), "key", "left")
    fresh = F.greatest(F.col("prompt") - F.col("cached"), F.lit(0))
    cost = (fresh * F.col("r_in") + F.col("completion") * F.col("r_out") + F.col("cached") * F.col("r_cached")) / 1e6 * F.when(F.col("peak"), 2.0).otherwise(1.0)
    return priced.withColumn("cost", cost)


def spend_measures() -> list[Column]:
    calls = F.count("*")
    return [
        calls.alias("calls"), F.count_if("failed").alias("failed"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.sum("cached").alias("cached"),
        F.round(F.sum("cost"), 8).alias("cost"), F.round(F.try_divide(F.sum(F.col("prompt") + F.col("completion")), calls), 4).alias("avg_tokens"),
        F.round(F.coalesce(F.try_divide(100.0 * F.count_if("failed"), calls), F.lit(0.0)), 4).alias("fail_rate"),
    ]


def user_activity(users: DataFrame, saves: DataFrame, reactions: DataFrame, visits: DataFrame) -> DataFrame:
    """Users (id) with numbers saved and reacted to, and when last seen: three aggregates, joined."""
    saved = saves.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("saved"))
    reacted = reactions.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("reactions"))
    seen = visits.groupBy(F.col("device").alias("id")).agg(F.max("created_at").alias("last_seen"))
    joined = users.join(saved, "id", "left").join(reacted, "id", "left").join(seen, "id", "left")
    return joined.select("id", F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("reactions", F.lit(0)).alias("reactions"), "last_seen")
