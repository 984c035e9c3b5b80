"""Scores, ranks and the joins of the served lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the ranking rules.
CYCLE_HOURS = 6.0
DECAY = 1.5
IMAGE_BOOST = 1.15
INTEREST_BOOST = 8.0


def hours_between(late: Column, early: Column) -> Column:
    return (F.unix_timestamp(late) - F.unix_timestamp(early)) / 3600.0


def age_cycles(now: Column, created: str = "created_at", updated: str = "updated_at") -> Column:
    """Age in refresh cycles: since the last change, but at least half of the age since birth."""
    touched, born = hours_between(now, F.col(updated)), hours_between(now, F.col(created))
    return F.greatest(F.greatest(touched, 0.5 * born), F.lit(0.0)) / CYCLE_HOURS


def rank_score(impact: Column, age: Column, has_image: Column | None = None) -> Column:
    score = F.greatest(impact, F.lit(0.0)) / F.pow(1 + age, F.lit(DECAY))
    return score if has_image is None else score * F.when(has_image, IMAGE_BOOST).otherwise(1.0)


def recent_impact(n_articles: str, credibility: str, interesting: Column) -> Column:
    """Log of coverage, weighted by interest and credibility."""
    return F.log1p(n_articles) * F.when(interesting, INTEREST_BOOST).otherwise(1.0) * (0.6 + 0.9 * F.coalesce(F.col(credibility), F.lit(0.0)) / 100)


def credibility_prior(sources: Column, best_tier: Column) -> Column:
    return F.least(F.lit(95), 35 + 15 * sources + 5 * (4 - best_tier))


def breaking_score(sources: Column, keyword: Column, age_hours: Column) -> Column:
    """Corroboration (three sources or more) or a keyword, faded by age; 0 after six hours."""
    corroborated = F.when(sources >= 3, F.least(F.lit(1.0), sources / 3.0)).otherwise(0.0)
    recency = F.greatest(F.lit(0.0), 1 - age_hours / 6.0)
    score = F.greatest(corroborated, F.when(keyword, 0.9).otherwise(0.0)) * (0.5 + 0.5 * recency)
    return F.when(age_hours > 6, 0.0).otherwise(F.round(score, 3))


def unread(stories: DataFrame, read: DataFrame, key: str = "id") -> DataFrame:
    """Stories that a reader has not opened; read has story_id."""
    return stories.join(read.select(F.col("story_id").alias(key)).distinct(), key, "left_anti")


def merged_feed(news: DataFrame, finance: DataFrame) -> DataFrame:
    """News rows and finance rows, without the news rows whose event a finance row covers."""
    covered = finance.where("event_id IS NOT NULL").select("event_id").distinct()
    return finance.unionByName(news.join(covered, "event_id", "left_anti").select(*finance.columns))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")


def mode_by_group(df: DataFrame, group: str, value: str, first: str) -> DataFrame:
    """The most frequent value of a group; ties go to the value whose least ``first`` is least."""
    counts = df.where((F.col(value).isNotNull()) & (F.col(value).cast("string") != "")).groupBy(group, value).agg(F.count("*").alias("n"), F.min(first).alias("at"))
    return counts.groupBy(group).agg(F.max_by(value, F.struct("n", -F.col("at"))).alias(value), F.max("n").alias("n"))


def search(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows where a column holds the text, whatever its case; % and _ are ordinary characters."""
    if not query:
        return df.limit(0)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.col(c)), F.lower(F.lit(query)))
    return df.where(hit)


def relevant(topic: Column, words: Column, interests: Column) -> Column:
    """A story is relevant if its topic is an interest, or all words of an interest are among its words."""
    return F.array_contains(interests, topic) | F.exists(interests, lambda i: F.size(F.array_except(F.split(F.lower(i), r"\s+"), words)) == 0)
