"""Answers to questions that cost a call: from the cache, from a group's representative, from memory, else asked in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gazetteer

#: Questions of one call.
BATCH = 20
CACHE = "hash string, task string, response string, created_at timestamp"


def cache_key(task: Column, prompt: Column) -> Column:
    """Task and prompt, told apart by a zero byte, as SHA-256."""
    return F.sha2(F.concat(F.coalesce(task, F.lit("")), F.lit("\x00"), F.coalesce(prompt, F.lit(""))), 256)


def cached(requests: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """requests (task, prompt, ...) with hash and response: what the cache holds that is not older than the TTL and parses, else null; a TTL of 0 serves nothing."""
    alive = cache.where((F.unix_timestamp("created_at") >= F.unix_timestamp(now) - ttl_seconds) & F.try_parse_json("response").isNotNull())
    known = alive.groupBy("hash").agg(F.max_by("response", "created_at").alias("response")) if ttl_seconds > 0 else cache.select("hash", "response").limit(0)
    return requests.withColumn("hash", cache_key(F.col("task"), F.col("prompt"))).join(known, "hash", "left")


def put(cache: DataFrame, answers: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """The cache with new answers (hash, task, response) in place of old ones, without what has expired: written as the next version."""
    fresh = answers.where("response IS NOT NULL").select("hash", F.substring("task", 1, 40).alias("task"), "response", now.alias("created_at"))
    both = cache.unionByName(fresh).groupBy("hash").agg(F.max_by(F.struct("task", "response", "created_at"), "created_at").alias("last")).select("hash", "last.*")
    return purge(both, now, ttl_seconds)


def purge(cache: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    return cache.where(F.unix_timestamp("created_at") >= F.unix_timestamp(now) - ttl_seconds)


def drop(cache: DataFrame, hashes: DataFrame) -> DataFrame:
    """The cache without some answers (hash): those that proved wrong."""
    return cache.join(hashes.select("hash").distinct(), "hash", "left_anti")


def asked(questions: DataFrame, ask: Callable[[list[str]], list[str | None]], batch: int = BATCH) -> DataFrame:
    """(hash, response) of distinct questions (hash, prompt), asked ``batch`` at a time; a call that fails, or answers another number of questions, leaves its batch without answers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                try:
                    answers = ask(part["prompt"].tolist())
                except Exception:  # noqa: BLE001 - one bad call costs its batch, not the stage
                    answers = []
                yield pd.DataFrame({"hash": part["hash"], "response": answers if len(answers) == len(part) else [None] * len(part)})

    return questions.select("hash", "prompt").dropDuplicates(["hash"]).mapInPandas(run, "hash string, response string")


def filled(articles: DataFrame, memory: DataFrame, cache: DataFrame, ask: Callable[[list[str]], list[str | None]], now: Column, ttl_seconds: int, cut: Callable[[DataFrame], DataFrame], batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """Entities of articles (id, group_id, title, summary, entities) that lack them: (id, tier, response), and the answers to put into the cache.

    A group is asked for once: by its representative (the article that the group is named by; without one, its least article).  Tiers: copied (the
    representative has entities), matched (memory accounts for the whole text), cached, called, failed (to be tried again).
    """
    lacking = articles.where("entities IS NULL OR entities = ''").select("id", F.coalesce("group_id", "id").alias("g"))
    rep = articles.where(F.col("id") == F.coalesce("group_id", "id")).select(F.col("id").alias("g"), F.col("title").alias("t"), F.col("summary").alias("s"), F.nullif("entities", F.lit("")).alias("e"))
    least = articles.join(lacking.select("id"), "id", "left_semi").groupBy(F.coalesce("group_id", "id").alias("g")).agg(F.min_by(F.struct("title", "summary"), "id").alias("own"))
    groups = cut(least.join(rep.withColumn("found", F.lit(True)), "g", "left").select("g", F.when(F.col("found"), F.col("t")).otherwise(F.col("own.title")).alias("title"), F.when(F.col("found"), F.col("s")).otherwise(F.col("own.summary")).alias("summary"), "e"))
    copied = groups.where("e IS NOT NULL").select("g", F.lit("copied").alias("tier"), F.col("e").alias("response"))
    open_ = groups.where("e IS NULL")
    known = cut(gazetteer.match(open_.select(F.col("g").alias("id"), "title", "summary"), memory))
    matched = known.where("reason = 'matched'").select(F.col("id").alias("g"), F.lit("matched").alias("tier"), F.to_json(F.struct("entities", "sectors", "regions")).alias("response"))
    rest = open_.join(known.where("reason <> 'matched'").select(F.col("id").alias("g")), "g", "left_semi")
    requests = cut(cached(rest.select("g", F.lit("entities").alias("task"), F.concat_ws("\n", "title", "summary").alias("prompt")), cache, now, ttl_seconds))
    answers = cut(asked(requests.where("response IS NULL"), ask, batch))
    called = requests.where("response IS NULL").select("g", "hash").join(answers, "hash").select("g", F.when(F.col("response").isNotNull(), "called").otherwise("failed").alias("tier"), "response")
    by_group = copied.unionByName(matched).unionByName(requests.where("response IS NOT NULL").select("g", F.lit("cached").alias("tier"), "response")).unionByName(called)
    return lacking.join(by_group, "g").select("id", "tier", "response"), answers.select("hash", F.lit("entities").alias("task"), "response")
