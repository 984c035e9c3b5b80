"""Readers, snapshot writers, and the domain tables bound to the star-schema fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment for which reports over events and stories are made; operators take it as a parameter.
EVENTS_NOW = "2024-01-31 00:00:00"
STORIES_NOW = "2001-11-05 00:00:00"
ARTICLES_NOW = "2024-02-01 00:00:00"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def log_run(spark: SparkSession, path: str, stage: str, status: str, detail: str, at: Column) -> None:
    """Append one line to the log of runs; readers see whole files only."""
    spark.range(1).select(F.lit(stage).alias("stage"), F.lit(status).alias("status"), F.lit(detail).alias("detail"), at.alias("at")).coalesce(1).write.mode("append").parquet(path)


def ids_of(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows with one of the ids, each once: a semi-join, whatever the number of ids."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A bundled sample: one JSON array of objects."""
    return spark.read.schema(schema).json(path, multiLine=True)


def load_quotes(spark: SparkSession, path: str) -> DataFrame:
    """Index quotes from CSV, with the move since opening in percent (null if there is no opening)."""
    quotes = spark.read.option("header", True).schema("symbol string, open double, close double").csv(path)
    return quotes.withColumn("pct", F.round(F.try_divide(F.col("close") - F.col("open"), F.col("open")) * 100, 2))


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("device"), F.col("event_type").alias("path"), F.col("ts").cast("timestamp").alias("created_at"), F.to_date("ts").alias("day"), "value",
        (F.col("event_id") % 1500).alias("story_id"),
    )


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A story an order: topic, times, number of articles and sources, credibility prior."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("updated_at"), F.count("*").alias("n_articles"), F.countDistinct("l_suppkey").alias("source_count"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate", "o_totalprice")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("topic"), F.col("o_orderstatus").alias("kind"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("updated_at").cast("timestamp").alias("updated_at"), "n_articles", "source_count", F.least(F.lit(95.0), 35.0 + 15.0 * F.col("source_count")).alias("credibility"), F.col("o_totalprice").alias("weight"),
    )


STORIES_SQL = """stories AS (
  SELECT o_orderkey AS id, o_custkey AS owner, o_orderpriority AS topic, o_orderstatus AS kind, o_orderdate AS created_at, updated_at, n_articles, source_count,
         least(95.0, 35.0 + 15.0 * source_count)::DOUBLE AS credibility, o_totalprice AS weight
  FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS updated_at, count(*) AS n_articles, count(DISTINCT l_suppkey) AS source_count FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""


def story_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change log of stories: a row a line, at its ship date; ties in time by line number."""
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("story_id"), F.col("l_shipdate").cast("timestamp").alias("at"), F.col("l_linenumber").alias("seq"), (100.0 * (1 - F.col("l_discount"))).alias("credibility_raw"),
        F.round(100.0 * (1 - F.col("l_discount")), 2).alias("credibility"), (F.col("l_linenumber") % 3).alias("disputed"), F.round(F.col("l_tax") * 100).cast("int").alias("conflicts"),
        F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("part"),
    ).drop("credibility_raw")


HISTORY_SQL = """history AS (
  SELECT l_orderkey AS story_id, l_shipdate AS at_, l_linenumber AS seq, round(100.0 * (1 - l_discount), 2) AS credibility, l_linenumber % 3 AS disputed,
         round(l_tax * 100)::INT AS conflicts, l_suppkey AS src, l_partkey AS part FROM lineitem)"""


def llm_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls: a row a line; half of the prompt's tokens are cached on odd lines, even days are peak."""
    return load(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("provider"), F.col("l_linestatus").alias("model"), F.col("l_linenumber").cast("string").alias("task"),
        F.round(F.col("l_quantity") * 100).cast("long").alias("prompt"), F.round(F.col("l_extendedprice")).cast("long").alias("completion"),
        F.when(F.col("l_linenumber") % 2 == 1, F.round(F.col("l_quantity") * 50).cast("long")).otherwise(F.lit(0)).alias("cached"), (F.col("l_suppkey") % 50 == 0).alias("failed"), (F.day("l_shipdate") % 2 == 0).alias("peak"),
    )


USAGE_SQL = """usage_ AS (
  SELECT l_shipdate::DATE AS day, l_returnflag AS provider, l_linestatus AS model, l_linenumber::VARCHAR AS task, round(l_quantity * 100)::BIGINT AS prompt, round(l_extendedprice)::BIGINT AS completion,
         CASE WHEN l_linenumber % 2 = 1 THEN round(l_quantity * 50)::BIGINT ELSE 0 END AS cached, l_suppkey % 50 = 0 AS failed, day(l_shipdate) % 2 = 0 AS peak FROM lineitem)"""

#: Rates per million tokens (input, output, cached) by provider/model; N/O is left unpriced.
RATES = {"A/F": (1.0, 10.0, 0.1), "A/O": (2.0, 4.0, 2.0), "R/F": (0.5, 1.5, 0.05), "R/O": (0.0, 0.0, 0.0), "N/F": (3.0, 15.0, 0.3)}
RATES_SQL = "rates(key, r_in, r_out, r_cached) AS (VALUES " + ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for k, (a, b, c) in RATES.items()) + ")"


def rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in RATES.items()], "key string, r_in double, r_out double, r_cached double")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article a document: the first line is the title, the first 600 characters are the summary."""
    return load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.substring("text", 1, 600).alias("summary"), "source", F.col("lang").alias("topic"),
        F.timestamp_seconds(F.unix_timestamp(moment(ARTICLES_NOW)) - (F.col("doc_id") % 168) * 3600).alias("fetched_at"), "text",
    )


def trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trend a document: its name is the first line, its kind the language, its members the lines; labelled ones are the stored ones."""
    lines = F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.md5(x)))
    labels = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    own = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), F.substring_index("text", "\n", 1).alias("name"), F.coalesce(lines, F.array().cast("array<string>")).alias("members"), "n_chars")
    return own.join(labels, "id", "left")


TRENDS_SQL = """trends AS MATERIALIZED (
  SELECT doc_id AS id, lang AS kind, split_part(text, chr(10), 1) AS name, coalesce(list_distinct(list_transform(str_split(text, chr(10)), lambda x: md5(x))), []) AS members, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"""


def kg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier -supplies-> customer -located_in-> nation -part_of-> region."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_discount")
    # in whole cents: a mean of discounts may lie on a rounding tie
    cents, n = F.sum(F.round(100 * (1 - F.col("l_discount"))).cast("long")), F.count("*")
    whole = F.floor((cents * 200 + n) / (n * 2)) / 10_000
    pairs = lines.join(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey", "o_custkey").agg(whole.alias("confidence"))
    supplies = pairs.select(F.concat(F.lit("S"), "l_suppkey").alias("subject"), F.lit("supplies").alias("predicate"), F.concat(F.lit("C"), "o_custkey").alias("object"), "confidence")
    located = load(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("subject"), F.lit("located_in").alias("predicate"), F.concat(F.lit("N"), "c_nationkey").alias("object"), F.lit(0.9).alias("confidence"))
    part = load(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("subject"), F.lit("part_of").alias("predicate"), F.concat(F.lit("R"), "n_regionkey").alias("object"), F.lit(0.95).alias("confidence"))
    return supplies.unionByName(located).unionByName(part)


EDGES_SQL = """pairs AS (
  SELECT l_suppkey, o_custkey, floor((sum(round(100 * (1 - l_discount))::BIGINT) * 200 + count(*)) / (count(*) * 2)) / 10000 AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
edges AS (
  SELECT 'S' || l_suppkey AS subject, 'supplies' AS predicate, 'C' || o_custkey AS object, confidence
  FROM pairs
  UNION ALL SELECT 'C' || c_custkey, 'located_in', 'N' || c_nationkey, 0.9 FROM customer
  UNION ALL SELECT 'N' || n_nationkey, 'part_of', 'R' || n_regionkey, 0.95 FROM nation)"""
