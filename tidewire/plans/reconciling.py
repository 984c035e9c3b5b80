"""Registered queries over snapshots, sets and ladders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..functions import text as T
from ..operators import feed, reconcile
from ..operators.checkpoint import cut
from ..sources import tables as t
from .reporting import ORACLE_SQL, QUERIES, query

__all__ = ["ORACLE_SQL", "QUERIES"]


@query("""SELECT user_id, event_type AS route, count(*) AS hits, floor(epoch(min(ts)))::BIGINT AS first_at, floor(epoch(max(ts)))::BIGINT AS last_at FROM events GROUP BY ALL""")
def counter_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored counters of the first half of the month, and the second half's."""
    own = t.visits(spark, sf_dir).select(F.col("device").alias("user_id"), F.col("path").alias("route"), "created_at")
    count = lambda rows: rows.groupBy("user_id", "route").agg(F.count("*").alias("hits"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    edge = t.moment("2024-01-16 00:00:00")
    merged = reconcile.merge_counters(count(own.where(F.col("created_at") < edge)), count(own.where(F.col("created_at") >= edge)), ["user_id", "route"], ["hits"], "first_at", "last_at")
    return merged.withColumns({c: F.unix_timestamp(c) for c in ("first_at", "last_at")})


@query("""WITH old AS (SELECT user_id, event_type = 'view' AS v, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-03' AND event_type = 'view' GROUP BY ALL),
new AS (SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-28' AND event_type = 'view' GROUP BY ALL)
SELECT coalesce(o.user_id, n.user_id) AS user_id, CASE WHEN o.user_id IS NULL THEN 'insert' WHEN n.user_id IS NULL THEN 'retire' WHEN o.n = n.n THEN 'keep' ELSE 'update' END AS action, coalesce(n.n, o.n) AS n
FROM old o FULL JOIN new n ON o.user_id = n.user_id""")
def trend_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = t.visits(spark, sf_dir).where("path = 'view'").select(F.col("device").alias("user_id"), "created_at")
    count = lambda rows: rows.groupBy("user_id").agg(F.count("*").alias("n"))
    return reconcile.reconcile(count(own.where(F.col("created_at") < t.moment("2024-01-03 00:00:00"))), count(own.where(F.col("created_at") >= t.moment("2024-01-28 00:00:00"))), "user_id", ["n"])


@query(f"""WITH {t.STORIES_SQL} SELECT id, CASE WHEN kind = 'F' THEN '1999-01-01' WHEN updated_at < TIMESTAMP '2001-10-06' THEN '2001-11-05' END AS retired_at FROM stories WHERE updated_at >= TIMESTAMP '2000-01-01'""")
def soft_retirement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retired after 30 days without change; rows retired before stay so; older than the retention limit go."""
    own = t.stories(spark, sf_dir).withColumn("retired_at", F.when(F.col("kind") == "F", t.moment("1999-01-01 00:00:00")))
    now = t.moment(t.STORIES_NOW)
    kept = reconcile.keep_since(own, "updated_at", now, 674)
    return reconcile.retire(kept, "updated_at", now, 30).select("id", F.date_format("retired_at", "yyyy-MM-dd").alias("retired_at"))


@query(f"""WITH {t.EDGES_SQL}, n AS (SELECT 'C' || c_custkey AS id FROM customer WHERE c_acctbal < 0)
SELECT DISTINCT subject, predicate, object FROM edges WHERE subject IN (SELECT id FROM n) OR object IN (SELECT id FROM n)""")
def edges_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = t.load(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.concat(F.lit("C"), "c_custkey").alias("id"))
    return reconcile.touching(t.kg_edges(spark, sf_dir).drop("confidence"), nodes, "subject", "object")


@query("""WITH m AS (SELECT DISTINCT l_suppkey % 40 AS g, l_orderkey AS m FROM lineitem)
SELECT x.g AS a, y.g AS b, count(*) AS shared FROM m x JOIN m y ON x.m = y.m AND x.g < y.g GROUP BY ALL HAVING count(*) >= 3""")
def trend_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = t.load(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("g"), F.col("l_orderkey").alias("m"))
    return reconcile.overlaps(members, "g", "m", 3)


@query("""WITH c AS (SELECT l_suppkey AS a, l_partkey AS b, round(sum(l_quantity), 2) AS score FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS x, row_number() OVER (PARTITION BY b ORDER BY score DESC, a) AS y FROM c)
SELECT a, b, score FROM r WHERE x = 1 AND y = 1""")
def best_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = t.load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).agg(F.round(F.sum("l_quantity"), 2).alias("score"))
    return reconcile.best_match(scored, "a", "b", "score")


@query()
def greedy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts matched one to one, the highest totals first."""
    scored = t.load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).agg(F.round(F.sum("l_quantity"), 2).alias("score"))
    return reconcile.greedy_match(scored, "a", "b", "score", cut)


@query("""SELECT p_partkey, p_type, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_type), p_size ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) WHERE place = 1""")
def forecast_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One a title (type and size), that of the highest confidence (price)."""
    rows = t.load(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    return reconcile.keep_best(rows, F.struct(F.lower("p_type"), "p_size"), [F.desc("p_retailprice"), F.col("p_partkey")]).drop("p_size")


@query(f"""WITH {t.STORIES_SQL} SELECT id, CASE WHEN source_count >= 4 OR n_articles >= 5 THEN 'deep' WHEN source_count >= 2 OR n_articles >= 2 THEN 'standard' ELSE 'brief' END AS depth,
CASE WHEN credibility >= 85 THEN 'very high' WHEN credibility >= 70 THEN 'high' WHEN credibility >= 55 THEN 'fair' WHEN credibility >= 40 THEN 'mixed' ELSE 'low' END AS agreement FROM stories""")
def story_ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = t.stories(spark, sf_dir)
    return own.select("id", scores.depth_hint(F.col("source_count"), F.col("n_articles")).alias("depth"), scores.agreement(F.col("credibility")).alias("agreement"))


@query("""WITH p AS (SELECT l_orderkey AS story_id, list(least(1.0, greatest(-1.0, (l_quantity - 25) / 20))) AS p FROM lineitem GROUP BY 1),
s AS (SELECT story_id, CASE WHEN len(p) >= 2 THEN round(list_max(p) - list_min(p), 4) END AS span FROM p)
SELECT story_id, span, CASE WHEN span >= 1 THEN 'wide' WHEN span >= 0.5 THEN 'moderate' WHEN span IS NOT NULL THEN 'narrow' END AS framing FROM s""")
def framing(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = t.load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("story_id")).agg(F.collect_list((F.col("l_quantity") - 25) / 20).alias("p"))
    return positions.select("story_id", *scores.spread(F.col("p")))


@query("""SELECT l_orderkey AS story_id, count_if(l_returnflag = 'A')::INT AS verified, count_if(l_returnflag = 'R')::INT AS disputed, count_if(l_returnflag NOT IN ('A', 'R'))::INT AS unverified FROM lineitem GROUP BY 1""")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.when(F.col("l_returnflag") == "A", "Corroborated by two").when(F.col("l_returnflag") == "R", " disputed").otherwise("open")
    return t.load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("story_id")).agg(F.collect_list(word).alias("v")).select("story_id", *scores.verdicts(F.col("v")))


@query("""WITH s AS (SELECT l_orderkey AS story_id, sum((l_discount * 20 - 1) * l_quantity) / coalesce(nullif(sum(l_quantity), 0), count(*)) AS net, CASE WHEN count(*) < 2 THEN 0.0 ELSE stddev_pop(l_discount * 20 - 1) END AS d FROM lineitem GROUP BY 1)
SELECT story_id, round(net, 4) + 0 AS net, round(d, 4) AS dispersion, CASE WHEN round(net, 4) > 0 THEN 'up' WHEN round(net, 4) < 0 THEN 'down' ELSE 'flat' END AS direction FROM s""")
def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    score, weight = F.col("l_discount") * 20 - 1, F.col("l_quantity")
    net = F.sum(score * weight) / F.coalesce(F.nullif(F.sum(weight), F.lit(0.0)), F.count("*"))
    own = t.load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("story_id")).agg((F.round(net, 4) + 0).alias("net"), F.round(F.when(F.count("*") < 2, 0.0).otherwise(F.stddev_pop(score)), 4).alias("dispersion"))
    return own.withColumn("direction", scores.direction(F.col("net")))


@query("""SELECT event_type, count(json_extract(props, '$.k')) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total, max(json_extract(props, '$.k')::BIGINT) AS largest FROM events GROUP BY 1""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return t.load(spark, sf_dir, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.max(k).alias("largest"))


#: Ids of several rows that are broadcast; if there are more, texts move to them.
MOST_SHARED_IDS = 100_000


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[a-z]{4,}'), 1) AS p FROM documents),
c AS (SELECT doc_id, w, count(*) AS n, min(p) AS p FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS place FROM c)
SELECT doc_id, string_agg(w, ' ' ORDER BY place) AS keywords FROM r WHERE place <= 3 GROUP BY 1""")
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent words of four letters or more, ties by first use."""
    own = t.articles(spark, sf_dir).select(F.col("id").alias("doc_id"), "text")
    several = own.groupBy("doc_id").agg(F.count("*").alias("rows")).where((F.col("rows") > 1) | F.col("doc_id").isNull()).select(F.col("doc_id").alias("other"))
    several = F.broadcast(several) if several.limit(MOST_SHARED_IDS + 1).count() <= MOST_SHARED_IDS else several
    alone = own.join(several, F.col("doc_id") == F.col("other"), "left_anti").where("doc_id IS NOT NULL")  # a text is counted where it lies; only rows that share an id move
    single = alone.select("doc_id", T.frequent_words(F.lower("text"), F.lit(3)).alias("keywords")).where("keywords IS NOT NULL")
    shared = own.join(several, F.col("doc_id").eqNullSafe(F.col("other")), "left_semi")
    words = shared.select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("p", "w"))
    counts = words.groupBy("doc_id", "w").agg(F.count("*").alias("n"), F.min("p").alias("p"))
    best = feed.top_per_group(counts, ["doc_id"], [F.desc("n"), F.col("p")], 3)
    return single.unionByName(best.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "p", "w"))), lambda x: x["w"]), " ").alias("keywords")))


@query(f"""WITH {t.STORIES_SQL}
(SELECT 'story' AS section, id::VARCHAR AS id FROM stories ORDER BY updated_at DESC, stories.id LIMIT 200) UNION ALL (SELECT 'part', p_partkey::VARCHAR FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50)
UNION ALL (SELECT 'source', s_suppkey::VARCHAR FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 50)""")
def sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = lambda name, rows, key, order, n: rows.orderBy(F.desc(order), key).limit(n).select(F.lit(name).alias("section"), F.col(key).cast("string").alias("id"))
    out = section("story", t.stories(spark, sf_dir), "id", "updated_at", 200).unionByName(section("part", t.load(spark, sf_dir, "part"), "p_partkey", "p_retailprice", 50))
    return out.unionByName(section("source", t.load(spark, sf_dir, "supplier"), "s_suppkey", "s_acctbal", 50))


ADVICE_SQL = "|".join(f"(?:{p})" for p in scores.ADVICE)


@query(f"""SELECT conv_id, turn, regexp_matches(lower(text), '{ADVICE_SQL}') AS advice, regexp_replace(regexp_replace(lower(trim(role)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS role FROM conversations""")
def conversation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.load(spark, sf_dir, "conversations").select("conv_id", "turn", scores.advice_in(F.col("text")).isNotNull().alias("advice"), scores.snake(F.col("role")).alias("role"))


@query(f"""WITH {t.STORIES_SQL} SELECT c_custkey AS user_id, count(*) AS n FROM customer JOIN stories ON owner = c_custkey WHERE topic IN (CASE WHEN c_mktsegment = 'BUILDING' THEN '1-URGENT' ELSE '2-HIGH' END) GROUP BY 1""")
def relevant_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    interests = F.array(F.when(F.col("c_mktsegment") == "BUILDING", "1-URGENT").otherwise("2-HIGH"))
    joined = t.stories(spark, sf_dir).join(t.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), interests.alias("interests")), "owner")
    kept = joined.where(feed.relevant(F.col("topic"), F.array(F.lit("")), F.col("interests")))
    return kept.groupBy(F.col("owner").alias("user_id")).agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '(?is)<p\b')) AS paragraphs, length(html) AS chars FROM pages""")
def page_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.load(spark, sf_dir, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit(r"(?is)<p\b"), F.lit(0))).cast("long").alias("paragraphs"), F.length("html").cast("long").alias("chars"))
