"""Registered queries over the knowledge graph, texts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import prose as P
from ..functions import text as T
from ..operators import graph, similarity
from ..operators.components import connected_components
from ..operators.checkpoint import cut
from ..sources import tables as t
from .reporting import ORACLE_SQL, QUERIES, query

__all__ = ["ORACLE_SQL", "QUERIES"]


@query(f"WITH {t.EDGES_SQL} SELECT node, count(*) AS degree, sum(o)::BIGINT AS out_degree FROM (SELECT subject AS node, 1 AS o FROM edges UNION ALL SELECT object, 0 FROM edges) GROUP BY 1")
def kg_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(t.kg_edges(spark, sf_dir))


@query("""SELECT 'S' || l_suppkey AS subject, 'supplies' AS predicate, 'P' || l_partkey AS object, max(round(1 - l_discount, 4)) AS confidence, count(DISTINCT l_orderkey) AS stories, count(*) AS seen FROM lineitem GROUP BY ALL""")
def kg_edges_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.load(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("subject"), F.lit("supplies").alias("predicate"), F.concat(F.lit("P"), "l_partkey").alias("object"), F.round(1 - F.col("l_discount"), 4).alias("confidence"), F.col("l_orderkey").alias("story_id"))
    return graph.merge_edges(rows).select("subject", "predicate", "object", "confidence", F.size("story_ids").cast("long").alias("stories"), "seen")


@query(f"""WITH RECURSIVE {t.EDGES_SQL}, deg AS (SELECT node, count(*) AS d FROM (SELECT subject AS node FROM edges UNION ALL SELECT object FROM edges) GROUP BY 1),
strong AS (SELECT * FROM edges WHERE confidence >= 0.35),
both_ AS (SELECT subject AS here, object AS there, * FROM strong UNION ALL SELECT object, subject, * FROM strong WHERE subject <> object),
walk(node, hop) AS (
  SELECT 'S' || s_suppkey, 0 FROM supplier WHERE s_acctbal < 2500
  UNION
  SELECT b.there, w.hop + 1 FROM walk w JOIN both_ b ON b.here = w.node LEFT JOIN deg ON deg.node = w.node WHERE w.hop < 2 AND (w.hop = 0 OR deg.d <= 40)),
reach AS (SELECT node, min(hop) AS hop FROM walk GROUP BY 1)
SELECT b.subject, b.predicate, b.object, min(r.hop)::INT AS hop, round(max(b.confidence) * pow(0.75, min(r.hop)), 4) AS impact
FROM reach r JOIN both_ b ON b.here = r.node LEFT JOIN deg ON deg.node = r.node WHERE r.hop = 0 OR deg.d <= 40 GROUP BY ALL""")
def kg_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = t.load(spark, sf_dir, "supplier").where("s_acctbal < 2500").select(F.concat(F.lit("S"), "s_suppkey").alias("node"))
    return graph.cascade(t.kg_edges(spark, sf_dir), seeds, cut)


@query(f"""WITH RECURSIVE {t.EDGES_SQL}, deg AS (SELECT node, count(*) AS d FROM (SELECT subject AS node FROM edges UNION ALL SELECT object FROM edges) GROUP BY 1),
beam AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY confidence DESC, object) AS place FROM edges WHERE confidence >= 0.4) WHERE place <= 4),
paths(seed, path, joint, last) AS (
  SELECT 'S' || s_suppkey, ['S' || s_suppkey], 1.0::DOUBLE, 'S' || s_suppkey FROM supplier
  UNION ALL
  SELECT seed, list_append(path, object), joint * confidence, object FROM paths JOIN beam ON subject = last LEFT JOIN deg ON node = last WHERE (len(path) = 1 OR d <= 40) AND len(path) <= 3 AND NOT list_contains(path, object)),
r AS (SELECT seed, array_to_string(path, '>') AS path, (len(path) - 1)::INT AS hops, round(joint, 6) AS joint FROM paths WHERE len(path) > 1)
SELECT seed, path, hops, joint FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hops DESC, joint DESC, path) AS place FROM r) WHERE place = 1""")
def kg_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = t.load(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("node"))
    return graph.beam_paths(t.kg_edges(spark, sf_dir), seeds)


@query("""SELECT l_orderkey AS chain, round(product(1 - l_discount), 6) AS joint, round(exp(avg(ln(greatest(1 - l_discount, 0.01)))), 6) AS overall FROM lineitem GROUP BY 1""")
def chain_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = 1 - F.col("l_discount")
    return t.load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("chain")).agg(F.round(F.product(c), 6).alias("joint"), F.round(F.exp(F.avg(F.log(F.greatest(c, F.lit(0.01))))), 6).alias("overall"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(least(0.98, greatest(0.1, CASE WHEN l_quantity - 25 >= 0 THEN (1 - l_discount) + l_discount * 0.4 * ((l_quantity - 25) / 100.0) ELSE (1 - l_discount) * (1 + 0.5 * ((l_quantity - 25) / 100.0)) END)), 6) AS p FROM lineitem""")
def shock_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(graph.shocked(1 - F.col("l_discount"), F.col("l_quantity") - 25), 6).alias("p"))


@query("""WITH e AS (SELECT l_suppkey AS subject, l_partkey AS object FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-08-01')
SELECT s_suppkey AS id FROM supplier WHERE s_suppkey IN (SELECT subject FROM e UNION SELECT object FROM e)""")
def orphan_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = t.load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject"), F.col("l_partkey").alias("object"), F.col("l_shipdate").cast("timestamp").alias("updated_at"))
    nodes = t.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return graph.prune(nodes, edges, t.moment("2001-08-01 00:00:00"))[0]


@query()
def shared_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories that share a source's report (supplier and part), directly or through others, as connected components."""
    rows = t.load(spark, sf_dir, "lineitem")
    return connected_components(rows.select(F.col("l_orderkey").alias("a"), (F.lit(1 << 61) + F.xxhash64("l_suppkey", "l_partkey").bitwiseAND((1 << 60) - 1)).alias("b")), cut)


STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(T.STOP_WORDS))) + "]"


def _tokens_sql(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower({column}), '[a-z0-9][a-z0-9''\\-]*'), lambda w: length(w) >= 2 AND NOT list_contains({STOP_SQL}, w))"


@query(f"""WITH w AS (SELECT DISTINCT doc_id AS id, unnest({_tokens_sql("split_part(text, chr(10), 1)")}) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT term, count(*) AS df, round(ln((any_value(n) + 1) / (count(*) + 1)) + 1, 6) AS idf FROM w, n GROUP BY 1""")
def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.articles(spark, sf_dir)
    terms = docs.select("id", F.explode(F.array_distinct(T.tokens(F.col("title")))).alias("term"))
    return similarity.idf(terms, docs.count()).withColumn("idf", F.round("idf", 6))


@query(f"""WITH s AS (SELECT doc_id AS id, source, array_to_string(list_sort({_tokens_sql("split_part(text, chr(10), 1)")}), ' ') AS key, epoch(TIMESTAMP '2024-02-01') - (doc_id % 168) * 3600 AS at_ FROM documents)
SELECT id, first FROM (SELECT id, first_value(id) OVER (PARTITION BY source, key ORDER BY at_, id) AS first FROM s WHERE key <> '') WHERE id <> first""")
def same_source_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.same_source_copies(t.articles(spark, sf_dir))


@query(r"""SELECT page_id, regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '^www\.', '') AS host FROM pages""")
def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.load(spark, sf_dir, "pages").select("page_id", T.host(F.col("url")).alias("host"))


@query(r"""WITH n AS (SELECT DISTINCT doc_id, replace(unnest(regexp_extract_all(text, '\b\d[\d,]*(?:\.\d+)?\b')), ',', '') AS n FROM documents) SELECT doc_id, count(*)::INT AS numbers, string_agg(n, ' ' ORDER BY n) AS listed FROM n GROUP BY 1""")
def doc_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = t.load(spark, sf_dir, "documents").select("doc_id", F.array_sort(T.numbers(F.col("text"))).alias("n"))
    return own.where(F.size("n") > 0).select("doc_id", F.size("n").alias("numbers"), F.array_join("n", " ").alias("listed"))


@query(f"""WITH w AS (SELECT lang AS kind, term, ts FROM (SELECT lang, unnest({_tokens_sql("split_part(text, chr(10), 1)")}) AS term, doc_id AS ts FROM documents))
SELECT kind, lower(term) AS norm, count(*) AS seen, min(ts) AS first_seen, max(ts) AS last_seen FROM w GROUP BY ALL HAVING count(*) > 1""")
def gazetteer_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.articles(spark, sf_dir).select(F.col("topic").alias("kind"), F.explode(T.tokens(F.col("title"))).alias("norm"), "id")
    return rows.groupBy("kind", "norm").agg(F.count("*").alias("seen"), F.min("id").alias("first_seen"), F.max("id").alias("last_seen")).where("seen > 1")


@query()
def event_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.event_groups(t.articles(spark, sf_dir), cut)


@query()
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.load(spark, sf_dir, "pages").select("page_id", P.html_to_text("html").alias("prose"))


@query()
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.articles(spark, sf_dir).select("id", F.posexplode(P.sentences("text")).alias("pos", "sentence"))


#: Articles of a story that its brief is made from, newest first: a rule of the brief.
BRIEF_ARTICLES = 12
BRIEF_CHARS = 2600


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of stories, a row each; an article without any has a row without a fact.  Bodies are read where they lie; only their facts move, those of the newest articles of each story."""
    own = t.articles(spark, sf_dir).withColumn("story_id", F.col("id") % 97 + 100 * F.floor(F.col("id") / 1000))
    told = own.select("story_id", "id", "fetched_at", "source", P.facts("title", "text").alias("f"))
    newest = told.withColumn("place", F.row_number().over(Window.partitionBy("story_id").orderBy(F.desc("fetched_at"), "id"))).where(F.col("place") <= BRIEF_ARTICLES)
    rows = newest.select("story_id", "place", "source", (F.regexp_extract("source", r"\d+", 0).try_cast("int") % 4 + 1).alias("tier"), F.col("f.title").alias("title"), F.posexplode_outer("f.facts").alias("pos", "fact"))
    return rows.withColumns({"words": T.tokens(F.col("fact")), "info": similarity.info_score(F.col("fact")), "numbers": T.numbers(F.col("fact")), "tier": F.coalesce("tier", F.lit(4))})


@query()
def fact_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.fact_clusters(_facts(spark, sf_dir).where("fact IS NOT NULL").select("story_id", "place", "pos", "words"))


@query()
def brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A story's brief, from its newest articles' facts."""
    return similarity.briefs(_facts(spark, sf_dir), BRIEF_CHARS)
