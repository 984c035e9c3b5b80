"""Registered queries over answers, choices and look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import answers, history, similarity
from ..sources import tables as t
from .knowledge import _tokens_sql
from .reporting import query


@query("""WITH s AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
b AS (SELECT conv_id, list({'label': left('turn ' || turn, 60), 'text': text} ORDER BY i) FILTER (length(text) >= 40) AS kept, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT conv_id, n, CASE WHEN len(kept) >= 2 THEN kept END AS kept FROM b),
q AS (SELECT s.conv_id, s.i, trim(CASE WHEN s.i % 3 = 2 THEN upper(left(text, 30)) ELSE left(text, 30) END) AS quote, CASE WHEN s.i % 4 = 3 THEN NULL ELSE s.i - 1 END AS claim FROM s),
f AS (SELECT q.conv_id, i, claim, quote FROM q JOIN k USING (conv_id) WHERE kept IS NOT NULL AND claim < n - 1 AND length(quote) >= 24 AND contains(array_to_string(list_transform(kept, lambda b: b.text), chr(10)), quote)),
d AS (SELECT conv_id, quote, arg_min(claim, i) AS claim, min(i) AS i FROM f GROUP BY ALL), a AS (SELECT conv_id, string_agg(claim || ':' || quote, '|' ORDER BY i) AS quotes FROM d GROUP BY 1)
SELECT k.conv_id, coalesce(len(kept), 0)::INT AS beats, quotes FROM k LEFT JOIN a USING (conv_id)""")
def story_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as beats of a story, and the quotes that stand in them word for word."""
    turn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = t.load(spark, sf_dir, "conversations").select("conv_id", "turn", "text", turn.alias("i"))
    start = F.substring(F.trim("text"), 1, 30)
    quote = F.when(F.col("i") % 3 == 2, F.upper(start)).otherwise(start)
    claim = F.when(F.col("i") % 4 == 3, "none").otherwise((F.col("i") - 1).cast("string"))
    beat = F.struct("i", F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("label"), F.col("text").alias("text"), claim.alias("claim"), quote.alias("quote"))
    own = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(beat)).alias("raw"))
    kept = own.select("conv_id", "raw", answers.beats(F.col("raw")).alias("kept"))
    told = kept.select("conv_id", "kept", answers.quotes(F.col("raw"), F.size("raw") - 1, F.col("kept")).alias("q"))
    return told.select("conv_id", F.coalesce(F.size("kept"), F.lit(0)).alias("beats"), F.array_join(F.transform("q", lambda x: F.concat_ws(":", x["claim"].cast("string"), x["quote"])), "|").alias("quotes"))


@query("""WITH c AS (SELECT o_orderkey AS id, o_custkey, list(lower(p_name) ORDER BY l_linenumber, l_partkey, l_suppkey) AS cited FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL),
s AS (SELECT id, cited, CASE id % 4 WHEN 0 THEN upper(cited[1]) || ' Times' WHEN 1 THEN ' ' || split_part(cited[-1], ' ', 2) || ' ' WHEN 2 THEN '' ELSE 'unknown' END AS said FROM c)
SELECT id, CASE WHEN lower(trim(said)) <> '' THEN list_filter(cited, lambda a: contains(lower(trim(said)), a) OR contains(a, lower(trim(said))))[1] END AS outlet FROM s""")
def outlet_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlets that answers name, as the ones really cited."""
    lines = t.load(spark, sf_dir, "lineitem").join(t.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    cited = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.lower("p_name").alias("p")))), lambda x: x["p"])
    own = lines.groupBy(F.col("l_orderkey").alias("id")).agg(cited.alias("cited"))
    form = F.col("id") % 4
    said = F.when(form == 0, F.concat(F.upper(F.get("cited", F.lit(0))), F.lit(" Times"))).when(form == 1, F.concat(F.lit(" "), F.split_part(F.element_at("cited", -1), F.lit(" "), F.lit(2)), F.lit(" "))).when(form == 2, "").otherwise("unknown")
    return own.select("id", answers.outlet(said, F.col("cited")).alias("outlet"))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem),
e AS (SELECT l_orderkey AS id, list(trim(CASE WHEN i % 5 = 0 THEN '  ' ELSE 'S' || l_suppkey END) ORDER BY i) FILTER (i % 5 > 0) AS names FROM l WHERE i <= 40 GROUP BY 1),
m AS (SELECT l_orderkey AS id, count(*) FILTER (i % 4 = 1 OR (i % 4 > 1)) AS metrics FROM l WHERE i <= 30 GROUP BY 1),
r AS (SELECT l_orderkey AS id, count(*) FILTER (list_contains(list_transform(names, lambda n: lower(n)), 's' || l_suppkey) AND list_contains(list_transform(names, lambda n: lower(n)), 's' || (l_suppkey + (i % 3 - 1) * (1 + l_partkey % 2))) AND i % 3 <> 1) AS relations FROM l JOIN e ON e.id = l_orderkey WHERE i <= 30 GROUP BY 1)
SELECT o.l_orderkey AS id, coalesce(array_to_string(names, '|'), '') AS entities, coalesce(metrics, 0)::INT AS metrics, coalesce(relations, 0)::INT AS relations FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN e ON e.id = l_orderkey LEFT JOIN m ON m.id = l_orderkey LEFT JOIN r ON r.id = l_orderkey""")
def extraction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractions row by row: blank entities, values without a digit, relations with an end that was not extracted or to itself go."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    lines = t.load(spark, sf_dir, "lineitem").withColumn("i", place)
    supplier = lambda c: F.concat(F.lit("S"), c.cast("string"))
    entity = F.struct(F.when(F.col("i") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), supplier(F.col("l_suppkey")))).alias("name"))
    metric = F.struct(F.lit("").alias("name"), F.when(F.col("i") % 4 != 2, F.col("l_quantity")).alias("value"), F.when(F.col("i") % 4 == 0, "no figure").otherwise(F.concat(F.lit("rose by "), F.col("l_quantity").cast("string"))).alias("verbatim"))
    relation = F.struct(F.lower(supplier(F.col("l_suppkey"))).alias("subject"), F.lit(None).cast("string").alias("predicate"), supplier(F.col("l_suppkey") + (F.col("i") % 3 - 1) * (1 + F.col("l_partkey") % 2)).alias("object"))
    listed = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("i", entity.alias("e"), metric.alias("m"), relation.alias("r")))).alias("x"))
    part = lambda k: F.transform("x", lambda y: y[k])
    out = answers.extracted(listed.select("id", part("e").alias("entities"), part("m").alias("metrics"), part("r").alias("relations")))
    return out.select("id", F.array_join("entities", "|").alias("entities"), F.size("metrics").alias("metrics"), F.size("relations").alias("relations"))


@query("""WITH u AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN ' sports, ,weather' END AS override, CASE WHEN c_custkey % 7 = 0 THEN FALSE WHEN c_custkey % 7 = 1 THEN TRUE END AS enabled,
  CASE WHEN c_custkey % 3 = 0 THEN ['finance', 'gossip'] WHEN c_custkey % 3 = 1 THEN [] END AS chosen FROM customer)
SELECT id, CASE WHEN override IS NOT NULL THEN 'sports|weather' WHEN enabled = FALSE THEN NULL WHEN len(chosen) > 0 THEN 'finance' ELSE 'breaking|sports|finance|events' END AS categories,
CASE WHEN override IS NOT NULL THEN 'score' WHEN enabled = FALSE THEN NULL WHEN len(chosen) > 0 THEN 'market' ELSE 'breaking|score|market|event' END AS types FROM u""")
def live_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each reader sees of the live section: asked for, chosen, all, or nothing."""
    key = F.col("c_custkey")
    chosen = F.when(key % 3 == 0, F.array(F.lit("finance"), F.lit("gossip"))).when(key % 3 == 1, F.array().cast("array<string>"))
    own = t.load(spark, sf_dir, "customer").select(key.alias("id"), answers.live_categories(F.when(key % 5 == 0, " sports, ,weather"), F.when(key % 7 == 0, False).when(key % 7 == 1, True), chosen).alias("c"))
    return own.select("id", F.array_join("c", "|").alias("categories"), F.array_join(answers.card_types(F.col("c")), "|").alias("types"))


@query("""WITH a AS (SELECT l_orderkey AS story, l_linenumber, l_partkey, l_suppkey, l_shipdate, p_name || ' ' || p_type || ' of ' || p_brand || CASE WHEN l_linenumber % 2 = 0 THEN ' sold in large lots all over the country, line ' || l_linenumber || ' ' || l_partkey || ' ' || l_suppkey ELSE '' END AS summary,
  p_name || ' is told here in a headline that is long enough' || CASE WHEN p_partkey % 2 = 0 THEN '!' ELSE '' END AS title FROM lineitem JOIN part ON p_partkey = l_partkey),
o AS (SELECT *, row_number() OVER (PARTITION BY story ORDER BY l_shipdate, l_linenumber * 1000000 + l_partkey, summary, title) AS i FROM a),
p AS (SELECT story, i, CASE WHEN length(summary) > 40 AND row_number() OVER (PARTITION BY story, lower(summary) ORDER BY i) = 1 THEN summary ELSE title END AS piece FROM o),
d AS (SELECT story, arg_min(piece, i) AS piece, min(i) AS i FROM p GROUP BY story, lower(piece))
SELECT story, string_agg(CASE WHEN regexp_matches(piece, '[.!?]$') THEN piece ELSE piece || '.' END, ' ' ORDER BY i) AS narrative FROM d GROUP BY 1""")
def stand_in_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories that are not written yet, told by their articles in order of time."""
    lines = t.load(spark, sf_dir, "lineitem").join(t.load(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    summary = F.concat(F.concat_ws(" ", "p_name", "p_type", F.lit("of"), "p_brand"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" sold in large lots all over the country, line "), F.concat_ws(" ", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")))).otherwise(""))
    title = F.concat("p_name", F.lit(" is told here in a headline that is long enough"), F.when(F.col("l_partkey") % 2 == 0, "!").otherwise(""))
    return answers.stand_in(lines.select(F.col("l_orderkey").alias("story"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("id"), F.col("l_shipdate").alias("at"), summary.alias("summary"), title.alias("title")))


@query("""SELECT id, headline, kind FROM (SELECT o_orderkey AS id, o_orderpriority AS headline, 'finance' AS kind, o_orderdate AS at_ FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = o_orderkey AND (contains(lower(p_name), 'gizmo') OR p_brand LIKE '%Brand#7%'))) ORDER BY at_ DESC, id LIMIT 50""")
def entity_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories that mention an entity or its ticker, newest first."""
    return answers.stories_of("Gizmo", "BRAND#7", *_mentions(spark, sf_dir), limit=80).drop("at")


@query("""SELECT doc_id AS id, split_part(text, chr(10), 1) AS headline, 'news' AS kind FROM documents WHERE contains(lower(split_part(text, chr(10), 1) || ' ' || left(text, 600)), 'the') ORDER BY doc_id % 168, doc_id LIMIT 10""")
def entity_stories_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for what no finance story mentions: the general stories' words are looked at instead."""
    return answers.stories_of("The", "THE", *_mentions(spark, sf_dir)).drop("at")


def _mentions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = t.load(spark, sf_dir, "lineitem").join(t.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand"), "l_partkey")
    named = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("p_name").alias("entities"), F.collect_set("p_brand").alias("tickers"))
    finance = t.load(spark, sf_dir, "orders").join(named, "o_orderkey").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("headline"), "entities", "tickers", F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    general = t.articles(spark, sf_dir).select("id", F.col("title").alias("headline"), F.col("summary").alias("narrative"), F.col("fetched_at").alias("created_at"))
    return finance, general


@query(f"""WITH w AS (SELECT doc_id AS id, term, 1 + ln(count(*)) AS tf FROM (SELECT doc_id, unnest({_tokens_sql("split_part(text, chr(10), 1)")}) AS term FROM documents) GROUP BY ALL),
i AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf FROM w GROUP BY 1),
r AS (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY round(tf * idf, 9) DESC, term) AS place FROM w JOIN i USING (term))
SELECT id, string_agg(term, ' ' ORDER BY place) AS keys FROM r WHERE place <= 12 GROUP BY 1""")
def blocking_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve weightiest words of each title, by which articles are brought together."""
    docs = t.articles(spark, sf_dir)
    counts = docs.select("id", F.explode(T.tokens(F.col("title"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    weighed = counts.join(similarity.idf(counts.select("id", "term"), docs.count()), "term").withColumn("w", F.round((1 + F.log("tf")) * F.col("idf"), 9))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("w"), "term"))
    return weighed.withColumn("place", place).where("place <= 12").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]), " ").alias("keys"))


@query("""WITH p AS (SELECT c_custkey, c_nationkey AS city, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n, c_acctbal FROM customer)
SELECT n_nationkey AS reader, c_custkey AS story, place::INT AS place FROM (SELECT n_nationkey, c_custkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY city <> n_nationkey, c_acctbal DESC, c_custkey) AS place FROM nation, p WHERE n = 1)""")
def own_city_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading story of each city for readers of every city: their own first, the others in their order."""
    best = F.max_by(F.struct("c_custkey", "c_acctbal"), F.struct("c_acctbal", -F.col("c_custkey"))).alias("x")
    leading = t.load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("city")).agg(best).select("city", "x.*")
    readers = t.load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("reader"))
    place = F.row_number().over(Window.partitionBy("reader").orderBy(F.col("city") != F.col("reader"), F.desc("c_acctbal"), "c_custkey"))
    return leading.crossJoin(F.broadcast(readers)).select("reader", F.col("c_custkey").alias("story"), place.alias("place"))  # a row a city on both sides


@query("""SELECT l_orderkey AS story_id, arg_max(l_linenumber, (l_shipdate, l_linenumber, l_suppkey, l_partkey)) AS seq, arg_max(l_suppkey, (l_shipdate, l_linenumber, l_suppkey, l_partkey)) AS src FROM lineitem GROUP BY 1""")
def latest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each story in its change log."""
    return history.latest(t.story_history(spark, sf_dir), "story_id", ["at", "seq", "src", "part"]).select("story_id", "seq", "src")


@query(r"""WITH f AS (SELECT doc_id AS id, trim(regexp_replace(left(text, 600), '\s+', ' ', 'g')) AS x FROM documents) SELECT id, CASE WHEN length(x) > 60 THEN rtrim(left(x, 59)) || '…' ELSE x END AS teaser FROM f""")
def teasers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries on one line, cut at 60 characters."""
    return t.articles(spark, sf_dir).select("id", T.clip(F.col("summary"), 60).alias("teaser"))


@query("""WITH r AS (SELECT user_id % 20 AS stage, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'skipped' ELSE 'ok' END AS status FROM events)
SELECT (SELECT count(DISTINCT user_id) FROM events) AS users, (SELECT count(*) FROM r) AS runs, (SELECT count(*) FROM r WHERE status = 'error') AS failed, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS pending, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P' AND o_custkey IN (SELECT user_id FROM events)) AS pending_of_users""")
def ops_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users, runs and repairs that wait, for the operations page."""
    events = t.load(spark, sf_dir, "events")
    waiting = t.load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    runs = events.agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("runs"), F.count_if(F.col("event_type") == "error").alias("failed"))
    of_users = t.ids_of(waiting, events.select(F.col("user_id").alias("id"))).agg(F.count("*").alias("pending_of_users"))
    return runs.crossJoin(waiting.agg(F.count("*").alias("pending"))).crossJoin(of_users)  # one row each
