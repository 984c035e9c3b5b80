"""Registered queries over stories, trends, dimensions and graph builds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assembly, graph
from ..operators.checkpoint import cut
from ..operators.components import connected_components
from ..sources import tables as t
from .reporting import query


@query("""SELECT story_id, pos, l_partkey AS article_id, p_name AS title FROM (SELECT l_orderkey AS story_id, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INT - 1 AS pos FROM lineitem) JOIN part ON p_partkey = l_partkey""")
def story_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles of each story in their order."""
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    stories = t.load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("story_id")).agg(F.transform(lines, lambda x: x["l_partkey"]).alias("article_ids"))
    return assembly.with_members(stories, "article_ids", t.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("article_id"), F.col("p_name").alias("title")), "article_id")


LABELS = """labelled AS (SELECT o_custkey AS trend, o_orderkey AS story FROM orders WHERE o_custkey IN (SELECT s_suppkey FROM supplier) AND o_orderpriority = '1-URGENT'),
told AS (SELECT * FROM labelled UNION ALL SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem WHERE l_linenumber = 1 AND l_suppkey NOT IN (SELECT trend FROM labelled))"""


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    trends = t.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("trend"))
    labelled = t.load(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("trend"), F.col("o_orderkey").alias("story")).join(trends, "trend", "left_semi")
    overlapping = t.load(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_suppkey").alias("trend"), F.col("l_orderkey").alias("story")).distinct()
    return assembly.labelled_or_overlapping(labelled, overlapping, "trend")


@query(f"WITH {LABELS} SELECT trend, story FROM told")
def trend_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of a trend: those labelled with it, or, without any, those that share its articles."""
    return _told(spark, sf_dir)


@query(f"""WITH {LABELS}, k AS (SELECT l_orderkey AS story, l_returnflag AS key, count(*) AS n, count_if(l_linenumber % 3 = 1) AS disputed FROM lineitem GROUP BY ALL)
SELECT trend, key, sum(n)::BIGINT AS n, count_if(disputed > 0) AS disputed FROM told JOIN k USING (story) GROUP BY ALL""")
def trend_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of sources over a trend's stories, added up, and how many stories dispute each."""
    kinds = t.load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("story"), F.col("l_returnflag").alias("key")).agg(F.count("*").alias("n"), F.count_if(F.col("l_linenumber") % 3 == 1).alias("disputed"))
    maps = kinds.groupBy("story").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("kinds"), F.map_from_entries(F.collect_list(F.struct("key", (F.col("disputed") > 0).cast("long")))).alias("disputes"))
    joined = _told(spark, sf_dir).join(maps, "story")
    return assembly.summed_maps(joined, "trend", "kinds").join(assembly.summed_maps(joined, "trend", "disputes").withColumnRenamed("n", "disputed"), ["trend", "key"])


@query(f"""WITH {LABELS}, h AS (SELECT l_orderkey AS story, max(100.0 * (1 - l_discount)) - arg_max(100.0 * (1 - l_discount), (l_shipdate, l_linenumber, l_suppkey, l_partkey)) AS drop FROM lineitem GROUP BY 1)
SELECT trend, count(*) AS stories, count_if(drop >= 7.995) AS weakened FROM told JOIN h USING (story) GROUP BY 1""")
def trend_weakened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a trend's stories lost credibility from their peak."""
    c = 100.0 * (1 - F.col("l_discount"))
    history = t.load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("story")).agg((F.max(c) - F.max_by(c, F.struct("l_shipdate", "l_linenumber", "l_suppkey", "l_partkey"))).alias("drop"))
    return _told(spark, sf_dir).join(history, "story").groupBy("trend").agg(F.count("*").alias("stories"), F.count_if(F.col("drop") >= 7.995).alias("weakened"))


KINDS = [("example.com", "newsroom", 1), ("example.net", "vendor", 2), ("m.", "mobile", 3), ("example.org", "blog", 4)]
KINDS_SQL = "dim(key, value, place) AS (VALUES " + ", ".join(map(str, KINDS)) + ")"


@query(f"""WITH {KINDS_SQL}, m AS (SELECT page_id, url, (SELECT value FROM dim WHERE contains(lower(url), key) ORDER BY place LIMIT 1) AS kind, (SELECT value FROM dim WHERE contains(lower(url), key) ORDER BY length(key) DESC, place LIMIT 1) AS place FROM pages)
SELECT page_id, coalesce(kind, 'unknown') AS kind, coalesce(place, '') AS place FROM m""")
def source_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outlet's kind, by the first line of the file that its URL contains, and its place, by the longest."""
    dimension = spark.createDataFrame(KINDS, "key string, value string, place int")
    kinds = assembly.first_by_substring(t.load(spark, sf_dir, "pages").select("page_id", "url"), "url", dimension).select("page_id", "url", F.coalesce("value", F.lit("unknown")).alias("kind"))
    return assembly.first_by_substring(kinds, "url", dimension, longest=True).select("page_id", "kind", F.coalesce("value", F.lit("")).alias("place"))


@query("""WITH c AS (SELECT l_orderkey AS story, l_returnflag AS kind, count(*) AS n FROM lineitem GROUP BY ALL) SELECT story, string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds FROM c GROUP BY 1""")
def source_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = t.load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("story")).agg(F.collect_list("l_returnflag").alias("k"))
    entries = F.map_entries(assembly.count_map(F.col("k")))
    return own.select("story", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("kinds"))


@query("""WITH i AS (SELECT lower(p_name) AS key, p_brand AS symbol FROM part WHERE p_size < 3), u AS (SELECT key, min(symbol) AS symbol FROM i GROUP BY 1 HAVING count(DISTINCT symbol) = 1),
n AS (SELECT p_partkey, lower(p_name) AS key, p_type AS proposed FROM part)
SELECT p_partkey, CASE WHEN key LIKE '%gear' THEN 'REG' ELSE coalesce(symbol, key) END AS canonical,
CASE WHEN key LIKE '%gear' THEN 'regulator' WHEN symbol IS NOT NULL THEN 'organization' WHEN proposed IN ('SMALL', 'LARGE') THEN lower(proposed) ELSE 'organization' END AS type FROM n LEFT JOIN u USING (key)""")
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name's canonical spelling and type: regulators first, then tickers that only one name claims, then what was proposed."""
    part = t.load(spark, sf_dir, "part")
    key = T.company_key(F.col("p_name"))
    index = assembly.unambiguous(part.where("p_size < 3").select(key.alias("key"), F.col("p_brand").alias("symbol")), "key", "symbol")
    regulators = part.where(F.col("p_name").endswith("gear")).select(key.alias("key"), F.lit("REG").alias("regulator")).distinct()
    own = part.select("p_partkey", key.alias("key"), F.lower("p_type").alias("proposed")).join(index, "key", "left").join(regulators, "key", "left")
    kind = F.when(F.col("regulator").isNotNull(), "regulator").when(F.col("symbol").isNotNull(), "organization").when(F.col("proposed").isin("small", "large"), F.col("proposed")).otherwise("organization")
    return own.select("p_partkey", F.coalesce("regulator", "symbol", "key").alias("canonical"), kind.alias("type"))


@query("""WITH m AS (SELECT 'S' || l_suppkey AS node, ['', 'organization', 'company', 'index'][1 + (l_partkey % 4)::INT] AS type, CASE WHEN l_discount > 0.08 THEN l_returnflag || l_linenumber END AS ticker, (l_shipdate, l_orderkey, l_linenumber, l_partkey) AS at_, l_shipdate FROM lineitem)
SELECT node, count(*) AS mentions, arg_min(ticker, at_) FILTER (ticker IS NOT NULL) AS ticker, coalesce(arg_min(type, at_) FILTER (type NOT IN ('', 'organization')), arg_max(type, at_)) AS type FROM m GROUP BY 1""")
def kg_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes merged from their mentions."""
    kind = F.get(F.array(*map(F.lit, ("", "organization", "company", "index"))), F.col("l_partkey") % 4)
    ticker = F.when(F.col("l_discount") > 0.08, F.concat("l_returnflag", F.col("l_linenumber").cast("string")))
    rows = t.load(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("node"), kind.alias("type"), ticker.alias("ticker"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").alias("at"))
    return assembly.merged_nodes(rows).select("node", "mentions", "ticker", "type")


DEGREES_SQL = "deg AS (SELECT node, count(*) AS d, sum(o)::BIGINT AS o FROM (SELECT subject AS node, 1 AS o FROM edges UNION ALL SELECT object, 0 FROM edges) GROUP BY 1)"


@query(f"""WITH {t.EDGES_SQL}, {DEGREES_SQL} (SELECT 'hub' AS what, node AS id, d::DOUBLE AS n FROM deg ORDER BY d DESC, node LIMIT 5)
UNION ALL SELECT 'nodes', '', count(*)::DOUBLE FROM deg UNION ALL SELECT 'edges', '', count(*)::DOUBLE FROM edges
UNION ALL (SELECT 'link', subject || '>' || object, confidence FROM edges ORDER BY confidence DESC, subject, object LIMIT 10)""")
def kg_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the graph, its five hubs and its strongest links."""
    edges = cut(t.kg_edges(spark, sf_dir))
    degree = graph.degrees(edges)
    row = lambda what, rows, key, n: rows.select(F.lit(what).alias("what"), key.alias("id"), n.cast("double").alias("n"))
    hubs = row("hub", degree.orderBy(F.desc("degree"), "node").limit(5), F.col("node"), F.col("degree"))
    links = row("link", edges.orderBy(F.desc("confidence"), "subject", "object").limit(10), F.concat_ws(">", "subject", "object"), F.col("confidence"))
    return hubs.unionByName(row("nodes", degree.agg(F.count("*").alias("n")), F.lit(""), F.col("n"))).unionByName(row("edges", edges.agg(F.count("*").alias("n")), F.lit(""), F.col("n"))).unionByName(links)


@query(f"""WITH {t.EDGES_SQL}, {DEGREES_SQL}, m AS (SELECT 'S' || l_suppkey AS node, count(*) AS mentions FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01' GROUP BY 1)
SELECT node, o AS out_degree, d AS degree, mentions FROM (SELECT * FROM m ORDER BY mentions DESC, node LIMIT 20) JOIN deg USING (node) WHERE o >= 1""")
def kg_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities named most in the window from which edges lead on: where chains start."""
    recent = t.load(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= t.moment("2001-06-01 00:00:00")).groupBy(F.concat(F.lit("S"), "l_suppkey").alias("node")).agg(F.count("*").alias("mentions"))
    top = recent.orderBy(F.desc("mentions"), "node").limit(20)
    return graph.degrees(t.kg_edges(spark, sf_dir)).join(top, "node").where("out_degree >= 1").select("node", "out_degree", "degree", "mentions")


@query("""WITH p AS (SELECT l_orderkey AS seed, list('P' || l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nodes, list(1 - l_discount ORDER BY l_linenumber, l_partkey, l_suppkey) AS c FROM lineitem GROUP BY 1)
SELECT seed, array_to_string(nodes, '>') AS signature, (i - 1)::INT AS step, nodes[i] AS node, CASE WHEN i = 1 THEN 1.0 ELSE round(c[i - 1], 3) END AS elasticity,
['Immediate (days)', 'Weeks', '1-3 months', '3-6 months', '6-12 months'][least(i, 5)] AS horizon FROM (SELECT *, unnest(range(1, len(nodes) + 1)) AS i FROM p)""")
def chain_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains told step by step."""
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_discount")))
    paths = t.load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("seed")).agg(lines.alias("lines"))
    paths = paths.select("seed", F.transform("lines", lambda x: F.concat(F.lit("P"), x["l_partkey"])).alias("nodes"), F.transform("lines", lambda x: 1 - x["l_discount"]).alias("confidences"))
    return assembly.chain_steps(paths)


@query("""WITH c AS (SELECT l_orderkey AS article, l_suppkey AS trend, count(*) AS shared, round(sum(1 - l_discount), 6) AS score FROM lineitem GROUP BY ALL)
SELECT article, trend, score FROM (SELECT *, row_number() OVER (PARTITION BY article ORDER BY score DESC, trend) AS place FROM c WHERE shared >= 1 AND score >= 0.93) WHERE place = 1""")
def trend_attachment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trend that an article continues: the likest of those that share enough with it."""
    rows = t.load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("article"), F.col("l_suppkey").alias("trend")).agg(F.count("*").alias("shared"), F.round(F.sum(1 - F.col("l_discount")), 6).alias("score"))
    return assembly.best_attachment(rows, "article", "trend", 1, 0.93)


@query("""WITH c AS (SELECT o_orderkey AS id, o_custkey AS component FROM orders), p AS (SELECT o_orderkey AS id, o_custkey AS component, 'G' || o_orderkey AS g, o_orderdate AS at_ FROM orders WHERE o_orderstatus = 'F'),
k AS (SELECT component, arg_min(g, (at_, id)) AS old FROM p GROUP BY 1) SELECT id, coalesce(old, component::VARCHAR) AS group_id FROM c LEFT JOIN k USING (component)""")
def group_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups keep the name of their earliest member's group."""
    orders = t.load(spark, sf_dir, "orders")
    prior = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("G"), "o_orderkey")).alias("group_id"), F.col("o_orderdate").alias("at"))
    return assembly.inherited_groups(orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("component")), prior)


@query("""WITH e AS (SELECT o_orderkey AS event, o_custkey AS who FROM orders WHERE o_orderstatus = 'O'), s AS (SELECT o_orderkey AS story, o_custkey AS who FROM orders WHERE o_orderstatus <> 'O'),
same AS (SELECT event, min(story) AS story FROM e JOIN s ON story = event + 1 GROUP BY 1), near_ AS (SELECT event, min(story) AS story FROM e JOIN s USING (who) GROUP BY 1)
SELECT event, coalesce(same.story, near_.story) AS story FROM e LEFT JOIN same USING (event) LEFT JOIN near_ USING (event)""")
def event_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The story an event continues: by its key, else by what it shares."""
    orders = t.load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    events = orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("event"), F.col("o_custkey").alias("who"))
    stories = orders.where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("story"), F.col("o_custkey").alias("who"))
    near = events.join(stories.groupBy("who").agg(F.min("story").alias("near")), "who", "left")
    same = stories.select((F.col("story") - 1).alias("event"), F.col("story").alias("same"))
    return near.join(same, "event", "left").select("event", F.coalesce("same", "near").alias("story"))


@query(f"""WITH {t.STORIES_SQL}, c AS (
(SELECT 'event-' || id AS id, 'event' AS type, round(0.4 + 0.1 * source_count, 4) AS priority FROM stories ORDER BY source_count DESC, stories.id LIMIT 5)
UNION ALL (SELECT 'market-' || id, 'market', 0.2 FROM stories WHERE topic = '5-LOW' ORDER BY created_at DESC, stories.id LIMIT 5)
UNION ALL (SELECT 'breaking-' || id, 'breaking', round(weight / 1000000, 4) FROM stories WHERE topic = '1-URGENT' ORDER BY updated_at DESC, stories.id LIMIT 4))
SELECT id, type, priority::DOUBLE AS priority FROM c ORDER BY CASE type WHEN 'breaking' THEN 0 WHEN 'event' THEN 1 ELSE 3 END, priority DESC, id LIMIT 12""")
def live_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaking stories, events and markets as cards in their order."""
    own = cut(t.stories(spark, sf_dir))

    def cards(kind: str, rows: DataFrame, priority, n: int) -> DataFrame:
        return rows.limit(n).select(F.concat(F.lit(f"{kind}-"), "id").alias("id"), F.lit(kind).alias("type"), F.round(priority, 4).cast("double").alias("priority"))

    out = cards("event", own.orderBy(F.desc("source_count"), "id"), 0.4 + 0.1 * F.col("source_count"), 5)
    out = out.unionByName(cards("market", own.where("topic = '5-LOW'").orderBy(F.desc("created_at"), "id"), F.lit(0.2), 5))
    out = out.unionByName(cards("breaking", own.where("topic = '1-URGENT'").orderBy(F.desc("updated_at"), "id"), F.col("weight") / 1_000_000, 4))
    return assembly.live_cards(out).select("id", "type", "priority")


@query(f"WITH {t.STORIES_SQL} SELECT count(*) AS stories, strftime(max(updated_at), '%Y-%m-%d') AS at, arg_max(id, (updated_at, -id)) AS newest FROM stories WHERE updated_at > TIMESTAMP '2001-10-06'")
def feed_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the feed has changed: how many stories of late, when and which the newest."""
    recent = t.stories(spark, sf_dir).where(F.col("updated_at") > t.moment("2001-10-06 00:00:00"))
    return recent.agg(F.count("*").alias("stories"), F.date_format(F.max("updated_at"), "yyyy-MM-dd").alias("at"), F.max_by("id", F.struct("updated_at", -F.col("id"))).alias("newest"))


@query("""WITH r AS (SELECT user_id % 20 AS stage, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'skipped' ELSE 'ok' END AS status, ts, event_id FROM events),
l AS (SELECT stage, arg_max(status, (ts, event_id)) AS status, max(ts) AS at_, count_if(status = 'error') AS errors, count(*) AS runs FROM r GROUP BY 1)
SELECT stage, status, errors, runs, CASE WHEN status = 'skipped' THEN 'gated' WHEN status = 'error' THEN 'failing' WHEN epoch(TIMESTAMP '2024-02-01') - epoch(at_) > 2 * 24 * 3600 THEN 'stale' ELSE 'healthy' END AS verdict FROM l""")
def run_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last run of every stage and what it says."""
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "skipped").otherwise("ok")
    runs = t.load(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("stage"), status.alias("status"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"))
    age = (F.unix_timestamp(t.moment("2024-02-01 00:00:00")) - F.unix_timestamp("at")) / 3600.0
    return assembly.latest_runs(runs).select("stage", "status", "errors", "runs", assembly.verdict(F.col("status"), age, 24).alias("verdict"))


@query("""WITH r AS (SELECT user_id % 20 AS stage, event_type, ts FROM events)
SELECT stage, strftime(max(ts) FILTER (event_type = 'purchase'), '%Y-%m-%d') AS last_full, coalesce(epoch(TIMESTAMP '2024-01-31') - epoch(max(ts) FILTER (event_type = 'purchase')) > 86400, TRUE) AS full_due FROM r GROUP BY 1""")
def full_run_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a stage's next run must be a full one: none in the last day."""
    last = F.max(F.when(F.col("event_type") == "purchase", F.col("ts").cast("timestamp")))
    own = t.load(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("stage")).agg(last.alias("last"))
    due = F.coalesce(F.unix_timestamp(t.moment("2024-01-31 00:00:00")) - F.unix_timestamp("last") > 86_400, F.lit(True))
    return own.select("stage", F.date_format("last", "yyyy-MM-dd").alias("last_full"), due.alias("full_due"))


@query(f"""WITH {t.STORIES_SQL} SELECT id, CASE WHEN kind = 'F' THEN '' ELSE left(topic || ' ' || repeat('x', 300), 280) END AS detail, CASE WHEN kind <> 'F' THEN n_articles END AS articles, kind = 'P' AS personalized, list_slice(range(n_articles), 1, 4)::VARCHAR AS first_four FROM stories""")
def story_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a list shows of a story: text cut, lists cut, some fields masked or left out."""
    masked = F.col("kind") == "F"
    four = F.slice(F.sequence(F.lit(0), F.col("n_articles").cast("int") - 1), 1, 4)
    return t.stories(spark, sf_dir).select("id", F.when(masked, "").otherwise(F.substring(F.concat("topic", F.lit(" "), F.repeat(F.lit("x"), 300)), 1, 280)).alias("detail"), F.when(~masked, F.col("n_articles")).alias("articles"), (F.col("kind") == "P").alias("personalized"), F.concat(F.lit("["), F.array_join(four, ", "), F.lit("]")).alias("first_four"))


@query("""WITH m AS (SELECT l_orderkey, list(DISTINCT 'T' || l_suppkey % 10) AS ids FROM lineitem GROUP BY 1)
SELECT l_orderkey, len(list_distinct(list_concat(ids, ['T1', 'T2'])))::INT AS together, list_has_all(ids, ['T1', 'T2']) AS holds, list_contains(ids, 'T3') AS has_three FROM m""")
def id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of ids: union, superset and membership."""
    two = F.array(F.lit("T1"), F.lit("T2"))
    own = t.load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("T"), (F.col("l_suppkey") % 10).cast("string"))).alias("ids"))
    return own.select("l_orderkey", F.size(F.array_union("ids", two)).alias("together"), (F.size(F.array_except(two, F.col("ids"))) == 0).alias("holds"), F.array_contains("ids", "T3").alias("has_three"))


@query("""WITH e AS (SELECT c_custkey AS id, c_nationkey + 1000000 AS e FROM customer WHERE c_acctbal < 0), n AS (SELECT id, min(id) OVER (PARTITION BY e) AS subject FROM e),
k AS (SELECT subject, count(*) AS n FROM n GROUP BY 1), b AS (SELECT arg_max(subject, (n, -subject)) AS big FROM k) SELECT id, subject, subject = (SELECT big FROM b) AS keeps FROM n""")
def blob_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A story of several subjects: each subject is named by its least article, the largest one keeps the story's row."""
    own = t.load(spark, sf_dir, "customer").where("c_acctbal < 0")
    parts = connected_components(own.select(F.col("c_custkey").alias("a"), (F.col("c_nationkey") + (1 << 60)).alias("b")), cut).where(F.col("node") < 1 << 60)
    sizes = parts.groupBy("component").agg(F.count("*").alias("n"))
    big = sizes.agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("big"))
    return parts.crossJoin(F.broadcast(big)).select(F.col("node").alias("id"), F.col("component").alias("subject"), (F.col("component") == F.col("big")).alias("keeps"))
