"""Registered queries over expressions: images, JSON answers, predicates, keys, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import images, records, scores
from ..functions import text as T
from ..sources import tables as t
from .reporting import query

_IMAGES = """i AS (SELECT p_partkey, CASE WHEN p_partkey % 11 > 0 THEN p_size * 40 END AS w, CASE WHEN p_partkey % 11 > 0 THEN p_size * 25 END AS h,
CASE p_partkey % 7 WHEN 0 THEN 'https://x.com/logo/a.jpg' WHEN 1 THEN 'https://x.com/a.svg?w=1' WHEN 2 THEN 'https://ichef.bbci.co.uk/ace/standard/240/a.jpg'
 WHEN 3 THEN 'https://x.com/' || (p_size * 30) || 'x' || (p_size * 20) || '/a' WHEN 4 THEN 'ftp://x.com/a.jpg' WHEN 5 THEN 'https://x.com/a_1600x900.jpg' ELSE 'https://x.com/a.jpg' END AS url FROM part),
u AS (SELECT *, CASE WHEN uw BETWEEN 100 AND 6000 AND uh BETWEEN 100 AND 6000 THEN uw END AS vw, CASE WHEN uw BETWEEN 100 AND 6000 AND uh BETWEEN 100 AND 6000 THEN uh END AS vh FROM
 (SELECT *, TRY_CAST(regexp_extract(url, '(\\d+)x(\\d+)', 1) AS INT) AS uw, TRY_CAST(regexp_extract(url, '(\\d+)x(\\d+)', 2) AS INT) AS uh, url LIKE '%ichef%' AS resized FROM i)),
d AS (SELECT *, CASE WHEN resized THEN 240 WHEN w IS NOT NULL THEN w ELSE vw END AS dw,
 CASE WHEN resized THEN CASE WHEN w IS NOT NULL THEN CASE WHEN w = 240 THEN h ELSE round_even(h * (240 / w::DOUBLE), 0)::INT END END WHEN w IS NOT NULL THEN h ELSE vh END AS dh FROM u)"""


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = t.load(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("int").alias("s"))
    size = lambda n: F.when(F.col("p_partkey") % 11 > 0, F.col("s") * n)
    kinds = ["https://x.com/logo/a.jpg", "https://x.com/a.svg?w=1", "https://ichef.bbci.co.uk/ace/standard/240/a.jpg", None, "ftp://x.com/a.jpg", "https://x.com/a_1600x900.jpg", "https://x.com/a.jpg"]
    sized = F.concat(F.lit("https://x.com/"), F.col("s") * 30, F.lit("x"), F.col("s") * 20, F.lit("/a"))
    url = F.coalesce(F.get(F.array(*[F.lit(k) for k in kinds]), F.col("p_partkey") % 7), sized)
    return own.select("p_partkey", size(40).alias("w"), size(25).alias("h"), url.alias("url"))


@query(f"""WITH {_IMAGES}
SELECT p_partkey, CASE WHEN url NOT LIKE 'http%' OR url LIKE '%.svg%' OR (url LIKE '%logo%' AND NOT coalesce(coalesce(w, vw) >= 400 AND coalesce(w, vw) * coalesce(h, vh) >= 240000, FALSE)) THEN 0.0
 WHEN dw IS NULL OR dh IS NULL THEN 1.0 WHEN dw < 200 OR dh < 120 THEN 0.3 WHEN dw / dh < 0.4 OR dw / dh > 3.5 THEN 0.2
 ELSE round(sqrt(dw * dh) / 100 * CASE WHEN dw / dh BETWEEN 1.3 AND 2.1 THEN 1.25 ELSE 1.0 END, 4) END::DOUBLE AS score FROM d""")
def image_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir).select("p_partkey", images.image_score(F.col("w"), F.col("h"), F.col("url")).alias("score"))


@query(f"""WITH {_IMAGES} SELECT p_partkey, CASE WHEN resized THEN replace(url, '/240/', '/1024/') ELSE url END AS url, CASE WHEN resized THEN CASE WHEN w IS NOT NULL THEN 1024 END ELSE w END AS w,
CASE WHEN resized THEN CASE WHEN w IS NOT NULL THEN round_even(h * (1024 / w::DOUBLE), 0)::INT END ELSE h END AS h, dw, dh,
CASE WHEN url LIKE 'http%' AND NOT coalesce(dw < 300 OR dh < 200, FALSE) OR (url LIKE 'http%' AND (dw IS NULL OR dh IS NULL)) THEN url ELSE 'site.png' END AS card FROM d""")
def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upgraded URLs with their sizes, the size to trust, and the share card's image."""
    args = (F.col("url"), F.col("w"), F.col("h"))
    url, w, h = images.upgraded(*args)
    dw, dh = images.declared_size(*args)
    return _images(spark, sf_dir).select("p_partkey", url.alias("url"), w.alias("w"), h.alias("h"), dw.alias("dw"), dh.alias("dh"), images.card_image(*args, "site.png").alias("card"))


@query(f"""WITH {_IMAGES}, s AS (SELECT p_partkey % 50 AS story, url, p_partkey, coalesce(dw * dh, 0) AS area FROM d WHERE url LIKE 'http%' AND url NOT LIKE '%.svg%')
SELECT story, arg_max(url, (area, -p_partkey)) AS image FROM s GROUP BY 1""")
def story_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest photograph of a story's candidates, the first one on a tie."""
    args = (F.col("url"), F.col("w"), F.col("h"))
    w, h = images.declared_size(*args)
    own = _images(spark, sf_dir).where(F.col("url").startswith("http") & ~F.col("url").contains(".svg"))
    return own.groupBy((F.col("p_partkey") % 50).alias("story")).agg(F.max_by("url", F.struct(F.coalesce(w * h, F.lit(0)), -F.col("p_partkey"))).alias("image"))


@query("""WITH a AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, source FROM documents),
s AS (SELECT doc_id, CASE WHEN n % 3 > 0 THEN 'u' || (doc_id % 40) END AS url FROM a), seen AS (SELECT url, min(doc_id) AS image FROM s WHERE doc_id % 2 = 0 AND url IS NOT NULL GROUP BY 1)
SELECT doc_id, url, CASE WHEN doc_id % 2 = 0 AND url IS NOT NULL THEN doc_id ELSE image END AS image FROM s LEFT JOIN seen USING (url)""")
def image_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles without an image take that of a row with the same URL."""
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    own = t.load(spark, sf_dir, "documents").select("doc_id", F.when(n % 3 > 0, F.concat(F.lit("u"), F.col("doc_id") % 40)).alias("url"))
    own = own.withColumn("own", F.when((F.col("doc_id") % 2 == 0) & F.col("url").isNotNull(), F.col("doc_id")))
    seen = own.where("own IS NOT NULL").groupBy("url").agg(F.min("own").alias("image"))
    return own.join(seen, "url", "left").select("doc_id", "url", F.coalesce("own", "image").alias("image"))


@query("""WITH r AS (SELECT event_id, user_id, props, value FROM events)
SELECT event_id, CASE user_id % 4 WHEN 0 THEN props WHEN 1 THEN '[' || props || ']' WHEN 2 THEN NULL ELSE NULL END AS blob, CASE WHEN user_id % 4 < 2 THEN props::JSON ->> '$.k' END AS k FROM r""")
def json_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first JSON in an answer: a plain object, one in an array, none, and broken ones."""
    form = F.col("user_id") % 4
    said = F.when(form == 0, F.concat(F.lit("Sure: "), "props", F.lit(" done"))).when(form == 1, F.concat(F.lit("```["), "props", F.lit("]```"))).when(form == 2, F.lit("no answer")).otherwise(F.concat(F.lit("{broken "), "props"))
    own = t.load(spark, sf_dir, "events").select("event_id", records.first_json(said).alias("blob"))
    return own.select("event_id", "blob", F.get_json_object(records.as_object(F.col("blob")), "$.k").alias("k"))


@query("""WITH l AS (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos FROM lineitem),
p AS (SELECT l_orderkey, CASE l_orderkey % 4 WHEN 0 THEN pos WHEN 1 THEN pos + 1 WHEN 2 THEN NULL ELSE pos END AS place, 'P' || l_partkey AS term FROM l)
SELECT l_orderkey, place, term FROM p WHERE place IS NOT NULL""")
def batch_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch answers mapped back to places: enveloped or bare arrays, with, without and with junk indices."""
    form = F.col("l_orderkey") % 4
    lines = t.load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("lines"))
    index = lambda p: F.when(form == 1, F.concat(F.lit('"i": '), (p + 2).cast("string"), F.lit(", "))).when(form == 2, F.lit('"i": "x", ')).otherwise("")
    item = F.transform("lines", lambda x, p: F.concat(F.lit("{"), index(p), F.lit('"name": " P'), x["l_partkey"], F.lit('"}')))
    array = F.concat(F.lit("["), F.array_join(item, ","), F.lit("]"))
    blob = F.when(form == 3, array).otherwise(F.concat(F.lit('{"items": '), array, F.lit("}")))
    own = lines.select("l_orderkey", F.posexplode(records.items_of(blob, "items")).alias("pos", "item"))
    placed = own.select("l_orderkey", "item", records.item_place(F.col("item"), F.col("pos")).cast("long").alias("place")).where("place IS NOT NULL")
    return placed.select("l_orderkey", "place", F.explode(records.terms(F.array("item"))).alias("term"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, q AS prompt, CASE WHEN odd THEN c + l_linenumber ELSE c END AS completion, CASE WHEN odd THEN 3 WHEN l_partkey % 3 = 0 THEN 7 ELSE 5 END AS cached,
CASE WHEN l_partkey % 5 = 0 THEN 999 WHEN odd THEN q + c + l_linenumber ELSE q + c END AS total
FROM (SELECT *, l_quantity::BIGINT AS q, l_extendedprice::BIGINT AS c, l_linenumber % 2 = 1 AS odd FROM lineitem)""")
def usage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts from two providers' forms of a usage record."""
    q, c = F.round("l_quantity").cast("long"), F.rint("l_extendedprice").cast("long")
    total = F.when(F.col("l_partkey") % 5 == 0, 999).otherwise(0)
    one = F.format_string('{"usageMetadata": {"promptTokenCount": %d, "candidatesTokenCount": %d, "thoughtsTokenCount": %d, "cachedContentTokenCount": 3, "totalTokenCount": %d}}', q, c, F.col("l_linenumber"), total)
    hit = F.when(F.col("l_partkey") % 3 == 0, F.lit('"prompt_cache_hit_tokens": 7')).otherwise('"prompt_tokens_details": {"cached_tokens": 5}')
    two = F.concat(F.format_string('{"usage": {"prompt_tokens": %d, "completion_tokens": %d, "total_tokens": %d, ', q, c, total), hit, F.lit("}}"))
    own = t.load(spark, sf_dir, "lineitem").withColumn("answer", F.when(F.col("l_linenumber") % 2 == 1, one).otherwise(two))
    return own.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[x.cast("long").alias(n) for x, n in zip(records.usage(F.col("answer")), ("prompt", "completion", "cached", "total"), strict=True)])


@query("""WITH v AS (SELECT event_id, CASE user_id % 5 WHEN 0 THEN '/admin/users' WHEN 1 THEN '/story/' || event_id WHEN 2 THEN '/live/stream' WHEN 3 THEN '/' ELSE '/docs' END AS path,
CASE user_id % 4 WHEN 0 THEN 'in' WHEN 1 THEN 'XX' WHEN 2 THEN 'T1' ELSE '' END AS h1, CASE WHEN user_id % 3 = 0 THEN ' us ' ELSE '12' END AS h2, hour(ts) AS h FROM events)
SELECT event_id, path, CASE WHEN h1 = 'in' THEN 'IN' WHEN h2 = ' us ' THEN 'US' ELSE '' END AS country, (h >= 1 AND h < 4) OR (h >= 6 AND h < 10) AS peak FROM v WHERE path NOT LIKE '/admin%' AND path NOT LIKE '/live/stream%' AND path NOT LIKE '/docs%'""")
def page_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views worth counting, with country and whether they fall in peak hours."""
    user = F.col("user_id")
    path = F.when(user % 5 == 0, F.lit("/admin/users")).when(user % 5 == 1, F.concat(F.lit("/story/"), "event_id")).when(user % 5 == 2, F.lit("/live/stream")).when(user % 5 == 3, F.lit("/")).otherwise("/docs")
    first = F.when(user % 4 == 0, F.lit("in")).when(user % 4 == 1, F.lit("XX")).when(user % 4 == 2, F.lit("T1")).otherwise("")
    own = t.load(spark, sf_dir, "events").select("event_id", path.alias("path"), records.country(first, F.when(user % 3 == 0, F.lit(" us ")).otherwise("12")).alias("country"), records.in_peak(F.col("ts"), [(1, 4), (6, 10)]).alias("peak"))
    return own.where(records.trackable(F.col("path")))


@query("""SELECT o_orderkey, strftime((o_orderdate::DATE + (CASE o_orderkey % 5 WHEN 0 THEN 180 WHEN 1 THEN 14 WHEN 2 THEN 365 WHEN 3 THEN 10 END)::INT), '%Y-%m-%d') AS due,
CASE o_orderkey % 3 WHEN 0 THEN 'merger_and_acquisition' WHEN 1 THEN 'regulation' ELSE 'other' END AS kind,
sha256('rank' || chr(0) || o_orderstatus || o_orderkey) AS key, sha256('story|' || o_orderkey)[1:12] AS short FROM orders""")
def record_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates that phrases reach, labels of a closed list, cache keys and short ids."""
    k = F.col("o_orderkey")
    phrase = F.get(F.array(*map(F.lit, ("3-6 months", "within 2 weeks", "a year", "10 days", "soon"))), k % 5)
    label = F.get(F.array(*map(F.lit, (" Merger & Acquisition", "REGULATION", "gossip"))), k % 3)
    kind = records.coerced(label, ("merger_and_acquisition", "regulation"), "other")
    key = records.cache_key(F.lit("rank"), F.concat("o_orderstatus", k.cast("string")))
    return t.load(spark, sf_dir, "orders").select("o_orderkey", F.date_format(records.horizon_date(phrase, F.to_date("o_orderdate")), "yyyy-MM-dd").alias("due"), kind.alias("kind"), key.alias("key"), records.short_id(F.lit("story"), k).alias("short"))


@query("""SELECT s_suppkey, 'See ' || s_name || ' and ' || sha256('story|x')[1:12] || '.' AS text FROM supplier""")
def linked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of known stories in a text become their headlines; unknown ones stay."""
    own = records.short_id(F.lit("story"), F.col("s_suppkey"))
    text = F.concat(F.lit("See "), own, F.lit(" and "), records.short_id(F.lit("story"), F.lit("x")), F.lit("."))
    return t.load(spark, sf_dir, "supplier").select("s_suppkey", records.linked(text, F.create_map(own, F.col("s_name"))).alias("text"))


_FLUFF_SQL = T.FLUFF.replace("'", "''")


@query(rf"""WITH s AS (SELECT conv_id, turn, trim(split_part(text, chr(10), 1)) AS s FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, length(s) < 25 OR regexp_matches(s, '{_FLUFF_SQL}') OR length(regexp_replace(s, '\P{{L}}', '', 'g')) * 2 < length(s) AS fluff,
trim(regexp_replace(regexp_replace(lower(s), '^(?:early signal|rising focus|trend|focus on)\s*:?\s*', ''), '[^a-z0-9]+', ' ', 'g')) AS name, starts_with(s, '- [') OR s LIKE 'split%' AS placeholder FROM s""")
def text_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that report nothing, names for comparing, placeholders of stories not yet told."""
    s = F.trim(F.substring_index("text", "\n", 1))
    own = t.load(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", s.alias("s"))
    return own.select("conv_id", "turn", T.is_fluff(F.col("s")).alias("fluff"), T.trend_name(F.col("s")).alias("name"), (F.ltrim("s").startswith("- [") | F.col("s").like("split%")).alias("placeholder"))


@query("""SELECT c_custkey, company, CASE company WHEN 'ril' THEN 'a' WHEN 'larsen and toubro' THEN 'b' ELSE '' END AS known FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'ril' WHEN 1 THEN 'larsen and toubro' WHEN 2 THEN '' ELSE 'customer 0' || (c_custkey % 10) END AS company FROM customer)""")
def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, F.lit("The RIL Holdings Ltd.")).when(k % 4 == 1, F.lit("Larsen & Toubro Limited")).when(k % 4 == 2, F.lit("Company Group")).otherwise(F.concat(F.lit("Customer#0"), (k % 10).cast("string"), F.lit(" Co., Inc")))
    key = T.company_key(name)
    return t.load(spark, sf_dir, "customer").select("c_custkey", key.alias("company"), F.when(key == "ril", "a").when(key == "larsen and toubro", "b").otherwise("").alias("known"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 12345.5 WHEN s_suppkey % 3 = 1 THEN s_acctbal END AS amount, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE s_name[1:40] END AS label FROM supplier""")
def loose_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers out of free text, and labels without words that mean nothing."""
    k = F.col("s_suppkey")
    said = F.when(k % 3 == 0, F.lit("Rs 12,345.50 crore")).when(k % 3 == 1, F.concat(F.lit("about "), F.format_string("%s", F.col("s_acctbal").cast("decimal(18,2)").cast("string")))).otherwise("none")
    label = F.when(k % 2 == 0, F.lit(" N/A ")).otherwise(F.concat(F.lit(" "), "s_name"))
    return t.load(spark, sf_dir, "supplier").select("s_suppkey", scores.number_in(said).alias("amount"), scores.without_null_words(label).alias("label"))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, 'P' || l_partkey AS p FROM lineitem),
n AS (SELECT l_orderkey, pos, CASE WHEN pos % 6 IN (0, 1, 5) THEN p WHEN pos % 6 = 2 THEN l_partkey::VARCHAR WHEN pos % 6 = 4 THEN (l_partkey + 0.5)::DECIMAL(18, 1)::VARCHAR END AS term FROM l WHERE l_orderkey % 7 <> 6),
u AS (SELECT l_orderkey, term, min(pos) AS pos FROM n WHERE term IS NOT NULL GROUP BY ALL), s AS (SELECT l_orderkey, string_agg(term, '|' ORDER BY pos) AS names FROM u GROUP BY 1)
SELECT DISTINCT l.l_orderkey, coalesce(names, '') AS names, CASE l.l_orderkey % 7 WHEN 6 THEN '' WHEN 0 THEN '7' WHEN 1 THEN 'one' ELSE '' END AS sectors FROM l LEFT JOIN s USING (l_orderkey)""")
def variant_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names out of answers of any shape: strings, nested lists, objects with and without a name, numbers, booleans, nulls, broken JSON."""
    text = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    quoted = F.concat(F.lit('"'), text, F.lit('"'))
    forms = (
        F.when(F.col("pos") % 6 == 0, F.concat(F.lit("[["), quoted, F.lit(', [" "]], null]'))).when(F.col("pos") % 6 == 1, quoted)
        .when(F.col("pos") % 6 == 2, F.concat(F.lit('{"entity": '), F.col("l_partkey").cast("string"), F.lit(', "text": "later"}'))).when(F.col("pos") % 6 == 3, F.concat(F.lit('{"name": true, "label": '), quoted, F.lit("}")))
        .when(F.col("pos") % 6 == 4, F.concat(F.col("l_partkey").cast("string"), F.lit(".5"))).otherwise(F.concat(F.lit('{"name": {"x": 1}, "title": " '), text, F.lit(' "}')))
    )
    own = t.load(spark, sf_dir, "lineitem").withColumn("pos", place).withColumn("item", forms).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]), ", ").alias("items"))
    form = F.col("l_orderkey") % 7
    sectors = F.when(form == 0, "7").when(form == 1, '" one "').when(form == 2, "true").when(form == 3, "{}").when(form == 4, '[[], {"id": 3}]').otherwise("null")
    blob = F.concat(F.lit('{"entities": ['), "items", F.lit('], "sectors": '), sectors, F.when(form == 6, "").otherwise("}"))
    doc = own.select("l_orderkey", F.try_parse_json(blob).alias("doc"))
    return doc.select("l_orderkey", F.array_join(records.variant_terms(F.col("doc"), "entities"), "|").alias("names"), F.array_join(records.variant_terms(F.col("doc"), "sectors"), "|").alias("sectors"))
