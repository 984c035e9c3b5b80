"""Registered report queries over the fixture bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import feed, history, reports
from ..sources import tables as t

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


VISITS = "visits AS (SELECT event_id AS id, user_id AS device, event_type AS path, ts AS created_at, ts::DATE AS day, value, event_id % 1500 AS story_id FROM events)"


@query(f"""WITH {VISITS}, w AS (SELECT * FROM visits WHERE created_at >= TIMESTAMP '2024-01-25'),
f AS (SELECT device, min(created_at) AS first FROM visits GROUP BY 1 HAVING min(created_at) >= TIMESTAMP '2024-01-25')
SELECT (SELECT count(DISTINCT device) FROM w) AS devices, (SELECT count(*) FROM w) AS views, (SELECT count(*) FROM f) AS new_devices,
       greatest(0, (SELECT count(DISTINCT device) FROM w) - (SELECT count(*) FROM f)) AS returning""")
def visitor_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.audience_totals(t.visits(spark, sf_dir), t.moment(t.EVENTS_NOW), 7)


@query(f"""WITH {VISITS}, days AS (SELECT unnest(generate_series(DATE '2023-12-23', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day),
d AS (SELECT day, count(DISTINCT device) AS devices, count(*) AS views FROM visits WHERE day >= DATE '2023-12-23' GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, coalesce(devices, 0) AS devices, coalesce(views, 0) AS views FROM days LEFT JOIN d USING (day)""")
def visitor_daily_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.audience_daily(t.visits(spark, sf_dir), t.moment(t.EVENTS_NOW), 40).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(f"""WITH {VISITS} SELECT path, count(*) AS views, count(DISTINCT device) AS devices FROM visits
WHERE created_at >= TIMESTAMP '2024-01-02' AND path <> '' GROUP BY 1 ORDER BY views DESC, path LIMIT 3""")
def top_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_values(t.visits(spark, sf_dir), "path", t.moment(t.EVENTS_NOW), 30, 3)


@query(f"""WITH {VISITS}, d AS (SELECT device, count(DISTINCT day) AS days FROM visits WHERE created_at >= TIMESTAMP '2024-01-02' GROUP BY 1)
SELECT round(avg(days), 4) AS avg_days, max(days) AS max_days FROM d""")
def loyalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.loyalty(t.visits(spark, sf_dir), t.moment(t.EVENTS_NOW), 30)


@query(f"""WITH {VISITS}, d AS (SELECT day, count(*) AS hits FROM visits GROUP BY 1)
SELECT sum(hits)::BIGINT AS total, round(sum(hits) / 30, 4) AS per_day, strftime((SELECT day FROM d ORDER BY hits DESC, day LIMIT 1), '%Y-%m-%d') AS busiest_day FROM d""")
def traffic_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = t.visits(spark, sf_dir).groupBy("day", F.col("path").alias("route")).agg(F.count("*").alias("hits"))
    return reports.traffic(hits, 30).withColumn("busiest_day", F.date_format("busiest_day", "yyyy-MM-dd"))


@query("SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, count(*) AS signups, count_if(value > 50) AS large FROM events WHERE event_type = 'signup' GROUP BY 1")
def signups_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = t.visits(spark, sf_dir).where("path = 'signup'")
    return own.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("signups"), F.count_if(F.col("value") > 50).alias("large"))


@query("""SELECT c_custkey AS id, (SELECT count(*) FROM events WHERE user_id = c_custkey AND event_type = 'click') AS saved,
(SELECT count(*) FROM events WHERE user_id = c_custkey AND event_type = 'purchase') AS reactions,
(SELECT floor(epoch(max(ts)))::BIGINT FROM events WHERE user_id = c_custkey) AS last_seen FROM customer WHERE c_custkey IN (SELECT user_id FROM events)""")
def user_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = t.visits(spark, sf_dir).withColumn("user_id", F.col("device"))
    seen = v.select(F.col("device").alias("id")).distinct()
    users = t.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(seen, "id", "left_semi")
    out = reports.user_activity(users, v.where("path = 'click'"), v.where("path = 'purchase'"), v)
    return out.withColumn("last_seen", F.unix_timestamp("last_seen"))


PRICED = f"""{t.USAGE_SQL}, {t.RATES_SQL},
priced AS (SELECT u.*, (greatest(prompt - cached, 0) * r_in + completion * r_out + cached * r_cached) / 1e6 * CASE WHEN peak THEN 2.0 ELSE 1.0 END AS cost
           FROM usage_ u LEFT JOIN rates ON key = provider || '/' || model)"""
MEASURES = """count(*) AS calls, count_if(failed)::BIGINT AS failed, sum(prompt)::BIGINT AS prompt, sum(completion)::BIGINT AS completion, sum(cached)::BIGINT AS cached,
round(sum(cost), 8) AS cost, round(sum(prompt + completion) / count(*), 4) AS avg_tokens, round(100.0 * count_if(failed) / count(*), 4) AS fail_rate"""


def _spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.spend(t.llm_usage(spark, sf_dir), t.rates(spark))


@query(f"WITH {PRICED} SELECT provider, model, {MEASURES} FROM priced GROUP BY ALL")
def llm_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spend(spark, sf_dir).groupBy("provider", "model").agg(*reports.spend_measures())


@query(f"WITH {PRICED} SELECT task, {MEASURES} FROM priced WHERE task <> '' GROUP BY ALL")
def llm_by_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spend(spark, sf_dir).where("task <> ''").groupBy("task").agg(*reports.spend_measures())


@query(f"WITH {PRICED} SELECT strftime(day, '%Y-%m-%d') AS day, {MEASURES} FROM priced GROUP BY ALL")
def llm_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spend(spark, sf_dir).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(*reports.spend_measures())


@query(f"WITH {PRICED} SELECT coalesce(provider, '*') AS provider, coalesce(task, '*') AS task, grouping(provider, task)::INT AS level, count(*) AS calls, round(sum(cost), 4) AS cost FROM priced GROUP BY GROUPING SETS ((provider), (task), ())")
def llm_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = _spend(spark, sf_dir).groupingSets([["provider"], ["task"], []], "provider", "task").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("calls"), F.round(F.sum("cost"), 4).alias("cost"))
    return sets.select(F.coalesce("provider", F.lit("*")).alias("provider"), F.coalesce("task", F.lit("*")).alias("task"), "level", "calls", "cost")


@query(f"""WITH {PRICED}, old AS (SELECT provider, model, task, round(sum(prompt + completion) / 1e6, 4) AS cost FROM usage_ GROUP BY ALL),
new AS (SELECT provider, model, task, round(sum(cost), 4) AS cost FROM priced GROUP BY ALL)
SELECT o.provider, o.model, o.task, coalesce(n.cost, o.cost) AS cost, coalesce(abs(n.cost - o.cost) >= 1e-12, FALSE) AS changed FROM old o JOIN new n USING (provider, model, task)""")
def llm_reprice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored costs at today's card: unpriced rows keep what they have."""
    own = _spend(spark, sf_dir).groupBy("provider", "model", "task").agg(F.round(F.sum(F.col("prompt") + F.col("completion")) / 1e6, 4).alias("old"), F.round(F.sum("cost"), 4).alias("new"))
    return own.select("provider", "model", "task", F.coalesce("new", "old").alias("cost"), F.coalesce(F.abs(F.col("new") - F.col("old")) >= 1e-12, F.lit(False)).alias("changed"))


@query(f"WITH {PRICED} SELECT provider, count(*) AS calls, round(sum(CASE WHEN provider <> 'R' THEN cost END), 4) AS paid FROM priced WHERE day = DATE '1998-10-05' GROUP BY ALL")
def today_paid_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    today = _spend(spark, sf_dir).where(F.col("day") == F.lit("1998-10-05").cast("date"))
    return today.groupBy("provider").agg(F.count("*").alias("calls"), F.round(F.sum(F.when(F.col("provider") != "R", F.col("cost"))), 4).alias("paid"))


AGE = "greatest(greatest((epoch(TIMESTAMP '2001-11-05') - epoch(updated_at)) / 3600.0, 0.5 * (epoch(TIMESTAMP '2001-11-05') - epoch(created_at)) / 3600.0), 0.0) / 6.0"


def _ranked(stories: DataFrame, impact) -> DataFrame:
    return stories.withColumn("rank", F.round(feed.rank_score(impact, feed.age_cycles(t.moment(t.STORIES_NOW))), 9))


@query(f"""WITH {t.STORIES_SQL}, r AS (SELECT DISTINCT event_id % 1500 AS story_id FROM events WHERE user_id = 7 AND event_type = 'view')
SELECT id, topic, source_count, round(ln(1 + n_articles) * CASE WHEN topic IN ('1-URGENT', '2-HIGH') THEN 8.0 ELSE 1.0 END * (0.6 + 0.9 * credibility / 100) / pow(1 + {AGE}, 1.5), 9) AS rank
FROM stories WHERE id NOT IN (SELECT story_id FROM r) ORDER BY rank DESC, id LIMIT 100""")
def feed_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked feed of one reader, without what was read."""
    read = t.visits(spark, sf_dir).where("device = 7 AND path = 'view'")
    impact = feed.recent_impact("n_articles", "credibility", F.col("topic").isin("1-URGENT", "2-HIGH"))
    return _ranked(feed.unread(t.stories(spark, sf_dir), read), impact).select("id", "topic", "source_count", "rank").orderBy(F.desc("rank"), "id").limit(100)


@query(f"""WITH {t.STORIES_SQL}, s AS (SELECT story_id, max(value) AS score FROM (SELECT event_id % 1500 AS story_id, value FROM events WHERE event_type = 'click') GROUP BY 1)
SELECT id, round(coalesce(least(score / 100, 3.0), CASE WHEN topic = '5-LOW' THEN 1.0 END, 0.0) / pow(1 + {AGE}, 1.5), 9) AS rank FROM stories LEFT JOIN s ON story_id = id ORDER BY rank DESC, id LIMIT 100""")
def feed_foryou(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = t.visits(spark, sf_dir).where("path = 'click'").groupBy(F.col("story_id").alias("id")).agg(F.max("value").alias("score"))
    impact = F.coalesce(F.least(F.col("score") / 100, F.lit(3.0)), F.when(F.col("topic") == "5-LOW", 1.0), F.lit(0.0))
    return _ranked(t.stories(spark, sf_dir).join(scores, "id", "left"), impact).select("id", "rank").orderBy(F.desc("rank"), "id").limit(100)


@query(f"""WITH {t.STORIES_SQL}, f AS (SELECT *, CASE WHEN id % 3 = 0 THEN id // 3 END AS event_id FROM stories WHERE kind = 'F'),
n AS (SELECT *, CASE WHEN id % 2 = 0 THEN id // 3 END AS event_id FROM stories WHERE kind <> 'F')
SELECT id, kind, event_id FROM f UNION ALL SELECT id, kind, event_id FROM n WHERE event_id IS NULL OR event_id NOT IN (SELECT event_id FROM f WHERE event_id IS NOT NULL)""")
def feed_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = t.stories(spark, sf_dir).select("id", "kind")
    event = F.floor(F.col("id") / 3).cast("long")
    finance = own.where("kind = 'F'").withColumn("event_id", F.when(F.col("id") % 3 == 0, event))
    news = own.where("kind <> 'F'").withColumn("event_id", F.when(F.col("id") % 2 == 0, event))
    return feed.merged_feed(news, finance)


@query(f"""WITH {t.STORIES_SQL} SELECT topic, strftime(created_at, '%Y-%m') AS month, count(*) AS story_count, round(avg(credibility), 4) AS credibility, sum(source_count)::BIGINT AS sources FROM stories GROUP BY ALL""")
def trend_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = t.stories(spark, sf_dir)
    return own.groupBy("topic", F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("story_count"), F.round(F.avg("credibility"), 4).alias("credibility"), F.sum("source_count").alias("sources"))


@query(f"""WITH {VISITS} SELECT path, count_if(created_at > TIMESTAMP '2024-01-28') AS recent, count_if(created_at BETWEEN TIMESTAMP '2024-01-25' AND TIMESTAMP '2024-01-28') AS before,
round(count_if(created_at > TIMESTAMP '2024-01-28') / greatest(count_if(created_at BETWEEN TIMESTAMP '2024-01-25' AND TIMESTAMP '2024-01-28'), 1), 4) AS velocity FROM visits WHERE created_at >= TIMESTAMP '2024-01-25' GROUP BY 1""")
def trend_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = t.moment(t.EVENTS_NOW)
    edge, start = (F.timestamp_seconds(F.unix_timestamp(now) - h * 3600) for h in (72, 144))
    recent, before = F.count_if(F.col("created_at") > edge), F.count_if(F.col("created_at").between(start, edge))
    own = t.visits(spark, sf_dir).where(F.col("created_at") >= start).groupBy("path").agg(recent.alias("recent"), before.alias("before"))
    return own.withColumn("velocity", F.round(F.col("recent") / F.greatest("before", F.lit(1)), 4))


@query("""WITH c AS (SELECT l_orderkey AS story_id, l_returnflag AS topic, count(*) AS n, min(l_linenumber) AS at_ FROM lineitem GROUP BY ALL)
SELECT story_id, topic, n FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY n DESC, at_, topic DESC) AS place FROM c) WHERE place = 1""")
def story_topic_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("story_id"), F.col("l_returnflag").alias("topic"), "l_linenumber")
    counts = rows.groupBy("story_id", "topic").agg(F.count("*").alias("n"), F.min("l_linenumber").alias("at"))
    return counts.groupBy("story_id").agg(F.max_by("topic", F.struct("n", -F.col("at"), "topic")).alias("topic"), F.max("n").alias("n"))


@query("SELECT l_orderkey AS story_id, count(DISTINCT l_suppkey) AS sources, least(95, 35 + 15 * count(DISTINCT l_suppkey) + 5 * (4 - min(l_linenumber)))::BIGINT AS prior FROM lineitem GROUP BY 1")
def story_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = t.load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("story_id")).agg(F.countDistinct("l_suppkey").alias("sources"), F.min("l_linenumber").alias("tier"))
    return own.select("story_id", "sources", feed.credibility_prior(F.col("sources"), F.col("tier")).cast("long").alias("prior"))


@query(f"""WITH {t.HISTORY_SQL}, l AS (SELECT *, lag(disputed) OVER w AS d, lag(conflicts) OVER w AS c, row_number() OVER w AS n FROM history WINDOW w AS (PARTITION BY story_id ORDER BY at_, seq, src, part))
SELECT story_id, seq, disputed, conflicts, count(*) AS n FROM l WHERE n = 1 OR d IS DISTINCT FROM disputed OR c IS DISTINCT FROM conflicts GROUP BY ALL""")
def history_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = history.changes(t.story_history(spark, sf_dir), "story_id", ["at", "seq", "src", "part"], ["disputed", "conflicts"])
    return out.groupBy("story_id", "seq", "disputed", "conflicts").agg(F.count("*").alias("n"))


@query(f"""WITH {t.HISTORY_SQL}, s AS (SELECT story_id, max(credibility) AS peak, last(credibility ORDER BY at_, seq, src, part) AS now, first(disputed ORDER BY at_, seq, src, part) AS d0, last(disputed ORDER BY at_, seq, src, part) AS d1,
first(conflicts ORDER BY at_, seq, src, part) AS c0, last(conflicts ORDER BY at_, seq, src, part) AS c1, count(*) AS n FROM history GROUP BY 1 HAVING count(*) > 1),
k AS (SELECT story_id, CASE WHEN d1 > d0 THEN 'contested' WHEN peak - now >= 8 THEN 'weakened' WHEN c1 > c0 THEN 'conflicting' END AS kind, round(now - peak, 2) AS delta, peak, now FROM s)
SELECT * FROM k WHERE kind IS NOT NULL""")
def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.corrections(t.story_history(spark, sf_dir).withColumn("seq", F.struct("seq", "src", "part")))


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey) AS place FROM lineitem) WHERE place <= 2""")
def topn_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.load(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return feed.top_per_group(rows, ["l_suppkey"], [F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 2).drop("l_shipdate")


@query(f"""WITH {t.STORIES_SQL} SELECT event_id AS bookmark, id AS story_id, round((credibility - value)::DECIMAL(20, 8), 1)::DOUBLE AS delta FROM events JOIN stories ON id = event_id % 1500 WHERE event_type = 'click'""")
def saved_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = t.visits(spark, sf_dir).where("path = 'click'").select(F.col("id").alias("bookmark"), "story_id", "value")
    joined = marks.join(t.stories(spark, sf_dir).select(F.col("id").alias("story_id"), "credibility"), "story_id")
    return joined.select("bookmark", "story_id", F.round((F.col("credibility") - F.col("value")).cast("decimal(20,8)"), 1).cast("double").alias("delta"))


READS = """reads AS (SELECT user_id, event_id % 1500 AS story_id, max(least(value / 100, 1.0)) AS progress, min(CASE WHEN least(value / 100, 1.0) >= 0.9 THEN ts END) AS completed_at, count(*) AS updates
FROM events WHERE event_type = 'view' GROUP BY ALL)"""


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = t.visits(spark, sf_dir).where("path = 'view'").select(F.col("device").alias("user_id"), "story_id", F.col("created_at").alias("at"), F.least(F.col("value") / 100, F.lit(1.0)).alias("progress"))
    return history.progress(own)


@query(f"WITH {READS} SELECT user_id, story_id, round(progress, 4) AS progress, floor(epoch(completed_at))::BIGINT AS completed_at, updates FROM reads")
def progress_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reads(spark, sf_dir).withColumns({"progress": F.round("progress", 4), "completed_at": F.unix_timestamp("completed_at")})


@query(f"""WITH {t.STORIES_SQL}, {READS} SELECT topic, count(*) AS opened, count_if(completed_at IS NOT NULL) AS finished FROM reads JOIN stories ON id = story_id
GROUP BY 1 HAVING count(*) >= 3 AND count_if(completed_at IS NOT NULL) * 2 < count(*) ORDER BY count_if(completed_at IS NOT NULL) / count(*), opened DESC, topic LIMIT 3""")
def blind_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _reads(spark, sf_dir).join(t.stories(spark, sf_dir).select(F.col("id").alias("story_id"), "topic"), "story_id")
    own = joined.groupBy("topic").agg(F.count("*").alias("opened"), F.count("completed_at").alias("finished")).where("opened >= 3 AND finished * 2 < opened")
    return own.orderBy(F.col("finished") / F.col("opened"), F.desc("opened"), "topic").limit(3)


@query(f"""WITH {t.STORIES_SQL}, {READS} SELECT user_id, count(*) AS opened, count_if(progress >= 0.9) AS finished, count_if(progress < 0.2) AS abandoned, count_if(credibility >= 70) AS high, count_if(credibility >= 40 AND credibility < 70) AS middle, count_if(credibility < 40) AS low
FROM reads JOIN stories ON id = story_id GROUP BY 1""")
def reading_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _reads(spark, sf_dir).join(t.stories(spark, sf_dir).select(F.col("id").alias("story_id"), "credibility"), "story_id")
    band = F.col("credibility")
    return joined.groupBy("user_id").agg(
        F.count("*").alias("opened"), F.count_if(F.col("progress") >= 0.9).alias("finished"), F.count_if(F.col("progress") < 0.2).alias("abandoned"),
        F.count_if(band >= 70).alias("high"), F.count_if((band >= 40) & (band < 70)).alias("middle"), F.count_if(band < 40).alias("low"),
    )


@query("SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), lower('An')) OR contains(lower(p_type), lower('An')) ORDER BY p_partkey LIMIT 15")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.search(t.load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), ["p_name", "p_type"], "An").orderBy("p_partkey").limit(15)


@query(f"""WITH {t.STORIES_SQL} SELECT id, topic, max(value) AS impact FROM stories JOIN events ON event_id % 1500 = id WHERE value >= 200 GROUP BY id, topic ORDER BY impact DESC, id LIMIT 12""")
def important_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    strong = t.visits(spark, sf_dir).where("value >= 200").select(F.col("story_id").alias("id"), "value")
    own = t.stories(spark, sf_dir).select("id", "topic").join(strong, "id")
    return own.groupBy("id", "topic").agg(F.max("value").alias("impact")).orderBy(F.desc("impact"), "id").limit(12)


@query(f"""WITH {VISITS}, s AS (SELECT story_id, count(DISTINCT device) AS sources, bool_or(path = 'error') AS keyword, (epoch(TIMESTAMP '2024-01-31') - epoch(max(created_at))) / 3600.0 AS age FROM visits GROUP BY 1)
SELECT story_id, sources, round(CASE WHEN age > 6 THEN 0.0 ELSE round(greatest(CASE WHEN sources >= 3 THEN least(1.0, sources / 3.0) ELSE 0.0 END, CASE WHEN keyword THEN 0.9 ELSE 0.0 END) * (0.5 + 0.5 * greatest(0.0, 1 - age / 6.0)), 3) END, 3)::DOUBLE AS score FROM s""")
def breaking(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = t.visits(spark, sf_dir).groupBy("story_id").agg(F.countDistinct("device").alias("sources"), F.max(F.col("path") == "error").alias("keyword"), F.max("created_at").alias("at"))
    age = (F.unix_micros(t.moment(t.EVENTS_NOW)) - F.unix_micros("at")) / 3.6e9
    return own.select("story_id", "sources", feed.breaking_score(F.col("sources"), F.col("keyword"), age).cast("double").alias("score"))


@query("SELECT props AS name, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-01' GROUP BY 1 ORDER BY n DESC, name LIMIT 40")
def unresolved_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.load(spark, sf_dir, "events").where(F.col("ts") >= F.lit("2024-01-01").cast("timestamp_ntz")).groupBy(F.col("props").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(40)
