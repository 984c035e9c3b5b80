"""Rules of answers, the cache, batches of questions and tiers of filling, case by case."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tidewire.operators import answers, assembly, chains, fill, gazetteer
from tidewire.operators.checkpoint import cut
from tidewire.sources import tables

NOW = "2024-02-01 00:00:00"


def at(text):
    return F.lit(text).cast("timestamp")


def test_beats_and_quotes(spark):
    long, other = "The bank raised its rate on Tuesday to fight rising prices.", "Markets fell sharply after the surprise decision came out."
    beat = "array<struct<label:string,text:string>>"
    rows = [(1, [(" Rates ", long), ("Markets", other), ("", long), ("Short", "no")], [("0", long[:30]), ("0", long[:30]), ("9", other[:30]), ("x", other[:30]), ("1", other[:30].upper()), ("1", "too short")]), (2, [("One", long)], [("0", long[:30])]), (3, None, None)]
    frame = spark.createDataFrame(rows, f"id int, beats {beat}, quotes array<struct<claim:string,quote:string>>")
    kept = frame.withColumn("kept", answers.beats(F.col("beats")))
    out = {x.id: (x.kept, x.q) for x in kept.select("id", "kept", answers.quotes(F.col("quotes"), F.lit(2), F.col("kept")).alias("q")).collect()}
    assert [tuple(b) for b in out[1][0]] == [("Rates", long), ("Markets", other)] and [tuple(q) for q in out[1][1]] == [(0, long[:30])]
    assert out[2] == (None, None) and out[3] == (None, None)


def test_stand_in_takes_the_title_where_the_summary_is_told(spark):
    one, two = "A summary that is certainly longer than forty characters", "A headline that is longer than forty characters as well!"
    rows = [(1, 1, 1, one, two), (1, 2, 2, one.upper(), two), (1, 3, 3, one, two), (1, 4, 0, "short", "short too")]
    out = answers.stand_in(spark.createDataFrame(rows, "story int, id int, at int, summary string, title string")).first()
    assert out.narrative == f"{one}. {two}"


def test_cache(spark):
    requests = spark.createDataFrame([(i, "entities", f"p{i}") for i in range(5)] + [(9, "other", "p0")], "id int, task string, prompt string")
    key = fill.cache_key(F.lit("entities"), F.col("prompt"))
    cache = requests.where("id < 4 AND task = 'entities'").select(key.alias("hash"), "task", F.when(F.col("id") == 2, "{bad").otherwise(F.concat(F.lit('"a'), "id", F.lit('"'))).alias("response"), F.when(F.col("id") == 1, at("2024-01-01 00:00:00")).otherwise(at("2024-01-31 23:00:00")).alias("created_at"))
    out = {x.id: x.response for x in fill.cached(requests, cache, at(NOW), 86_400).collect()}
    assert out == {0: '"a0"', 1: None, 2: None, 3: '"a3"', 4: None, 9: None}
    assert all(x.response is None for x in fill.cached(requests, cache, at(NOW), 0).collect())
    assert fill.purge(cache, at(NOW), 86_400).count() == 3 and fill.drop(cache, cache.limit(1)).count() == 3
    fresh = fill.put(cache, spark.createDataFrame([(cache.first().hash, "entities", '"new"'), ("h", "entities", None)], "hash string, task string, response string"), at(NOW), 86_400)
    assert {x.response for x in fresh.collect()} == {'"new"', "{bad", '"a3"'}


def test_batches_fail_alone_and_ask_once(spark):
    def ask(prompts):
        if "boom" in prompts:
            raise ValueError("no answer")
        return [p.upper() for p in prompts] if len(prompts) < 4 else prompts[:1]

    rows = [(f"{i:02}", f"q{i}") for i in range(4)] + [("00", "q0"), ("09", "boom")]
    one = spark.createDataFrame(rows, "hash string, prompt string").dropDuplicates(["hash"]).coalesce(1).sortWithinPartitions("hash")
    out = {x.hash: x.response for x in fill.asked(one, ask, batch=1).collect()}
    assert out == {"00": "Q0", "01": "Q1", "02": "Q2", "03": "Q3", "09": None}
    assert all(x.response is None for x in fill.asked(one.where("hash < '05'"), ask, batch=4).collect())  # another number of answers


def test_tiers(spark):
    memory = gazetteer.learn(spark.createDataFrame([(1, 1, ["HDFC Bank"], ["banking"], ["India"])], "id long, at long, entities array<string>, sectors array<string>, regions array<string>"))
    rows = [(1, 1, "x", "y", '{"entities": ["A"]}'), (2, 1, "x", "y", ""), (3, 3, "HDFC Bank gains", "", None), (4, 3, "HDFC Bank gains", "", None), (5, 5, "Zeptolytics soars", "", None), (6, 5, "z", "", None), (7, 70, "Qubits Ltd falls", "", None), (8, 8, "fails here Now", "", None)]
    articles = spark.createDataFrame(rows, "id long, group_id long, title string, summary string, entities string")
    cache = spark.createDataFrame([("Qubits Ltd falls\n",)], "p string").select(fill.cache_key(F.lit("entities"), F.col("p")).alias("hash"), F.lit("entities").alias("task"), F.lit("{}").alias("response"), at("2024-01-31 23:00:00").alias("created_at"))
    out, put = fill.filled(articles, memory, cache, lambda ps: [None if "fails" in p else '{"entities": ["Z"]}' for p in ps], at(NOW), 86_400, cut)
    assert {x.id: x.tier for x in out.collect()} == {2: "copied", 3: "matched", 4: "matched", 5: "called", 6: "called", 7: "cached", 8: "failed"}
    assert sorted(str(x.response) for x in put.collect()) == ["None", '{"entities": ["Z"]}']


def test_continued_trends(spark):
    kinds = "id long, text string, entities array<string>"
    trends = spark.createDataFrame([(1, "RBI tightens lending rules for banks", ["rbi", "hdfc"]), (2, "lending rules for banks by RBI", ["rbi", "hdfc"]), (3, "Iceland volcano", ["iceland", "grindavik"])], kinds)
    articles = spark.createDataFrame([(10, "RBI adds lending rules for banks", ["rbi", "hdfc", "x"]), (11, "RBI adds lending rules for banks", ["rbi"]), (12, "quite another text", ["iceland", "grindavik"]), (13, "volcano in Iceland erupts", ["iceland", "grindavik"])], kinds)
    assert {x.article: (x.trend, x.shared) for x in assembly.continued_trends(articles, trends).collect()} == {10: (2, 2), 13: (3, 2)}


def test_distinct_walks_and_words(spark):
    rows = [("A>B>C>D", 0.5), ("B>C>D", 0.9), ("A>B>X>Y", 0.4), ("Q>R>S", 0.2)]
    walks = spark.createDataFrame(rows, "signature string, confidence double").withColumn("nodes", F.split("signature", ">"))
    assert {x.signature for x in chains.distinct_walks(walks, cut).collect()} == {"A>B>C>D", "A>B>X>Y", "Q>R>S"}
    one, other = (spark.range(1).select(chains.structure_hash(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(1.0), F.lit(x))).alias("h")).first().h for x in (0.5, 0.5004))
    assert one == other


def test_sample_and_quotes(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "title": "x"}, {"id": 2}]')
    (tmp_path / "q.csv").write_text("symbol,open,close\nA,100,110\nB,,5\nC,0,5\n")
    assert [(x.id, x.title) for x in tables.load_json(spark, str(tmp_path / "a.json"), "id int, title string").collect()] == [(1, "x"), (2, None)]
    assert [x.pct for x in tables.load_quotes(spark, str(tmp_path / "q.csv")).orderBy("symbol").collect()] == [10.0, None, None]


def test_log_of_runs(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    tables.log_run(spark, path, "trends", "ok", "3 new", at(NOW))
    tables.log_run(spark, path, "stories", "error", "no answer", at(NOW))
    assert sorted((x.stage, x.status, x.detail) for x in spark.read.parquet(path).collect()) == [("stories", "error", "no answer"), ("trends", "ok", "3 new")]


def test_continued_trends_in_tiles(spark, monkeypatch):
    """articles meet trends by tiles instead of by all pairs that share an entity; the rows are those of brute force."""
    r = random.Random(3)
    words, names = [f"w{i}" for i in range(60)], [f"e{i}" for i in range(12)]
    rows = lambda first, n: [(first + i, " ".join(r.choices(words[:25], k=r.randint(0, 12)) + r.sample(words, 2)) if i % 9 else "", r.sample(names, r.randint(0, 5))) for i in range(n)]
    articles, trends = rows(0, 70), rows(1000, 40) + [(2000, "w1 w2 w3", names), (2001, "w3 w2 w1", names)]

    def cos(a, b):
        a, b = Counter(a.split()), Counter(b.split())
        return sum(n * b[w] for w, n in a.items()) / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values())) if a and b else 0.0

    want = {}
    for i, text, own in articles:
        fit = [(-round(cos(text, t), 9), j, len(set(own) & set(e))) for j, t, e in trends if len(set(own) & set(e)) >= 2 and cos(text, t) >= 0.3 - 1e-12]
        if fit:
            want[i] = min(fit)[1:]
    kinds, spread = "id long, text string, entities array<string>", assembly.tiles.paired
    monkeypatch.setattr(assembly.tiles, "paired", lambda left, right, by=None: spread(left, right, by, 16))
    found = assembly.continued_trends(spark.createDataFrame(articles, kinds), spark.createDataFrame(trends, kinds)).collect()
    assert {x.article: (x.trend, x.shared) for x in found} == want and len(want) > 20
