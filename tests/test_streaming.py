"""Streaming operators on files read as a stream, against their batch results."""

from pyspark.sql import functions as F

from tidewire.streaming import counters


def run(spark, frame, mode, name):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_daily_hits_and_arrivals(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 10:00:00"), (2, "a", "2024-01-01 11:00:00"), (3, "b", "2024-01-02 10:00:00")]
    df = spark.createDataFrame(rows, "id long, path string, at string").withColumn("created_at", F.col("at").cast("timestamp"))
    df.write.parquet(str(tmp_path / "v"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "v"))
    found = {(str(r.day), r.path): r.hits for r in run(spark, counters.daily_hits(stream), "update", "hits").collect()}
    assert found == {("2024-01-01", "a"): 2, ("2024-01-02", "b"): 1}
    urls = stream.select(F.col("path").alias("url"), F.col("created_at").alias("fetched_at"))
    assert sorted(r.url for r in run(spark, counters.first_arrivals(urls), "append", "urls").collect()) == ["a", "b"]


def feed(spark, tmp_path, name, batches, schema):
    """A stream of one file a batch."""
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, schema.replace("timestamp", "string"))
        for c in schema.split(", "):
            if c.endswith(" timestamp"):
                frame = frame.withColumn(c.split()[0], F.col(c.split()[0]).cast("timestamp"))
        frame.coalesce(1).write.parquet(str(tmp_path / name / f"{i}"))
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / name))


def test_reading_progress_ends_and_drops_what_is_late(spark, tmp_path):
    counters.with_rocksdb(spark)
    batches = [
        [(1, 1, "2024-01-01 10:00:00", 0.4), (1, 1, "2024-01-01 11:00:00", 0.95), (1, 1, "2024-01-01 12:00:00", 0.2), (2, 1, "2024-01-01 10:00:00", 0.3)],
        [(3, 1, "2024-01-02 10:00:00", 0.1), (1, 1, "2024-01-02 09:00:00", 0.99)],
        [(3, 1, "2024-01-08 10:00:00", 0.5)],  # the watermark passes the timers of 1 and 2
        [(3, 1, "2024-01-08 10:30:00", 0.55)],  # rows are late by the watermark that the batch before them went by
        [(2, 1, "2024-01-02 10:00:00", 0.9), (3, 1, "2024-01-08 11:00:00", 0.6)],  # late, and in time
        [(2, 1, "2024-01-08 12:00:00", 0.2)],  # begins anew
    ]
    stream = feed(spark, tmp_path, "p", batches, "user_id long, story_id long, at timestamp, progress double")
    out = run(spark, counters.reading_progress(stream), "update", "progress").collect()
    rows = [(x.user_id, x.progress, str(x.completed_at)[:19] if x.completed_at else None, x.updates, x.ended) for x in out]
    of = lambda user: [x[1:] for x in rows if x[0] == user]
    first = "2024-01-01 11:00:00"
    assert of(1) == [(0.95, first, 3, False), (0.99, first, 4, False), (0.99, first, 4, True)]
    assert of(2) == [(0.3, None, 1, False), (0.3, None, 1, True), (0.2, None, 1, False)]
    assert of(3) == [(0.1, None, 1, False), (0.5, None, 2, False), (0.55, None, 3, False), (0.6, None, 4, False)]


def test_usage_and_velocity(spark, tmp_path):
    usage = feed(spark, tmp_path, "u", [[("2024-01-01 10:00:00", "A", "m", 5, 1), ("2024-01-01 12:00:00", "A", "m", 7, 2)], [("2024-01-02 10:00:00", "A", "m", 1, 1)]], "at timestamp, provider string, model string, prompt long, completion long")
    last = {str(x.day): (x.calls, x.prompt, x.completion, str(x.first_at), str(x.last_at)) for x in run(spark, counters.usage_counters(usage), "update", "usage").collect()}
    assert last["2024-01-01"] == (2, 12, 3, "2024-01-01 10:00:00", "2024-01-01 12:00:00") and last["2024-01-02"][0] == 1
    visits = feed(spark, tmp_path, "w", [[("2024-01-03 10:00:00", "a"), ("2024-01-04 10:00:00", "a")]], "created_at timestamp, path string")
    counts = {str(x.start)[:10]: x.n for x in run(spark, counters.velocity(visits), "update", "velocity").collect()}
    assert counts == {"2024-01-01": 1, "2024-01-02": 2, "2024-01-03": 2, "2024-01-04": 1}


def test_changed_rows(spark):
    last = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    out = []
    counters.changed_rows(lambda: last, lambda df: out.extend(df.collect()), "id")(spark.createDataFrame([(1, "a"), (2, "c"), (3, None)], "id int, x string"), 0)
    assert sorted((r.id, r.x or "") for r in out) == [(2, "c"), (3, "")]
