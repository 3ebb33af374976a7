import datetime

from pyspark.sql import functions as F

from tabwright.streaming import jobs

SCHEMA = "event_id long, ts timestamp, user_id long, level string, value double"
START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def feed(spark, folder, batches):
    """One file per batch, read in order of their modification times."""
    import os

    for i, batch in enumerate(batches):
        path = f"{folder}/b{i}"
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(path)
        for f in os.listdir(path):
            os.utime(f"{path}/{f}", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name).collect()


def test_window_counts_drop_late_rows(spark, tmp_path):
    batches = [
        [(1, at(10), 1, "INFO", 1.0), (2, at(20), 1, "ERROR", 1.0)],
        [(3, at(600), 1, "INFO", 1.0)],
        [(4, at(1200), 1, "INFO", 1.0)],
        [(5, at(15), 1, "INFO", 1.0), (6, at(1300), 1, "INFO", 1.0)],
        [(7, at(2400), 1, "DEBUG", 1.0)],
    ]
    got = run(jobs.live_log_counts(feed(spark, tmp_path, batches), "ts"), "w1")
    first = min(got, key=lambda r: r["start"])
    assert (first["lines"], first["info"], first["error"], first["warning"]) == (2, 1, 1, 0)


def test_once_per_id(spark, tmp_path):
    batches = [[(1, at(0), 1, "a", 1.0), (1, at(1), 1, "a", 1.0)], [(1, at(2), 1, "a", 1.0), (2, at(3), 1, "a", 1.0)]]
    got = run(jobs.once_per_id(feed(spark, tmp_path, batches), ["event_id"], "ts", "1 minute"), "w2")
    assert sorted(r["event_id"] for r in got) == [1, 2]


def test_latest_state(spark, tmp_path):
    batches = [[(1, at(0), 1, "a", 1.0), (2, at(5), 1, "b", 2.0)], [(3, at(3), 1, "c", 3.0), (4, at(9), 2, "d", 4.0)]]
    stream = jobs.latest_state(feed(spark, tmp_path, batches), ["user_id"], "ts", "event_id")
    got = run(stream, "w3", "complete")
    assert {r["user_id"]: r["level"] for r in got} == {1: "b", 2: "d"}


def test_liveness(spark, tmp_path):
    batches = [
        [(1, at(0), 1, "a", 1.0), (2, at(0), 2, "a", 1.0)],
        [(3, at(60), 1, "a", 1.0)],
        [(4, at(140), 1, "a", 1.0)],
        [(5, at(200), 1, "a", 1.0)],
        [(6, at(210), 1, "a", 1.0)],
    ]
    got = run(jobs.liveness(feed(spark, tmp_path, batches), "user_id", "ts"), "w4")
    seen = sorted((r["worker_id"], r["status"], r["at"]) for r in got)
    assert seen == [(1, "online", at(0)), (2, "offline", at(90)), (2, "online", at(0))]


def test_liveness_is_the_same_for_any_cut_into_batches(spark, tmp_path):
    beats = [(i, at(s), 1, "a", 1.0) for i, s in enumerate([0, 60, 500, 560, 1200])] + [(9, at(1300), 2, "a", 1.0)]
    cuts = {"one": [beats], "each": [[b] for b in beats], "two": [beats[:3], beats[3:]]}
    seen = {}
    for name, batches in cuts.items():
        got = run(jobs.liveness(feed(spark, str(tmp_path / name), batches), "user_id", "ts"), f"live_{name}")
        seen[name] = sorted((r["status"], r["at"]) for r in got if r["worker_id"] == 1)
    want = sorted([("online", at(0)), ("offline", at(150)), ("online", at(500)), ("offline", at(650)), ("online", at(1200))])
    assert seen["one"] == want and seen["two"] == want
    assert seen["each"] == want


def test_change_relay(spark, tmp_path):
    batches = [
        [(1, at(0), 1, "a", 1.0), (2, at(1), 1, "a", 1.0), (3, at(2), 1, "b", 1.0)],
        [(4, at(3), 1, "b", 1.0), (5, at(4), 1, "a", 1.0), (6, at(5), 2, "a", 1.0)],
    ]
    stream = jobs.change_relay(feed(spark, tmp_path, batches), "user_id", "level", "event_id", "user_id long, event_id long, level string")
    assert sorted(r["event_id"] for r in run(stream, "w5")) == [1, 3, 5, 6]


def test_ingest_resumes(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    row = [(1, at(0), 1, "a", 1.0)]
    for i in range(2):
        spark.createDataFrame(row, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.new_files(spark, source, "parquet", SCHEMA)
        jobs.ingest(stream, target, checkpoint, lambda d: d.filter(F.col("value") > 0)).awaitTermination(60)
        assert spark.read.parquet(target).count() == i + 1


def test_upsert_sink_merges_the_first_batch(spark, tmp_path):
    path = str(tmp_path / "state")
    stream = feed(spark, str(tmp_path / "src"), [[(1, at(0), 1, "a", 1.0), (2, at(5), 1, "b", 1.0)]])
    stream.writeStream.foreachBatch(jobs.upsert_sink(path, ["user_id"], ["ts"])).trigger(availableNow=True).start().awaitTermination(60)
    assert [r["event_id"] for r in spark.read.parquet(f"{path}/v=0").collect()] == [2]


def test_log_lines_are_parsed_on_a_stream(spark, tmp_path):
    from tabwright.operators import logs

    lines = [f"2024-01-01 00:0{i % 3}:00.000 | {'ERROR' if i % 2 else 'INFO'} | mod:run:1 - x" for i in range(12)]
    spark.createDataFrame([(x,) for x in lines], "line string").write.parquet(str(tmp_path / "in"))
    raw = spark.readStream.schema("line string").parquet(str(tmp_path / "in"))
    parsed = logs.parse_app_log(raw, "line").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    counts = jobs.live_log_counts(parsed, "timestamp")
    q = counts.writeStream.format("memory").queryName("loglines").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    rows = spark.table("loglines").collect()
    assert sum(r["lines"] for r in rows) == 12 and sum(r["error"] for r in rows) == 6


def test_upsert_sink(spark, tmp_path):
    batches = [[(1, at(0), 1, "a", 1.0)], [(2, at(5), 1, "b", 1.0), (3, at(1), 2, "c", 1.0)]]
    path = str(tmp_path / "state")
    stream = feed(spark, str(tmp_path / "src"), batches)
    q = stream.writeStream.foreachBatch(jobs.upsert_sink(path, ["user_id"], ["ts"])).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["user_id"]: r["level"] for r in spark.read.parquet(f"{path}/v=1").collect()} == {1: "b", 2: "c"}


def test_fitted_cleaning_runs_on_a_stream(spark, tmp_path):
    from tabwright.operators import cleaning as C

    train = spark.createDataFrame([(1.0,), (3.0,)], "value double")
    fitted = C.fit(train, [C.FillMissing("value", "mean"), C.Normalize("value")])
    stream = fitted.apply(feed(spark, tmp_path, [[(1, at(0), 1, "a", None)]]))
    assert [r["value"] for r in run(stream, "w6")] == [0.5]
