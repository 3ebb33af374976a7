import os

import pytest
from pyspark.sql import functions as F

from tabwright.streaming.merge import MergeTable, merge_sink


def rows(spark, *items):
    return spark.createDataFrame(list(items), "id long, at long, text string")


def state(table):
    return {r["id"]: (r["at"], r["text"]) for r in table.read().collect()}


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = MergeTable(spark, str(tmp_path), ["id"], ["at"], 16)
    first = spark.range(1000).select("id", F.lit(1).cast("long").alias("at"), F.lit("a").alias("text"))
    assert table.merge(first, 0) == list(range(16))
    before = files(f"{tmp_path}/data")
    touched = table.merge(rows(spark, (5, 2, "b"), (5, 3, "c"), (7, 0, "late"), (2000, 1, "new")), 1)
    assert 1 <= len(touched) <= 3
    assert len(files(f"{tmp_path}/data") - before) == len(touched)
    got = state(table)
    assert len(got) == 1001 and got[5] == (3, "c") and got[7] == (1, "a") and got[2000] == (1, "new")


def test_replays_give_the_same_table(spark, tmp_path):
    table = MergeTable(spark, str(tmp_path), ["id"], ["at"], 4)
    table.merge(rows(spark, (1, 1, "a"), (2, 1, "b")), 0)
    batch = rows(spark, (1, 2, "c"), (3, 1, "d"))
    table.merge(batch, 1)
    want, kept = state(table), files(tmp_path)
    assert table.merge(batch, 1) == [] and table.merge(rows(spark, (9, 9, "x")), 0) == []
    assert state(table) == want and files(tmp_path) == kept
    # another checkpoint counts its own batches
    assert table.merge(rows(spark, (9, 9, "x")), 0, "other")
    assert state(table)[9] == (9, "x")


def test_a_run_cut_short_before_its_manifest(spark, tmp_path):
    table = MergeTable(spark, str(tmp_path), ["id"], ["at"], 4)
    table.merge(rows(spark, (1, 1, "a")), 0)
    # files of a version whose manifest was never written
    rows(spark, (1, 5, "lost")).withColumn("__bucket", F.lit(0)).write.partitionBy("__bucket").parquet(f"{tmp_path}/data/v=1")
    assert state(table) == {1: (1, "a")}
    table.merge(rows(spark, (1, 2, "b")), 1)
    assert state(table) == {1: (2, "b")}
    rows(spark, (1, 5, "lost")).withColumn("__bucket", F.lit(3)).write.partitionBy("__bucket").parquet(f"{tmp_path}/data/v=7")
    assert table.vacuum() == 1 and state(table) == {1: (2, "b")}


def test_old_versions_go_and_readers_keep_theirs(spark, tmp_path):
    table = MergeTable(spark, str(tmp_path), ["id"], ["at"], 2)
    table.merge(rows(spark, (1, 0, "v0"), (2, 0, "v0"), (3, 0, "v0")), 0)
    for epoch in range(1, 6):
        reader = table.read()
        table.merge(rows(spark, *[(i, epoch, f"v{epoch}") for i in (1, 2, 3)]), epoch)
        assert {r["text"] for r in reader.collect()} == {f"v{epoch - 1}"}
    assert len(os.listdir(f"{tmp_path}/manifest")) == 2
    held = {d.split("/data/")[1] for d in map(os.path.dirname, files(f"{tmp_path}/data"))}
    assert {h.split("/")[0] for h in held} == {"v=4", "v=5"}


def test_ties_nulls_and_new_columns(spark, tmp_path):
    table = MergeTable(spark, str(tmp_path), ["id"], ["at"], 3)
    ties = [(1, 1, "x"), (1, 1, "y"), (None, 1, "n"), (None, None, "m"), (2, None, None)]
    table.merge(rows(spark, *ties), 0)
    one = state(table)
    other = MergeTable(spark, str(tmp_path / "other"), ["id"], ["at"], 3)
    for i, r in enumerate(reversed(ties)):
        other.merge(rows(spark, r), i)
    assert state(other) == one and one[None] == (1, "n") and one[2] == (None, None)
    table.merge(rows(spark, (2, 5, "z")).withColumn("extra", F.lit(7)), 1)
    assert {r["id"]: r["extra"] for r in table.read().collect()} == {1: None, None: None, 2: 7}
    table.merge(rows(spark), 2)
    assert len(state(table)) == 3


def test_nothing_merged_yet(spark, tmp_path):
    with pytest.raises(ValueError, match="nothing"):
        MergeTable(spark, str(tmp_path / "none"), ["id"], ["at"]).read()


def test_a_stream_merges_its_batches(spark, tmp_path):
    for i in range(4):
        rows(spark, *[(k, i, f"{k}-{i}") for k in range(i, 5)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, at long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sink = merge_sink(f"{tmp_path}/out", ["id"], ["at"], 4)
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert state(MergeTable(spark, f"{tmp_path}/out", ["id"], ["at"])) == {k: (min(k, 3), f"{k}-{min(k, 3)}") for k in range(5)}
