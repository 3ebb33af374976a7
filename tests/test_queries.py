"""Every registered query against its check SQL, the entry point, and plan checks."""

import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tabwright.operators import catalog, cleaning, layout
from tabwright.operators.cleaning import DropDuplicates

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    ok, note = compare(spark, duck, sf, name, QUERIES[name], ORACLES.get(name))
    assert ok, note


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() == 5 and out.columns[0] == "position"


def test_names():
    assert set(ORACLES) <= set(QUERIES)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ordered_fill_of_a_large_group_has_no_single_partition(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet")
    out = layout.carry_forward(df, {"filled": F.col("value")}, ["ts", "event_id"], target_rows=100)
    window = plan(out).split("Window", 1)[1]
    assert "hashpartitioning(__b0" in window
    main = [line for line in plan(out).splitlines() if "SinglePartition" in line]
    # only the table with one row per range is gathered
    assert all("__n" not in line for line in main)


def test_keep_first_reduces_before_the_shuffle(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    for out in (
        cleaning.clean_one(df, DropDuplicates(("o_custkey",), "first", ("o_orderkey",))),
        catalog.latest_by_key(df, ["o_custkey"], ["o_orderdate", "o_orderkey"]),
    ):
        assert plan(out).count("WindowGroupLimit") == 2


def test_filters_and_columns_reach_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    out = cleaning.clean_one(df, cleaning.FilterRows("l_quantity", "gt", 10.0)).select("l_orderkey")
    text = plan(out)
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text


def test_lineage_depth_finds_cycles(spark):
    links = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 9)], "id long, parent_id long")
    assert {r["id"]: r["depth"] for r in catalog.lineage_depth(links).collect()} == {1: 0, 2: 1, 3: 2, 4: 1}


def test_repartitioned_input_gives_the_same_rows(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet").withColumn("k", F.col("o_custkey") % 5)
    op = DropDuplicates(("k",), "last", ("o_orderkey",))
    assert sorted(cleaning.clean_one(df, op).collect()) == sorted(cleaning.clean_one(df.repartition(13), op).collect())


def test_log_format_comes_from_all_lines(spark, tmp_path):
    # the first 150 lines are null, the others in the known format
    df = spark.range(1000, numPartitions=1).select(
        F.col("id").alias("event_id"), F.lit(7).cast("long").alias("user_id"), F.when(F.col("id") >= 150, F.lit("click")).alias("event_type")
    )
    df.write.parquet(f"{tmp_path}/events.parquet")
    out = QUERIES["log_detect"](spark, str(tmp_path))
    assert {r["format"] for r in out.collect()} == {"syslog"} and out.count() == 850
