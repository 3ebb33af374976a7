"""Bucketed windows against plain pandas, with one group holding most rows."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwright.operators import layout
from tabwright.operators.layout import Key

N = 3000


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for i in range(N):
        group = "hot" if rng.random() < 0.7 else f"g{rng.randrange(40)}"
        tie = 5 if rng.random() < 0.4 else rng.randrange(1000)
        value = None if rng.random() < 0.6 else float(rng.randrange(100))
        out.append((i, group, tie, f"name-{rng.randrange(500):05d}-{i:06d}", value))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, g string, tie int, name string, v double").repartition(7)


@pytest.fixture(scope="module")
def pdf(rows):
    return pd.DataFrame(rows, columns=["id", "g", "tie", "name", "v"])


@pytest.mark.parametrize("groups", [[], ["g"]])
@pytest.mark.parametrize("order", [["tie", "id"], ["-tie", "id"], ["name"]])
def test_row_numbers(frame, pdf, groups, order):
    lay = layout.build(frame, order, groups, target_rows=100)
    assert lay.buckets
    largest = lay.df.groupBy(*groups, *lay.buckets).count().agg(F.max("count")).first()[0]
    assert largest < N / 3
    got = {r["id"]: r["n"] for r in layout.row_numbers(frame, "n", order, groups, target_rows=100).collect()}
    names = [o.lstrip("-") for o in order]
    ordered = pdf.sort_values(names, ascending=[not o.startswith("-") for o in order])
    want = ordered.groupby("g").cumcount() + 1 if groups else pd.Series(range(1, N + 1), index=ordered.index)
    assert got == dict(zip(ordered["id"], want.loc[ordered.index]))


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_fills_and_neighbours(frame, pdf, groups):
    ordered = pdf.sort_values(["tie", "id"])
    series = ordered.groupby("g")["v"] if groups else ordered["v"]
    out = layout.carry_forward(frame, {"f": F.col("v")}, ["tie", "id"], groups, True, 100)
    assert _same(out, "f", ordered, series.ffill())
    out = layout.carry_forward(frame, {"b": F.col("v")}, [Key("tie", True), Key("id", True)], groups, True, 100)
    assert _same(out, "b", ordered, series.bfill())
    out = layout.neighbours(frame, F.col("v"), ["tie", "id"], groups, 100)
    assert out.columns == [*frame.columns, "__at", "__lo", "__hi"]
    assert _same(out.withColumn("x", F.col("__lo.v")), "x", ordered, series.ffill())
    assert _same(out.withColumn("x", F.col("__hi.v")), "x", ordered, series.bfill())


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_running_sums_and_previous(frame, pdf, groups):
    ordered = pdf.sort_values(["tie", "id"])
    by = ordered.groupby("g") if groups else ordered
    out = layout.running_sums(frame, {"s": "tie"}, ["tie", "id"], groups, 100)
    assert _same(out, "s", ordered, by["tie"].cumsum())
    out = layout.previous(frame, "v", "p", ["tie", "id"], groups, 100)
    assert _same(out, "p", ordered, by["v"].shift())
    firsts = out.filter("not p_known").count()
    assert firsts == (ordered["g"].nunique() if groups else 1)


def test_special_order_values(spark):
    values = [None, float("nan"), -0.0, 0.0, 1.5, -2.0, float("inf")] * 30
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, x double")
    got = [r["id"] for r in layout.row_numbers(df, "n", ["x", "id"], target_rows=5).orderBy("n").collect()]
    want = [r["id"] for r in df.orderBy("x", "id").collect()]
    assert got == want


def test_timestamps_and_negative_longs(spark):
    df = spark.range(400).select(
        F.col("id"),
        (F.lit("2024-03-31 01:59:59.5").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") % 7)).alias("t"),
        ((F.col("id") - 200) * F.lit(2**40)).alias("big"),
    )
    for order in (["t", "id"], ["-big"], ["big"]):
        got = [r["id"] for r in layout.row_numbers(df, "n", order, target_rows=20).orderBy("n").collect()]
        want = [r["id"] for r in df.orderBy(*[k.sort() for k in layout.keys(order)]).collect()]
        assert got == want


def test_small_groups_keep_the_plain_window(frame):
    lay = layout.build(frame, ["id"], ["g"], target_rows=N)
    assert not lay.buckets


@pytest.mark.parametrize(
    "order",
    [["url"], ["day", "id"], ["a", "b", "id"], ["raw"], ["same"], ["wait", "id"]],
)
def test_as_many_ranges_as_rows_ask_for(spark, order):
    """Long common prefixes, few values in front, binary and interval keys, and one value for all rows."""
    n, target = 6000, 250
    df = spark.range(n).select(
        "id",
        F.concat(F.lit("https://www.example.com/a/long/common/prefix/"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("url"),
        (F.col("id") * 7 % 30).alias("day"),
        (F.col("id") % 9).alias("a"),
        (F.col("id") * 11 % 13).alias("b"),
        F.encode(F.lpad((F.col("id") * 31 % n).cast("string"), 6, "0"), "utf-8").alias("raw"),
        F.lit(1).alias("same"),
        F.make_dt_interval(secs=F.col("id") % 100).alias("wait"),
    )
    lay = layout.build(df, order, (), target)
    sizes = [r["count"] for r in lay.df.groupBy(*lay.buckets).count().collect()]
    assert len(sizes) <= 2 * math.ceil(n / target) and max(sizes) < 4 * target
    got = layout.row_numbers(df, "n", order, (), target)
    assert got.agg(F.sum("n"), F.count_distinct("n")).first()[:] == (n * (n + 1) // 2, n)
    if order != ["same"]:
        want = [r["id"] for r in df.orderBy(*[k.sort() for k in layout.keys(order)]).collect()]
        assert [r["id"] for r in got.orderBy("n").collect()] == want


def test_empty_and_missing_order(spark, frame):
    empty = frame.filter("false")
    assert layout.row_numbers(empty, "n", ["id"]).count() == 0
    with pytest.raises(ValueError):
        layout.keys([])


def _same(df, column, ordered, want):
    got = {r["id"]: r[column] for r in df.select("id", column).collect()}
    expect = {i: (None if pd.isna(v) else v) for i, v in zip(ordered["id"], want.loc[ordered.index])}
    return got == expect and not any(isinstance(v, float) and math.isnan(v) for v in got.values() if v is not None)


def test_ranges_follow_from_the_rows_alone(spark, monkeypatch):
    """A map task that runs again deals its rows to the same ranges: the row number counts a written table."""
    import re

    df = spark.range(4000).repartition(7).withColumn("k", F.col("id") % 3).withColumn("v", F.lit(1))
    seen = []
    cut = layout.cut_lineage

    def watched(d):
        seen.append(d._jdf.queryExecution().optimizedPlan().toString())
        return cut(d)

    monkeypatch.setattr(layout, "cut_lineage", watched)
    out = layout.running_sums(df, {"n": "v"}, ["k"], target_rows=500)
    assert sorted(r["n"] for r in out.collect()) == list(range(1, 4001))
    ranged = [p for p in seen if "RepartitionByExpression" in p and "__row" in p]
    assert ranged and all("monotonically_increasing_id" in p and not re.search(r"Repartition 7", p) for p in ranged)


def test_scratch_scope_deletes_what_it_wrote(spark):
    import os

    from tabwright import session

    kept = session.cut_lineage(spark.range(3))
    with session.scratch_scope(spark):
        inner = session.cut_lineage(spark.range(5))
        path = inner.inputFiles()[0].removeprefix("file://")
        assert inner.count() == 5 and os.path.exists(path)
        with session.scratch_scope(spark):
            session.cut_lineage(spark.range(2))
        assert os.path.exists(path)
    assert not os.path.exists(path) and kept.count() == 3
