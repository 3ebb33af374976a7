import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import sketches as K


@pytest.fixture(scope="module")
def table(spark):
    i = F.col("id")
    return spark.range(60_000).select(
        (i % 12).cast("int").alias("day"), i, F.when(i % 7 != 0, (i * 7919 % 10_007) / 3).alias("x"),
        F.concat(F.lit("v"), i % 500).alias("text"), F.lit(None).cast("double").alias("none"), F.when(i % 3 == 0, F.lit(float("nan"))).otherwise(2.5).alias("odd"),
    ).cache()


def exact_ranks(values, got, share):
    values = np.sort(values)
    return np.searchsorted(values, got, "left") / len(values) - share, np.searchsorted(values, got, "right") / len(values) - share


@pytest.mark.parametrize("days", [[3], [0, 5, 7], list(range(12))])
def test_merged_parts_equal_direct_ones_within_the_error(spark, table, days):
    parts = K.build(table, ["day"]).filter(F.col("day").isin(days))
    some = table.filter(F.col("day").isin(days))
    got = {r["column"]: r for r in K.merge(parts).collect()}
    rows = some.toPandas()
    assert set(got) == {"id", "x", "text", "none", "odd"}
    for c, r in got.items():
        known = rows[c].dropna()
        assert (r["rows"], r["nulls"]) == (len(rows), len(rows) - len(known))
        distinct = known.nunique()
        assert abs(r["distinct"] - distinct) <= max(1, K.DISTINCT_ERROR * distinct)
        if c == "text" or not len(known):
            assert r["low"] is None and r["q0.5"] is None
            continue
        assert (r["low"], r["high"]) == (known.min(), known.max())
        for share in (0.25, 0.5, 0.75):
            low, high = exact_ranks(known.to_numpy(), r[f"q{share:g}"], share)
            assert low <= K.RANK_ERROR and high >= -K.RANK_ERROR, (c, share)


def test_parts_are_kept_and_replaced(spark, table, tmp_path):
    path = str(tmp_path / "s")
    K.add_parts(table.filter("day < 2"), path, ["day"])
    K.add_parts(table.filter("day in (1, 2) and id < 30000"), path, ["day"])
    kept = spark.read.parquet(path)
    got = {r["day"]: r["rows"] for r in kept.filter(F.col("column") == "id").collect()}
    assert got == {0: 5000, 1: 2500, 2: 2500}
    assert K.merge(kept.filter("day = 1")).filter(F.col("column") == "x").first()["rows"] == 2500
