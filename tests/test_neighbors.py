import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators.neighbors import knn_classify, knn_regress, nearest


@pytest.mark.parametrize("pivots,block", [(8, 25), (40, 1000)])
def test_matches_brute_force_with_a_hot_point(spark, pivots, block):
    rng = np.random.default_rng(1)
    train = np.round(rng.normal(size=(400, 3)), 1)
    train[:140] = [0.5, 0.5, 0.5]
    asked = np.vstack([np.round(rng.normal(size=(120, 3)), 1), np.tile([0.5, 0.5, 0.5], (60, 1))])
    t = spark.createDataFrame([(i, *map(float, v), i % 3) for i, v in enumerate(train)], "t long, a double, b double, c double, y int")
    q = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(asked)], "q long, a double, b double, c double")
    out = nearest(q.repartition(3), t.repartition(5), ["a", "b", "c"], 7, "q", "t", "y", block_rows=block, pivots=pivots)
    got: dict[int, list] = {}
    for r in out.orderBy("query_id", "distance", "train_id").collect():
        got.setdefault(r["query_id"], []).append(r["train_id"])
    for i, v in enumerate(asked):
        d = np.zeros(len(train))
        for j in range(3):
            d += (v[j] - train[:, j]) ** 2
        assert got[i] == [int(j) for j in np.lexsort((np.arange(len(train)), np.sqrt(d)))[:7]]


def test_fewer_rows_than_k_and_votes(spark):
    t = spark.createDataFrame([(1, 0.0, 1.0), (2, 3.0, 5.0)], "t long, x double, y double")
    q = spark.createDataFrame([(1, 1.0), (2, 3.0)], "q long, x double")
    out = nearest(q, t, ["x"], 5, "q", "t", "y")
    assert out.count() == 4
    assert {r["query_id"]: r["prediction"] for r in knn_regress(out).collect()} == {1: 3.0, 2: 3.0}
    weighted = {r["query_id"]: r["prediction"] for r in knn_regress(out, "distance").collect()}
    assert weighted == {1: pytest.approx((1 * 1 + 5 * 0.5) / 1.5), 2: 5.0}
    assert {r["query_id"]: r["prediction"] for r in knn_classify(out).collect()} == {1: 1.0, 2: 1.0}
    with pytest.raises(ValueError):
        nearest(q, t.filter("false"), ["x"], 1, "q", "t", "y")


def test_every_query_gets_its_neighbours(spark):
    t = spark.range(50).select(F.col("id").alias("t"), F.col("id").cast("double").alias("x"), F.lit(1).alias("y"))
    q = spark.range(200).select(F.col("id").alias("q"), (F.col("id") / 4).alias("x"))
    counts = nearest(q, t, ["x"], 3, "q", "t", "y").groupBy("query_id").count().select("count").distinct().collect()
    assert [r[0] for r in counts] == [3]


def wide(seed, n, columns=50, inner=6):
    """Points that vary in a few directions, as feature rows do, spread over many columns."""
    rng = np.random.default_rng(7)
    basis = rng.normal(size=(inner, columns))
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, inner)) @ basis + rng.normal(size=(n, columns)) * 0.1


def vectors(spark, x, key):
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    names = [f"c{i}" for i in range(x.shape[1])]
    return spark.createDataFrame(rows, f"{key} long, " + ", ".join(f"{n} double" for n in names)), names


def test_hashed_search_finds_most_neighbours_of_wide_rows(spark, monkeypatch):
    from tabwright.operators import neighbors as N

    t, names = vectors(spark, wide(1, 4000), "t")
    q, _ = vectors(spark, wide(2, 150), "q")
    t = t.withColumn("y", F.col("t") % 3)
    routed = []
    cut = N.cut_lineage

    def seen(df):
        out = cut(df)
        if "query_id" in df.columns and "bucket" in df.columns:
            routed.append(out.count())
        return out

    monkeypatch.setattr(N, "cut_lineage", seen)
    out = N.nearest_hashed(q.repartition(3), t.repartition(4), names, 5, "q", "t", "y", bucket_rows=250, block_rows=200)
    exact = nearest(q, t, names, 5, "q", "t", "y")
    assert N.recall(out, exact) >= 0.9
    assert routed[0] < 150 * 50
    got = out.collect()
    assert {(r["query_id"], r["train_id"]) for r in got} == {(r["query_id"], r["train_id"]) for r in N.nearest_hashed(q, t, names, 5, "q", "t", "y", bucket_rows=250).collect()}
    # distances and their order are exact
    true = {(r["query_id"], r["train_id"]): r["distance"] for r in exact.collect()}
    assert all(true.get((r["query_id"], r["train_id"]), r["distance"]) == r["distance"] for r in got)
    assert all(r["payload"] == r["train_id"] % 3 for r in got) and len(got) == 150 * 5


def test_hashed_search_of_few_rows_and_hot_points_is_exact(spark):
    from tabwright.operators.neighbors import nearest_hashed, recall

    x = np.round(wide(3, 300, 12), 1)
    x[:120] = x[0]
    t, names = vectors(spark, x, "t")
    asked = np.vstack([x[:1], x[200:220], wide(4, 20, 12) * 50])
    q, _ = vectors(spark, asked, "q")
    t = t.withColumn("y", F.lit(1))
    exact = nearest(q, t, names, 7, "q", "t", "y")
    # one bucket, then buckets that hold fewer than k rows and send their queries to the exact search
    assert recall(nearest_hashed(q, t, names, 7, "q", "t", "y"), exact) == 1.0
    small = nearest_hashed(q, t, names, 7, "q", "t", "y", tables=1, probes=1, bucket_rows=2)
    assert small.groupBy("query_id").count().filter("count <> 7").isEmpty() and recall(small, exact) > 0.3
    with pytest.raises(ValueError):
        nearest_hashed(q, t.filter("false"), names, 1, "q", "t", "y")


def test_cells_grow_in_number_not_in_size(spark):
    """A query is compared with a few cells, and a cell does not grow with the table."""
    from tabwright.operators import neighbors as N

    assert N.CELL_ROWS <= 2000
    n = 12 * N.CELL_ROWS
    t = spark.range(n).select("id", (F.rand(3) * 10).alias("a"), (F.rand(4) * 10).alias("b"), (F.col("id") % 3).alias("y"))
    met = spark.sparkContext.accumulator(0)
    by_value = N._closest

    def counted(d, k):
        met.add(d.size)
        return by_value(d, k)

    N._closest = counted
    try:
        found = nearest(t.where("id % 20 = 0"), t, ["a", "b"], 3, "id", "id", "y")
        rows = found.groupBy("query_id").count().collect()
    finally:
        N._closest = by_value
    assert len(rows) == n // 20 and {r["count"] for r in rows} == {3}
    # not the whole table for each query
    assert 0 < met.value < (n // 20) * n / 2


def test_closest_keeps_the_lower_column_on_ties():
    from tabwright.operators.neighbors import _closest

    d = np.array([[3.0, 1.0, 1.0, 1.0, 2.0], [np.inf, 5.0, np.inf, np.inf, 4.0]])
    row, column = _closest(d, 2)
    assert row.tolist() == [0, 0, 1, 1] and column.tolist() == [1, 2, 4, 1]
    nan = np.array([[np.nan, 2.0, np.nan, np.nan], [np.nan, np.inf, np.nan, np.nan]])
    assert [a.tolist() for a in _closest(nan, 2)] == [[0], [1]]
    assert [a.tolist() for a in _closest(nan, 2, finite=False)] == [[0, 0, 1, 1], [1, 0, 1, 0]]
    with np.errstate(invalid="ignore"):
        some = np.random.default_rng(2).choice([np.nan, 1.0, 2.0, 3.0], (40, 30))
        best = np.argsort(some, axis=1, kind="stable")[:, :4]
    assert _closest(some, 4, finite=False)[1].tolist() == best.reshape(-1).tolist()
