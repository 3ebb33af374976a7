from pyspark.sql import functions as F

from tabwright.operators import profiling as P
from tabwright.operators import replies as R


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_column_stats_edge_cases(spark):
    df = spark.createDataFrame([(1, 5.0, "a", True), (2, 5.0, None, None)], "id long, x double, c string, b boolean")
    got = by_column(P.column_stats(df))
    assert (got["x"]["std"], got["x"]["min"], got["x"]["max"], got["x"]["unique_values"]) == (0.0, 5.0, 5.0, 1)
    assert (got["c"]["nulls"], got["c"]["unique_values"], got["c"]["mean"]) == (1, 2, None)
    assert not got["b"]["is_numeric"]
    approx = by_column(P.column_stats(df, approx=True))
    assert {c: r["unique_values"] for c, r in approx.items()} == {c: r["unique_values"] for c, r in got.items()}
    one = by_column(P.column_stats(df.limit(1)))
    assert one["x"]["std"] is None
    none = by_column(P.column_stats(df.filter("false")))
    assert none["x"]["rows"] == 0 and none["x"]["unique_values"] == 0


def test_nested_columns_are_profiled_as_text(spark):
    df = spark.sql("select array(1, 2) as a, struct(1 as x) as s, map('k', 1) as m")
    assert {r["unique_values"] for r in P.column_stats(df).collect()} == {1}
    assert P.top_values(df).count() == 3


def test_top_values_ties_and_nulls(spark):
    rows = [(c,) for c in ["a", "a", "b", "b", None, None, None]]
    got = P.top_values(spark.createDataFrame(rows, "c string"), 2).orderBy("position").collect()
    assert [(r["value"], r["n"]) for r in got] == [(None, 3), ("a", 2)]
    wide = spark.range(100)
    assert P.top_values(wide).count() == 0


def test_profile_text_and_samples(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id long, c string")
    got = by_column(P.profile(df, order_by=["id"]))
    assert got["c"]["samples"] == ["x", "y"] and got["c"]["null_percentage"] == 33.33 and got["id"]["median"] == 2.0
    text = R.whole_profile_text(P.profile(df, order_by=["id"]), 3, 2, 0).first()[0]
    assert text.startswith("Dataset Analysis:\n- Total rows: 3") and "c:\n  Type: string\n  Missing: 1 (33.33%)" in text


def test_correlation(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("a"), (-F.col("id")).alias("b"), F.lit(1).alias("k"), F.lit("t").alias("t"))
    got = {(r["column_x"], r["column_y"]): r["value"] for r in P.correlation_matrix(df).collect()}
    assert got[("a", "b")] == got[("b", "a")] == -1.0 and got[("a", "a")] == 1.0 and got[("a", "k")] == 0.0 and len(got) == 9
    assert P.correlation_matrix(df.select("a")).count() == 0


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)] + [(None,)], "x double")
    got = [r["n"] for r in P.histogram(df, "x", 5).orderBy("bin").collect()]
    assert got == [2, 2, 2, 2, 3]
    sparse = spark.createDataFrame([(0.0,), (1.0,)], "x double")
    assert [r["n"] for r in P.histogram(sparse, "x", 4).orderBy("bin").collect()] == [1, 0, 0, 1]
    same = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert [tuple(r) for r in P.histogram(same, "x").collect()] == [(0, 5.0, 5.0, 2)]
    assert P.histogram(same.filter("false"), "x").count() == 0


def test_feature_stats_single_row(spark):
    got = P.feature_stats(spark.createDataFrame([(2.0,)], "x double")).first()
    assert got["std"] == 0.0 and got["median"] == 2.0


def test_correlation_and_preview_keep_everything(spark):
    df = spark.range(700).select("id", *[(F.col("id") * (i + 1) % 97).alias(f"c{i}") for i in range(21)])
    names = df.columns[1:]
    got = {(r["column_x"], r["column_y"]) for r in P.correlation_matrix(df, names).collect()}
    assert got == {(a, b) for a in names for b in names}
    assert P.preview(df, ["id"], 650).count() == 650


def test_suggestions(spark):
    rows = [(i, None if i % 3 else 1.0, "  a", 1000.0 if i == 5 else float(i % 4)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, m double, c string, x double")
    got = R.suggest_operations(P.profile(df), 7, P.outlier_counts(df, ["x"])).collect()
    assert [r["operation"] for r in got] == ["fill_missing", "drop_duplicates", "string_clean", "remove_outliers"]


def test_replies(spark):
    texts = [
        'x ```json\n[{"operation":"a","description":"d","confidence":1}]\n``` y ```json\n[]\n```',
        '```\n{"operation":"b","description":"d","confidence":0.5}\n```',
        '{"operation":"c","description":"d","confidence":0.1}',
        "no json at all",
        "[" + ",".join(['{"operation":"n","description":"d","confidence":1}'] * 7) + "]",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, reply string")
    got = R.reply_operations(df, "reply", ["id"]).groupBy("id").agg(F.count("*").alias("n"), F.min("operation").alias("o"))
    assert {r["id"]: (r["n"], r["o"]) for r in got.collect()} == {0: (1, "a"), 1: (1, "b"), 2: (1, "c"), 4: (7, "n")}
    assert R.reply_operations(df, "reply", ["id"], most=5).filter("id = 4").count() == 5
    explained = R.reply_explanation(df, "reply", ["id"]).orderBy("id").collect()
    assert explained[3]["summary"] == "no json at all" and explained[1]["summary"] == "No summary available"
