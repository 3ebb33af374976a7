import pytest
from pyspark.sql import functions as F

from tabwright.operators import features as X
from tabwright.operators import metrics as M


def test_unseen_and_missing_categories(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 3.0)], "k string, x double")
    prep = X.fit_features(train, ["k", "x"], limit=1)
    assert prep.feature_names == ["k", "x"]
    new = spark.createDataFrame([("c", 2.0), (None, float("nan")), ("b", None)], "k string, x double")
    assert [tuple(r) for r in prep.transform(new).collect()] == [(-1.0, 2.0), (0.0, 2.0), (1.0, 2.0)]


def test_onehot_on_one_row_keeps_its_category(spark):
    train = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    prep = X.fit_features(train, ["k"])
    one = spark.createDataFrame([("c",)], "k string")
    assert prep.transform(one).first().asDict() == {"k_b": 0.0, "k_c": 1.0}


@pytest.mark.parametrize("n,role", [(50, "low_card"), (51, "high_card")])
def test_cardinality_boundary(spark, n, role):
    df = spark.range(n).select(F.col("id").cast("string").alias("k"), (F.col("id") > 3).alias("b"), F.lit("2024-01-01").cast("timestamp_ntz").alias("t"))
    got = {r["column"]: r["role"] for r in X.roles_table(df).collect()}
    assert got == {"k": role, "b": "numeric", "t": "unsupported"}
    with pytest.raises(ValueError):
        X.fit_features(df, ["t"])


def test_missing_input_column_and_save(spark, tmp_path):
    train = spark.createDataFrame([("a", 1.0, True), ("b", 3.0, False), ("b", 8.0, True)], "k string, x double, b boolean")
    prep = X.fit_features(train, ["k", "x", "b"])
    prep.save(spark, str(tmp_path / "prep"))
    again = X.FeaturePrep.load(spark, str(tmp_path / "prep"))
    new = spark.createDataFrame([(7, "a")], "id long, k string")
    assert again.transform(new).first().asDict() == {"id": 7, "x": 3.0, "b": 1.0, "k_b": 0.0}
    high = X.fit_features(train, ["k"], limit=1)
    high.save(spark, str(tmp_path / "high"))
    assert X.FeaturePrep.load(spark, str(tmp_path / "high")).transform(train).count() == 3


def test_folds_are_balanced_and_stable(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 < 7, "hot").otherwise("cold").alias("y"))
    one = X.stratified_folds(df.coalesce(1), "y", ["id"])
    two = X.stratified_folds(df.repartition(9), "y", ["id"])
    assert sorted(one.collect()) == sorted(two.collect())
    sizes = one.groupBy("y", "fold").count().groupBy("y").agg((F.max("count") - F.min("count")).alias("d"))
    assert all(r["d"] <= 1 for r in sizes.collect())


def test_split_and_exact_sample(spark):
    df = spark.range(5000)
    train, test = X.train_test(df, ["id"])
    assert train.count() + test.count() == 5000 and train.join(test, "id").count() == 0
    assert 0.17 < test.count() / 5000 < 0.23
    sample = X.sample_exact(df.repartition(5), ["id"], 321)
    assert sample.count() == 321 and sorted(sample.collect()) == sorted(X.sample_exact(df.coalesce(1), ["id"], 321).collect())
    assert X.sample_exact(df, ["id"], 9999).count() == 5000


def test_problem_type(spark):
    df = spark.range(1000).select((F.col("id") % 20).alias("few"), (F.col("id") % 21).alias("many"), F.lit("x").alias("t"))
    assert [X.problem_type(df, c) for c in df.columns] == ["classification", "regression", "classification"]
    assert X.problem_type(spark.range(10), "id") == "regression"


def test_labels_round_trip(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "y string")
    labels = X.target_labels(df, "y")
    out = labels.encode(df, "y", "i").withColumn("back", labels.decode(F.col("i")))
    assert all(r["y"] == r["back"] for r in out.collect()) and labels.labels == ("a", "b", "c")


def test_metrics_match_spark_evaluators(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator

    df = spark.range(400).select(
        (F.col("id") % 3 == 0).cast("double").alias("label"),
        (F.col("id") % 4 == 0).cast("double").alias("prediction"),
        (F.col("id") * 7 % 50).cast("double").alias("score"),
    )
    got = M.roc_auc(df, "label", "score", target_rows=5).first()[0]
    want = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(df)
    assert got == pytest.approx(want)
    scores = M.weighted_scores(df, "label", "prediction").first()
    for name, metric in (("f1", "f1"), ("precision", "weightedPrecision"), ("recall", "weightedRecall")):
        assert scores[name] == pytest.approx(MulticlassClassificationEvaluator(metricName=metric).evaluate(df))


def test_metric_edges(spark):
    one_class = spark.createDataFrame([(1.0, 1.0, 0.3)], "y double, p double, s double")
    assert M.roc_auc(one_class, "y", "s").first()[0] is None
    flat = spark.createDataFrame([(2.0, 2.0), (2.0, 3.0)], "y double, p double")
    got = M.regression_scores(flat, "y", "p").first()
    assert got["r2"] is None and got["mae"] == 0.5
    with pytest.raises(ValueError):
        M.compare_models(one_class, [1], "y")


def test_many_labels_are_looked_up(spark):
    df = spark.range(300).select(F.col("id"), F.format_string("l%03d", F.col("id") % 150).alias("y"), F.lit(None).cast("string").alias("z"))
    labels = X.target_labels(df, "y")
    got = labels.encode(df, "y", "label")
    assert got.columns == ["id", "y", "z", "label"] and got.filter(F.col("label") == F.col("id") % 150).count() == 300
    assert labels.encode(df, "z", "label").filter("label is null").count() == 300
    assert got.select(labels.decode(F.col("label")).alias("back"), "y").filter("back = y").count() == 300
