import pytest
from pyspark.sql import functions as F

from tabwright.operators import search as S
from tabwright.operators.models import CLASSIFICATION, REGRESSION, Space, registry, registry_table, validate_request
from tabwright.operators.scoring import Bundle

SMALL = {"n_estimators": Space("int", 2, 3), "max_depth": Space("int", 2, 3), "iterations": Space("int", 2, 3), "depth": Space("int", 2, 3)}


@pytest.fixture(scope="module")
def passengers(spark):
    i = F.col("id")
    return spark.range(240).select(
        i,
        F.when(i % 5 != 0, (i % 60).cast("double")).alias("age"),
        F.when(i % 2 == 0, "male").otherwise("female").alias("sex"),
        F.when(i % 7 != 0, F.element_at(F.array(F.lit("S"), F.lit("C"), F.lit("Q")), (i % 3 + 1).cast("int"))).alias("embarked"),
        (i % 11 > 4).alias("alone"),
        F.when((i % 2 == 1) | (i % 60 < 10), "yes").otherwise("no").alias("survived"),
        ((i % 60) * 2 + i % 2).cast("double").alias("fare"),
    )


def spaces(problem, names):
    return {n: {k: SMALL.get(k, v) for k, v in registry(problem)[n].space.items()} for n in names}


FEATURES = ["age", "sex", "embarked", "alone"]


def test_search_and_bundle(spark, passengers, tmp_path):
    names = ["decision_tree", "naive_bayes", "xgboost"]
    result = S.search(passengers, "survived", ["id"], names, FEATURES, trials=2, folds=2, spaces=spaces(CLASSIFICATION, names))
    board = result.leaderboard(spark).orderBy("position").collect()
    assert result.problem == CLASSIFICATION and [r["position"] for r in board] == [1, 2, 3]
    assert board[0]["algorithm"] == result.best.algorithm and board[0]["accuracy"] > 0.8 and board[0]["auc"] is not None
    assert all(0 <= r["cv_score"] <= 1 and r["error"] is None for r in board)
    path = str(tmp_path / "bundle")
    result.best.bundle.save(spark, path)
    scored = Bundle.load(spark, path).score(passengers.drop("survived").withColumn("age", F.col("age").cast("string")))
    assert scored.columns[:6] == ["id", "age", "sex", "embarked", "alone", "fare"]
    good = scored.join(passengers.select("id", "survived"), "id").filter("prediction = survived").count()
    assert good > 190
    one = scored.filter("id = 3").first()
    assert one["confidence"] == pytest.approx(max(one["prob_class_0"], one["prob_class_1"]))


@pytest.mark.parametrize("name", ["knn", "adaboost", "gradient_boosting"])
def test_three_classes(spark, passengers, tmp_path, name):
    df = passengers.withColumn("y", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 60 / 20).cast("int") + 1))
    data = S.TrainingSet.prepare(df, "y", ["id"], ["fare"], CLASSIFICATION, 2, 42)
    params = S.draw_params(CLASSIFICATION, name, 0, space=spaces(CLASSIFICATION, [name])[name])
    out = S.train_single(data, name, {**params, "n_neighbors": 3} if name == "knn" else params)
    assert out.metrics["accuracy"] > 0.55
    out.bundle.save(spark, str(tmp_path / name))
    again = Bundle.load(spark, str(tmp_path / name)).score(df.drop("y").limit(5))
    assert again.count() == 5 and set(r["prediction"] for r in again.collect()) <= {"a", "b", "c"}


@pytest.mark.parametrize("name", ["ridge", "elastic_net", "svr", "adaboost"])
def test_regression(spark, passengers, tmp_path, name):
    data = S.TrainingSet.prepare(passengers.withColumn("x", F.col("id") % 60), "fare", ["id"], ["x", "sex"], REGRESSION, 2, 42)
    params = S.draw_params(REGRESSION, name, 1, space=spaces(REGRESSION, [name])[name])
    if "alpha" in params:
        params["alpha"] = 0.01
    out = S.train_single(data, name, params)
    assert out.metrics["r2"] > 0.5 and out.metrics["rmse"] >= out.metrics["mae"]
    out.bundle.save(spark, str(tmp_path / name))
    assert Bundle.load(spark, str(tmp_path / name)).score(passengers.withColumn("x", F.col("id") % 60).limit(3)).count() == 3


def test_failures_and_budget_are_listed(spark, passengers):
    bad = {"decision_tree": {"max_depth": Space("int", 99, 99), "min_samples_leaf": Space("int", 1, 1), "criterion": Space("choice", options=("gini",))}}
    result = S.search(passengers, "survived", ["id"], ["decision_tree", "naive_bayes"], FEATURES, trials=1, folds=2, spaces=bad, parallel=1)
    assert [o.error is None for o in result.outcomes] == [False, True] and result.leaderboard(spark).count() == 1
    late = S.search(passengers, "survived", ["id"], ["naive_bayes"], FEATURES, folds=2, budget_minutes=0.001)
    assert "budget" in late.outcomes[0].error and late.best is None


def test_scoring_a_stream(spark, passengers, tmp_path):
    data = S.TrainingSet.prepare(passengers, "survived", ["id"], FEATURES, CLASSIFICATION, 2, 42)
    bundle = S.train_single(data, "decision_tree", {"max_depth": 3, "min_samples_leaf": 1, "criterion": "gini"}).bundle
    source = str(tmp_path / "in")
    passengers.drop("survived").write.parquet(source)
    stream = spark.readStream.schema(passengers.drop("survived").schema).parquet(source)
    q = bundle.score(stream).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("scored").count() == 240


def test_registry_and_validation(spark, passengers):
    assert registry_table(spark, CLASSIFICATION).count() == 11 and registry_table(spark, REGRESSION).count() == 12
    for args in (("gone", CLASSIFICATION, ["knn"], 5), ("survived", CLASSIFICATION, ["ridge"], 5), ("survived", CLASSIFICATION, ["knn"], 61)):
        with pytest.raises(ValueError):
            validate_request(passengers, *args)
    assert S.draw_params(CLASSIFICATION, "knn", 3) == S.draw_params(CLASSIFICATION, "knn", 3)


@pytest.mark.parametrize("problem,name", [(CLASSIFICATION, "logistic_regression"), (REGRESSION, "ridge")])
def test_scoring_after_observed_metrics(spark, passengers, problem, name):
    """A session that has observed metrics cannot serialize training summaries."""
    from pyspark.sql import Observation

    seen = Observation()
    passengers.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 240
    target = "survived" if problem == CLASSIFICATION else "fare"
    data = S.TrainingSet.prepare(passengers, target, ["id"], ["sex", "alone"], problem, 2, 42)
    params = S.draw_params(problem, name, 0, space=spaces(problem, [name])[name])
    assert S.train_single(data, name, params).bundle.score(passengers).count() == 240


def test_a_fit_longer_than_the_budget_is_cancelled(spark, passengers, monkeypatch):
    import time

    real, seen = S.cv_score, []

    def slow(data, folds, name, params):
        seen.append(name)
        # a job of minutes, in many short tasks
        wait = F.udf(lambda i: time.sleep(0.5) or i, "long")
        spark.range(0, 2000, 1, 2000).select(wait("id").alias("i")).agg(F.sum("i")).collect()
        return real(data, folds, name, params)

    monkeypatch.setattr(S, "cv_score", slow)
    data = S.TrainingSet.prepare(passengers, "survived", ["id"], FEATURES, CLASSIFICATION, 2, 42)
    begin = time.time()
    out = S._search_one(data, [], "decision_tree", 3, 3.0, 1, None, True, 0.0)
    assert time.time() - begin < 30
    assert out.stopped == 1 and out.trials == 1 and "stopped after" in out.error and seen == ["decision_tree"]
    # the session goes on
    assert spark.range(10).count() == 10


def test_errors_inside_the_limit_stay_themselves(spark):
    with pytest.raises(ZeroDivisionError), S.time_limit(spark.sparkContext, 100):
        1 / 0  # noqa: B018


def test_guided_search_is_seeded_and_no_worse_than_random():
    space = {"rate": Space("log", 1e-4, 1.0), "depth": Space("int", 2, 20), "kind": Space("choice", options=("a", "b", "c")), "share": Space("float", 0, 1)}

    def score(p):
        import math

        return -abs(math.log10(p["rate"]) + 2) - abs(p["depth"] - 15) / 6 - 2 * (p["kind"] != "b") - 2 * abs(p["share"] - 0.3)

    def best(guided, seed, n=30):
        seen = []
        for t in range(n):
            import random

            p = S.guided_params(space, seen, f"{seed}-{t}") if guided else {k: s.draw(random.Random(f"{seed}-{t}-{k}")) for k, s in space.items()}
            assert 1e-4 <= p["rate"] <= 1 and 2 <= p["depth"] <= 20 and isinstance(p["depth"], int) and 0 <= p["share"] <= 1
            seen.append((p, score(p)))
        return max(s for _, s in seen)

    assert best(True, 3) == best(True, 3)
    guided, blind = [best(True, s) for s in range(25)], [best(False, s) for s in range(25)]
    assert sum(guided) / 25 > sum(blind) / 25 + 0.2
    assert sum(g >= b for g, b in zip(guided, blind, strict=True)) >= 18


def test_rings_need_the_kernel(spark, tmp_path):
    import math

    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector

    from tabwright.operators.kernel import KernelSvm, KernelSvmModel
    from tabwright.operators.models import Shape, without_summary

    a = F.col("id") * (2 * math.pi / 97)
    r = F.when(F.col("id") % 2 == 0, 1.0).otherwise(2.5) + F.col("id") % 7 / 20
    df = spark.range(700).select("id", array_to_vector(F.array(r * F.cos(a), r * F.sin(a))).alias("features"), (F.col("id") % 2).cast("double").alias("label"))

    def share(model):
        return model.transform(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]

    model = KernelSvm(1.0, Shape(700, 2)).fit(df)
    assert share(model) >= 0.95 and share(without_summary(LinearSVC().fit(df))) < 0.6
    model.save(str(tmp_path / "k"))
    assert share(KernelSvmModel.load(spark, str(tmp_path / "k"))) == share(model)


def test_an_estimator_gets_its_rows_in_parts(spark, monkeypatch):
    """Few bytes in a file are many rows: parts follow the rows."""
    from tabwright import session
    from tabwright.operators import search as S
    from tabwright.operators.models import registry

    df = cut_lineage_of_one_file(spark)
    assert df.rdd.getNumPartitions() == 1
    parts = session.by_rows(df, 5000, 1000)
    assert parts.rdd.getNumPartitions() == 5 and sorted(r[0] for r in parts.collect()) == list(range(5000))
    assert session.by_rows(df, 900, 1000) is df
    monkeypatch.setattr(session.by_rows, "__defaults__", (1000,))
    got = []

    class Seen:
        def fit(self, rows):
            got.append(rows.rdd.getNumPartitions())
            return self

    spec = registry("classification")["decision_tree"]
    S._fit(type(spec)("x", "x", "x", {}, lambda p, s: Seen()), {}, S.Shape(5000, 2), df)
    assert got == [5]


def cut_lineage_of_one_file(spark):
    from tabwright.session import cut_lineage

    return cut_lineage(spark.range(0, 5000, 1, 1))


def test_kernel_fit_keeps_no_mapped_rows(spark, monkeypatch):
    """Mapped rows are a hundred times as wide as the data: every step maps them anew and gets sums of tasks."""
    import math

    import numpy as np
    import pytest
    from pyspark.ml import classification as MC
    from pyspark.ml.functions import array_to_vector

    from tabwright.operators import kernel as K
    from tabwright.operators.models import Shape

    a, r = F.col("id") * (2 * math.pi / 97), 1.0 + F.col("id") % 3 + F.col("id") % 7 / 20
    rows = spark.range(0, 900, 1, 5).select(array_to_vector(F.array(r * F.cos(a), r * F.sin(a))).alias("features"), (F.col("id") % 3).cast("double").alias("label"))
    rows = rows.unionByName(rows.limit(100))  # some rows twice
    local = rows.collect()
    x, y = np.array([r.features.toArray() for r in local]), np.array([r.label for r in local])
    w, b = K.spectrum(2, 0.7, K.FEATURES, 42)
    z = K.fourier(x, w, b)
    assert np.allclose(z, math.sqrt(2 / K.FEATURES) * np.cos(x @ w + b), atol=1e-6)

    def loss(plane, shift, side):
        return np.maximum(0, 1 - side * (z @ plane + shift)).mean() + plane @ plane / 2000

    frame = spark.createDataFrame([(v.tolist(), float(k == 1)) for v, k in zip(z, y, strict=True)], "z array<double>, label double")
    svc = MC.LinearSVC(regParam=1 / 1000, maxIter=25, standardization=False).fit(frame.select(array_to_vector("z").alias("features"), "label"))
    fitted = []
    for kind in (MC.LinearSVC, MC.OneVsRest):
        monkeypatch.setattr(kind, "fit", lambda self, df, *more: fitted.append(df.columns))
    model = K.KernelSvm(1.0, Shape(1000, 3), gamma=0.7, iterations=25).fit(rows)
    assert not fitted and model.coefficients.shape == (3, K.FEATURES)
    side = np.where(y == 1, 1.0, -1.0)
    assert loss(model.coefficients[1], model.intercepts[1], side) <= 1.05 * loss(svc.coefficients.toArray(), svc.intercept, side)
    got = [r.prediction for r in model.transform(rows).collect()]
    assert got == (z @ model.coefficients.T + model.intercepts).argmax(1).tolist() and np.mean(np.array(got) == y) > 0.9
    with pytest.raises(ValueError, match="finite"):
        K.KernelSvm(1.0, Shape(1000, 2), gamma=0.7).fit(rows)
