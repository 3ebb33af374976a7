"""Histogram boosting against a plain implementation, and trees as expressions."""

import duckdb
import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabwright.operators import boosting as B
from tabwright.operators import tree_columns as T


def frame(spark, x, y, parts=3):
    rows = [(i, [float(v) for v in r], float(label)) for i, (r, label) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id long, a array<double>, label double").repartition(parts)
    return df.select("id", array_to_vector("a").alias("features"), "label")


def data(seed, n=400, width=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)), 1)
    x[:, 1] = rng.integers(0, 5, n)
    return x, rng


def plain_tree(x, g, h, borders, leaves, depth, l2, least):
    """One tree, leaf by leaf, the best first; returns the leaf value of each row."""
    def best(rows, level):
        out = (-np.inf, None, None)
        if level >= depth:
            return out
        score = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)
        for f, cuts in enumerate(borders):
            for c in cuts:
                left, right = rows[x[rows, f] < c], rows[x[rows, f] >= c]
                if min(len(left), len(right)) < least:
                    continue
                gain = score(left) + score(right) - score(rows)
                if gain > out[0] + 1e-9 and gain > 1e-9:
                    out = (gain, f, c)
        return out

    every = np.arange(len(x))
    open_ = [(every, 0, best(every, 0))]
    while len(open_) < leaves:
        at = max(range(len(open_)), key=lambda i: open_[i][2][0])
        rows, level, (gain, f, c) = open_[at]
        if f is None:
            break
        del open_[at]
        for part in (rows[x[rows, f] < c], rows[x[rows, f] >= c]):
            open_.append((part, level + 1, best(part, level + 1)))
    out = np.zeros(len(x))
    for rows, _, _ in open_:
        out[rows] = -g[rows].sum() / (h[rows].sum() + l2)
    return out


@pytest.mark.parametrize("leaves,depth", [(6, 5), (None, 3)])
def test_equals_a_plain_booster(spark, leaves, depth):
    x, rng = data(1)
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=len(x)) > 1).astype(float)
    booster = B.Booster(trees=10, rate=0.3, max_depth=depth, max_leaves=leaves, l2=1.0, least_rows=5, least_curvature=0.0, classes=2, bins=200)
    model = booster.fit(frame(spark, x, y))
    borders = [sorted(set(x[:, f]))[1:] for f in range(x.shape[1])]
    share = y.mean()
    m = np.full(len(x), np.log(share / (1 - share)))
    for _ in range(10):
        p = 1 / (1 + np.exp(-m))
        m += 0.3 * plain_tree(x, p - y, p * (1 - p), borders, leaves or 1 << depth, depth, 1.0, 5)
    rows = model.transform(frame(spark, x, y)).orderBy("id").collect()
    assert np.allclose([r["rawPrediction"][1] for r in rows], m, atol=1e-4)
    assert [r["prediction"] for r in rows] == (m > 0).astype(float).tolist()
    if leaves:
        assert all(t.leaves() <= leaves for t in model.forests[0])
    assert sum(model.featureImportances.toArray()) == pytest.approx(1.0)
    # the model does not depend on how rows lie
    again = booster.fit(frame(spark, x, y, 7))
    assert [t.record() for t in again.forests[0]] == [t.record() for t in model.forests[0]]


def test_squared_error_and_many_classes(spark):
    x, rng = data(2, 500)
    y = np.where(x[:, 0] > 0.5, 7.0, 1.0) + np.where(x[:, 1] >= 3, 2.0, 0.0)
    model = B.Booster(trees=25, rate=0.5, max_depth=3, l2=0.0).fit(frame(spark, x, y))
    got = [r["prediction"] for r in model.transform(frame(spark, x, y)).orderBy("id").collect()]
    assert np.abs(np.array(got) - y).max() < 1e-3
    kind = np.where(x[:, 0] > 0.5, 2.0, np.where(x[:, 1] >= 3, 1.0, 0.0))
    model = B.Booster(trees=8, rate=0.5, max_depth=3, classes=3).fit(frame(spark, x, kind))
    rows = model.transform(frame(spark, x, kind)).orderBy("id").collect()
    assert [r["prediction"] for r in rows] == kind.tolist()
    assert all(sum(r["probability"]) == pytest.approx(1.0) for r in rows)


def test_symmetric_trees_share_a_split_in_each_generation(spark):
    x, rng = data(3)
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.2)).astype(float)
    model = B.Booster(trees=12, rate=0.5, max_depth=3, l2=3.0, symmetric=True, classes=2, noise=0.1).fit(frame(spark, x, y))
    for tree in model.forests[0]:
        level = [tree]
        while level and level[0].feature >= 0:
            assert len({(t.feature, t.threshold) for t in level}) == 1
            level = [side for t in level for side in (t.left, t.right)]
    got = [r["prediction"] for r in model.transform(frame(spark, x, y)).orderBy("id").collect()]
    assert np.mean(np.array(got) == y) > 0.97


def test_shares_of_rows_and_columns(spark):
    x, rng = data(4)
    y = (x[:, 0] > 0).astype(float)
    model = B.Booster(trees=8, rate=0.3, max_depth=2, classes=2, row_share=0.6, feature_share=0.5, seed=3).fit(frame(spark, x, y))
    used = [sorted({s.feature for s in t.splits()}) for t in model.forests[0]]
    assert all(len(u) <= 2 for u in used) and len({tuple(u) for u in used}) > 1
    assert 0 in {f for u in used for f in u}


def test_categories_never_see_their_own_label(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 300, 900), rng.normal(size=900)])
    y = rng.integers(0, 2, 900).astype(float)  # nothing can be learned
    source = spark.createDataFrame([([float(v) for v in r], float(t), i * 7919 % 900) for i, (r, t) in enumerate(zip(x, y, strict=True))], "x array<double>, label double, row long")
    out, means = B.ordered_statistics(source, 0)
    got = {r["row"]: r["x"] for r in out.collect()}
    seen, prior = {}, y.mean()
    for i in sorted(range(900), key=lambda i: i * 7919 % 900):
        total, n = seen.get(x[i, 0], (0.0, 0))
        assert got[i * 7919 % 900] == [pytest.approx((total + prior) / (n + 1)), x[i, 1]]
        seen[x[i, 0]] = (total + y[i], n + 1)
    for r in means.table.collect():
        total, n = seen[r["category"]]
        assert r["mean"] == pytest.approx((total + prior) / (n + 1))


def test_saved_models_missing_values_and_unknown_categories(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.integers(0, 40, 600), np.round(rng.normal(size=600), 2)]).astype(float)
    x[::17, 1] = np.nan
    y = ((x[:, 0] % 2 == 0) | np.isnan(x[:, 1])).astype(float)
    model = B.Booster(trees=10, rate=0.5, max_depth=3, classes=2, categories=(0,)).fit(frame(spark, x, y))
    test = frame(spark, np.vstack([x, [[999.0, 0.1]]]), [*y, 0])
    got = [r["prediction"] for r in model.transform(test).orderBy("id").collect()]
    assert np.mean(np.array(got[:-1]) == y) > 0.97
    model.save(f"{tmp_path}/m")
    again = B.BoostedModel.load(spark, f"{tmp_path}/m")
    assert [r["prediction"] for r in again.transform(test).orderBy("id").collect()] == got


def test_constant_features_and_labels(spark):
    model = B.Booster(trees=3, classes=2).fit(frame(spark, [[1.0], [1.0], [1.0]], [0, 1, 1]))
    assert {r["prediction"] for r in model.transform(frame(spark, [[1.0], [5.0]], [0, 0])).collect()} == {1.0}
    model = B.Booster(trees=3).fit(frame(spark, [[1.0], [2.0]], [4, 4]))
    assert {r["prediction"] for r in model.transform(frame(spark, [[1.0]], [0])).collect()} == {4.0}
    with pytest.raises(ValueError):
        B.Booster().fit(frame(spark, [[1.0]], [1]).filter("false"))


def test_one_pass_for_each_generation(spark):
    """Leaf by leaf growth needs no more passes than generations."""
    x, rng = data(7, 600)
    y = rng.integers(0, 2, len(x)).astype(float)
    passes = []
    count = B.histograms

    def counted(*args):
        passes.append(len(args[1]))
        return count(*args)

    B.histograms = counted
    try:
        model = B.Booster(trees=1, max_depth=6, max_leaves=12, least_rows=5, classes=2).fit(frame(spark, x, y))
    finally:
        B.histograms = count
    assert model.forests[0][0].leaves() == 12
    assert len(passes) <= 7


def test_trees_as_text_score_like_spark(spark):
    x, rng = data(8)
    y = (x[:, 0] + x[:, 1] > 2).astype(float)
    df = frame(spark, x, y)
    fitted = [DecisionTreeClassifier(maxDepth=d, seed=d).fit(df) for d in (1, 2, 4)]
    trees = [T.read_spark_tree(m) for m in fitted]
    columns = df.select("id", *[F.get(F.expr("cast(null as array<double>)"), F.lit(0)).alias("_")]).drop("_")
    assert columns.count() == len(x)
    con = duckdb.connect()
    values = ", ".join(f"({i}, [{', '.join(f'{float(v)!r}::double' for v in r)}])" for i, r in enumerate(x))
    con.execute(f"create table t as select * from (values {values}) as v(id, f)")
    for model, tree in zip(fitted, trees, strict=True):
        spark_side = [r["prediction"] for r in model.transform(df).orderBy("id").collect()]
        text = T.tree_sql(tree, lambda i: f"f[{i + 1}]", T.OTHER)
        assert [r[0] for r in con.execute(f"select {text} from t order by id").fetchall()] == spark_side
    weights = [0.5, 1.5, 0.25]
    text = T.weighted_vote_sql(trees, weights, 2, lambda i: f"f[{i + 1}]", T.OTHER)
    votes = np.zeros((len(x), 2))
    for model, w in zip(fitted, weights, strict=True):
        for i, r in enumerate(model.transform(df).orderBy("id").collect()):
            votes[i, int(r["prediction"])] += w
    assert [r[0] for r in con.execute(f"select {text} from t order by id").fetchall()] == votes.argmax(1).tolist()


def test_adaboost_takes_one_pass_for_a_stump(spark, monkeypatch):
    """Stumps equal those of plain loops, and equal rows on bins are read as one."""
    import math

    from tabwright.operators import boosting, ensembles
    from tabwright.operators.models import Shape

    raw = [(i % 13, i * 7 % 11, (i % 13 > 6) + (i * 7 % 11 > 4 and i % 13 > 2)) for i in range(700)]
    df = spark.createDataFrame([([float(a), float(b)], float(k)) for a, b, k in raw], "x array<double>, label double").repartition(3)
    df = df.select(array_to_vector("x").alias("features"), "label")
    written = []
    monkeypatch.setattr(boosting, "cut_lineage", lambda t, cut=boosting.cut_lineage: written.append(out := cut(t)) or out)
    model = ensembles.AdaBoost(12, 0.7, True, Shape(700, 3)).fit(df)
    cells = len({(a, b, k) for a, b, k in raw})
    assert [t.count() for t in written] == [700, cells] and len(model.trees) == 12
    weights, alphas = [1.0] * 700, []
    for tree in model.trees:
        best, found = None, None
        for feature in (0, 1):
            for cut in sorted({r[feature] for r in raw})[1:]:
                sides = [[0.0] * 3, [0.0] * 3]
                for r, w in zip(raw, weights, strict=True):
                    sides[r[feature] >= cut][r[2]] += w
                pure = sum(sum(v * v for v in s) / sum(s) for s in sides)
                if best is None or pure > best + 1e-9:
                    best, found = pure, (feature, cut, [s.index(max(s)) for s in sides])
        feature, cut, chosen = found
        if chosen[0] == chosen[1]:
            assert tree.feature < 0 and tree.value == chosen[0]
        else:
            assert (tree.feature, tree.threshold, tree.left.value, tree.right.value) == (feature, cut, *chosen)
        wrong = [chosen[r[feature] >= cut] != r[2] for r in raw]
        error = sum(w for w, bad in zip(weights, wrong, strict=True) if bad) / sum(weights)
        alphas.append(0.7 * (math.log((1 - error) / error) + math.log(2)))
        weights = [w * math.exp(alphas[-1]) if bad else w for w, bad in zip(weights, wrong, strict=True)]
    assert np.allclose(model.alphas, alphas)


def test_stump_places_share_the_weight():
    from tabwright.operators.ensembles import split_places

    assert split_places(np.array([3.0, 0.0, 1.0, 2.0, 0.0])) == [0, 2]
    assert split_places(np.ones(8), 3) == [1, 3, 5]
