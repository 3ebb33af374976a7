"""Training and scoring queries. Models that SQL can restate are checked; the others only run."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import models as M
from tabwright.operators import search as S
from tabwright.operators.features import fit_features
from tabwright.operators.models import CLASSIFICATION, REGRESSION
from tabwright.plans.base import SCORED, query, table, view


@query(
    "ridge_score",
    """select l_quantity, round(regr_intercept + regr_slope * l_quantity, 1) as prediction from
         (select distinct l_quantity from lineitem), (select regr_intercept(l_extendedprice, l_quantity) as regr_intercept,
          regr_slope(l_extendedprice, l_quantity) as regr_slope from lineitem)""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    key = ["l_orderkey", "l_linenumber", "l_partkey"]
    data = S.TrainingSet.prepare(df, "l_extendedprice", key, ["l_quantity"], REGRESSION, 0, 42)
    bundle = S.train_single(data, "ridge", {"alpha": 1e-4}).bundle
    scored = bundle.score(df.select("l_quantity").distinct())
    return scored.select("l_quantity", F.round("prediction", 1).alias("prediction"))


@query(
    "naive_bayes_score",
    """with s as (select y, avg(score) as m, var_pop(score) as v, ln(count(*)) as p from scored group by y)
       select event_id, cast((select y from s order by p - 0.5 * ln(2 * pi() * v) - (score - m) ** 2 / (2 * v) desc, y limit 1) as integer) as prediction
       from scored""",
    scored=SCORED,
)
def _(spark, sf):
    df = view(spark, sf, SCORED).select("event_id", "y", "score")
    data = S.TrainingSet.prepare(df, "y", ["event_id"], ["score"], CLASSIFICATION, 0, 42)
    bundle = S.train_single(data, "naive_bayes", {}).bundle
    return bundle.score(df.select("event_id", "score")).select("event_id", "prediction")


_LINES = """select l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax,
         case when l_quantity > 30 and l_discount >= 0.05 then 1 else 0 end as dear, case when l_quantity > 25 then 1 else 0 end as many,
         3 * l_quantity + 200 * l_discount - 100 * l_tax + 5.25 as charge,
         case when l_quantity <= 10 then 5.0 when l_quantity <= 33 then 20.0 else 50.0 end + case when l_tax >= 0.04 then 7.0 else 0.0 end as fee
       from lineitem"""
_LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey"]


@query("xgboost_score", "select distinct l_quantity, l_discount, l_tax, dear as prediction from lines", lines=_LINES)
def _(spark, sf):
    df = view(spark, sf, _LINES)
    inputs = ["l_quantity", "l_discount", "l_tax"]
    data = S.TrainingSet.prepare(df, "dear", _LINE_KEY, inputs, CLASSIFICATION, 0, 42)
    params = {"n_estimators": 10, "learning_rate": 0.3, "max_depth": 3, "subsample": 0.8, "colsample_bytree": 1.0}
    return S.fit_bundle(data, "xgboost", params).score(df.select(*inputs).distinct()).select(*inputs, "prediction")


@query("lightgbm_score", "select distinct l_quantity, l_tax, round(fee, 0)::double as prediction from lines", lines=_LINES)
def _(spark, sf):
    df = view(spark, sf, _LINES).withColumn("fee", F.col("fee").cast("double"))
    data = S.TrainingSet.prepare(df, "fee", _LINE_KEY, ["l_quantity", "l_tax"], REGRESSION, 0, 42)
    params = {"n_estimators": 14, "learning_rate": 0.5, "max_depth": 4, "num_leaves": 6}
    scored = S.fit_bundle(data, "lightgbm", params).score(df.select("l_quantity", "l_tax").distinct())
    return scored.select("l_quantity", "l_tax", F.round("prediction", 0).alias("prediction"))


_RULE = "select distinct l_quantity, l_discount, l_tax, dear as prediction from lines"
_INPUTS = ["l_quantity", "l_discount", "l_tax"]


def _learned(spark, sf, target, model, params, problem=CLASSIFICATION, digits=None):
    """A model fitted on a label that is a rule of its inputs, scored on all inputs that occur."""
    df = view(spark, sf, _LINES)
    if problem == REGRESSION:
        df = df.withColumn(target, F.col(target).cast("double"))
    bundle = S.fit_bundle(S.TrainingSet.prepare(df, target, _LINE_KEY, _INPUTS, problem, 0, 42), model, params)
    scored = bundle.score(df.select(*_INPUTS).distinct())
    value = F.col("prediction") if digits is None else F.round("prediction", digits)
    return scored.select(*_INPUTS, value.alias("prediction"))


@query("decision_tree_score", _RULE, lines=_LINES)
def _(spark, sf):
    return _learned(spark, sf, "dear", "decision_tree", {"max_depth": 4, "min_samples_leaf": 1, "criterion": "gini"})


@query("gradient_boosting_score", _RULE, lines=_LINES)
def _(spark, sf):
    return _learned(spark, sf, "dear", "gradient_boosting", {"n_estimators": 5, "learning_rate": 0.3, "max_depth": 3})


@query("adaboost_score", _RULE, lines=_LINES)
def _(spark, sf):
    return _learned(spark, sf, "dear", "adaboost", {"n_estimators": 12, "learning_rate": 1.0})


@query("random_forest_score", _RULE.replace("dear", "many"), lines=_LINES)
def _(spark, sf):
    return _learned(spark, sf, "many", "random_forest", {"n_estimators": 15, "max_depth": 6, "min_samples_leaf": 1})


@query("logistic_score", _RULE.replace("dear", "many"), lines=_LINES)
def _(spark, sf):
    return _learned(spark, sf, "many", "logistic_regression", {"C": 10.0})


_RINGS = """select *, case when x * x + y * y > 0.9 then 1 else 0 end as outer_ring from (
         select l_orderkey, l_linenumber, l_partkey, (l_quantity - 25.5) / 24.5 as x, (l_tax - 0.04) / 0.04 as y from lineitem)
       where x * x + y * y < 0.3 or x * x + y * y > 0.9"""


@query("svm_score", "select distinct x, y, outer_ring as prediction from rings", rings=_RINGS)
def _(spark, sf):
    """Two rings, which no straight line parts."""
    df = view(spark, sf, _RINGS)
    data = S.TrainingSet.prepare(df, "outer_ring", _LINE_KEY, ["x", "y"], CLASSIFICATION, 0, 42)
    return S.fit_bundle(data, "svm", {"C": 10.0}).score(df.select("x", "y").distinct()).select("x", "y", "prediction")


@query("lasso_score", _RULE.replace("dear", "round(charge, 0)"), lines=_LINES)
def _(spark, sf):
    return _learned(spark, sf, "charge", "lasso", {"alpha": 1e-4}, REGRESSION, 0)


@query("elastic_net_score", _RULE.replace("dear", "round(charge, 0)"), lines=_LINES)
def _(spark, sf):
    return _learned(spark, sf, "charge", "elastic_net", {"alpha": 1e-4, "l1_ratio": 0.5}, REGRESSION, 0)


@query("svr_score", _RULE.replace("dear", "round(charge, 0)"), lines=_LINES)
def _(spark, sf):
    return _learned(spark, sf, "charge", "svr", {"C": 10.0, "epsilon": 0.1}, REGRESSION, 0)


@query("confidence_by_rule", "select distinct l_quantity, l_discount, l_tax, dear as prediction, 1.0::double as confidence from lines", lines=_LINES)
def _(spark, sf):
    """A tree that separates the classes is sure of each."""
    df = view(spark, sf, _LINES)
    data = S.TrainingSet.prepare(df, "dear", _LINE_KEY, _INPUTS, CLASSIFICATION, 0, 42)
    bundle = S.fit_bundle(data, "decision_tree", {"max_depth": 4, "min_samples_leaf": 1, "criterion": "entropy"})
    return bundle.score(df.select(*_INPUTS).distinct()).select(*_INPUTS, "prediction", "confidence")


@query(
    "search_by_rule",
    """select cast(i + 1 as integer) as position, ['decision_tree', 'lightgbm'][i + 1] as algorithm, 1.0::double as accuracy, 1.0::double as f1, 1.0::double as cv_score, 2 as trials
       from range(2) t(i) where (select count(distinct dear) from lines) = 2""",
    lines=_LINES,
)
def _(spark, sf):
    df = view(spark, sf, _LINES).select(*_LINE_KEY, *_INPUTS, "dear")
    tree = {"max_depth": M.Space("int", 4, 6), "min_samples_leaf": M.Space("int", 1, 1), "criterion": M.Space("choice", options=("gini", "entropy"))}
    fixed = {"n_estimators": 6, "learning_rate": 0.4, "max_depth": 3, "num_leaves": 6}
    spaces = {"decision_tree": tree, "lightgbm": {k: M.Space("choice", options=(v,)) for k, v in fixed.items()}}
    result = S.search(df, "dear", _LINE_KEY, ["decision_tree", "lightgbm"], _INPUTS, CLASSIFICATION, trials=2, folds=2, budget_minutes=20, spaces=spaces)
    return result.leaderboard(spark).select("position", "algorithm", "accuracy", "f1", "cv_score", "trials")


@query("catboost_score", "select o_orderkey, case when o_custkey % 3 = 0 then 1 else 0 end as prediction from orders")
def _(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey", F.format_string("customer %d", "o_custkey").alias("customer"), "o_totalprice", (F.col("o_custkey") % 3 == 0).cast("int").alias("third")
    )
    data = S.TrainingSet.prepare(df, "third", ["o_orderkey"], ["customer", "o_totalprice"], CLASSIFICATION, 0, 42)
    params = {"iterations": 8, "learning_rate": 0.5, "depth": 3, "l2_leaf_reg": 3.0, "random_strength": 0.5}
    return S.fit_bundle(data, "catboost", params).score(df.drop("third")).select("o_orderkey", "prediction")


def _documents(spark, sf):
    labels = table(spark, sf, "labels")
    return table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source").join(labels, "doc_id")


@query("batch_score")
def _(spark, sf):
    train = _documents(spark, sf).drop("toxic")
    data = S.TrainingSet.prepare(train, "quality", ["doc_id"], None, CLASSIFICATION, 0, 42)
    outcome = S.train_single(data, "decision_tree", {"max_depth": 4, "min_samples_leaf": 5, "criterion": "gini"})
    return outcome.bundle.score(table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source"))


@query("score_confidence")
def _(spark, sf):
    train = _documents(spark, sf).drop("quality")
    data = S.TrainingSet.prepare(train, "toxic", ["doc_id"], None, CLASSIFICATION, 0, 42)
    bundle = S.train_single(data, "logistic_regression", {"C": 1.0}).bundle
    scored = bundle.score(table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source"))
    return scored.select("doc_id", "prediction", "confidence")


@query("model_search")
def _(spark, sf):
    train = _documents(spark, sf).drop("toxic")
    result = S.search(train, "quality", ["doc_id"], ["decision_tree", "naive_bayes"], trials=2, folds=3, budget_minutes=10)
    return result.leaderboard(spark).select("position", "algorithm", "accuracy", "f1", "cv_score", "trials")


@query(
    "feature_matrix",
    """select event_id, coalesce(value, (select median(value) from d)) as value,
         cast(coalesce(event_type, m) = 'error' as double) as "event_type_error", cast(coalesce(event_type, m) = 'purchase' as double) as "event_type_purchase",
         cast(coalesce(event_type, m) = 'signup' as double) as "event_type_signup", cast(coalesce(event_type, m) = 'view' as double) as "event_type_view"
       from d, (select event_type as m from d where event_type is not null group by event_type order by count(*) desc, event_type limit 1)""",
    d="""select event_id, case when event_id % 11 = 0 then null else event_type end as event_type,
         case when event_id % 7 = 0 then null else value end as value from events""",
)
def _(spark, sf):
    df = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
    )
    return fit_features(df, ["value", "event_type"]).transform(df)
