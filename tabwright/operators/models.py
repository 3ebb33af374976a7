"""Model registry: search spaces and the Spark estimators they build."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark import SparkContext
from pyspark.ml import classification as MC
from pyspark.ml import regression as MR
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.operators.boosting import Booster
from tabwright.operators.kernel import KernelSvm

CLASSIFICATION, REGRESSION = "classification", "regression"
MAX_BUDGET_MINUTES = 60
#: Splits between up to so many values of a feature are exact in Spark's trees.
TREE_BINS = 128


@dataclass(frozen=True)
class Space:
    kind: str
    low: float = 0
    high: float = 0
    options: tuple = ()

    def draw(self, rng: random.Random) -> Any:
        if self.kind == "choice":
            return rng.choice(self.options)
        if self.kind == "int":
            return rng.randint(int(self.low), int(self.high))
        if self.kind == "log":
            return math.exp(rng.uniform(math.log(self.low), math.log(self.high)))
        return rng.uniform(self.low, self.high)

    def at(self, share: float) -> Any:
        """The value at a place between 0 and 1."""
        if self.kind == "log":
            return math.exp(math.log(self.low) + share * (math.log(self.high) - math.log(self.low)))
        value = self.low + share * (self.high - self.low)
        return int(round(value)) if self.kind == "int" else value


def _int(low, high):
    return Space("int", low, high)


def _log(low, high):
    return Space("log", low, high)


def _float(low, high):
    return Space("float", low, high)


def _choice(*options):
    return Space("choice", options=options)


@dataclass(frozen=True)
class Shape:
    """What an estimator may depend on: row and class counts of the training data."""

    rows: int
    classes: int = 0
    seed: int = 42
    #: places of features that are numbers of categories
    categories: tuple[int, ...] = ()


@dataclass(frozen=True)
class ModelSpec:
    name: str
    display: str
    category: str
    space: dict[str, Space]
    build: Callable[[dict, Shape], Any]
    defaults: dict[str, Any] = field(default_factory=dict)


def _tree_args(p: dict, shape: Shape) -> dict:
    out = {"maxDepth": p["max_depth"], "maxBins": TREE_BINS, "seed": shape.seed}
    if "min_samples_leaf" in p:
        out["minInstancesPerNode"] = p["min_samples_leaf"]
    return out


def _boosted(p: dict, shape: Shape, classify: bool):
    args = {"maxIter": p["n_estimators"], "stepSize": p["learning_rate"], "maxDepth": p["max_depth"], "maxBins": TREE_BINS, "seed": shape.seed}
    if not classify:
        return MR.GBTRegressor(**args)
    one = MC.GBTClassifier(**args)
    return one if shape.classes <= 2 else MC.OneVsRest(classifier=one)


def _shared(p: dict, shape: Shape, classify: bool) -> dict:
    return {
        "trees": p.get("n_estimators") or p.get("iterations"), "rate": p["learning_rate"], "row_share": p.get("subsample", 1.0),
        "feature_share": p.get("colsample_bytree", 1.0), "classes": max(shape.classes, 2) if classify else 0, "seed": shape.seed,
    }


def _xgboost(p: dict, shape: Shape, classify: bool) -> Booster:
    """All leaves of a depth, Newton leaves drawn to zero by an l2 of 1, shares of rows and columns."""
    return Booster(**_shared(p, shape, classify), max_depth=p["max_depth"], l2=1.0, least_curvature=1.0)


def _lightgbm(p: dict, shape: Shape, classify: bool) -> Booster:
    """The best leaf first, up to a number of leaves."""
    return Booster(**_shared(p, shape, classify), max_depth=p["max_depth"], max_leaves=p["num_leaves"], l2=0.0, least_rows=20)


def _catboost(p: dict, shape: Shape, classify: bool) -> Booster:
    """Symmetric trees, l2 in the leaves, shaken scores, and category numbers as ordered means of the label."""
    return Booster(
        **_shared(p, shape, classify), max_depth=p["depth"], l2=p["l2_leaf_reg"], symmetric=True, noise=p.get("random_strength", 0.0),
        categories=shape.categories,
    )


def _svm(p: dict, shape: Shape) -> KernelSvm:
    return KernelSvm(p["C"], shape)


_BOOST_SPACE = {"n_estimators": _int(50, 200), "learning_rate": _log(0.01, 0.3), "max_depth": _int(3, 10)}
_XGB_SPACE = {
    "n_estimators": _int(50, 300), "learning_rate": _log(0.01, 0.3), "max_depth": _int(3, 12),
    "subsample": _float(0.6, 1.0), "colsample_bytree": _float(0.6, 1.0),
}
_LGB_SPACE = {**{k: _XGB_SPACE[k] for k in ("n_estimators", "learning_rate", "max_depth")}, "num_leaves": _int(20, 150)}
_LGB_CLASS_SPACE = {**_XGB_SPACE, "num_leaves": _int(20, 150)}
_CAT_SPACE = {"iterations": _int(100, 500), "learning_rate": _log(0.01, 0.3), "depth": _int(4, 10), "l2_leaf_reg": _float(1, 10)}
_CAT_CLASS_SPACE = {**_CAT_SPACE, "random_strength": _float(0.5, 2.0)}
_FOREST_SPACE = {"n_estimators": _int(50, 300), "max_depth": _int(3, 20), "min_samples_leaf": _int(1, 10)}
_TREE_SPACE = {"max_depth": _int(3, 20), "min_samples_leaf": _int(1, 10)}
_KNN_SPACE = {"n_neighbors": _int(3, 25), "weights": _choice("uniform", "distance")}
_ADA_SPACE = {"n_estimators": _int(50, 300), "learning_rate": _log(0.01, 2.0)}


def _linear(p: dict, shape: Shape, l1: float, scaled: bool):
    strength = p["alpha"] / max(shape.rows, 1) if scaled else p["alpha"]
    return MR.LinearRegression(
        regParam=strength, elasticNetParam=l1, standardization=False, maxIter=200, solver="l-bfgs" if l1 else "auto"
    )


def _specs() -> dict[str, dict[str, ModelSpec]]:
    def knn(classify):
        from tabwright.operators.ensembles import KnnEstimator

        return lambda p, s: KnnEstimator(p["n_neighbors"], p["weights"], classify)

    def ada(classify):
        from tabwright.operators.ensembles import AdaBoost

        return lambda p, s: AdaBoost(p["n_estimators"], p["learning_rate"], classify, s)

    both = [
        ("knn", "KNN", "instance", _KNN_SPACE, knn(True), knn(False)),
        ("adaboost", "AdaBoost", "boosting", _ADA_SPACE, ada(True), ada(False)),
        ("gradient_boosting", "Gradient Boosting", "boosting", _BOOST_SPACE, lambda p, s: _boosted(p, s, True), lambda p, s: _boosted(p, s, False)),
        ("xgboost", "XGBoost", "boosting", _XGB_SPACE, lambda p, s: _xgboost(p, s, True), lambda p, s: _xgboost(p, s, False)),
        (
            "random_forest", "Random Forest", "tree", _FOREST_SPACE,
            lambda p, s: MC.RandomForestClassifier(numTrees=p["n_estimators"], **_tree_args(p, s)),
            lambda p, s: MR.RandomForestRegressor(numTrees=p["n_estimators"], **_tree_args(p, s)),
        ),
    ]
    classify = {n: ModelSpec(n, d, c, sp, b) for n, d, c, sp, b, _ in both}
    regress = {n: ModelSpec(n, d, c, sp, b) for n, d, c, sp, _, b in both}
    for out, classes in ((classify, True), (regress, False)):
        out["lightgbm"] = ModelSpec(
            "lightgbm", "LightGBM", "boosting", _LGB_CLASS_SPACE if classes else _LGB_SPACE, lambda p, s, c=classes: _lightgbm(p, s, c)
        )
        out["catboost"] = ModelSpec(
            "catboost", "CatBoost", "boosting", _CAT_CLASS_SPACE if classes else _CAT_SPACE, lambda p, s, c=classes: _catboost(p, s, c)
        )
    for spec in (
        ModelSpec(
            "logistic_regression", "Logistic Regression", "linear", {"C": _log(1e-4, 10)},
            lambda p, s: MC.LogisticRegression(regParam=1.0 / (p["C"] * max(s.rows, 1)), standardization=False, maxIter=200),
        ),
        ModelSpec(
            "decision_tree", "Decision Tree", "tree", {**_TREE_SPACE, "criterion": _choice("gini", "entropy")},
            lambda p, s: MC.DecisionTreeClassifier(impurity=p["criterion"], **_tree_args(p, s)),
        ),
        ModelSpec("svm", "SVM", "instance", {"C": _log(0.1, 10)}, _svm),
        ModelSpec("naive_bayes", "Naive Bayes", "probabilistic", {}, lambda p, s: MC.NaiveBayes(modelType="gaussian")),
    ):
        classify[spec.name] = spec
    for spec in (
        ModelSpec("ridge", "Ridge", "linear", {"alpha": _log(1e-4, 10)}, lambda p, s: _linear(p, s, 0.0, True)),
        ModelSpec("lasso", "Lasso", "linear", {"alpha": _log(1e-4, 10)}, lambda p, s: _linear(p, s, 1.0, False)),
        ModelSpec(
            "elastic_net", "Elastic Net", "linear", {"alpha": _log(1e-4, 10), "l1_ratio": _float(0.0, 1.0)},
            lambda p, s: _linear(p, s, p["l1_ratio"], False),
        ),
        ModelSpec(
            "decision_tree", "Decision Tree", "tree", _TREE_SPACE,
            lambda p, s: MR.DecisionTreeRegressor(**_tree_args(p, s)),
        ),
        ModelSpec(
            "svr", "SVR", "instance", {"C": _log(0.1, 10), "epsilon": _float(0.1, 0.5)},
            lambda p, s: MR.LinearRegression(
                loss="huber", epsilon=1.0 + p["epsilon"], regParam=1.0 / (p["C"] * max(s.rows, 1)), standardization=False
            ),
        ),
    ):
        regress[spec.name] = spec
    return {CLASSIFICATION: classify, REGRESSION: regress}


_CACHE: dict[str, dict[str, ModelSpec]] = {}


def registry(problem: str) -> dict[str, ModelSpec]:
    if not _CACHE:
        _CACHE.update(_specs())
    if problem not in _CACHE:
        raise ValueError("problem type must be 'classification' or 'regression'")
    return _CACHE[problem]


def registry_table(spark, problem: str) -> DataFrame:
    rows = [(s.name, s.display, s.category) for s in sorted(registry(problem).values(), key=lambda s: s.name)]
    return spark.createDataFrame(rows, "id string, name string, category string")


def validate_request(df: DataFrame, target: str, problem: str, names: Sequence[str], budget_minutes: float) -> None:
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    unknown = sorted(set(names) - set(registry(problem)))
    if unknown:
        raise ValueError(f"models not valid for {problem}: {', '.join(unknown)}")
    if not 0 < budget_minutes <= MAX_BUDGET_MINUTES:
        raise ValueError(f"the time budget must be above 0 and at most {MAX_BUDGET_MINUTES} minutes")


def without_summary(model: Any) -> Any:
    """Drop the training summary of a fitted model.

    The summary holds the training data and the session, which then travel with every task that
    scores rows and cannot be serialized once the session has observed metrics.
    """
    for part in getattr(model, "models", None) or [model]:
        if getattr(part, "hasSummary", False):
            part._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
    return model


def class_statistics(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Count, mean and population variance per class: what a Gaussian naive Bayes learns."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.var_pop(c).alias(f"{c}_variance")]
    return df.groupBy(label).agg(*aggs)


def importances(model: Any, names: Sequence[str]) -> dict[str, float]:
    """Tree importances, else absolute coefficients; of several classes the norm over them."""
    values = None
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    elif isinstance(model, MC.LogisticRegressionModel):
        values = (model.coefficientMatrix.toArray() ** 2).sum(axis=0) ** 0.5
    elif hasattr(model, "coefficients"):
        values = abs(model.coefficients.toArray())
    if values is None:
        return {}
    return {n: float(v) for n, v in zip(names, values)}

