"""Estimators Spark ML does not have: nearest neighbours and AdaBoost over weighted trees.

They follow the ``fit(df)`` / ``transform(df)`` shape of Spark ML with ``features`` and ``label``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.operators.boosting import BINS, binned, merged, quantile_borders
from tabwright.operators.neighbors import knn_classify, knn_regress, nearest, nearest_hashed
from tabwright.operators.tree_columns import SPARK, Tree, number, read_spark_tree, total_sql, tree_sql, weighted_vote_sql
from tabwright.session import cut_lineage

CUT_EVERY = 10
#: A stump chooses among the borders of so many bins of a feature, which have about equal weights.
STUMP_BINS = 32
#: Rounding can leave so much of an error.
LEAST_ERROR = 1e-12


def _meta(spark, path: str, data: dict[str, Any]) -> None:
    spark.createDataFrame([(json.dumps(data),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def _read_meta(spark, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(f"{path}/meta").first()[0])


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """Fix a row number: it is not repeatable, so the numbered rows are written out once."""
    return cut_lineage(df.withColumn(name, F.monotonically_increasing_id()))


def _spread(df: DataFrame, width: int) -> tuple[DataFrame, list[str]]:
    names = [f"__f{i}" for i in range(width)]
    array = vector_to_array("features")
    return df.select("*", *[array[i].alias(n) for i, n in enumerate(names)]), names


class KnnEstimator:
    """Neighbours are exact; ``hashed`` trades that for buckets, which many columns need to be fast."""

    def __init__(self, k: int, weights: str, classify: bool, hashed: bool = False) -> None:
        self.k, self.weights, self.classify, self.hashed = k, weights, classify, hashed

    def fit(self, df: DataFrame) -> KnnModel:
        rows = _numbered(df.select("features", "label"), "__t")
        first = rows.first()
        if first is None:
            raise ValueError("no training rows")
        return KnnModel(rows, len(first["features"]), self.k, self.weights, self.classify, self.hashed)


class KnnModel:
    def __init__(self, rows: DataFrame, width: int, k: int, weights: str, classify: bool, hashed: bool = False) -> None:
        self.rows, self.width, self.k, self.weights, self.classify, self.hashed = rows, width, k, weights, classify, hashed

    def transform(self, df: DataFrame) -> DataFrame:
        asked = _numbered(df, "__q")
        queries, names = _spread(asked.select("features", "__q"), self.width)
        train, _ = _spread(self.rows, self.width)
        search = nearest_hashed if self.hashed else nearest
        found = search(queries, train, names, self.k, "__q", "__t", "label")
        decided = knn_classify(found, self.weights) if self.classify else knn_regress(found, self.weights)
        return asked.join(decided.withColumnRenamed("query_id", "__q"), "__q", "left").drop("__q")

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        meta = {"width": self.width, "k": self.k, "weights": self.weights, "classify": self.classify, "hashed": self.hashed}
        _meta(self.rows.sparkSession, path, meta)

    @staticmethod
    def load(spark, path: str) -> KnnModel:
        return KnnModel(spark.read.parquet(f"{path}/rows"), **_read_meta(spark, path))


class AdaBoost:
    """SAMME for classes over weighted stumps, and R2 with linear loss for numbers over weighted Spark trees.

    Stumps are found on bins, one pass for each: the weights of features, bins and classes tell the best split and its
    error. Weights of rows follow from their bins and label, so they are an expression of the stumps so far.
    """

    def __init__(self, n_estimators: int, learning_rate: float, classify: bool, shape) -> None:
        self.n, self.rate, self.classify, self.shape = n_estimators, learning_rate, classify, shape

    def fit(self, df: DataFrame) -> AdaBoostModel:
        return self._fit_classes(df) if self.classify else self._fit_numbers(df)

    def _fit_classes(self, df: DataFrame) -> AdaBoostModel:
        classes = max(2, self.shape.classes)
        source = df.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("label"))
        first = source.first()
        if first is None:
            raise ValueError("no training rows")
        names = [f"x{i}" for i in range(len(first["x"]))]
        # adding zero makes -0.0 and 0.0 one value
        values = source.select("label", *[(F.col("x")[i] + F.lit(0.0)).alias(n) for i, n in enumerate(names)])
        borders = quantile_borders(values, names, BINS)
        rows = merged(binned(values, borders, "label"), ["bins", "label"]).withColumn("weight", F.col("n").cast("double"))
        trees, alphas, gains, pending, first_total = [], [], [], [], 0.0
        shape = (len(names), max(len(b) for b in borders) + 2, classes)
        for _ in range(self.n):
            spread = rows.select("label", _reweighted(pending).alias("weight"), F.posexplode("bins").alias("feature", "bin"))
            found = spread.groupBy("feature", "bin", "label").agg(F.sum("weight").alias("weight")).toArrow()
            weights = np.zeros(shape)
            weights[tuple(found.column(c).to_numpy() for c in ("feature", "bin", "label"))] = found.column("weight").to_numpy()
            feature, place, sides = best_stump(weights)
            chosen = [int(side.argmax()) for side in sides]
            total = float(weights[0].sum())
            first_total = first_total or total
            error = sum(side.sum() - side[c] for side, c in zip(sides, chosen, strict=True)) / total
            one = len(set(chosen)) == 1
            if error <= LEAST_ERROR:
                alpha = 1.0
            elif error >= 1 - 1 / classes:
                if trees:
                    break
                alpha = 1.0
            else:
                alpha = self.rate * (math.log((1 - error) / error) + math.log(classes - 1))
            cuts = borders[feature]
            # beyond the last border only missing values lie
            threshold, closed = (cuts[place], False) if place < len(cuts) else (math.inf, True)
            left, right = (Tree(float(c)) for c in (chosen * 2)[:2])
            trees.append(left if one else Tree(0.0, feature, threshold, closed, left, right))
            alphas.append(alpha)
            gains.append([0.0 if one or i != feature else 1.0 for i in range(len(names))])
            if error <= LEAST_ERROR or error >= 1 - 1 / classes:
                break
            pending.append((Tree(chosen[0]) if one else Tree(0, feature, place, True, Tree(chosen[0]), Tree(chosen[1])), math.exp(alpha)))
            if len(pending) == CUT_EVERY:
                # weights keep an average of one
                average = total * (1 - error + error * math.exp(alpha)) / first_total
                rows = cut_lineage(rows.withColumn("weight", _reweighted(pending) / F.lit(average)))
                pending = []
        return AdaBoostModel(trees, alphas, True, classes, gains)

    def _fit_numbers(self, df: DataFrame) -> AdaBoostModel:
        rows = cut_lineage(df.select("features", "label").withColumn("weight", F.lit(1.0)))
        trees, alphas = [], []
        for i in range(self.n):
            tree = DecisionTreeRegressor(maxDepth=3, weightCol="weight", seed=self.shape.seed + i).fit(rows)
            scored = tree.transform(rows)
            step = self._regress(scored)
            if step is None:
                if not trees:
                    trees, alphas = [tree], [1.0]
                break
            alpha, weight, average = step
            trees.append(tree)
            alphas.append(alpha)
            if average is None:
                break
            # weights keep an average of one
            rows = scored.select("features", "label", (weight / F.lit(average)).alias("weight"))
            if (i + 1) % CUT_EVERY == 0:
                rows = cut_lineage(rows)
        gains = [t.featureImportances.toArray().tolist() for t in trees]
        return AdaBoostModel([read_spark_tree(t) for t in trees], alphas, False, max(2, self.shape.classes), gains)

    def _regress(self, scored: DataFrame) -> tuple[float, Column, float | None] | None:
        off = F.abs(F.col("prediction") - F.col("label"))
        largest = scored.agg(F.max(off)).first()[0]
        if not largest:
            return 1.0, F.col("weight"), None
        loss = off / F.lit(largest)
        row = scored.agg(F.sum(F.col("weight") * loss), F.sum("weight")).first()
        error = row[0] / row[1]
        if error >= 0.5:
            return None
        beta = error / (1 - error)
        weight = F.col("weight") * F.pow(F.lit(beta), (1 - loss) * F.lit(self.rate))
        return self.rate * math.log(1 / beta), weight, scored.agg(F.avg(weight)).first()[0]


def _reweighted(stumps: list[tuple[Tree, float]]) -> Column:
    """The weight after each of ``stumps`` (on bins) has raised what it gets wrong by its factor."""
    out = F.col("weight")
    for tree, factor in stumps:
        wrong = F.expr(tree_sql(tree, "bins[{}]".format, leaf=lambda v: str(int(v)))) != F.col("label")
        out = out * F.when(wrong, F.lit(factor)).otherwise(F.lit(1.0))
    return out


def split_places(counts: np.ndarray, most: int = STUMP_BINS - 1) -> list[int]:
    """The bins after which a column may be split: all that hold rows if few, else those nearest to even shares of weight."""
    held = np.flatnonzero(counts > 0).tolist()
    if len(held) - 1 <= most:
        return held[:-1]
    stride = float(counts.sum()) / (most + 1)
    out, target, reached = [], stride, float(counts[held[0]])
    for before, place in zip(held, held[1:]):
        previous, reached = reached, reached + float(counts[place])
        if abs(previous - target) < abs(reached - target):
            out.append(before)
            target += stride
    return out


def best_stump(weights: np.ndarray) -> tuple[int, int, list[np.ndarray]]:
    """Feature, last bin of the left side, and class weights of the sides of the split with the least Gini impurity.

    ``weights`` are those of each feature, bin and class. One side if no split lowers the impurity.
    """
    whole = weights[0].sum(0)
    left = np.cumsum(weights, 1)
    right = np.maximum(whole - left, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        pure = (left**2).sum(2) / left.sum(2) + (right**2).sum(2) / right.sum(2)
    # rounding can leave a little weight where no rows are
    least = 1e-12 * whole.sum()
    pure = np.where((left.sum(2) > least) & (right.sum(2) > least), pure, -np.inf)
    allowed = np.zeros(pure.shape, bool)
    for i, counts in enumerate(weights.sum(2)):
        allowed[i, split_places(counts)] = True
    pure = np.where(allowed, pure, -np.inf)
    at = int(pure.argmax())
    feature, place = divmod(at, pure.shape[1])
    if not pure.flat[at] > (whole**2).sum() / whole.sum():
        return 0, 0, [whole]
    return feature, place, [left[feature, place], right[feature, place]]


class AdaBoostModel:
    """Trees and their weights; all of them score in one projection, on streams too."""

    def __init__(self, trees: list[Tree], alphas: list[float], classify: bool, classes: int, gains: list[list[float]]) -> None:
        self.trees, self.alphas, self.classify, self.classes, self.gains = trees, alphas, classify, classes, gains

    def sql(self, column: Callable[[int], str], dialect: str = SPARK) -> str:
        """The class as one expression over features that ``column`` names, for Spark or another engine."""
        if not self.classify:
            raise ValueError("a weighted median is no plain expression")
        return weighted_vote_sql(self.trees, self.alphas, self.classes, column, dialect)

    def transform(self, df: DataFrame) -> DataFrame:
        keep = [F.col(c) for c in df.columns if c != "prediction"]
        out = df.select(*keep, vector_to_array("features").alias("__x"))
        column = "__x[{}]".format
        if self.classify:
            totals = []
            for c in range(self.classes):
                votes = [tree_sql(t, column, leaf=lambda v, a=a, c=c: number(a if v == c else 0.0)) for t, a in zip(self.trees, self.alphas, strict=True)]
                totals.append(total_sql(votes))
            out = out.withColumn("__scores", F.expr(f"array({', '.join(totals)})"))
            best = (F.array_position("__scores", F.array_max("__scores")) - 1).cast("double")
            return out.select(*keep, best.alias("prediction"))
        pairs = [f"struct({tree_sql(t, column)} AS p, {number(a)} AS w)" for t, a in zip(self.trees, self.alphas, strict=True)]
        half = F.lit(sum(self.alphas) / 2)
        start = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("p"))
        # the weighted median: the first prediction at which half of the weight is reached
        middle = F.aggregate(F.array_sort(F.expr(f"array({', '.join(pairs)})")), start, _add_median(half))
        return out.select(*keep, middle["p"].alias("prediction"))

    @property
    def featureImportances(self):
        from pyspark.ml.linalg import Vectors

        total = sum(self.alphas) or 1.0
        return Vectors.dense([sum(g[i] * a for g, a in zip(self.gains, self.alphas, strict=True)) / total for i in range(len(self.gains[0]))])

    def save(self, path: str) -> None:
        from pyspark.sql import SparkSession

        meta = {
            "trees": [t.record() for t in self.trees], "alphas": self.alphas, "classify": self.classify, "classes": self.classes, "gains": self.gains,
        }
        _meta(SparkSession.active(), path, meta)

    @staticmethod
    def load(spark, path: str) -> AdaBoostModel:
        meta = _read_meta(spark, path)
        return AdaBoostModel(**{**meta, "trees": [Tree.read(r) for r in meta["trees"]]})


def _add_median(half: Column):
    def add(acc: Column, v: Column) -> Column:
        reached = acc["s"] + v["w"]
        value = F.when(acc["p"].isNotNull(), acc["p"]).when(reached >= half, v["p"])
        return F.struct(reached.alias("s"), value.alias("p"))

    return add
