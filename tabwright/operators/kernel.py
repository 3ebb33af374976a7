"""A support vector classifier with a radial kernel, by random Fourier features before the linear one.

Inner products of the features ``sqrt(2 / n) cos(w x + b)`` estimate the kernel ``exp(-gamma |x - y|^2)`` when the rows of
``w`` are drawn from its spectrum. So the classifier stays linear in the rows, where a kernel matrix grows with their square.

The features are a hundred times as wide as the rows and are never stored: each step of the fit maps the rows anew, block
by block, and a task returns only its sums of losses and gradients. Equal rows of one label are one row with a count.
"""

from __future__ import annotations

import json
import math
from collections import deque
from collections.abc import Generator, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import classification as MC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.session import cut_lineage

FEATURES = 256
#: Rows that are mapped at once.
BLOCK = 2048
#: Steps that the optimiser remembers, and tries for the length of one step.
MEMORY, TRIES = 10, 20
#: The fit ends when ``STILL`` steps in a row lower the loss by less than this share of it (of 0.01 at least).
TOLERANCE, STILL = 1e-5, 3
_RAW = "__raw"


def scale_gamma(df: DataFrame) -> float:
    """One over the number of columns times the variance of all entries."""
    x = vector_to_array("features")
    first = df.select(x.alias("x")).first()
    if first is None:
        raise ValueError("no training rows")
    one, two = F.lit(0.0), F.lit(0.0)
    row = df.select(
        F.aggregate(x, one, lambda a, v: a + v).alias("s"), F.aggregate(x, two, lambda a, v: a + v * v).alias("q")
    ).agg(F.sum("s"), F.sum("q"), F.count("*")).first()
    width = len(first["x"])
    n = row[2] * width
    variance = max(row[1] / n - (row[0] / n) ** 2, 0.0)
    return 1.0 / (width * variance) if variance > 0 else 1.0


def spectrum(width: int, gamma: float, features: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(size=(width, features)) * math.sqrt(2 * gamma), rng.uniform(0, 2 * math.pi, features)


def fourier(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The mapped features of rows. Whole turns are taken off in double precision, the cosines are single."""
    turns = x @ (w / (2 * math.pi)) + b / (2 * math.pi)
    turns -= np.rint(turns)
    out = np.cos(turns.astype(np.float32) * np.float32(2 * math.pi))
    out *= np.float32(math.sqrt(2.0 / len(b)))
    return out


def _table(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def margins(x: Column, w: np.ndarray, b: np.ndarray, coefficients: np.ndarray, intercepts: np.ndarray) -> Column:
    """The distance of each row of an array column from each plane."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for at in range(0, len(part), BLOCK):
                z = fourier(np.stack(part.iloc[at : at + BLOCK].to_numpy()), w, b)
                out += list(z.astype(np.float64) @ coefficients.T + intercepts)
            yield pd.Series(out, dtype=object)

    return run(x)


def _sums(w: np.ndarray, b: np.ndarray, planes: dict[int, np.ndarray]):
    """Rows (x, label, n) of a task to one row: hinge loss and its gradient for each plane, summed over the rows."""
    wanted = np.array(list(planes), float)
    plane = np.stack(list(planes.values()))
    weights, shifts = plane[:, :-1].T.astype(np.float32), plane[:, -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(plane), 1 + plane.shape[1]))
        for batch in batches:
            x, label, n = _table(batch.column("x"), len(w)), batch.column("label").to_numpy(), batch.column("n").to_numpy()
            for at in range(0, len(x), BLOCK):
                rows = slice(at, at + BLOCK)
                z = fourier(x[rows], w, b)
                side = np.where(label[rows, None] == wanted, 1.0, -1.0)
                loss = 1 - side * (z @ weights + shifts)
                pull = np.where(loss > 0, -side * n[rows, None], 0.0)
                total[:, 0] += n[rows] @ np.maximum(loss, 0)
                total[:, 1:-1] += pull.T.astype(np.float32) @ z
                total[:, -1] += pull.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1)], pa.list_(pa.float64()))], ["sums"])

    return run


def minimise(x: np.ndarray, iterations: int) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """L-BFGS that asks for a value and a gradient by yielding a point, and returns the lowest point.

    Steps are found by bisection between too long (the value falls too little) and too short (it still falls as steeply),
    which also ends at the kinks of a hinge loss.
    """
    f, g = yield x
    steps: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=MEMORY)
    still = 0
    for _ in range(iterations):
        way = -_smoothed(g, steps)
        slope = float(g @ way)
        if slope >= 0:
            steps.clear()
            way, slope = -g, -float(g @ g)
        if slope > -1e-20:
            break
        size = 1.0 if steps else 1 / math.sqrt(-slope)
        low, high = 0.0, math.inf
        best = None
        for _ in range(TRIES):
            point = x + size * way
            value, gradient = yield point
            if value < f and (best is None or value < best[0]):
                best = value, gradient, point
            if value > f + 1e-4 * size * slope:
                high = size
            elif gradient @ way < 0.9 * slope:
                low = size
            else:
                break
            size = (low + high) / 2 if high < math.inf else 2 * low
        if best is None:
            if not steps:
                break
            # no way down from remembered steps: start again from the gradient
            steps.clear()
            continue
        value, gradient, point = best
        moved, bent = point - x, gradient - g
        if moved @ bent > 1e-14 * math.sqrt((moved @ moved) * (bent @ bent)):
            steps.append((moved, bent))
        still = still + 1 if f - value <= TOLERANCE * max(abs(f), 0.01) else 0
        x, f, g = point, value, gradient
        if still >= STILL:
            break
    return x


def _smoothed(g: np.ndarray, steps: deque) -> np.ndarray:
    """The gradient times the inverse curvature that the remembered steps tell."""
    out, shares = g.copy(), []
    for s, y in reversed(steps):
        a = (s @ out) / (s @ y)
        out -= a * y
        shares.append(a)
    if steps:
        s, y = steps[-1]
        out *= (s @ y) / (y @ y)
    for (s, y), a in zip(steps, reversed(shares), strict=True):
        out += s * (a - (y @ out) / (s @ y))
    return out


class KernelSvm:
    """``fit(df)`` on ``features`` and ``label``; more than two classes are taken one against the rest."""

    def __init__(self, c: float, shape: Any, features: int = FEATURES, gamma: float | None = None, iterations: int = 100) -> None:
        self.c, self.shape, self.features, self.gamma, self.iterations = c, shape, features, gamma, iterations

    def fit(self, df: DataFrame) -> KernelSvmModel:
        classes = max(self.shape.classes, 2)
        # equal rows are one row with a count
        plain = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))
        rows = cut_lineage(plain.groupBy("x", "label").agg(F.count("*").cast("double").alias("n")))
        odd = F.exists("x", lambda v: F.isnan(v) | (F.abs(v) == math.inf)) | ~F.col("label").isin([float(k) for k in range(classes)])
        seen = rows.agg(F.sum("n"), F.max(F.size("x")), F.max(F.coalesce(odd, F.lit(True)))).first()
        if seen[0] is None:
            raise ValueError("no training rows")
        if seen[2]:
            raise ValueError(f"features have to be finite, and labels whole numbers from 0 to {classes - 1}")
        gamma = self.gamma or scale_gamma(df)
        w, b = spectrum(seen[1], gamma, self.features, self.shape.seed)
        strength = 1.0 / (self.c * max(self.shape.rows, 1))
        # two classes need one plane; those of more classes take their steps in the same passes over the rows
        searches = {k: minimise(np.zeros(self.features + 1), self.iterations) for k in ([1] if classes == 2 else range(classes))}
        asked, found = {k: next(s) for k, s in searches.items()}, {}
        while asked:
            parts = rows.mapInArrow(_sums(w, b, asked), "sums array<double>").toArrow().column("sums")
            sums = _table(parts.combine_chunks(), len(asked) * (self.features + 2)).sum(0).reshape(len(asked), -1) / seen[0]
            for (k, plane), (loss, *gradient) in zip(list(asked.items()), sums, strict=True):
                slim = np.append(plane[:-1], 0.0)
                try:
                    asked[k] = searches[k].send((float(loss + strength / 2 * (slim @ slim)), np.array(gradient) + strength * slim))
                except StopIteration as end:
                    found[k] = end.value
                    del asked[k]
        planes = np.stack([found[k] for k in searches])
        return KernelSvmModel(w, b, planes[:, :-1], planes[:, -1])


class KernelSvmModel:
    """One plane for two classes, else one for each class."""

    def __init__(self, w: np.ndarray, b: np.ndarray, coefficients: np.ndarray, intercepts: np.ndarray) -> None:
        self.w, self.b, self.coefficients, self.intercepts = w, b, coefficients, intercepts

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn(_RAW, margins(vector_to_array("features"), self.w, self.b, self.coefficients, self.intercepts))
        raw = F.col(_RAW)
        if len(self.intercepts) == 1:
            shown, decided = F.array(-raw[0], raw[0]), (raw[0] > 0).cast("double")
        else:
            shown, decided = raw, (F.array_position(raw, F.array_max(raw)) - 1).cast("double")
        return out.withColumns({"rawPrediction": array_to_vector(shown), "prediction": decided}).drop(_RAW)

    def save(self, path: str) -> None:
        meta = {"w": self.w.tolist(), "b": self.b.tolist(), "coefficients": self.coefficients.tolist(), "intercepts": self.intercepts.tolist()}
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark, path: str) -> KernelSvmModel:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        if "kind" in meta:  # saved when the planes were models of Spark
            kind = {"LinearSVCModel": MC.LinearSVCModel, "OneVsRestModel": MC.OneVsRestModel}[meta["kind"]]
            linear = kind.load(f"{path}/linear")
            planes = getattr(linear, "models", [linear])
            meta |= {"coefficients": [p.coefficients.toArray().tolist() for p in planes], "intercepts": [p.intercept for p in planes]}
        return KernelSvmModel(*(np.array(meta[k]) for k in ("w", "b", "coefficients", "intercepts")))
