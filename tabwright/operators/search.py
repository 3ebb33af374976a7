"""Model search: seeded random search with cross-validation, ranking and refit.

Rows stay on the executors. The driver only picks parameters and submits Spark jobs; preparation is
fitted again inside each fold, so no fold sees statistics of its own validation rows.
"""

from __future__ import annotations

import math
import random
import threading
import time
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.operators import metrics
from tabwright.operators.features import (
    FOLDS,
    FeaturePrep,
    TargetLabels,
    fit_features,
    hash_percent,
    problem_type,
    stratified_folds,
    target_labels,
    TEST_PERCENT,
)
from tabwright.operators.models import CLASSIFICATION, ModelSpec, Shape, Space, importances, registry, validate_request, without_summary
from tabwright.operators.scoring import Bundle, assemble
from tabwright.session import by_rows, cut_lineage

TRIALS = 10
MIN_SECONDS = 5.0
#: Trials before the search is guided, and draws of which the best is tried.
FIRST_TRIALS, CANDIDATES = 4, 24
SEED = 42

RESULT = (
    "job_id string, algorithm string, problem_type string, accuracy double, f1 double, precision double, recall double, "
    "auc double, rmse double, mae double, r2 double, cv_score double, trials int, training_time double, "
    "params map<string,string>, importance map<string,double>, error string"
)


@dataclass
class Outcome:
    algorithm: str
    metrics: dict[str, float] = field(default_factory=dict)
    params: dict[str, Any] = field(default_factory=dict)
    cv_score: float | None = None
    trials: int = 0
    stopped: int = 0
    seconds: float = 0.0
    importance: dict[str, float] = field(default_factory=dict)
    bundle: Bundle | None = None
    error: str | None = None


@dataclass
class SearchResult:
    problem: str
    outcomes: list[Outcome]
    job_id: str
    seconds: float

    def table(self, spark) -> DataFrame:
        names = ("accuracy", "f1", "precision", "recall", "auc", "rmse", "mae", "r2")
        rows = [
            (
                self.job_id, o.algorithm, self.problem, *[o.metrics.get(n) for n in names], o.cv_score, o.trials, o.seconds,
                {k: str(v) for k, v in o.params.items()}, o.importance, o.error,
            )
            for o in self.outcomes
        ]
        return spark.createDataFrame(rows, RESULT)

    def leaderboard(self, spark) -> DataFrame:
        """Successful models, best accuracy or R2 first."""
        metric = "accuracy" if self.problem == CLASSIFICATION else "r2"
        return metrics.leaderboard(self.table(spark).filter("error is null"), ["job_id"], metric, ["algorithm"])

    @property
    def best(self) -> Outcome | None:
        metric = "accuracy" if self.problem == CLASSIFICATION else "r2"
        good = [o for o in self.outcomes if o.error is None]
        return min(good, key=lambda o: (-(o.metrics.get(metric) or 0.0), o.algorithm)) if good else None


@dataclass
class TrainingSet:
    """The pruned training table with ``label``, ``fold`` and ``part`` columns, written once."""

    df: DataFrame
    features: list[str]
    problem: str
    shape: Shape
    labels: TargetLabels | None

    @staticmethod
    def prepare(df: DataFrame, target: str, key: Sequence[str], features: Sequence[str] | None, problem: str | None, folds: int, seed: int) -> TrainingSet:
        """Rows, label and split, written once. Without folds (0) their shuffle is spared."""
        problem = problem or problem_type(df, target)
        chosen = list(features or [c for c in df.columns if c != target and c not in key])
        rows = df.select(*key, *chosen, target).filter(F.col(target).isNotNull())
        labels = None
        if problem == CLASSIFICATION:
            labels = target_labels(rows, target)
            rows = labels.encode(rows, target, "label")
        else:
            rows = rows.withColumn("label", F.col(target).cast("double"))
        if folds:
            rows = stratified_folds(rows, "label" if labels else None, key, folds, "fold", seed)
        else:
            rows = rows.withColumn("fold", F.lit(None).cast("int"))
        part = F.when(hash_percent(key, seed) < TEST_PERCENT, F.lit("test")).otherwise(F.lit("train"))
        rows = cut_lineage(rows.select(*chosen, "label", "fold", part.alias("part")))
        shape = Shape(rows.count(), len(labels.labels) if labels else 0, seed)
        return TrainingSet(rows, chosen, problem, shape, labels)


@dataclass
class Split:
    """One fitted preparation with its transformed training and validation rows."""

    train: DataFrame
    valid: DataFrame
    shape: Shape

    def fit(self, spec: ModelSpec, params: dict[str, Any]) -> Any:
        return _fit(spec, params, self.shape, self.train)


def _fit(spec: ModelSpec, params: dict[str, Any], shape: Shape, train: DataFrame) -> Any:
    return without_summary(spec.build(params, shape).fit(by_rows(train, shape.rows)))


def _shape(data: TrainingSet, prep: FeaturePrep) -> Shape:
    """Of the training data, with the features that hold numbers of categories."""
    return replace(data.shape, categories=tuple(i for i, n in enumerate(prep.feature_names) if n in prep.dictionaries))


def _split(data: TrainingSet, train: DataFrame, valid: DataFrame) -> Split:
    prep = fit_features(train, data.features)
    return Split(*[assemble(prep.transform(d), prep).select("features", "label") for d in (train, valid)], _shape(data, prep))


def cv_score(data: TrainingSet, folds: Sequence[Split], name: str, params: dict[str, Any]) -> float:
    """Mean accuracy, or mean negative squared error, over the folds."""
    total = 0.0
    for fold in folds:
        model = fold.fit(registry(data.problem)[name], params)
        scored = model.transform(fold.valid)
        if data.problem == CLASSIFICATION:
            value = F.avg((F.col("prediction") == F.col("label")).cast("double"))
        else:
            value = -F.avg(F.pow(F.col("prediction") - F.col("label"), 2))
        total += scored.agg(value).first()[0]
    return total / len(folds)


def evaluate(scored: DataFrame, problem: str, classes: int) -> dict[str, float]:
    """All metrics of a model on held-out rows; the model scores them only once."""
    kept = ["label", "prediction"]
    if problem == CLASSIFICATION and classes == 2 and "probability" in scored.columns:
        scored = scored.withColumn("score", vector_to_array("probability")[1])
        kept.append("score")
    scored = cut_lineage(scored.select(*kept))
    if problem != CLASSIFICATION:
        return metrics.regression_scores(scored, "label", "prediction").first().asDict()
    out = metrics.weighted_scores(scored, "label", "prediction").first().asDict()
    out["accuracy"] = metrics.accuracy(scored, "label", "prediction").first()[0]
    if "score" in kept:
        out["auc"] = metrics.roc_auc(scored, "label", "score").first()[0]
    return {k: v for k, v in out.items() if v is not None}


def train_single(data: TrainingSet, name: str, params: dict[str, Any], refit: bool = True) -> Outcome:
    """One model with given parameters: held-out metrics, then a refit on all rows."""
    start = time.time()
    spec = registry(data.problem)[name]
    test = data.df.filter("part = 'test'")
    split = _split(data, data.df.filter("part = 'train'"), test)
    model = split.fit(spec, params)
    scores = evaluate(model.transform(split.valid), data.problem, data.shape.classes)
    out = Outcome(name, scores, dict(params))
    if refit:
        out.bundle = fit_bundle(data, name, params)
        out.importance = importances(out.bundle.model, out.bundle.prep.feature_names)
    out.seconds = time.time() - start
    return out


def fit_bundle(data: TrainingSet, name: str, params: dict[str, Any]) -> Bundle:
    """Preparation and model fitted on all rows."""
    prep = fit_features(data.df, data.features)
    ready = assemble(prep.transform(data.df), prep).select("features", "label")
    final = _fit(registry(data.problem)[name], params, _shape(data, prep), ready)
    return Bundle(prep, final, data.problem, data.labels, name)


def draw_params(problem: str, name: str, trial: int, seed: int = SEED, space: dict | None = None) -> dict[str, Any]:
    rng = random.Random(f"{seed}-{name}-{trial}")
    return {k: s.draw(rng) for k, s in (space or registry(problem)[name].space).items()}


class TimeUp(Exception):
    """Spark work was cancelled because its time was over."""


@contextmanager
def time_limit(context: SparkContext, seconds: float) -> Iterator[None]:
    """Cancel the Spark jobs of this thread once ``seconds`` are over, and raise ``TimeUp``.

    Jobs carry a tag of their own, and the tag is cancelled until the block ends: a fit that goes on with another job
    loses that too.
    """
    tag, ended, over = f"limit-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        if ended.wait(max(seconds, 0.0)):
            return
        over.set()
        while not ended.wait(0.2):
            context.cancelJobsWithTag(tag)

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        yield
    except Exception as e:
        if over.is_set():
            raise TimeUp(f"stopped after {seconds:.1f} seconds") from e
        raise
    finally:
        ended.set()
        watcher.join()
        context.removeJobTag(tag)


def _search_one(
    data: TrainingSet, folds: list[Split], name: str, trials: int, seconds: float, seed: int, space: dict | None, guided: bool, grace: float
) -> Outcome:
    start, done, stopped, last_error = time.time(), 0, 0, None
    spec, context = registry(data.problem)[name], data.df.sparkSession.sparkContext
    space = space or spec.space
    seen: list[tuple[dict[str, Any], float]] = []
    for trial in range(trials if space else 1):
        left = seconds - (time.time() - start)
        if done and left <= 0:
            break
        params = guided_params(space, seen, f"{seed}-{name}-{trial}") if guided else draw_params(data.problem, name, trial, seed, space)
        try:
            with time_limit(context, left):
                seen.append((params, cv_score(data, folds, name, params)))
        except TimeUp as e:
            stopped, last_error = stopped + 1, e
        except Exception as e:  # noqa: BLE001
            last_error = e
        done += 1
    if not seen:
        return Outcome(name, trials=done, stopped=stopped, seconds=time.time() - start, error=str(last_error))
    # the first of equal scores
    best_params, best = max(seen, key=lambda s: s[1])
    try:
        with time_limit(context, max(seconds + grace - (time.time() - start), MIN_SECONDS)):
            out = train_single(data, name, best_params)
    except TimeUp as e:
        out = Outcome(name, params=dict(best_params), error=f"last fit {e}")
    out.cv_score, out.trials, out.stopped, out.seconds = best, done, stopped, time.time() - start
    return out


def _unit(space: Space, value: Any) -> float:
    """A drawn value as a place between 0 and 1, evenly spread under random draws."""
    if space.kind == "log":
        return (math.log(value) - math.log(space.low)) / ((math.log(space.high) - math.log(space.low)) or 1.0)
    return (value - space.low) / ((space.high - space.low) or 1.0)


def guided_params(space: dict[str, Space], seen: Sequence[tuple[dict[str, Any], float]], seed: str) -> dict[str, Any]:
    """Parameters that look more like those of good trials than like those of the others.

    The first ``FIRST_TRIALS`` are random. Then the best quarter of the trials and the rest each give a density: bumps
    around their values, over an even floor. Of ``CANDIDATES`` draws from the good density the one with the largest
    ratio of the two is tried. Every parameter is drawn by itself, and reruns agree.
    """
    rng = random.Random(seed)
    if len(seen) < FIRST_TRIALS:
        return {k: s.draw(rng) for k, s in space.items()}
    order = sorted(range(len(seen)), key=lambda i: (-seen[i][1], i))
    split = max(1, math.ceil(len(seen) / 4))
    good, rest = [seen[i][0] for i in order[:split]], [seen[i][0] for i in order[split:]]
    return {k: _better(s, [p[k] for p in good], [p[k] for p in rest], rng) for k, s in space.items()}


def _better(space: Space, good: list, rest: list, rng: random.Random) -> Any:
    if space.kind == "choice":
        def share(values: list, option: Any) -> float:
            return (values.count(option) + 1.0) / (len(values) + len(space.options))

        weights = [share(good, o) for o in space.options]
        drawn = rng.choices(space.options, weights, k=CANDIDATES)
        return max(drawn, key=lambda o: share(good, o) / share(rest, o))
    near, far = [_unit(space, v) for v in good], [_unit(space, v) for v in rest]

    def density(places: list[float], x: float) -> float:
        width = max(0.05, 1.0 / (1 + len(places)))
        return (1.0 + sum(math.exp(-0.5 * ((x - p) / width) ** 2) / width for p in places)) / (1 + len(places))

    width = max(0.05, 1.0 / (1 + len(near)))
    drawn = [space.draw(rng)]
    for _ in range(CANDIDATES - 1):
        x = min(1.0, max(0.0, rng.gauss(rng.choice(near), width)))
        drawn.append(space.at(x))
    return max(drawn, key=lambda v: density(near, _unit(space, v)) / density(far, _unit(space, v)))


def search(
    df: DataFrame,
    target: str,
    key: Sequence[str],
    models: Sequence[str],
    features: Sequence[str] | None = None,
    problem: str | None = None,
    trials: int = TRIALS,
    folds: int = FOLDS,
    budget_minutes: float = 5.0,
    parallel: int = 2,
    seed: int = SEED,
    job_id: str = "job",
    spaces: dict[str, dict] | None = None,
    guided: bool = True,
    grace: float = 0.0,
) -> SearchResult:
    """Search all ``models``, ``parallel`` at a time; a failing model is listed with its error.

    Every model gets an equal share of the time that is left when it starts and is skipped when less
    than five seconds remain. A trial that is still running at the end of its share is cancelled and counted as
    stopped; the last fit of a model has what is left, ``grace`` seconds more, and five seconds at least. ``guided``
    draws parameters by what earlier trials showed, else at random. ``key`` names the columns that identify a row.
    """
    start = time.time()
    deadline = start + budget_minutes * 60
    problem = problem or problem_type(df, target)
    validate_request(df, target, problem, models, budget_minutes)
    data = TrainingSet.prepare(df, target, key, features, problem, folds, seed)
    # every trial reads the folds: they are prepared once
    splits = [_split(data, data.df.filter(F.col("fold") != i), data.df.filter(F.col("fold") == i)) for i in range(folds)]
    splits = [Split(cut_lineage(s.train), cut_lineage(s.valid), s.shape) for s in splits]
    context = df.sparkSession.sparkContext
    waiting = list(models)

    def run(name: str) -> Outcome:
        left = deadline - time.time()
        share = left * parallel / max(len(waiting), 1)
        waiting.remove(name)
        if left < MIN_SECONDS:
            return Outcome(name, error="skipped: time budget used up")
        context.setLocalProperty("spark.scheduler.pool", name)
        try:
            return _search_one(data, splits, name, trials, min(left, share), seed, (spaces or {}).get(name), guided, grace)
        except Exception as e:  # noqa: BLE001
            return Outcome(name, error=str(e))

    with ThreadPoolExecutor(max(1, parallel)) as pool:
        outcomes = list(pool.map(inheritable_thread_target(df.sparkSession)(run), list(models)))
    return SearchResult(problem, outcomes, job_id, time.time() - start)
