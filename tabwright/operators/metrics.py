"""Exact model metrics, rankings and comparisons as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.operators import layout
from tabwright.session import cut_lineage


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def confusion_cells(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(df: DataFrame, label: str, prediction: str, classes: Sequence) -> DataFrame:
    """One row per actual class and one column per predicted class of the given list."""
    cells = confusion_cells(df, label, prediction)
    return cells.groupBy("actual").agg(
        *[F.coalesce(F.sum(F.when(F.col("predicted") == F.lit(c), F.col("n"))), F.lit(0)).alias(f"predicted_{c}") for c in classes]
    )


def weighted_scores(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Support-weighted precision, recall and F1; a class without predictions scores 0."""
    cells = confusion_cells(df, label, prediction)
    by_actual = cells.groupBy(F.col("actual").alias("c")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))).alias("tp")
    )
    by_predicted = cells.groupBy(F.col("predicted").alias("c")).agg(F.sum("n").alias("claimed"))
    per = by_actual.join(by_predicted, "c", "left").select(
        "support", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("claimed", F.lit(0)).alias("claimed")
    )
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("claimed")), F.lit(0.0))
    recall = F.col("tp") / F.col("support")
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    per = per.withColumn("p", precision).withColumn("r", recall).withColumn("f", f1)
    total = F.sum("support")
    return per.agg(
        (F.sum(F.col("p") * F.col("support")) / total).alias("precision"),
        (F.sum(F.col("r") * F.col("support")) / total).alias("recall"),
        (F.sum(F.col("f") * F.col("support")) / total).alias("f1"),
    )


def roc_auc(df: DataFrame, label: str, score: str, target_rows: int | None = None) -> DataFrame:
    """Exact area under the curve for 0/1 labels; equal scores count half.

    Rows are first reduced to one per score; the running count of negatives then moves over
    score buckets instead of one sorted task.
    """
    per = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    # the ordered steps need several passes: aggregate the rows only once
    per = cut_lineage(per)
    run = layout.running_sums(per, {"neg_upto": "neg"}, score, (), target_rows)
    below = F.col("neg_upto") - F.col("neg")
    won = F.sum(F.col("pos") * (below + F.col("neg") / 2.0))
    return run.agg(F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def regression_scores(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """RMSE, MAE and R2 in one aggregate; the total spread comes from the population variance."""
    y = F.col(label).cast("double")
    e = y - F.col(prediction)
    sse, n = F.sum(e * e), F.count(e)
    sst = F.var_pop(F.when(e.isNotNull(), y)) * n
    return df.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(sse, sst)).alias("r2")
    )


def rank_importance(df: DataFrame, by: Sequence[str], name: str, value: str, k: int | None = None) -> DataFrame:
    """Largest absolute importance first inside each model; ``k`` keeps the top of each list."""
    order = [layout.Key("importance", True), layout.Key(name)]
    out = df.withColumn("importance", F.abs(F.col(value)))
    if k is None:
        return layout.row_numbers(out, "position", order, by)
    w = Window.partitionBy(*by).orderBy(*[o.sort() for o in order])
    return out.withColumn("position", F.row_number().over(w).cast("long")).filter(F.col("position") <= k)


def leaderboard(df: DataFrame, by: Sequence[str], metric: str, tie: Sequence[str]) -> DataFrame:
    """Rank 1..n inside each job, best metric first and a missing metric as 0."""
    out = df.withColumn("__m", F.coalesce(F.col(metric), F.lit(0.0)))
    ranked = layout.row_numbers(out, "position", [layout.Key("__m", True), *[layout.Key(t) for t in tie]], by)
    return ranked.drop("__m")


def best_model(df: DataFrame, by: Sequence[str], metric: str, tie: Sequence[str]) -> DataFrame:
    """The first maximum per job; the rank filter keeps one row per job in each map task."""
    order = [F.coalesce(F.col(metric), F.lit(0.0)).desc(), *[F.col(t).asc() for t in tie]]
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


COMPARED_METRICS = ("accuracy", "f1_score", "precision", "recall", "auc")


def compare_models(df: DataFrame, ids: Sequence, key: str, metrics: Sequence[str] = COMPARED_METRICS) -> DataFrame:
    """The best of two to five models per metric; higher is better and missing values do not compete."""
    if not 2 <= len(set(ids)) <= 5:
        raise ValueError("compare two to five models")
    chosen = df.filter(F.col(key).isin(list(ids)))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    rows = chosen.select(key, F.inline(cells)).filter(F.col("value").isNotNull())
    best = rows.groupBy("metric").agg(F.min(F.struct((-F.col("value")).alias("v"), F.col(key).alias("id"))).alias("b"))
    return best.select("metric", F.col("b.id").alias("best_id"), (-F.col("b.v")).alias("best_value"))


def _present(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def display_scores(df: DataFrame) -> DataFrame:
    """Scores on a 0-100 scale; regression maps its errors and a classifier falls back to accuracy."""
    r2, rmse, mae = F.col("r2"), F.col("rmse"), F.col("mae")
    zero = F.lit(0.0)
    regression = r2.isNotNull()

    def from_error(c: Column) -> Column:
        return F.when(_present(c).isNull(), zero).otherwise(F.greatest(zero, 100.0 - c * 10.0))

    def from_class(*cs: Column) -> Column:
        return F.coalesce(*[_present(c) for c in cs], zero) * 100.0

    from_r2 = F.when(_present(r2).isNull(), zero).otherwise(F.greatest(zero, r2 * 100.0))
    acc = F.col("accuracy")
    return df.select(
        *[c for c in df.columns if c not in ("accuracy", "precision", "recall", "f1_score", "r2", "rmse", "mae")],
        F.when(regression, from_r2).otherwise(from_class(acc)).alias("accuracy"),
        F.when(regression, from_error(rmse)).otherwise(from_class(F.col("precision"), acc)).alias("precision"),
        F.when(regression, from_error(mae)).otherwise(from_class(F.col("recall"), acc)).alias("recall"),
        F.when(regression, from_r2).otherwise(from_class(F.col("f1_score"), acc)).alias("f1"),
        regression.alias("is_regression"),
    )


def latest_results(df: DataFrame, created: str, scores: Sequence[str], tie: Sequence[str], n: int) -> DataFrame:
    """Newest first, then the first non-zero score; a bounded top-n."""
    score = F.coalesce(*[_present(F.col(s)) for s in scores], F.lit(0.0))
    return df.orderBy(F.col(created).desc(), score.desc(), *[F.col(t).asc() for t in tie]).limit(n)


def hyperparameters(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """One row per hyper-parameter of a JSON text column."""
    parsed = F.from_json(F.col(column), "map<string,string>")
    return df.select(*keep, F.explode(parsed).alias("name", "value"))
