"""Column sketches that are kept for each part of a dataset and merged for any choice of parts.

A part's sketches are made by one pass over it. Counts, nulls, least and largest values merge exactly, distinct values by
HyperLogLog and quantiles by KLL sketches, so a profile of a year of daily parts reads a few hundred rows and no data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.operators.profiling import is_numeric

#: Base-2 logarithm of the HyperLogLog registers, and the accuracy of the KLL sketches.
REGISTERS, ACCURACY = 12, 400
#: Relative error of distinct counts, and error of a quantile's rank as a share of the rows; each at least 99 % sure.
DISTINCT_ERROR, RANK_ERROR = 0.05, 0.0133


def _name(c: str) -> Column:
    return F.col(f"`{c}`")


def build(df: DataFrame, by: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """One row for each part (values of ``by``) and column: column, rows, nulls, low, high, distinct_sketch, quantile_sketch.

    Least and largest values and quantiles are those of numeric columns, null for others; NaN counts as null.
    """
    chosen = [c for c in (columns or df.columns) if c not in by]
    aggs, cells = [], []
    none = F.lit(None)
    for i, c in enumerate(chosen):
        kind = df.schema[c].dataType
        numeric = is_numeric(kind)
        value = F.nanvl(_name(c).cast("double"), none.cast("double")) if numeric else _name(c)
        known = value if numeric else _name(c)
        text = _name(c) if isinstance(kind, (T.IntegerType, T.LongType, T.StringType)) else F.when(known.isNotNull(), _name(c).cast("string"))
        aggs += [F.count("*").alias(f"n{i}"), F.count(known).alias(f"k{i}"), F.hll_sketch_agg(text, F.lit(REGISTERS)).alias(f"d{i}")]
        if numeric:
            aggs += [F.min(value).alias(f"l{i}"), F.max(value).alias(f"h{i}"), F.kll_sketch_agg_double(value, F.lit(ACCURACY)).alias(f"q{i}")]
        low, high, quantile = (F.col(f"{p}{i}") if numeric else none for p in "lhq")
        cells.append(
            F.struct(
                F.lit(c).alias("column"), F.col(f"n{i}").alias("rows"), (F.col(f"n{i}") - F.col(f"k{i}")).alias("nulls"), low.cast("double").alias("low"),
                high.cast("double").alias("high"), F.col(f"d{i}").alias("distinct_sketch"), quantile.cast("binary").alias("quantile_sketch"),
            )
        )
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*cells)))


def add_parts(df: DataFrame, path: str, by: Sequence[str], columns: Sequence[str] | None = None) -> None:
    """Sketch the parts in ``df`` and keep them below ``path``; parts that come again replace what was kept of them."""
    made = build(df, by, columns)
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def merge(parts: DataFrame, shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The profile of all given parts together: column, rows, nulls, low, high, distinct, and one column for each share."""
    known = F.when(F.col("rows") > F.col("nulls"), F.col("quantile_sketch"))
    out = parts.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct"), F.kll_merge_agg_double(known).alias("__q"), F.count(known).alias("__k"),
    )
    quantiles = [F.when(F.col("__k") > 0, F.kll_sketch_get_quantile_double("__q", F.lit(float(s)))).alias(f"q{s:g}") for s in shares]
    return out.select("column", "rows", "nulls", "low", "high", "distinct", *quantiles)
