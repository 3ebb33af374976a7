"""Dataset profiling: column statistics, value counts, correlations and histograms."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.operators import order_stats

TOP_VALUES = 5
FEW_VALUES = 20
#: Column pairs of one correlation aggregate: wide ones outgrow generated code and take far longer.
CORRELATION_PAIRS = 8
CATEGORICAL_SHARE = 0.05


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def _is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def _as_text(field: T.StructField) -> Column:
    c = F.col(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return (c + F.lit(0.0)).cast("string")  # -0.0 and 0.0 are one value
    if _is_nested(field.dataType):
        return F.to_json(c)
    return c.cast("string")


def value_counts(df: DataFrame) -> DataFrame:
    """(column, value, n) over all columns; null is a value.

    Each column is counted on its own with its own type: the scan of a branch reads just that
    column, and map-side combine reduces a frequent value to one row per task before the shuffle.
    If ``df`` is an expensive plan rather than a table, write it first (``cut_lineage``).
    """
    parts = None
    for f in df.schema.fields:
        key = _as_text(f) if _is_nested(f.dataType) else F.col(f.name)
        counts = df.groupBy(key.alias(f.name)).agg(F.count(F.lit(1)).alias("n"))
        one = counts.select(F.lit(f.name).alias("column"), (F.col(f.name) if _is_nested(f.dataType) else _as_text(f)).alias("value"), "n")
        parts = one if parts is None else parts.unionByName(one)
    return parts


def distinct_counts(df: DataFrame) -> DataFrame:
    """(column, unique_values): grouped values, counted without turning them into text."""
    parts = None
    for f in df.schema.fields:
        key = _as_text(f) if _is_nested(f.dataType) else F.col(f.name)
        one = df.select(key.alias("v")).distinct().agg(F.count(F.lit(1)).alias("unique_values"))
        one = one.select(F.lit(f.name).alias("__c"), "unique_values")
        parts = one if parts is None else parts.unionByName(one)
    return parts


def scalar_stats(df: DataFrame) -> DataFrame:
    """Count, nulls, mean, std, min and max of every column from one aggregate."""
    aggs, structs = [F.count(F.lit(1)).alias("__rows")], []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f.name)
        aggs.append(F.count(c).alias(f"n{i}"))
        numeric = is_numeric(f.dataType)
        if numeric:
            aggs += [
                F.avg(c).cast("double").alias(f"mean{i}"),
                F.stddev_samp(c).alias(f"std{i}"),
                F.min(c).cast("double").alias(f"min{i}"),
                F.max(c).cast("double").alias(f"max{i}"),
            ]
        empty = F.lit(None).cast("double")
        structs.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.lit(numeric).alias("is_numeric"),
                F.col("__rows").alias("rows"),
                F.col(f"n{i}").alias("non_null"),
                (F.col("__rows") - F.col(f"n{i}")).alias("nulls"),
                *[(F.col(f"{k}{i}") if numeric else empty).alias(k) for k in ("mean", "std", "min", "max")],
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*structs)))


def column_stats(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column; ``unique_values`` counts null as a value.

    ``approx=True`` replaces the exact value-count shuffle by HyperLogLog counts.
    """
    stats = scalar_stats(df)
    if approx:
        found = df.agg(*[F.approx_count_distinct(c).alias(c) for c in df.columns])
        uniq = found.select(
            F.inline(
                F.array(*[F.struct(F.lit(c).alias("__c"), F.col(f"`{c}`").alias("unique_values")) for c in df.columns])
            )
        )
        joined = stats.join(F.broadcast(uniq), F.col("column") == F.col("__c"), "left").drop("__c")
        some_null = (F.col("nulls") > 0).cast("long")
        return joined.withColumn("unique_values", F.coalesce("unique_values", F.lit(0)) + some_null)
    uniq = distinct_counts(df)
    joined = stats.join(F.broadcast(uniq), F.col("column") == F.col("__c"), "left").drop("__c")
    return joined.withColumn("unique_values", F.coalesce("unique_values", F.lit(0).cast("long")))


def top_values(df: DataFrame, k: int = TOP_VALUES) -> DataFrame:
    """The ``k`` most frequent values of text columns and of columns with few values."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    # the distinct counts decide which columns qualify; only those are counted by value
    few = distinct_counts(df.drop(*text)).filter(F.col("unique_values") < FEW_VALUES) if len(text) < len(df.columns) else None
    chosen = set(text) | ({r["__c"] for r in few.collect()} if few is not None else set())  # one row per column
    if not chosen:
        return df.sparkSession.createDataFrame([], "column string, value string, n long, position int")
    counts = value_counts(df.select(*[c for c in df.columns if c in chosen]))
    # the rank filter keeps k rows per column in each task before the shuffle
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_last("value"))
    return counts.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def _per_column(values: dict[str, float | None]) -> Column:
    """The learned value of the column a row describes."""
    known = [x for c, v in values.items() if v is not None for x in (F.lit(c), F.lit(float(v)))]
    return F.try_element_at(F.create_map(*known), F.col("column")) if known else F.lit(None).cast("double")


def sample_values(df: DataFrame, order_by: Sequence[str], k: int = 5) -> DataFrame:
    """The first ``k`` non-null values of each column, by one scan of all columns."""
    at = [F.col(o).alias(f"__o{i}") for i, o in enumerate(order_by)]
    cells = [F.struct(F.lit(f.name).alias("__s"), _as_text(f).alias("value")) for f in df.schema.fields]
    rows = df.select(*at, F.inline(F.array(*cells))).filter(F.col("value").isNotNull())
    # one scan; the rank filter keeps k rows of each column in a task before the shuffle
    place = [f"__o{i}" for i in range(len(order_by))]
    rank = F.row_number().over(Window.partitionBy("__s").orderBy(*place, "value"))
    head = rows.withColumn("__r", rank).filter(F.col("__r") <= k)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("__r", "value"))), lambda s: s["value"])
    found = head.groupBy("__s").agg(texts.alias("samples"))
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "__s string")
    none = F.array().cast("array<string>")
    return names.join(found, "__s", "left").select("__s", F.coalesce("samples", none).alias("samples"))


def profile(df: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
    """The full per-column profile, with exact medians and, given an order, sample values."""
    stats = column_stats(df)
    numeric = numeric_columns(df)
    middle = order_stats.medians(df, numeric) if numeric else {}
    median = _per_column(middle)
    share = F.when(F.col("rows") > 0, F.col("nulls") * 100.0 / F.col("rows")).otherwise(F.lit(0.0))
    out = stats.select(
        "position",
        "column",
        "dtype",
        "rows",
        F.col("nulls").alias("null_count"),
        F.round(share, 2).alias("null_percentage"),
        F.col("unique_values").alias("unique_count"),
        "is_numeric",
        (F.col("unique_values") < F.col("rows") * CATEGORICAL_SHARE).alias("is_categorical"),
        "mean",
        median.alias("median"),
        "std",
        "min",
        "max",
    )
    if order_by:
        samples = sample_values(df, order_by)
        out = out.join(F.broadcast(samples), F.col("column") == F.col("__s"), "left").drop("__s")
    return out


def duplicate_count(df: DataFrame) -> DataFrame:
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"))


#: Bytes of one value by type; texts and binaries add their length to 8 bytes of offset.
WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}


def table_size(df: DataFrame) -> DataFrame:
    """One row per column and its size in memory as plain column buffers: column, bytes. Null values keep their place."""
    sums = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + 8
        elif _is_nested(f.dataType):
            # as the text it is shown as
            size = F.coalesce(F.octet_length(_as_text(f)), F.lit(0)) + 8
        else:
            size = F.lit(16 if kind.startswith("decimal") else WIDTHS.get(kind, 8))
        sums.append(F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias(f"s{len(sums)}"))
    one = df.agg(*sums)
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("bytes")) for i, c in enumerate(df.columns)]
    return one.select(F.inline(F.array(*cells)))


def number_texts(df: DataFrame) -> DataFrame:
    """Text columns whose every known value reads as a number: column, whole (no value has a fraction)."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return df.sparkSession.createDataFrame([], "column string, whole boolean")
    cells = []
    sums = []
    for i, c in enumerate(text):
        value = F.trim(F.col(f"`{c}`"))
        number = value.try_cast("double")
        known = value.isNotNull() & (value != "")
        plain = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
        sums += [F.count_if(known).alias(f"k{i}"), F.count_if(known & plain).alias(f"n{i}"), F.count_if(known & plain & (number == F.floor(number))).alias(f"w{i}")]
        cells.append(F.struct(F.lit(c).alias("column"), F.col(f"k{i}").alias("known"), F.col(f"n{i}").alias("numbers"), (F.col(f"w{i}") == F.col(f"k{i}")).alias("whole")))
    return df.agg(*sums).select(F.inline(F.array(*cells))).filter("known > 0 and numbers = known").select("column", "whole")


def dataset_totals(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"), F.lit(len(df.columns)).cast("long").alias("total_columns")
    )


def _pearson(a: Column, b: Column) -> Column:
    """Correlation over the rows where both are known; null for a constant column, where ``corr`` raises."""
    a, b = a.cast("double"), b.cast("double")
    spread = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_pop(a, b), spread)


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Long form (column_x, column_y, value) of all columns; the upper triangle in aggregates of bounded width."""
    chosen = list(columns or numeric_columns(df))
    schema = "column_x string, column_y string, value double"
    if len(chosen) < 2:
        return df.sparkSession.createDataFrame([], schema)
    pairs = [(i, j) for i in range(len(chosen)) for j in range(i, len(chosen))]
    parts = [pairs[at : at + CORRELATION_PAIRS] for at in range(0, len(pairs), CORRELATION_PAIRS)]
    return functools.reduce(DataFrame.unionByName, [_correlations(df, chosen, part) for part in parts])


def _correlations(df: DataFrame, chosen: Sequence[str], pairs: Sequence[tuple[int, int]]) -> DataFrame:
    row = df.agg(*[_pearson(F.col(chosen[i]), F.col(chosen[j])).alias(f"c{i}_{j}") for i, j in pairs])
    cells = []
    for i, j in pairs:
        raw = F.col(f"c{i}_{j}")
        value = F.round(F.coalesce(F.nanvl(raw, F.lit(None).cast("double")), F.lit(0.0)), 3)
        for x, y in {(i, j), (j, i)}:
            cells.append(
                F.struct(F.lit(chosen[x]).alias("column_x"), F.lit(chosen[y]).alias("column_y"), value.alias("value"))
            )
    return row.select(F.inline(F.array(*cells)))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins with the last one closed; empty bins are kept, nulls dropped."""
    spark = df.sparkSession
    schema = "bin int, bin_start double, bin_end double, n long"
    c = F.col(column).cast("double")
    low, high = df.agg(F.min(c), F.max(c)).first()
    if low is None:
        return spark.createDataFrame([], schema)
    if low == high:
        return df.agg(F.count(column).alias("n")).select(
            F.lit(0).alias("bin"), F.lit(low).alias("bin_start"), F.lit(high).alias("bin_end"), "n"
        )
    width = (high - low) / bins
    edges = [low + i * width for i in range(bins)] + [high]
    # the arithmetic guess can be one off at an edge, so it is corrected by comparing with the edges
    guess = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((c - F.lit(low)) / F.lit(width)).cast("int")))
    start = F.lit(low) + guess * F.lit(width)
    end = F.lit(low) + (guess + 1) * F.lit(width)
    place = F.when(c < start, guess - 1).when((c >= end) & (guess < bins - 1), guess + 1).otherwise(guess)
    counts = df.filter(c.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    at = F.lit(edges)
    frame = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        F.element_at(at, F.col("bin") + 1).alias("bin_start"),
        F.element_at(at, F.col("bin") + 2).alias("bin_end"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
    )


def category_counts(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """The ``k`` most frequent non-null values."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(column)).limit(k)


def quantile_table(df: DataFrame, columns: Sequence[str], shares: Sequence[float], approx: bool = False) -> DataFrame:
    found = order_stats.nearest_quantiles(df, {c: list(shares) for c in columns}, approx)
    rows = [(c, float(q), found[c][q]) for c in columns for q in shares]
    return df.sparkSession.createDataFrame(rows, "column string, q double, value double")


def feature_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Min, max, mean, median and std of each numeric column; std is 0 below two values."""
    chosen = list(columns or numeric_columns(df))
    middle = order_stats.medians(df, chosen)
    median = _per_column(middle)
    stats = scalar_stats(df.select(*chosen))
    return stats.select(
        "column",
        "min",
        "max",
        "mean",
        median.alias("median"),
        F.when(F.col("non_null") > 1, F.col("std")).otherwise(F.lit(0.0)).alias("std"),
    )


def outlier_counts(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Rows outside the interquartile fences, with the median, per column."""
    wanted = {
        c: (lambda n: [*order_stats.median_ranks(n), order_stats.nearest_rank(n, 0.25), order_stats.nearest_rank(n, 0.75)])
        for c in columns
    }
    found = order_stats.order_statistics(df, wanted)
    aggs, structs = [], []
    for i, c in enumerate(columns):
        n, values = found[c]
        if n:
            q1, q3 = values[order_stats.nearest_rank(n, 0.25)], values[order_stats.nearest_rank(n, 0.75)]
            middle = (values[(n - 1) // 2] + values[n // 2]) / 2
            low, high = q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)
            aggs.append(F.count_if((F.col(c) < F.lit(low)) | (F.col(c) > F.lit(high))).alias(f"o{i}"))
        else:
            low = high = middle = math.nan
            aggs.append(F.lit(0).cast("long").alias(f"o{i}"))
        structs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(low).alias("lower"),
                F.lit(high).alias("upper"),
                F.lit(middle).alias("median"),
                F.col(f"o{i}").alias("outliers"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*structs)))


def preview(df: DataFrame, order_by: Sequence[str], n: int = 20) -> DataFrame:
    return df.orderBy(*order_by).limit(n)
