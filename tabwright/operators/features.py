"""Feature preparation with a strict fit / transform split, hash splits and folds."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.operators import layout, order_stats
from tabwright.operators.cleaning import Dictionary, category_index, look_up

MAX_ONEHOT = 50
MISSING = "MISSING"
FOLDS = 5
FEW_LABELS = 32
#: Rows of one label that a fold bucket holds.
BUCKET_ROWS = 50_000
TEST_PERCENT = 20


@dataclass(frozen=True)
class Roles:
    numeric: tuple[str, ...]
    low_card: tuple[str, ...]
    high_card: tuple[str, ...]
    unsupported: tuple[str, ...] = ()
    distinct: dict[str, int] = field(default_factory=dict)

    @property
    def categorical(self) -> tuple[str, ...]:
        return self.low_card + self.high_card


def column_roles(df: DataFrame, columns: Sequence[str] | None = None, limit: int = MAX_ONEHOT) -> Roles:
    """Numeric (booleans count as numbers), low- and high-cardinality text; dates are unsupported."""
    numeric, text, other = [], [], []
    for f in df.schema.fields:
        if columns is not None and f.name not in columns:
            continue
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            numeric.append(f.name)
        elif isinstance(f.dataType, T.StringType):
            text.append(f.name)
        else:
            other.append(f.name)
    sizes: dict[str, int] = {}
    if text:
        counts = _value_counts(df, text).groupBy("column").agg(F.count(F.lit(1)).alias("n"))
        sizes = {c: 0 for c in text} | {r["column"]: r["n"] for r in counts.collect()}  # one row per column
    low = tuple(c for c in text if sizes[c] <= limit)
    high = tuple(c for c in text if sizes[c] > limit)
    return Roles(tuple(numeric), low, high, tuple(other), sizes)


def _value_counts(df: DataFrame, text: Sequence[str]) -> DataFrame:
    """(column, value, n) of the non-null values; each branch scans one column."""
    parts = None
    for c in text:
        one = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        one = one.select(F.lit(c).alias("column"), "value", "n")
        parts = one if parts is None else parts.unionByName(one)
    return parts


def roles_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    roles = column_roles(df, columns)
    rows = [(c, "numeric") for c in roles.numeric]
    rows += [(c, "low_card") for c in roles.low_card] + [(c, "high_card") for c in roles.high_card]
    rows += [(c, "unsupported") for c in roles.unsupported]
    return df.sparkSession.createDataFrame(rows, "column string, role string")


def _number(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    c = c.cast("double")
    return F.nanvl(c, F.lit(None).cast("double"))


@dataclass
class FeaturePrep:
    """What ``fit_features`` learned; ``transform`` adds no pass over the data and works on streams."""

    inputs: list[str]
    medians: dict[str, float]
    modes: dict[str, str]
    categories: dict[str, list[str]]
    feature_names: list[str]
    distinct: dict[str, int]
    dictionaries: dict[str, Dictionary] = field(default_factory=dict, repr=False)

    def transform(self, df: DataFrame) -> DataFrame:
        """Keep all columns that are no inputs and replace the inputs by the fitted features.

        Inputs missing from ``df`` count as missing values; unknown columns pass through.
        """
        taken = set(self.inputs)
        keep = [c for c in df.columns if c not in taken]
        out = df
        for c in self.inputs:
            if c not in df.columns:
                kind = "double" if c in self.medians else "string"
                out = out.withColumn(c, F.lit(None).cast(kind))
        made: dict[str, Column] = {}
        filled = {}
        for c, mode in self.modes.items():
            filled[c] = F.coalesce(F.col(c).cast("string"), F.lit(mode))
        for c, book in self.dictionaries.items():
            out = out.withColumn(f"__k_{c}", filled[c])
            out = look_up(out, f"__k_{c}", book, f"__i_{c}", unseen=-1)
            made[c] = F.col(f"__i_{c}").cast("double")
        for c, median in self.medians.items():
            made[c] = F.coalesce(_number(F.col(c), out.schema[c].dataType), F.lit(median))
        for c, values in self.categories.items():
            for value in values[1:]:
                made[f"{c}_{value}"] = (filled[c] == F.lit(value)).cast("double")
        return out.select(*[F.col(c) for c in keep], *[made[n].alias(n) for n in self.feature_names])

    def metadata(self) -> dict[str, Any]:
        plain = {k: v for k, v in self.__dict__.items() if k != "dictionaries"}
        return {**plain, "dictionary_sizes": {c: d.size for c, d in self.dictionaries.items()}}

    def save(self, spark, path: str) -> None:
        """Metadata as JSON and one parquet table per dictionary under ``path``."""
        spark.createDataFrame([(json.dumps(self.metadata()),)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{path}/metadata"
        )
        for i, c in enumerate(self.dictionaries):
            self.dictionaries[c].table.write.mode("overwrite").parquet(f"{path}/dictionary-{i}")

    @staticmethod
    def load(spark, path: str) -> FeaturePrep:
        data = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        sizes = data.pop("dictionary_sizes")
        books = {
            c: Dictionary(spark.read.parquet(f"{path}/dictionary-{i}"), n) for i, (c, n) in enumerate(sizes.items())
        }
        return FeaturePrep(**data, dictionaries=books)


def fit_features(
    df: DataFrame, columns: Sequence[str], limit: int = MAX_ONEHOT, mode_fallback_only: bool = False
) -> FeaturePrep:
    """Learn medians, modes, one-hot categories and dictionaries from ``df``.

    ``mode_fallback_only`` fills every missing category with the fallback word, as the
    single-model path does.
    """
    roles = column_roles(df, columns, limit)
    if roles.unsupported:
        raise ValueError(f"cannot use as features: {', '.join(roles.unsupported)}")
    numbers = df.select(*[_number(F.col(c), df.schema[c].dataType).alias(c) for c in roles.numeric])
    medians = order_stats.medians(numbers, list(roles.numeric)) if roles.numeric else {}
    modes, categories = {}, {}
    if roles.categorical:
        counts = _value_counts(df, roles.categorical)
        w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
        top = counts.withColumn("r", F.row_number().over(w)).filter("r = 1")
        found = {r["column"]: r["value"] for r in top.collect()}  # one row per column
        modes = {c: MISSING if mode_fallback_only else found.get(c, MISSING) for c in roles.categorical}
        if roles.low_card:
            # at most ``limit`` rows per low-cardinality column
            rows = counts.filter(F.col("column").isin(list(roles.low_card))).select("column", "value").collect()
            for c in roles.low_card:
                seen = {r["value"] for r in rows if r["column"] == c}
                if mode_fallback_only or not seen:
                    seen.add(modes[c])
                categories[c] = sorted(seen)
    books = {}
    for c in roles.high_card:
        values = df.select(F.coalesce(F.col(c), F.lit(modes[c])).alias(c))
        books[c] = category_index(values, c)
    plain = [c for c in columns if c in roles.numeric or c in roles.high_card]
    names = plain + [f"{c}_{v}" for c in columns if c in categories for v in categories[c][1:]]
    fitted = {c: (0.0 if m is None else float(m)) for c, m in medians.items()}
    return FeaturePrep(list(columns), fitted, modes, categories, names, roles.distinct, books)


def align_features(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the fitted features in order: missing ones as 0, others dropped."""
    cols = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) if n in df.columns else F.lit(0.0).alias(n) for n in names]
    return df.select(*keep, *cols)


def problem_type(df: DataFrame, target: str) -> str:
    """Text is classification; so are at most 20 distinct values below 5 % of the rows."""
    if isinstance(df.schema[target].dataType, (T.StringType, T.BooleanType)):
        return "classification"
    # 21 values settle the question, so the distinct list never has to be complete
    seen = df.select(target).filter(F.col(target).isNotNull()).distinct().limit(21).count()
    rows = df.count()
    return "classification" if seen <= 20 and seen < rows * 0.05 else "regression"


@dataclass(frozen=True)
class TargetLabels:
    """Sorted class labels; the index of a label is its class number."""

    labels: tuple[Any, ...]

    def encode(self, df: DataFrame, column: str, into: str) -> DataFrame:
        """Add the class number; many labels are looked up in a table, which Spark hashes, not searched in a list."""
        if len(self.labels) > FEW_LABELS:
            kind = T.StructType([T.StructField("__label", df.schema[column].dataType), T.StructField(into, T.DoubleType())])
            book = df.sparkSession.createDataFrame([(v, float(i)) for i, v in enumerate(self.labels)], kind)
            return df.join(book, F.col(column) == F.col("__label"), "left").select(*df.columns, into)
        at = F.array_position(F.array(*[F.lit(v) for v in self.labels]), F.col(column))
        return df.withColumn(into, F.when(at > 0, (at - 1).cast("double")))

    def decode(self, index: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in self.labels]), index.cast("int") + 1)


def target_labels(df: DataFrame, column: str, limit: int | None = None) -> TargetLabels:
    """All labels, as a model needs its classes; ``limit`` refuses more than so many."""
    found = df.filter(F.col(column).isNotNull()).select(column).distinct()
    rows = (found if limit is None else found.limit(limit + 1)).collect()
    if limit is not None and len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} classes")
    return TargetLabels(tuple(sorted(r[0] for r in rows)))


# --- reproducible samples, splits and folds --------------------------------------------------


def hash_text(key: Sequence[str], seed: int = 42) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def hash_percent(key: Sequence[str], seed: int = 42) -> Column:
    return F.conv(F.substring(hash_text(key, seed), 1, 8), 16, 10).cast("long") % 100


def train_test(df: DataFrame, key: Sequence[str], test_percent: int = TEST_PERCENT, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """A split that depends only on the row key, not on partitioning."""
    share = hash_percent(key, seed)
    return df.filter(share >= test_percent), df.filter(share < test_percent)


def sample_exact(df: DataFrame, key: Sequence[str], n: int = 100_000, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all): the smallest hashes, as a bounded top-n.

    Rows whose hash lies clearly above the expected cut are dropped before the sort, and the
    result is checked to hold enough rows.
    """
    h = hash_text(key, seed)
    total = df.count()
    if total <= n:
        return df
    share = n / total
    cut = min(1.0, share + 8 * (share * (1 - share) / total) ** 0.5 + 1e-6)
    near = df.filter(F.conv(F.substring(h, 1, 8), 16, 10).cast("long") < F.lit(int(cut * 2**32)))
    if near.count() < n:
        near = df
    ranked = layout.row_numbers(near.withColumn("__h", h), "__r", ["__h", *key])
    return ranked.filter(F.col("__r") <= n).drop("__r", "__h")


def stratified_folds(
    df: DataFrame, label: str | None, key: Sequence[str], k: int = FOLDS, into: str = "fold", seed: int = 42
) -> DataFrame:
    """Folds 0..k-1 dealt out in hash order inside each label, so sizes differ by at most one.

    The first hash digits are a ready-made bucket in sort order: windows work per (label, bucket)
    and a table of bucket sizes gives the offsets, so a label with most rows stays parallel.
    """
    h = hash_text(key, seed)
    digits = _bucket_digits(df.count())
    tagged = df.withColumn("__h", h).withColumn("__p", F.substring("__h", 1, digits))
    # a key without nulls lets the join use the partitioning of the window
    text = F.concat(F.lit("="), F.col(label).cast("string")) if label else F.lit("")
    tagged = tagged.withColumn("__g", F.coalesce(text, F.lit("null")))
    on = ["__g", "__p"]
    w = Window.partitionBy(*on).orderBy("__h", *key)
    local = tagged.withColumn("__r", F.row_number().over(w).cast("long"))
    sizes = tagged.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    across = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(across), F.lit(0))).drop("__n")
    joined = local.join(starts, on)
    fold = ((F.col("__r") + F.col("__before") - 1) % k).cast("int")
    return joined.select(*df.columns, fold.alias(into))


def _bucket_digits(rows: int) -> int:
    """So many hash digits that even a label with all rows has at most ``BUCKET_ROWS`` in a bucket, on average."""
    digits = 1
    while rows > BUCKET_ROWS * 16**digits:
        digits += 1
    return digits
