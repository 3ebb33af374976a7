"""The whitelisted cleaning operations, their fitted form and the chain that applies them.

An operation is a small record. ``fit`` collects what it has to learn from the data (means,
quantiles, categories) and ``Fitted.apply`` is a pure DataFrame step that can be used again on new
or streaming data. Operations that follow each other and do not change each other's input are
fitted together, so their statistics share passes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.convert import cast_column
from tabwright.functions.text import STRING_OPS, apply_string_ops
from tabwright.operators import layout, order_stats
from tabwright.session import cut_lineage


# Names of strategies and methods, as requests give them.
FILL_STRATEGIES = ("mean", "median", "mode", "forward", "backward", "constant", "interpolate")
OUTLIER_METHODS = ("iqr", "zscore", "percentile")


class CleaningError(ValueError):
    pass


# --- statistics ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Need:
    """One statistic: ``kind`` of ``column``; ``q`` is the share of a quantile, or the most categories."""

    column: str
    kind: str
    q: float | None = None


def collect_needs(df: DataFrame, needs: Sequence[Need]) -> dict[Need, Any]:
    """All statistics of one input: one aggregate, one selection, then one count per category column."""
    found: dict[Need, Any] = {}
    plain = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wanted = [n for n in dict.fromkeys(needs) if n.kind in plain or n.kind == "nulls"]
    if wanted:
        columns = []
        for i, n in enumerate(wanted):
            if n.kind == "nulls":
                value = F.try_divide(F.count_if(F.col(n.column).isNull()), F.count(F.lit(1)))
            else:
                value = plain[n.kind](F.col(n.column)).cast("double")
            columns.append(value.alias(f"s{i}"))
        row = df.agg(*columns).first()
        found.update({n: row[f"s{i}"] for i, n in enumerate(wanted)})
    ranked = [n for n in dict.fromkeys(needs) if n.kind in ("median", "quantile")]
    if ranked:
        by_column: dict[str, list[Need]] = {}
        for n in ranked:
            by_column.setdefault(n.column, []).append(n)

        def ranks(mine: list[Need]):
            def of(n: int) -> list[int]:
                out: list[int] = []
                for need in mine:
                    out += order_stats.median_ranks(n) if need.kind == "median" else [
                        order_stats.nearest_rank(n, need.q)
                    ]
                return out

            return of

        stats = order_stats.order_statistics(df, {c: ranks(mine) for c, mine in by_column.items()})
        for n in ranked:
            size, values = stats[n.column]
            if not size:
                found[n] = None
            elif n.kind == "median":
                found[n] = (values[(size - 1) // 2] + values[size // 2]) / 2
            else:
                found[n] = values[order_stats.nearest_rank(size, n.q)]
    for n in dict.fromkeys(needs):
        if n.kind == "mode":
            found[n] = order_stats.modes(df, [n.column])[n.column]
        elif n.kind == "categories":
            # every category becomes a column of the schema, which the driver has to know
            values = df.select(n.column).distinct()
            rows = (values if n.q is None else values.limit(n.q + 1)).collect()
            if n.q is not None and len(rows) > n.q:
                raise CleaningError(f"{n.column} has more than {n.q} values")
            found[n] = sorted((r[0] for r in rows), key=lambda v: (v is not None, v))
        elif n.kind == "dictionary":
            found[n] = category_index(df, n.column)
    return found


@dataclass(frozen=True)
class Dictionary:
    """Sorted distinct values with their 0-based index, as a two-column table."""

    table: DataFrame
    size: int


def category_index(df: DataFrame, column: str, skip_null: bool = False) -> Dictionary:
    values = df.select(F.col(column).alias("value")).distinct()
    if skip_null:
        values = values.filter(F.col("value").isNotNull())
    # ordering takes several passes and the table is joined later: collect the distinct values once
    values = cut_lineage(values)
    indexed = layout.row_numbers(values, "position", "value")
    indexed = cut_lineage(indexed.select("value", (F.col("position") - 1).alias("position")))
    return Dictionary(indexed, values.count())


def look_up(df: DataFrame, column: str, book: Dictionary, into: str, unseen: int | None = None) -> DataFrame:
    """Add ``into``: the index of ``column``. Spark picks the join by the size of the written table."""
    right = book.table.select(F.col("value").alias("__value"), F.col("position").alias("__position"))
    joined = df.join(right, F.col(column).eqNullSafe(F.col("__value")), "left")
    found = F.col("__position") if unseen is None else F.coalesce(F.col("__position"), F.lit(unseen).cast("long"))
    return joined.withColumn("__index", found).select(
        *[F.col("__index").alias(c) if c == into else F.col(c) for c in df.columns],
        *([] if into in df.columns else [F.col("__index").alias(into)]),
    )


# --- operations ---------------------------------------------------------------------------


@dataclass(frozen=True)
class CleaningOp:
    """Base record. ``changes_rows`` and ``touched`` tell the chain which fits may be shared."""

    description: str = field(default="", kw_only=True)
    confidence: float = field(default=0.8, kw_only=True)

    operation = ""
    changes_rows = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "confidence", max(0.0, min(1.0, float(self.confidence))))
        self.validate()

    def validate(self) -> None:
        pass

    def reads(self) -> list[str]:
        column = getattr(self, "column", None)
        return [column] if column else list(getattr(self, "columns", None) or [])

    def check(self, df: DataFrame) -> None:
        for c in self.reads():
            if c not in df.columns:
                raise CleaningError(f"column {c!r} not found")

    def needs(self, df: DataFrame) -> list[Need]:
        return []

    def reshuffles(self) -> bool:
        """Whether ``apply`` moves rows, so that several passes above it should start from a written table."""
        return False

    def apply(self, df: DataFrame, stats: dict[Need, Any]) -> DataFrame:
        raise NotImplementedError


def _replace(df: DataFrame, column: str, value: Column) -> DataFrame:
    return df.select(*[value.alias(c) if c == column else F.col(c) for c in df.columns])


def _number(df: DataFrame, column: str) -> None:
    if not isinstance(df.schema[column].dataType, T.NumericType):
        raise CleaningError(f"column {column!r} is not numeric")


@dataclass(frozen=True)
class FillMissing(CleaningOp):
    column: str
    strategy: str = "mean"
    fill_value: Any = None
    order_by: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()

    operation = "fill_missing"

    def validate(self) -> None:
        if self.strategy not in FILL_STRATEGIES:
            raise CleaningError(f"unknown fill strategy: {self.strategy}")
        if self.strategy == "constant" and self.fill_value is None:
            raise CleaningError("the constant strategy needs fill_value")
        if self.strategy in ("forward", "backward", "interpolate") and not self.order_by:
            raise CleaningError(f"the {self.strategy} strategy depends on row order: pass order_by")

    def check(self, df: DataFrame) -> None:
        super().check(df)
        if self.strategy in ("mean", "median", "interpolate"):
            _number(df, self.column)

    def needs(self, df: DataFrame) -> list[Need]:
        if self.strategy in ("mean", "median", "mode"):
            return [Need(self.column, self.strategy)]
        return []

    def reshuffles(self) -> bool:
        return self.strategy in ("forward", "backward", "interpolate")

    def apply(self, df: DataFrame, stats: dict[Need, Any]) -> DataFrame:
        c, dtype = F.col(self.column), df.schema[self.column].dataType
        if self.strategy in ("mean", "median"):
            value = stats[Need(self.column, self.strategy)]
            return _replace(df, self.column, F.coalesce(c.cast("double"), F.lit(value).cast("double")))
        if self.strategy == "mode":
            return _replace(df, self.column, F.coalesce(c, F.lit(stats[Need(self.column, "mode")]).cast(dtype)))
        if self.strategy == "constant":
            return _replace(df, self.column, F.coalesce(c, F.lit(self.fill_value).cast(dtype)))
        if self.strategy == "interpolate":
            return interpolate(df, self.column, self.order_by, self.partition_by)
        order = layout.keys(self.order_by)
        if self.strategy == "backward":
            order = [k.reverse() for k in order]
        filled = layout.carry_forward(df, {"__filled": c}, order, self.partition_by)
        return _replace(filled, self.column, F.col("__filled")).drop("__filled")


def interpolate(
    df: DataFrame,
    column: str,
    order_by: Sequence[str | layout.Key],
    partition_by: Sequence[str] = (),
    target_rows: int | None = None,
) -> DataFrame:
    """Linear by row position between the neighbouring known values; the ends stay null."""
    out = layout.neighbours(df, F.col(column).cast("double"), order_by, partition_by, target_rows)
    step = F.try_divide(F.col("__hi.v") - F.col("__lo.v"), F.col("__hi.at") - F.col("__lo.at"))
    between = F.col("__lo.v") + step * (F.col("__at") - F.col("__lo.at"))
    value = F.coalesce(F.col(column).cast("double"), between)
    return _replace(out, column, value).drop("__at", "__lo", "__hi")


@dataclass(frozen=True)
class DropMissing(CleaningOp):
    axis: str = "rows"
    threshold: float | None = None
    columns: tuple[str, ...] = ()

    operation = "drop_missing"

    @property
    def changes_rows(self) -> bool:  # type: ignore[override]
        return self.axis == "rows"

    def validate(self) -> None:
        if self.axis not in ("rows", "columns"):
            raise CleaningError("axis must be 'rows' or 'columns'")

    def needs(self, df: DataFrame) -> list[Need]:
        return [Need(c, "nulls") for c in df.columns] if self.axis == "columns" else []

    def apply(self, df: DataFrame, stats: dict[Need, Any]) -> DataFrame:
        if self.axis == "rows":
            cond = F.lit(True)
            for c in self.columns or df.columns:
                cond = cond & F.col(c).isNotNull()
            return df.filter(cond)
        limit = self.threshold or 0.0
        return df.select(*[c for c in df.columns if (stats.get(Need(c, "nulls")) or 0.0) <= limit])


@dataclass(frozen=True)
class DropDuplicates(CleaningOp):
    columns: tuple[str, ...] = ()
    keep: str = "first"
    order_by: tuple[str, ...] = ()

    operation = "drop_duplicates"
    changes_rows = True

    def validate(self) -> None:
        if self.keep not in ("first", "last", "none"):
            raise CleaningError("keep must be 'first', 'last' or 'none'")
        if self.columns and self.keep != "none" and not self.order_by:
            raise CleaningError(f"keep={self.keep!r} on some columns depends on row order: pass order_by")

    def reshuffles(self) -> bool:
        return True

    def apply(self, df: DataFrame, stats: dict[Need, Any]) -> DataFrame:
        by = list(self.columns) or df.columns
        if set(by) == set(df.columns):
            if self.keep != "none":
                return df.distinct()
            return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n")).filter("__n = 1").drop("__n")
        if self.keep == "none":
            rest = [c for c in df.columns if c not in by]
            one = df.groupBy(*by).agg(
                F.count(F.lit(1)).alias("__n"), F.any_value(F.struct(*rest)).alias("__rest")
            )
            return one.filter("__n = 1").select(
                *[F.col(f"__rest.`{c}`").alias(c) if c in rest else F.col(c) for c in df.columns]
            )
        order = layout.keys(self.order_by)
        if self.keep == "last":
            order = [k.reverse() for k in order]
        # Spark keeps one row per key in each map task before the shuffle (WindowGroupLimit)
        w = Window.partitionBy(*by).orderBy(*[k.sort() for k in order])
        return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


@dataclass(frozen=True)
class CastType(CleaningOp):
    column: str
    target_type: str = "string"
    date_format: str | None = None
    on_error: str = "raise"

    operation = "cast_type"

    def apply(self, df: DataFrame, stats: dict[Need, Any]) -> DataFrame:
        return _replace(
            df, self.column, cast_column(df, self.column, self.target_type, self.date_format, self.on_error == "raise")
        )


@dataclass(frozen=True)
class RemoveOutliers(CleaningOp):
    column: str
    method: str = "iqr"
    threshold: float = 1.5
    percentile_range: tuple[float, float] | None = None

    operation = "remove_outliers"
    changes_rows = True

    def validate(self) -> None:
        if self.method not in OUTLIER_METHODS:
            raise CleaningError(f"unknown outlier method: {self.method}")

    def check(self, df: DataFrame) -> None:
        super().check(df)
        _number(df, self.column)

    def _shares(self) -> tuple[float, float]:
        return (0.25, 0.75) if self.method == "iqr" else tuple(self.percentile_range or (0.01, 0.99))

    def needs(self, df: DataFrame) -> list[Need]:
        if self.method == "zscore":
            return [Need(self.column, "mean"), Need(self.column, "std")]
        return [Need(self.column, "quantile", q) for q in self._shares()]

    def apply(self, df: DataFrame, stats: dict[Need, Any]) -> DataFrame:
        c = F.col(self.column)
        if self.method == "zscore":
            mean, std = stats[Need(self.column, "mean")], stats[Need(self.column, "std")]
            if not std:
                return df.filter(F.lit(False))
            return df.filter(F.abs(c - F.lit(mean)) / F.lit(std) <= F.lit(float(self.threshold)))
        low, high = (stats[Need(self.column, "quantile", q)] for q in self._shares())
        if low is None:
            return df.filter(F.lit(False))
        if self.method == "iqr":
            spread = high - low
            low, high = low - self.threshold * spread, high + self.threshold * spread
        return df.filter((c >= F.lit(low)) & (c <= F.lit(high)))


@dataclass(frozen=True)
class Standardize(CleaningOp):
    column: str

    operation = "standardize"

    def check(self, df: DataFrame) -> None:
        super().check(df)
        _number(df, self.column)

    def needs(self, df: DataFrame) -> list[Need]:
        return [Need(self.column, "mean"), Need(self.column, "std")]

    def apply(self, df: DataFrame, stats: dict[Need, Any]) -> DataFrame:
        mean, std = stats[Need(self.column, "mean")], stats[Need(self.column, "std")]
        value = F.try_divide(F.col(self.column) - F.lit(mean).cast("double"), F.lit(std).cast("double"))
        return _replace(df, self.column, value)


@dataclass(frozen=True)
class Normalize(CleaningOp):
    column: str

    operation = "normalize"

    def check(self, df: DataFrame) -> None:
        super().check(df)
        _number(df, self.column)

    def needs(self, df: DataFrame) -> list[Need]:
        return [Need(self.column, "min"), Need(self.column, "max")]

    def apply(self, df: DataFrame, stats: dict[Need, Any]) -> DataFrame:
        low, high = stats[Need(self.column, "min")], stats[Need(self.column, "max")]
        low_c, high_c = F.lit(low).cast("double"), F.lit(high).cast("double")
        return _replace(df, self.column, F.try_divide(F.col(self.column) - low_c, high_c - low_c))


@dataclass(frozen=True)
class StringClean(CleaningOp):
    column: str
    operations: tuple[str, ...] = ("strip",)

    operation = "string_clean"

    def validate(self) -> None:
        for name in self.operations:
            if name not in STRING_OPS:
                raise CleaningError(f"unknown string operation: {name}")

    def apply(self, df: DataFrame, stats: dict[Need, Any]) -> DataFrame:
        return _replace(df, self.column, apply_string_ops(F.col(self.column), self.operations))


@dataclass(frozen=True)
class RenameColumn(CleaningOp):
    column: str
    new_name: str = ""

    operation = "rename_column"

    def apply(self, df: DataFrame, stats: dict[Need, Any]) -> DataFrame:
        return df.withColumnRenamed(self.column, self.new_name or f"{self.column}_renamed")


@dataclass(frozen=True)
class DropColumn(CleaningOp):
    column: str

    operation = "drop_column"

    def apply(self, df: DataFrame, stats: dict[Need, Any]) -> DataFrame:
        return df.drop(self.column)


@dataclass(frozen=True)
class EncodeCategorical(CleaningOp):
    """``most`` refuses a one-hot encoding of more values; every one of them becomes a column."""

    column: str
    method: str = "label"
    most: int | None = None

    operation = "encode_categorical"

    def validate(self) -> None:
        if self.method not in ("label", "onehot"):
            raise CleaningError("method must be 'label' or 'onehot'")

    def needs(self, df: DataFrame) -> list[Need]:
        return [Need(self.column, "dictionary")] if self.method == "label" else [self._categories()]

    def reshuffles(self) -> bool:
        return self.method == "label"

    def _categories(self) -> Need:
        return Need(self.column, "categories", self.most)

    def apply(self, df: DataFrame, stats: dict[Need, Any]) -> DataFrame:
        if self.method == "label":
            return look_up(df, self.column, stats[Need(self.column, "dictionary")], self.column)
        flags = []
        for value in stats[self._categories()]:
            same = F.col(self.column).eqNullSafe(F.lit(value))
            flags.append(same.cast("int").alias(f"{self.column}_{'null' if value is None else value}"))
        at = df.columns.index(self.column)
        before, after = df.columns[:at], df.columns[at + 1 :]
        return df.select(*before, *flags, *after)


_COMPARE = {
    "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
}


@dataclass(frozen=True)
class FilterRows(CleaningOp):
    """Keep rows where ``column condition value``; null compares as unknown and is dropped."""

    column: str
    condition: str = "eq"
    value: Any = None

    operation = "filter_rows"
    changes_rows = True

    def validate(self) -> None:
        if self.condition not in (*_COMPARE, "contains"):
            raise CleaningError(f"unknown condition: {self.condition}")

    def apply(self, df: DataFrame, stats: dict[Need, Any]) -> DataFrame:
        c = F.col(self.column)
        if self.condition == "contains":
            return df.filter(c.rlike(str(self.value)))
        return df.filter(_COMPARE[self.condition](c, F.lit(self.value)))


_ARITHMETIC = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": F.try_divide,
}


@dataclass(frozen=True)
class CreateFeature(CleaningOp):
    """A new column from one column and another column or a constant."""

    column: str
    new_name: str = ""
    method: str = "add"
    other: str | None = None
    value: float | None = None

    operation = "create_feature"

    def validate(self) -> None:
        if self.method not in _ARITHMETIC:
            raise CleaningError(f"unknown feature method: {self.method}")
        if not self.new_name or (self.other is None) == (self.value is None):
            raise CleaningError("create_feature needs new_name and either other or value")

    def reads(self) -> list[str]:
        return [self.column, *([self.other] if self.other else [])]

    def apply(self, df: DataFrame, stats: dict[Need, Any]) -> DataFrame:
        right = F.col(self.other) if self.other else F.lit(self.value)
        return df.withColumn(self.new_name, _ARITHMETIC[self.method](F.col(self.column), right))


OPERATIONS: dict[str, type[CleaningOp]] = {
    cls.operation: cls
    for cls in (
        FillMissing, DropMissing, DropDuplicates, CastType, RemoveOutliers, Standardize, Normalize,
        StringClean, RenameColumn, DropColumn, EncodeCategorical, FilterRows, CreateFeature,
    )
}


def op_from_record(record: dict[str, Any]) -> CleaningOp | None:
    """``{operation, column, columns, description, confidence, parameters}`` to a typed operation.

    None for an operation outside the whitelist.
    """
    cls = OPERATIONS.get(record.get("operation", ""))
    if cls is None:
        return None
    names = set(cls.__dataclass_fields__)
    given = {k: v for k, v in {**record, **(record.get("parameters") or {})}.items() if k in names and v is not None}
    for k, v in given.items():
        if isinstance(v, list):
            given[k] = tuple(v)
    return cls(**given)


# --- chains -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Fitted:
    """Operations with what they learned. ``apply`` is lazy; fills in row order count large tables and write them in ranges."""

    steps: tuple[tuple[CleaningOp, dict[Need, Any]], ...]

    def apply(self, df: DataFrame) -> DataFrame:
        for op, stats in self.steps:
            op.check(df)
            df = op.apply(df, stats)
        return df


def fit(df: DataFrame, ops: Sequence[CleaningOp]) -> Fitted:
    return _run(df, ops)[0]


def clean(df: DataFrame, ops: Sequence[CleaningOp]) -> DataFrame:
    return _run(df, ops)[1]


def clean_one(df: DataFrame, op: CleaningOp) -> DataFrame:
    return clean(df, [op])


def _run(df: DataFrame, ops: Sequence[CleaningOp]) -> tuple[Fitted, DataFrame]:
    steps: list[tuple[CleaningOp, dict[Need, Any]]] = []
    pending = list(ops)
    shuffled = False
    while pending:
        batch, needs = _shared_batch(df, pending)
        if needs and shuffled:
            # the learned values need several passes: do the shuffle below them only once
            df, shuffled = cut_lineage(df), False
        stats = collect_needs(df, needs) if needs else {}
        for op in batch:
            op.check(df)
            mine = {n: stats[n] for n in op.needs(df)}
            steps.append((op, mine))
            df = op.apply(df, mine)
            shuffled = shuffled or op.reshuffles()
        pending = pending[len(batch) :]
    return Fitted(tuple(steps)), df


def _shared_batch(df: DataFrame, ops: list[CleaningOp]) -> tuple[list[CleaningOp], list[Need]]:
    """The longest prefix whose statistics can all be taken from ``df`` as it is now."""
    batch: list[CleaningOp] = []
    needs: list[Need] = []
    touched: set[str] = set()
    rows_changed = False
    for op in ops:
        if batch and (any(c not in df.columns for c in op.reads()) or isinstance(op, DropMissing) and op.axis == "columns"):
            break
        if not batch:
            op.check(df)
        mine = op.needs(df)
        if batch and mine and (rows_changed or any(n.column in touched for n in mine)):
            break
        batch.append(op)
        needs += mine
        rows_changed = rows_changed or op.changes_rows
        touched.update(op.reads())
        if isinstance(op, (RenameColumn, DropColumn, CreateFeature)) or getattr(op, "axis", "") == "columns":
            break
    return batch, needs


@dataclass
class CleaningResult:
    df: DataFrame
    success: bool
    applied: list[str]
    skipped: list[str]
    errors: list[dict[str, str]]
    columns_before: int
    columns_after: int
    error: str | None = None
    before: Observation | None = None
    after: Observation | None = None

    def rows(self) -> tuple[int, int]:
        """Row counts before and after, taken while an action on ``df`` ran."""
        if self.before is None or self.after is None:
            raise ValueError("rows are only counted for successful chains")
        return self.before.get["rows"], self.after.get["rows"]


def apply_records(
    df: DataFrame,
    records: Sequence[dict[str, Any]],
    preview: int | None = None,
    on_error: str = "stop",
) -> CleaningResult:
    """Apply operation records in turn. Unknown operations are skipped.

    ``on_error='stop'`` gives the input back unchanged with the error; ``'skip'`` leaves out the
    failing operation and goes on. Only errors found while planning and fitting can be handled here;
    use ``on_error='null'`` of a cast for bad values in the rows.
    """
    start = df
    before, after = Observation(), Observation()
    current = df.observe(before, F.count(F.lit(1)).alias("rows"))
    applied: list[str] = []
    skipped: list[str] = []
    errors: list[dict[str, str]] = []
    group: list[tuple[dict[str, Any], CleaningOp]] = []
    for record in records:
        name = str(record.get("operation"))
        try:
            op = op_from_record(record)
            if op is None:
                skipped.append(name)
                continue
            if on_error == "skip":
                current = clean_one(current, op)
                if op.reshuffles():
                    # the next operation learns from a table, not from a plan that grows
                    current = cut_lineage(current)
                current.schema
                applied.append(_label(name, record))
            else:
                group.append((record, op))
        except Exception as e:  # noqa: BLE001
            errors.append({"op": name, "error": str(e)})
            if on_error != "skip":
                break
    if on_error != "skip" and not errors:
        try:
            current = clean(current, [op for _, op in group])
            current.schema
            applied = [_label(str(r.get("operation")), r) for r, _ in group]
        except Exception as e:  # noqa: BLE001
            errors.append({"op": "chain", "error": str(e)})
    width = len(start.columns)
    if errors and on_error != "skip":
        return CleaningResult(start, False, applied, skipped, errors, width, width, f"operation failed: {errors[-1]['error']}")
    columns_after = len(current.columns)
    current = current.observe(after, F.count(F.lit(1)).alias("rows"))
    if preview is not None:
        current = current.limit(preview)
    return CleaningResult(current, True, applied, skipped, errors, width, columns_after, None, before, after)


def _label(name: str, record: dict[str, Any]) -> str:
    return f"{name}: {record.get('description', 'No description')}"


def chain_report(df: DataFrame, ops: Sequence[CleaningOp]) -> DataFrame:
    """One row per operation with the counts before and after it, all observed in one job."""
    fitted = fit(df, ops)
    watch = [Observation()]
    current = df.observe(watch[0], F.count(F.lit(1)).alias("rows"))
    widths = [len(current.columns)]
    for op, stats in fitted.steps:
        watch.append(Observation())
        current = op.apply(current, stats).observe(watch[-1], F.count(F.lit(1)).alias("rows"))
        widths.append(len(current.columns))
    current.agg(F.count(F.lit(1))).first()
    rows = [o.get["rows"] for o in watch]
    out = [
        (i + 1, op.operation, rows[i], rows[i + 1], widths[i], widths[i + 1])
        for i, (op, _) in enumerate(fitted.steps)
    ]
    return df.sparkSession.createDataFrame(
        out,
        "step int, operation string, rows_before long, rows_after long, columns_before int, columns_after int",
    )


def preprocess_records(df: DataFrame, operations: Sequence[dict[str, Any]]) -> CleaningResult:
    """The smaller task vocabulary: drop_nulls, fill_nulls, drop_columns, rename_column, cast_type,
    filter, encode_categorical and scale, with one error not stopping the rest."""
    records: list[dict[str, Any]] = []
    for op in operations:
        kind = op.get("op")
        columns = op.get("columns") or ([op["column"]] if op.get("column") else [])
        if kind == "drop_nulls":
            records.append({"operation": "drop_missing", "axis": "rows", "columns": columns})
        elif kind == "fill_nulls":
            targets = columns or df.columns
            records += [
                {"operation": "fill_missing", "column": c, "strategy": "constant", "fill_value": op.get("value", 0)}
                for c in targets
            ]
        elif kind == "drop_columns":
            records += [{"operation": "drop_column", "column": c} for c in columns]
        elif kind == "rename_column":
            records.append({"operation": kind, "column": op.get("old_name"), "new_name": op.get("new_name")})
        elif kind == "cast_type":
            records.append({"operation": kind, "column": op.get("column"), "target_type": op.get("dtype", "string")})
        elif kind == "filter":
            records.append({"operation": "filter_rows", **{k: op.get(k) for k in ("column", "condition", "value")}})
        elif kind == "encode_categorical":
            records += [{"operation": kind, "column": c, "method": op.get("method", "label")} for c in columns]
        elif kind == "scale":
            if op.get("method", "standard") != "standard":
                raise CleaningError(f"unknown scale method: {op['method']}")
            records += [{"operation": "standardize", "column": c} for c in columns]
        else:
            records.append({"operation": str(kind)})
    return apply_records(df, records, on_error="skip")
