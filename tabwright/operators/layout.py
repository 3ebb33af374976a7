"""Skew-proof ordered computations.

``row_number``, running sums, carried values and ``lag`` over one large group (or over the
whole table) would run in a single task if written as one window. Here the rows of groups above
the row target are dealt out by ranges of (group, sort keys) and written once with the number of
their range; a normal window works inside each range, and a small table with one row per range
carries the state from one to the next. Groups below the target keep the plain window, so
ordinary data pays only for one count.

Ranges are cut over the whole sort key of any type, and there are as many as rows ask for.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tabwright.session import cut_lineage

#: Rows of a group, or of a range of a larger group, that one task puts in order.
TARGET_ROWS = 2_000_000
_ROW = "__row"
BUCKET = "__b0"


@dataclass(frozen=True)
class Key:
    """One sort key. Nulls come first when ascending and last when descending, as in Spark."""

    name: str
    descending: bool = False

    def sort(self) -> Column:
        return F.col(self.name).desc() if self.descending else F.col(self.name).asc()

    def reverse(self) -> Key:
        return Key(self.name, not self.descending)


def keys(order_by: Sequence[str | Key] | str) -> list[Key]:
    if isinstance(order_by, (str, Key)):
        order_by = [order_by]
    found = []
    for item in order_by:
        if isinstance(item, Key):
            found.append(item)
        elif item.startswith("-"):
            found.append(Key(item[1:], True))
        else:
            found.append(Key(item))
    if not found:
        raise ValueError("this operator depends on row order: pass order_by")
    return found


@dataclass
class Layout:
    """``df`` with bucket columns; ``buckets`` is empty when no group needed cutting."""

    df: DataFrame
    groups: list[str]
    order: list[Key]
    buckets: list[str] = field(default_factory=list)

    def window(self, backwards: bool = False) -> WindowSpec:
        """In order inside a bucket. Looking ahead uses the reverse order with a preceding frame,
        because Spark recomputes a following frame for every row."""
        cols = [F.col(c) for c in [*self.groups, *self.buckets]]
        order = [k.reverse() for k in self.order] if backwards else self.order
        return Window.partitionBy(*cols).orderBy(*[k.sort() for k in order])

    def before(self, backwards: bool = False) -> WindowSpec:
        """Over the one-row-per-bucket table: the earlier (or later) buckets of the same group."""
        base = Window.partitionBy(*[F.col(g) for g in self.groups]) if self.groups else Window.partitionBy(F.lit(0))
        order = [F.col(b).desc() if backwards else F.col(b).asc() for b in self.buckets]
        return base.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def per_bucket(self, df: DataFrame, *aggregates: Column) -> DataFrame:
        """One row for each range of a large group; groups in a plain window need no carried state."""
        return df.filter(F.col(BUCKET) >= 0).groupBy(*self.groups, *self.buckets).agg(*aggregates)

    def attach(self, main: DataFrame, carry: DataFrame, values: list[str]) -> DataFrame:
        """Add the carried ``values`` of each bucket to its rows; Spark picks the join by size."""
        on = [*self.groups, *self.buckets]
        right = carry.select(*[F.col(c).alias(f"__r_{c}") for c in on], *values)
        cond = None
        for c in on:
            part = F.col(c).eqNullSafe(F.col(f"__r_{c}"))
            cond = part if cond is None else cond & part
        return main.join(right, cond, "left").drop(*[f"__r_{c}" for c in on])

    def clean(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.buckets)


def build(
    df: DataFrame,
    order_by: Sequence[str | Key] | str,
    partition_by: Sequence[str] = (),
    target_rows: int | None = None,
) -> Layout:
    """One count job; tables with a group above the target are written once in ranges."""
    order, groups = keys(order_by), list(partition_by)
    target = target_rows or TARGET_ROWS

    def counted(df: DataFrame) -> DataFrame:
        """Rows with a number that a repeated task finds again: it counts the rows of a written table."""
        return cut_lineage(df).withColumn(_ROW, F.monotonically_increasing_id())

    if groups:
        counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("__rows"))
        large = counts.filter(F.col("__rows") > target)
        head = large.agg(F.sum("__rows")).first()
        size = int(head[0] or 0)
        if not size:
            return Layout(df, groups, order)
        large = large.select(*[F.col(g).alias(f"__h_{g}") for g in groups], F.lit(True).alias("__hot"))
        cond = None
        for g in groups:
            part = F.col(g).eqNullSafe(F.col(f"__h_{g}"))
            cond = part if cond is None else cond & part
        df = counted(df).join(large, cond, "left").drop(*[f"__h_{g}" for g in groups])
        hot = F.coalesce(F.col("__hot"), F.lit(False))
    else:
        size = df.count()
        if size <= target:
            return Layout(df, groups, order)
        df, hot = counted(df), F.lit(True)
    # rows with the same keys may be parted anywhere, so a value that fills many ranges is no hot spot
    by = [*[F.when(hot, F.col(g)) for g in groups], *[k.sort() for k in order]]
    ranged = df.repartitionByRange(max(2, math.ceil(size / target)), *by, _ROW)
    ranged = ranged.withColumn(BUCKET, F.when(hot, F.spark_partition_id()).otherwise(F.lit(-1)))
    return Layout(cut_lineage(ranged.drop("__hot", _ROW)), groups, order, [BUCKET])


def row_numbers(
    df: DataFrame,
    name: str,
    order_by: Sequence[str | Key] | str,
    partition_by: Sequence[str] = (),
    target_rows: int | None = None,
) -> DataFrame:
    """1..n in order inside each group, without a single-task window for large groups."""
    lay = build(df, order_by, partition_by, target_rows)
    local = lay.df.withColumn(name, F.row_number().over(lay.window()).cast("long"))
    if not lay.buckets:
        return lay.clean(local)
    sizes = lay.per_bucket(lay.df, F.count(F.lit(1)).alias("__n"))
    carry = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(lay.before()), F.lit(0)))
    out = lay.attach(local, carry, ["__before"])
    return lay.clean(out.withColumn(name, F.col(name) + F.coalesce("__before", F.lit(0))).drop("__before"))


def running_sums(
    df: DataFrame,
    sums: dict[str, str],
    order_by: Sequence[str | Key] | str,
    partition_by: Sequence[str] = (),
    target_rows: int | None = None,
) -> DataFrame:
    """For each ``new: column`` the sum of all rows up to and including this one."""
    lay = build(df, order_by, partition_by, target_rows)
    upto = lay.window().rowsBetween(Window.unboundedPreceding, 0)
    local = lay.df.select("*", *[F.sum(c).over(upto).alias(n) for n, c in sums.items()])
    if not lay.buckets:
        return lay.clean(local)
    totals = lay.per_bucket(lay.df, *[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    carry = totals.select("*", *[F.sum(f"__t_{n}").over(lay.before()).alias(f"__c_{n}") for n in sums])
    out = lay.attach(local, carry, [f"__c_{n}" for n in sums])
    for n in sums:
        both = F.coalesce(F.col(n) + F.col(f"__c_{n}"), F.col(n), F.col(f"__c_{n}"))
        out = out.withColumn(n, both).drop(f"__c_{n}")
    return lay.clean(out)


def _one_way(order: list[Key]) -> None:
    if len({k.descending for k in order}) > 1:
        raise ValueError("carried values need every sort key in the same direction")


def carry_forward(
    df: DataFrame,
    fills: dict[str, Column],
    order_by: Sequence[str | Key] | str,
    partition_by: Sequence[str] = (),
    include_current: bool = True,
    target_rows: int | None = None,
) -> DataFrame:
    """For each ``new: expression`` the last non-null value at or before the row.

    With ``include_current=False`` only earlier rows count. Sort keys in the opposite direction
    give the next non-null value instead.
    """
    order = keys(order_by)
    _one_way(order)
    for name, expr in fills.items():
        df = df.withColumn(f"__v_{name}", expr)
    lay = build(df, order, partition_by, target_rows)
    temp = [f"__v_{n}" for n in fills]
    upto = lay.window().rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    local = lay.df.select("*", *[F.last(f"__v_{n}", ignorenulls=True).over(upto).alias(n) for n in fills])
    if not lay.buckets:
        return lay.clean(local).drop(*temp)
    ends = lay.per_bucket(lay.df, *[_last_known(lay, f"__v_{n}").alias(f"__e_{n}") for n in fills])
    carry = ends.select(
        "*", *[F.last(f"__e_{n}", ignorenulls=True).over(lay.before()).alias(f"__c_{n}") for n in fills]
    )
    out = lay.attach(local, carry, [f"__c_{n}" for n in fills])
    for n in fills:
        out = out.withColumn(n, F.coalesce(F.col(n), F.col(f"__c_{n}"))).drop(f"__c_{n}")
    return lay.clean(out).drop(*temp)


def _last_known(lay: Layout, column: str) -> Column:
    at = F.struct(*[F.col(k.name) for k in lay.order])
    known = F.when(F.col(column).isNotNull(), at)
    return F.min_by(column, known) if lay.order[0].descending else F.max_by(column, known)


def previous(
    df: DataFrame,
    column: str,
    name: str,
    order_by: Sequence[str | Key] | str,
    partition_by: Sequence[str] = (),
    target_rows: int | None = None,
) -> DataFrame:
    """The value of the row before, null included (``lag``); ``name + '_known'`` says if there is one."""
    wrapped = F.struct(F.col(column).alias("v"))
    out = carry_forward(df, {"__prev": wrapped}, order_by, partition_by, False, target_rows)
    return (
        out.withColumn(name, F.col("__prev.v"))
        .withColumn(f"{name}_known", F.col("__prev").isNotNull())
        .drop("__prev")
    )


def neighbours(
    df: DataFrame,
    value: Column,
    order_by: Sequence[str | Key] | str,
    partition_by: Sequence[str] = (),
    target_rows: int | None = None,
) -> DataFrame:
    """Row position ``__at`` and the nearest known (v, at) at or before (``__lo``) and after (``__hi``)."""
    lay = build(df, order_by, partition_by, target_rows)
    lay.df = lay.df.withColumn("__v", value)
    w = lay.window()
    placed = lay.df.withColumn("__at", F.row_number().over(w).cast("long"))
    if lay.buckets:
        sizes = lay.per_bucket(lay.df, F.count(F.lit(1)).alias("__n"))
        starts = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(lay.before()), F.lit(0)))
        placed = lay.attach(placed, starts, ["__before"])
        placed = placed.withColumn("__at", F.col("__at") + F.coalesce("__before", F.lit(0))).drop("__before")
    known = F.when(F.col("__v").isNotNull(), F.struct(F.col("__v").alias("v"), F.col("__at").alias("at")))
    placed = placed.withColumn("__known", known)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = lay.window(backwards=True).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select(
        "*",
        F.last("__known", ignorenulls=True).over(back).alias("__lo"),
        F.last("__known", ignorenulls=True).over(ahead).alias("__hi"),
    )
    if lay.buckets:
        ends = lay.per_bucket(
            placed,
            F.max_by("__known", F.when(F.col("__v").isNotNull(), F.col("__at"))).alias("__last"),
            F.min_by("__known", F.when(F.col("__v").isNotNull(), F.col("__at"))).alias("__first"),
        )
        carry = ends.select(
            "*",
            F.last("__last", ignorenulls=True).over(lay.before()).alias("__c_lo"),
            F.last("__first", ignorenulls=True).over(lay.before(backwards=True)).alias("__c_hi"),
        )
        local = lay.attach(local, carry, ["__c_lo", "__c_hi"])
        local = local.withColumn("__lo", F.coalesce("__lo", "__c_lo")).withColumn("__hi", F.coalesce("__hi", "__c_hi"))
        local = local.drop("__c_lo", "__c_hi")
    return lay.clean(local).drop("__v", "__known")
