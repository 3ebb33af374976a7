"""Exact medians and quantiles by distributed selection.

Spark's exact ``percentile`` keeps every distinct value of a column in one task. These functions
put values in order only once the candidates are few: larger columns are narrowed first. Each round
asks ``percentile_approx`` for pivots, at first a lower, middle and upper one of each rank, and counts the
rows at and between all pivots of a column, each row in the one place that a binary search finds for it.
Counting makes every step exact, and a value shared by many rows is found as soon as it becomes a pivot.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SMALL_ROWS = 50_000
_ACCURACY = 10_000
#: Later rounds part a place so many times.
_SPREAD = 64


@dataclass
class _Search:
    """The rank is among ``size`` rows at ``place`` (see ``_placed``), after ``base`` rows in lower places."""

    at: int
    rank: int
    size: int
    base: int = 0
    place: int = 0
    answer: float | None = None

    def shares(self) -> list[float]:
        middle = (self.rank + 0.5) / self.size
        slack = 3.0 / _ACCURACY
        return [max(0.0, middle - slack), middle, min(1.0, middle + slack)]


def order_statistics(
    df: DataFrame,
    wanted: dict[str, Callable[[int], list[int]]],
    small_rows: int = SMALL_ROWS,
) -> dict[str, tuple[int, dict[int, float]]]:
    """Values at 0-based ranks of the sorted non-null column: ``{column: (n, {rank: value})}``.

    ``wanted`` maps a numeric column to a function from n to ranks. All columns share each pass.
    """
    for column in wanted:
        if not isinstance(df.schema[column].dataType, T.NumericType):
            raise TypeError(f"{column} is not numeric")
    columns = list(wanted)
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    df = df.select(*[_ordered(F.col(c)).alias(f"x{i}") for i, c in enumerate(columns)])
    return _select(df, wanted, {c: counts[c] for c in columns}, small_rows)


def group_order_statistics(
    df: DataFrame,
    group: str,
    value: str,
    wanted: dict[Any, Callable[[int], list[int]]],
    small_rows: int = SMALL_ROWS,
) -> dict[Any, tuple[int, dict[int, float]]]:
    """``order_statistics`` of one column apart for each group that ``wanted`` names: ``{group: (n, {rank: value})}``.

    All groups share each pass, in which a row has the one place of its own group. The names of groups are not null.
    """
    if not isinstance(df.schema[value].dataType, T.NumericType):
        raise TypeError(f"{value} is not numeric")
    if not wanted:
        return {}
    at = F.coalesce(*[F.when(F.col(group) == k, i) for i, k in enumerate(wanted)])
    df = df.select(at.alias("at"), _ordered(F.col(value)).alias("x")).where("at is not null and x is not null")
    # one row for each group
    found = {r.at: r.n for r in df.groupBy("at").agg(F.count("*").alias("n")).collect()}
    df = df.select("at", *[F.when(F.col("at") == i, F.col("x")).alias(f"x{i}") for i in range(len(wanted))])
    return _select(df, wanted, {k: found.get(i, 0) for i, k in enumerate(wanted)}, small_rows)


def _ordered(column: F.Column) -> F.Column:
    # casts keep the order, and adding zero makes -0.0 and 0.0 one value
    return column.cast("double") + F.lit(0.0)


def _select(
    df: DataFrame, wanted: dict[Any, Callable[[int], list[int]]], counts: dict[Any, int], small_rows: int
) -> dict[Any, tuple[int, dict[int, float]]]:
    """Of columns x0, x1 and so on in the order of ``wanted``; with a column ``at``, a row has a value in that one alone."""
    columns = list(wanted)
    searches: list[_Search] = []
    for i, c in enumerate(columns):
        n = counts[c]
        searches += [_Search(i, r, n) for r in sorted(set(wanted[c](n)))] if n else []
    cuts: dict[int, list[float]] = {}
    while True:
        open_ = [s for s in searches if s.answer is None]
        large = [s for s in open_ if s.size > small_rows]
        if not large:
            break
        _narrow(df, open_, large, cuts)
    _finish(df, open_, cuts)
    out: dict[Any, tuple[int, dict[int, float]]] = {c: (counts[c], {}) for c in columns}
    for s in searches:
        out[columns[s.at]][1][s.rank] = s.answer
    return out


def _placed(df: DataFrame, columns: list[int], cuts: dict[int, list[float]]) -> DataFrame:
    """(at, place, x): the non-null values of ``columns``, each with its place among the column's finite ``cuts``.

    Values equal to cut j are at 2j + 1, those before it and after the last one at 2j; infinite values and NaN have
    places of their own at the ends. Values of a column without cuts are all at 0.
    """
    apart = "at" in df.columns
    if apart:
        df = df.where(F.col("at").isin(columns))
    cut = [i for i in columns if cuts.get(i)]
    if cut:
        splits = [[-math.inf, *cuts[i], math.inf] for i in cut]
        made = Bucketizer(splitsArray=splits, inputCols=[f"x{i}" for i in cut], outputCols=[f"b{i}" for i in cut], handleInvalid="keep")
        df = made.transform(df)
    places = {}
    for i in columns:
        x, place = F.col(f"x{i}"), F.lit(0)
        if i in cuts:
            n, b = len(cuts[i]), F.col(f"b{i}").cast("int") if i in cut else F.lit(0)
            lower = F.get(F.array(*map(F.lit, cuts[i])), b - 1) if i in cut else F.lit(None)
            place = F.when(F.isnan(x), 2 * n + 2).when(x == math.inf, 2 * n + 1).when(x == -math.inf, -1)
            place = place.otherwise(2 * b - F.coalesce(x == lower, F.lit(False)).cast("int"))
        places[i] = place
    if apart:
        # a row for each column would hold a value in one of them
        place = F.coalesce(*[F.when(F.col("at") == i, p) for i, p in places.items()])
        return df.select("at", place.alias("place"), F.coalesce(*[f"x{i}" for i in columns]).alias("x"))
    rows = [F.struct(F.lit(i).alias("at"), p.alias("place"), F.col(f"x{i}").alias("x")) for i, p in places.items()]
    return df.select(F.inline(F.array(*rows))).where("x is not null")


def _among(rows: DataFrame, searches: list[_Search]) -> DataFrame:
    """The rows in places of the searches."""
    places: dict[int, set[int]] = {}
    for s in searches:
        places.setdefault(s.at, set()).add(s.place)
    cond = F.lit(False)
    for i, some in places.items():
        cond = cond | ((F.col("at") == i) & F.col("place").isin(sorted(some)))
    return rows.where(cond)


def _narrow(df: DataFrame, searches: list[_Search], large: list[_Search], cuts: dict[int, list[float]]) -> None:
    """One round: pivots for all large searches in one job, the rows at and between them in another."""
    columns = sorted({s.at for s in large})
    if not cuts:
        shares = {i: [p for s in large if s.at == i for p in s.shares()] for i in columns}
        found = df.agg(*[F.percentile_approx(f"x{i}", shares[i], _ACCURACY).alias(f"x{i}") for i in columns]).first()
        marks = {i: set(found[f"x{i}"]) for i in columns}
    else:
        # one row for each place that is still large; evenly spread pivots serve all ranks in it
        rows, spread = _among(_placed(df, columns, cuts), large), [j / _SPREAD for j in range(_SPREAD + 1)]
        marks = {i: set() for i in columns}
        for r in rows.groupBy("at", "place").agg(F.percentile_approx("x", spread, _ACCURACY).alias("p")).collect():
            marks[r.at].update(r.p)
    for s in searches:
        if s.at in marks and s.at in cuts:
            # the cuts around a place stay
            marks[s.at].update(cuts[s.at][max(0, s.place // 2 - 1) : s.place // 2 + 1])
    cuts.update({i: sorted(filter(math.isfinite, m)) for i, m in marks.items()})
    # at most two rows for each cut
    counted = _placed(df, columns, cuts).groupBy("at", "place").agg(F.count("*").alias("n")).collect()
    tallies: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(counted):
        tallies.setdefault(r.at, []).append((r.place, r.n))
    for s in searches:
        if s.at in marks:
            _step(s, tallies[s.at], cuts[s.at])


def _step(s: _Search, tally: list[tuple[int, int]], cuts: list[float]) -> None:
    """Find the place that holds the rank; where it is that of one value, that is the answer."""
    below = 0
    for place, n in tally:
        if s.rank < below + n:
            break
        below += n
    s.place, s.base, s.size = place, below, n
    if place < 0 or place > 2 * len(cuts):
        s.answer = {-1: -math.inf, 2 * len(cuts) + 1: math.inf}.get(place, math.nan)
    elif place % 2:
        s.answer = cuts[place // 2]


def _finish(df: DataFrame, searches: list[_Search], cuts: dict[int, list[float]]) -> None:
    """Put the few rows of each place in order."""
    if not searches:
        return
    rows = _among(_placed(df, sorted({s.at for s in searches}), cuts), searches)
    nth = F.row_number().over(Window.partitionBy("at", "place").orderBy("x"))
    name = F.concat_ws(" ", "at", "place", nth - 1)
    wanted = {f"{s.at} {s.place} {s.rank - s.base}": s for s in searches}
    ranked = rows.select("x", name.alias("name")).where(F.col("name").isin(sorted(wanted)))
    values: dict[str, Any] = {r.name: r.x for r in ranked.collect()}  # one row for each search
    for name, s in wanted.items():
        s.answer = values[name]


def median_ranks(n: int) -> list[int]:
    return [(n - 1) // 2, n // 2]


def nearest_rank(n: int, q: float) -> int:
    """Index of the nearest-interpolation quantile; halves go to the even index."""
    return round((n - 1) * q)


def medians(df: DataFrame, columns: list[str], small_rows: int = SMALL_ROWS) -> dict[str, float | None]:
    found = order_statistics(df, {c: median_ranks for c in columns}, small_rows)
    return {
        c: (values[(n - 1) // 2] + values[n // 2]) / 2 if n else None for c, (n, values) in found.items()
    }


def nearest_quantiles(
    df: DataFrame,
    shares: dict[str, list[float]],
    approx: bool = False,
    small_rows: int = SMALL_ROWS,
) -> dict[str, dict[float, float | None]]:
    """``{column: {q: value}}``; ``approx=True`` is one ``percentile_approx`` pass."""
    if approx:
        row = df.agg(
            *[F.percentile_approx(F.col(c).cast("double"), qs, _ACCURACY).alias(c) for c, qs in shares.items()]
        ).first()
        return {c: dict(zip(qs, row[c] or [None] * len(qs))) for c, qs in shares.items()}
    ranks = {c: (lambda n, qs=qs: [nearest_rank(n, q) for q in qs]) for c, qs in shares.items()}
    found = order_statistics(df, ranks, small_rows)
    return {
        c: {q: (found[c][1][nearest_rank(found[c][0], q)] if found[c][0] else None) for q in qs}
        for c, qs in shares.items()
    }


def modes(df: DataFrame, columns: list[str]) -> dict[str, Any]:
    """Most frequent non-null value per column, the lowest on ties.

    Counts are grouped with map-side combine, so no task holds all distinct values.
    """
    out: dict[str, Any] = {}
    for c in columns:
        counts = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("__n"))
        row = counts.orderBy(F.desc("__n"), F.asc(c)).limit(1).first()
        out[c] = row[0] if row else None
    return out
