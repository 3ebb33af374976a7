"""Null markers, type inference, casts and date patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts read as missing.
NULL_MARKERS = ("", "NA", "N/A", "null", "NULL", "None", "nan", "NaN", ".")

TARGET_TYPES = {"int": "bigint", "float": "double", "string": "string", "boolean": "boolean"}
TYPE_ALIASES = {"str": "string", "bool": "boolean"}

_STRPTIME = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM",
    "B": "MMMM", "p": "a", "I": "hh", "j": "DDD", "f": "SSSSSS", "z": "Z", "a": "EEE", "A": "EEEE",
}
_STRPTIME_WHOLE = {"F": "%Y-%m-%d", "T": "%H:%M:%S", "D": "%m/%d/%y", "R": "%H:%M"}


def datetime_pattern(strptime: str) -> str:
    """A strptime format as a Spark datetime pattern."""
    for short, full in _STRPTIME_WHOLE.items():
        strptime = strptime.replace(f"%{short}", full)
    out, i = "", 0
    while i < len(strptime):
        ch = strptime[i]
        if ch == "%":
            code = strptime[i + 1] if i + 1 < len(strptime) else ""
            if code == "%":
                out += "%"
            elif code in _STRPTIME:
                out += _STRPTIME[code]
            else:
                raise ValueError(f"unsupported date code %{code}")
            i += 2
            continue
        out += f"'{ch}'" if ch.isalpha() else ("''" if ch == "'" else ch)
        i += 1
    return out


def null_markers(df: DataFrame, columns: Sequence[str] | None = None, markers: Sequence[str] = NULL_MARKERS) -> DataFrame:
    """Turn marker texts into nulls in the string columns."""
    chosen = set(columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])
    return df.select(
        *[F.when(~F.col(c).isin(*markers), F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns]
    )


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def to_boolean(c: Column, strict: bool = True) -> Column:
    """Only true and false count, whatever their case."""
    low = F.lower(F.trim(c))
    known = F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False))
    if not strict:
        return known
    wrong = F.raise_error(F.concat(F.lit("not a boolean: "), c)).cast("boolean")
    return known.when(c.isNotNull(), wrong)


def cast_column(df: DataFrame, column: str, target: str, date_format: str | None = None, strict: bool = True) -> Column:
    """The converted column; a bad value raises, or becomes null when not ``strict``."""
    target = TYPE_ALIASES.get(target, target)
    c, source = F.col(column), df.schema[column].dataType
    text = isinstance(source, T.StringType)
    if target == "datetime":
        if not text:
            return c.cast("timestamp_ntz") if strict else c.try_cast("timestamp_ntz")
        pattern = F.lit(datetime_pattern(date_format)) if date_format else None
        if strict:
            return F.to_timestamp_ntz(c, pattern) if pattern is not None else c.cast("timestamp_ntz")
        if pattern is None:
            return c.try_cast("timestamp_ntz")
        return F.try_to_timestamp(c, pattern).cast("timestamp_ntz")
    if target not in TARGET_TYPES:
        raise ValueError(f"unknown target type: {target}")
    if target == "boolean" and text:
        return to_boolean(c, strict)
    if target == "int" and isinstance(source, (T.FloatType, T.DoubleType)):
        c = F.when(~F.isnan(c), c)
    return c.cast(TARGET_TYPES[target]) if strict else c.try_cast(TARGET_TYPES[target])


_CANDIDATES = ("bigint", "double", "boolean", "timestamp_ntz")


def _candidate(c: Column, kind: str) -> Column:
    if kind == "boolean":
        return to_boolean(c, strict=False)
    if kind == "bigint":
        return F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("bigint"))
    if kind == "double":
        return F.when(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(inf|Infinity)$"), c.try_cast("double"))
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"), c.try_cast("timestamp_ntz"))


def inferred_types(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, str]:
    """The narrowest type every non-null text of a column fits, from one pass over all rows."""
    columns = list(columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])
    if not columns:
        return {}
    misses = []
    for i, name in enumerate(columns):
        c = F.col(name)
        misses.append(F.count(c).alias(f"n{i}"))
        for kind in _CANDIDATES:
            misses.append(F.count_if(c.isNotNull() & _candidate(c, kind).isNull()).alias(f"{kind}{i}"))
    row = df.agg(*misses).first()
    out = {}
    for i, name in enumerate(columns):
        fits = [k for k in _CANDIDATES if row[f"{k}{i}"] == 0]
        out[name] = fits[0] if row[f"n{i}"] and fits else "string"
    return out


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Convert text columns; a value that does not fit becomes null."""
    return df.select(
        *[
            _candidate(F.col(c), types[c]).alias(c) if types.get(c, "string") != "string" else F.col(c)
            for c in df.columns
        ]
    )


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return apply_types(df, inferred_types(df, columns))


def range_midpoint(c: Column) -> Column:
    """``a-b`` to its midpoint and ``5+`` to 5; a leading minus belongs to the number."""
    number = r"^\s*(-?[0-9.]+)"
    low = F.regexp_extract(c, number + r"\s*-\s*-?[0-9.]+\s*$", 1).try_cast("double")
    high = F.regexp_extract(c, number + r"\s*-\s*(-?[0-9.]+)\s*$", 2).try_cast("double")
    plus = F.regexp_extract(c, number + r"\+\s*$", 1).try_cast("double")
    return F.coalesce((low + high) / 2, plus, c.try_cast("double"))
