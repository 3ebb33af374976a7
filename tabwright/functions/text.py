"""String cleaning expressions. ``(?U)`` makes Java's classes follow Unicode."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def remove_special(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[^a-zA-Z0-9\s]", "")


def remove_numbers(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\d", "")


def collapse_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


STRING_OPS: dict[str, Callable[[Column], Column]] = {
    "lowercase": F.lower,
    "uppercase": F.upper,
    "strip": strip,
    "remove_special": remove_special,
    "remove_numbers": remove_numbers,
    "remove_whitespace": collapse_whitespace,
}


def apply_string_ops(c: Column, names: Sequence[str]) -> Column:
    for name in names:
        if name not in STRING_OPS:
            raise ValueError(f"unknown string operation: {name}")
        c = STRING_OPS[name](c)
    return c
