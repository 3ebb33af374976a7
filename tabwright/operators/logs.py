"""Log parsing, filtering and statistics over a text column."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.operators.catalog import moment

# The line formats that are recognised, in the order they are tried.
APP_LINE = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+)\s*\|\s*(\w+)\s*\|\s*([^|]+)\s*-\s*(.*)"
ACCESS_LINE = r'(?P<ip>[\d.]+)\s+-\s+(?P<user>\S+)\s+\[(?P<timestamp>[^\]]+)\]\s+"(?P<method>\w+)\s+(?P<path>\S+)\s+(?P<protocol>[^"]+)"\s+(?P<status>\d+)\s+(?P<size>\d+)'
SYSTEM_LINE = r"(?P<timestamp>\w+\s+\d+\s+[\d:]+)\s+(?P<host>\S+)\s+(?P<process>\S+):\s+(?P<message>.+)"
GENERIC_LINE = r"(?P<timestamp>[\d\-T:\.]+)\s*[\|\-]?\s*(?P<level>\w+)?\s*[\|\-]?\s*(?P<message>.+)"
LINE_FORMATS = (("apache", ACCESS_LINE), ("syslog", SYSTEM_LINE), ("generic", GENERIC_LINE))
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR")


def _java(pattern: str) -> str:
    """A Python pattern as a Java one matching at the start, with Unicode classes."""
    return "(?U)^(?:" + pattern.replace("(?P<", "(?<") + ")"


def parse_app_log(df: DataFrame, line: str, keep: Sequence[str] = ()) -> DataFrame:
    """``time | level | source - message`` lines to columns; other lines are dropped."""
    text = F.trim(F.col(line))
    pattern = _java(APP_LINE)

    def part(i: int) -> Column:
        return F.trim(F.regexp_extract(text, pattern, i))

    at = F.try_to_timestamp(F.substring(part(1), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    out = df.filter(text.rlike(pattern)).select(
        *keep, at.alias("timestamp"), part(2).alias("level"), part(3).alias("source"), part(4).alias("message")
    )
    return out.filter(F.col("timestamp").isNotNull())


def named_groups(df: DataFrame, line: str, pattern: str, keep: Sequence[str] = ()) -> DataFrame:
    """Lines matching a pattern with named groups, one column per name."""
    names = re.compile(pattern).groupindex
    java, text = _java(pattern), F.trim(F.col(line))
    cols = [F.nullif(F.regexp_extract(text, java, i), F.lit("")).alias(n) for n, i in names.items()]
    return df.filter(text.rlike(java)).select(*keep, *cols)


def detect_format(df: DataFrame, line: str) -> str | None:
    """The first format that more than half of all lines match."""
    text = F.trim(F.col(line))
    row = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(text.rlike(_java(p))).alias(name) for name, p in LINE_FORMATS]
    ).first()
    for name, _ in LINE_FORMATS:
        if row[name] > row["n"] * 0.5:
            return name
    return None


def parse_lines(df: DataFrame, line: str, kind: str, keep: Sequence[str] = ()) -> DataFrame:
    return named_groups(df, line, dict(LINE_FORMATS)[kind], keep)


def filter_log(
    df: DataFrame,
    level: str | None = None,
    source: str | None = None,
    message: str | None = None,
    since: datetime | str | None = None,
    until: datetime | str | None = None,
) -> DataFrame:
    if level:
        df = df.filter(F.upper("level") == level.upper())
    if source:
        df = df.filter(F.lower("source").contains(source.lower()))
    if message:
        df = df.filter(F.lower("message").contains(message.lower()))
    if since is not None:
        df = df.filter(F.col("timestamp") >= moment(since))
    if until is not None:
        df = df.filter(F.col("timestamp") <= moment(until))
    return df


def search_log(df: DataFrame, text: str) -> DataFrame:
    low = text.lower()
    return df.filter(F.lower("message").contains(low) | F.lower("source").contains(low))


def log_page(df: DataFrame, number: int, size: int, tie: Sequence[str]) -> DataFrame:
    """Newest first, with the total and whether more rows follow on every row of the page."""
    total = df.count()
    rows = df.orderBy(F.desc("timestamp"), *tie).offset((number - 1) * size).limit(size)
    return rows.withColumn("total", F.lit(total).cast("long")).withColumn("has_more", F.lit(number * size < total))


def log_stats(df: DataFrame) -> DataFrame:
    counts = [F.count_if(F.upper("level") == name).alias(name.lower()) for name in LEVELS]
    return df.agg(
        F.count(F.lit(1)).alias("total"), *counts, F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest")
    )


def log_recent(df: DataFrame, n: int = 50, level: str | None = None, tie: Sequence[str] = ()) -> DataFrame:
    return filter_log(df, level=level).orderBy(F.desc("timestamp"), *tie).limit(n)


def log_sources(df: DataFrame) -> DataFrame:
    return df.select("source").distinct()


def change_only(df: DataFrame, key: Sequence[str], value: str, order_by: Sequence[str]) -> DataFrame:
    """Rows whose value differs from the one before of the same key; the first row always counts."""
    from tabwright.operators.layout import previous

    out = previous(df, value, "__was", order_by, key)
    changed = ~F.col("__was_known") | ~F.col("__was").eqNullSafe(F.col(value))
    return out.filter(changed).select(*df.columns)
