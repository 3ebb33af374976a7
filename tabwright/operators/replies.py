"""JSON in model replies, rule-based cleaning suggestions and profile texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING_PERCENT = 5.0

OPERATION = (
    "array<struct<operation:string,column:string,columns:array<string>,description:string,"
    "confidence:double,parameters:map<string,string>>>"
)
EXPLANATION = (
    "struct<summary:string,strengths:array<string>,weaknesses:array<string>,recommendations:array<string>,"
    "threshold_suggestion:string>"
)


def fenced(text: Column) -> Column:
    """What stands in the first json fence, else in the first fence, else the whole text."""
    # split limits keep the rest of a long reply in one piece
    after_json = F.get(F.split(text, "```json", 2), F.lit(1))
    after_any = F.get(F.split(text, "```", 2), F.lit(1))
    inner = F.coalesce(after_json, after_any, text)
    return F.regexp_replace(F.get(F.split(inner, "```", 2), F.lit(0)), r"(?U)^\s+|\s+$", "")


def reply_operations(df: DataFrame, reply: str, keep: Sequence[str], most: int | None = None) -> DataFrame:
    """One row per operation of each reply, or of its first ``most``, that has all required fields."""
    body = fenced(F.col(reply))
    as_list = F.when(F.startswith(body, F.lit("{")), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    parsed = F.from_json(as_list, OPERATION)
    if most is not None:
        parsed = F.slice(parsed, 1, most)
    rows = df.select(*keep, F.inline(parsed))
    return rows.filter(
        F.col("operation").isNotNull() & F.col("description").isNotNull() & F.col("confidence").isNotNull()
    )


def reply_explanation(df: DataFrame, reply: str, keep: Sequence[str]) -> DataFrame:
    """Summary, strengths, weaknesses and recommendations; the raw text where it is no JSON object."""
    body = fenced(F.col(reply))
    parsed = F.from_json(body, EXPLANATION)
    readable = F.startswith(body, F.lit("{")) & F.try_parse_json(body).isNotNull()
    none = F.array().cast("array<string>")
    summary = F.when(readable, F.coalesce(parsed["summary"], F.lit("No summary available"))).otherwise(F.col(reply))
    lists = [
        F.when(readable, F.coalesce(parsed[n], none)).otherwise(none).alias(n)
        for n in ("strengths", "weaknesses", "recommendations")
    ]
    return df.select(*keep, summary.alias("summary"), *lists, parsed["threshold_suggestion"].alias("threshold_suggestion"))


def suggest_operations(
    profile: DataFrame, duplicate_rows: int, outliers: DataFrame | None = None, most: int | None = None, numbers: DataFrame | None = None
) -> DataFrame:
    """The operations the profile calls for, or the first ``most``, in the form the cleaning chain takes.

    Rules: more than 5 % missing, duplicates present, text that is all numbers (as ``numbers`` found it), padded
    text, values outside the fences. The profile has one row per column, so this stays small.
    """
    stats = profile
    if outliers is not None:
        small = outliers.select(F.col("column").alias("__o"), "outliers")
        stats = profile.join(F.broadcast(small), F.col("column") == F.col("__o"), "left")
    else:
        stats = profile.withColumn("outliers", F.lit(None).cast("long"))
    if numbers is not None:
        small = numbers.select(F.col("column").alias("__t"), "whole")
        stats = stats.join(F.broadcast(small), F.col("column") == F.col("__t"), "left")
    else:
        stats = stats.withColumn("whole", F.lit(None).cast("boolean"))
    numeric = F.col("is_numeric")
    choices = F.array(
        F.when(
            F.col("null_percentage") > MISSING_PERCENT,
            F.struct(
                F.lit(1).alias("rule"),
                F.lit("fill_missing").alias("operation"),
                F.when(numeric, F.lit("median")).otherwise(F.lit("mode")).alias("parameter"),
                F.col("null_percentage").alias("weight"),
            ),
        ),
        F.when(
            F.col("whole").isNotNull(),
            F.struct(
                F.lit(3).alias("rule"),
                F.lit("cast_type").alias("operation"),
                F.when(F.col("whole"), F.lit("int")).otherwise(F.lit("float")).alias("parameter"),
                F.lit(0.0).alias("weight"),
            ),
        ),
        F.when(
            (F.col("dtype") == "string") & F.col("is_categorical") & F.col("whole").isNull(),
            F.struct(
                F.lit(3).alias("rule"),
                F.lit("string_clean").alias("operation"),
                F.lit("strip").alias("parameter"),
                F.lit(0.0).alias("weight"),
            ),
        ),
        F.when(
            numeric & (F.col("outliers") > 0),
            F.struct(
                F.lit(4).alias("rule"),
                F.lit("remove_outliers").alias("operation"),
                F.lit("iqr").alias("parameter"),
                F.col("outliers").cast("double").alias("weight"),
            ),
        ),
    )
    kept = F.filter(choices, lambda x: x.isNotNull())
    rows = stats.select("column", F.inline(kept))
    if duplicate_rows:
        extra = profile.sparkSession.createDataFrame(
            [(None, 2, "drop_duplicates", "first", float(duplicate_rows))],
            "column string, rule int, operation string, parameter string, weight double",
        )
        rows = rows.unionByName(extra)
    ordered = rows.orderBy("rule", F.desc("weight"), F.asc_nulls_first("column"))
    return ordered if most is None else ordered.limit(most)


def profile_text(profile: DataFrame) -> DataFrame:
    """One text block per column for a prompt, in column order."""

    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("None"))

    stats = F.concat(
        F.lit("\n  Stats: mean="), shown("mean"), F.lit(", std="), shown("std"),
        F.lit(", min="), shown("min"), F.lit(", max="), shown("max"),
    )
    text = F.concat(
        F.col("column"), F.lit(":\n  Type: "), F.col("dtype"),
        F.lit("\n  Missing: "), F.col("null_count").cast("string"), F.lit(" ("), F.col("null_percentage").cast("string"),
        F.lit("%)\n  Unique values: "), F.col("unique_count").cast("string"),
        F.when(F.col("is_numeric"), stats).otherwise(F.lit("")),
    )
    if "samples" in profile.columns:
        text = F.concat(text, F.lit("\n  Sample: ["), F.array_join(F.slice("samples", 1, 3), ", "), F.lit("]"))
    return profile.select("position", "column", text.alias("text"))


def whole_profile_text(profile: DataFrame, rows: int, columns: int, duplicates: int) -> DataFrame:
    """The block texts of all columns under a heading; bounded by the number of columns."""
    head = f"Dataset Analysis:\n- Total rows: {rows}\n- Total columns: {columns}\n- Duplicate rows: {duplicates}\n\nColumn Details:\n"
    parts = F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda s: s["text"])
    return profile_text(profile).agg(F.concat(F.lit(head), F.array_join(parts, "\n")).alias("text"))
