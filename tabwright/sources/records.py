"""Row extraction from bank, calendar and contact texts, as column expressions over a text column.

Each function takes a DataFrame with one document (or block) per row and returns one row per
record, so a folder of many files is read in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Field names of the formats.
OFX_FIELDS = ("TRNTYPE", "DTPOSTED", "TRNAMT", "FITID", "NAME", "MEMO", "CHECKNUM")
QIF_FIELDS = {"D": "date", "P": "payee", "M": "memo", "C": "cleared", "N": "number", "L": "category"}
ICAL_FIELDS = {
    "SUMMARY": "title", "DTSTART": "start", "DTEND": "end", "DESCRIPTION": "description",
    "LOCATION": "location", "ORGANIZER": "organizer", "STATUS": "status", "UID": "uid",
}

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number(c: Column) -> Column:
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def iso_date(c: Column) -> Column:
    return F.concat(F.substring(c, 1, 4), F.lit("-"), F.substring(c, 5, 2), F.lit("-"), F.substring(c, 7, 2))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), _strip)


def ofx(df: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """Transactions of bank statements, with or without closing tags."""
    c = F.col(text)
    closed = F.regexp_extract_all(c, F.lit(r"(?is)<STMTTRN>(.*?)</STMTTRN>"), F.lit(1))
    opened = F.regexp_extract_all(c, F.lit(r"(?is)<STMTTRN>(.*?)(?=<STMTTRN>|</BANKTRANLIST>|$)"), F.lit(1))
    blocks = F.when(F.size(closed) > 0, closed).otherwise(opened)
    rows = df.select(*keep, F.posexplode(blocks).alias("position", "__block"))
    b = F.col("__block")

    def field(name: str) -> Column:
        xml, sgml = rf"(?i)<{name}>(.*?)</{name}>", rf"(?i)<{name}>([^<\n]+)"
        return F.when(b.rlike(xml), _strip(F.regexp_extract(b, xml, 1))).when(
            b.rlike(sgml), _strip(F.regexp_extract(b, sgml, 1))
        )

    raw = rows.select(*keep, "position", *[field(f).alias(f.lower()) for f in OFX_FIELDS])
    amount = number(F.col("trnamt"))
    some = F.coalesce(*[F.col(f.lower()) for f in OFX_FIELDS]).isNotNull()
    return raw.filter(some).select(
        *keep,
        "position",
        "trntype",
        "fitid",
        "name",
        "memo",
        "checknum",
        amount.alias("amount"),
        F.when(amount.isNull(), F.col("trnamt")).alias("trnamt"),
        iso_date(F.col("dtposted")).alias("date"),
    )


def _last(lines: Column, test) -> Column:
    found = F.filter(lines, test)
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def _starts(letter: str):
    return lambda x: x.startswith(letter)


def qif(df: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """Records ended by a caret line; a repeated field keeps its last value."""
    records = F.split(F.concat(F.lit("\n"), F.col(text)), r"\n\s*\^[^\n]*")
    rows = df.select(*keep, F.posexplode(records).alias("position", "__record"))
    rows = rows.withColumn("__lines", _lines(F.col("__record")))
    lines = F.col("__lines")
    cols = []
    for letter, name in QIF_FIELDS.items():
        cols.append(F.substring(_last(lines, _starts(letter)), 2, 2**31 - 1).alias(name))
    sums = F.transform(
        F.filter(lines, lambda x: x.startswith("T") | x.startswith("U")), lambda x: F.substring(x, 2, 2**31 - 1)
    )

    def value(x: Column) -> Column:
        return number(F.regexp_replace(x, r"[,$]", ""))

    good, bad = F.filter(sums, lambda x: value(x).isNotNull()), F.filter(sums, lambda x: value(x).isNull())
    cols.append(F.when(F.size(good) > 0, value(F.element_at(good, -1))).alias("amount"))
    cols.append(F.when(F.size(bad) > 0, F.element_at(bad, -1)).alias("amount_raw"))
    out = rows.select(*keep, "position", *cols)
    names = [*QIF_FIELDS.values(), "amount_raw"]
    return out.filter(F.coalesce(*[F.col(n) for n in names], F.col("amount").cast("string")).isNotNull())


def _blocks(df: DataFrame, text: str, kind: str, keep: Sequence[str]) -> DataFrame:
    """One row per BEGIN/END block with its property lines as (prop, value) pairs."""
    joined = F.array_join(_lines(F.col(text)), "\n")
    found = F.regexp_extract_all(joined, F.lit(rf"(?ms)^BEGIN:{kind}$(.*?)^END:{kind}$"), F.lit(1))
    rows = df.select(*keep, F.posexplode(found).alias("position", "__body"))
    # a block that starts again inside drops what came before
    body = F.substring_index(F.col("__body"), f"\nBEGIN:{kind}\n", -1)
    lines = F.filter(F.split(body, "\n"), lambda x: x.contains(":"))
    pairs = F.transform(
        lines,
        lambda x: F.struct(
            F.substring_index(F.substring_index(x, ":", 1), ";", 1).alias("prop"),
            F.substring(x, F.position(F.lit(":"), x) + 1, F.length(x)).alias("value"),
        ),
    )
    return rows.select(*keep, "position", pairs.alias("__pairs"))


def _values(prop: str) -> Column:
    return F.transform(F.filter(F.col("__pairs"), lambda p: p["prop"] == prop), lambda p: p["value"])


def _last_value(prop: str) -> Column:
    values = _values(prop)
    return F.when(F.size(values) > 0, F.element_at(values, -1))


def ical_moment(c: Column) -> Column:
    """``YYYYMMDD[THHMMSS]`` to ``YYYY-MM-DD[ HH:MM]``; short values stay as they are."""
    time = F.substring(F.get(F.split(c, "T"), F.lit(1)), 1, 6)
    clock = F.concat(F.lit(" "), F.substring(time, 1, 2), F.lit(":"), F.substring(time, 3, 2))
    with_time = F.when((F.length(c) > 8) & c.contains("T") & (F.length(time) >= 4), clock).otherwise(F.lit(""))
    return F.when(F.length(c) >= 8, F.concat(iso_date(F.substring(c, 1, 8)), with_time)).otherwise(c)


def ical(df: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """Calendar events; properties without a column of their own go to the map ``other``."""
    rows = _blocks(df, text, "VEVENT", keep)
    cols = []
    for prop, name in ICAL_FIELDS.items():
        value = _last_value(prop)
        cols.append((ical_moment(value) if name in ("start", "end") else value).alias(name))
    rest = F.filter(F.col("__pairs"), lambda p: ~p["prop"].isin(*ICAL_FIELDS))
    empty = F.create_map().cast("map<string,string>")
    other = F.aggregate(
        rest,
        empty,
        lambda m, p: F.map_concat(
            F.map_filter(m, lambda k, _: k != F.lower(p["prop"])), F.create_map(F.lower(p["prop"]), p["value"])
        ),
    )
    return rows.filter(F.size("__pairs") > 0).select(*keep, "position", *cols, other.alias("other"))


def _second(prop: str) -> Column:
    """The last value when there is more than one: a third entry replaces the second."""
    values = _values(prop)
    return F.when(F.size(values) > 1, F.element_at(values, -1))


def _first(prop: str) -> Column:
    return F.get(_values(prop), F.lit(0))


def vcard(df: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    rows = _blocks(df, text, "VCARD", keep)

    def split_last(prop: str, least: int) -> Column:
        fits = F.filter(F.transform(_values(prop), lambda v: F.split(v, ";")), lambda p: F.size(p) >= least)
        return F.when(F.size(fits) > 0, F.element_at(fits, -1))

    rows = rows.withColumn("__n", split_last("N", 2)).withColumn("__adr", split_last("ADR", 7))
    return rows.select(
        *keep,
        "position",
        _last_value("FN").alias("full_name"),
        F.get("__n", F.lit(0)).alias("last_name"),
        F.get("__n", F.lit(1)).alias("first_name"),
        _first("EMAIL").alias("email"),
        _second("EMAIL").alias("email2"),
        _first("TEL").alias("phone"),
        _second("TEL").alias("phone2"),
        _last_value("ORG").alias("organization"),
        _last_value("TITLE").alias("title"),
        F.get("__adr", F.lit(3)).alias("city"),
        F.get("__adr", F.lit(4)).alias("state"),
        F.get("__adr", F.lit(5)).alias("postal_code"),
        F.get("__adr", F.lit(6)).alias("country"),
        _last_value("BDAY").alias("birthday"),
        _last_value("NOTE").alias("notes"),
    )
