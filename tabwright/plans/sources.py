"""Scans: given tables are written in a format to the scratch folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabwright.plans.base import CUSTOMER_DIRTY, EVENTS_DIRTY, query, table, view
from tabwright.session import scratch_dir
from tabwright.sources import files as S


def _written(df, fmt, **options):
    path = f"{scratch_dir(df.sparkSession).rstrip('/')}/scan-{uuid.uuid4().hex}.{fmt}"
    S.write_any(df, path, fmt, **options)
    return path


@query(
    "parquet_scan",
    "select l_orderkey, l_quantity from lineitem where l_quantity > 45 and l_shipdate >= timestamp '1997-01-01'",
)
def _(spark, sf):
    df = S.read_any(spark, f"{sf}/lineitem.parquet")
    recent = F.col("l_shipdate") >= F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")
    return df.filter((F.col("l_quantity") > 45) & recent).select("l_orderkey", "l_quantity")


@query(
    "csv_scan",
    "select c_custkey, try_cast(acctbal_txt as double) as acctbal_txt, name_txt, segment from dirty",
    dirty=CUSTOMER_DIRTY,
)
def _(spark, sf):
    path = _written(view(spark, sf, CUSTOMER_DIRTY), "csv")
    return S.read_any(spark, path)


@query(
    "tsv_scan",
    "select event_id, user_id, event_type, value from dirty",
    dirty=EVENTS_DIRTY,
)
def _(spark, sf):
    return S.read_any(spark, _written(view(spark, sf, EVENTS_DIRTY).drop("ts"), "tsv"))


@query("jsonl_scan", "select event_id, user_id, event_type, value from dirty", dirty=EVENTS_DIRTY)
def _(spark, sf):
    path = _written(view(spark, sf, EVENTS_DIRTY).drop("ts"), "jsonl")
    return S.read_any(spark, path, schema="event_id long, user_id long, event_type string, value double")


@query("json_records", "select conv_id, turn, role, text from conversations")
def _(spark, sf):
    """One array of records per file."""
    path = _written(table(spark, sf, "conversations"), "json")
    return S.read_any(spark, path, schema="conv_id long, turn long, role string, text string")


@query("feather_scan", "select event_id, user_id, event_type, value from dirty", dirty=EVENTS_DIRTY)
def _(spark, sf):
    df = view(spark, sf, EVENTS_DIRTY).drop("ts").repartition(4)
    return S.read_any(spark, _written(df, "feather"))


@query("qif_scan", "select 'payee ' || o_custkey as payee, o_totalprice as amount, strftime(o_orderdate, '%m/%d/%Y') as date from orders")
def _(spark, sf):
    """Records of several lines in files that are read in blocks."""
    o = table(spark, sf, "orders")
    lines = F.array(
        F.concat(F.lit("D"), F.date_format("o_orderdate", "MM/dd/yyyy")), F.concat(F.lit("T"), F.format_number("o_totalprice", 2)),
        F.concat(F.lit("Ppayee "), F.col("o_custkey")), F.lit("^"),
    )
    path = _text(o.select(F.array_join(lines, "\n").alias("value")), "qif")
    return S.read_any(spark, path).select("payee", "amount", "date")


@query("ofx_scan", "select o_orderkey as fitid, cast(o_totalprice as double) as amount, strftime(o_orderdate, '%Y-%m-%d') as date from orders")
def _(spark, sf):
    o = table(spark, sf, "orders")
    record = F.concat(
        F.lit("<STMTTRN>\n<TRNAMT>"), F.format_string("%.2f", "o_totalprice"), F.lit("\n<DTPOSTED>"), F.date_format("o_orderdate", "yyyyMMddHHmmss"),
        F.lit("\n<FITID>"), F.col("o_orderkey"), F.lit("\n</STMTTRN>"),
    )
    out = S.read_any(spark, _text(o.select(record.alias("value")), "ofx"))
    return out.select(F.col("fitid").cast("long").alias("fitid"), "amount", "date")


@query("ical_scan", "select 'event ' || event_id as title, event_type as location, strftime(ts, '%Y-%m-%d %H:%M') as start from events")
def _(spark, sf):
    e = table(spark, sf, "events")
    record = F.concat(
        F.lit("BEGIN:VEVENT\nSUMMARY:event "), F.col("event_id"), F.lit("\nDTSTART:"), F.date_format("ts", "yyyyMMdd'T'HHmmss"),
        F.lit("\nLOCATION:"), F.col("event_type"), F.lit("\nEND:VEVENT"),
    )
    return S.read_any(spark, _text(e.select(record.alias("value")), "ics")).select("title", "location", "start")


@query("vcard_scan", "select c_name as full_name, 'c' || c_custkey || '@x.org' as email, c_mktsegment as organization from customer")
def _(spark, sf):
    c = table(spark, sf, "customer")
    record = F.concat(
        F.lit("BEGIN:VCARD\nFN:"), F.col("c_name"), F.lit("\nEMAIL;TYPE=work:c"), F.col("c_custkey"), F.lit("@x.org\nORG:"), F.col("c_mktsegment"), F.lit("\nEND:VCARD"),
    )
    return S.read_any(spark, _text(c.select(record.alias("value")), "vcf")).select("full_name", "email", "organization")


@query("log_numbered", "select row_number() over (order by o_orderkey) as line_number, 'order ' || o_orderkey as content from orders")
def _(spark, sf):
    """Lines in no known format; the file is written by one task, as its order is what is numbered."""
    o = table(spark, sf, "orders").orderBy("o_orderkey").coalesce(1)
    return S.read_any(spark, _text(o.select(F.concat(F.lit("order "), "o_orderkey").alias("value")), "log"))


@query("csv_skip_rows", "select c_custkey as column_1, c_mktsegment as column_2 from customer")
def _(spark, sf):
    """The head line of every file is skipped, and columns get names of their own."""
    path = _written(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "csv")
    return S.read_any(spark, path, delimiter=",", skip_rows=1, has_header=False)


@query("xml_scan", "select c_custkey, c_name, c_acctbal from customer")
def _(spark, sf):
    path = f"{scratch_dir(spark).rstrip('/')}/scan-{uuid.uuid4().hex}.xml"
    wide = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    wide.write.format("xml").option("rootTag", "customers").option("rowTag", "customer").save(path)
    return S.read_any(spark, path).select("c_custkey", "c_name", "c_acctbal")


@query(
    "health_scan",
    """select 'kind ' || event_type as type, strftime(ts, '%Y-%m-%d %H:%M:%S') as "startDate", cast(event_id as varchar) as value from events""",
)
def _(spark, sf):
    path = f"{scratch_dir(spark).rstrip('/')}/scan-{uuid.uuid4().hex}.xml"
    start = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0100"))
    records = table(spark, sf, "events").select(F.concat(F.lit("kind "), "event_type").alias("_type"), start.alias("_startDate"), F.col("event_id").alias("_value"))
    records.write.format("xml").option("rootTag", "HealthData").option("rowTag", "Record").save(path)
    return S.read_any(spark, path).select("type", "startDate", "value")


@query("parquet_written", "select l_orderkey, l_linenumber, l_returnflag from lineitem")
def _(spark, sf):
    path = _written(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "parquet", partition_by=("l_returnflag",))
    return S.read_any(spark, path).select("l_orderkey", "l_linenumber", "l_returnflag")


@query("rows_as_text", "select o_orderkey, o_orderkey || ',' || o_orderstatus || ',' || o_custkey as value from orders")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), "o_orderkey", "o_orderstatus", "o_custkey")
    out = S.as_text(o.select("key", "o_orderkey", "o_orderstatus", "o_custkey"), "csv", ["key"])
    return out.withColumnRenamed("key", "o_orderkey")


@query("file_columns", """select 'parquet' as format, count(*) over () as num_columns, column_name as "column", case column_type when 'BIGINT' then 'bigint' when 'DOUBLE' then 'double' when 'INTEGER' then 'int' else 'string' end as dtype from (describe part)""")
def _(spark, sf):
    found = S.file_info(spark, f"{sf}/part.parquet")
    return found.select("format", F.col("num_columns").cast("long").alias("num_columns"), "column", "dtype")


@query("file_listing", "select '.csv' as ending, count(distinct c_mktsegment) as files, true as sized from customer")
def _(spark, sf):
    """One file for each segment, found again below its folder."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment").repartition(1)
    path = _written(c, "csv", partition_by=("c_mktsegment",))
    listed = S.file_listing(spark, path, "*.csv")
    return listed.groupBy(F.substring("name", -4, 4).alias("ending")).agg(F.count("*").alias("files"), F.min(F.col("size_bytes") > 0).alias("sized"))


@query(
    "version_save",
    """select v as version, 'orders@' || (v - 1) as parent, ['drop ' || v] as history, (select count(*) from orders where o_orderkey % v = 0) as rows
       from (values (2), (3)) as t(v)""",
)
def _(spark, sf):
    folder = f"{scratch_dir(spark).rstrip('/')}/versions-{uuid.uuid4().hex}"
    o, parts = table(spark, sf, "orders"), None
    for v in (2, 3):
        saved = S.save_version(o.where(F.col("o_orderkey") % v == 0), f"{folder}/data", "orders", f"{folder}/catalog", (f"orders@{v - 1}", v - 1), [f"drop {v}"])
        rows = spark.read.parquet(saved.first()["path"]).agg(F.count("*").alias("rows"), F.lit(v).alias("v"))
        parts = rows if parts is None else parts.unionByName(rows)
    saved = spark.read.parquet(f"{folder}/catalog")
    return saved.join(parts, saved.version == parts.v).select("version", F.col("parent_id").alias("parent"), F.col("operation_history").alias("history"), "rows")


def _text(df, ext):
    path = f"{scratch_dir(df.sparkSession).rstrip('/')}/scan-{uuid.uuid4().hex}.{ext}"
    df.write.text(path)
    return path


@query("file_size_by_column", "select 'p_partkey' as \"column\", count(*) * 8 as bytes from part union all select 'p_name', sum(strlen(p_name) + 8)::bigint from part")
def _(spark, sf):
    from tabwright.operators.profiling import table_size

    return table_size(table(spark, sf, "part").select("p_partkey", "p_name"))


@query("csv_multiline_scan", "select doc_id, md5(text) as digest from documents")
def _(spark, sf):
    path = _written(table(spark, sf, "documents").select("doc_id", "text"), "csv")
    out = S.read_any(spark, path, delimiter=",", multiline=True, schema="doc_id long, text string")
    return out.select("doc_id", F.md5("text").alias("digest"))
