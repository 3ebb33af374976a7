"""Log analytics, streaming twins and text records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import logs as L
from tabwright.operators import profiling as P
from tabwright.operators import replies as R
from tabwright.plans.base import APPLOG, EVENTS_DIRTY, REPLIES, STATEMENTS, query, table, view
from tabwright.sources import files, records

_PATTERN = r"'^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+)\s*\|\s*(\w+)\s*\|\s*([^|]+)\s*-\s*(.*)'"


def _part(i: int) -> str:
    return f"trim(regexp_extract(line, {_PATTERN}, {i}))"


# one second per event keeps the times apart
PARSED = f"""
select event_id, strptime(substr({_part(1)}, 1, 19), '%Y-%m-%d %H:%M:%S') + interval 1 second * (event_id % 86400) as timestamp,
       {_part(2)} as level, {_part(3)} as source, {_part(4)} as message from applog
where regexp_matches(line, {_PATTERN})
"""


def _parsed(spark, sf):
    out = L.parse_app_log(view(spark, sf, APPLOG), "line", ["event_id"])
    shifted = F.col("timestamp") + F.make_dt_interval(secs=(F.col("event_id") % 86400).cast("decimal(18,6)"))
    return out.withColumn("timestamp", shifted)


def _log_query(name, sql, build):
    @query(name, sql, applog=APPLOG, parsed=PARSED)
    def _(spark, sf):
        return build(_parsed(spark, sf))


_log_query("log_parse", "select * from parsed", lambda d: d)
_log_query(
    "log_filter",
    """select * from parsed where upper(level) = 'ERROR' and contains(lower(source), 'mod3') and contains(lower(message), 'c')
       and timestamp >= timestamp '2024-01-01 00:10:00' and timestamp <= timestamp '2024-01-01 02:00:00'""",
    lambda d: L.filter_log(d, "error", "MOD3", "C", "2024-01-01 00:10:00", "2024-01-01 02:00:00"),
)
_log_query(
    "log_search",
    "select * from parsed where contains(lower(message), 'mod4') or contains(lower(source), 'mod4')",
    lambda d: L.search_log(d, "Mod4"),
)
_log_query(
    "log_page",
    """select *, (select count(*) from parsed) as total, (select count(*) from parsed) > 200 as has_more from parsed
       order by timestamp desc, event_id limit 100 offset 100""",
    lambda d: L.log_page(d, 2, 100, ["event_id"]),
)
_log_query(
    "log_stats",
    """select count(*) as total, count(*) filter (level = 'DEBUG') as debug, count(*) filter (level = 'INFO') as info,
         count(*) filter (level = 'WARNING') as warning, count(*) filter (level = 'ERROR') as error,
         min(timestamp) as oldest, max(timestamp) as newest from parsed""",
    L.log_stats,
)
_log_query(
    "log_recent",
    "select * from parsed where level = 'WARNING' order by timestamp desc, event_id limit 50",
    lambda d: L.log_recent(d, 50, "warning", ["event_id"]),
)
_log_query("log_sources", "select distinct source from parsed", L.log_sources)

_SYSLOG = "concat('Jan ', cast(event_id % 28 + 1 as varchar(3)), ' 10:00:00 host', cast(user_id as varchar(9)), ' app', ': ', event_type)"


@query(
    "log_detect",
    """select 'syslog' as format, event_id, 'Jan ' || cast(event_id % 28 + 1 as varchar) || ' 10:00:00' as timestamp,
         'host' || cast(user_id as varchar) as host, 'app' as process, event_type as message from events""",
)
def _(spark, sf):
    lines = table(spark, sf, "events").select("event_id", F.expr(_SYSLOG).alias("line"))
    kind = L.detect_format(lines, "line")
    return L.parse_lines(lines, "line", kind, ["event_id"]).withColumn("format", F.lit(kind))


@query(
    "change_only",
    """select event_id, ts, user_id, event_type from (select *, lag(event_type) over w as was, row_number() over w as rn
         from events window w as (partition by user_id order by ts, event_id)) where rn = 1 or was is distinct from event_type""",
)
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    return L.change_only(df, ["user_id"], "event_type", ["ts", "event_id"])


@query(
    "window_counts",
    """select time_bucket(interval 10 minutes, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total
       from events group by 1, 2""",
)
def _(spark, sf):
    from tabwright.streaming.jobs import window_counts

    out = window_counts(table(spark, sf, "events"), "ts", "event_type", "value", "10 minutes")
    return out.withColumn("total", F.round("total", 4))


# --- text records ---------------------------------------------------------------------------


@query(
    "ofx_extract",
    """select o_custkey, 0 as position, 'DEBIT' as trntype, cast(null as varchar) as fitid, 'n' || cast(o_custkey as varchar) as name,
         cast(null as varchar) as memo, cast(null as varchar) as checknum, cast(o_orderkey + 0.25 as double) as amount, cast(null as varchar) as trnamt, '2024-01-02' as date from orders
       union all select o_custkey, 1, null, null, null, null, null, 7.0, null, null from orders""",
)
def _(spark, sf):
    return records.ofx(view(spark, sf, STATEMENTS), "content", ["o_custkey"])


@query(
    "qif_extract",
    """select o_orderkey, 0 as position, strftime(o_orderdate, '%m/%d/%Y') as date, 'payee ' || cast(o_custkey as varchar) as payee,
         'second memo' as memo, '*' as cleared, cast(null as varchar) as number, o_orderpriority as category,
         cast(o_custkey as double) as amount, cast(null as varchar) as amount_raw from orders
       union all select o_orderkey, 1, null, null, null, null, null, null, null, 'n/a' from orders""",
)
def _(spark, sf):
    text = F.concat(
        F.lit("!Type:Bank\nD"), F.date_format("o_orderdate", "MM/dd/yyyy"),
        F.lit("\nT$"), F.col("o_custkey").cast("string"), F.lit(".00\nPpayee "), F.col("o_custkey").cast("string"),
        F.lit("\nMfirst memo\nMsecond memo\nC*\nL"), F.col("o_orderpriority"), F.lit("\n^\nTn/a\n^\n"),
    )
    return records.qif(table(spark, sf, "orders").select("o_orderkey", text.alias("content")), "content", ["o_orderkey"])


@query(
    "ical_extract",
    """select event_id, 0 as position, event_type as title, strftime(ts, '%Y-%m-%d %H:%M') as "start", strftime(ts, '%Y-%m-%d') as "end",
         'a:b' as description, cast(null as varchar) as location, cast(null as varchar) as organizer, cast(null as varchar) as status,
         cast(event_id as varchar) as uid, '5' as sequence from events""",
)
def _(spark, sf):
    text = F.concat(
        F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY;LANGUAGE=en:"), F.col("event_type"),
        F.lit("\r\nDTSTART;TZID=UTC:"), F.date_format("ts", "yyyyMMdd'T'HHmmss"),
        F.lit("\r\nDTEND:"), F.date_format("ts", "yyyyMMdd"), F.lit("\r\nDESCRIPTION:a:b\r\nSEQUENCE:5\r\nUID:"),
        F.col("event_id").cast("string"), F.lit("\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"),
    )
    out = records.ical(table(spark, sf, "events").select("event_id", text.alias("content")), "content", ["event_id"])
    return out.withColumn("sequence", F.col("other")["sequence"]).drop("other")


@query(
    "vcard_extract",
    """select c_custkey, 0 as position, c_name as full_name, 'Last' as last_name, 'F' || cast(c_custkey as varchar) as first_name,
         'a@x' as email, 'c@x' as email2, cast(c_nationkey as varchar) as phone, cast(null as varchar) as phone2, c_mktsegment as organization,
         cast(null as varchar) as title, 'City' as city, 'ST' as state, '123' as postal_code, 'DE' as country,
         cast(null as varchar) as birthday, 'n;o' as notes from customer""",
)
def _(spark, sf):
    text = F.concat(
        F.lit("BEGIN:VCARD\nVERSION:3.0\nFN:"), F.col("c_name"), F.lit("\nN:Last;F"), F.col("c_custkey").cast("string"),
        F.lit(";;\nEMAIL;TYPE=home:a@x\nEMAIL:b@x\nEMAIL:c@x\nTEL:"), F.col("c_nationkey").cast("string"),
        F.lit("\nORG:"), F.col("c_mktsegment"), F.lit("\nADR:;;Street;City;ST;123;DE\nNOTE:n;o\nEND:VCARD\n"),
    )
    return records.vcard(table(spark, sf, "customer").select("c_custkey", text.alias("content")), "content", ["c_custkey"])


@query(
    "content_checksum",
    """select sha256(text) as checksum, min(doc_id) as keep_id, count(*) as copies, count(*) - 1 as extra_copies
       from documents group by 1""",
)
def _(spark, sf):
    return files.content_groups(table(spark, sf, "documents"), "text", "doc_id")


# --- replies and suggestions ------------------------------------------------------------------


@query(
    "fenced_json",
    """select conv_id, turn, json_extract_string(o, '$.operation') as operation, cast(null as varchar) as "column",
         json_extract_string(o, '$.description') as description, cast(json_extract_string(o, '$.confidence') as double) as confidence
       from (select conv_id, turn, unnest(from_json(trim(split_part(split_part(reply, '```json', 2), '```', 1), chr(10)), '["JSON"]')) as o from replies)
       where json_extract_string(o, '$.confidence') is not null""",
    replies=REPLIES,
)
def _(spark, sf):
    out = R.reply_operations(view(spark, sf, REPLIES), "reply", ["conv_id", "turn"])
    return out.select("conv_id", "turn", "operation", "column", "description", "confidence")


@query(
    "reply_explanation",
    """select conv_id, turn, case when turn % 2 = 0 then 'about ' || role else 'plain ' || role end as summary,
         case when turn % 2 = 0 then ['fast'] else [] end as strengths, cast([] as varchar[]) as weaknesses, cast([] as varchar[]) as recommendations
       from conversations""",
)
def _(spark, sf):
    reply = F.when(
        F.col("turn") % 2 == 0,
        F.concat(F.lit('ok\n```\n{"summary":"about '), F.col("role"), F.lit('","strengths":["fast"]}\n```')),
    ).otherwise(F.concat(F.lit("plain "), F.col("role")))
    df = table(spark, sf, "conversations").select("conv_id", "turn", reply.alias("reply"))
    return R.reply_explanation(df, "reply", ["conv_id", "turn"]).drop("threshold_suggestion")


@query(
    "suggest_ops",
    """with f as (select q1 - 1.5 * (q3 - q1) as low, q3 + 1.5 * (q3 - q1) as high from (select
             max(case when rn = cast(round_even((n - 1) * 0.25, 0) as bigint) then value end) as q1,
             max(case when rn = cast(round_even((n - 1) * 0.75, 0) as bigint) then value end) as q3
           from (select value, row_number() over (order by value) - 1 as rn, count(*) over () as n from dirty where value is not null))),
          s as (select 'event_type' as "column", 1 as rule, 'fill_missing' as operation, 'mode' as parameter,
                   round((select count(*) - count(event_type) from dirty) * 100.0 / (select count(*) from dirty), 2) as weight
                union all select 'value', 1, 'fill_missing', 'median', round((select count(*) - count(value) from dirty) * 100.0 / (select count(*) from dirty), 2)
                union all select 'event_type', 3, 'string_clean', 'strip', 0.0
                union all select 'value', 4, 'remove_outliers', 'iqr', cast((select count(*) from dirty, f where value < low or value > high) as double))
       select * from s where not (rule = 4 and weight = 0) order by rule, weight desc, "column" limit 5""",
    dirty=EVENTS_DIRTY,
)
def _(spark, sf):
    df = view(spark, sf, EVENTS_DIRTY)
    duplicates = P.duplicate_count(df).first()[0]
    return R.suggest_operations(P.profile(df), duplicates, P.outlier_counts(df, ["value"]))


@query(
    "suggest_casts",
    """select 'price' as "column", 3 as rule, 'cast_type' as operation, 'float' as parameter, 0.0::double as weight
       union all select 'size', 3, 'cast_type', 'int', 0.0 from (select count(*) as n from part) where n > 0
       union all select 'kind', 3, 'string_clean', 'strip', 0.0 from part having count(distinct p_type) < count(*) * 0.05""",
)
def _(spark, sf):
    df = table(spark, sf, "part").select(
        F.format_string(" %.2f", F.col("p_retailprice") + 0.25).alias("price"), F.col("p_size").cast("string").alias("size"), F.col("p_type").alias("kind")
    )
    return R.suggest_operations(P.profile(df), 0, numbers=P.number_texts(df))


@query(
    "profile_text",
    """select 0 as position, 'event_type' as "column", 'event_type:' || chr(10) || '  Type: string' || chr(10) || '  Missing: ' ||
         cast(count(*) - count(event_type) as varchar) || ' (' || cast(round((count(*) - count(event_type)) * 100.0 / count(*), 2) as varchar) || '%)' ||
         chr(10) || '  Unique values: ' || cast(count(distinct event_type) + 1 as varchar) as text from dirty
       union all select 1, 'user_id', 'user_id:' || chr(10) || '  Type: bigint' || chr(10) || '  Missing: 0 (0.0%)' ||
         chr(10) || '  Unique values: ' || cast(count(distinct user_id) as varchar) || chr(10) || '  Stats: mean=' || cast(round(avg(user_id), 2) as varchar) ||
         ', std=' || cast(round(stddev_samp(user_id), 2) as varchar) || ', min=' || cast(cast(min(user_id) as double) as varchar) ||
         ', max=' || cast(cast(max(user_id) as double) as varchar) from dirty""",
    dirty=EVENTS_DIRTY,
)
def _(spark, sf):
    profile = P.profile(view(spark, sf, EVENTS_DIRTY).select("event_type", "user_id"))
    rounded = profile.withColumn("mean", F.round("mean", 2)).withColumn("std", F.round("std", 2))
    return R.profile_text(rounded)
