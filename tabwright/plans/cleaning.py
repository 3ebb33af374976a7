"""Cleaning operations and the preprocessing vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.functions import convert
from tabwright.operators import cleaning as C
from tabwright.operators import profiling
from tabwright.session import cut_lineage
from tabwright.plans.base import CUSTOMER_DIRTY, EVENTS_DIRTY, ORDERS_DUP, query, table, view


def _round(df, *columns, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


# the two nearest-rank quartiles of the dirty values, as check SQL
QUARTILES = """
select max(case when rn = q1 then value end) as q1, max(case when rn = q3 then value end) as q3
from (select value, row_number() over (order by value) - 1 as rn,
             cast(round_even((count(*) over () - 1) * 0.25, 0) as bigint) as q1,
             cast(round_even((count(*) over () - 1) * 0.75, 0) as bigint) as q3
      from dirty where value is not null)
"""


@query(
    "fill_mean",
    """select event_id, ts, user_id, event_type,
              round(coalesce(value, (select avg(value) from dirty)), 6) as value from dirty""",
    dirty=EVENTS_DIRTY,
)
def _(spark, sf):
    return _round(C.clean_one(view(spark, sf, EVENTS_DIRTY), C.FillMissing("value", "mean")), "value")


@query(
    "fill_median",
    """select event_id, ts, user_id, event_type,
              round(coalesce(value, (select median(value) from dirty)), 6) as value from dirty""",
    dirty=EVENTS_DIRTY,
)
def _(spark, sf):
    return _round(C.clean_one(view(spark, sf, EVENTS_DIRTY), C.FillMissing("value", "median")), "value")


@query(
    "fill_mode",
    """select event_id, ts, user_id, coalesce(event_type, (select event_type from dirty where event_type is not null
              group by event_type order by count(*) desc, event_type limit 1)) as event_type, value from dirty""",
    dirty=EVENTS_DIRTY,
)
def _(spark, sf):
    return C.clean_one(view(spark, sf, EVENTS_DIRTY), C.FillMissing("event_type", "mode"))


@query(
    "fill_forward",
    """select event_id, ts, user_id, event_type, last_value(value ignore nulls) over (order by ts, event_id
              rows between unbounded preceding and current row) as value from dirty""",
    dirty=EVENTS_DIRTY,
)
def _(spark, sf):
    return C.clean_one(
        view(spark, sf, EVENTS_DIRTY), C.FillMissing("value", "forward", order_by=("ts", "event_id"))
    )


@query(
    "fill_forward_by_user",
    """select event_id, ts, user_id, event_type, last_value(value ignore nulls) over (partition by user_id
              order by ts, event_id rows between unbounded preceding and current row) as value from dirty""",
    dirty=EVENTS_DIRTY,
)
def _(spark, sf):
    op = C.FillMissing("value", "forward", order_by=("ts", "event_id"), partition_by=("user_id",))
    return C.clean_one(view(spark, sf, EVENTS_DIRTY), op)


@query(
    "fill_backward",
    """select event_id, ts, user_id, event_type, first_value(value ignore nulls) over (order by ts, event_id
              rows between current row and unbounded following) as value from dirty""",
    dirty=EVENTS_DIRTY,
)
def _(spark, sf):
    return C.clean_one(
        view(spark, sf, EVENTS_DIRTY), C.FillMissing("value", "backward", order_by=("ts", "event_id"))
    )


@query(
    "fill_constant",
    "select event_id, ts, user_id, coalesce(event_type, 'unknown') as event_type, value from dirty",
    dirty=EVENTS_DIRTY,
)
def _(spark, sf):
    op = C.FillMissing("event_type", "constant", fill_value="unknown")
    return C.clean_one(view(spark, sf, EVENTS_DIRTY), op)


_INTERPOLATE = """
select event_id, ts, user_id, event_type,
       round(coalesce(value, lo.v + (hi.v - lo.v) / (hi.at - lo.at) * (rn - lo.at)), 6) as value
from (select *, last_value(known ignore nulls) over ({part} order by ts, event_id
                  rows between unbounded preceding and current row) as lo,
             first_value(known ignore nulls) over ({part} order by ts, event_id
                  rows between current row and unbounded following) as hi
      from (select *, case when value is not null then struct_pack(v := value, at := rn) end as known
            from (select *, row_number() over ({part} order by ts, event_id) as rn from dirty)))
"""


@query("fill_interpolate", _INTERPOLATE.format(part=""), dirty=EVENTS_DIRTY)
def _(spark, sf):
    op = C.FillMissing("value", "interpolate", order_by=("ts", "event_id"))
    return _round(C.clean_one(view(spark, sf, EVENTS_DIRTY), op), "value")


@query("fill_interpolate_by_user", _INTERPOLATE.format(part="partition by user_id"), dirty=EVENTS_DIRTY)
def _(spark, sf):
    op = C.FillMissing("value", "interpolate", order_by=("ts", "event_id"), partition_by=("user_id",))
    return _round(C.clean_one(view(spark, sf, EVENTS_DIRTY), op), "value")


@query(
    "drop_null_rows",
    "select * from dirty where event_type is not null and value is not null",
    dirty=EVENTS_DIRTY,
)
def _(spark, sf):
    return C.clean_one(view(spark, sf, EVENTS_DIRTY), C.DropMissing(columns=("event_type", "value")))


@query("drop_null_columns", "select event_id, ts, user_id, event_type from dirty", dirty=EVENTS_DIRTY)
def _(spark, sf):
    # types are 9 % missing and values 14 %
    return C.clean_one(view(spark, sf, EVENTS_DIRTY), C.DropMissing(axis="columns", threshold=0.1))


@query(
    "dedup_first",
    """select o_orderkey, o_custkey, o_orderstatus, o_totalprice, seq from (select *, row_number() over
       (partition by o_custkey order by o_totalprice, o_orderkey, seq) as rn from dup) where rn = 1""",
    dup=ORDERS_DUP,
)
def _(spark, sf):
    op = C.DropDuplicates(("o_custkey",), "first", ("o_totalprice", "o_orderkey", "seq"))
    return C.clean_one(view(spark, sf, ORDERS_DUP), op)


@query(
    "dedup_last",
    """select o_orderkey, o_custkey, o_orderstatus, o_totalprice, seq from (select *, row_number() over
       (partition by o_custkey order by o_totalprice desc, o_orderkey desc, seq desc) as rn from dup) where rn = 1""",
    dup=ORDERS_DUP,
)
def _(spark, sf):
    op = C.DropDuplicates(("o_custkey",), "last", ("o_totalprice", "o_orderkey", "seq"))
    return C.clean_one(view(spark, sf, ORDERS_DUP), op)


@query(
    "dedup_none",
    """select o_orderkey, o_custkey, o_orderstatus, o_totalprice, seq from
       (select *, count(*) over (partition by o_orderkey) as n from dup) where n = 1""",
    dup=ORDERS_DUP,
)
def _(spark, sf):
    return C.clean_one(view(spark, sf, ORDERS_DUP), C.DropDuplicates(("o_orderkey",), "none"))


@query(
    "dedup_whole_rows",
    "select distinct o_custkey, o_orderstatus from dup",
    dup=ORDERS_DUP,
)
def _(spark, sf):
    return C.clean_one(view(spark, sf, ORDERS_DUP).select("o_custkey", "o_orderstatus"), C.DropDuplicates())


@query(
    "cast_types",
    """select c_custkey, try_cast(acctbal_txt as double) as acctbal_txt, cast(segment = 'BUILDING' as varchar) as flag,
              cast(c_acctbal_int as bigint) as whole
       from (select d.*, trunc(c.c_acctbal) as c_acctbal_int from dirty d join customer c using (c_custkey))""",
    dirty=CUSTOMER_DIRTY,
)
def _(spark, sf):
    df = view(spark, sf, CUSTOMER_DIRTY).join(
        table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("whole")), "c_custkey"
    )
    df = df.select("c_custkey", "acctbal_txt", (F.col("segment") == "BUILDING").alias("flag"), "whole")
    ops = [C.CastType("acctbal_txt", "float", on_error="null"), C.CastType("flag", "string"), C.CastType("whole", "int")]
    return C.clean(df, ops)


@query(
    "cast_boolean",
    """select event_id, case lower(txt) when 'true' then true when 'false' then false end as txt from
       (select event_id, case event_id % 4 when 0 then 'True' when 1 then 'FALSE' when 2 then 'yes' end as txt from events)""",
)
def _(spark, sf):
    text = F.expr("case event_id % 4 when 0 then 'True' when 1 then 'FALSE' when 2 then 'yes' end")
    df = table(spark, sf, "events").select("event_id", text.alias("txt"))
    return C.clean_one(df, C.CastType("txt", "boolean", on_error="null"))


@query(
    "cast_datetime",
    """select o_orderkey, try_strptime(txt, '%d/%m/%Y %H:%M:%S') as txt from (select o_orderkey,
         case when o_orderkey % 10 = 0 then 'unknown' else strftime(o_orderdate, '%d/%m/%Y %H:%M:%S') end as txt from orders)""",
)
def _(spark, sf):
    text = F.when(F.col("o_orderkey") % 10 == 0, F.lit("unknown")).otherwise(
        F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss")
    )
    df = table(spark, sf, "orders").select("o_orderkey", text.alias("txt"))
    return C.clean_one(df, C.CastType("txt", "datetime", "%d/%m/%Y %H:%M:%S", "null"))


@query(
    "outliers_iqr",
    """select * from dirty where value >= (select q1 - 0.5 * (q3 - q1) from q)
       and value <= (select q3 + 0.5 * (q3 - q1) from q)""",
    dirty=EVENTS_DIRTY,
    q=QUARTILES,
)
def _(spark, sf):
    return C.clean_one(view(spark, sf, EVENTS_DIRTY), C.RemoveOutliers("value", "iqr", 0.5))


@query(
    "outliers_zscore",
    """select * from dirty where abs(value - (select avg(value) from dirty)) /
       nullif((select stddev_samp(value) from dirty), 0) <= 1.5""",
    dirty=EVENTS_DIRTY,
)
def _(spark, sf):
    return C.clean_one(view(spark, sf, EVENTS_DIRTY), C.RemoveOutliers("value", "zscore"))


@query(
    "outliers_percentile",
    """select event_id, ts, user_id, event_type, value from dirty,
         (select max(case when rn = p1 then value end) as low, max(case when rn = p9 then value end) as high from
           (select value, row_number() over (order by value) - 1 as rn,
                   cast(round_even((count(*) over () - 1) * 0.01, 0) as bigint) as p1,
                   cast(round_even((count(*) over () - 1) * 0.99, 0) as bigint) as p9
            from dirty where value is not null)) where value between low and high""",
    dirty=EVENTS_DIRTY,
)
def _(spark, sf):
    return C.clean_one(view(spark, sf, EVENTS_DIRTY), C.RemoveOutliers("value", "percentile"))


@query(
    "standardize",
    """select event_id, ts, user_id, event_type, round((value - (select avg(value) from dirty)) /
       nullif((select stddev_samp(value) from dirty), 0), 6) as value from dirty""",
    dirty=EVENTS_DIRTY,
)
def _(spark, sf):
    return _round(C.clean_one(view(spark, sf, EVENTS_DIRTY), C.Standardize("value")), "value")


@query(
    "normalize",
    """select event_id, ts, user_id, event_type, round((value - (select min(value) from dirty)) /
       nullif((select max(value) - min(value) from dirty), 0), 6) as value from dirty""",
    dirty=EVENTS_DIRTY,
)
def _(spark, sf):
    return _round(C.clean_one(view(spark, sf, EVENTS_DIRTY), C.Normalize("value")), "value")


def _string_query(name, ops, sql):
    @query(
        name,
        f"select c_custkey, acctbal_txt, {sql} as name_txt, segment from dirty",
        dirty=CUSTOMER_DIRTY,
    )
    def _(spark, sf):
        return C.clean_one(view(spark, sf, CUSTOMER_DIRTY), C.StringClean("name_txt", ops))


_SPACE = r"[\t-\r \x{85}\p{Z}]"
_STRIP = rf"regexp_replace(name_txt, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
_string_query("str_lower", ("lowercase",), "lower(name_txt)")
_string_query("str_upper", ("uppercase",), "upper(name_txt)")
_string_query("str_strip", ("strip",), _STRIP)
_string_query(
    "str_remove_special",
    ("remove_special",),
    r"regexp_replace(name_txt, '[^a-zA-Z0-9\t-\r \x{85}\p{Z}]', '', 'g')",
)
_string_query("str_remove_numbers", ("remove_numbers",), r"regexp_replace(name_txt, '\p{Nd}', '', 'g')")
_string_query("str_collapse_ws", ("remove_whitespace",), rf"regexp_replace(name_txt, '{_SPACE}+', ' ', 'g')")
_string_query(
    "str_ops_in_order",
    ("strip", "lowercase", "remove_numbers", "remove_whitespace"),
    rf"regexp_replace(regexp_replace(lower({_STRIP}), '\p{{Nd}}', '', 'g'), '{_SPACE}+', ' ', 'g')",
)


@query(
    "documents_string_clean",
    rf"""select doc_id, md5(regexp_replace(lower(regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g')),
          '{_SPACE}+', ' ', 'g')) as digest from documents""",
)
def _(spark, sf):
    op = C.StringClean("text", ("strip", "lowercase", "remove_whitespace"))
    df = C.clean_one(table(spark, sf, "documents").select("doc_id", "text"), op)
    return df.select("doc_id", F.md5("text").alias("digest"))


@query("rename", "select c_custkey, acctbal_txt as balance, name_txt, segment from dirty", dirty=CUSTOMER_DIRTY)
def _(spark, sf):
    return C.clean_one(view(spark, sf, CUSTOMER_DIRTY), C.RenameColumn("acctbal_txt", "balance"))


@query("drop_column", "select c_custkey, segment from dirty", dirty=CUSTOMER_DIRTY)
def _(spark, sf):
    return C.clean(view(spark, sf, CUSTOMER_DIRTY), [C.DropColumn("acctbal_txt"), C.DropColumn("name_txt")])


@query(
    "label_encode",
    """select c_custkey, acctbal_txt, name_txt,
              cast((select count(distinct s.segment) from dirty s where s.segment < d.segment) + 1 as bigint)
              - case when segment is null then 1 else 0 end as segment from dirty d""",
    dirty=CUSTOMER_DIRTY,
)
def _(spark, sf):
    return C.clean_one(view(spark, sf, CUSTOMER_DIRTY), C.EncodeCategorical("segment"))


@query(
    "label_encode_wide",
    """select c_custkey, acctbal_txt, pos as name_txt, segment from dirty join (select name_txt,
         row_number() over (order by name_txt) - 1 as pos from (select distinct name_txt from dirty)) using (name_txt)""",
    dirty=CUSTOMER_DIRTY,
)
def _(spark, sf):
    return C.clean_one(view(spark, sf, CUSTOMER_DIRTY), C.EncodeCategorical("name_txt"))


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(
    "onehot",
    "select c_custkey, acctbal_txt, name_txt, cast(segment is null as integer) as segment_null, "
    + ", ".join(f"cast(coalesce(segment = '{s}', false) as integer) as \"segment_{s}\"" for s in _SEGMENTS)
    + " from dirty",
    dirty=CUSTOMER_DIRTY,
)
def _(spark, sf):
    return C.clean_one(view(spark, sf, CUSTOMER_DIRTY), C.EncodeCategorical("segment", "onehot"))


CHAIN = (
    {"operation": "fill_missing", "column": "event_type", "description": "fill types", "confidence": 0.9,
     "parameters": {"strategy": "mode"}},
    {"operation": "fill_missing", "column": "value", "description": "fill values", "confidence": 0.9,
     "parameters": {"strategy": "median"}},
    {"operation": "string_clean", "column": "event_type", "description": "upper case", "confidence": 0.7,
     "parameters": {"operations": ["strip", "uppercase"]}},
    {"operation": "no_such_operation", "description": "skipped", "confidence": 0.1},
    {"operation": "drop_duplicates", "description": "newest row per user", "confidence": 0.8,
     "parameters": {"columns": ["user_id"], "keep": "last", "order_by": ["ts", "event_id"]}},
    {"operation": "rename_column", "column": "value", "description": "rename", "confidence": 0.8,
     "parameters": {"new_name": "amount"}},
)

_CHAIN_SQL = """
select event_id, ts, user_id, upper(event_type) as event_type, amount from
  (select event_id, ts, user_id, coalesce(event_type, (select event_type from dirty where event_type is not null
            group by event_type order by count(*) desc, event_type limit 1)) as event_type,
          coalesce(value, (select median(value) from dirty)) as amount,
          row_number() over (partition by user_id order by ts desc, event_id desc) as rn from dirty) where rn = 1
"""


@query("clean_chain", _CHAIN_SQL, dirty=EVENTS_DIRTY)
def _(spark, sf):
    return C.apply_records(view(spark, sf, EVENTS_DIRTY), CHAIN).df


@query("clean_preview", "select * from dirty where value is not null order by event_id limit 20", dirty=EVENTS_DIRTY)
def _(spark, sf):
    df = view(spark, sf, EVENTS_DIRTY)
    records = [{"operation": "drop_missing", "parameters": {"columns": ["value"]}}]
    return profiling.preview(C.apply_records(df, records).df, ["event_id"], 20)


@query(
    "clean_report",
    """select * from (values
         (1, 'drop_missing', (select count(*) from dirty), (select count(*) from dirty where value is not null), 5, 5),
         (2, 'filter_rows', (select count(*) from dirty where value is not null), (select count(*) from dirty where value > 50), 5, 5),
         (3, 'drop_column', (select count(*) from dirty where value > 50), (select count(*) from dirty where value > 50), 5, 4))
       as t(step, operation, rows_before, rows_after, columns_before, columns_after)""",
    dirty=EVENTS_DIRTY,
)
def _(spark, sf):
    ops = [C.DropMissing(columns=("value",)), C.FilterRows("value", "gt", 50.0), C.DropColumn("event_type")]
    return C.chain_report(view(spark, sf, EVENTS_DIRTY), ops)


@query(
    "create_feature",
    """select l_orderkey, l_linenumber, l_extendedprice, l_discount,
              l_extendedprice * l_discount as saved, l_extendedprice / nullif(l_discount, 0) as ratio from lineitem""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    ops = [
        C.CreateFeature("l_extendedprice", "saved", "multiply", "l_discount"),
        C.CreateFeature("l_extendedprice", "ratio", "divide", "l_discount"),
    ]
    return C.clean(df, ops)


def _filter_query(name, column, condition, value, sql):
    @query(name, f"select * from dirty where {sql}", dirty=EVENTS_DIRTY)
    def _(spark, sf):
        return C.clean_one(view(spark, sf, EVENTS_DIRTY), C.FilterRows(column, condition, value))


_filter_query("filter_gt", "value", "gt", 50.0, "value > 50")
_filter_query("filter_lt", "value", "lt", 50.0, "value < 50")
_filter_query("filter_eq", "event_type", "eq", "click", "event_type = 'click'")
_filter_query("filter_ne", "event_type", "ne", "click", "event_type <> 'click'")
_filter_query("filter_contains", "event_type", "contains", "^p.*e$", "regexp_matches(event_type, '^p.*e$')")


@query(
    "preprocess_task",
    "select event_id, ts, user_id, event_type as kind, cast(value as bigint) as value from dirty where value > 10",
    dirty=EVENTS_DIRTY.replace("value end as value", "floor(value) end as value"),
)
def _(spark, sf):
    df = view(spark, sf, EVENTS_DIRTY).withColumn("value", F.floor("value").cast("double"))
    steps = [
        {"op": "drop_nulls", "columns": ["value"]},
        {"op": "filter", "column": "value", "condition": "gt", "value": 10},
        {"op": "cast_type", "column": "value", "dtype": "int"},
        {"op": "cast_type", "column": "missing", "dtype": "int"},
        {"op": "rename_column", "old_name": "event_type", "new_name": "kind"},
    ]
    return C.preprocess_records(df, steps).df


@query(
    "null_markers",
    """select c_custkey, case when acctbal_txt not in ('', 'NA', 'N/A', 'null', 'NULL', 'None', 'nan', 'NaN', '.')
              then acctbal_txt end as acctbal_txt, name_txt, segment from dirty""",
    dirty=CUSTOMER_DIRTY,
)
def _(spark, sf):
    return convert.null_markers(view(spark, sf, CUSTOMER_DIRTY))


@query(
    "infer_types",
    "select c_custkey, try_cast(acctbal_txt as double) as acctbal_txt, name_txt, segment from dirty",
    dirty=CUSTOMER_DIRTY,
)
def _(spark, sf):
    return convert.infer_types(convert.null_markers(view(spark, sf, CUSTOMER_DIRTY)))


@query(
    "blank_to_null",
    """select c_custkey, nullif(trim(acctbal_txt), '') as acctbal_txt from dirty""",
    dirty=CUSTOMER_DIRTY,
)
def _(spark, sf):
    df = view(spark, sf, CUSTOMER_DIRTY)
    return df.select("c_custkey", convert.blank_to_null(F.col("acctbal_txt")).alias("acctbal_txt"))


_CLEANED = """
select event_id, ts, user_id, event_type, value from
  (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as rn from
    (select event_id, ts, user_id, event_type, coalesce(value, (select median(value) from dirty)) as value from dirty))
where rn = 1
"""


@query(
    "clean_then_profile",
    """select 0 as position, 'event_id' as "column", 'bigint' as dtype, count(*) as "rows", count(event_id) as non_null,
              cast(0 as bigint) as nulls, count(distinct event_id) as unique_values, round(avg(event_id), 3) as mean,
              round(stddev_samp(event_id), 3) as std, cast(min(event_id) as double) as min, cast(max(event_id) as double) as max from kept
       union all
       select 1, 'ts', 'timestamp_ntz', count(*), count(ts), 0, count(distinct ts), null, null, null, null from kept
       union all
       select 2, 'user_id', 'bigint', count(*), count(user_id), 0, count(distinct user_id), round(avg(user_id), 3),
              round(stddev_samp(user_id), 3), min(user_id), max(user_id) from kept
       union all
       select 3, 'event_type', 'string', count(*), count(event_type), count(*) - count(event_type),
              count(distinct event_type) + max(case when event_type is null then 1 else 0 end), null, null, null, null from kept
       union all
       select 4, 'value', 'double', count(*), count(value), 0, count(distinct value), round(avg(value), 3),
              round(stddev_samp(value), 3), min(value), max(value) from kept""",
    dirty=EVENTS_DIRTY,
    cleaned=_CLEANED,
    kept=f"""select * from cleaned where value between
             (select q1 - 0.25 * (q3 - q1) from ({QUARTILES.replace('dirty', 'cleaned')})) and
             (select q3 + 0.25 * (q3 - q1) from ({QUARTILES.replace('dirty', 'cleaned')}))""",
)
def _(spark, sf):
    ops = [
        C.FillMissing("value", "median"),
        C.DropDuplicates(("user_id", "event_type"), "first", ("ts", "event_id")),
        C.RemoveOutliers("value", "iqr", 0.25),
    ]
    stats = profiling.column_stats(cut_lineage(C.clean(view(spark, sf, EVENTS_DIRTY), ops)))
    return _round(stats.drop("is_numeric"), "mean", "std", digits=3)
