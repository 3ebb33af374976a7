"""Dataset profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import profiling as P
from tabwright.plans.base import CUSTOMER_DIRTY, EVENTS_DIRTY, ORDERS_DUP, query, table, view
from tabwright.plans.cleaning import QUARTILES


def _stats_sql(columns: list[tuple[str, str, bool]], source: str, digits: int = 3) -> str:
    """Check SQL: one row per (name, type, numeric) column."""
    parts = []
    for i, (c, dtype, numeric) in enumerate(columns):
        if numeric:
            tail = (
                f"round(avg({c}), {digits}) as mean, round(stddev_samp({c}), {digits}) as std, "
                f"cast(min({c}) as double) as min, cast(max({c}) as double) as max"
            )
        else:
            empty = "cast(null as double)"
            tail = f"{empty} as mean, {empty} as std, {empty} as min, {empty} as max"
        parts.append(
            f"""select {i} as position, '{c}' as "column", '{dtype}' as dtype, {str(numeric).lower()} as is_numeric,
                count(*) as "rows", count({c}) as non_null, count(*) - count({c}) as nulls, {tail},
                count(distinct {c}) + cast(max(case when {c} is null then 1 else 0 end) as bigint) as unique_values
                from {source}"""
        )
    return " union all ".join(parts)


EVENT_COLUMNS = [
    ("event_id", "bigint", True),
    ("ts", "timestamp_ntz", False),
    ("user_id", "bigint", True),
    ("event_type", "string", False),
    ("value", "double", True),
]

LINEITEM_COLUMNS = [
    ("l_orderkey", "bigint", True), ("l_partkey", "bigint", True), ("l_suppkey", "bigint", True),
    ("l_linenumber", "int", True), ("l_quantity", "double", True), ("l_extendedprice", "double", True),
    ("l_discount", "double", True), ("l_tax", "double", True), ("l_returnflag", "string", False),
    ("l_linestatus", "string", False), ("l_shipdate", "timestamp_ntz", False),
]


def _rounded(df, digits=3):
    return df.withColumn("mean", F.round("mean", digits)).withColumn("std", F.round("std", digits))


@query("column_stats", _stats_sql(EVENT_COLUMNS, "dirty"), dirty=EVENTS_DIRTY)
def _(spark, sf):
    return _rounded(P.column_stats(view(spark, sf, EVENTS_DIRTY)))


@query("column_stats_lineitem", _stats_sql(LINEITEM_COLUMNS, "lineitem"))
def _(spark, sf):
    return _rounded(P.column_stats(table(spark, sf, "lineitem")))


@query(
    "top_values",
    """select "column", value, n, cast(position as integer) as position from
        (select *, row_number() over (partition by "column" order by n desc, value asc nulls last) as position,
                count(*) over (partition by "column") as u
         from (select 'name_txt' as "column", name_txt as value, count(*) as n from dirty group by name_txt
               union all select 'acctbal_txt', acctbal_txt, count(*) from dirty group by acctbal_txt
               union all select 'segment', segment, count(*) from dirty group by segment)) where position <= 5""",
    dirty=CUSTOMER_DIRTY,
)
def _(spark, sf):
    return P.top_values(view(spark, sf, CUSTOMER_DIRTY))


def _profile_sql() -> str:
    base = _stats_sql(EVENT_COLUMNS, "dirty")
    medians, samples = [], []
    for c, _, numeric in EVENT_COLUMNS:
        median = f"cast(median({c}) as double)" if numeric else "max(cast(null as double))"
        medians.append(f"select '{c}' as \"column\", {median} as median from dirty")
        text = f"cast({c} as varchar)"
        samples.append(
            f"""select '{c}' as "column", list(v order by event_id) as samples from
                (select event_id, {text} as v from dirty where {c} is not null order by event_id limit 5)"""
        )
    return f"""select s.position, s."column", s.dtype, s."rows", s.nulls as null_count,
        round(s.nulls * 100.0 / s."rows", 2) as null_percentage, s.unique_values as unique_count, s.is_numeric,
        s.unique_values < s."rows" * 0.05 as is_categorical, s.mean, m.median, s.std, s.min, s.max, p.samples
      from ({base}) s join ({" union all ".join(medians)}) m using ("column")
      join ({" union all ".join(samples)}) p using ("column")"""


@query("profile", _profile_sql(), dirty=EVENTS_DIRTY)
def _(spark, sf):
    return _rounded(P.profile(view(spark, sf, EVENTS_DIRTY), order_by=["event_id"]))


@query(
    "duplicate_count",
    """select cast(count(*) - (select count(*) from (select distinct o_custkey, o_orderstatus from dup)) as bigint)
       as duplicate_rows from dup""",
    dup=ORDERS_DUP,
)
def _(spark, sf):
    return P.duplicate_count(view(spark, sf, ORDERS_DUP).select("o_custkey", "o_orderstatus"))


@query("dataset_totals", "select count(*) as total_rows, cast(11 as bigint) as total_columns from lineitem")
def _(spark, sf):
    return P.dataset_totals(table(spark, sf, "lineitem"))


_CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "correlation",
    " union all ".join(
        f"select '{a}' as column_x, '{b}' as column_y, round(coalesce(corr({a}, {b}), 0), 3) as value from lineitem"
        for a in _CORR
        for b in _CORR
    ),
)
def _(spark, sf):
    return P.correlation_matrix(table(spark, sf, "lineitem"), _CORR)


_WIDE = "select " + ", ".join(f"l_quantity * {i % 5} + l_extendedprice * {i % 3} + l_discount * {i * 1000} as c{i}" for i in range(1, 18)) + " from lineitem"


@query(
    "correlation_wide",
    "select x.column_x, x.column_y, x.value from (select unnest(["
    + ", ".join(
        f"{{'column_x': 'c{i}', 'column_y': 'c{j}', 'value': round(coalesce(corr(c{i}, c{j}), 0), 3)}}"
        for i in range(1, 18)
        for j in range(1, 18)
    )
    + "]) as x from wide)",
    wide=_WIDE,
)
def _(spark, sf):
    """More columns than one aggregate takes."""
    return P.correlation_matrix(view(spark, sf, _WIDE))


@query(
    "histogram",
    """select cast(b.i as integer) as bin, low + b.i * w as bin_start,
              case when b.i = 19 then high else low + (b.i + 1) * w end as bin_end,
              (select count(*) from dirty where value >= low + b.i * w and
                 (value < low + (b.i + 1) * w or (b.i = 19 and value <= high))) as n
       from (select unnest(range(20)) as i) b, (select min(value) as low, max(value) as high,
             (max(value) - min(value)) / 20 as w from dirty) e""",
    dirty=EVENTS_DIRTY,
)
def _(spark, sf):
    return P.histogram(view(spark, sf, EVENTS_DIRTY), "value")


@query(
    "category_counts",
    """select event_type, count(*) as n from dirty where event_type is not null group by event_type
       order by n desc, event_type limit 3""",
    dirty=EVENTS_DIRTY,
)
def _(spark, sf):
    return P.category_counts(view(spark, sf, EVENTS_DIRTY), "event_type", 3)


_SHARES = (0.01, 0.25, 0.5, 0.75, 0.99)


@query(
    "quantiles",
    " union all ".join(
        f"""select '{c}' as "column", cast({q} as double) as q, cast({c} as double) as value from
            (select {c}, row_number() over (order by {c}) - 1 as rn, count(*) over () as n from lineitem)
            where rn = cast(round_even((n - 1) * {q}, 0) as bigint)"""
        for c in ("l_quantity", "l_extendedprice")
        for q in _SHARES
    ),
)
def _(spark, sf):
    return P.quantile_table(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], _SHARES)


@query(
    "feature_stats",
    " union all ".join(
        f"""select '{c}' as "column", cast(min({c}) as double) as min, cast(max({c}) as double) as max,
            round(avg({c}), 3) as mean, cast(median({c}) as double) as median, round(stddev_samp({c}), 3) as std from lineitem"""
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    ),
)
def _(spark, sf):
    return _rounded(P.feature_stats(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query(
    "outlier_counts",
    """select 'value' as "column", q1 - 0.5 * (q3 - q1) as lower, q3 + 0.5 * (q3 - q1) as upper,
              (select median(value) from dirty) as median,
              (select count(*) from dirty where value < q1 - 0.5 * (q3 - q1) or value > q3 + 0.5 * (q3 - q1)) as outliers
       from q""",
    dirty=EVENTS_DIRTY,
    q=QUARTILES,
)
def _(spark, sf):
    return P.outlier_counts(view(spark, sf, EVENTS_DIRTY), ["value"], 0.5)


@query("preview", "select * from lineitem order by l_orderkey, l_linenumber limit 1000")
def _(spark, sf):
    return P.preview(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], 1000)


@query("head_n", "select o_orderkey, o_totalprice from orders order by o_orderkey limit 100")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(100)


@query(
    "sketch_profile",
    """select 'value' as "column", count(*) as rows, count(*) - count(value) as nulls, min(value) as low, max(value) as high, true as close_enough
         from dirty where user_id % 4 in (1, 2)
       union all select 'event_id', count(*), 0, cast(min(event_id) as double), cast(max(event_id) as double), true from dirty where user_id % 4 in (1, 2)""",
    dirty=EVENTS_DIRTY,
)
def _(spark, sf):
    """Two of four parts merged from their sketches; distinct counts and medians are held against the exact ones."""
    from tabwright.operators import sketches as K

    df = view(spark, sf, EVENTS_DIRTY).select((F.col("user_id") % 4).alias("part"), "event_id", "value")
    some = df.where("part in (1, 2)")
    found = K.merge(K.build(df, ["part"]).where("part in (1, 2)")).collect()  # one row for each column
    aggs, cells = [], []
    for r in found:
        c, v = r["column"], F.col(r["column"])
        aggs += [F.count_if(v < r["q0.5"]).alias(f"{c}_below"), F.count_if(v <= r["q0.5"]).alias(f"{c}_upto"), F.count(v).alias(f"{c}_n"), F.count_distinct(v).alias(f"{c}_d")]
        below, upto, n, d = (F.col(f"{c}_{x}") for x in ("below", "upto", "n", "d"))
        share = K.RANK_ERROR * n + 1
        near = (below <= n / 2 + share) & (upto >= n / 2 - share) & (F.abs(F.lit(r["distinct"]) - d) <= K.DISTINCT_ERROR * d + 1)
        values = [F.lit(r[x]).alias(x) for x in ("column", "rows", "nulls", "low", "high")]
        cells.append(F.struct(*values, near.alias("close_enough")))
    return some.agg(*aggs).select(F.inline(F.array(*cells)))
