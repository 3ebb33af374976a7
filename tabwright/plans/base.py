"""Query registry: a Spark callable and, where SQL can say it, the check SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, **views: str) -> Callable[[QueryFn], QueryFn]:
    """Register a query. ``views`` are put in front of the check SQL as common table expressions."""

    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ctes = ", ".join(f"{k} as ({text})" for k, text in views.items())
            head = oracle.strip()
            if ctes and head.lower().startswith("with "):
                ORACLES[name] = f"with {ctes}, {head[5:]}"
            else:
                ORACLES[name] = f"with {ctes} {head}" if ctes else head
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run one of the shared view texts over the tables it names."""
    names = ("events", "customer", "orders", "lineitem", "conversations", "documents", "supplier", "part", "labels")
    used = {n: table(spark, sf_dir, n) for n in names if f"from {n}" in text}
    text = text.replace("{", "{{").replace("}", "}}")
    for n in used:
        text = text.replace(f"from {n}", f"from {{{n}}}")
    return spark.sql(text, **used)


EVENTS_DIRTY = """
select event_id, ts, user_id,
       case when event_id % 11 = 0 then null else event_type end as event_type,
       case when event_id % 7 = 0 then null else value end as value
from events
"""

CUSTOMER_DIRTY = """
select c_custkey,
       case when c_custkey % 10 = 0 then '' when c_custkey % 10 = 1 then 'NA'
            when c_custkey % 10 = 2 then '.' else cast(c_acctbal as varchar(40)) end as acctbal_txt,
       case when c_custkey % 5 = 0 then concat('  ', c_name, '# 42  ') else c_name end as name_txt,
       case when c_custkey % 13 = 0 then null else c_mktsegment end as segment
from customer
"""

ORDERS_DUP = """
select o_orderkey, o_custkey, o_orderstatus, o_totalprice, 0 as seq from orders
union all
select o_orderkey, o_custkey, o_orderstatus, o_totalprice, 1 as seq from orders where o_orderkey % 4 = 0
"""

JOBS = """
select o_orderkey as job_id, o_custkey as dataset_id,
       case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'running' end as status,
       o_orderdate as created_at
from orders
"""

MODELS = """
select l_orderkey as job_id, l_linenumber as model_no, l_discount as accuracy,
       case when l_linenumber % 3 = 0 then null else l_tax end as f1,
       l_quantity as training_time, l_shipdate as created_at
from lineitem
"""

WORKERS = """
select user_id as worker_id, max(ts) as last_heartbeat, count(*) as beats from events group by user_id
"""

SCORED = """
select event_id, case when event_type in ('error','purchase') then 1 else 0 end as y,
       case when value > 50 then 1 else 0 end as p, value as score
from events
"""

APPLOG = """
select event_id, concat('2024-01-01 00:00:00.000 | ',
         case event_id % 5 when 0 then 'ERROR' when 1 then 'DEBUG' when 2 then 'WARNING'
                           when 3 then 'CRITICAL' else 'INFO' end,
         ' | mod', cast(event_id % 9 as varchar(5)), ':run:1 - ', event_type) as line
from events
"""

STATEMENTS = """
select o_custkey, concat('<STMTTRN><TRNTYPE>DEBIT<DTPOSTED>20240102120000<TRNAMT>',
         cast(o_orderkey as varchar(20)), '.25<NAME>n', cast(o_custkey as varchar(20)),
         '</STMTTRN><STMTTRN><TRNAMT>7</TRNAMT></STMTTRN>') as content
from orders
"""

REPLIES = """
select conv_id, turn, concat('Sure.', chr(10), '```json', chr(10),
         '[{"operation":"drop_column","description":"', role, '","confidence":0.5},{"operation":"x"}]',
         chr(10), '```') as reply
from conversations
"""
