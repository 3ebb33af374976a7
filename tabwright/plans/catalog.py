"""Relational work on metadata tables, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import catalog as K
from tabwright.operators import metrics as M
from tabwright.plans.base import EVENTS_DIRTY, JOBS, MODELS, WORKERS, query, table, view

NOW = "1998-08-01 00:00:00"


@query(
    "page_desc",
    "select job_id, status, created_at from jobs where status = 'completed' order by created_at desc, job_id limit 20 offset 40",
    jobs=JOBS,
)
def _(spark, sf):
    done = view(spark, sf, JOBS).filter("status = 'completed'").select("job_id", "status", "created_at")
    return K.page(done, [F.desc("created_at"), "job_id"], 3, 20)


@query(
    "semi_join",
    "select * from models where job_id in (select job_id from jobs where status = 'running')",
    jobs=JOBS,
    models=MODELS,
)
def _(spark, sf):
    return K.in_keys(view(spark, sf, MODELS), view(spark, sf, JOBS).filter("status = 'running'"), "job_id")


@query(
    "status_rollup",
    """select count(*) as total_jobs, count(*) filter (status = 'running') as running_jobs,
              count(*) filter (status = 'pending') as queued_jobs from jobs""",
    jobs=JOBS,
)
def _(spark, sf):
    return K.status_rollup(view(spark, sf, JOBS))


@query(
    "avg_best",
    """select round(avg(f1), 4) as average_best from (select f1, row_number() over (partition by job_id
         order by coalesce(f1, 0) desc, model_no, created_at) as r from models) where r = 1 and f1 is not null""",
    models=MODELS,
)
def _(spark, sf):
    best = M.best_model(view(spark, sf, MODELS), ["job_id"], "f1", ["model_no", "created_at"])
    return K.average_best(best.withColumn("position", F.lit(1)), "position", "f1")


@query(
    "recent_count",
    f"select count(*) as recent from jobs where created_at >= timestamp '{NOW}' - interval 7 days",
    jobs=JOBS,
)
def _(spark, sf):
    return K.recent_count(view(spark, sf, JOBS), "created_at", NOW)


# every worker gets a queue list from its id: a third serve only the processor queue
_TAGS = """case worker_id % 3 when 0 then '["cpu"]' when 1 then '["cpu","gpu"]' else '["cpu","gpu","gpu.vram6"]' end"""


@query(
    "tag_coverage",
    f"""select tag, count(*) as workers from (select unnest(from_json({_TAGS}, '["VARCHAR"]')) as tag from workers
         where last_heartbeat >= (select max(ts) - interval 90 seconds * 20 from events)) group by tag""",
    workers=WORKERS,
)
def _(spark, sf):
    workers = view(spark, sf, WORKERS).withColumn("tags", F.expr(_TAGS))
    now = table(spark, sf, "events").agg(F.max("ts")).first()[0]
    live = K.online(workers, now, 90 * 20).filter("online")
    return K.tag_coverage(live)


_FLEET = f"""select worker_id, last_heartbeat, {_TAGS} as tags, cast(worker_id % 8 + 1 as integer) as cpu_count, cast(worker_id % 4 * 8 as double) as total_ram_gb,
         cast(worker_id % 3 as integer) as gpu_count, cast(worker_id % 3 * 6 as double) as total_vram_gb from (select user_id as worker_id, max(ts) as last_heartbeat from events group by user_id)"""


@query(
    "fleet_totals",
    """select count(*) as total_workers, count(*) filter (live) as online_workers, count(*) filter (not live) as offline_workers,
         cast(coalesce(sum(cpu_count) filter (live), 0) as bigint) as total_cpus, coalesce(sum(total_ram_gb) filter (live), 0.0) as total_ram_gb,
         cast(coalesce(sum(gpu_count) filter (live), 0) as bigint) as total_gpus, coalesce(sum(total_vram_gb) filter (live), 0.0) as total_vram_gb
       from (select *, last_heartbeat >= (select max(ts) - interval 30 minutes * 20 from events) as live from fleet)""",
    fleet=_FLEET,
)
def _(spark, sf):
    now = table(spark, sf, "events").agg(F.max("ts")).first()[0]
    return K.fleet_totals(K.online(view(spark, sf, _FLEET), now, 1800 * 20))


@query(
    "full_outer_coverage",
    f"""with c as (select tag, count(*) as workers from (select unnest(from_json({_TAGS}, '["VARCHAR"]')) as tag from workers) group by tag),
             q as (select event_type as queue, count(*) as pending from events group by event_type
                   union all select 'cpu', count(*) from events where value > 90)
        select coalesce(tag, queue) as name, coalesce(workers, 0) as workers, coalesce(pending, 0) as pending
        from c full join q on tag = queue""",
    workers=WORKERS,
)
def _(spark, sf):
    events = table(spark, sf, "events")
    queues = events.groupBy(F.col("event_type").alias("queue")).agg(F.count(F.lit(1)).alias("pending"))
    cpu = events.filter("value > 90").agg(F.count(F.lit(1)).alias("pending")).select(F.lit("cpu").alias("queue"), "pending")
    coverage = K.tag_coverage(view(spark, sf, WORKERS).withColumn("tags", F.expr(_TAGS)))
    return K.queue_coverage(queues.unionByName(cpu), coverage)


@query(
    "priority_union",
    """with u as (select n_name as hostname, n_nationkey as id, 0 as source_priority from nation where n_nationkey % 5 = 0
                  union all select lower(n_name), n_nationkey, 1 from nation where n_nationkey % 2 = 0
                  union all select s_name, s_suppkey, 2 from supplier union all select n_name, n_nationkey, 2 from nation)
       select hostname, cast(id as bigint) as id, source_priority from (select *, row_number() over
         (partition by lower(hostname) order by source_priority, id) as r from u) where r = 1""",
)
def _(spark, sf):
    nation, supplier = table(spark, sf, "nation"), table(spark, sf, "supplier")
    n_id = F.col("n_nationkey").cast("long").alias("id")
    master = nation.filter("n_nationkey % 5 = 0").select(F.col("n_name").alias("hostname"), n_id)
    broker = nation.filter("n_nationkey % 2 = 0").select(F.lower("n_name").alias("hostname"), n_id)
    stored = supplier.select(F.col("s_name").alias("hostname"), F.col("s_suppkey").alias("id")).unionByName(
        nation.select(F.col("n_name").alias("hostname"), n_id)
    )
    return K.priority_union([master, broker, stored], "hostname", ["id"])


@query(
    "availability",
    """with w as (select last_heartbeat >= (select max(ts) - interval 1800 seconds from events) as live,
                         case when worker_id % 4 = 0 then 'busy' else 'online' end as status, beats % 3 as current_tasks from workers)
       select count(*) + 1 as total, count(*) filter (live) - count(*) filter (live and (status = 'busy' or current_tasks > 0)) + 1 as available,
              count(*) filter (live and (status = 'busy' or current_tasks > 0)) as busy from w""",
    workers=WORKERS,
)
def _(spark, sf):
    now = table(spark, sf, "events").agg(F.max("ts")).first()[0]
    workers = view(spark, sf, WORKERS).select(
        "last_heartbeat",
        F.when(F.col("worker_id") % 4 == 0, "busy").otherwise("online").alias("status"),
        (F.col("beats") % 3).alias("current_tasks"),
    )
    return K.availability(K.online(workers, now, 1800))


@query(
    "liveness_ttl",
    """select worker_id, last_heartbeat, beats, last_heartbeat >= (select max(ts) - interval 1800 seconds from events) as online
       from workers""",
    workers=WORKERS,
)
def _(spark, sf):
    now = table(spark, sf, "events").agg(F.max("ts")).first()[0]
    return K.online(view(spark, sf, WORKERS), now, 1800)


@query(
    "latest_by_key",
    """select event_id, ts, user_id, event_type, value from (select *, row_number() over (partition by user_id
         order by ts desc, event_id desc) as r from dirty) where r = 1""",
    dirty=EVENTS_DIRTY,
)
def _(spark, sf):
    return K.latest_by_key(view(spark, sf, EVENTS_DIRTY), ["user_id"], ["ts", "event_id"])


@query(
    "upsert",
    """select c_custkey, c_acctbal, changed_at from (select *, row_number() over (partition by c_custkey order by changed_at desc) as r
         from (select c_custkey, c_acctbal, timestamp '1990-01-01' as changed_at from customer
               union all select o_custkey, max(o_totalprice), max(o_orderdate) from orders group by o_custkey)) where r = 1""",
)
def _(spark, sf):
    current = table(spark, sf, "customer").select(
        "c_custkey", "c_acctbal", F.lit("1990-01-01 00:00:00").cast("timestamp_ntz").alias("changed_at")
    )
    changes = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_totalprice").alias("c_acctbal"), F.max("o_orderdate").alias("changed_at")
    )
    return K.upsert(current, changes, ["c_custkey"], ["changed_at"])


@query(
    "stale_jobs",
    """select job_id, dataset_id, case when status in ('running', 'pending') and job_id not in
         (select l_orderkey from lineitem where l_linestatus = 'O') then 'failed' else status end as status, created_at from jobs""",
    jobs=JOBS,
)
def _(spark, sf):
    live = table(spark, sf, "lineitem").filter("l_linestatus = 'O'").select(F.col("l_orderkey").alias("job_id"))
    return K.fail_stale(view(spark, sf, JOBS), live)


@query(
    "cascade_delete",
    "select * from models where job_id not in (select job_id from jobs where status = 'completed')",
    jobs=JOBS,
    models=MODELS,
)
def _(spark, sf):
    return K.cascade_delete(view(spark, sf, MODELS), view(spark, sf, JOBS).filter("status = 'completed'"), "job_id")


@query(
    "retention",
    f"""select count(*) filter (created_at < timestamp '{NOW}' - interval 30 days) as deleted,
               cast(sum(case when created_at < timestamp '{NOW}' - interval 30 days then dataset_id else 0 end) as bigint) as freed_bytes,
               count(*) filter (created_at >= timestamp '{NOW}' - interval 30 days) as kept from jobs""",
    jobs=JOBS,
)
def _(spark, sf):
    return K.retention(view(spark, sf, JOBS), "created_at", "dataset_id", NOW, 30)


# dataset versions: every part descends from the part with half its number
_VERSIONS = "select p_partkey as id, case when p_partkey > 1 then p_partkey // 2 end as parent_id, p_name as name from part"


def _versions(spark, sf):
    parent = F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), parent.alias("parent_id"), F.col("p_name").alias("name")
    )


@query(
    "lineage_children",
    """select d.id, d.parent_id, d.name, p.name as parent_name, (select count(*) from d c where c.parent_id = d.id) as children
       from d left join d p on d.parent_id = p.id""",
    d=_VERSIONS,
)
def _(spark, sf):
    return K.lineage(_versions(spark, sf))


@query(
    "lineage_versions",
    f"""with recursive chain(node, depth) as (select id, 0 from ({_VERSIONS}) where parent_id is null
         union all select d.id, depth + 1 from ({_VERSIONS}) d join chain c on d.parent_id = c.node)
       select node as id, depth + 1 as version from chain""",
)
def _(spark, sf):
    return K.lineage_depth(_versions(spark, sf)).select("id", (F.col("depth") + 1).alias("version"))


@query(
    "set_except",
    "select distinct l_partkey as id from lineitem except select p_partkey from part where p_size > 10",
)
def _(spark, sf):
    used = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"))
    return used.subtract(table(spark, sf, "part").filter("p_size > 10").select("p_partkey"))


@query(
    "set_intersect",
    "select l_partkey as id from lineitem intersect select p_partkey from part where p_size > 10",
)
def _(spark, sf):
    used = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"))
    return used.intersect(table(spark, sf, "part").filter("p_size > 10").select("p_partkey"))


@query(
    "group_in_order",
    """select distinct event_type, user_id, case event_type when 'purchase' then 0 when 'click' then 1 else 2 end as position
       from events""",
)
def _(spark, sf):
    return K.group_in_order(table(spark, sf, "events"), "event_type", "user_id", ["purchase", "click"])


@query(
    "tier_routing",
    """select l_orderkey, l_linenumber, case when l_linenumber = 7 then 'llm'
              when l_returnflag = 'R' or l_quantity - 20 > 0 then case when l_quantity - 20 >= 24 then 'gpu.vram24' when l_quantity - 20 >= 12 then 'gpu.vram12'
                when l_quantity - 20 >= 8 then 'gpu.vram8' when l_quantity - 20 >= 6 then 'gpu.vram6' else 'gpu' end
              when l_linenumber * 2 >= 8 then 'priority' else 'cpu' end as queue,
              list_filter(['cpu', case when l_returnflag = 'R' and l_quantity >= 4 then 'gpu' end,
                case when l_returnflag = 'R' and l_quantity >= 6 then 'gpu.vram6' end, case when l_returnflag = 'R' and l_quantity >= 8 then 'gpu.vram8' end,
                case when l_returnflag = 'R' and l_quantity >= 12 then 'gpu.vram12' end, case when l_returnflag = 'R' and l_quantity >= 24 then 'gpu.vram24' end,
                case when l_returnflag = 'R' and l_quantity >= 6 then 'llm' end], lambda x: x is not null) as serves from lineitem""",
)
def _(spark, sf):
    gpu, memory = F.col("l_returnflag") == "R", F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        K.route_tier(F.col("l_linenumber") == 7, gpu, memory - 20, F.col("l_linenumber") * 2).alias("queue"),
        K.worker_queues(gpu, memory).alias("serves"),
    )


@query(
    "lookup_join",
    """select m.job_id, m.model_no, j.status, c.c_name as dataset from models m join jobs j using (job_id)
       join customer c on j.dataset_id = c.c_custkey""",
    jobs=JOBS,
    models=MODELS,
)
def _(spark, sf):
    datasets = table(spark, sf, "customer").select(F.col("c_custkey").alias("dataset_id"), F.col("c_name").alias("dataset"))
    joined = view(spark, sf, MODELS).select("job_id", "model_no").join(view(spark, sf, JOBS), "job_id")
    return joined.join(datasets, "dataset_id").select("job_id", "model_no", "status", "dataset")


@query(
    "lifecycle_timeline",
    """select job_id, created_at as at, 'info' as level, 'created' as message from jobs
       union all select job_id, created_at + interval 1 day, 'info', 'started' from jobs where status <> 'pending'
       union all select job_id, created_at + interval 2 days, 'info', 'completed' from jobs where status = 'completed'""",
    jobs=JOBS,
)
def _(spark, sf):
    jobs = view(spark, sf, JOBS).select(
        "job_id",
        "created_at",
        F.when(F.col("status") != "pending", F.col("created_at") + F.expr("interval 1 day")).alias("started_at"),
        F.when(F.col("status") == "completed", F.col("created_at") + F.expr("interval 2 days")).alias("completed_at"),
    )
    steps = [("created_at", "info", "created"), ("started_at", "info", "started"), ("completed_at", "info", "completed")]
    return K.timeline(jobs, "job_id", steps)
