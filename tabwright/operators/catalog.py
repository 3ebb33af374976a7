"""Relational work on the metadata tables: jobs, models, workers, dataset versions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.session import cut_lineage

LIVE_SECONDS = 90
ACTIVE = ("running", "pending")

# Memory thresholds in GB with their queue, largest first.
VRAM_TIERS = ((24, "gpu.vram24"), (12, "gpu.vram12"), (8, "gpu.vram8"), (6, "gpu.vram6"))


def moment(now: datetime | str | Column) -> Column:
    if isinstance(now, Column):
        return now
    return F.lit(str(now)).cast("timestamp_ntz")


def page(df: DataFrame, order_by: Sequence[Column | str], number: int = 1, size: int = 20) -> DataFrame:
    """Page ``number`` (from 1) of the ordered rows."""
    return df.orderBy(*order_by).offset((number - 1) * size).limit(size)


def in_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on), on, "left_semi")


def status_rollup(jobs: DataFrame, models: DataFrame | None = None, on: str = "job_id") -> DataFrame:
    """Total, running and queued (active but not running) jobs."""
    active = F.count_if(F.col("status").isin(*ACTIVE))
    running = F.count_if(F.col("status") == "running")
    return jobs.agg(
        F.count(F.lit(1)).alias("total_jobs"), running.alias("running_jobs"), (active - running).alias("queued_jobs")
    )


def average_best(ranked: DataFrame, position: str, metric: str) -> DataFrame:
    best = ranked.filter((F.col(position) == 1) & F.col(metric).isNotNull())
    return best.agg(F.round(F.avg(metric), 4).alias("average_best"))


def recent_count(df: DataFrame, created: str, now: datetime | str | Column, days: int = 7) -> DataFrame:
    since = moment(now) - F.expr(f"interval {int(days)} days")
    return df.filter(F.col(created) >= since).agg(F.count(F.lit(1)).alias("recent"))


def online(workers: DataFrame, now: datetime | str | Column, seconds: int = LIVE_SECONDS) -> DataFrame:
    since = moment(now) - F.expr(f"interval {int(seconds)} seconds")
    return workers.withColumn("online", F.col("last_heartbeat") >= since)


def tag_coverage(workers: DataFrame, tags: str = "tags") -> DataFrame:
    """Workers per tag of a JSON list column; unreadable lists count for no tag."""
    parsed = F.from_json(F.col(tags), "array<string>")
    return workers.select(F.explode(parsed).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("workers"))


def fleet_totals(workers: DataFrame) -> DataFrame:
    """One row: workers by liveness, and what the live ones have together."""
    live = F.col("online")

    def total(name: str, kind: str) -> Column:
        return F.coalesce(F.sum(F.when(live, F.col(name))), F.lit(0)).cast(kind)

    return workers.agg(
        F.count(F.lit(1)).alias("total_workers"),
        F.count_if(live).alias("online_workers"),
        F.count_if(~live).alias("offline_workers"),
        total("cpu_count", "long").alias("total_cpus"),
        total("total_ram_gb", "double").alias("total_ram_gb"),
        total("gpu_count", "long").alias("total_gpus"),
        total("total_vram_gb", "double").alias("total_vram_gb"),
    )


def queue_coverage(queues: DataFrame, coverage: DataFrame) -> DataFrame:
    """Every queue that has tasks or workers, with 0 for the missing side."""
    joined = queues.select(F.col("queue").alias("name"), "pending").join(
        coverage.select(F.col("tag").alias("name"), "workers"), "name", "full"
    )
    zero = F.lit(0).cast("long")
    return joined.select("name", F.coalesce("workers", zero).alias("workers"), F.coalesce("pending", zero).alias("pending"))


def priority_union(parts: Sequence[DataFrame], key: str, tie: Sequence[str]) -> DataFrame:
    """Union where, per case-folded key, the row of the earliest part wins."""
    merged = None
    for i, part in enumerate(parts):
        part = part.withColumn("source_priority", F.lit(i))
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    w = Window.partitionBy(F.lower(F.col(key))).orderBy("source_priority", *tie)
    return merged.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def availability(workers: DataFrame) -> DataFrame:
    """Counts with the always available master added; busy means a busy status or running tasks."""
    busy = F.count_if(F.col("online") & ((F.col("status") == "busy") | (F.col("current_tasks") > 0)))
    live = F.count_if(F.col("online"))
    return workers.agg(
        (F.count(F.lit(1)) + 1).alias("total"), (live - busy + 1).alias("available"), busy.alias("busy")
    )


def latest_by_key(df: DataFrame, key: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The newest row of each key; one row per key and task reaches the shuffle."""
    w = Window.partitionBy(*key).orderBy(*[F.col(o).desc() for o in order_by])
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def upsert(current: DataFrame, changes: DataFrame, key: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    return latest_by_key(current.unionByName(changes), key, order_by)


def fail_stale(jobs: DataFrame, live: DataFrame, on: str = "job_id") -> DataFrame:
    """Active jobs that no live run knows become failed."""
    known = live.select(on).distinct().withColumn("__live", F.lit(True))
    stale = F.col("status").isin(*ACTIVE) & F.col("__live").isNull()
    joined = jobs.join(known, on, "left")
    return joined.withColumn("status", F.when(stale, F.lit("failed")).otherwise(F.col("status"))).select(*jobs.columns)


def cascade_delete(children: DataFrame, removed: DataFrame, on: str) -> DataFrame:
    return children.join(removed.select(on), on, "left_anti")


def retention(files: DataFrame, modified: str, length: str, now: datetime | str | Column, days: int) -> DataFrame:
    """What a clean-up of rows older than ``days`` removes and keeps."""
    old = F.col(modified) < moment(now) - F.expr(f"interval {int(days)} days")
    return files.agg(
        F.count_if(old).alias("deleted"),
        F.coalesce(F.sum(F.when(old, F.col(length))), F.lit(0)).cast("long").alias("freed_bytes"),
        F.count_if(~old).alias("kept"),
    )


def lineage(datasets: DataFrame, key: str = "id", parent: str = "parent_id", name: str = "name") -> DataFrame:
    """Each dataset with the name of its parent and the number of its children."""
    parents = datasets.select(F.col(key).alias("__p"), F.col(name).alias("parent_name"))
    children = datasets.filter(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("__c")).agg(
        F.count(F.lit(1)).alias("children")
    )
    out = datasets.join(parents, F.col(parent) == F.col("__p"), "left").drop("__p")
    out = out.join(children, F.col(key) == F.col("__c"), "left").drop("__c")
    return out.withColumn("children", F.coalesce("children", F.lit(0).cast("long")))


def lineage_depth(datasets: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """The distance of each dataset from its first version.

    Every round doubles the length of the links, so a chain of n versions takes about log2(n)
    joins; rows that reached their first version are no longer joined.
    """
    links = datasets.select(F.col(key), F.col(parent).alias("__up"), F.col(parent).isNotNull().cast("int").alias("depth"))
    open_ = cut_lineage(links)
    for _ in range(64):
        jump = open_.select(F.col(key).alias("__id"), F.col("__up").alias("__next"), F.col("depth").alias("__more"))
        moved = open_.filter(F.col("__up").isNotNull()).join(jump, F.col("__up") == F.col("__id"), "left")
        moved = moved.select(
            key, F.col("__next").alias("__up"), (F.col("depth") + F.coalesce("__more", F.lit(0))).alias("depth")
        )
        # finished rows stay in the table the next round looks up
        open_ = cut_lineage(moved.unionByName(open_.filter(F.col("__up").isNull())))
        if open_.filter(F.col("__up").isNotNull()).isEmpty():
            return open_.select(key, "depth")
    raise ValueError("the version links form a cycle")


def route_tier(require_llm: Column, require_gpu: Column, min_vram: Column, priority: Column) -> Column:
    """The one queue a task goes to: language-model flag, then memory tier, then priority."""
    wants_gpu = require_gpu | (min_vram > 0)
    out = F.when(require_llm, F.lit("llm"))
    for gb, name in VRAM_TIERS:
        out = out.when(wants_gpu & (min_vram >= gb), F.lit(name))
    return out.when(wants_gpu, F.lit("gpu")).when(priority >= 8, F.lit("priority")).otherwise(F.lit("cpu"))


def worker_queues(has_gpu: Column, vram: Column) -> Column:
    """All queues a worker with this memory can serve."""
    gpu = has_gpu & (vram >= 4)
    entries = [F.lit("cpu"), F.when(gpu, F.lit("gpu"))]
    entries += [F.when(gpu & (vram >= gb), F.lit(name)) for gb, name in reversed(VRAM_TIERS)]
    entries.append(F.when(has_gpu & (vram >= 6), F.lit("llm")))
    return F.filter(F.array(*entries), lambda q: q.isNotNull())


def group_in_order(df: DataFrame, group: str, item: str, order: Sequence[str]) -> DataFrame:
    """The distinct items of each group as rows, with the place of the group in the given order.

    Sorting by (position, item) shows the groups one after the other; no list is collected.
    """
    position = F.lit(len(order))
    for i, g in reversed(list(enumerate(order))):
        position = F.when(F.col(group) == g, F.lit(i)).otherwise(position)
    return df.select(group, item).distinct().withColumn("position", position)


def timeline(jobs: DataFrame, key: str, moments: Sequence[tuple[str, str, str]]) -> DataFrame:
    """One row per known lifecycle time: ``(column, level, message)``."""
    cells = F.array(
        *[
            F.struct(F.col(c).alias("at"), F.lit(level).alias("level"), F.lit(text).alias("message"))
            for c, level, text in moments
        ]
    )
    return jobs.select(key, F.inline(cells)).filter(F.col("at").isNotNull())
