"""Session settings and the shared scratch folder."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task of an estimator holds, about.
TASK_ROWS = 1_000_000


def build_session(app: str = "tabwright", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the launcher makes the session."""
    cpus = cpus or os.cpu_count() or 1
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "10g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: ``spark.checkpoint.dir`` of the session.

    Only a local session may fall back to a temporary folder, because there the driver
    and the executors are one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="tabwright-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the scratch folder and go on from the written table.

    Parquet keeps the result columnar, so later passes read only the columns they need,
    and a lost executor costs a re-read instead of a recomputation.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_rows(df: DataFrame, rows: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` of ``rows`` rows in as many parts as leave ``task_rows`` in each, where it has fewer.

    Spark cuts files by bytes. Columns of few values are a byte or two for each row in a file, and a hundred bytes once an
    estimator holds them, so one task would hold tens of millions of rows.
    """
    parts = math.ceil(rows / task_rows)
    if parts <= 1 or parts <= df.rdd.getNumPartitions():
        return df
    return df.repartition(parts)


#: Paths written inside each open scope, the innermost last.
_SCOPES: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete at its end the tables that ``cut_lineage`` wrote inside the block.

    Results are lazy and read those tables, so write or collect them inside the block too. Scopes are for one thread;
    work of other threads that runs meanwhile counts as done inside.
    """
    written: list[str] = []
    _SCOPES.append(written)
    try:
        yield
    finally:
        _SCOPES.remove(written)
        context = spark.sparkContext
        for path in written:
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
