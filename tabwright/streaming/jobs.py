"""Structured Streaming jobs. Each takes a streaming (or batch) DataFrame and returns one."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tabwright.operators.catalog import LIVE_SECONDS
from tabwright.operators.logs import LEVELS


def new_files(spark: SparkSession, path: str, fmt: str, schema: T.StructType | str, max_files: int | None = None) -> DataFrame:
    """Files as they appear in a folder; the schema is pinned so that a new file cannot change it."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def ingest(stream: DataFrame, target: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None):
    """Write everything that has arrived to parquet and stop; a rerun goes on where it stopped."""
    rows = prepare(stream) if prepare else stream
    return (
        rows.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def window_counts(df: DataFrame, at: str, key: str, value: str, width: str, late: str | None = None) -> DataFrame:
    """Counts and sums per tumbling window and key; ``late`` sets the watermark of a stream."""
    if late:
        df = df.withWatermark(at, late)
    grouped = df.groupBy(F.window(at, width).alias("w"), key)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(
        F.col("w.start").alias("start"), key, "n", "total"
    )


def live_log_counts(df: DataFrame, at: str, width: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Lines per level and window; rows later than the watermark are dropped."""
    counts = [F.count_if(F.upper("level") == name).alias(name.lower()) for name in LEVELS]
    grouped = df.withWatermark(at, late).groupBy(F.window(at, width).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("lines"), *counts).select(F.col("w.start").alias("start"), "lines", *[n.lower() for n in LEVELS])


def once_per_id(df: DataFrame, key: Sequence[str], at: str, late: str) -> DataFrame:
    """Drop repeated deliveries that arrive within the watermark."""
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark(list(key))


def latest_state(df: DataFrame, key: Sequence[str], at: str, tie: str) -> DataFrame:
    """The newest row of each key, as a running aggregate for update mode."""
    rest = [c for c in df.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct(at, tie))
    return df.groupBy(*key).agg(newest.alias("s")).select(*key, *[F.col(f"s.`{c}`").alias(c) for c in rest])


def upsert_sink(path: str, key: Sequence[str], order_by: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges each batch, the first one too, into the newest version of a table.

    A batch that is replayed after a failure writes the same version again.
    """
    from tabwright.operators.catalog import latest_by_key, upsert

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        target = f"{path.rstrip('/')}/v={epoch}"
        if epoch:
            current = spark.read.parquet(f"{path.rstrip('/')}/v={epoch - 1}")
            batch = upsert(current, batch, key, order_by)
        else:
            batch = latest_by_key(batch, key, order_by)
        batch.write.mode("overwrite").parquet(target)

    return merge


LIVENESS_OUTPUT = "worker_id long, status string, at timestamp"


def liveness(df: DataFrame, key: str, at: str, seconds: int = LIVE_SECONDS, late: str = "30 seconds") -> DataFrame:
    """``online`` when a worker's first beat arrives or it comes back, ``offline`` once none came for ``seconds``.

    Beats of a batch are walked in order, so a gap inside it gives its ``offline`` and ``online`` as it would over
    several batches. After the last beat expiry follows event time: it fires when the watermark passes the limit.
    """

    def track(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame(
                {"worker_id": [who[0]], "status": ["offline"], "at": [pd.Timestamp(last + seconds * 1000, unit="ms")]}
            )
            return
        # only the times of a worker's beats are held, eight bytes each
        beats = np.sort(np.concatenate([b["__ms"].to_numpy() for b in batches]))
        known = state.getOption
        limit = seconds * 1000
        if known is not None:
            beats = np.r_[known[0], beats[beats > known[0]]]
        gaps = np.flatnonzero(np.diff(beats) > limit)
        times = [(int(beats[0]), "online")] if known is None else []
        for i in gaps:
            times += [(int(beats[i]) + limit, "offline"), (int(beats[i + 1]), "online")]
        last = int(beats[-1])
        state.update((last,))
        state.setTimeoutTimestamp(max(last + limit, state.getCurrentWatermarkMs() + 1))
        if times:
            at = [pd.Timestamp(t, unit="ms") for t, _ in times]
            yield pd.DataFrame({"worker_id": [who[0]] * len(times), "status": [s for _, s in times], "at": at})

    rows = df.withWatermark(at, late).select(F.col(key).alias("worker_id"), at, F.unix_millis(at).alias("__ms"))
    return rows.groupBy("worker_id").applyInPandasWithState(
        track, LIVENESS_OUTPUT, "last long", "append", GroupStateTimeout.EventTimeTimeout
    )


def change_relay(df: DataFrame, key: str, value: str, order: str, output: str) -> DataFrame:
    """Only the rows whose value differs from the last one relayed for the key.

    ``output`` is the schema of (key, order, value), all taken in ``order`` inside a batch. A task holds
    the rows of one key in one micro-batch, so limit the batch at the source (``max_files``).
    """

    def relay(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.getOption
        has, last = (False, None) if known is None else (True, known[0])
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        before = rows[value].shift()
        # null equals null
        changed = rows[value].ne(before) & ~(rows[value].isna() & before.isna())
        first = rows[value].iloc[0]
        changed.iloc[0] = not has or not (first == last or (pd.isna(first) and pd.isna(last)))
        state.update((rows[value].iloc[-1],))
        out = rows[changed.to_numpy()]
        if len(out):
            yield out[[key, order, value]]

    kind = df.schema[value].dataType.simpleString()
    return df.select(key, order, value).groupBy(key).applyInPandasWithState(
        relay, output, f"last {kind}", "append", GroupStateTimeout.NoTimeout
    )
