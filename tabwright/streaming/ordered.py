"""Per-key work in event-time order, by Spark's arbitrary state with timers.

Rows wait in their key's state, in buckets of event time, until the watermark has passed the end of their bucket. Then the
bucket is put in order and walked, so the output does not depend on how rows fall into batches. A task holds the rows that
a batch brings for one key, and of what waits the chunks that share a bucket. Rows behind the watermark are dropped by Spark, so ``late`` is also how far rows may
come out of order. What lies in buckets that the watermark has not passed yet comes out in a later batch.

The state store has to be RocksDB; ``state_store`` sets that for the streams started inside it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tabwright.operators.catalog import LIVE_SECONDS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


#: Rows of one key that are held under one state entry.
CHUNK_ROWS = 20_000


class Ordered(StatefulProcessor):
    """Holds rows (at in microseconds, tie, code) and gives them to ``walk`` bucket by bucket, in order.

    The rows that a batch brings for a key are held in chunks by time, many buckets to a chunk, and a key has one timer at
    a time, for the first bucket or limit that is due. So calls to the state follow keys and chunks, not keys and buckets.
    """

    def __init__(self, keys: Sequence[str], bucket_ms: int) -> None:
        self.keys, self.bucket_ms, self.chunk_rows = list(keys), bucket_ms, CHUNK_ROWS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "chunk long", "at array<long>, tie array<long>, code array<string>")
        #: what ``walk`` knows, the time of the timer, and the chunks with the ends of their first buckets
        self.known = handle.getValueState("known", "last long, code string, due long, chunks array<long>, firsts array<long>")

    def end(self, micros: int) -> int:
        """The end, in milliseconds, of the bucket that a time falls into."""
        return (micros // (self.bucket_ms * 1000) + 1) * self.bucket_ms

    def _state(self) -> tuple:
        last, code, due, chunks, firsts = self.known.get() or (None, None, None, [], [])
        return last, code, due, dict(zip(chunks, firsts, strict=True))

    def _hold(self, rows: list[tuple], chunks: dict[int, int]) -> None:
        for at in range(0, len(rows), self.chunk_rows):
            some = rows[at : at + self.chunk_rows]
            number = max(chunks, default=-1) + 1
            self.held.updateValue((number,), tuple(list(p) for p in zip(*some, strict=True)))
            chunks[number] = self.end(some[0][0])

    def _keep(self, last: int | None, code: str | None, due: int | None, chunks: dict[int, int], until: int | None) -> None:
        """Write down what is known, with a timer for what is due next."""
        wanted = min([*chunks.values(), *([] if until is None else [until])], default=None)
        if wanted is not None and wanted != due:
            self.handle.registerTimer(wanted)
        self.known.update((last, code, wanted, list(chunks), list(chunks.values())))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        news: list[tuple] = []
        for pdf in rows:
            news += zip(pdf["at"].tolist(), pdf["tie"].tolist(), pdf["code"].tolist(), strict=True)
        news.sort(key=lambda r: r[0])
        last, code, due, chunks = self._state()
        self._hold(news, chunks)
        self._keep(last, code, due, chunks, due)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # up to the last bucket that has ended
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) // self.bucket_ms * self.bucket_ms
        last, code, due, chunks = self._state()
        # a timer that an earlier one has overtaken
        if due is None or due > passed:
            return
        out: list[tuple] = []
        waiting = sorted(chunks, key=lambda c: (chunks[c], c))
        pool: list[tuple] = []
        while True:
            ends = [*([self.end(pool[0][0])] if pool else []), *([chunks[waiting[0]]] if waiting else [])]
            if not ends or min(ends) > passed:
                break
            end = min(ends)
            while waiting and chunks[waiting[0]] <= end:
                number = waiting.pop(0)
                pool = sorted([*pool, *zip(*self.held.getValue((number,)), strict=True)])
                self.held.removeKey((number,))
                del chunks[number]
            # up to the last bucket that is due and that no chunk still to be read shares
            stop = min([passed, *([chunks[waiting[0]] - self.bucket_ms] if waiting else [])])
            cut = bisect_left(pool, (max(end, stop) * 1000,))
            found, last, code = self.walk(pool[:cut], last, code)
            out += found
            pool = pool[cut:]
            if len(out) >= self.chunk_rows:
                yield self._frame(key, out)
                out = []
        self._hold(pool, chunks)
        found, code, until = self.rest(last, code, passed)
        out += found
        self._keep(last, code, None, chunks, until)
        if out:
            yield self._frame(key, out)

    def _frame(self, key: Any, out: list[tuple]) -> pd.DataFrame:
        # objects keep whole numbers whole beside nulls
        return pd.DataFrame([(*key, *row) for row in out], columns=[*self.keys, *self.columns], dtype=object)

    columns: tuple[str, ...] = ()

    def walk(self, rows: list[tuple], last: int | None, code: str | None) -> tuple[list[tuple], int | None, str | None]:
        """Output rows, and what to know from now on."""
        raise NotImplementedError

    def rest(self, last: int | None, code: str | None, passed: int) -> tuple[list[tuple], str | None, int | None]:
        """After all rows that are due: output rows, what to know, and the end of a bucket to wait for."""
        return [], code, None

    def close(self) -> None:
        pass


class Changes(Ordered):
    columns = ("at", "tie", "code")

    def walk(self, rows, last, code):
        out = []
        for at, tie, new in rows:
            if last is None or new != code:
                out.append((at, tie, new))
            last, code = at, new
        return out, last, code


class Presence(Ordered):
    columns = ("status", "at")

    def __init__(self, keys: Sequence[str], bucket_ms: int, limit: int) -> None:
        super().__init__(keys, bucket_ms)
        self.limit = limit

    def walk(self, rows, last, code):
        out, online = [], code == "online"
        for at, _, _ in rows:
            if online and at - last > self.limit:
                out.append(("offline", last + self.limit))
                online = False
            if not online:
                out.append(("online", at))
            last, online = at, True
        return out, last, "online" if online else "offline"

    def rest(self, last, code, passed):
        if code != "online":
            return [], code, None
        # beats up to the limit lie in buckets up to the limit's own
        until = self.end(last + self.limit)
        if until > passed:
            return [], code, until
        return [("offline", last + self.limit)], "offline", None


def _run(df: DataFrame, key: Sequence[str], at: str, tie, code, late: str, processor: Ordered, output: str) -> DataFrame:
    """Keyed rows through a processor; ``at`` comes back as the type it had."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in [*key, at]}
    rows = df.where(F.col(at).isNotNull())
    if kinds[at] != "timestamp":
        rows = rows.withColumn(at, F.col(at).cast("timestamp"))
    rows = rows.withWatermark(at, late)
    rows = rows.select(*key, F.col(at).alias("event_time"), F.unix_micros(at).alias("at"), tie.cast("long").alias("tie"), code.alias("code"))
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in key], output])
    found = rows.groupBy(*key).transformWithStateInPandas(processor, schema, "Append", "EventTime")
    return found.withColumn("at", F.timestamp_micros("at").cast(kinds[at]))


def changes(df: DataFrame, key: Sequence[str], value: str, at: str, tie: str, late: str, bucket_seconds: int = 60) -> DataFrame:
    """(key, at, tie, value) of a stream's rows whose value differs from the one before of the same key, in order of (at, tie).

    Null equals null, as in a batch. Keys of any type that Spark groups by will do, one column or several; ``tie`` is
    a whole number. Rows without a time are left out.
    """
    kind = df.schema[value].dataType.simpleString()
    code = F.to_json(F.struct(F.col(value).alias("v")), _JSON)
    out = _run(df, key, at, F.col(tie), code, late, Changes(key, bucket_seconds * 1000), "at long, tie long, code string")
    read = F.from_json("code", T.StructType().add("v", df.schema[value].dataType), _JSON)["v"].cast(kind)
    return out.select(*key, F.col("at").alias(at), F.col("tie").cast(df.schema[tie].dataType).alias(tie), read.alias(value))


def presence(df: DataFrame, key: Sequence[str], at: str, seconds: int = LIVE_SECONDS, late: str = "30 seconds", bucket_seconds: int = 60) -> DataFrame:
    """(key, status, at): ``online`` at a first beat and when beats come back, ``offline`` when none came for ``seconds``."""
    one = F.lit("")
    return _run(df, key, at, F.lit(0), one, late, Presence(key, bucket_seconds * 1000, seconds * 1_000_000), "status string, at long")
