"""Shared helpers: word arithmetic on Arrow text batches, and connected components as joins."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.session import cut_lineage

#: The six ASCII blanks that end a word.
BLANKS = b" \t\n\v\f\r"
#: The same as a pattern for SQL.
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20
#: The most bits that ``perhaps_in`` sets.
FILTER_BITS = 1 << 26


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_FOLD = np.uint64(0x9FB21C651E98DF25)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = np.arange(97, 123)
#: Words above this many bytes are hashed one by one.
LONG_WORD = 64


class Texts:
    """Word hashes of a slice of texts.

    ``wh`` holds one 64-bit hash for each word, ``doc`` the text it belongs to, ``first`` the index of
    each text's first word (one more entry at the end). Words are runs of bytes other than ASCII blanks.

    Eight bytes at a time go through ``mix``, and so do the halves of every run of words. No step is a sum of
    products, so no pattern of letters or words makes different runs meet. Another ``seed`` gives hashes that
    have nothing to do with these.
    """

    def __init__(self, column: pa.Array, lower: bool = False, seed: int = 0):
        data, offsets = text_bytes(column)
        self.data = data = _LOWER[data] if lower else data
        n = len(data)
        inside = np.ones(256, bool)
        inside[list(BLANKS)] = False
        inside = inside[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        change = np.empty(n, bool)
        change[:1] = True
        np.not_equal(inside[1:], inside[:-1], out=change[1:])
        begin = np.flatnonzero(inside & (edge[:n] | change))
        change[:-1] = change[1:]
        change[-1:] = True
        self.start, self.end = begin, np.flatnonzero(inside & (edge[1:] | change)) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self._hash(seed)

    def _hash(self, seed: int) -> None:
        size = self.end - self.start
        out = mix((size.astype(np.uint64) + np.uint64(seed + 1)) * np.uint64(0x9E3779B97F4A7C15))
        padded = np.append(self.data, np.zeros(8, np.uint8))
        # the eight bytes from each place on
        eight = np.ndarray(len(self.data) + 1, "<u8", buffer=padded, strides=(1,))
        todo = np.flatnonzero(size <= LONG_WORD)
        at, left = self.start[todo], size[todo]
        while len(todo):
            part = eight[at]
            part &= np.uint64(2**64 - 1) >> (8 * np.maximum(8 - left, 0)).astype(np.uint64)
            out[todo] = mix(out[todo] ^ part)
            more = left > 8
            todo, at, left = todo[more], at[more] + 8, left[more] - 8
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            code = hashlib.blake2b(self.data[self.start[i] : self.end[i]], digest_size=8, salt=seed.to_bytes(8, "little"))
            out[i] = int.from_bytes(code.digest(), "little")
        self.wh = out
        #: hashes of the 2**j words from each word on
        self._levels = [out]

    def seeded(self, seed: int) -> Texts:
        """The same words under other hashes."""
        other = copy(self)
        other._hash(seed)
        return other

    def _level(self, j: int) -> np.ndarray:
        while len(self._levels) <= j:
            low, half = self._levels[-1], 1 << (len(self._levels) - 1)
            self._levels.append(mix(low[:-half] * _FOLD + low[half:]) if len(low) > half else low[:0])
        return self._levels[j]

    def runs(self, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the word sequences ``begin`` to ``stop`` (exclusive), from the two halves that cover each."""
        size = stop - begin
        out = np.zeros(len(begin), np.uint64)
        for j in np.unique(np.frexp(size[size > 0])[1] - 1).tolist():
            level = self._level(j)
            some = np.flatnonzero((size >> j) == 1)
            both = mix(level[begin[some]] * _FOLD + level[stop[some] - (1 << j)])
            out[some] = mix(both + size[some].astype(np.uint64))
        return out

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which ``k`` words of one text begin, and the hashes of these words."""
        at = np.arange(max(0, len(self.wh) - k + 1))
        at = at[self.doc[at] == self.doc[at + k - 1]] if len(at) else at
        return at, self.runs(at, at + k)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins. Null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice has about ``limit`` bytes of text, or one long text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def perhaps_in(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` without nearly all that have no partner of equal ``keys`` in ``known``, before a join moves them.

    One bit for each hash that occurs in ``known``, a written table. All bits take at most 8 MB; where more rows are
    known than these tell apart, more rows pass than needed, and none is lost.
    """
    (page, bits, at) = fresh(rows, "page", "bits", "at")
    size = min(FILTER_BITS, 1 << (8 * known.count()).bit_length())
    place = F.pmod(F.xxhash64(*keys), F.lit(size)) + 1
    pages = known.select(place.alias(at)).groupBy(F.bitmap_bucket_number(at).alias(page)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(bits))
    spot = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.getbit(byte, (spot % 8).cast("int")) == 1
    return rows.join(F.broadcast(pages), (F.bitmap_bucket_number(place) == F.col(page)) & found, "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node reachable by links.

    Each round hangs every node under its smallest neighbour, follows these pointers two steps, and
    contracts the graph to what is left between different roots. Groups shrink to a point whatever their
    size, a hub costs no more than its links, and only a row count per round reaches the driver.
    """
    edges = cut_lineage(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    )
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("up"))
        low = cut_lineage(low)
        while True:
            up = low.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = cut_lineage(low.join(up, "up").select("node", F.col("top").alias("up"), (F.col("top") < F.col("up")).alias("moved")))
            low = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = low.select("node", F.col("up").alias("component"))
        else:
            step = low.select(F.col("node").alias("component"), "up")
            labels = cut_lineage(
                labels.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
            )
        a = low.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        b = low.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        edges = edges.join(a, "a").join(b, "b").where("ua <> ub")
        edges = cut_lineage(edges.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
