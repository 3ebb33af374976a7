"""Exact de-duplication by grace hashing: partition to spill files until every bucket fits a hash table.

Records are first collapsed where they lie, so a text with a billion copies leaves each input task once.
The distinct contents of each task then go to bucket files on the shared folder. A bucket with more bytes
than the limit is partitioned again by the next bits of the hash, and its equal contents, dealt out by
document id meanwhile, are collapsed on the way. When every bucket fits, one task at a time loads a bucket
into an open-addressing table that compares complete content. Only bucket sizes reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import fresh, slices, table
from tabwright.session import cut_lineage

#: Bytes of distinct content that one table may hold.
TABLE_BYTES = 32 << 20
#: Parts of an oversized bucket, and tasks that a content's records are dealt to on the way.
FAN, SALTS = 16, 8

RECORD = "bucket string, hash long, content binary, bytes long, keep_id long, group_size long, keep_rows long"
GROUP = "text_sha256 string, keep_id long, group_size long, keep_rows long"


class ContentTable:
    """Open addressing with linear probing; a slot is shared only by identical bytes."""

    def __init__(self):
        self.slots = np.full(1024, -1, np.int64)
        self.rows: list[list] = []  # bucket, hash, content, bytes, largest id, count, rows of that id
        self.bytes = 0

    def add(self, bucket: str, code: int, content: bytes, keep_id: int | None, n: int, rows: int = 1) -> None:
        mask = len(self.slots) - 1
        at = code & mask
        while (row := self.slots[at]) >= 0:
            found = self.rows[row]
            if found[1] == code and found[2] == content:
                if keep_id == found[4]:
                    found[6] += rows
                elif keep_id is not None and (found[4] is None or keep_id > found[4]):
                    found[4], found[6] = keep_id, rows
                found[5] += n
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.rows)
        self.rows.append([bucket, code, content, len(content), keep_id, n, rows])
        self.bytes += len(content) + 200
        if 2 * len(self.rows) > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for i, row in enumerate(self.rows):
            at = row[1] & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = i

    def fill(self, batch) -> None:
        columns = (batch.column(c).to_pylist() for c in ("bucket", "hash", "content", "keep_id", "group_size", "keep_rows"))
        for record in zip(*columns, strict=True):
            self.add(*record)

    def records(self) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = ["bucket", "hash", "content", "bytes", "keep_id", "group_size", "keep_rows"]
        for at in range(0, len(self.rows), 1000):
            columns = zip(*self.rows[at : at + 1000], strict=True)
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)


def _collapse(limit: int):
    """Add up equal contents; a full table is handed on and a new one begun."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = ContentTable()
        for batch in slices(batches, "content"):
            held.fill(batch)
            if held.bytes > limit:
                yield from held.records()
                held = ContentTable()
        yield from held.records()

    return run


def _settle(bucket: pa.Table) -> pa.Table:
    """All records of one bucket: one row for each distinct content."""
    held = ContentTable()
    held.fill(bucket)
    return pa.table(
        {
            "text_sha256": pa.array([hashlib.sha256(r[2]).hexdigest() for r in held.rows], pa.string()),
            "keep_id": pa.array([r[4] for r in held.rows], pa.int64()),
            "group_size": pa.array([r[5] for r in held.rows], pa.int64()),
            "keep_rows": pa.array([r[6] for r in held.rows], pa.int64()),
        }
    )


def groups(docs: DataFrame, limit: int = TABLE_BYTES) -> DataFrame:
    """One row for each distinct text: text_sha256, keep_id (the largest doc_id), group_size, keep_rows (rows of keep_id)."""
    text = F.coalesce("text", F.lit(""))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = max(4, int(2 * total / limit).bit_length())
    rows = docs.select(
        F.pmod(F.xxhash64(text), F.lit(1 << width)).cast("string").alias("bucket"),
        F.xxhash64(text).alias("hash"),
        text.cast("binary").alias("content"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.col("doc_id").cast("long").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(1).cast("long").alias("keep_rows"),
    )
    spill, shift, out = cut_lineage(rows.mapInArrow(_collapse(limit), RECORD)), width, None
    while True:
        size = spill.groupBy("bucket").agg(
            F.sum(F.col("bytes") + 200).alias("bytes"),
            F.count("*").alias("records"),
            F.count_distinct("hash").alias("contents"),
        )
        # one content that few records bring fits: the table holds it once
        over = size.where((F.col("bytes") > limit) & ((F.col("contents") > 1) | (F.col("records") > SALTS)))
        over = cut_lineage(over.where(F.lit(shift < 64)).select("bucket"))
        last = over.isEmpty()
        fits = spill if last else spill.join(over, "bucket", "left_anti")
        fits = fits.groupBy("bucket").applyInArrow(_settle, GROUP)
        out = fits if out is None else out.unionByName(fits)
        if last:
            return out
        # the next bits of the hash split a bucket; the document id deals out the records of one content
        digit = F.pmod(F.shiftrightunsigned("hash", shift), F.lit(FAN))
        large = spill.join(over, "bucket", "left_semi")
        large = large.withColumn("bucket", F.concat_ws(".", "bucket", digit.cast("string")))
        large = large.repartition(F.col("bucket"), F.pmod(F.hash("keep_id"), F.lit(SALTS)))
        spill = cut_lineage(large.mapInArrow(_collapse(limit), RECORD))
        shift += FAN.bit_length() - 1


def _hashed(docs: DataFrame, name: str) -> DataFrame:
    return docs.withColumn(name, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))


def exact_dedup(docs: DataFrame, limit: int = TABLE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null counts as the empty text. Of equal texts the largest doc_id stays; a group without any doc_id has
    a null keep_id and its rows stay. Further columns of ``docs`` play no part.
    """
    joined = _hashed(docs.select("doc_id", "text"), "text_sha256").drop("text").join(groups(docs, limit), "text_sha256")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, limit: int = TABLE_BYTES) -> DataFrame:
    """The documents that stay, with all their columns; of fully repeated (doc_id, text) rows one stays."""
    sha, keep, rows = fresh(docs, "text_sha256", "keep_id", "keep_rows")
    found = groups(docs, limit).select(F.col("text_sha256").alias(sha), F.col("keep_id").alias(keep), F.col("keep_rows").alias(rows))
    found = cut_lineage(found)
    joined = _hashed(docs, sha).join(found, sha).where(F.col("doc_id").eqNullSafe(F.col(keep)))
    # only rows that are repeated in full are shuffled once more
    many = joined.where(F.col(rows) > 1).dropDuplicates(["doc_id", sha])
    return joined.where(F.col(rows) == 1).unionByName(many).select(*docs.columns)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = """
with t as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents),
g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from t group by text_sha256)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from t join g using (text_sha256)
"""
