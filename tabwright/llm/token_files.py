"""Token ids as flat binary files: unsigned integers one after the other and 64-bit document offsets.

A part is three files: ``tokens-N.bin`` (little-endian uint16, or uint32 for a vocabulary above 65,536 ids),
``offsets-N.bin`` (uint64, one for each document and the end, counted from the part's first id) and
``docs-N.bin`` (int64 doc_id, the smallest int64 for none). ``manifest`` is a Parquet table of the parts with the
number of ids in all parts before each, summed up from part totals. Parts are in ascending order of doc_id.

A task writes under names of its own attempt and the manifest lists only attempts that succeeded, so a lost
executor leaves an unlisted file at most.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.common import slices, table
from tabwright.llm.pieces import BYTE_LEVEL, SLICE_BYTES, Cutter, SliceEncoder, pre_tokenizer_classes
from tabwright.session import cut_lineage, scratch_dir

END_ID = 0
PART_BYTES = 64 << 20
NO_ID = np.iinfo(np.int64).min
VISIBLE = re.compile(r" ?\S+")

_PART = "part int, folder string, name string, docs long, ids long"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def cuts_apart(spec: dict) -> bool:
    """Whether the pieces of a byte-level pre-tokenizer have the same ids wherever they stand."""
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    limits = spec.get("truncation") or spec.get("padding")
    return plain and not limits and not any(t[k] for t in spec.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip"))


class WordEncoder:
    """Encodes with the tokenizers library; pieces met before are looked up, new ones are encoded together.

    Where the tokenizer does not cut texts into pieces that stand for themselves, whole texts are encoded.
    Markers such as ``<|endoftext|>`` in a text have their own id, as is the library's default.
    """

    def __init__(self, spec: str, dtype: str, classes: np.ndarray | None = None):
        # a task has one core; threads of the library would only compete with other tasks
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.pieces = Tokenizer.from_str(spec), dtype, None
        full = json.loads(spec)
        if cuts_apart(full):
            classes = pre_tokenizer_classes(self.tokenizer.pre_tokenizer) if classes is None else classes
            markers = [t["content"] for t in full.get("added_tokens") or []]
            self.pieces = SliceEncoder(Cutter(BYTE_LEVEL, classes, markers), self._learn)
            #: a line end between two visible pieces is always a piece of its own
            self.between = np.array(self._ids(["\n"])[0], np.int32)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [found.ids for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        texts = [p.decode() for p in pieces]
        out: list[bytes] = [b""] * len(texts)
        visible = [i for i, t in enumerate(texts) if VISIBLE.fullmatch(t) and len(self.between) == 1 and pieces[i] not in self.pieces.cutter.whole]
        for a in range(0, len(visible), 4000):
            some = visible[a : a + 4000]
            ids = np.array(self._ids(["\n".join(texts[i] for i in some)])[0], np.int32)
            ends = np.append(np.flatnonzero(ids == self.between[0]), len(ids)).tolist()
            begin = 0
            for i, end in zip(some, ends, strict=True):
                out[i] = ids[begin:end].tobytes()
                begin = end + 1
        rest = sorted(set(range(len(texts))).difference(visible))
        for a in range(0, len(rest), 4000):
            some = rest[a : a + 4000]
            for i, found in zip(some, self._ids([texts[i] for i in some]), strict=True):
                out[i] = np.array(found, np.int32).tobytes()
        return out

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all texts one after the other, the end id after each, and where each begins."""
        if self.pieces is None:
            found = self._ids([t or "" for t in column.to_pylist()])
            at = np.cumsum([0, *map(len, found)])
            ids = np.fromiter(chain.from_iterable(found), np.int64, at[-1])
        else:
            ids, at = self.pieces.encode_column(column)
        ids = np.insert(ids, at[1:], END_ID).astype(self.dtype)
        return ids, at + np.arange(len(at))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as packed integers, the end id after each."""
        ids, at = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


def _writer(shared, folder: str, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, root = _filesystem(folder)
        name = f"{part:05d}-{uuid.uuid4().hex}.bin"
        held = shared.value
        encoder = held.get("encoder") or held.setdefault("encoder", WordEncoder(held["spec"], dtype, np.frombuffer(held["classes"], np.uint8)))
        offsets, docs, total = [np.zeros(1, "<u8")], [], 0
        with fs.open_output_stream(f"{root}/tokens-{name}") as out:
            for batch in slices(batches, "text", SLICE_BYTES):
                ids, at = encoder.encode_column(batch.column("text"))
                out.write(ids.tobytes())
                offsets.append((total + at[1:]).astype("<u8"))
                docs.append(batch.column("doc_id").fill_null(NO_ID).to_numpy().astype("<i8"))
                total += len(ids)
        for kind, arrays in (("offsets", offsets), ("docs", docs)):
            with fs.open_output_stream(f"{root}/{kind}-{name}") as out:
                for a in arrays:
                    out.write(a.tobytes())
        n = sum(map(len, docs))
        if n:
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "folder": [folder], "name": [name], "docs": [n], "ids": [total]}
            )

    return run


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """Write all documents below ``folder``; returns the manifest (part, folder, name, docs, ids, base, dtype).

    Documents without an id come first, equal ids in the order of their texts' hashes. A null text has only the end id.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = folder or f"{scratch_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    model = json.loads(spec)
    ids = max(model["model"]["vocab"].values(), default=0)
    dtype = "<u2" if max([ids, *(t["id"] for t in model.get("added_tokens", []))]) < 1 << 16 else "<u4"
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    # the file of a vocabulary is a few MB; a worker unpickles it once and keeps the encoder for all its tasks
    classes = pre_tokenizer_classes(Tokenizer.from_str(spec).pre_tokenizer).tobytes() if cuts_apart(model) else b""
    shared = spark.sparkContext.broadcast({"spec": spec, "classes": classes})
    written = cut_lineage(rows.select("doc_id", "text").mapInArrow(_writer(shared, folder, dtype), _PART))
    # one row for each part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = written.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))).withColumn("dtype", F.lit(dtype))
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


class Part:
    """One part; ids are mapped into memory on a local or mounted file system and read by range elsewhere."""

    def __init__(self, folder: str, name: str, dtype: str):
        from pyarrow import fs

        self.fs, self.root = _filesystem(folder)
        self.name = name
        self.dtype = np.dtype(dtype)
        self.offsets = np.frombuffer(self._whole("offsets"), "<u8").astype(np.int64)
        self.docs = np.frombuffer(self._whole("docs"), "<i8")
        name = f"{self.root}/tokens-{name}"
        self.file = None
        if not isinstance(self.fs, fs.LocalFileSystem):
            self.file = self.fs.open_input_file(name)
        else:
            self.ids = np.memmap(name, self.dtype, "r")

    def _whole(self, kind: str) -> bytes:
        with self.fs.open_input_stream(f"{self.root}/{kind}-{self.name}") as f:
            return f.read()

    def document(self, i: int) -> np.ndarray:
        a, b = self.offsets[i], self.offsets[i + 1]
        if self.file is None:
            return self.ids[a:b]
        width = self.dtype.itemsize
        self.file.seek(int(a) * width)
        return np.frombuffer(self.file.read(int(b - a) * width), self.dtype)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            part = Part(row["folder"], row["name"], row["dtype"])
            for at in range(0, len(part.docs), 5000):
                some = range(at, min(at + 5000, len(part.docs)))
                crc = [zlib.crc32(part.document(i).astype("<u4").tobytes()) for i in some]
                docs = part.docs[at : at + len(crc)]
                starts = part.offsets[at : at + len(crc)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, pa.int64(), mask=docs == NO_ID),
                        pa.array(starts + row["base"]),
                        pa.array(part.offsets[at + 1 : at + 1 + len(crc)] - starts),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def read(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    parts = manifest.repartition("part")
    return parts.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return read(write(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json")))
