"""Byte-level BPE by a segment tree over the ranks of adjacent pairs, and decoding.

The leaves of a tree are the ranks of the pairs of neighbouring tokens of one piece, each with its place. The root is
the smallest, so it names the leftmost of the lowest-ranked merges. A merge changes at most three leaves: its own, that
of the pair before it, and that of the token that went; each is updated on its way to the root. When the root is empty
no pair can merge and the tokens that are left are the encoding.

Pieces of up to ``WIDE`` bytes stand in the rows of one array and take their steps together, each in its own tree; a
longer piece has a tree of its own.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import slices, table
from tabwright.llm.pieces import BYTE_LEVEL, SLICE_BYTES, Cutter, SliceEncoder, gather, pre_tokenizer_classes

#: Longest piece whose tree is a row of a shared array, and how many cells such an array has.
WIDE, CELLS = 128, 1 << 21
NONE = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens and merges of a byte-level tokenizer file."""

    def __init__(self, spec: str):
        full = json.loads(spec)
        model, pre, added = full["model"], full["pre_tokenizer"] or {}, full.get("added_tokens") or []
        fine = (
            model.get("type", "BPE") == "BPE" and not full["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space") and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip"))
        )
        if not fine:
            raise ValueError("only plain byte-level BPE files are supported")
        letters = byte_letters()
        vocab = model["vocab"]
        self.added = {t["content"].encode(): t["id"] for t in added}
        missing = [c for c in letters if c not in vocab]
        if missing:
            raise ValueError("the vocabulary lacks single bytes")
        self.first = np.empty(256, np.int64)
        for c, b in letters.items():
            self.first[b] = vocab[c]
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.tokens: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.tokens[i] = bytes(map(letters.__getitem__, token)) if all(c in letters for c in token) else token.encode()
        for content, i in self.added.items():
            self.tokens[i] = content
        #: rank and new token of a pair; a pair is the number left * size + right
        self.size = size
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] * size + vocab[b]] = (rank, vocab[a + b])
        self.pairs = np.array(sorted(self.merges), np.int64)
        found = np.array([self.merges[p] for p in self.pairs.tolist()], np.int64).reshape(-1, 2)
        self.rank, self.made = found[:, 0].copy(), found[:, 1].copy()
        self._pad = np.append(self.pairs, NONE)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of the merge of each pair in ``pairs``, -1 for none."""
        pair = left * self.size + right
        at = np.searchsorted(self.pairs, pair)
        return np.where(self._pad[at] == pair, at, -1)


class PieceTree:
    """The tree of one long piece."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes):
        self.v = vocabulary
        raw = np.frombuffer(piece, np.uint8)
        ids = vocabulary.first[raw]
        n = len(ids)
        self.n, self.width = n, 1 << max(1, (n - 1).bit_length())
        self.ids = ids.tolist()
        self.next, self.before = list(range(1, n + 1)), list(range(-1, n - 1))
        found = vocabulary.lookup(ids[:-1], ids[1:])
        level = np.full(self.width, NONE)
        level[: n - 1] = np.where(found >= 0, vocabulary.rank[found] * self.width + np.arange(n - 1), NONE)
        levels = [level]
        while len(level) > 1:
            level = np.minimum(level[::2], level[1::2])
            levels.append(level)
        #: node 1 is the root, node i has the children 2i and 2i + 1
        self.nodes = [NONE, *np.concatenate(levels[::-1]).tolist()]

    def _update(self, leaf: int, value: int) -> None:
        nodes, at = self.nodes, leaf + self.width
        nodes[at] = value
        while at > 1:
            other = nodes[at ^ 1]
            if other < value:
                value = other
            at >>= 1
            if nodes[at] == value:
                return
            nodes[at] = value

    def _pair(self, leaf: int) -> int:
        other = self.next[leaf]
        if other >= self.n:
            return NONE
        found = self.v.merges.get(self.ids[leaf] * self.v.size + self.ids[other])
        return NONE if found is None else found[0] * self.width + leaf

    def encode(self) -> list[int]:
        merges, size = self.v.merges, self.v.size
        while (root := self.nodes[1]) != NONE:
            at = root & (self.width - 1)
            gone = self.next[at]
            self.ids[at] = merges[self.ids[at] * size + self.ids[gone]][1]
            after = self.next[at] = self.next[gone]
            if after < self.n:
                self.before[after] = at
            self._update(gone, NONE)
            self._update(at, self._pair(at))
            if at:
                self._update(self.before[at], self._pair(self.before[at]))
        out, at = [], 0
        while at < self.n:
            out.append(self.ids[at])
            at = self.next[at]
        return out


def merge_rows(v: Vocabulary, data: np.ndarray, begin: np.ndarray, sizes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many pieces of at most ``2**bits`` bytes, (rows, columns), -1 where no token begins; each row is one tree."""
    width, rows = 1 << bits, len(begin)
    column = np.arange(width)
    inside = column < sizes[:, None]
    ids = np.where(inside, v.first[data[np.minimum(begin[:, None] + column, len(data) - 1)]], -1)
    found = np.full((rows, width), -1)
    if width > 1:
        found[:, :-1] = np.where(inside[:, 1:], v.lookup(ids[:, :-1], ids[:, 1:]), -1)
    # a value is rank * width + place; the number of a merge follows from its rank
    by_rank = np.empty(len(v.pairs), np.int64)
    by_rank[v.rank] = np.arange(len(v.pairs))
    rank = np.append(v.rank, NONE >> bits)
    nodes = np.empty((rows, 2 * width), np.int64)
    nodes[:, width:] = np.where(found >= 0, rank[found] * width + column, NONE)
    for level in range(bits - 1, -1, -1):
        low = 1 << level
        np.minimum(nodes[:, 2 * low : 4 * low : 2], nodes[:, 2 * low + 1 : 4 * low : 2], out=nodes[:, low : 2 * low])
    after = np.minimum(column + 1, sizes[:, None])
    before = np.broadcast_to(column - 1, (rows, width)).copy()
    flat, ids, after, before = nodes.reshape(-1), ids.reshape(-1), after.reshape(-1), before.reshape(-1)

    def update(row: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
        base, at = row * (2 * width), place + width
        flat[base + at] = value
        for _ in range(bits):
            value = np.minimum(value, flat[base + (at ^ 1)])
            at >>= 1
            flat[base + at] = value

    def pair(row: np.ndarray, place: np.ndarray, limit: np.ndarray) -> np.ndarray:
        base = row * width
        other = after[base + place]
        ends = other >= limit
        right = ids[base + np.where(ends, place, other)]
        hit = v.lookup(ids[base + place], right)
        return np.where((hit >= 0) & ~ends, rank[hit] * width + place, NONE)

    active = np.flatnonzero(flat[1 :: 2 * width] != NONE)
    while len(active):
        root = flat[active * (2 * width) + 1]
        more = root != NONE
        active, root = active[more], root[more]
        base, limit = active * width, sizes[active]
        at = root & (width - 1)
        gone = after[base + at]
        ids[base + at] = v.made[by_rank[root >> bits]]
        ids[base + gone] = -1
        then = after[base + gone]
        after[base + at] = then
        has = then < limit
        before[(base + then)[has]] = at[has]
        update(active, gone, np.full(len(active), NONE))
        update(active, at, pair(active, at, limit))
        has = at > 0
        prior = before[(base + at)[has]]
        update(active[has], prior, pair(active[has], prior, limit[has]))
    ids = ids.reshape(rows, width)
    return ids, (ids >= 0).sum(1)


def encode_pieces(v: Vocabulary, pieces: list[bytes]) -> list[bytes]:
    """Packed ids of each piece."""
    out: list[bytes] = [b""] * len(pieces)
    sizes = np.array([len(p) for p in pieces], np.int64)
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(pieces), np.uint8)
    for i in np.flatnonzero(sizes > WIDE).tolist():
        out[i] = np.array(PieceTree(v, pieces[i]).encode(), np.int32).tobytes()
    bits = np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    for b in range(WIDE.bit_length()):
        rows = np.flatnonzero((bits == b) & (sizes > 0) & (sizes <= WIDE))
        step = max(1, CELLS >> (b + 2))
        for a in range(0, len(rows), step):
            some = rows[a : a + step]
            ids, counts = merge_rows(v, data, begin[some], sizes[some], b)
            flat = ids[ids >= 0].astype(np.int32).tobytes()
            ends = (4 * np.cumsum(counts)).tolist()
            at = 0
            for i, end in zip(some.tolist(), ends, strict=True):
                out[i] = flat[at:end]
                at = end
    for i, piece in enumerate(pieces):
        if piece in v.added:
            out[i] = np.array([v.added[piece]], np.int32).tobytes()
    return out


def make_encoder(spec: str, classes: np.ndarray) -> tuple[SliceEncoder, pa.Array]:
    """The encoder of a tokenizer file, and the bytes of each id."""
    v = Vocabulary(spec)
    cutter = Cutter(BYTE_LEVEL, classes, [m.decode() for m in v.added])
    return SliceEncoder(cutter, lambda pieces: encode_pieces(v, pieces)), pa.array(v.tokens, pa.large_binary())


def _run(shared, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        # a worker unpickles a broadcast value once and keeps it, so one encoder serves all its tasks
        if "encoder" not in held:
            held["encoder"] = make_encoder(held["spec"], np.frombuffer(held["classes"], np.uint8))
        encoder, tokens = held["encoder"]
        for batch in slices(batches, "text", SLICE_BYTES):
            ids, at = encoder.encode_column(batch.column("text"))
            raw, ends = gather(tokens, ids, at)
            packed = memoryview(ids.astype("<u4")).cast("B") if len(ids) else memoryview(b"")
            id_hash, text_hash = [], []
            for i in range(batch.num_rows):
                id_hash.append(hashlib.sha256(packed[4 * at[i] : 4 * at[i + 1]]).hexdigest())
                text = codecs.decode(raw[ends[i] : ends[i + 1]], "utf-8", "replace")
                text_hash.append(hashlib.sha256(text.encode()).hexdigest())
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array(np.diff(at)),
                "ids_sha256": pa.array(id_hash, pa.string()),
                "decoded_sha256": pa.array(text_hash, pa.string()),
            }
            if with_ids:
                columns["ids"] = pa.LargeListArray.from_arrays(at, pa.array(ids)).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def tokenize(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids.

    ``path`` is a byte-level BPE file of the tokenizers library; a marker of the file that stands in a text has its own
    id, no others are added. A null or empty text has no ids. Rows without doc_id and repeated rows keep their rows;
    further columns play no part. ``decoded_sha256`` is that of the text that the ids decode to.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = f.read()
    # one byte for each code point; with the vocabulary, a few MB of fixed size
    classes = pre_tokenizer_classes(Tokenizer.from_str(spec).pre_tokenizer).tobytes()
    shared = docs.sparkSession.sparkContext.broadcast({"spec": spec, "classes": classes})
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(_run(shared, with_ids), schema)


def op12_segment_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return tokenize(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), with_ids=False)
