"""Texts cut into the pieces that byte-level BPE encodes one by one, a slice of texts at a time.

All texts of a slice lie in one buffer. The borders of their pieces come from array arithmetic over its bytes, equal
pieces are found by Arrow's dictionary encoding, and only pieces that a worker has not met yet go through an encoder.
Ids of whole texts are then gathered by ``take`` into one flat array.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import regex

from tabwright.llm.common import text_bytes

#: Fixed value: the pattern of byte-level pre-tokenizers, for which borders are computed on arrays.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, OTHER, BLANK = 0, 1, 2, 3
#: Text of one slice, and how many pieces a worker remembers.
SLICE_BYTES, MEMORY = 4 << 20, 400_000
#: Pieces above this length are encoded anew each time.
LONG = 64


def _every() -> tuple[str, np.ndarray]:
    points = np.r_[0:0xD800, 0xE000:0x110000]
    return "".join(map(chr, points.tolist())), points


def rank_file_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or BLANK for each code point, as the tiktoken library's tables have them.

    Libraries differ in the characters they know as letters, so the table comes from the library itself.
    """
    import tiktoken

    every, _ = _every()
    out = np.full(0x110000, OTHER, np.uint8)
    for code, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        only = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        found = bytes(only.encode_ordinary(every)).decode().encode("utf-32-le")
        out[np.frombuffer(found, "<u4")] = code
    return out


def pre_tokenizer_classes(pre_tokenizer) -> np.ndarray:
    """The same from a byte-level pre-tokenizer of the tokenizers library: it cuts all characters, in order, into runs of one class."""
    every, points = _every()

    def pieces(text: str) -> int:
        return len(pre_tokenizer.pre_tokenize_str(text))

    out = np.full(0x110000, OTHER, np.uint8)
    for _, (a, b) in pre_tokenizer.pre_tokenize_str(every):
        one = every[b - 1]
        if pieces("a" + one) == 1:
            code = LETTER
        elif pieces("1" + one) == 1:
            code = NUMBER
        else:
            code = OTHER if pieces("!" + one) == 1 else BLANK
        out[points[a:b]] = code
    out[0x20] = BLANK
    return out


def _classes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    out = table[:256][data]
    if len(data) and data.max() >= 0x80:
        for low, high, more in ((0xC0, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0xF8, 3)):
            at = np.flatnonzero((data >= low) & (data < high))
            point = (data[at] & (0x3F >> more)).astype(np.int32)
            for j in range(1, more + 1):
                point = point << 6 | (data[at + j] & 0x3F)
            found = table[point]
            for j in range(more + 1):
                out[at + j] = found
    return out


def byte_level_cuts(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where the pieces of ``BYTE_LEVEL`` begin in texts that begin at ``offsets``; the last entry is the end."""
    n = len(data)
    if not n:
        return np.zeros(1, np.int64)
    kind = _classes(data, table)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    blank = kind == BLANK
    change = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    border = change | edge[:n]
    space = data == 0x20
    # a space goes with the visible run after it
    joined = space[:-1] & ~blank[1:] & ~edge[1:n]
    border[1:][joined] = False
    border[:-1][joined] = True
    # the last of several blanks before something visible is a piece of its own
    last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~edge[1:n])
    while len(last):
        lead = (data[last] & 0xC0) != 0x80
        border[last[lead]] = True
        last = last[~lead] - 1
    at = np.flatnonzero((data[:-1] == 0x27) & border[:-1] & ~edge[1:n])
    if len(at):
        one = data[at + 1]
        short = at[np.isin(one, np.frombuffer(b"stmd", np.uint8))]
        border[short + 1] = False
        border[short[short + 2 < n] + 2] = True
        at = at[(at + 2 < n) & ~edge[np.minimum(at + 2, n)]]
        pair = data[at + 1].astype(np.int32) << 8 | data[np.minimum(at + 2, n - 1)]
        double = at[np.isin(pair, [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")])]
        border[double + 1] = False
        border[double[double + 3 < n] + 3] = True
    return np.append(np.flatnonzero(border), n)


def pattern_cuts(data: np.ndarray, offsets: np.ndarray, pattern) -> np.ndarray:
    """The same for any pattern that covers whole texts."""
    out, raw = [0], data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        for piece in pattern.findall(raw[a:b].decode()):
            out.append(out[-1] + len(piece.encode()))
        if out[-1] != b:
            raise ValueError("the pattern leaves out parts of a text")
    return np.array(out, np.int64)


def marker_edges(data: np.ndarray, offsets: np.ndarray, markers: re.Pattern) -> np.ndarray:
    """Offsets with those of all markers in texts added: what stands between two is a text of its own."""
    raw = data.tobytes()
    if not markers.search(raw):
        return offsets
    out = [offsets]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        out += [np.array([a + x for m in markers.finditer(raw[a:b]) for x in m.span()], np.int64)]
    return np.unique(np.concatenate(out))


class Cutter:
    """Cuts slices by a pattern; ``markers`` are texts that stay whole, whatever stands around them."""

    def __init__(self, pattern: str, table: np.ndarray, markers: Iterable[str] = ()):
        self.table = table if pattern == BYTE_LEVEL else None
        self.pattern = regex.compile(pattern)
        raw = sorted((m.encode() for m in markers if m), key=len, reverse=True)
        self.markers = re.compile(b"|".join(map(re.escape, raw))) if raw else None
        self.whole = set(raw)

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        edges = offsets if self.markers is None else marker_edges(data, offsets, self.markers)
        if self.table is None:
            cuts = pattern_cuts(data, edges, self.pattern)
        else:
            cuts = byte_level_cuts(data, edges, self.table)
        if edges is not offsets:
            # borders inside a marker go; every marker lies between two neighbouring edges
            raw = data.tobytes()
            inside = np.zeros(len(data) + 1, bool)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if raw[a:b] in self.whole:
                    inside[a + 1 : b] = True
            cuts = cuts[~inside[cuts]]
        return cuts


class SliceEncoder:
    """Ids of all texts of a slice. ``learn`` gives the ids of pieces as packed 32-bit integers, for many at once."""

    def __init__(self, cutter: Cutter, learn: Callable[[list[bytes]], list[bytes]], memory: int = MEMORY):
        self.cutter, self.learn, self.memory = cutter, learn, memory
        self.known: dict[bytes, bytes] = {}

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        known = self.known
        found = list(map(known.get, pieces))
        new = [i for i, packed in enumerate(found) if packed is None]
        if len(known) + len(new) > self.memory:
            known.clear()
        for i, packed in zip(new, self.learn([pieces[i] for i in new]), strict=True):
            found[i] = packed
            if len(pieces[i]) <= LONG:
                known[pieces[i]] = packed
        return found

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): all ids one after the other, and where those of each text begin. Null counts as empty."""
        data, offsets = text_bytes(column)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        cuts = self.cutter.cuts(data, offsets)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        book = pieces.dictionary_encode()
        packed = pa.array(self._ids(book.dictionary.to_pylist()), pa.large_binary())
        taken = packed.take(book.indices)
        _, ends, flat = taken.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(cuts)]
        ids = np.frombuffer(flat, np.int32)[: ends[-1] // 4]
        return ids, ends[np.searchsorted(cuts, offsets)] // 4


def gather(values: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The bytes of ``values`` at ``ids`` in one buffer, and where those of each text begin."""
    if not len(ids):
        return memoryview(b""), np.zeros(len(offsets), np.int64)
    _, ends, flat = values.take(pa.array(ids)).buffers()
    ends = np.frombuffer(ends, np.int64)[: len(ids) + 1]
    return memoryview(flat), ends[offsets]
