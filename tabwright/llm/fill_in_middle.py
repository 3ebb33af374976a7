"""Fill-in-the-middle texts, cut at unit ranks that an indexable skip list finds.

The units of a text are runs of ASCII letters and single other characters. They are the nodes of a skip list: every unit
stands in lane 0, and by a hash of its place one in ``FAN`` of a lane's units stands in the lane above. A node carries how
many units and how many code points lie between it and the next node of its lane. To reach a rank, a walk begins at the
text's head in the top lane, goes on while the next node is not beyond the rank, and descends; the widths that it has
passed add up to the rank in units, and to the place of the cut in code points.

The lists of all texts of a slice lie in the same arrays, one after the other, and their walks take steps together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import mix, slices, table, text_bytes

#: One in so many units of a lane stands in the lane above.
FAN = 16
#: Shares in percent: texts that stay as they are, and of the others those whose suffix comes first.
PLAIN, SUFFIX_FIRST = 10, 20
#: The signs before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SLICE = 2 << 20


class SkipLists:
    """One list for each text of a slice; ``sizes`` are their numbers of units.

    ``lanes`` holds (first, units, points) from the bottom up: where each text's nodes begin, and the two widths of every
    node. The last node of a text in each lane is its tail, of width 0.
    """

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(column)
        n, texts = len(data), len(offsets) - 1
        letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
        follows = np.flatnonzero((data & 0xC0) == 0x80)
        begins = ~letter
        begins[1:] |= ~letter[:-1]
        begins[follows] = False
        begins[offsets[:-1][offsets[:-1] < n]] = True
        starts = np.flatnonzero(begins)
        # code points before each unit, and before each text's end
        ends = offsets[1:]
        points = starts - np.searchsorted(follows, starts)
        total = ends - np.searchsorted(follows, ends)
        head = np.searchsorted(starts, offsets)
        self.sizes = np.diff(head)
        tails = head[1:]
        place = np.insert(points, tails, total).astype(np.int64)
        first = head[:-1] + np.arange(texts)
        tail = tails + np.arange(texts)
        width = np.diff(place, append=place[-1:])
        width[tail] = 0
        units = np.ones(len(place), np.int64)
        units[tail] = 0
        fixed = np.zeros(len(place), bool)
        fixed[first] = fixed[tail] = True
        name = np.arange(len(place), dtype=np.uint64)
        self.lanes = [(first, units, width)]
        #: for each lane but the lowest, where its nodes stand in the lane below
        self.below: list[np.ndarray] = []
        while len(place) and (np.diff(np.append(first, len(units))) > 2).any():
            name = mix(name)
            up = np.flatnonzero(fixed | (name % np.uint64(FAN) == 0))
            if len(up) == len(units):
                break
            units, width = np.add.reduceat(units, up), np.add.reduceat(width, up)
            # a tail's sum holds nothing but itself, as the next text's head is in every lane
            first = np.searchsorted(up, first)
            fixed, name = fixed[up], name[up]
            self.below.append(up)
            self.lanes.append((first, units, width))

    def reach(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(units, points) passed on the way to one rank of each text; the units are the rank."""
        passed, points = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        node = self.lanes[-1][0].copy()
        for level in range(len(self.lanes) - 1, -1, -1):
            _, units, width = self.lanes[level]
            walk = np.arange(len(ranks))
            while len(walk):
                step = units[node[walk]]
                walk = walk[(step > 0) & (passed[walk] + step <= ranks[walk])]
                passed[walk] += units[node[walk]]
                points[walk] += width[node[walk]]
                node[walk] += 1
            if level:
                node = self.below[level - 1][node]
        return passed, points


def chances(doc_id: int | None, seed: str) -> list[int]:
    """Four numbers below 2**32 that depend on the document's name only."""
    code = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(code[i : i + 8], 16) for i in range(0, 32, 8)]


def arrange(form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def restore(form: str, output: str) -> str:
    """The text from its output. No part holds a sign, and no sign begins as another ends, so the first of each kind is it."""
    if form == "plain":
        return output
    a, b = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output[len(a) :].split(b, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == "psm" else two + middle + one


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _run(seed: str, plain: int, suffix_first: int, with_output: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            lists = SkipLists(batch.column("text"))
            sizes = lists.sizes
            h = np.array([chances(i, seed) for i in batch.column("doc_id").to_pylist()], np.int64).reshape(-1, 4)
            cuts = h[:, :2] % (sizes + 1)[:, None]
            low, high = lists.reach(cuts.min(1))[1], lists.reach(cuts.max(1))[1]
            rows = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                text, a, b = text or "", int(low[i]), int(high[i])
                if not text or h[i, 2] % 100 >= 100 - plain or any(sign in text for sign in (PREFIX, SUFFIX, MIDDLE)):
                    form, output, a, b = "plain", text, None, None
                else:
                    form = "spm" if h[i, 3] % 100 < suffix_first else "psm"
                    output = arrange(form, text[:a], text[a:b], text[b:])
                rows.append((form, a, None if a is None else b - a, _digest(output), _digest(restore(form, output)), output))
            form, prefix, middle, out, back, output = zip(*rows, strict=True)
            columns = {
                "doc_id": batch.column("doc_id"),
                "n": pa.array(sizes, pa.int64()),
                "form": pa.array(form, pa.string()),
                "prefix_chars": pa.array(prefix, pa.int64()),
                "middle_chars": pa.array(middle, pa.int64()),
                "output_sha256": pa.array(out, pa.string()),
                "restored_sha256": pa.array(back, pa.string()),
            }
            if with_output:
                columns["output"] = pa.array(output, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def fill_in_middle(docs: DataFrame, seed: str = "1", plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, with_output: bool = True) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars, two digests and the output text.

    Form ``psm`` is prefix, suffix, middle, ``spm`` is suffix, prefix, middle, and ``plain`` is the text as it was: empty
    and null texts, texts that hold one of the signs, and ``plain`` percent of the others. The cuts follow from ``seed``
    and doc_id alone, so rows that share an id and text are equal; a row without doc_id counts as having an empty name.
    Further columns play no part. ``restored_sha256`` is that of the text rebuilt from output and form.
    """
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(_run(seed, plain, suffix_first, with_output), schema + ", output string" * with_output)


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"), with_output=False)


OP13_SQL = """
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || doc_id) as h from documents),
c as (
  select *, len(u) as n, ('0x' || h[1:8])::ubigint as h1, ('0x' || h[9:16])::ubigint as h2, ('0x' || h[17:24])::ubigint as h3, ('0x' || h[25:32])::ubigint as h4 from d),
f as (
  select *, (least(h1 % (n + 1), h2 % (n + 1)))::bigint as a, (greatest(h1 % (n + 1), h2 % (n + 1)))::bigint as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from c),
p as (
  select *, coalesce(array_to_string(u[1:a], ''), '') as prefix, coalesce(array_to_string(u[a + 1:b], ''), '') as middle, coalesce(array_to_string(u[b + 1:], ''), '') as suffix from f)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(t) as restored_sha256 from p
"""
