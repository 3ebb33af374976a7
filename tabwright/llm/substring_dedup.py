"""Repeated passages by a compacted de Bruijn graph over words.

The edges of the graph are the windows of ``k`` words. A window's minimizer is the first of the smallest hashes of
the ``m``-word runs in it, so equal windows have equal minimizers, wherever they stand. Consecutive windows of one
text under the same minimizer are a path, one row that stands for all its edges; only paths whose minimizer stands
elsewhere too are kept. Joins then find the paths that are repeated as a whole, and the paths that always follow each
other: where every occurrence of one is followed by the other and every occurrence of the other preceded by the first,
no branch lies between them, and they compact to one path. A minimizer that continues in different paths is a branch;
there the paths are opened again into windows, at their source coordinates.

Hashes only propose. Every compacted span and every window of a branch is read again at its source coordinates, and what
is removed is decided by digests of the words themselves. Spans lead back to (text, word). Texts are named by two
hashes, so copies of a text share their spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.common import Texts, slices, table
from tabwright.session import cut_lineage

#: Words of a window and of a minimizer, and bits of the hash of a path.
WINDOW, MINIMIZER, PATH_BITS = 35, 16, 64

_PATH = "t1 long, t2 int, start int, n int, minimizer long, path long"


def paths(texts: Texts, k: int, m: int):
    """Compact paths of a slice: text, first word, windows, minimizer, hash of all words under them."""
    at, grams = texts.grams(m)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none, none, none
    # hashes by word position; positions without a run of m words in their text are never read
    by_word = np.full(len(texts.wh), np.iinfo(np.uint64).max)
    by_word[at] = grams
    starts = np.arange(max(0, len(texts.wh) - k + 1))
    starts = starts[texts.doc[starts] == texts.doc[starts + k - 1]] if len(starts) else starts
    if not len(starts):
        return none, none, none, none, none
    width = k - m + 1
    views = np.lib.stride_tricks.sliding_window_view(by_word, width)
    best = np.empty(len(starts), np.int64)
    for a in range(0, len(starts), 1 << 16):
        some = starts[a : a + (1 << 16)]
        best[a : a + (1 << 16)] = some + views[some].argmin(1)
    turn = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (starts[1:] != starts[:-1] + 1)])
    n = np.diff(np.r_[turn, len(starts)])
    first = starts[turn]
    spot = best[turn]
    # the place of the minimizer and the length tell paths with equal words apart from their shifts
    code = texts.runs(first, first + n + k - 1) + (spot - first).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    code &= np.uint64((1 << PATH_BITS) - 1)
    return texts.doc[first], first - texts.first[texts.doc[first]], n, by_word[spot].view(np.int64), code.view(np.int64)


def _paths(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            doc, start, n, minimizer, path = paths(Texts(batch.column("text")), k, m)
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("t1").take(rows),
                    batch.column("t2").take(rows),
                    pa.array(start.astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                    pa.array(minimizer),
                    pa.array(path),
                ],
                ["t1", "t2", "start", "n", "minimizer", "path"],
            )

    return run


def _joined(texts: Texts) -> tuple[memoryview, np.ndarray]:
    """All words with one space after each, and where each begins (one more entry at the end)."""
    size = texts.end - texts.start + 1
    at = np.cumsum(np.r_[0, size])
    source = np.arange(at[-1]) + np.repeat(texts.start - at[:-1], size)
    out = np.append(texts.data, np.uint8(0x20))[source]
    out[at[1:] - 1] = 0x20
    return memoryview(out), at


def _digest(text: memoryview) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


_READ = "t1 long, t2 int, start int, words int, minimizer long, path long, digest binary, once boolean, branch boolean"


def _read(k: int):
    """Spans of a text and windows of its branches, read at their source coordinates: a digest of the words of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = Texts(batch.column("text"))
            joined, at = _joined(texts)
            for column, size in (("branches", k), ("spans", 0)):
                found = batch.column(column)
                flat = found.flatten()
                row = np.repeat(np.arange(batch.num_rows), np.asarray(found.fill_null([]).value_lengths()))
                each, word = np.arange(len(row)), flat.field("start").to_numpy()
                if size:
                    n = flat.field("n").to_numpy()
                    each = np.repeat(each, n)
                    word = word[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                words = np.full(len(each), size) if size else flat.field("words").to_numpy()
                begin = texts.first[row[each]] + word
                ends = zip(at[begin].tolist(), (at[begin + words] - 1).tolist(), strict=True)
                rows, many = pa.array(row[each]), pa.array(each)
                columns = [
                    batch.column("t1").take(rows),
                    batch.column("t2").take(rows),
                    pa.array(word.astype(np.int32)),
                    pa.array(words.astype(np.int32)),
                    flat.field("minimizer").take(many),
                    flat.field("path").take(many),
                    pa.array([_digest(joined[a:b]) for a, b in ends], pa.binary()),
                    flat.field("once").take(many),
                    pa.array(np.full(len(each), bool(size))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["t1", "t2", "start", "words", "minimizer", "path", "digest", "once", "branch"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and their repeated spans of words to what is left."""
    for batch in slices(batches, "text"):
        texts = Texts(batch.column("text"))
        spans = batch.column("spans")
        flat = spans.flatten()
        row = np.repeat(np.arange(batch.num_rows), np.asarray(spans.fill_null([]).value_lengths()))
        cover = np.zeros(len(texts.wh) + 1, np.int64)
        begin = texts.first[row] + flat.field("start").to_numpy()
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + flat.field("words").to_numpy(), -1)
        gone = np.cumsum(cover)[:-1] > 0
        kept, data = [], texts.data
        for i in range(batch.num_rows):
            words = slice(texts.first[i], texts.first[i + 1])
            keep = ~gone[words]
            parts = [data[a:b].tobytes() for a, b in zip(texts.start[words][keep], texts.end[words][keep], strict=True)]
            kept.append(b" ".join(parts))
        total = np.diff(texts.first)
        removed = np.diff(np.r_[0, np.cumsum(gone)][texts.first])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(total.astype(np.int64)),
                pa.array(removed.astype(np.int64)),
                pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string()),
                pa.array([t.decode() for t in kept], pa.string()),
            ],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )


def _named(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.hash(text).alias("t2"))


def edges(named: DataFrame, k: int, m: int) -> DataFrame:
    """(t1, t2, start, n, minimizer, path) of all paths whose minimizer stands more than once, written once."""
    found = named.select("t1", "t2", "text").mapInArrow(_paths(k, m), _PATH)
    often = found.groupBy("minimizer").agg(F.count("*").alias("n")).where("n > 1").select("minimizer")
    return cut_lineage(found.join(often, "minimizer", "left_semi").select("t1", "t2", "start", "n", "minimizer", "path"))


def compact(places: DataFrame, k: int) -> DataFrame:
    """Repeated paths (t1, t2, start, n, minimizer, path), each place once, as longest paths without a branch.

    One row for each place of a compacted path: t1, t2, start, words, the minimizer and path that it begins with, and
    ``parts``, the number of paths in it. A path is one with its successor if all places of both are next to each other.
    """
    node = F.struct("minimizer", "path")
    here = places.select("t1", "t2", "start", "n", node.alias("node"))
    in_text = Window.partitionBy("t1", "t2").orderBy("start")
    after = F.lead(F.struct("start", "node")).over(in_text)
    here = here.withColumn("after", after).withColumn("after", F.when(F.col("after.start") == F.col("start") + F.col("n"), F.col("after.node")))
    here = cut_lineage(here)
    count = here.groupBy("node").agg(F.count("*").alias("n"))
    links = here.where("after is not null").groupBy("node", "after").agg(F.count("*").alias("times"))
    left = count.select(F.col("node").alias("a"), F.col("n").alias("a_times"))
    right = count.select(F.col("node").alias("b"), F.col("n").alias("b_times"))
    firm = links.join(left, F.col("node") == F.col("a")).where("times = a_times")
    firm = firm.join(right, F.col("after") == F.col("b")).where("times = b_times")
    # a path of a firm link has no other predecessor, and every place of it has this one
    inner = here.join(firm.select("b").withColumn("inner", F.lit(True)), F.col("node") == F.col("b"), "left")
    run = F.sum(F.when(F.col("inner"), 0).otherwise(1)).over(in_text)
    runs = inner.withColumn("run", run).groupBy("t1", "t2", "run").agg(
        F.min(F.struct("start", "node")).alias("head"), F.sum("n").alias("n"), F.count("*").cast("int").alias("parts")
    )
    return runs.select("t1", "t2", "head.start", (F.col("n") + k - 1).cast("int").alias("words"), "head.node.minimizer", "head.node.path", "parts")


def _read_at(docs: DataFrame, spans: DataFrame | None, branches: DataFrame, k: int) -> DataFrame:
    """The given spans and branches, read in one document of each text."""
    found = branches.groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "n", "minimizer", "path", "once")).alias("branches"))
    item = F.struct("start", "words", "minimizer", "path", F.lit(False).alias("once"))
    if spans is None:
        found = found.withColumn("spans", F.array().cast("array<struct<start:int,words:int,minimizer:bigint,path:bigint,once:boolean>>"))
    else:
        found = found.join(spans.groupBy("t1", "t2").agg(F.collect_list(item).alias("spans")), ["t1", "t2"], "full")
    # a document of each text is chosen before texts move, so copies do not meet in one task
    chosen = docs.groupBy("t1", "t2").agg(F.min("doc_id").alias("chosen")).join(found, ["t1", "t2"])
    chosen = chosen.withColumnsRenamed({"t1": "c1", "t2": "c2"})
    same = (F.col("t1") == F.col("c1")) & (F.col("t2") == F.col("c2")) & F.col("doc_id").eqNullSafe(F.col("chosen"))
    texts = docs.join(chosen, same).dropDuplicates(["t1", "t2"])
    return cut_lineage(texts.select("t1", "t2", "text", "branches", "spans").mapInArrow(_read(k), _READ))


def _repeated(windows: DataFrame, k: int) -> DataFrame:
    """Windows of single paths that stand in another path as well."""
    again = windows.groupBy("minimizer", "digest").agg(F.count("*").alias("n")).where("n > 1").select("minimizer", "digest")
    return windows.where("once").join(again, ["minimizer", "digest"], "left_semi").select("t1", "t2", "start", F.lit(k).alias("words"))


def spans(docs: DataFrame, k: int = WINDOW, m: int = MINIMIZER) -> DataFrame:
    """(t1, t2, start, words): word spans covered by windows that occur more than once; overlaps are possible."""
    named = _named(docs)
    found = edges(named, k, m)
    key = ["minimizer", "path"]
    kinds = found.groupBy(*key).agg(F.count("*").alias("times"), F.min(F.struct("t1", "t2", "start", "n")).alias("place"))
    kinds = cut_lineage(kinds)
    forks = kinds.groupBy("minimizer").agg(F.count("*").alias("paths")).where("paths > 1").select("minimizer")
    # paths that are repeated as a whole, wherever they stand; copies of a text count once from here on
    whole = kinds.where("times > 1").select(*key)
    places = found.join(whole, key, "left_semi").dropDuplicates(["t1", "t2", "start"])
    compacted = cut_lineage(compact(places, k))
    # branches, opened where one path of each kind stands
    branches = kinds.join(forks, "minimizer", "left_semi").select("place.*", *key, (F.col("times") == 1).alias("once"))
    read = _read_at(named, compacted, branches, k)
    firm, windows = read.where("not branch"), read.where("branch")
    # equal hashes of unequal words: all paths of these minimizers are opened, everywhere
    wrong = firm.groupBy(*key, "words").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high")
    wrong = wrong.unionByName(firm.groupBy(*key).agg(F.min("words").alias("words"), F.max("words").alias("most"), F.min("digest").alias("low"), F.max("digest").alias("high")).where("words <> most").drop("most"))
    wrong = cut_lineage(wrong.select(*key).distinct())
    out = firm.select("t1", "t2", "start", "words")
    if wrong.isEmpty():
        return out.unionByName(_repeated(windows, k))
    return _exactly(named, found, firm, windows, wrong, k)


def _exactly(named: DataFrame, found: DataFrame, firm: DataFrame, windows: DataFrame, wrong: DataFrame, k: int) -> DataFrame:
    """The spans where some hashes met that should not have: their minimizers are decided window by window."""
    bad = firm.join(wrong, ["minimizer", "path"], "left_semi")
    inside = bad.select("t1", "t2", F.col("start").alias("low"), (F.col("start") + F.col("words") - k).alias("high"))
    minimizers = found.join(inside, ["t1", "t2"]).where("start between low and high").select("minimizer").distinct()
    minimizers = cut_lineage(minimizers)
    copies = named.groupBy("t1", "t2").agg(F.count("*").alias("copies"))
    opened = found.join(minimizers, "minimizer", "left_semi").dropDuplicates(["t1", "t2", "start"]).withColumn("once", F.lit(True))
    every = _read_at(named, None, opened, k).join(copies, ["t1", "t2"])
    again = every.groupBy("minimizer", "digest").agg(F.sum("copies").alias("n")).where("n > 1").select("minimizer", "digest")
    exact = every.join(again, ["minimizer", "digest"], "left_semi").select("t1", "t2", "start", F.lit(k).alias("words"))
    good = firm.join(wrong, ["minimizer", "path"], "left_anti").select("t1", "t2", "start", "words")
    return good.unionByName(_repeated(windows.join(minimizers, "minimizer", "left_anti"), k)).unionByName(exact)


def remove_repeats(docs: DataFrame, k: int = WINDOW, m: int = MINIMIZER) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text.

    A word goes if a window of ``k`` words that covers it also starts at any other place. Null texts have no
    words. Repeated rows count as other places, and every row keeps its own result.
    """
    covered = spans(docs, k, m).groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "words")).alias("spans"))
    joined = _named(docs).join(covered, ["t1", "t2"], "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


OP5_SQL = r"""
with d as materialized (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
w as materialized (
  select doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) as h from (select doc_id, words, unnest(range(1, len(words) - 33)) as i from d)),
again as (select h from w group by h having count(*) > 1),
gone as materialized (select distinct doc_id, i + j as p from w join again using (h), (select unnest(range(35)) as j)),
word as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as p from d),
kept as (select doc_id, string_agg(word, ' ' order by p) as kept from word anti join gone using (doc_id, p) group by doc_id),
n as (select doc_id, count(*) as n from gone group by doc_id)
select d.doc_id, len(d.words) as n_words, coalesce(n.n, 0) as n_removed, sha256(coalesce(kept.kept, '')) as kept_sha256
from d left join n using (doc_id) left join kept using (doc_id)
"""
