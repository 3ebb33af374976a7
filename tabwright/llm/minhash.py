"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has ``BINS`` coordinates. In round ``r`` every element of a set falls into one bin with the value
``(r, hash)``; a bin keeps its smallest value, so earlier rounds win. Once every bin is filled, or after
``BINS`` rounds with one more round per bin that is still empty, the sketch is whole: every coordinate is
filled, and the share of equal coordinates is concentrated around the similarity of two sets.

Bands of coordinates are joined by equality. Only documents that meet another one carry their text further,
and links are confirmed on the full shingle sets. Texts with equal shingle sets are one class, so copies are
never expanded into pairs. Every member of a band bucket is first compared with the bucket's smallest member;
what is still apart is compared in full: small buckets as pairs, large ones in tiles that count all
intersections of two blocks of texts at once and return only which groups are linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import Texts, components, mix, perhaps_in, slices, table
from tabwright.session import cut_lineage

#: A pair of similarity 0.8 shares none of 32 bands of 4 coordinates with a probability of 5e-8.
BINS, BANDS, ROWS = 128, 32, 4
#: One-bit sketches of two sets of similarity 0.8 differ in 12.8 of 128 bits on average, deviation 3.4.
MOST_BITS = 40
SHINGLE, PERCENT = 5, 80
#: Buckets up to this size are joined to pairs; larger ones are cut into tiles of about ``TILE`` members.
PAIR_BUCKET, TILE, COLUMNS = 24, 256, 4096
#: Links are confirmed under other word hashes than those that proposed them.
PROOF = 2

_SEEDS = mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(texts: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``k``-word shingles, sorted within each text, and where each text's begin.

    A text of fewer words has its whole sequence as the only shingle, a text without words none.
    """
    at, grams = texts.grams(k)
    doc = texts.doc[at] if len(at) else np.zeros(0, np.int64)
    n = np.diff(texts.first)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        grams = np.concatenate([grams, texts.runs(texts.first[short], texts.first[short + 1])])
        doc = np.concatenate([doc, short])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(len(n) + 1))


def _set_sums(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One number for each set, whatever the order of its elements."""
    sums = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(mix(grams ^ np.uint64(0xA5A5)), out=sums[1:])
    return (sums[first[1:]] - sums[first[:-1]]).view(np.int64)


def sketches(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sketch of each non-empty set: (sets, BINS) of 64-bit values."""
    sizes = np.diff(first)
    sets = np.repeat(np.arange(len(sizes)), sizes)
    empty = np.uint64(2**64 - 1)
    out = np.full((len(sizes), BINS), empty)
    flat = out.reshape(-1)
    active, elements = sets, grams
    for r in range(BINS):
        h = mix(elements ^ _SEEDS[r])
        value = (np.uint64(r) << np.uint64(56)) | (h >> np.uint64(8))
        np.minimum.at(flat, active * BINS + (h & np.uint64(BINS - 1)).astype(np.int64), value)
        open_ = (out == empty).any(1)
        more = open_[active]
        active, elements = active[more], elements[more]
        if not len(active):
            return out
    for b in range(BINS):
        h = mix(elements ^ _SEEDS[BINS + b])
        low = np.full(len(sizes), empty)
        np.minimum.at(low, active, (np.uint64(BINS) << np.uint64(56)) | (h >> np.uint64(8)))
        out[:, b] = np.minimum(out[:, b], low)
    return out


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = Texts(batch.column("text"), lower=True)
            grams, first = shingle_sets(texts, k)
            n = np.diff(first)
            # a set's name is 128 bits from two sets of word hashes that have nothing to do with each other
            sums = _set_sums(grams, first)
            more = _set_sums(*shingle_sets(texts.seeded(1), k))
            sketch = sketches(grams, first)
            odd = (mix(sketch) & np.uint64(1)).astype(np.uint8)
            bits = np.packbits(odd, axis=1).view(np.int64).reshape(len(n), 2)
            bands = np.zeros((len(n), BANDS), np.uint64)
            for j in range(ROWS):
                bands = mix(bands + sketch[:, j::ROWS])
            bands = mix(bands + np.arange(BANDS, dtype=np.uint64))
            rows = pa.array(bands.view(np.int64).reshape(-1))
            at = pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(n.astype(np.int64)),
                    pa.array(sums),
                    pa.array(more),
                    pa.array(bits[:, 0].copy()),
                    pa.array(bits[:, 1].copy()),
                    pa.ListArray.from_arrays(at, rows),
                ],
                ["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "bits_a", "bits_b", "bands"],
            )

    return run


def _verify(k: int, percent: int):
    """Rows (hub, id, hub_text, text) to the pairs whose full sets are similar enough.

    Rows arrive ordered by hub, so a hub's set is made once for many partners.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hubs, ids = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            turn = np.flatnonzero(np.r_[True, hubs[1:] != hubs[:-1]])
            left, left_at = shingle_sets(Texts(batch.column("a_text").take(pa.array(turn)), lower=True, seed=PROOF), k)
            right, right_at = shingle_sets(Texts(batch.column("text"), lower=True, seed=PROOF), k)
            of = np.repeat(np.arange(len(turn)), np.diff(np.r_[turn, len(hubs)]))
            good = np.zeros(len(ids), bool)
            for i in range(len(ids)):
                a = left[left_at[of[i]] : left_at[of[i] + 1]]
                b = right[right_at[i] : right_at[i + 1]]
                place = np.minimum(np.searchsorted(a, b), len(a) - 1)
                both = int((a[place] == b).sum())
                good[i] = both > 0 and 100 * both >= percent * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([pa.array(hubs[good]), pa.array(ids[good])], ["a", "b"])

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links among candidate ``pairs`` (a, b): each text is moved to its pairs, then sets are compared."""
    with_b = pairs.join(texts.select(F.col("id").alias("b"), "text"), "b")
    both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("a_text")), "a")
    both = both.select("a", "b", "a_text", "text").sortWithinPartitions("a")
    return cut_lineage(both.mapInArrow(_verify(k, percent), "a long, b long"))


def _intersections(left: np.ndarray, left_at: np.ndarray, right: np.ndarray, right_at: np.ndarray) -> np.ndarray:
    """Sizes of all intersections of two blocks of sets, as products of incidence matrices over shared shingles."""
    shared = np.intersect1d(left, right)
    n, m = len(left_at) - 1, len(right_at) - 1
    out = np.zeros((n, m), np.float32)
    parts = []
    for values, at in ((left, left_at), (right, right_at)):
        rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
        place = np.searchsorted(shared, values)
        hit = place < len(shared)
        hit[hit] = shared[place[hit]] == values[hit]
        order = np.argsort(place[hit], kind="stable")
        parts.append((rows[hit][order], place[hit][order], len(at) - 1))
    for begin in range(0, len(shared), COLUMNS):
        blocks = []
        for rows, place, size in parts:
            a, b = np.searchsorted(place, [begin, begin + COLUMNS])
            block = np.zeros((size, min(COLUMNS, len(shared) - begin)), np.float32)
            block[rows[a:b], place[a:b] - begin] = 1
            blocks.append(block)
        out += blocks[0] @ blocks[1].T
    return out


def _tile_links(k: int, percent: int):
    """One pair of tiles to the distinct pairs of groups that a link between the tiles joins."""

    def run(rows: pa.Table) -> pa.Table:
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        tiles = rows.column("tile").to_numpy()
        sides = []
        for tile in (i, j):
            side = rows.filter(pa.array(tiles == tile))
            sets = shingle_sets(Texts(side.column("text").combine_chunks(), lower=True, seed=PROOF), k)
            sides.append((side.column("g").to_numpy(), *sets))
        (gx, left, left_at), (gy, right, right_at) = sides
        both = _intersections(left, left_at, right, right_at).astype(np.int64)
        union = np.diff(left_at)[:, None] + np.diff(right_at)[None] - both
        linked = (both > 0) & (100 * both >= percent * union) & (gx[:, None] != gy[None])
        x, y = np.nonzero(linked)
        pairs = np.unique(np.stack([gx[x], gy[y]], 1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return run


def _tiled(large: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between groups of large buckets (band, y, g). Buckets that share members are one cluster."""
    low = large.groupBy("band").agg(F.min("y.id").alias("a"))
    cluster = components(large.join(low, "band").select("a", F.col("y.id").alias("b")))
    members = large.select(F.col("y.id").alias("id"), "g").distinct().join(cluster.withColumnRenamed("node", "id"), "id")
    size = members.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    members = members.join(size, "component").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    members = members.join(texts, "id").select("component", "id", "g", "tile", "text", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("u"))
    members = members.select("component", "g", "tile", "text", F.least("tile", "u").alias("i"), F.greatest("tile", "u").alias("j"))
    return cut_lineage(members.groupBy("component", "i", "j").applyInArrow(_tile_links(k, percent), "a long, b long"))


def _alike(percent: int) -> F.Column:
    """What two members x, y of a bucket must satisfy to be similar: sizes exactly, one-bit sketches but for 1e-12."""
    sizes = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    apart = F.bit_count(F.col("x.bits_a").bitwiseXOR(F.col("y.bits_a"))) + F.bit_count(F.col("x.bits_b").bitwiseXOR(F.col("y.bits_b")))
    return sizes & (apart <= MOST_BITS)


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Null and blank texts have no shingles and link with nothing. Rows that share a doc_id are one node; a row
    without doc_id links with nothing, has a null component_id and stays. Repeated rows keep their rows.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    marks = cut_lineage(source.mapInArrow(_signatures(k), "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bits_a long, bits_b long, bands array<long>"))
    # a class is one shingle set with a number of its own; one text of its smallest document stands for it, as
    # that document may have other texts in other classes
    classes = marks.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("least"), F.first("n_shingles").alias("n"), F.first("bits_a").alias("bits_a"), F.first("bits_b").alias("bits_b"), F.first("bands").alias("bands")
    )
    classes = cut_lineage(classes.select("*", "least.*").drop("least").withColumn("id", F.monotonically_increasing_id()))
    # most bands are of one class; only the others are moved again, and with what tells whether members are alike
    members = classes.select("id", F.explode("bands").alias("band"))
    lead = cut_lineage(members.groupBy("band").agg(F.min("id").alias("low"), F.count("*").alias("c")).where("c > 1").select("band", "low"))
    shared = cut_lineage(perhaps_in(members, lead, ["band"]).join(lead, "band"))
    alike = classes.select("id", F.struct("id", "n", "bits_a", "bits_b").alias("one"))
    shared = shared.join(alike.select("id", F.col("one").alias("y")), "id").drop("id")
    buckets = cut_lineage(shared.join(alike.select(F.col("id").alias("low"), F.col("one").alias("x")), "low").select("band", "x", "y"))
    # first every member against the smallest member of its buckets
    stars = buckets.where(F.col("x.id") != F.col("y.id")).where(_alike(percent))
    stars = stars.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    stars = cut_lineage(stars)
    met = cut_lineage(classes.join(buckets.select(F.col("y.id").alias("id")), "id", "left_semi").select("id", "doc_id", "text_hash"))
    keys = ["doc_id", "text_hash"]
    # an id has one text, and with the keys of the join in its name no text moves twice
    texts = perhaps_in(source, met, keys).join(met, keys).groupBy(*keys, "id").agg(F.min("text").alias("text"))
    texts = cut_lineage(texts.select("id", "text"))
    links = _confirmed(stars, texts, k, percent)
    label = components(links)
    # then, in buckets that still hold several groups, every pair of different groups that has not been compared
    group = F.coalesce("component", "y.id")
    left = buckets.join(label.select(F.col("node").alias("__n"), "component"), F.col("y.id") == F.col("__n"), "left")
    left = left.select("band", "y", group.alias("g"))
    several = left.groupBy("band").agg(F.min("g").alias("low"), F.max("g").alias("high"), F.count("*").alias("c"))
    left = cut_lineage(left.join(several.where("low < high").select("band", "c"), "band"))
    large = left.where(F.col("c") > PAIR_BUCKET)
    left = left.where(F.col("c") <= PAIR_BUCKET)
    x = left.select("band", F.col("y").alias("x"), F.col("g").alias("gx"))
    rest = x.join(left, "band").where((F.col("gx") != F.col("g")) & (F.col("x.id") < F.col("y.id")) & _alike(percent))
    rest = rest.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    rest = cut_lineage(rest)
    if not rest.isEmpty():
        links = links.unionByName(_confirmed(rest, texts, k, percent))
    if not large.isEmpty():
        links = links.unionByName(_tiled(large, texts, k, percent))
    # from here on documents are linked, each class by its smallest; so the classes of one document are one node
    names = classes.select("id", "doc_id")
    links = links.join(names.select(F.col("id").alias("a"), F.col("doc_id").alias("x")), "a").join(names.select(F.col("id").alias("b"), F.col("doc_id").alias("y")), "b")
    links = links.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b")
    same = marks.where("n_shingles > 0 and doc_id is not null").join(classes.select("set_a", "set_b", F.col("doc_id").alias("least")), ["set_a", "set_b"])
    same = same.select(F.col("doc_id").alias("a"), F.col("least").alias("b")).where("a <> b")
    label = components(links.unionByName(same))
    out = marks.select("doc_id", "n_shingles").join(label, marks.doc_id == label.node, "left")
    component = F.coalesce("component", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def keep_first(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each group of near duplicates, with all columns."""
    gone = near_duplicates(docs.select("doc_id", "text"), k, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op2_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


OP2_SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
  from documents),
s as (
  select doc_id, case when len(words) = 0 then [] when len(words) < 4 then [array_to_string(words, ' ')]
         else list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) end as shingles from w),
e as materialized (select doc_id, unnest(shingles) as shingle from s),
n as materialized (select doc_id, len(shingles) as n from s),
hit as materialized (select x.doc_id as a, y.doc_id as b, count(*) as c from e x join e y on x.shingle = y.shingle and x.doc_id <> y.doc_id group by all),
links as materialized (select a, b from hit join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
reach(doc_id, other) as (select doc_id, doc_id from n union select reach.doc_id, b from reach join links on a = other)
select n.doc_id, n.n as n_shingles, min(other) as component_id, n.doc_id = min(other) as kept
from n join reach on n.doc_id = reach.doc_id group by n.doc_id, n.n
"""
