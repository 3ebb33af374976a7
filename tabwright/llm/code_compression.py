"""Vectors compressed to one code for each of their parts, in exact integer arithmetic.

Components become integers ``floor(scale * x)``, and every part position has a codebook. Squared distances to all entries
are |x|^2 - 2 x.c + |c|^2. The products x.c are matrix products in float64 whose inputs are limbs of the integers, short
enough that every sum stays below 2**53 and is exact; the limbs' products are put together in 64-bit integers. So ties are
true ties, and the first smallest distance is the same on every machine and in every order of rows.

A round assigns all parts in one pass over the vectors. Tasks add up the parts of each entry, Spark adds up the tasks, and
only the codebooks, whose size is fixed, come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import table
from tabwright.session import cut_lineage

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Vectors of one block of products.
BLOCK = 4096


def limb_bits(width: int) -> int:
    """The most bits of a limb for which ``width`` products add up to at most 2**53."""
    return (53 - max(1, width - 1).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """``x`` as limbs of ``bits`` bits, the lowest first; all but the last are not negative, the last keeps the sign."""
    out = []
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    while low < -(1 << bits) or high > 1 << bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
        low, high = low >> bits, high >> bits
    return [*out, x.astype(np.float64)]


def exact_products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """x @ c.T of 64-bit integers, exact where the result fits."""
    bits = limb_bits(x.shape[1])
    out = np.zeros((len(x), len(c)), np.int64)
    right = limbs(c, bits)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(right):
            if bits * (i + j) < 64:
                out += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of ``c`` for each row of ``x``, and its squared distance."""
    away = (x * x).sum(1)[:, None] - 2 * exact_products(x, c) + (c * c).sum(1)[None]
    best = away.argmin(1)
    return best, away[np.arange(len(x)), best]


def integers(column: pa.Array, width: int, scale: int, parts: int) -> np.ndarray:
    """The integer components of a column of vectors, (rows, parts, part width)."""
    flat = np.floor(scale * pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64))
    # distances add up width / parts squares of differences and have to fit 63 bits
    most = 2.0 ** ((61 - (width // parts).bit_length()) // 2)
    if flat.size and np.abs(flat).max() >= most:
        raise ValueError(f"components have to be below {most / scale:g} for exact distances")
    return flat.astype(np.int64).reshape(-1, parts, width // parts)


def _assign(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) codes and (rows,) summed distances."""
    codes, error = np.empty(block.shape[:2], np.int64), np.zeros(len(block), np.int64)
    for part in range(block.shape[1]):
        codes[:, part], away = nearest(block[:, part], books[part])
        error += away
    return codes, error


def _sums(books: np.ndarray, width: int, scale: int):
    """One task's vectors to the sums of parts at each entry."""
    parts, entries, each = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros((parts * entries, each), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block = integers(batch.column("v").slice(at, BLOCK), width, scale, parts)
                slot = _assign(block, books)[0] + np.arange(parts) * entries
                np.add.at(sums, slot.reshape(-1), block.reshape(-1, each))
                count += np.bincount(slot.reshape(-1), minlength=parts * entries)
        used = np.flatnonzero(count)
        at = np.arange(len(used) + 1, dtype=np.int32) * each
        values = pa.ListArray.from_arrays(at, pa.array(sums[used].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), values], ["slot", "n", "sums"])

    return run


def _codes(books: np.ndarray, width: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                codes, error = _assign(integers(some.column("v"), width, scale, books.shape[0]), books)
                text = [row.tobytes().hex() for row in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [some.column("vec_id"), some.column("label"), pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"]
                )

    return run


def _vectors(vectors: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """(vec_id, label, v) of the vectors that take part, and their length."""
    v = F.col("v")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    lead = rows.where(F.size(v) % parts == 0).agg(F.min(F.struct(F.col("vec_id").isNull(), "vec_id", F.size(v).alias("width"))).alias("lead")).first()
    width = lead.lead.width if lead.lead else parts
    return rows.where(F.size(v) == width), width


def train(rows: DataFrame, width: int, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, part width): the first vectors' parts, moved to the means of what they attract."""
    first = rows.where("vec_id is not null").orderBy("vec_id", "v").limit(entries).select("v").toArrow()
    books = integers(first.column("v").combine_chunks(), width, scale, parts).transpose(1, 0, 2).copy()
    each = width // parts
    for _ in range(rounds if books.size else 0):
        found = rows.select("v").mapInArrow(_sums(books, width, scale), "slot int, n long, sums array<long>")
        total = found.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(each)])
        books = books.copy()
        # one row for each entry of each part
        for slot, n, *sums in total.collect():
            books[slot // books.shape[1], slot % books.shape[1]] = [s // n for s in sums]
    return books


def compress(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row for each vector that takes part: vec_id, code, error, label_error, codebooks_sha256.

    Takes columns vec_id, embedding and label; others play no part. Left out are vectors that are null or empty, hold null
    or non-finite components, or are not as long as that of the smallest vec_id whose length ``parts`` divides. Rows
    without vec_id come last: they are coded but give no first entry; repeated ids come in the order of their components.
    With fewer vectors than ``entries`` the codebooks are as short; if no vector has a vec_id, nothing can be coded and
    no row comes back. Null labels count as equal. Components of ten thousand times the size of a usual embedding's raise
    an error, as distances would no longer fit 64-bit integers.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes of two digits name 1 to 256 entries")
    rows, width = _vectors(vectors, parts)
    books = train(rows, width, scale, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    label = dict(rows.dtypes)["label"]
    schema = f"vec_id long, label {label}, code string, error long"
    coded = cut_lineage(rows.where(F.lit(bool(books.size))).mapInArrow(_codes(books, width, scale), schema))
    # errors of a label are added up before anything is shuffled, so a label of half the rows is one row of a task
    total = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(total, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_code_compression(spark, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


_ROUND = """
near{i} as materialized (
  select vec_id, label, part, any_value(x) as x, min(d * 64 + k) as m
  from (select vec_id, label, p.part, k, x, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) as d from p join book{i} b on b.part = p.part)
  group by vec_id, label, part),
"""
_MOVE = """
mean{i} as materialized (
  select part, k, list(s order by i) as c
  from (select part, m % 64 as k, i, floor(sum(x[i])::double / count(*))::bigint as s from near{i}, unnest(range(1, len(x) + 1)) as t(i) group by all) group by part, k),
book{next} as materialized (select b.part, b.k, coalesce(mean{i}.c, b.c) as c from book{i} b left join mean{i} using (part, k)),
"""
OP11_SQL = (
    """
with v as materialized (
  select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select vec_id, label, j as part, e[j * (len(e) // 16) + 1:(j + 1) * (len(e) // 16)] as x from v, range(16) as t(j)),
book0 as materialized (select part, k, x as c from (select part, x, row_number() over (partition by part order by vec_id) - 1 as k from p) where k < 64),
"""
    + "".join(_ROUND.format(i=i) + _MOVE.format(i=i, next=i + 1) for i in range(ROUNDS))
    + _ROUND.format(i=ROUNDS)
    + f"""
coded as (
  select vec_id, label, string_agg(printf('%02x', (m % 64)::int), '' order by part) as code, sum(m // 64)::bigint as error from near{ROUNDS} group by vec_id, label),
total as (select label, sum(error)::bigint as label_error from coded group by label),
digest as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, k)) as codebooks_sha256 from book{ROUNDS})
select vec_id, code, error, label_error, codebooks_sha256 from coded join total on coded.label is not distinct from total.label, digest
"""
)
