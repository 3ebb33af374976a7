"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Unit vectors are rounded to int8 with one scale each, and the length of what rounding took away is kept. The
product of two rounded vectors then brackets their cosine, so nearly all pairs are settled on small integers and
only pairs whose bracket holds the threshold are computed in double precision.

Equal vectors are one class. Classes belong to the cell of their nearest pivot, large cells are cut into blocks,
and a class visits a cell only if the angles to its pivot allow a link with a vector in it: exact for any pivots.
A tile returns link counts and a spanning forest, never its pairs. Where the data has no clusters no cell can be
ruled out and the work is that of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import components, table
from tabwright.session import cut_lineage

THRESHOLD = 0.95
#: Classes in a block, and pivots at most (the sample of vectors that reaches the driver).
BLOCK, PIVOTS = 4096, 1024
#: Rows of a tile product at once; columns whose int8 products are exact in float32.
ROWS, EXACT = 512, 1000
#: Pairs that are looked at closely at once, and slack for single precision.
PAIRS, SINGLE = 100_000, 1e-5
#: Slack for rounding in double arithmetic.
SLACK = 1e-9


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, filled with zeros to one width, and their own widths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths())
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out, sizes


def unit(x: np.ndarray) -> np.ndarray:
    # divided by the largest component first, so that the norm neither overflows nor vanishes
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the lengths of their rounding errors."""
    scale = np.abs(u).max(1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    error = u - q * scale[:, None]
    return q, scale, np.sqrt((error * error).sum(1)) + SLACK


def linked(ux, qx, uy, qy, threshold: float) -> tuple[np.ndarray, int]:
    """Which rows of x and y have a cosine of ``threshold`` or more, and how many pairs took full precision."""
    (ix, sx, ex), (iy, sy, ey) = qx, qy
    out, exact = np.zeros((len(ux), len(uy)), bool), 0
    columns = [iy[:, c : c + EXACT].astype(np.float32).T for c in range(0, ux.shape[1], EXACT)]
    # what a product times the column's scale has to reach in a row, whatever the column; single precision gets some slack
    least = ((threshold - ex - (1 + ex) * ey.max()) / sx - SINGLE / sx).astype(np.float32)
    scale = sy.astype(np.float32)
    for at in range(0, len(ux), ROWS):
        rows = slice(at, at + ROWS)
        product = 0.0
        for c, column in enumerate(columns):
            part = ix[rows, c * EXACT : (c + 1) * EXACT].astype(np.float32) @ column
            product = part if c == 0 else product.astype(np.float64) + part
        a, b = np.nonzero(product * scale >= least[rows, None])
        for k in range(0, len(a), PAIRS):
            i, j = a[k : k + PAIRS], b[k : k + PAIRS]
            cosine = product[i, j] * sx[at + i].astype(np.float64) * sy[j]
            # |xy - x'y'| <= |x - x'| |y| + |x'| |y - y'|
            bound = ex[at + i] + (1 + ex[at + i]) * ey[j]
            sure = cosine - bound >= threshold
            out[at + i[sure], j[sure]] = True
            i, j = i[open_ := ~sure & (cosine + bound >= threshold)] + at, j[open_]
            exact += len(i)
            out[i, j] = (ux[i] * uy[j]).sum(1) >= threshold
    return out, exact


def forest(links: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns of a link matrix, the row or column (counted after the rows) that stands for their group."""
    n, m = links.shape
    x, y = np.arange(n), np.arange(m) + (0 if same else n)
    rows, columns = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
    small = links[np.ix_(rows, columns)]
    big = n + m
    while len(rows):
        low = np.minimum(x[rows], np.where(small, y[columns][None], big).min(1))
        high = np.minimum(y[columns], np.where(small, low[:, None], big).min(0))
        if (low == x[rows]).all() and (high == y[columns]).all():
            break
        x[rows], y[columns] = low, high
        if same:
            x = y = np.minimum(x, y)
    return x, y


def _place(pivots: np.ndarray, width: int):
    """Adds to each class the cell of its nearest pivot and the angle to that pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            u = unit(matrix(batch.column("v"), width)[0])
            cosine = np.clip(u @ pivots.T, -1, 1)
            cell = cosine.argmax(1)
            angle = np.arccos(cosine[np.arange(len(u)), cell])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "n", "v")), pa.array(cell.astype(np.int32)), pa.array(angle)], ["id", "n", "v", "cell", "angle"]
            )

    return run


def _visits(pivots: np.ndarray, width: int, radius: np.ndarray, blocks: np.ndarray, threshold: float):
    """Each class to the blocks of lower or equal number in which a linked vector may lie."""
    reach = radius + np.arccos(threshold) + 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            u = unit(matrix(batch.column("v"), width)[0])
            near = np.arccos(np.clip(u @ pivots.T, -1, 1)) <= reach
            own = batch.column("block").to_numpy()
            for at in range(0, len(own), 256):
                some = near[at : at + 256]
                row, target = np.nonzero(np.repeat(some, blocks, axis=1))
                lower = target < own[at + row]
                row, target = row[lower] + at, target[lower]
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(rows) for c in ("id", "n", "v")), pa.array(target.astype(np.int32)), pa.array(own[row])], ["id", "n", "v", "i", "j"]
                )

    return run


def _tile(width: int, threshold: float):
    """The classes of block i and those of block j that visit it to (id, group, links)."""

    def run(rows: pa.Table) -> pa.Table:
        home = rows.column("home").to_numpy(zero_copy_only=False).astype(bool)
        sides = []
        for flag in (home, ~home):
            part = rows.filter(pa.array(flag))
            ids, n = part.column("id").to_numpy(), part.column("n").to_numpy()
            v, sizes = matrix(part.column("v"), width)
            u = unit(v) if len(v) else v
            sides.append((ids, n, sizes, u, quantise(u) if len(u) else None))
        (ids, n, size, u, q), (ids2, n2, size2, u2, q2) = sides
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        same = i == j
        if same:
            ids2, n2, size2, u2, q2 = sides[0]
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        if not len(ids) or not len(ids2):
            return empty
        links, _ = linked(u, q, u2, q2, threshold)
        links &= size[:, None] == size2[None]
        if same:
            np.fill_diagonal(links, False)
        x, y = forest(links, same)
        count, names, group = links @ n2, ids, x
        if not same:
            count = np.concatenate([count, n @ links])
            names, group = np.concatenate([ids, ids2]), np.concatenate([x, y])
        hit = count > 0
        return pa.table({"a": pa.array(names[hit]), "b": pa.array(names[group[hit]]), "links": pa.array(count[hit].astype(np.int64))})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, most_pivots: int = PIVOTS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. Takes columns vec_id and embedding.

    Vectors that are null, empty or zero or hold null or non-finite components, and rows without vec_id, link
    with nothing; so do vectors of different lengths. Repeated rows are vectors of their own that share an id.
    """
    v = F.col("v")
    fine = F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    # the number before the vector seeds its hash, so that the two have nothing to do with each other
    marked = rows.select("vec_id", "v", F.coalesce(fine, F.lit(False)).alias("fine"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    classes = marked.where("fine").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = cut_lineage(classes)
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    width = size.width or 1
    wanted = max(1, min(most_pivots, -(-size.n // block)))
    chosen = classes.orderBy(F.xxhash64("id", F.lit("pivot")), "id").limit(wanted).select("v").toArrow()
    pivots = unit(matrix(chosen.column("v"), width)[0]) if len(chosen) else np.zeros((1, width))
    placed = cut_lineage(classes.select("id", "n", "v").mapInArrow(_place(pivots, width), "id long, n long, v array<double>, cell int, angle double"))
    # one row for each pivot
    cells = {r.cell: r for r in placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()}
    radius = np.array([cells[c].radius if c in cells else -9.0 for c in range(len(pivots))])
    blocks = np.array([-(-cells[c].n // block) if c in cells else 0 for c in range(len(pivots))])
    first = np.cumsum(blocks) - blocks
    at = F.element_at(F.array(*map(F.lit, first.tolist())), F.col("cell") + 1)
    parts = F.element_at(F.array(*map(F.lit, blocks.tolist())), F.col("cell") + 1)
    homed = placed.withColumn("block", (at + F.pmod(F.xxhash64("id"), parts)).cast("int")).select("id", "n", "v", "block")
    visits = cut_lineage(homed.mapInArrow(_visits(pivots, width, radius, blocks, threshold), "id long, n long, v array<double>, i int, j int"))
    pairs = visits.select("i", "j").distinct().unionByName(homed.select(F.col("block").alias("i"), F.col("block").alias("j")).distinct())
    hosts = homed.join(pairs, homed.block == pairs.i).select("id", "n", "v", "i", "j", F.lit(True).alias("home"))
    both = hosts.unionByName(visits.withColumn("home", F.lit(False)))
    found = cut_lineage(both.groupBy("i", "j").applyInArrow(_tile(width, threshold), "a long, b long, links long"))
    label = components(found.select("a", "b"))
    counts = found.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    known = classes.select("h1", "h2", "id", "n").join(counts, "id", "left").join(label.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("c"))
    out = marked.select("vec_id", F.when(F.col("fine"), F.col("h1")).alias("h1"), F.col("h2")).join(known, ["h1", "h2"], "left")
    component = F.coalesce("c", "vec_id")
    kept = F.coalesce(F.col("vec_id") == component, F.lit(True))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
with recursive v as materialized (select vec_id, embedding::double[] as e from embeddings),
links as materialized (select x.vec_id as a, y.vec_id as b from v x join v y on x.vec_id <> y.vec_id where list_cosine_similarity(x.e, y.e) >= 0.95),
reach(vec_id, other) as (select vec_id, vec_id from v union select reach.vec_id, b from reach join links on a = other),
n as (select a, count(*) as n from links group by a)
select v.vec_id, coalesce(max(n.n), 0) as n_links, min(other) as component_id, v.vec_id = min(other) as kept
from v join reach on v.vec_id = reach.vec_id left join n on n.a = v.vec_id group by v.vec_id
"""
