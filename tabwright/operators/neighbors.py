"""Nearest neighbours without comparing every pair: exact ones by cells, and for many columns by hashed buckets.

Training rows are assigned to the nearest of a bounded set of pivot points. For a query row the
pivots and the k smallest pivot distances of each cell give an upper bound on its k-th
neighbour (triangle inequality), so only cells that can hold a closer row are visited. Cells and
their queries are cut into blocks of limited size; a block returns at most k rows per query
and a rank filter merges the blocks. Equal training points are reduced to the k lowest keys first,
because no further copy can be among the k nearest.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.operators.features import hash_text
from tabwright.session import cut_lineage

#: Rows of a cell, about: what a query is compared with in each cell that it visits, however large the table is.
CELL_ROWS = 500
BLOCK_ROWS = 20_000
ASSIGN_ROWS = 1000
#: Queries that are routed together, and routed rows that leave a task at once.
ROUTE_ROWS, ROUTED_ROWS = 512, 20_000
MIN_PIVOTS, MAX_PIVOTS = 8, 4096
#: Hashed search: tables, buckets visited in each, rows of a bucket, planes of a table and rows of the sample at most.
TABLES, PROBES, BUCKET_ROWS, MAX_BITS, SAMPLE_ROWS = 6, 8, 2000, 40, 4096

# functions of this module go to the workers by value: they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _vector(columns: Sequence[str]):
    # adding zero makes -0.0 and 0.0 one point
    return F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in columns])


def nearest(
    queries: DataFrame,
    train: DataFrame,
    columns: Sequence[str],
    k: int,
    query_key: str,
    train_key: str,
    payload: str,
    block_rows: int = BLOCK_ROWS,
    pivots: int | None = None,
) -> DataFrame:
    """(query_id, train_id, payload, distance): the k nearest by distance, lower key first on ties."""
    key_kind = train.schema[train_key].dataType.simpleString()
    query_kind = queries.schema[query_key].dataType.simpleString()
    load_kind = train.schema[payload].dataType.simpleString()
    points = train.select(F.col(train_key).alias("train_id"), F.col(payload).alias("payload"), _vector(columns).alias("v"))
    same = Window.partitionBy("v").orderBy("train_id")
    points = points.withColumn("r", F.row_number().over(same)).filter(F.col("r") <= k).drop("r")
    points = cut_lineage(points)
    total = points.count()
    if not total:
        raise ValueError("no training rows")
    wanted = pivots or max(MIN_PIVOTS, min(MAX_PIVOTS, total // CELL_ROWS))
    picked = points.select("v", hash_text(["train_id"]).alias("h")).orderBy("h").limit(wanted).collect()
    centers = np.unique(np.array([r["v"] for r in picked], dtype=float), axis=0)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # as many rows at once as keep the distances to all pivots small
            for at in range(0, len(pdf), ASSIGN_ROWS):
                some = pdf.iloc[at : at + ASSIGN_ROWS]
                d = _distances(np.stack(some["v"].to_numpy()), centers)
                cell = d.argmin(axis=1)
                yield some.assign(cell=cell.astype("int32"), d=d[np.arange(len(some)), cell])

    cells = cut_lineage(
        points.mapInPandas(assign, f"train_id {key_kind}, payload {load_kind}, v array<double>, cell int, d double")
    )
    w = Window.partitionBy("cell").orderBy("d", "train_id")
    near = cells.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    near = near.groupBy("cell").agg(F.array_sort(F.collect_list("d")).alias("near"))
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius"))
    # one row per pivot with at most k numbers
    summary = {r["cell"]: r for r in sizes.join(near, "cell").collect()}
    filled = np.array(sorted(summary))
    radius = np.array([summary[c]["radius"] for c in filled])
    bounds = np.full((len(filled), k), np.inf)
    for i, c in enumerate(filled):
        values = summary[c]["near"]
        bounds[i, : len(values)] = values
    own = centers[filled]
    blocks = {int(c): -(-summary[c]["n"] // block_rows) for c in filled}

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # any set of cells gives a valid bound once it holds k rows; else all cells are used
        probe = min(len(own), 8)
        if np.sort(np.isfinite(bounds).sum(axis=1))[:probe].sum() < k:
            probe = len(own)
        for pdf in batches:
            for lo in range(0, len(pdf), ROUTE_ROWS):
                part = pdf.iloc[lo : lo + ROUTE_ROWS]
                d = _distances(np.stack(part["v"].to_numpy()), own)
                first = np.argpartition(d, probe - 1, axis=1)[:, :probe]
                reach = (np.take_along_axis(d, first, 1)[:, :, None] + bounds[first]).reshape(len(part), -1)
                limit = np.partition(reach, k - 1, axis=1)[:, k - 1] if reach.shape[1] >= k else np.full(len(part), np.inf)
                limit = limit * (1 + 1e-9) + 1e-12
                row, cell = np.nonzero(d - radius[None, :] <= limit[:, None])
                for at in range(0, len(row), ROUTED_ROWS):
                    some, to = row[at : at + ROUTED_ROWS], cell[at : at + ROUTED_ROWS]
                    hit = part.iloc[some]
                    yield pd.DataFrame(
                        {
                            "query_id": hit["query_id"].to_numpy(),
                            "v": hit["v"].to_numpy(),
                            "cell": filled[to].astype("int32"),
                            "most": limit[some],
                        }
                    )

    routed = queries.select(F.col(query_key).alias("query_id"), _vector(columns).alias("v")).mapInPandas(
        route, f"query_id {query_kind}, v array<double>, cell int, most double"
    )
    routed = cut_lineage(routed)
    # one row per pivot
    asked = {r["cell"]: -(-r["n"] // block_rows) for r in routed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = [(c, int(blocks[c]), int(asked.get(c, 1))) for c in blocks]
    grid = F.broadcast(queries.sparkSession.createDataFrame(rows, "cell int, train_blocks int, query_blocks int"))
    left = routed.join(grid, "cell").select(
        "*", F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int").alias("qb")
    )
    left = left.select("query_id", "v", "most", "cell", "qb", F.explode(F.sequence(F.lit(0), F.col("train_blocks") - 1)).alias("tb"))
    right = cells.join(grid, "cell").select(
        "*", F.pmod(F.xxhash64("train_id"), F.col("train_blocks")).cast("int").alias("tb")
    )
    right = right.select("train_id", "payload", "v", "cell", "tb", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("qb"))

    def compare(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "train_id": [], "payload": [], "distance": []})
        if not len(q) or not len(t):
            return empty
        t = t.sort_values("train_id")
        points, ids, loads = np.stack(t["v"].to_numpy()), t["train_id"].to_numpy(), t["payload"].to_numpy()
        out = []
        for lo in range(0, len(q), 256):
            part = q.iloc[lo : lo + 256]
            d = _distances(np.stack(part["v"].to_numpy()), points)
            d[d > part["most"].to_numpy()[:, None]] = np.inf
            row, flat = _closest(d, k)
            out.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[row], "train_id": ids[flat], "payload": loads[flat], "distance": d[row, flat]}))
        return pd.concat(out) if out else empty

    found = (
        left.groupBy("cell", "qb", "tb")
        .cogroup(right.groupBy("cell", "qb", "tb"))
        .applyInPandas(compare, f"query_id {query_kind}, train_id {key_kind}, payload {load_kind}, distance double")
    )
    best = Window.partitionBy("query_id").orderBy("distance", "train_id")
    return found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).drop("r")


def nearest_hashed(
    queries: DataFrame,
    train: DataFrame,
    columns: Sequence[str],
    k: int,
    query_key: str,
    train_key: str,
    payload: str,
    tables: int = TABLES,
    probes: int = PROBES,
    bucket_rows: int = BUCKET_ROWS,
    block_rows: int = BLOCK_ROWS,
    seed: int = 42,
) -> DataFrame:
    """The same columns as ``nearest`` for many columns, where no bound rules cells out: most of the k nearest, not surely all.

    In each of ``tables`` tables a row's bucket is the sides of random planes on which it lies; the planes of a table are
    as many as leave about ``bucket_rows`` rows in a bucket, and each parts a bounded sample of ``SAMPLE_ROWS`` rows in
    halves. All rows are indexed. A query visits ``probes`` buckets of a table: its own and those across the planes that
    it is closest to. Distances inside a bucket are exact, and so is their order. A query for which the buckets hold fewer
    than k rows goes through ``nearest``.
    """
    key_kind = train.schema[train_key].dataType.simpleString()
    query_kind = queries.schema[query_key].dataType.simpleString()
    load_kind = train.schema[payload].dataType.simpleString()
    points = train.select(F.col(train_key).alias("train_id"), F.col(payload).alias("payload"), _vector(columns).alias("v"))
    same = Window.partitionBy("v").orderBy("train_id")
    points = cut_lineage(points.withColumn("r", F.row_number().over(same)).filter(F.col("r") <= k).drop("r"))
    total = points.count()
    if not total:
        raise ValueError("no training rows")
    bits = min(MAX_BITS, max(0, (total // bucket_rows).bit_length() - 1))
    sample = points.select("v", hash_text(["train_id"], seed).alias("h")).orderBy("h").limit(SAMPLE_ROWS).toArrow()
    sample = np.array(sample.column("v").to_pylist(), dtype=float)
    rng = np.random.default_rng(seed)
    planes = rng.normal(size=(tables, bits, len(columns)))
    middle = np.median(np.einsum("nd,tbd->ntb", sample, planes), axis=0)
    flips = _flip_sets(bits, probes)

    def sides(part: np.ndarray) -> np.ndarray:
        """Distances from the planes, (rows, tables, bits)."""
        return np.einsum("nd,tbd->ntb", part, planes) - middle

    weight = 1 << np.arange(bits, dtype=np.int64)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), ASSIGN_ROWS):
                part = pdf.iloc[lo : lo + ASSIGN_ROWS]
                code = ((sides(np.stack(part["v"].to_numpy())) > 0) * weight).sum(2)
                for t in range(tables):
                    yield part.assign(slot=np.int32(t), bucket=code[:, t])

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), ASSIGN_ROWS):
                part = pdf.iloc[lo : lo + ASSIGN_ROWS]
                d = sides(np.stack(part["v"].to_numpy()))
                code = ((d > 0) * weight).sum(2)
                # planes from the closest to the farthest; a set of them costs the sum of its squared distances
                order = np.argsort(np.abs(d), axis=2, kind="stable")
                cost = np.take_along_axis(d, order, 2) ** 2
                for t in range(tables):
                    price = cost[:, t] @ flips.T
                    best = np.argsort(price, axis=1, kind="stable")[:, :probes]
                    turned = (flips[best] * weight[order[:, t]][:, None, :]).sum(2).astype(np.int64)
                    for j in range(best.shape[1]):
                        yield part.assign(slot=np.int32(t), bucket=code[:, t] ^ turned[:, j])

    asked = cut_lineage(queries.select(F.col(query_key).alias("query_id"), _vector(columns).alias("v")))
    held = points.mapInPandas(index, f"train_id {key_kind}, payload {load_kind}, v array<double>, slot int, bucket long")
    held = cut_lineage(held)
    routed = cut_lineage(asked.mapInPandas(probe, f"query_id {query_kind}, v array<double>, slot int, bucket long"))
    on = ["slot", "bucket"]
    # buckets and their queries are cut into blocks, so that a full bucket is many small tasks
    size = held.groupBy(*on).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("train_blocks"))
    want = routed.groupBy(*on).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("query_blocks"))
    grid = cut_lineage(size.join(want, on))
    left = routed.join(grid, on).withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int"))
    left = left.select("query_id", "v", *on, "qb", F.explode(F.sequence(F.lit(0), F.col("train_blocks") - 1)).alias("tb"))
    right = held.join(grid, on).withColumn("tb", F.pmod(F.xxhash64("train_id"), F.col("train_blocks")).cast("int"))
    right = right.select("train_id", "payload", "v", *on, "tb", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("qb"))

    def compare(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(t):
            return pd.DataFrame({"query_id": [], "train_id": [], "payload": [], "distance": []})
        t = t.sort_values("train_id")
        points, ids, loads = np.stack(t["v"].to_numpy()), t["train_id"].to_numpy(), t["payload"].to_numpy()
        out = []
        for lo in range(0, len(q), 256):
            part = q.iloc[lo : lo + 256]
            d = _distances(np.stack(part["v"].to_numpy()), points)
            row, flat = _closest(d, k, finite=False)
            out.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[row], "train_id": ids[flat], "payload": loads[flat], "distance": d[row, flat]}))
        return pd.concat(out)

    by = [*on, "qb", "tb"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(compare, f"query_id {query_kind}, train_id {key_kind}, payload {load_kind}, distance double")
    # several tables can find the same row
    found = found.dropDuplicates(["query_id", "train_id"])
    best = Window.partitionBy("query_id").orderBy("distance", "train_id")
    found = cut_lineage(found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).drop("r"))
    enough = found.groupBy("query_id").count().filter(F.col("count") >= min(k, total)).select("query_id")
    few = cut_lineage(asked.join(enough, "query_id", "left_anti"))
    if few.isEmpty():
        return found
    rest = few.select("query_id", *[F.col("v")[i].alias(f"v{i}") for i in range(len(columns))])
    stock = points.select("train_id", "payload", *[F.col("v")[i].alias(f"v{i}") for i in range(len(columns))])
    exact = nearest(rest, stock, [f"v{i}" for i in range(len(columns))], k, "query_id", "train_id", "payload", block_rows)
    return found.join(few.select("query_id"), "query_id", "left_anti").unionByName(exact)


def _flip_sets(bits: int, probes: int) -> np.ndarray:
    """Sets of planes to cross, as rows of 0 and 1 over the planes in order of closeness: all sets of the closest few."""
    near = min(bits, max(1, probes).bit_length() + 4)
    sets = (np.arange(1 << near)[:, None] >> np.arange(near)) & 1
    out = np.zeros((len(sets), bits))
    out[:, :near] = sets
    return out


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the true (query_id, train_id) pairs that were found."""
    true = exact.select("query_id", "train_id")
    hit = true.join(found.select("query_id", "train_id"), ["query_id", "train_id"], "left_semi").count()
    return hit / (true.count() or 1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, column by column so that no cancellation hides equal points."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        diff = a[:, j][:, None] - b[:, j][None, :]
        total += diff * diff
    return np.sqrt(total)


def _closest(d: np.ndarray, k: int, finite: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k smallest entries of each row, in order, the lower column first of equal ones.

    Only finite ones, or all with those that are no numbers last.
    """
    value = np.where(np.isnan(d), np.inf, d)
    last = np.partition(value, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.full((len(d), 1), np.inf)
    near = value <= last
    row, column = np.nonzero(near & np.isfinite(value) if finite else near)
    order = np.lexsort((column, np.isnan(d[row, column]), value[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], column[keep]


def _weights(df: DataFrame, weights: str) -> DataFrame:
    if weights == "uniform":
        return df.withColumn("w", F.lit(1.0))
    if weights != "distance":
        raise ValueError("weights must be 'uniform' or 'distance'")
    # a query on top of training rows is decided by those rows alone
    closest = F.min("distance").over(Window.partitionBy("query_id"))
    exact = F.when(F.col("distance") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return df.withColumn("w", F.when(closest == 0, exact).otherwise(F.try_divide(F.lit(1.0), F.col("distance"))))


def knn_classify(neighbours: DataFrame, weights: str = "uniform") -> DataFrame:
    """The class with the largest vote, the lowest class on ties."""
    votes = _weights(neighbours, weights).groupBy("query_id", "payload").agg(F.sum("w").alias("vote"))
    best = votes.groupBy("query_id").agg(F.min(F.struct((-F.col("vote")).alias("v"), F.col("payload").alias("c"))).alias("b"))
    return best.select("query_id", F.col("b.c").alias("prediction"))


def knn_regress(neighbours: DataFrame, weights: str = "uniform") -> DataFrame:
    weighted = _weights(neighbours, weights)
    value = F.sum(F.col("payload") * F.col("w")) / F.sum("w")
    return weighted.groupBy("query_id").agg(value.alias("prediction"))
