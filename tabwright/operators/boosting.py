"""Gradient boosting on histograms, with Newton leaves.

Features are cut into bins once, at exact quantiles. A tree needs one pass over the rows for each generation of its
nodes: rows find their node by an expression over their bins, and one ``groupBy(node, feature, bin)`` adds up gradients
and curvatures. Spark combines these in the map tasks, so what is shuffled and what the driver sees is bounded by nodes x
features x bins, whatever the rows. Of two sibling nodes only the smaller is counted, the other is what its parent has
left. Gradients are added up as integers, so sums, and with them all splits, do not depend on the order of the rows.

Trees grow by the best leaf first until ``max_leaves``; the passes work ahead on all leaves that can still be chosen,
which gives the same tree as one leaf at a time. ``symmetric`` trees have one split for a whole generation.
"""

from __future__ import annotations

import heapq
import json
import math
import random
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.operators import layout, order_stats
from tabwright.operators.tree_columns import Tree, number, total_sql, tree_sql
from tabwright.session import cut_lineage

BINS = 64
#: Trees whose scores are computed from the bins before the margins are written anew.
CUT_EVERY = 8
#: Gradients are added up in units of 2**-24 of their scale.
UNIT = float(1 << 24)


@dataclass
class Node:
    """A node under growth: its histogram (features, bins, 3) of gradient, curvature and rows, and its best split."""

    depth: int
    sums: np.ndarray
    score: float = -math.inf
    feature: int = -1
    bin: int = -1
    number: int = 0
    children: tuple[Node, Node] | None = None
    taken: bool = False

    @property
    def total(self) -> np.ndarray:
        return self.sums[0].sum(0)


@dataclass(frozen=True)
class Booster:
    """``fit(df)`` on ``features`` and ``label``; classes are 0, 1, ... as doubles."""

    trees: int = 100
    rate: float = 0.1
    max_depth: int = 6
    max_leaves: int | None = None
    l2: float = 1.0
    least_rows: int = 1
    least_curvature: float = 1e-3
    row_share: float = 1.0
    feature_share: float = 1.0
    symmetric: bool = False
    noise: float = 0.0
    classes: int = 0
    categories: tuple[int, ...] = ()
    bins: int = BINS
    seed: int = 42

    def fit(self, df: DataFrame) -> BoostedModel:
        source = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))
        first = source.first()
        if first is None:
            raise ValueError("no training rows")
        width = len(first["x"])
        source = cut_lineage(source.withColumn("row", F.xxhash64(F.monotonically_increasing_id(), F.lit(self.seed))))
        books = {}
        for i in sorted(set(self.categories)):
            source, books[i] = ordered_statistics(source, i)
        # adding zero makes -0.0 and 0.0 one value
        values = source.select("label", "row", *[(F.col("x")[i] + F.lit(0.0)).alias(f"x{i}") for i in range(width)])
        borders = quantile_borders(values, [f"x{i}" for i in range(width)], self.bins)
        base, scale = self._start(values)
        margin = F.array(*map(F.lit, base)).alias("margin")
        if self.row_share < 1:
            # rows are drawn one by one
            rows = cut_lineage(binned(values, borders, "label", F.lit(1).cast("long").alias("n"), margin, "row"))
        else:
            rows = merged(binned(values, borders, "label", margin), ["bins", "label", "margin"])
        forests: list[list[Tree]] = [[] for _ in base]
        fresh: list[list[Tree]] = [[] for _ in base]
        for t in range(self.trees):
            rng = random.Random(f"{self.seed}-{t}")
            chosen = sorted(rng.sample(range(width), max(1, round(self.feature_share * width))))
            grown = [self._tree(rows, k, fresh, borders, chosen, scale, t, rng) for k in range(len(base))]
            if all(tree.feature < 0 and abs(tree.value) < 1e-12 for tree, _ in grown):
                break
            for k, (tree, by_bin) in enumerate(grown):
                forests[k].append(tree)
                fresh[k].append(by_bin)
            if len(fresh[0]) == CUT_EVERY:
                rows = cut_lineage(rows.withColumn("margin", self._margins(fresh)))
                fresh = [[] for _ in base]
        return BoostedModel(forests, base, self.classes, width, books)

    def _start(self, values: DataFrame) -> tuple[list[float], float]:
        """Constant margins to begin with, and the scale of gradients."""
        if not self.classes:
            row = values.agg(F.avg("label"), F.min("label"), F.max("label")).first()
            return [row[0]], max(row[2] - row[1], 1e-300)
        n = {r[0]: r[1] for r in values.groupBy("label").count().collect()}  # one row for each class
        total = sum(n.values())
        if self.classes <= 2:
            share = min(max(n.get(1.0, 0) / total, 1e-9), 1 - 1e-9)
            return [math.log(share / (1 - share))], 1.0
        return [math.log(max(n.get(float(k), 0), 1e-9) / total) for k in range(self.classes)], 1.0

    def _margins(self, fresh: list[list[Tree]]) -> Column:
        parts = []
        for k, trees in enumerate(fresh):
            steps = [tree_sql(t, lambda i: f"bins[{i}]") for t in trees]
            parts.append(f"margin[{k}] + {total_sql(steps)}" if steps else f"margin[{k}]")
        return F.expr(f"array({', '.join(parts)})")

    def _gradients(self, k: int) -> tuple[Column, Column]:
        """Of the loss of margin ``m``: logistic, softmax or half the squared error."""
        m = F.col("m")
        if not self.classes:
            return m[0] - F.col("label"), F.lit(1.0)
        if self.classes <= 2:
            p = 1 / (1 + F.exp(-m[0]))
            return p - F.col("label"), p * (1 - p)
        top = F.array_max(m)
        p = F.exp(m[k] - top) / F.aggregate(m, F.lit(0.0), lambda a, x: a + F.exp(x - top))
        return p - (F.col("label") == float(k)).cast("double"), p * (1 - p)

    def _tree(self, rows: DataFrame, k: int, fresh: list[list[Tree]], borders: list[list[float]], chosen: list[int], scale: float, t: int, rng) -> tuple[Tree, Tree]:
        """One tree, with thresholds on values and with thresholds on bins."""
        kept = rows
        if self.row_share < 1:
            share = F.pmod(F.xxhash64("row", F.lit(t)), F.lit(1 << 20))
            kept = kept.where(share < int(self.row_share * (1 << 20)))
        scored = kept.select("bins", "label", "n", self._margins(fresh).alias("m"))
        g, h = self._gradients(k)
        # curvatures of the squared error are 1, gradients as large as the labels lie apart
        size = scale if not self.classes else 1.0
        scored = scored.select("bins", "n", (F.round(g * (UNIT / size)).cast("long") * F.col("n")).alias("g"), (F.round(h * UNIT).cast("long") * F.col("n")).alias("h"))
        shape = (len(chosen), max(len(b) for b in borders) + 2, 3)

        def count(wanted: dict[int, str]) -> dict[int, np.ndarray]:
            return histograms(scored, wanted, chosen, shape)

        noise = 0.0
        if self.noise:
            noise = self.noise / (1 + t)
        grow = _Growth(self, chosen, size, noise, rng)
        root = grow.run(count)
        return grow.result(root, borders, True), grow.result(root, borders, False)


def histograms(scored: DataFrame, wanted: dict[int, str], chosen: Sequence[int], shape: tuple) -> dict[int, np.ndarray]:
    """Sums (features, bins, 3) of gradient, curvature and rows for each wanted node, by one pass.

    ``wanted`` maps a node's number to the condition on ``bins`` that leads to it.
    """
    if len(wanted) == 1 and not next(iter(wanted.values())):
        node = F.lit(next(iter(wanted)))
    else:
        node = F.expr("CASE " + " ".join(f"WHEN {cond} THEN {i}" for i, cond in wanted.items()) + " END")
    picked = F.array(*[F.col("bins")[i] for i in chosen])
    spread = scored.select(node.alias("node"), "g", "h", "n", picked.alias("picked")).where("node is not null")
    spread = spread.select("node", "g", "h", "n", F.posexplode("picked").alias("feature", "bin"))
    sums = spread.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    found = sums.toArrow()
    out = {i: np.zeros(shape) for i in wanted}
    node, feature, place, *parts = (found.column(c).to_numpy() for c in ("node", "feature", "bin", "g", "h", "n"))
    for i, part in out.items():
        mine = node == i
        part[feature[mine], place[mine]] = np.stack([p[mine] for p in parts], 1)
    return out


class _Growth:
    """Chooses the splits of one tree from histograms; all of it is small and on the driver."""

    def __init__(self, booster: Booster, chosen: list[int], size: float, noise: float, rng: random.Random):
        self.b, self.chosen, self.size, self.noise, self.rng = booster, chosen, size, noise, rng
        self.count = 0
        #: the conditions that lead to each node
        self.paths: dict[int, list[str]] = {}

    def node(self, depth: int, sums: np.ndarray, path: list[str]) -> Node:
        out = Node(depth, sums, number=self.count)
        self.paths[self.count] = path
        self.count += 1
        return out

    def gains(self, sums: np.ndarray) -> np.ndarray:
        """What each split (feature, bin) saves; rows up to the bin go left. Splits that leave too little are -inf."""
        total = sums.sum(1, keepdims=True)
        left = np.cumsum(sums, 1)
        right = total - left
        unit = np.array([self.size / UNIT, 1 / UNIT, 1.0])
        (gl, hl, nl), (gr, hr, nr), (g, h, _) = (np.moveaxis(x * unit, -1, 0) for x in (left, right, total))
        ok = (np.minimum(nl, nr) >= self.b.least_rows) & (np.minimum(hl, hr) >= self.b.least_curvature)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = gl**2 / (hl + self.b.l2) + gr**2 / (hr + self.b.l2) - g**2 / (h + self.b.l2)
        return np.where(ok, gain, -np.inf)

    def shaken(self, gains: np.ndarray, node: Node) -> np.ndarray:
        """Random additions to the scores of splits, as large as ``noise`` root mean square gradients."""
        if not self.noise:
            return gains
        # the curvature of a logistic loss is the expected square of its gradient
        _, h, n = node.total * [1, 1 / UNIT, 1]
        spread = self.noise * math.sqrt(h / max(n, 1.0))
        draws = np.random.default_rng(self.rng.getrandbits(32)).normal(0, spread, gains.shape)
        return gains + draws

    def best(self, node: Node) -> None:
        if node.depth >= self.b.max_depth:
            return
        gains = self.gains(node.sums)
        gains = np.where(gains > 1e-9, self.shaken(gains, node), -np.inf)
        at = int(gains.argmax())
        if np.isfinite(gains.flat[at]):
            node.feature, node.bin = divmod(at, gains.shape[1])
            node.score = float(gains.flat[at])

    def open(self, nodes: list[Node], count) -> None:
        """Give nodes with a split their children; only the smaller of two is counted."""
        wanted, small = {}, {}
        for node in nodes:
            left = node.sums[node.feature, : node.bin + 1, 2].sum()
            lower = left <= node.sums[node.feature, :, 2].sum() - left
            column = f"bins[{self.chosen[node.feature]}]"
            sides = [[*self.paths[node.number], f"{column} {sign} {node.bin}"] for sign in ("<=", ">")]
            small[node.number] = (lower, sides)
            wanted[node.number] = " AND ".join(sides[0 if lower else 1])
        found = count(wanted)
        for node in nodes:
            lower, sides = small[node.number]
            one = found[node.number]
            pair = (one, node.sums - one) if lower else (node.sums - one, one)
            node.children = tuple(self.node(node.depth + 1, s, p) for s, p in zip(pair, sides, strict=True))

    def run(self, count) -> Node:
        root = self.node(0, count({0: ""})[0], [])
        return self._symmetric(root, count) if self.b.symmetric else self._best_first(root, count)

    def _best_first(self, root: Node, count) -> Node:
        most = self.b.max_leaves or 1 << min(self.b.max_depth, 30)
        self.best(root)
        while True:
            # play the choice through; a leaf whose children are not known yet is taken as if they were never chosen
            queue, chosen, ahead = [(-root.score, root.number, root)], [], []
            while queue and len(chosen) < most - 1 and queue[0][2].feature >= 0:
                node = heapq.heappop(queue)[2]
                chosen.append(node)
                for child in node.children or ():
                    heapq.heappush(queue, (-child.score, child.number, child))
                if node.children is None:
                    ahead.append(node)
            if not ahead:
                for node in chosen:
                    node.taken = True
                return root
            # unknown children could only take the places of others, so no other leaf's children can be needed
            self.open(ahead, count)
            for node in ahead:
                for child in node.children:
                    self.best(child)

    def _symmetric(self, root: Node, count) -> Node:
        level = [root]
        for _ in range(self.b.max_depth):
            # a node that a split would leave empty on one side adds nothing and forbids nothing
            gains = sum(np.where(np.isfinite(g := self.gains(n.sums)), g, 0.0) for n in level)
            useful = np.any([np.isfinite(self.gains(n.sums)) for n in level], axis=0)
            gains = np.where(useful & (gains > 1e-9), self.shaken(gains, root), -np.inf)
            at = int(gains.argmax())
            if not np.isfinite(gains.flat[at]):
                break
            for node in level:
                node.feature, node.bin = divmod(at, gains.shape[1])
                node.taken = True
            self.open(level, count)
            level = [child for node in level for child in node.children]
        return root

    def result(self, node: Node, borders: list[list[float]], values: bool) -> Tree:
        g, h, n = node.total * [self.size / UNIT, 1 / UNIT, 1.0]
        if not node.taken:
            return Tree(float(-self.b.rate * g / (h + self.b.l2)) if n and h + self.b.l2 > 0 else 0.0, rows=float(n))
        feature = self.chosen[node.feature]
        left, right = (self.result(child, borders, values) for child in node.children)
        if not values:
            return Tree(0.0, feature, node.bin, True, left, right)
        cuts = borders[feature]
        # beyond the last border only missing values lie
        threshold = cuts[node.bin] if node.bin < len(cuts) else math.inf
        return Tree(0.0, feature, threshold, node.bin >= len(cuts), left, right, max(node.score, 0.0), float(n))


def quantile_borders(values: DataFrame, columns: list[str], bins: int = BINS) -> list[list[float]]:
    """Ascending borders for each column, at most ``bins`` - 1: all values of a column with few, else exact quantiles."""
    few = values.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    small = [c for c in columns if few[c] <= bins]
    found: dict[str, list[float]] = {}
    if small:
        # at most a little more than ``bins`` values of each
        row = values.agg(*[F.sort_array(F.collect_set(F.when(~F.isnan(c), F.col(c)))).alias(c) for c in small]).first()
        found = {c: row[c] for c in small}
    large = [c for c in columns if c not in found or len(found[c]) > bins]
    if large:
        clean = values.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in large])
        ranks = lambda n: sorted({n * i // bins for i in range(bins)}) if n else []
        stats = order_stats.order_statistics(clean, dict.fromkeys(large, ranks))
        for c in large:
            found[c] = sorted(set(stats[c][1].values()))
    # the lowest value is no border: nothing lies below it
    return [[float(v) for v in found[c][1:]] for c in columns]


def binned(values: DataFrame, borders: list[list[float]], *rest: str | Column) -> DataFrame:
    """``bins``, the bin numbers of columns x0, x1, ..., beside the columns ``rest``; missing values have the last bin."""
    cut = [i for i, b in enumerate(borders) if b]
    if cut:
        splits = [[-math.inf, *borders[i], math.inf] for i in cut]
        names = [f"x{i}" for i in cut]
        values = Bucketizer(splitsArray=splits, inputCols=names, outputCols=[f"b{i}" for i in cut], handleInvalid="keep").transform(values)
    bins = [F.col(f"b{i}").cast("int") if borders[i] else F.lit(0) for i in range(len(borders))]
    return values.select(F.array(*bins).alias("bins"), *rest)


def merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` written once, with ``n``: rows that are equal in ``keys`` are one with their number, where that halves them.

    A model on bins cannot tell such rows apart, so passes over few columns read the cells that occur, not the rows.
    """
    rows = cut_lineage(rows)
    seen = rows.agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64(*keys)).alias("cells")).first()
    if 2 * seen.cells > seen.n:
        return rows.withColumn("n", F.lit(1).cast("long"))
    return cut_lineage(rows.groupBy(*keys).agg(F.count("*").alias("n")))


@dataclass
class Means:
    """Mean label by category number, and what an unknown category gets."""

    table: DataFrame
    prior: float


def ordered_statistics(source: DataFrame, feature: int, weight: float = 1.0) -> tuple[DataFrame, Means]:
    """Replace a category number by the mean label of the rows before it, in a random order, of the same category.

    So no row sees its own label. ``weight`` rows of the overall mean are added to each category. The second table has
    the mean over all rows of each category, which is what new rows get. Above two classes the label is the class number.
    """
    prior = float(source.agg(F.avg("label")).first()[0])
    keyed = source.withColumn("category", F.col("x")[feature]).withColumn("one", F.lit(1.0))
    keyed = layout.running_sums(keyed, {"label_sum": "label", "label_rows": "one"}, ["row"], ["category"])
    before = (F.col("label_sum") - F.col("label") + weight * prior) / (F.col("label_rows") - 1 + weight)
    size = F.size("x")
    x = F.concat(F.slice("x", 1, feature), F.array(before), F.slice("x", F.lit(feature + 2), F.greatest(size - feature - 1, F.lit(0))))
    out = cut_lineage(keyed.select(x.alias("x"), "label", "row"))
    book = source.groupBy(F.col("x")[feature].alias("category")).agg(((F.sum("label") + weight * prior) / (F.count("*") + weight)).alias("mean"))
    return out, Means(cut_lineage(book), prior)


@dataclass
class BoostedModel:
    """Scores in one projection; ``books`` are tables of category means, joined by size."""

    forests: list[list[Tree]]
    base: list[float]
    classes: int
    width: int
    books: dict[int, Means] = field(default_factory=dict)

    def margins_sql(self, column, dialect: str = "spark") -> list[str]:
        return [
            total_sql([number(b, dialect), *[tree_sql(t, column, dialect) for t in trees]]) for b, trees in zip(self.base, self.forests, strict=True)
        ]

    def transform(self, df: DataFrame) -> DataFrame:
        names = [c for c in df.columns if c not in ("prediction", "rawPrediction", "probability")]
        out = df.select(*names, vector_to_array("features").alias("__x"))
        for i, book in self.books.items():
            mean = book.table.select(F.col("category").alias("__category"), F.col("mean").alias("__mean"))
            out = out.join(mean, out["__x"][i] == F.col("__category"), "left")
            known = F.coalesce("__mean", F.lit(book.prior))
            rest = F.slice("__x", F.lit(i + 2), F.lit(max(self.width - i - 1, 0)))
            out = out.withColumn("__x", F.concat(F.slice("__x", 1, i), F.array(known), rest)).drop("__category", "__mean")
        out = out.withColumn("__m", F.expr(f"array({', '.join(self.margins_sql(lambda i: f'__x[{i}]'))})"))
        m = F.col("__m")
        if not self.classes:
            return out.withColumn("prediction", m[0]).select(*names, "prediction")
        if self.classes <= 2:
            p = 1 / (1 + F.exp(-m[0]))
            raw, probability = F.array(-m[0], m[0]), F.array(1 - p, p)
        else:
            e = F.transform(m, lambda x: F.exp(x - F.array_max(m)))
            raw, probability = m, F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))
        out = out.select(*names, raw.alias("__raw"), probability.alias("__p"))
        decided = (F.array_position("__raw", F.array_max("__raw")) - 1).cast("double")
        return out.select(*names, array_to_vector("__raw").alias("rawPrediction"), array_to_vector("__p").alias("probability"), decided.alias("prediction"))

    @property
    def featureImportances(self):
        gains = np.zeros(self.width)
        for trees in self.forests:
            for tree in trees:
                for split in tree.splits():
                    gains[split.feature] += split.gain
        return Vectors.dense(gains / (gains.sum() or 1.0))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        meta = {
            "base": self.base, "classes": self.classes, "width": self.width, "books": {i: b.prior for i, b in self.books.items()},
            "forests": [[t.record() for t in trees] for trees in self.forests],
        }
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        for i, book in self.books.items():
            book.table.write.mode("overwrite").parquet(f"{path}/book-{i}")

    @staticmethod
    def load(spark, path: str) -> BoostedModel:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        forests = [[Tree.read(r) for r in trees] for trees in meta["forests"]]
        books = {int(i): Means(spark.read.parquet(f"{path}/book-{i}"), prior) for i, prior in meta["books"].items()}
        return BoostedModel(forests, meta["base"], meta["classes"], meta["width"], books)
