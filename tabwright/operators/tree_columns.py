"""Decision trees as column expressions: one text for Spark, and the same for another SQL engine.

A tree becomes nested ``CASE`` and an ensemble one expression over a feature array, so a model scores in a single
projection, in batch and on streams, with nothing to ship to the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

SPARK, OTHER = "spark", "other"


@dataclass
class Tree:
    """A split (``feature`` 0 or above) or a leaf. Rows below the threshold go left, with ``closed`` those at it too."""

    value: Any = 0.0
    feature: int = -1
    threshold: float = 0.0
    closed: bool = False
    left: Tree | None = None
    right: Tree | None = None
    gain: float = 0.0
    rows: float = 0.0

    def leaves(self) -> int:
        return 1 if self.feature < 0 else self.left.leaves() + self.right.leaves()

    def splits(self) -> list[Tree]:
        return [] if self.feature < 0 else [self, *self.left.splits(), *self.right.splits()]

    def record(self) -> dict:
        if self.feature < 0:
            return {"value": self.value}
        return {
            "feature": self.feature, "threshold": self.threshold, "closed": self.closed, "gain": self.gain,
            "left": self.left.record(), "right": self.right.record(),
        }

    @staticmethod
    def read(record: dict) -> Tree:
        if "feature" not in record:
            return Tree(record["value"])
        sides = {side: Tree.read(record[side]) for side in ("left", "right")}
        return Tree(0.0, record["feature"], record["threshold"], record["closed"], gain=record["gain"], **sides)


def number(value: float, dialect: str = SPARK) -> str:
    """A double in SQL, exact to the last bit."""
    text = repr(float(value))
    if text in ("inf", "-inf", "nan"):
        text = f"'{text}'"
        return f"double({text})" if dialect == SPARK else f"{text}::double"
    if dialect == SPARK:
        return f"{text}D"
    return f"{text}::double" if value >= 0 else f"({text}::double)"


def tree_sql(tree: Tree, column: Callable[[int], str], dialect: str = SPARK, leaf: Callable[[Any], str] | None = None) -> str:
    """``CASE`` text of a tree; ``column`` names a feature, ``leaf`` writes a leaf's value."""
    if tree.feature < 0:
        return leaf(tree.value) if leaf else number(tree.value, dialect)
    sign = "<=" if tree.closed else "<"
    low, high = (tree_sql(side, column, dialect, leaf) for side in (tree.left, tree.right))
    return f"CASE WHEN {column(tree.feature)} {sign} {number(tree.threshold, dialect)} THEN {low} ELSE {high} END"


def total_sql(parts: Sequence[str]) -> str:
    """The sum of ``parts`` with balanced brackets, so that no parser recurses as deep as there are trees."""
    if not parts:
        return "0"
    while len(parts) > 1:
        parts = [f"({' + '.join(parts[i : i + 2])})" if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def weighted_vote_sql(
    trees: Sequence[Tree], weights: Sequence[float], classes: int, column: Callable[[int], str], dialect: str = SPARK
) -> str:
    """The class with the largest total weight, the lowest of equals; the leaves hold classes.

    Each tree gives its weight to one class, so a class's total is a sum of ``CASE`` whose leaves are that weight or 0.
    """
    totals = []
    for c in range(classes):
        parts = [
            tree_sql(t, column, dialect, lambda v, w=w, c=c: number(w if v == c else 0.0, dialect)) for t, w in zip(trees, weights, strict=True)
        ]
        totals.append(total_sql(parts) if parts else number(0.0, dialect))
    top = f"greatest({', '.join(totals)})" if classes > 1 else totals[0]
    arms = " ".join(f"WHEN {t} = {top} THEN {number(c, dialect)}" for c, t in enumerate(totals[:-1]))
    return f"CASE {arms} ELSE {number(classes - 1, dialect)} END" if arms else number(0.0, dialect)


def read_spark_tree(model: Any) -> Tree:
    """The nodes of a fitted Spark ML tree with continuous splits."""

    def walk(node) -> Tree:
        if node.getClass().getSimpleName() == "LeafNode":
            return Tree(node.prediction())
        split = node.split()
        if split.getClass().getSimpleName() != "ContinuousSplit":
            raise ValueError("only continuous splits become expressions")
        return Tree(0.0, split.featureIndex(), split.threshold(), True, walk(node.leftChild()), walk(node.rightChild()), node.gain())

    return walk(model._java_obj.rootNode())
