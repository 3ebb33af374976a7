import math

import numpy as np
import pytest

from tabwright.llm import embedding_dedup as E


def brute(rows, threshold=0.95):
    def fine(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    good = [i for i, (k, v, *_) in enumerate(rows) if k is not None and fine(v)]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(rows[i][1]) for i in good}
    near = {i: [j for j in good if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in good}
    out = []
    for i, (k, *_) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = None if k is None else min(rows[j][0] for j in seen)
        out.append((k, len(near.get(i, [])), low, True if k is None else k == low))
    return sorted(out, key=repr)


def cases():
    rng = np.random.default_rng(2)
    rows, k = [], 1000
    for _ in range(30):  # clusters of chained neighbours, copies among them
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 12)):
            base = base + rng.normal(size=16) * 0.22
            rows += [(int(k := k - 1), base.astype(np.float32).tolist())] * 1
        rows.append((int(k := k - 1), rows[-1][1]))
    rows += [(2000 + i, [0.5] * 16) for i in range(60)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [1.0, None] * 8), (3004, [float("nan")] * 16), (3005, [float("inf")] + [1.0] * 15)]
    rows += [(3006, [1.0, 2.0]), (3007, [2.0, 4.0]), (3008, [1.0, 2.0, 0.0]), (None, [0.5] * 16), (3009, [1e-30] * 16), (3010, [3e38] * 16), (3011, [-0.5] * 16)]
    return [(i, v, None, "x") for i, v in rows]


@pytest.mark.parametrize("block,pivots", [(4096, 1024), (20, 8), (7, 40)])
def test_against_brute_force(spark, block, pivots):
    rows = cases()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string").repartition(3)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v, *_ in rows]
    got = E.near_duplicates(table, block=block, most_pivots=pivots).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_empty_table(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_error_bounds_hold_and_settle_most_pairs():
    rng = np.random.default_rng(1)
    u = E.unit(np.concatenate([rng.normal(size=(300, 64)), np.repeat(rng.normal(size=(10, 64)), 30, 0) + rng.normal(size=(300, 64)) * 0.2]))
    q = E.quantise(u)
    found, exact = E.linked(u, q, u, q, 0.95)
    assert (found == (u @ u.T >= 0.95)).all() or np.abs((u @ u.T)[found != (u @ u.T >= 0.95)] - 0.95).max() < 1e-12
    rounded = q[0] * q[1][:, None]
    assert (np.abs(u @ u.T - rounded @ rounded.T) <= q[2][:, None] + (1 + q[2][:, None]) * q[2][None]).all()
    assert exact < 0.05 * len(u) ** 2


def test_the_two_names_of_a_class_are_independent(spark):
    """A hash that takes the other as its seed would be a function of it."""
    import inspect

    from pyspark.sql import functions as F

    assert 'F.xxhash64(F.lit(1), "v")' in inspect.getsource(E.near_duplicates)
    row = spark.createDataFrame([([1.0, 2.0],)], "v array<double>").select(F.xxhash64("v").alias("a"), F.xxhash64("v", F.lit(1)).alias("b"), F.xxhash64(F.lit(1), "v").alias("c")).first()
    from_a = spark.range(1).select(F.xxhash64(F.lit(1)).alias("x")).first()
    assert len({row.a, row.b, row.c, from_a.x}) == 4


def test_only_pairs_near_the_threshold_are_looked_at_closely(monkeypatch):
    import numpy as np

    from tabwright.llm import embedding_dedup as E

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(600, 64)), np.repeat(rng.normal(size=(40, 64)), 5, 0) + rng.normal(size=(200, 64)) * 0.15])
    u = E.unit(x)
    q = E.quantise(u)
    sizes, nonzero = [], np.nonzero
    monkeypatch.setattr(E.np, "nonzero", lambda a: sizes.append(len((found := nonzero(a))[0])) or found)
    monkeypatch.setattr(E, "PAIRS", 7)
    links, _ = E.linked(u, q, u, q, 0.95)
    monkeypatch.undo()
    assert (links == (u @ u.T >= 0.95)).all() and links.sum() > 1000
    assert sum(sizes) < 0.02 * len(u) ** 2
