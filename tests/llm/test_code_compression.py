import hashlib
import math
import random

import numpy as np
import pytest

from tabwright.llm import code_compression as C


def brute(rows, entries=64, rounds=2):
    """Plain integers, one vector after the other."""
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    each = len(kept[0][2]) // 16
    part = lambda v, p: v[p * each : (p + 1) * each]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[2]))[:entries]
    books = [[part(v, p) for _, _, v in first] for p in range(16)]

    def assign(v, p):
        away = [sum((a - b) ** 2 for a, b in zip(part(v, p), c, strict=True)) for c in books[p]]
        return min(range(len(away)), key=lambda k: (away[k], k)), min(away)

    for _ in range(rounds):
        moved = [list(map(list, b)) for b in books]
        for p in range(16):
            groups = {}
            for _, _, v in kept:
                groups.setdefault(assign(v, p)[0], []).append(part(v, p))
            for k, g in groups.items():
                moved[p][k] = [sum(x) // len(g) for x in zip(*g, strict=True)]
        books = moved
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, total = [], {}
    for i, label, v in kept:
        found = [assign(v, p) for p in range(16)]
        error = sum(d for _, d in found)
        total[label] = total.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for k, _ in found), error, label))
    return sorted(((i, code, e, total[label], digest) for i, code, e, label in out), key=repr)


def frame(spark, rows):
    schema = "vec_id long, embedding array<float>, label int, code string, error string, slot int, v string, n int, of string"
    return spark.createDataFrame([(i, v, label, "x", "y", 1, "z", 2, "w") for i, v, label in rows], schema)


def some(rng, n, size=32, scale=1.0):
    out = []
    for i in range(n):
        v = [float(np.float32(rng.gauss(0, scale))) for _ in range(size)]
        out.append((i, v, rng.choice([0, 1, None])))
    return out


def test_equals_plain_integers(spark):
    rng = random.Random(4)
    rows = some(rng, 150)
    rows += [(200 + i, rows[i][1], 0) for i in range(70)]  # copies tie everywhere
    rows += [(300, None, 1), (301, [], 1), (302, [None] * 32, 1), (303, [float("nan")] * 32, 2), (304, [float("-inf")] * 32, 2), (305, [0.0] * 32, 7)]
    rows += [(None, rows[3][1], None), (7, rows[9][1], 1), (7, rows[9][1], 1)]
    got = C.compress(frame(spark, rows).repartition(5))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    # the repeated id 7 is no tie here, as its rows come in the order of their integers too
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_few_vectors_and_large_components(spark):
    rng = random.Random(5)
    rows = some(rng, 9, 16, 20_000.0)
    assert sorted(map(tuple, C.compress(frame(spark, rows)).collect()), key=repr) == brute(rows)
    with pytest.raises(Exception, match="exact distances"):
        C.compress(frame(spark, [(1, [1e30] * 16, 0)])).collect()


def test_odd_tables(spark):
    assert C.compress(frame(spark, [])).count() == 0
    assert C.compress(frame(spark, [(None, [1.0] * 16, 0)])).count() == 0
    # vectors of another length than that of the smallest id that fits are left out
    rows = [(0, [1.0] * 5, 0), (1, [1.0] * 16, 0), (2, [2.0] * 32, 0), (3, [1.5] * 16, None)]
    assert sorted(r.vec_id for r in C.compress(frame(spark, rows)).collect()) == [1, 3]


@pytest.mark.parametrize("size", [1, 3, 64, 1000])
@pytest.mark.parametrize("top", [5, 1 << 25, 1 << 26])
def test_limb_products_are_exact(size, top):
    rng = random.Random(size)
    x = [[rng.randrange(-top, top) for _ in range(size)] for _ in range(7)] + [[-top] * size, [top] * size]
    y = [[rng.randrange(-top, top) for _ in range(size)] for _ in range(5)] + [[top] * size]
    expected = [[sum(a * b for a, b in zip(r, s, strict=True)) for s in y] for r in x]
    assert C.exact_products(np.array(x), np.array(y)).tolist() == expected
    bits = C.limb_bits(size)
    assert size << (2 * bits) <= 1 << 53
    for limb in C.limbs(np.array(x), bits):
        assert np.abs(limb).max() <= 1 << bits


def test_products_beyond_float_precision():
    x = np.array([[(1 << 29) + 1, 1]])
    assert C.exact_products(x, x)[0, 0] == ((1 << 29) + 1) ** 2 + 1
    best, away = C.nearest(np.array([[1 << 28]]), np.array([[(1 << 28) + 1], [(1 << 28) - 1], [(1 << 28) + 2]]))
    assert (best[0], away[0]) == (0, 1)
