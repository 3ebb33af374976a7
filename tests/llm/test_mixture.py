import math
import re
from collections import defaultdict

import pytest
from cases import awkward, documents

from tabwright.llm import mixture as X


def targets(sizes):
    """The rule of the mix word for word: share, stop, share the excess again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: X.WEIGHTS[i % 3] for i, s in enumerate(order)}
    budget, out, open_ = X.SHARE * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if budget * weight[s] / total >= 2 * sizes[s]}
        if not over:
            return out | {s: budget * weight[s] / total for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            budget -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("bucket", [50_000, 7])
def test_plan_meets_targets(spark, monkeypatch, bucket):
    monkeypatch.setattr(X, "BUCKET_ROWS", bucket)
    rows = awkward()
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(10, 60)] + [(11, None, 0, "y"), (12, 1, 0, "z")], "doc_id long, quality int, toxic int, source string")
    got = X.plan(documents(spark, rows).repartition(4), labels).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        if r.target >= r.source_size:
            assert r.taken >= r.size
        taken[r.source] += r.taken
    assert {s: taken[s] for s in sizes} == {s: math.floor(t + 1e-9) for s, t in want.items()}
    again = X.plan(documents(spark, rows[::-1]).repartition(9), labels).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_good_documents_are_preferred(spark):
    rows = [(i, " ".join(["w"] * 20), "en", "a") for i in range(400)] + [(1000 + i, " ".join(["w"] * 20), "en", "b") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    got = X.plan(documents(spark, [(i, t, lang, "z" if s == "a" else "b") for i, t, lang, s in rows]), labels).collect()
    extra = [r.doc_id % 2 for r in got if r.source == "z" and r.taken > r.size]
    rest = [r.doc_id % 2 for r in got if r.source == "z" and r.taken == r.size]
    assert sum(extra) / len(extra) > (sum(rest) / len(rest) if rest else 0)


def test_mixed_documents_repeat(spark):
    docs = documents(spark, awkward())
    mixed = X.mix(docs)
    assert mixed.columns == docs.columns
    times = defaultdict(int)
    for r in mixed.collect():
        times[r.doc_id] += 1
    for r in X.plan(docs).collect():
        if r.doc_id not in (None, 83) and r.size:
            assert abs(times[r.doc_id] - r.taken / r.size) <= 0.5


def test_empty_table(spark):
    assert X.plan(documents(spark, [])).count() == 0
    assert X.mix(documents(spark, [(1, None, None, None)])).count() == 0
