import hashlib
from collections import defaultdict

import pytest
from cases import awkward, documents

from tabwright.llm import exact_dedup as X


def brute(rows):
    by = defaultdict(list)
    for i, t, *_ in rows:
        by[t or ""].append(i)
    out = []
    for i, t, *_ in rows:
        ids = [x for x in by[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(by[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [32 << 20, 20_000, 600])
def test_awkward_rows(spark, limit):
    """A small limit makes buckets recurse, tables flush and hot contents be dealt out."""
    rows = awkward()
    got = X.exact_dedup(documents(spark, rows).repartition(7), limit).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_stage_keeps_one_row_of_each_text(spark):
    rows = awkward()
    docs = documents(spark, rows)
    kept = X.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted({t or "" for _, t, *_ in rows})


def test_empty_table(spark):
    assert X.exact_dedup(documents(spark, [])).count() == 0


def test_colliding_hashes_are_told_apart_by_content():
    held = X.ContentTable()
    for i, content in enumerate([b"a", b"b", b"a"] * 800):
        held.add("0", 5, content, i, 1)
    for i in range(2000):
        held.add("0", i, b"%d" % i, i, 1)
    assert sorted(r[5] for r in held.rows)[-2:] == [800, 1600]
