import random
import re

import numpy as np
import pyarrow as pa
import pytest
from cases import awkward, documents, thue_morse

from tabwright.llm import minhash as M
from tabwright.llm.common import Texts


def sets(rows, k):
    out = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute(rows, k, percent=80):
    shingles = sets(rows, k)
    near = {}
    for i, a in enumerate(shingles):
        for j in range(i):
            b = shingles[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                near.setdefault(rows[i][0], set()).add(rows[j][0])
                near.setdefault(rows[j][0], set()).add(rows[i][0])
    out = []
    for (i, *_), s in zip(rows, shingles, strict=True):
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = None if i is None else min(seen)
        out.append((i, len(s), low, True if i is None else i == low))
    return sorted(out, key=repr)


def near_copies(seed=3):
    """One large group of copies edited more and less, so that some link only by way of others."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(150)]
    rows = awkward()
    for i in range(160):
        text = list(base)
        for _ in range(rng.randrange(0, 14)):
            text[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((500 + i, " ".join(text), "en", "s"))
    return rows


@pytest.mark.parametrize("k,bucket,tile", [(4, 24, 256), (5, 1, 20), (4, 3, 7)])
def test_against_brute_force(spark, monkeypatch, k, bucket, tile):
    """Small buckets and tiles send nearly all comparisons through the tiles."""
    monkeypatch.setattr(M, "PAIR_BUCKET", bucket)
    monkeypatch.setattr(M, "TILE", tile)
    rows = near_copies()
    got = M.near_duplicates(documents(spark, rows).repartition(4), k).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, k)


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    for n in (1, 3, 40, 500, 5000):
        shared = rng.integers(0, 2**63, int(n * 0.8) + 1).astype(np.uint64)
        a, b = (np.unique(np.concatenate([shared, rng.integers(0, 2**63, n - len(shared) + 1).astype(np.uint64)])) for _ in range(2))
        s = M.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert (s != 2**64 - 1).all()
        similarity = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - similarity) < 0.2


def test_words_and_shingles():
    texts = Texts(pa.array(["A b  c\td", "a B c d", "a b c", None, " "]), lower=True)
    grams, first = M.shingle_sets(texts, 4)
    assert np.diff(first).tolist() == [1, 1, 1, 0, 0] and grams[0] == grams[1] != grams[2]


def test_stage_and_empty_table(spark):
    rows = near_copies()
    docs = documents(spark, rows)
    kept = M.keep_first(docs)
    want = sorted((r[0] for r in brute(rows, 5) if r[3]), key=repr)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == want
    assert M.near_duplicates(documents(spark, [])).count() == 0


def test_texts_under_one_repeated_id_keep_their_links(spark):
    one = " ".join(f"a{i}" for i in range(60))
    for low, high in (("aa", "zz"), ("zz", "aa")):
        other = " ".join(f"{low}{i}" for i in range(60))
        shared = f"{high} {one}"
        rows = [(5, shared, "en", "s"), (5, other, "en", "s"), (7, shared, "en", "s"), (9, shared + " end", "en", "s"), (11, other + " end", "en", "s")]
        got = {r.doc_id: r.component_id for r in M.near_duplicates(documents(spark, rows)).collect()}
        assert got == {5: 5, 7: 5, 9: 5, 11: 5}


def test_patterned_words_do_not_meet(spark):
    """Thue-Morse words, whose hashes by sums of powers are equal, and runs of words in that pattern."""
    one, two = thue_morse(10)
    rows = [(1, one, "en", "s"), (2, two, "en", "s"), (3, " ".join(one), "en", "s"), (4, " ".join(two), "en", "s")]
    rows += [(5, f"{one} a b c", "en", "s"), (6, f"{two} a b c", "en", "s")]
    got = M.near_duplicates(documents(spark, rows), 4).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 4)
    assert all(r.kept for r in got if r.doc_id in (1, 2, 5, 6))
