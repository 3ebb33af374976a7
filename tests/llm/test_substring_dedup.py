import hashlib
import random
import re
from collections import Counter

import pytest
from cases import awkward, documents, thue_morse

from tabwright.llm import substring_dedup as S


def brute(rows, k):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    times = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (i, *_), w in zip(rows, words, strict=True):
        gone = {p for s in range(len(w) - k + 1) if times[tuple(w[s : s + k])] > 1 for p in range(s, s + k)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("k,m", [(35, 16), (6, 3), (4, 4), (3, 1)])
def test_against_brute_force(spark, k, m):
    rng = random.Random(9)
    rows = awkward()
    rows += [(200 + i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))), "en", "s") for i in range(40)]
    passage = [f"p{i}" for i in range(60)]
    for i in range(30):  # shared passages of all lengths around the window
        a = rng.randrange(0, 30)
        b = a + rng.randrange(25, 40)
        rows.append((300 + i, " ".join([f"q{i}_{j}" for j in range(rng.randrange(0, 50))] + passage[a:b] + [f"r{i}_{j}" for j in range(9)]), "en", "s"))
    got = S.remove_repeats(documents(spark, rows).repartition(4), k, m).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, k)


def test_empty_table(spark):
    assert S.remove_repeats(documents(spark, [])).count() == 0


def test_patterned_words_are_no_repeats(spark):
    one, two = thue_morse(10)
    same = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{same} {one}", "en", "s"), (2, f"{same} {two}", "en", "s"), (3, " ".join(one[:200]), "en", "s"), (4, " ".join(two[:200]), "en", "s")]
    got = S.remove_repeats(documents(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 35)
    assert {r.n_removed for r in got if r.doc_id < 3} == {0}


def graph(spark, texts):
    """Places of made paths: each text is a string of path names, each path of as many windows as its letter says."""
    rows = []
    for t, names in enumerate(texts):
        start = 0
        for name in names:
            n = ord(name.lower()) - ord("a") + 1
            if name != " ":
                rows.append((t, 0, start, n, ord(name), 7))
            start += n if name != " " else 5
    return spark.createDataFrame(rows, "t1 long, t2 int, start int, n int, minimizer long, path long")


def test_paths_without_a_branch_compact(spark):
    # abc always stands together; d follows or not; e meets f on both sides; gg is a cycle; a gap parts h from i
    texts = ["abcd", "abc", "xabcd", "ef", "fe", "ef", "gggg", "h i", "h i"]
    got = sorted((r.t1, r.start, chr(r.minimizer), r.parts, r.words) for r in S.compact(graph(spark, texts), 10).collect())
    one = lambda t, start, names: (t, start, names[0], len(names), sum(ord(c) - 96 for c in names) + 9)
    want = [one(0, 0, "abc"), one(0, 6, "d"), one(1, 0, "abc"), one(2, 0, "x"), one(2, 24, "abc"), one(2, 30, "d")]
    want += [one(3, 0, "e"), one(3, 5, "f"), one(4, 0, "f"), one(4, 6, "e"), one(5, 0, "e"), one(5, 5, "f")]
    want += [one(6, 7 * i, "g") for i in range(4)] + [x for t in (7, 8) for x in (one(t, 0, "h"), one(t, 13, "i"))]
    assert got == sorted(want)


def test_a_long_passage_is_one_path(spark):
    passage = " ".join(f"p{i}" for i in range(400))
    rows = [(i, f"{' '.join(f'x{i}_{j}' for j in range(30))} {passage} y{i}", "en", "s") for i in range(4)]
    named = S._named(documents(spark, rows))
    found = S.edges(named, 35, 16)
    whole = found.groupBy("minimizer", "path").count().where("count > 1")
    out = S.compact(found.join(whole, ["minimizer", "path"], "left_semi"), 35).collect()
    assert len(out) == 4 and len({(r.minimizer, r.path) for r in out}) == 1
    assert out[0].parts > 10 and out[0].words > 360


@pytest.mark.parametrize("bits", [2, 0])
def test_words_decide_where_hashes_meet(spark, monkeypatch, bits):
    """Nearly all paths of a minimizer hash alike; the result is the same."""
    monkeypatch.setattr(S, "PATH_BITS", bits)
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 50))), "en", "s") for i in range(60)]
    passage = [f"p{i}" for i in range(40)]
    rows += [(100 + i, " ".join([f"q{i}", *passage[i : i + 12], f"r{i}"]), "en", "s") for i in range(12)]
    rows += [(200, "only one text of these words here", "en", "s"), (201, "only one text of these words here", "en", "s")]
    got = S.remove_repeats(documents(spark, rows), 6, 3).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 6)
