import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
from cases import thue_morse

from tabwright.llm import minhash as M
from tabwright.llm import substring_dedup as S
from tabwright.llm.common import Texts, fresh, perhaps_in


def test_words_are_found_and_hashed_by_content():
    rng = random.Random(1)
    pool = ["a", "ab", "abcdefgh", "abcdefghi", "x" * 64, "x" * 65, "x" * 200, "é" * 40, "\x00", "\x00\x00", "A", "aB"]
    texts = ["".join(rng.choice([*pool, " ", "\n", "\t \r"]) for _ in range(rng.randrange(12))) for _ in range(500)] + [None, "", " "]
    for lower in (False, True):
        found = Texts(pa.array(texts), lower=lower)
        words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
        flat = [w for ws in words for w in ws]
        if lower:
            flat = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in flat]
        assert np.diff(found.first).tolist() == list(map(len, words))
        names = {}
        for w, h in zip(flat, found.wh.tolist(), strict=True):
            assert names.setdefault(w, h) == h
        assert len(set(names.values())) == len(names)


def test_runs_are_equal_where_words_are():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(40))) for _ in range(60)]
    found = Texts(pa.array(texts))
    seen, back = {}, {}
    for i, t in enumerate(texts):
        words = t.split()
        for a in range(len(words)):
            for b in range(a + 1, len(words) + 1):
                at = found.first[i]
                (h,) = found.runs(np.array([at + a]), np.array([at + b])).tolist()
                run = tuple(words[a:b])
                assert seen.setdefault(run, h) == h and back.setdefault(h, run) == run


def test_patterns_and_seeds():
    one, two = thue_morse(12)
    found = Texts(pa.array([f"{one} {two}", " ".join(one), " ".join(two)]))
    assert found.wh[0] != found.wh[1]
    begin = found.first[1:3]
    a, b = found.runs(begin, begin + 4096).tolist()
    assert a != b
    other = found.seeded(1)
    assert not np.isin(other.wh, found.wh).any() and found.seeded(0).wh.tolist() == found.wh.tolist()


def test_a_very_long_text_in_little_memory():
    """What op2 and op5 hold for a text of 20 MB."""
    rng = random.Random(3)
    text = " ".join(rng.choice(["ab", "word", "something", "x"]) + str(i % 100_000) for i in range(2_000_000))
    assert len(text) > 18_000_000
    column = pa.array([text])
    tracemalloc.start()
    found = Texts(column, lower=True)
    words = tracemalloc.get_traced_memory()[1]
    grams, first = M.shingle_sets(found, 5)
    M.sketches(grams, first)
    S.paths(Texts(column), 35, 16)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert words < 14 * len(text), words / len(text)
    assert most < 40 * len(text), most / len(text)


def test_fresh_names(spark):
    df = spark.range(1).selectExpr("id as a", "id as `A_`", "id as b_")
    assert fresh(df, "a", "b", "a") == ["a__", "b", "a___"]


def test_rows_without_partner_stay_behind(spark, monkeypatch):
    """None with a partner is lost, few others pass, and with fewer bits than rows only more of them do."""
    rows = spark.range(20_000).selectExpr("id as a", "cast(id % 7 as string) as page", "'t' as bits")
    known = spark.range(0, 20_000, 50).selectExpr("id as a", "cast(id % 7 as string) as page")
    for most, passed in ((1 << 26, 4500), (1 << 8, 20_000)):
        monkeypatch.setattr("tabwright.llm.common.FILTER_BITS", most)
        got = perhaps_in(rows, known, ["a", "page"])
        assert got.columns == rows.columns and got.count() <= passed
        assert got.join(known, ["a", "page"]).count() == 400
    assert perhaps_in(rows, known.where("false"), ["a"]).count() == 0
