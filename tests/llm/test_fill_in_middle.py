import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from cases import awkward, documents

from tabwright.llm import fill_in_middle as M

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.DOTALL)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n, code = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(code[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text), text
    if h4 % 100 < 20:
        form, out = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
    else:
        form, out = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, form, len(prefix), len(middle), sha(out), sha(text), out


def test_documents(spark):
    rows = awkward()
    rng = random.Random(6)
    signs = ["a", "bc", "<", "P", ">", "<P", "<S", "S>", "<M", "é", "中", "\U0001f600", "\n", " ", "7", "@", "[", "`", "{"]
    rows += [(1000 + i, "".join(rng.choice(signs) for _ in range(rng.randrange(12))), "en", "s") for i in range(600)]
    rows += [(2000, "a <M> b", "en", "s"), (-5, "negative id", "en", "s")]
    got = M.fill_in_middle(documents(spark, rows).repartition(4))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"]
    got = sorted(map(tuple, got.collect()), key=repr)
    assert got == sorted((brute(i, t) for i, t, *_ in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert sha(M.restore(r[2], r[7])) == r[6]


def test_empty_table(spark):
    assert M.fill_in_middle(documents(spark, []), with_output=False).count() == 0


def test_every_rank_is_reached():
    rng = random.Random(7)
    texts = ["", None, "a", "é", "aé b", "word " * 40, "".join(rng.choice("ab é中\U0001f600.") for _ in range(3000)), ""]
    lists = M.SkipLists(pa.array(texts))
    units = [UNIT.findall(t or "") for t in texts]
    assert lists.sizes.tolist() == list(map(len, units))
    for rank in range(max(map(len, units)) + 1):
        ranks = np.minimum(rank, lists.sizes)
        passed, points = lists.reach(ranks)
        assert passed.tolist() == ranks.tolist()
        if rank % 37 < 3:
            assert points.tolist() == [len("".join(u[:r])) for u, r in zip(units, ranks.tolist(), strict=True)]


def test_lanes_thin_out_and_keep_their_widths():
    lists = M.SkipLists(pa.array(["-" * 200_000, "x y"]))
    sizes = [len(units) for _, units, _ in lists.lanes]
    assert all(b < a / 8 for a, b in zip(sizes[:-2], sizes[1:-1], strict=True)) and sizes[-1] == 4
    for _, units, width in lists.lanes:
        assert units.sum() == 200_003 and width.sum() == 200_003


def test_a_very_long_text_in_little_memory():
    import tracemalloc

    text = "any words, and 5 more; " * 900_000
    column = pa.array([text])
    tracemalloc.start()
    lists = M.SkipLists(column)
    passed, points = lists.reach(np.array([5_000_000]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert passed[0] == 5_000_000 and len(UNIT.findall(text[: points[0]])) == 5_000_000
    assert most < 60 * len(text)
