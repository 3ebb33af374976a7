import hashlib
import random
import re

import numpy as np
import pytest
from cases import awkward, documents

from tabwright.llm import pii


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


#: The base rules in their plain form.
RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(rule, text or "") if good(m[0])] for k, (rule, good) in RULES.items()}


def odd_texts(rng):
    signs = ["a", "b.c", "@", "@x.de", ".", "..", "-", "+", "+1", "1", "255", "256", "4111111111111111", "4111 1111 1111 1111", " ", "(", ")", "é", "\U0001f600", "12", "%", "\n", "0" * 9]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 25))) for _ in range(1500)]
    cards = ["4111111111111111", "4111-1111-1111-1111", "378282246310005", "4111111111111112", "41111111111111111111"]
    for i in range(120):
        texts.append(f"word call +1 (555) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)} or {rng.choice(cards)} at 10.0.{i}.7, a{i}@mail.example.com. end")
        texts.append(f"word call ({rng.randrange(100, 999)}) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)} now")
    return texts


def test_base_equals_the_plain_rules(spark):
    rng = random.Random(6)
    rows = awkward() + [(1000 + i, t, "en", "s") for i, t in enumerate(odd_texts(rng))]
    long = ["1 " * 20_000, "1." * 8_000, "a@" + "b." * 20_000 + "c", "x" * 60_000 + "@", "+1" + "(" * 50_000, "9" * 50_000, "a@b.cc " * 1000 + "7" * 16]
    rows += [(9000 + i, t, "en", "s") for i, t in enumerate(long)]
    got = pii.find_private(documents(spark, rows).repartition(6)).collect()
    assert len(got) == len(rows)
    by = {}
    for i, t, *_ in rows:
        by.setdefault(i, []).append(brute(t))
    for r in got:
        found = by[r.doc_id][0]
        base = [f"{k}:{a}:{b}" for k in pii.KINDS for a, b in found[k]]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(found[k]) for k in pii.KINDS], r.doc_id
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), r.doc_id
        spans = r.spans.split(",") if r.spans else []
        assert set(base) <= set(spans)
        order = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert order == sorted(order)


def test_trees_add_what_looks_the_same(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        phone = f"({rng.randrange(100, 999)}) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"
        rows.append((i, f"some words {'+1 ' if i % 50 else ''}{phone} and {rng.randrange(1900, 2030)} to {rng.randrange(100)} years", "en", "s"))
    got = pii.find_private(documents(spark, rows)).collect()
    bare = [r.spans for r in got if r.doc_id % 50 == 0]
    assert all(s.startswith("phone:11:") for s in bare)
    assert all(r.n_phone == 0 for r in got if r.doc_id % 50 == 0)


@pytest.mark.parametrize("times", [1, 4])
def test_what_the_rules_often_miss_is_added_at_any_size(spark, times):
    rng = random.Random(8)
    rows, phones, mails = [], set(), set()
    for i in range(1000 * times):
        phone = f"({rng.randrange(100, 999)}) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"
        sign = " [at] " if i % 10 == 1 else "@"
        plus = "" if i % 10 < 3 else "+1 "
        rows.append((i, f"call {plus}{phone} or write to ann{i}{sign}mail{i % 7}.example.com today, order 2{i % 10}-{i % 9}0-77 and x@{i}", "en", "s"))
        phones |= {i} if not plus else set()
        mails |= {i} if sign != "@" else set()
    assert len(mails) == 100 * times and len(phones) == 300 * times
    got = {r.doc_id: r for r in pii.find_private(documents(spark, rows)).collect()}
    assert all(r.n_phone == (i not in phones) and r.n_email == (i not in mails) for i, r in got.items())
    for i, text, *_ in rows:
        spans = got[i].spans.split(",")
        assert sum(s.startswith("phone:") for s in spans) == 1 and sum(s.startswith("email:") for s in spans) == 1, (text, spans)


def test_what_the_rules_confirm_rarely_is_not_added(spark):
    rng = random.Random(9)
    rows = []
    for i in range(800):
        number = f"({rng.randrange(100, 999)}) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"
        rows.append((i, f"some words {'' if i % 20 else '+1 '}{number} and more", "en", "s"))
    got = pii.find_private(documents(spark, rows)).collect()
    assert all((r.spans != "") == (r.doc_id % 20 == 0) for r in got)


def test_scores_are_the_same_in_sql(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    x = rng.random((200, 4)) < 0.5
    yes = (x[:, 0] & x[:, 1]) * 30.0 + x[:, 2]
    trees = pii.Trees(list("abcd")).fit(x, yes, 31 - yes)
    df = spark.createDataFrame([tuple(map(bool, r)) for r in x], "a boolean, b boolean, c boolean, d boolean")
    got = [r[0] for r in df.select(trees.column(F.struct(*"abcd"))).collect()]
    assert got == pytest.approx(trees.score(x))


def test_empty_table(spark):
    assert pii.find_private(documents(spark, [])).count() == 0
