import zlib

import numpy as np
import pytest
from cases import awkward, documents

from tabwright.llm import langid as L
from tabwright.operators import order_stats


def texts(n):
    import random

    rng = random.Random(n)
    parts = {"aa": ["ka", "to", "mi", "ran"], "bb": ["sch", "ung", "ber", "zö"], "cc": ["eau", "ç", "oi", "que"]}
    return [
        (i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 300))), lang, "s")
        for i, lang in ((i, rng.choice(list(parts))) for i in range(n))
    ]


def test_held_out_accuracy_and_rules(spark):
    rows = texts(500) + [(1000, None, "aa", "s"), (1001, "", "bb", "s"), (1002, "123 +++ 456", "cc", "s"), (None, "schung ber", None, None)]
    got = L.identify(documents(spark, rows).repartition(3)).collect()
    lang = {i: x for i, _, x, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert len(held) > 50 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def test_reruns_agree_and_labels_of_held_out_texts_do_not_matter(spark):
    rows = texts(300)
    again = [(i, t, "aa" if zlib.crc32(str(i).encode()) % 5 == 0 else x, "other") for i, t, x, _ in rows]
    a, b = (sorted(map(tuple, L.identify(documents(spark, r).repartition(n)).collect())) for r, n in ((rows, 2), (again, 5)))
    assert [x[:3] for x in a] == [x[:3] for x in b] and np.allclose([x[3] for x in a], [x[3] for x in b], atol=1e-4)


def test_windows_cover_every_byte():
    body = [b"", b"x" * 256, b"y" * 257, b"z"]
    data = np.frombuffer(b"".join(body), np.uint8)
    x, doc, filled = L.windows(data, np.cumsum([0] + [len(b) for b in body]))
    assert doc.tolist() == [1, 2, 2, 3] and filled.tolist() == [256, 256, 1, 1]
    assert (x != L.PAD).sum() == len(data)


def test_gradient_is_right():
    rng = np.random.default_rng(0)
    net = L.ByteNet(["a", "b"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, 256, (6, L.WINDOW)), rng.integers(0, 2, 6)

    def loss():
        target = np.full((6, 2), L.SMOOTH / 2)
        target[np.arange(6), y] += 1 - L.SMOOTH
        return -(target * net.log_probs(x)).sum() / 6

    grad = net.gradients(x, y)
    for name, at in (("w3", (5, 2)), ("out", (3, 1)), ("bias", (0,)), ("emb", (int(x[0, 3]), 1))):
        keep = net.p[name][at]
        net.p[name][at] = keep + 1e-6
        up = loss()
        net.p[name][at] = keep - 1e-6
        down = loss()
        net.p[name][at] = keep
        assert grad[name][at] == pytest.approx((down - up) / -2e-6, rel=1e-3, abs=1e-6)


def test_nothing_to_learn_from(spark):
    assert L.identify(documents(spark, [])).count() == 0
    rows = [(i, t, None, None) for i, t, *_ in awkward()[:20]]
    assert {r.lang_pred for r in L.identify(documents(spark, rows)).collect()} == {"und"}


def test_stage_keeps_lettered_documents(spark):
    rows = texts(100) + [(500, "123", "aa", "s")]
    kept = L.keep_known(docs := documents(spark, rows))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(100))


def test_stage_rejects_what_is_in_no_learned_language(spark):
    rows = texts(600)
    strange = {
        1000: "Все люди рождаются свободными и равными в своем достоинстве и правах. " * 3,
        1001: "人人生而自由在尊严和权利上一律平等" * 5,
        1002: "#$ 12 %% 8 &* 57 +=- 90 <> 3 " * 8 + "a",
        1003: "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności. " * 3,
    }
    rows += [(i, t, None, "s") for i, t in strange.items()] + [(2000, "ka", None, "s"), (2001, "", "aa", "s")]
    for parts in (1, 5):
        kept = {r.doc_id for r in L.keep_known(documents(spark, rows).repartition(parts)).collect()}
        assert kept == set(range(600)) | {2000}


def plain_prediction(net, text):
    """One window, one filter and one place after the other."""
    raw = text.encode()
    total, weight = np.zeros(len(net.langs)), 0
    for at in range(0, len(raw), L.WINDOW):
        piece = raw[at : at + L.WINDOW]
        symbols = [*piece, *[L.PAD] * (L.WINDOW - len(piece))]
        h = []
        for w in L.WIDTHS:
            for f in range(L.FILTERS):
                best = -np.inf
                for place in range(L.WINDOW - w + 1):
                    patch = np.concatenate([net.p["emb"][s] for s in symbols[place : place + w]])
                    best = max(best, float(patch @ net.p[f"w{w}"][:, f]))
                h.append(max(best, 0.0))
        z = [sum(x * net.p["out"][i, k] for i, x in enumerate(h)) + net.p["bias"][k] for k in range(len(net.langs))]
        top = max(z)
        norm = top + np.log(sum(np.exp(v - top) for v in z))
        total += np.array([v - norm for v in z]) * len(piece)
        weight += len(piece)
    mean = np.exp(total / weight)
    mean /= mean.sum()
    return net.langs[int(mean.argmax())], float(mean.max())


def test_predictions_equal_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(L, "FILTERS", 5)
    net = L.ByteNet(["aa", "bb", "cc"], seed=3)
    net.p["out"] *= 20
    rows = [(i, t, None, "s") for i, t in enumerate(["ka to", "x", "zö" * 200, "eau " * 70 + "q", "!" * 256 + "a", "b" * 256])] + [(90, "12 !", None, None), (91, None, None, None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(documents(spark, rows).repartition(3), net).collect()}
    assert got.pop(90) == got.pop(91) == ("und", 0.0)
    for i, t, *_ in rows[:6]:
        lang, score = plain_prediction(net, t)
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-4)


def test_pairs_and_fences_come_from_all_texts(spark, monkeypatch):
    """More texts than the sample takes: counts, gradients and fences see every one of them."""
    rows = [(i, t, lang if lang == "aa" else "bb", "s") for i, t, lang, _ in texts(200)] + [(900, None, "aa", "s"), (901, "12", "aa", "s"), (902, "ka", None, "s")]
    docs = documents(spark, rows).repartition(3)
    known = [r for r in rows if r[2] and r[1] and any(c.isalpha() for c in r[1])]
    want = np.zeros((2, 256, 256))
    for _, t, lang, _ in known:
        raw = t.encode()
        for a, b in zip(raw, raw[1:]):
            want[["aa", "bb"].index(lang), a, b] += 1
    assert (L.count_pairs(docs, ["aa", "bb"]) == want).all()
    net, pairs = L.ByteNet(["aa", "bb"], seed=3), L.Pairs(want)
    found = {0: [], 1: []}
    for _, t, lang, _ in known:
        for at in range(0, len(raw := t.encode()), L.WINDOW):
            piece, y = np.frombuffer(raw[at : at + L.WINDOW], np.uint8), ["aa", "bb"].index(lang)
            ends = np.array([0, len(piece)])
            if net.log_probs(L.windows(piece, ends)[0]).argmax() == y:
                found[y].append(pairs.familiarity(piece, ends, np.array([y]))[0])
    L.fence(pairs, net, docs)
    for y, values in found.items():
        if len(values) >= L.LEAST_HELD:
            low, middle = np.quantile(values, [0.01, 0.5])
            assert np.allclose([pairs.middle[y], pairs.least[y]], [middle, low - L.FENCE * (middle - low)])
    assert any(len(v) >= L.LEAST_HELD for v in found.values())
    # every learned document is in one round, whatever the sample
    seen = []
    indexed = L._indexed
    monkeypatch.setattr(L, "_indexed", lambda docs, langs: seen.extend(r.doc_id for r in docs.select("doc_id").collect()) or indexed(docs, langs))
    before = L.ByteNet(["aa", "bb"], seed=3)
    after = L.refine(L.ByteNet(["aa", "bb"], seed=3), docs)
    assert sorted(seen) == sorted(r[0] for r in rows) and not np.allclose(before.p["out"], after.p["out"])


def test_fences_take_each_window_once_in_a_pass(spark, monkeypatch):
    """A row for each window and language in every pass would be mostly nulls."""
    docs = documents(spark, texts(120)).repartition(3)
    langs = ["aa", "bb", "cc"]
    net, pairs = L.ByteNet(langs, seed=3), L.Pairs(L.count_pairs(docs, langs))
    passes, placed = [], order_stats._placed
    monkeypatch.setattr(order_stats, "_placed", lambda *args: passes.append(placed(*args)) or passes[-1])
    L.fence(pairs, net, docs)
    assert np.isfinite(pairs.least).any()
    assert passes and not any("Generate" in p._jdf.queryExecution().toString() for p in passes)


def test_languages_are_numbered_without_python_workers(spark, sf):
    """A table from a Python list starts Python workers of its own in every executor, beside those of the network."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    langs = sorted(r.lang for r in docs.where("lang is not null").select("lang").distinct().collect())
    got = L._indexed(docs, langs[:2])
    assert "ExistingRDD" not in got._jdf.queryExecution().toString()
    want = sorted((langs.index(r.lang), r.text) for r in L.labelled(docs).collect() if r.lang in langs[:2])
    assert got.dtypes == [("lang", "int"), ("text", "string")] and sorted(map(tuple, got.collect())) == want
