"""Awkward tables that every operator has to take."""

import random

CLASHING = "bucket string, hash long, n long, a int, node string, size double, start int, kept string, rule string"
#: names of helper columns, past and present
CLASHING += ", __p string, __sha string, __keep long, __rows long, __n int, __id long, __hash long, __times int"
CLASHING += ", prediction string, Text_SHA256 string, keep_id long, keep_rows long, mix_id long, mix_hash long, mix_times int, mix_n int"
EXTRA = ("p", "q", 7, 8, 9, 10, 11, 12, "r", "s", 13, 14, 15, 16, 17, 18)


def documents(spark, rows):
    """rows of (doc_id, text, lang, source); with columns whose names operators might use themselves."""
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
    full = [(i, t, lang, src, len(t or ""), "x", 1, 2, 3, "y", 0.5, 4, "z", None, *EXTRA) for i, t, lang, src in rows]
    return spark.createDataFrame(full, schema)


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def awkward(seed=5):
    """Nulls in every column, empty, blank and long texts, copies, near copies, repeated rows, odd characters."""
    rng = random.Random(seed)
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "  \n\t", None, None), (None, "no id here", "en", "s")]
    rows += [(5, "one", "en", "s"), (6, "ONE", "de", None), (7, "café \U0001f600 naïve x\x1cy z", "fr", "t")]
    base = words(rng, 300)
    for i in range(10, 40):
        near = list(base)
        for _ in range(rng.randrange(0, 14)):
            near[rng.randrange(len(near))] = f"v{rng.randrange(50)}"
        rows.append((i, " ".join(near), rng.choice(["en", "de"]), rng.choice(["s", "t", "u", None])))
    for i in range(40, 60):
        rows.append((i, "same text in many rows", "en", "hot"))
    shared = words(rng, 60, 10_000)
    for i in range(60, 80):
        rows.append((i, " ".join(words(rng, 50) + shared[i % 5 :] + words(rng, 30)), "en", "s"))
    rows.append((80, " ".join(words(rng, 20_000, 3000)), "en", "long"))
    rows.append((81, " ".join(["again and"] * 2000), "en", "long"))
    rows.append((82, "x" * 100_000, "en", "long"))
    rows += [(83, "repeated row", "en", "s")] * 3
    rows.append((84, "+++ 123 --- 456", "en", "s"))
    return rows


def thue_morse(steps):
    """Two words of 2**steps letters that differ everywhere, yet agree in every sum of powers of an odd number mod 2**64."""
    one = "a"
    for _ in range(steps):
        one += one.translate({97: 98, 98: 97})
    return one, one.translate({97: 98, 98: 97})
