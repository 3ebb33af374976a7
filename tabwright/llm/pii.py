"""Personal data by candidate gradient boosting, in DataFrame functions only.

Strict rules give the base spans. A loose generator for each kind proposes more spans, overlapping ones too: what
looks like a mail address, an ip, a card or a phone by itself, also inside a longer run of digits that the rules
reject as a whole. Boosted trees judge a proposal by its format and context. They learn from all texts which
proposals a base span confirms, without seeing the plus sign, so they know what such data looks like where a rule
misses it. Features never show the sign that only the rules ask for (the plus, the plain at sign), and a proposal
that the rules miss is no error by that alone: it counts as a case in part, by how often proposals like it are
confirmed (``_missed``). The counts of equal feature rows are all that training takes to the driver, 2**features of
a kind at most. A threshold for each kind is calibrated to a precision on texts held out of training.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import table
from tabwright.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
#: The base rules as Java patterns that neither recurse nor retry: same matches as the plain forms.
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@(?=[{_LABEL}]+\.[{_LABEL}])[{_LABEL}.]+?(?!\.?[{_LABEL}])"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: The loose generators.
MAIL_LIKE = r"[^\s@<>\"(),;:\[\]]{1,64}(?:@| ?[\[(]at[\])] ?)[^\s@<>\"(),;:\[\]]{1,255}"
IP_LIKE = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"
CARD_LIKE = r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])"
PHONE_LIKE = r"(?<![0-9])\+?(?:[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"

#: Trees of an ensemble, shrinkage, ridge, and the share of all proposals that a leaf must hold.
ROUNDS, RATE, RIDGE, LEAF = 30, 0.3, 1.0, 0.001
#: The rules are taken to find at least this share of the cases of any format.
FOUND = 0.5
#: Precision on held-out texts that a kind's threshold has to reach.
PRECISION = 0.95
#: Width of the context on either side.
CONTEXT = 24


def _placed(matches: Column, pieces: Column) -> Column:
    """(start, end, text) of each match, from the matches and the pieces before them, in one fold."""
    both = F.zip_with(matches, F.slice(pieces, 1, F.size(matches)), lambda m, p: F.struct(F.length(p).alias("gap"), m.alias("text")))
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["text"])
        span = F.struct(start.alias("start"), end.alias("end"), x["text"].alias("text"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    return F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])


def _located(df: DataFrame, found: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds for each name an array of (start, end, text) of all matches; starts count code points of column ``t``.

    What lies between the matches comes from splitting by the same pattern, so lengths add up to places.
    """
    none = F.array().cast("array<string>")
    for name, (pattern, likely) in found.items():
        df = df.withColumn(f"{name}_m", F.when(likely, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(none))
    for name, (pattern, _) in found.items():
        df = df.withColumn(f"{name}_p", F.when(F.size(f"{name}_m") > 0, F.split("t", pattern, -1)).otherwise(none))
    for name in found:
        df = df.withColumn(name, _placed(F.col(f"{name}_m"), F.col(f"{name}_p"))).drop(f"{name}_m", f"{name}_p")
    return df


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    values = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int"))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _base(df: DataFrame) -> DataFrame:
    t = F.col("t")
    return (
        _located(
            df,
            {
                "email": (EMAIL, F.instr(t, "@") > 0),
                "ip": (IP, t.rlike(r"[0-9]\.[0-9]+\.[0-9]")),
                "card": (CARD, t.rlike(r"[0-9](?:[ -]?[0-9]){12}")),
                "phone": (PHONE, t.rlike(r"\+[0-9]")),
            },
        )
        .withColumn("ip", F.filter("ip", lambda x: F.forall(F.split(x["text"], r"\."), lambda p: p.cast("double") <= 255)))
        .withColumn("card", F.filter("card", lambda x: _luhn(_digits(x["text"]))))
        .withColumn("phone", F.filter("phone", lambda x: F.length(_digits(x["text"])).between(9, 15)))
    )


def _mail_features(x: Column, left: Column, right: Column) -> dict[str, Column]:
    domain = F.regexp_extract(x, r"(?:@|[\])] ?)(.*)$", 1)
    return {
        "dotted": F.instr(domain, ".") > 1,
        "top": domain.rlike(r"\.[A-Za-z]{2,12}\W*$"),
        "long_local": F.length(x) - F.length(domain) > 3,
        "ascii": x.rlike(r"^[\x21-\x7e ]+$"),
        "odd": x.rlike(r"[/=?&'!*#|$]"),
        "cue": left.rlike(r"(?i)(?:mail|contact|write|reply)\W*$"),
        "open": left.rlike(r"(?:^|[\s<(\[])$"),
    }


def _number_features(x: Column, left: Column, right: Column) -> dict[str, Column]:
    n = F.length(_digits(x))
    return {
        "paren": x.rlike(r"\([0-9]+\)"),
        "last4": x.rlike(r"[^0-9][0-9]{4}$"),
        "parts3": x.rlike(r"[0-9][^0-9]+[0-9]+[^0-9]+[0-9]"),
        "octets": ~x.rlike(r"(?:[3-9][0-9]|2[6-9]|25[6-9])[0-9]|25[6-9]|[0-9]{4}"),
        "check": F.when(n.between(13, 19), _luhn(_digits(x))).otherwise(F.lit(False)),
        "n9": n >= 9,
        "n13": n >= 13,
        "n16": n == 16,
        "n17": n > 16,
        "blank": x.rlike(r"[^0-9+()]{2}|  "),
        "fours": x.rlike(r"^[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}"),
        "cue": left.rlike(r"(?i)(?:tel|phone|call|fax|mobile|card|visa|pay|ip|host|server|addr\w*)\W*$"),
        "open": left.rlike(r"(?:^|[\s(\[])$") & right.rlike(r"^(?:$|[\s.,;:!?)\]])"),
    }


def _candidates(df: DataFrame) -> DataFrame:
    """Adds ``email_like`` and so on: arrays of (start, end, features)."""
    t = F.col("t")
    found = {
        "email_like": (MAIL_LIKE, t.rlike(r"@|[\[(]at[\])]")),
        "ip_like": (IP_LIKE, t.rlike(r"[0-9]\.[0-9]+\.[0-9]")),
        "card_like": (CARD_LIKE, t.rlike("[0-9]{4}[ -]?[0-9]{4}")),
        "phone_like": (PHONE_LIKE, t.rlike("[0-9][ .-][0-9]{3,4}")),
    }
    df = _located(df, found)

    def judged(name: str, features) -> Column:
        def one(x: Column) -> Column:
            begin = F.greatest(x["start"] - CONTEXT, F.lit(0))
            left = F.substring(t, begin + 1, x["start"] - begin)
            right = F.substring(t, x["end"] + 1, F.lit(CONTEXT))
            named = [c.alias(k) for k, c in features(x["text"], left, right).items()]
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.struct(*named).alias("f"))

        return F.transform(name, one)

    for name in found:
        df = df.withColumn(name, judged(name, _mail_features if name == "email_like" else _number_features))
    return df


def prepare(docs: DataFrame) -> DataFrame:
    """Base spans and proposals of every document, written once: training and selection read it, not the texts."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    df = _candidates(_base(df)).withColumn("held", F.pmod(F.xxhash64("t"), F.lit(5)) == 0)
    slim = [F.transform(k, lambda x: F.struct(x["start"], x["end"])).alias(k) for k in KINDS]
    return cut_lineage(df.select("doc_id", "held", *slim, *[f"{k}_like" for k in KINDS]))


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


class Trees:
    """Gradient boosting for yes and no over yes-no features: trees of two splits, Newton leaves."""

    def __init__(self, names: list[str]):
        self.names, self.bias, self.trees = names, 0.0, []

    def fit(self, x: np.ndarray, yes: np.ndarray, no: np.ndarray) -> Trees:
        n = yes + no
        self.leaf = LEAF * n.sum()
        self.bias = math.log((yes.sum() + 1) / (no.sum() + 1))
        score = np.full(len(x), self.bias)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            g, h = yes - n * p, n * p * (1 - p)
            root = self._split(x, g, h, n, np.ones(len(x), bool))
            if root is None:
                break
            leaves = {}
            for side in (False, True):
                rows = x[:, root] == side
                inner = self._split(x, g, h, n, rows)
                for low in (False, True):
                    some = rows if inner is None else rows & (x[:, inner] == low)
                    value = RATE * g[some].sum() / (h[some].sum() + RIDGE)
                    leaves[side, low] = (inner, float(value))
                    score[some] += value if inner is not None or low else 0
            self.trees.append((root, leaves))
        return self

    def _split(self, x, g, h, n, rows) -> int | None:
        def worth(s):
            return g[s].sum() ** 2 / (h[s].sum() + RIDGE)

        best, at = 1e-6, None
        for f in range(x.shape[1]):
            on, off = rows & x[:, f], rows & ~x[:, f]
            if min(n[on].sum(), n[off].sum()) >= self.leaf and on.any() and off.any() and (gain := worth(on) + worth(off) - worth(rows)) > best:
                best, at = gain, f
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for root, leaves in self.trees:
            for i, row in enumerate(x):
                inner, _ = leaves[bool(row[root]), False]
                out[i] += leaves[bool(row[root]), inner is None or bool(row[inner])][1]
        return out

    def column(self, f: Column) -> Column:
        """The same score in SQL of a struct of features."""
        out = F.lit(self.bias)
        for root, leaves in self.trees:
            sides = []
            for side in (True, False):
                inner, yes = leaves[side, True]
                sides.append(F.lit(yes) if inner is None else F.when(f[self.names[inner]], yes).otherwise(leaves[side, False][1]))
            out = out + F.when(f[self.names[root]], sides[0]).otherwise(sides[1])
        return out


def train(prepared: DataFrame, precision: float = PRECISION) -> dict[str, tuple[Trees, float]]:
    """For each kind an ensemble and the least score that reaches ``precision`` on held-out texts (infinite if none does)."""
    out = {}
    for kind in KINDS:
        rows = prepared.select("held", kind, F.explode(f"{kind}_like").alias("c"))
        rows = rows.select("held", F.exists(kind, lambda b: _overlaps(F.col("c"), b)).alias("yes"), "c.f.*")
        names = rows.columns[2:]
        cells: dict[tuple, np.ndarray] = {}
        for r in rows.groupBy(*rows.columns).count().collect():
            cells.setdefault(tuple(bool(r[c]) for c in names), np.zeros(4))[2 * bool(r["held"]) + bool(r["yes"])] += r["count"]
        keys = sorted(cells)
        x = np.array(keys, bool).reshape(len(keys), len(names))
        n = np.array([cells[k] for k in keys]).reshape(len(keys), 4)
        cases = _missed(Trees(names).fit(x, n[:, 1], n[:, 0]).score(x))
        yes, no = n[:, 1::2] + cases[:, None] * n[:, ::2], (1 - cases)[:, None] * n[:, ::2]
        trees = Trees(names).fit(x, yes[:, 0], no[:, 0])
        out[kind] = (trees, _calibrate(trees.score(x), yes[:, 1], no[:, 1], precision))
    return out


def _missed(score: np.ndarray, found: float = FOUND) -> np.ndarray:
    """The share of cases among proposals that the rules miss, from the score for being confirmed.

    These are the weights of learning from positive and unlabelled examples. Confirmed proposals are ``found`` of the
    cases of their format at least, so up to ``(1 - found) / found`` missed ones for each confirmed one are cases.
    """
    return np.minimum(1.0, (1 - found) / found * np.exp(np.minimum(score, 50.0)))


def _calibrate(score: np.ndarray, yes: np.ndarray, no: np.ndarray, precision: float) -> float:
    """The least score at and above which held-out proposals reach the precision, one doubtful proposal added.

    ``yes`` and ``no`` are weights: what the rules miss is in both of them, see ``_missed``.

    A proposal that is itself less likely than that stays out, however good those above it are.
    """
    best, good, bad, sure = math.inf, 0.0, 1.0, math.log(precision / (1 - precision))
    for s in sorted(set(score.tolist()), reverse=True):
        if s < sure:
            break
        at = score == s
        good, bad = good + yes[at].sum(), bad + no[at].sum()
        if good / (good + bad) >= precision:
            best = s
    return best


def detect(prepared: DataFrame, models: dict[str, tuple[Trees, float]]) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and ``base_sha256`` are of base spans, which all stay. A proposal above its kind's threshold is added
    if it meets no base span and none added before: mail addresses come first, then cards, phones and ips.
    """
    df = prepared.withColumn("taken", F.concat(*KINDS))
    for kind in ("email", "card", "phone", "ip"):
        trees, least = models[kind]
        if math.isfinite(least):
            free = F.filter(f"{kind}_like", lambda c: (trees.column(c["f"]) >= least - 1e-9) & ~F.exists("taken", lambda b: _overlaps(c, b)))  # noqa: B023
            slim = F.transform(free, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))
        else:
            slim = F.array().cast("array<struct<start:int,end:int>>")
        df = df.withColumn(f"{kind}_more", slim)
        df = df.withColumn("taken", F.concat("taken", f"{kind}_more"))

    def said(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))

    everything = [said(k, F.array_sort(F.concat(k, f"{k}_more"))) for k in KINDS]
    base = F.array_join(F.concat(*[said(k, F.col(k)) for k in KINDS]), ",")
    return df.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.concat(*everything), ",").alias("spans"),
    )


def find_private(docs: DataFrame) -> DataFrame:
    """Train on ``docs`` and detect in all of them. Null texts are empty; repeated rows keep their rows."""
    prepared = prepare(docs)
    return detect(prepared, train(prepared))


def op7_private_data(spark, sf_dir: str) -> DataFrame:
    return find_private(table(spark, sf_dir, "documents"))
