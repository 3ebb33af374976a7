"""Language identification by a byte convolutional network.

Byte embeddings, filters of several widths, max pooling over a fixed-length window and a softmax layer start from
weights that a bounded sample of labelled texts gives in many small steps. Then every window of every labelled text
takes part in ``ROUNDS`` large steps, whose gradients Spark adds up. Every window of every text is scored in batches
and a text's windows are averaged by their length. The softmax always names one of the learned languages; byte
pairs of that language, counted in all its texts, decide whether the text is in it (``Pairs``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tabwright.llm.common import SLICE_BYTES, fresh, slices, table, text_bytes
from tabwright.operators.order_stats import group_order_statistics
from tabwright.session import cut_lineage

WINDOW = 256
WIDTHS, FILTERS, DIM = (2, 3, 4), 12, 8
#: The first weights come from at most so many texts of each language, and so many windows of each.
SAMPLE_TEXTS, SAMPLE_WINDOWS = 600, 2
EPOCHS, BATCH, RATE, SMOOTH = 8, 64, 0.004, 0.02
#: Large steps over all labelled texts, each text in one of them; gradients far below ``CALM`` hardly count.
ROUNDS, CALM = 16, 1e-4
PAD = 256
UNKNOWN = "und"
#: A language with fewer held-out windows than this rejects nothing: too few to tell what is usual.
LEAST_HELD = 20
#: The least familiarity lies so many times the way from the median to the lowest hundredth below that hundredth.
FENCE = 4
#: Byte pairs of a language are smoothed by so many draws of its single bytes.
PRIOR = 20
#: A text counts as if so many usual bytes stood before it: a few letters tell too little to reject it.
USUAL = 16


class ByteNet:
    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"emb": rng.normal(0, 0.5, (PAD + 1, DIM))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS))
        self.p["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs)))
        self.p["bias"] = np.zeros(len(langs))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.p["emb"][PAD] = 0

    def pooled(self, x: np.ndarray, where: bool = False):
        """Filter maxima of each window (never below 0), and where they are if asked."""
        # places come first, so that sums and maxima run over long rows
        place, (k, size) = np.ascontiguousarray(x.T), x.shape
        tops, at = [], []
        for w in WIDTHS:
            n = size - w + 1
            tables = [self.p["emb"] @ self.p[f"w{w}"][j * DIM : (j + 1) * DIM] for j in range(w)]
            out = np.take(tables[0], place[:n], axis=0)
            for j in range(1, w):
                out += np.take(tables[j], place[j : j + n], axis=0)
            out = out.reshape(n, -1)
            tops.append(out.max(0).reshape(k, FILTERS))
            if where:
                at.append(out.argmax(0).reshape(k, FILTERS))
        return np.maximum(np.concatenate(tops, 1), 0), at

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(self.pooled(x)[0])

    def _softmax(self, h: np.ndarray) -> np.ndarray:
        z = h @ self.p["out"] + self.p["bias"]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        h, at = self.pooled(x, True)
        target = np.full((len(x), len(self.langs)), SMOOTH / len(self.langs), np.float32)
        target[np.arange(len(x)), y] += 1 - SMOOTH
        dz = (np.exp(self._softmax(h)) - target) / len(x)
        grad = {"out": h.T @ dz, "bias": dz.sum(0), "emb": np.zeros_like(self.p["emb"])}
        dh = (dz @ self.p["out"].T) * (h > 0)
        for k, w in enumerate(WIDTHS):
            dk = dh[:, k * FILTERS : (k + 1) * FILTERS]
            # only the winning place of each window and filter passes the gradient on
            spots = at[k][:, :, None] + np.arange(w)
            seen = x[np.arange(len(x))[:, None, None], spots]
            patch = self.p["emb"][seen].reshape(len(x), FILTERS, w * DIM)
            grad[f"w{w}"] = np.einsum("bf,bfd->df", dk, patch)
            back = dk[:, :, None] * self.p[f"w{w}"].T[None]
            np.add.at(grad["emb"], seen.reshape(-1), back.reshape(-1, DIM))
        grad["emb"][PAD] = 0
        return grad

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> ByteNet:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            rate = RATE * (1 - epoch / EPOCHS)
            for at in range(0, len(x), BATCH):
                rows, step = order[at : at + BATCH], step + 1
                for k, g in self.gradients(x[rows], y[rows]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts as padded rows, the text of each, and the bytes in each."""
    sizes = np.diff(offsets)
    per = -(-sizes // WINDOW)
    doc = np.repeat(np.arange(len(sizes)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    begin = offsets[doc] + nth * WINDOW
    filled = np.minimum(offsets[doc + 1] - begin, WINDOW)
    spots = begin[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < filled[:, None]
    x = np.full(spots.shape, PAD, np.intp)
    x[inside] = data[spots[inside]]
    return x, doc, filled


class Pairs:
    """Byte pairs of each language: the mean log probability of a text's bytes, and the least that is usual."""

    def __init__(self, counts: np.ndarray):
        """``counts`` of each byte pair in each language."""
        langs = len(counts)
        single = (counts.sum(1) + 0.5) / (counts.sum((1, 2)) + 128)[:, None]
        pairs = (counts + PRIOR * single[:, None]) / (counts.sum(2) + PRIOR)[:, :, None]
        self.first, self.next = np.log(single), np.log(pairs)
        self.middle, self.least = np.zeros(langs), np.full(langs, -np.inf)

    def familiarity(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Of each text in the language given for it; texts hold a byte at least."""
        sizes = np.diff(offsets)
        of = np.repeat(lang, sizes)
        terms = np.empty(len(data))
        terms[1:] = self.next[of[1:], data[:-1], data[1:]]
        begin = offsets[:-1]
        terms[begin] = self.first[lang, data[begin]]
        return np.add.reduceat(terms, begin) / sizes

    def strange(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Whether each text is less familiar than the least."""
        sizes = np.diff(offsets)
        found = self.familiarity(data, offsets, lang)
        return (sizes * found + USUAL * self.middle[lang]) / (sizes + USUAL) < self.least[lang]


def fence(pairs: Pairs, net: ByteNet, held: DataFrame) -> Pairs:
    """Take the least familiarity from all held-out windows whose language the network finds.

    It lies far below the lowest hundredth, so usual texts stay however many there are.
    """
    found = cut_lineage(_indexed(held, net.langs).mapInArrow(_window_familiarity(net, pairs), "lang int, found double"))
    places = lambda n: sorted({at for q in (0.01, 0.5) for at in _around(n, q)[:2]}) if n else []
    stats = group_order_statistics(found, "lang", "found", dict.fromkeys(range(len(net.langs)), places))
    for i, (n, values) in stats.items():
        if n >= LEAST_HELD:
            low, pairs.middle[i] = (values[a] + share * (values[b] - values[a]) for a, b, share in (_around(n, q) for q in (0.01, 0.5)))
            pairs.least[i] = low - FENCE * (pairs.middle[i] - low)
    return pairs


def _around(n: int, q: float) -> tuple[int, int, float]:
    """The ranks around a quantile of ``n`` values, and how far it lies between them."""
    place = q * (n - 1)
    return int(place), min(int(place) + 1, n - 1), place - int(place)


def labelled(docs: DataFrame) -> DataFrame:
    """Documents with a language and letters."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))


def _indexed(docs: DataFrame, langs: list[str]) -> DataFrame:
    """(lang, text) of the labelled documents, the language by its number."""
    # an expression: a table made from a Python list would keep Python workers of its own in every executor
    place = F.array_position(F.array(*map(F.lit, langs)), F.col("lang"))
    return labelled(docs.select("lang", "text")).where(place > 0).select((place - 1).cast("int").alias("lang"), "text")


def _window_familiarity(net: ByteNet, pairs: Pairs):
    """Rows (lang, text) to the familiarity of each window whose language the network finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            x, doc, filled = windows(data, offsets)
            lang = batch.column("lang").to_numpy()[doc]
            best = np.concatenate([net.log_probs(x[at : at + BATCH]).argmax(1) for at in range(0, len(x), BATCH)])
            found = pairs.familiarity(data, np.append(0, np.cumsum(filled)), best)
            good = best == lang
            yield pa.RecordBatch.from_arrays([pa.array(lang[good], pa.int32()), pa.array(found[good])], ["lang", "found"])

    return run


def _pair_sums(langs: int):
    """Rows (lang, text) of a task to the counts of the byte pairs in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((langs, 1 << 16), np.int64)
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            code = data[:-1].astype(np.int64) * 256 + data[1:]
            within = np.ones(len(code), bool)
            # a pair does not reach into the next text
            within[offsets[1:-1] - 1] = False
            of = np.repeat(batch.column("lang").to_numpy(), np.diff(offsets))[:-1]
            for k in np.unique(of).tolist():
                counts[k] += np.bincount(code[within & (of == k)], minlength=1 << 16)
        lang, code = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(code, pa.int32()), pa.array(counts[lang, code])], ["lang", "code", "n"])

    return run


def count_pairs(docs: DataFrame, langs: list[str]) -> np.ndarray:
    """(languages, 256, 256): how often each byte pair stands in all texts of each language."""
    parts = _indexed(docs, langs).mapInArrow(_pair_sums(len(langs)), "lang int, code int, n long")
    # at most 65,536 rows for each language
    found = parts.groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((len(langs), 1 << 16))
    out[found.column("lang").to_numpy(), found.column("code").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(-1, 256, 256)


def _gradient_sums(net: ByteNet):
    """Rows (lang, text) of a task to one row: its windows, and the sums of their gradients."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(sum(v.size for v in net.p.values())), 0
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            x, doc, _ = windows(data, offsets)
            y = batch.column("lang").to_numpy()[doc]
            n += len(x)
            for at in range(0, len(x), BATCH):
                grad = net.gradients(x[at : at + BATCH], y[at : at + BATCH])
                total += np.concatenate([grad[k].reshape(-1) for k in net.p]) * len(x[at : at + BATCH])
        yield pa.RecordBatch.from_arrays([pa.array([np.append(total, n)], pa.list_(pa.float64()))], ["sums"])

    return run


def refine(net: ByteNet, docs: DataFrame) -> ByteNet:
    """``ROUNDS`` steps by the gradients of all labelled documents, each document in the round its hash names.

    Sums do not depend on how rows lie in partitions, and nothing but one sum for each weight reaches the driver.
    """
    text_hash = F.xxhash64("doc_id", "text", F.lit("round"))
    m, v = (np.zeros(sum(p.size for p in net.p.values())) for _ in range(2))
    step = 0
    for r in range(ROUNDS):
        some = _indexed(docs.where(F.pmod(text_hash, F.lit(ROUNDS)) == r), net.langs)
        parts = some.mapInArrow(_gradient_sums(net), "sums array<double>")
        rows = parts.select(F.posexplode("sums").alias("at", "part")).groupBy("at").agg(F.sum("part").alias("total")).toArrow()
        sums = np.zeros(len(m) + 1)
        sums[rows.column("at").to_numpy()] = rows.column("total").to_numpy()
        if not sums[-1]:
            continue
        step += 1
        g = sums[:-1] / sums[-1]
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        move = RATE * (1 - r / ROUNDS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + CALM)
        at = 0
        for k, p in net.p.items():
            net.p[k] = p - move[at : at + p.size].reshape(p.shape).astype(p.dtype)
            at += p.size
    return net


def sample(docs: DataFrame, texts: int = SAMPLE_TEXTS, per_text: int = SAMPLE_WINDOWS) -> DataFrame:
    """(lang, window): for each language the texts with the smallest hashes of their id, some windows of each.

    Only the cut windows are shuffled, and Spark keeps ``texts`` rows of a language in each task before that.
    """
    body = F.col("text").cast("binary")
    count = F.ceil(F.octet_length("text") / WINDOW)
    order = F.xxhash64("doc_id", F.lit("sample"))
    cut = [
        F.expr(f"substring(cast(text as binary), cast(pmod(xxhash64(doc_id, {k}), ceil(octet_length(text) / {WINDOW})) as int) * {WINDOW} + 1, {WINDOW})")
        for k in range(per_text)
    ]
    usable = labelled(docs).where(count > 0)
    usable = usable.select("lang", order.alias("o"), F.col("doc_id").alias("i"), F.array_distinct(F.array(*cut)).alias("w"), F.md5(body).alias("m"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("o", "i", "m"))
    return usable.withColumn("r", rank).where(F.col("r") <= texts).select("lang", F.explode("w").alias("window"))


def held_out(doc_id) -> F.Column:
    """The fifth of the documents that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learned(docs: DataFrame) -> DataFrame:
    """Documents outside the held-out fifth; those without an id are in neither part."""
    return docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def train(docs: DataFrame, texts: int = SAMPLE_TEXTS) -> ByteNet | None:
    """Fit on all documents outside the held-out fifth; ``None`` if none of them has a language and letters."""
    known = learned(docs)
    net = _fit(sorted((r.lang, bytes(r.window)) for r in sample(known, texts).collect()))
    return net and refine(net, known)


def _fit(rows: list[tuple[str, bytes]]) -> ByteNet | None:
    if not rows:
        return None
    langs = sorted({lang for lang, _ in rows})
    body = b"".join(w for _, w in rows)
    offsets = np.cumsum([0] + [len(w) for _, w in rows])
    x, doc, _ = windows(np.frombuffer(body, np.uint8), offsets)
    y = np.array([langs.index(lang) for lang, _ in rows])[doc]
    return ByteNet(langs).fit(x, y)


def _score_slice(net: ByteNet, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, k = len(offsets) - 1, len(net.langs)
    total, weight = np.zeros((n, k)), np.zeros(n)
    x, doc, filled = windows(data, offsets)
    for at in range(0, len(x), BATCH):
        rows = slice(at, at + BATCH)
        share = filled[rows].astype(float)
        np.add.at(total, doc[rows], net.log_probs(x[rows]) * share[:, None])
        np.add.at(weight, doc[rows], share)
    mean = np.exp(total / np.maximum(weight, 1)[:, None])
    mean /= mean.sum(1, keepdims=True)
    return mean.argmax(1), mean.max(1)


def predict(text: F.Column, net: ByteNet | None, pairs: Pairs | None = None) -> F.Column:
    """struct<lang_pred, score> of a whole text; ``und`` with score 0 for null or a text without letters.

    With ``pairs`` also for a text less familiar than is usual in the language that the network names.
    """
    nothing = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if net is None:
        return nothing

    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            data, offsets = text_bytes(column)
            best, top = [], []
            at, n = 0, len(column)
            while at < n:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
                body, cuts = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
                b, t = _score_slice(net, body, cuts)
                if pairs is not None and len(body):
                    some = np.flatnonzero(np.diff(cuts))
                    strange = some[pairs.strange(body, np.r_[cuts[some], cuts[-1]], b[some])]
                    b[strange], t[strange] = -1, 0
                best.append(b)
                top.append(t)
                at = to
            best = np.concatenate(best) if best else np.zeros(0, int)
            top = np.concatenate(top) if top else np.zeros(0)
            names = pa.array([net.langs[i] if i >= 0 else UNKNOWN for i in best], pa.string())
            yield pa.StructArray.from_arrays([names, pa.array(top, pa.float64())], ["lang_pred", "score"])

    run = arrow_udf(score, "lang_pred string, score double")
    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return F.when(lettered, run(F.when(lettered, text))).otherwise(nothing)


def identify(docs: DataFrame, net: ByteNet | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Trains on ``docs`` if no network is given.

    Null texts and texts without letters are ``und``; documents without an id are neither held out nor learned from.
    """
    net = net or train(docs)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text"), net).alias("p"))
    return scored.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_known(docs: DataFrame, net: ByteNet | None = None, pairs: Pairs | None = None) -> DataFrame:
    """Documents in one of the languages of ``docs``, with all their columns.

    Null texts, texts without letters, and texts that are unfamiliar in the language the network names go. What is
    unfamiliar is learned from the held-out fifth; a language with under ``LEAST_HELD`` windows there rejects nothing.
    """
    if net is None:
        net = train(docs)
        if net is not None:
            pairs = fence(Pairs(count_pairs(learned(docs), net.langs)), net, docs.where(held_out(F.col("doc_id"))))
    (p,) = fresh(docs, "prediction")
    scored = docs.withColumn(p, predict(F.col("text"), net, pairs))
    return scored.where(F.col(p)["lang_pred"] != UNKNOWN).select(*docs.columns)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
