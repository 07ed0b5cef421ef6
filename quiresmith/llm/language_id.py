"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's words give subwords (the word with boundary marks, and its character n-grams); each is hashed to a
row of an embedding matrix; a text is the mean of its rows, and a linear softmax over it gives the language.
Both matrices are trained by stochastic gradient descent in numpy on the driver, on a bounded sample of
labelled rows (`SAMPLE` rows of at most `SAMPLE_BYTES` in all); temperature and the rejection thresholds come from a held-back part of
that sample. A softmax is sure of texts unlike any language it knows too, so a text is also rejected where its subwords
are rarer in the sample (mean logarithm of their shares) than those of all but `REJECT` of the held-back texts, by half their deviation. The sum over subwords is linear, so a word's share of the logits is computed once and kept.

Defined cases: null or letterless texts get `und`, score 0, rejected; labels that are null aren't learned from; a model that would have more
than `CELLS` weights is refused with an error, no label is left out; with no labelled row at all every text is `und`; with one label, every text with letters gets it; under
50 texts with letters to learn from set no thresholds; long texts are
scored whole; repeated rows alike; an empty table gives no rows; other columns are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, give_back, mix, table, tidy

#: Labelled rows and bytes of text that a model is fitted on, at most.
SAMPLE, SAMPLE_BYTES = 6000, 24 << 20
BUCKETS, DIM = 1 << 15, 16
#: Weights of a model, at most: 1 GB.
CELLS = 1 << 27
#: Words that a worker keeps with their logits (speed only).
KEPT_WORDS = 200_000
#: Words whose subwords are hashed together.
TOGETHER = 8192
#: Share of held-back texts of known languages that each threshold may reject; some 6 of the 1,200 of a full sample.
REJECT = 0.005
LETTER = regex.compile(r"\p{L}")


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the embedding matrix, place of the word) of the words' subwords, all words at once.

    A word in lower case between boundary marks gives itself and its 1- to 4-grams, as often as they occur.
    """
    marked = [f"<{w.lower()}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    owner = np.repeat(np.arange(len(marked)), sizes)
    starts = np.cumsum(sizes) - sizes
    rows, owners = [], []
    gram = np.zeros(len(codes), np.uint64)
    for n in (1, 2, 3, 4):
        gram = gram[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        inside = owner[: len(gram)] == owner[n - 1 :]
        rows.append(gram[inside] ^ np.uint64(n << 56))
        owners.append(owner[: len(gram)][inside])
    place = np.arange(len(codes)) - np.repeat(starts, sizes)
    if len(marked):
        rows.append(np.add.reduceat(mix(codes + (place.astype(np.uint64) << np.uint64(32))), starts))
        owners.append(np.arange(len(marked)))
    return (mix(np.concatenate(rows)) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(owners)


class Model:
    """Weights of each hashed subword per language, already multiplied out, with temperature and threshold.

    usual: logarithms of the subwords' shares in the sample; texts whose mean is under `least` are rejected.
    """

    def __init__(self, labels: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float, threshold: float, usual: np.ndarray, least: float):
        self.labels, self.weights, self.bias, self.temperature, self.threshold = labels, weights, bias, temperature, threshold
        self.usual, self.least = usual, least
        self.at: dict[str, int] = {}
        self.sums = np.zeros((1024, len(labels) + 2))

    def parts(self) -> tuple:
        return self.labels, self.weights, self.bias, self.temperature, self.threshold, self.usual, self.least

    def learn(self, texts: list[str | None]) -> None:
        """Work out the words of many texts together (speed only)."""
        new: set[str] = set()
        for t in texts:
            new.update(t.split() if t else ())
        if self.labels:
            self._rows(list(new))

    def _rows(self, words: list[str]) -> np.ndarray:
        at = self.at
        try:
            return np.fromiter(map(at.__getitem__, words), np.int64, len(words))
        except KeyError:
            if len(at) > KEPT_WORDS:
                at.clear()
            new = list(set(words).difference(at))
            first = len(at)
            at.update(zip(new, range(first, first + len(new)), strict=True))
            if len(at) > len(self.sums):
                self.sums = np.concatenate([self.sums[:first], np.zeros((2 * len(at) - first, self.sums.shape[1]))])
            self.sums[first : len(at)] = 0
            every = np.array([k for k, w in enumerate(new) if w.isalpha() or LETTER.search(w)], np.int64)
            for a in range(0, len(every), TOGETHER):
                lettered = every[a : a + TOGETHER]
                rows, owner = subwords([new[k] for k in lettered])
                for c in range(len(self.labels)):
                    self.sums[first + lettered, c] = np.bincount(owner, self.weights[rows, c], len(lettered))
                self.sums[first + lettered, -2] = np.bincount(owner, self.usual[rows], len(lettered))
                self.sums[first + lettered, -1] = np.bincount(owner, minlength=len(lettered))
            return np.fromiter(map(at.__getitem__, words), np.int64, len(words))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language or und, calibrated probability, rejected)."""
        words = text.split() if text else []
        if not words or not self.labels:
            return "und", 0.0, True
        uses = self.sums_of(words)
        if not uses[-1]:
            return "und", 0.0, True
        z = (uses[:-2] / uses[-1] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.labels[k], float(p[k]), bool(p[k] < self.threshold or uses[-2] / uses[-1] < self.least)

    def sums_of(self, words: list[str]) -> np.ndarray:
        rows = self._rows(words)
        if len(rows) <= 512:
            return self.sums[rows].sum(0)
        return np.bincount(rows, minlength=len(self.at)) @ self.sums[: len(self.at)] if len(rows) > len(self.at) else self.sums[rows].sum(0)


def train(texts: list[str], langs: list[str], seed: int = 7, epochs: int = 4, rate: float = 2.0) -> Model:
    """SGD over shuffled texts; every fifth text is held back for temperature and threshold."""
    try:
        return _train(texts, langs, seed, epochs, rate)
    finally:
        give_back()


def _train(texts: list[str], langs: list[str], seed: int, epochs: int, rate: float) -> Model:
    labels = sorted(set(langs))
    c = len(labels)
    if not c:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0, np.zeros(BUCKETS), -np.inf)
    rng = np.random.default_rng(seed)
    emb, out, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, c)), np.zeros(c)
    bags, ys = [], []
    for text, lang in zip(texts, langs, strict=True):
        words, times = np.unique([w for w in text.split() if LETTER.search(w)], return_counts=True)
        if not len(words):
            continue
        rows, owner = subwords(words.tolist())
        n = np.bincount(rows, times[owner])
        rows = np.flatnonzero(n)
        bags.append((rows, n[rows] / n.sum()))
        ys.append(labels.index(lang))
    order = rng.permutation(len(bags))
    held = order[::5] if len(bags) >= 50 else order[:0]
    fit = np.setdiff1d(order, held)
    steps, total = 0, max(1, epochs * len(fit))
    for _ in range(epochs):
        for i in rng.permutation(fit):
            rows, share = bags[i]
            mean = share @ emb[rows]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[ys[i]] -= 1
            lr = rate * (1 - steps / total)
            steps += 1
            back = out @ p
            out -= lr * 0.1 * np.outer(mean, p)
            bias -= lr * 0.01 * p
            emb[rows] -= lr * share[:, None] * back[None, :] * 10
    weights = emb @ out
    z = np.array([share @ weights[rows] + bias for rows, share in (bags[i] for i in held)]).reshape(-1, c)
    y = np.array([ys[i] for i in held], int)
    share_of = np.zeros((c, BUCKETS))
    for i in fit:
        share_of[ys[i], bags[i][0]] += bags[i][1]
    share_of /= np.maximum(share_of.sum(1, keepdims=True), 1e-9)
    usual = np.log(share_of.mean(0) + 1e-6)  # languages weigh alike
    temperature, threshold, least = 1.0, 0.0, -np.inf
    if len(y):
        def loss(t: float) -> float:
            q = z / t
            q = q - q.max(1, keepdims=True)
            return float(-(q[np.arange(len(y)), y] - np.log(np.exp(q).sum(1))).mean())

        temperature = min(np.geomspace(0.05, 20, 121), key=loss)
        q = z / temperature
        q = np.exp(q - q.max(1, keepdims=True))
        threshold = float(np.quantile(q.max(1) / q.sum(1), REJECT)) if c > 1 else 0.0
        threshold = min(threshold, max(0.5, 1.5 / c))  # never rejects a clear majority
        if c > 1:
            known = np.array([share @ usual[rows] for rows, share in (bags[i] for i in held)])
            least = float(np.quantile(known, REJECT) - known.std() / 2)  # some room, as the held-back texts are few
    return Model(labels, weights, bias, temperature, threshold, usual, least)


def training_rows(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", rows: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[str]]:
    """A bounded sample of labelled rows, spread by a hash of the id; whole texts.

    As many rows a language as fit in equal shares of the row and byte bounds, so rare languages are
    learned too. Labels are as many as the corpus has: they are a model's classes, whose weights must fit a worker.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.octet_length(text_col).alias("size"), F.xxhash64(id_col).alias("h"))
    stats = {r.lang: (r.n, r.size) for r in known.groupBy("lang").agg(F.count("*").alias("n"), F.sum("size").alias("size")).toLocalIterator()}
    if not stats:
        return [], []
    if len(stats) * BUCKETS > CELLS:
        raise ValueError(f"{len(stats)} labels make a model of over {CELLS} weights")
    bound = lambda n, size: int(min(1.0, rows / len(stats) / n, most_bytes / len(stats) / max(1, size)) * (1 << 30))
    shares = docs.sparkSession.createDataFrame([(lang, bound(*of)) for lang, of in stats.items()], "lang string, bound long")
    chosen = known.join(F.broadcast(shares), "lang").where(F.pmod(F.col("h"), F.lit(1 << 30)) < F.col("bound"))  # a row a label
    got, used, texts, langs = chosen.select("lang", "text", "h").toLocalIterator(), 0, [], []
    kept = sorted((r.h, r.lang, r.text) for r in got)
    for _, lang, text in kept:
        used += len(text)
        if used > 2 * most_bytes:
            break
        texts.append(text)
        langs.append(lang)
    return texts, langs


def identify(docs: DataFrame, model: Model, id_col: str | None = None, text_col: str = "text", extra: tuple = ()) -> DataFrame:
    """Rows (id, extra..., lang_pred, score, rejected) of whole texts; only the text is an input."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.parts())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = Model(*shared.value)
        for batch in batches(it, "text", 4 << 20):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            local.learn(texts)
            got = [local.predict(t) for t in texts]
            cols = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], [*names, "lang_pred", "score", "rejected"])

    narrow = docs.select(F.col(id_col or "doc_id").alias("id"), *extra, F.col(text_col).alias("text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema if f.name != "text")
    return narrow.mapInArrow(tidy(run), f"{fields}, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """docs without the rows that the model rejects; a null lang_col gets the prediction, all else stays as it is."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.parts())
    names = docs.columns
    at = names.index(text_col)
    lang = names.index(lang_col) if lang_col in names else None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = Model(*shared.value)
        for batch in batches(it, text_col, 4 << 20):
            texts = batch.column(at).to_pylist()
            local.learn(texts)
            got = [local.predict(t) for t in texts]
            cols = list(batch.columns)
            if lang is not None and cols[lang].null_count and pa.types.is_string(cols[lang].type):
                cols[lang] = pa.array([g[0] if x is None else x for g, x in zip(got, cols[lang].to_pylist(), strict=True)], pa.string())
            rest = pa.array([k for k, g in enumerate(got) if not g[2]], pa.int64())
            yield pa.RecordBatch.from_arrays([c.take(rest) for c in cols], names)

    return docs.mapInArrow(tidy(run), docs.schema)


def held_out():
    """Rows kept from training, as a Column: crc32 of the id as text, modulo 4, is 2; a null id isn't held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(*training_rows(docs.where(~held_out())))
    return identify(docs, model, extra=(held_out().alias("held_out"),)).withColumnRenamed("id", "doc_id")
