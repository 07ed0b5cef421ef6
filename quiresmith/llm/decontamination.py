"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit distance.

Texts and benchmark items are sequences of normalised words (lower case, letters and digits only). A document
holds an item of n words if some stretch of it is within floor(`SHARE` * n) word edits of the item.

1. Pieces: cut into one piece more than the edits allowed, an item keeps a piece intact in every such
   stretch, so only windows of n words around an intact piece can count. This loses nothing.
2. CGK: a random walk through a window copies its words to 3n places; at each step a random bit of (step,
   word) says whether to advance. Few edits give a small Hamming distance. Each repeat samples `PLACES` of
   the places and keeps the windows that agree with the item there; the number of repeats is the one at
   which simulated pairs at the most edits allowed reach the target recall.
   Where `MOST_REPEATS` don't reach it, as for items of very many words, there are none and step 3 sees
   every window of step 1.
3. Windows that agreed in any repeat are verified by the exact edit distance of the item to the best
   stretch within the allowed edits of the window.

Items are read in blocks of at most `BLOCK_BYTES` of text, each sent to the executors once; documents are
scanned where they are read, without a shuffle.

Defined cases: null texts and texts without words hold nothing; items that are null or without words match
nothing; items that repeat are reported each; repeated rows are reported each; a window may be cut short by the end
of a text; empty tables give no rows; other columns aren't looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, mix, rolling, table, tidy

SHARE, RECALL, PLACES, MOST_REPEATS, BLOCK_BYTES = 0.2, 0.99, 2, 512, 4 << 20
#: Bytes of text scanned together.
SCAN_BYTES = 12 << 20
#: Normalised words that a worker keeps with their hashes (speed only).
KEPT_WORDS = 200_000
SEED = 0x6A09E667F3BCC909


class Words:
    """Hashes of the normalised words of a text; 0 stands for none."""

    def __init__(self) -> None:
        self.kept: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.split() if text else []
        kept = self.kept
        try:
            h = np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(kept) > KEPT_WORDS:
                kept.clear()
            for w in set(words).difference(kept):
                low = w.lower()
                low = low if low.isalnum() else "".join(filter(str.isalnum, low))
                kept[w] = (xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")) | 1) if low else 0
            h = np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))
        return h[h != 0]


def allowed(n: int, share: float = SHARE) -> int:
    return int(math.floor(n * share + 1e-9))


def cgk(windows: np.ndarray, repeat: int, until: int | None = None) -> np.ndarray:
    """CGK walks of rows of n words: rows of 3n (or `until`) places, 0 past the end of a row."""
    rows, n = windows.shape
    wide = np.zeros((rows, n + 1), np.uint64)
    wide[:, :n] = windows
    at, out, row = np.zeros(rows, np.int64), np.empty((rows, until or 3 * n), np.uint64), np.arange(rows)
    for step in range(out.shape[1]):
        word = wide[row, at]
        out[:, step] = word
        seed = np.uint64((SEED * (2 * (repeat * 65537 + step) + 1)) & (2**64 - 1))
        at = np.minimum(at + ((mix(word ^ seed) >> np.uint64(17)) & np.uint64(1)).astype(np.int64), n)
    return out


def sampled(n: int, repeat: int, places: int = PLACES) -> np.ndarray:
    """The walk's places that a repeat looks at, among the first 3n/2: beyond, most walks have ended and all agree."""
    among = max(1, 3 * n // 2)
    return np.sort(np.random.default_rng((17, n, repeat)).choice(among, min(places, among), replace=False))


def sample(windows: np.ndarray, repeat: int) -> np.ndarray:
    """What this repeat sees of the walks through rows of n words."""
    at = sampled(windows.shape[1], repeat)
    return cgk(windows, repeat, int(at[-1]) + 1)[:, at]


@lru_cache(maxsize=None)
def repeats_for(n: int, share: float = SHARE, recall: float = RECALL) -> int | None:
    """Repeats at which simulated windows at the most edits allowed agree with their item at the target recall.

    None where `MOST_REPEATS` don't reach it; every window that a piece points to is then verified.
    """
    k = allowed(n, share)
    if not k:
        return 1
    rng = np.random.default_rng((23, n))
    pairs = 200
    x = rng.integers(1, 2**63, (pairs, n), dtype=np.uint64)
    y = np.zeros_like(x)
    for r in range(pairs):
        row = x[r].tolist()
        for _ in range(k):
            p, kind = int(rng.integers(0, len(row))), int(rng.integers(0, 3))
            row[p : p + (kind != 1)] = [int(rng.integers(1, 2**63))] * (kind != 2)
            row = row or [1]
        row = (row + [0] * n)[:n]
        y[r] = row
    found = np.zeros(pairs, bool)
    for repeat in range(MOST_REPEATS):
        found |= (sample(y, repeat) == sample(x, repeat)).all(1)
        if found.mean() >= recall:
            return repeat + 1
    return None


def edit_distances(items: np.ndarray, stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row by row: least edits of an item to any stretch within a row of stretches (0 ends a row), and the stretch's end."""
    rows, width = stretches.shape
    step = np.arange(width + 1)
    now = np.zeros((rows, width + 1), np.int32)
    for i in range(items.shape[1]):
        cost = (stretches != items[:, i : i + 1]) | (stretches == 0)
        best = np.minimum(now[:, 1:] + 1, now[:, :-1] + cost)
        after = np.concatenate([np.full((rows, 1), i + 1, np.int32), best.astype(np.int32)], axis=1)
        now = (np.minimum.accumulate(after - step, axis=1) + step).astype(np.int32)
    return now.min(1), now.argmin(1)


class Index:
    """A block of items: hashed words, pieces by length, and the repeats each length needs."""

    def __init__(self, items: list[tuple], share: float = SHARE, recall: float = RECALL):
        words = Words()
        self.ids, self.words = [], []
        for i, t in items:
            w = words(t)
            if len(w):
                self.ids.append(i)
                self.words.append(w)
        self.edits = [allowed(len(w), share) for w in self.words]
        pieces: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for i, (w, k) in enumerate(zip(self.words, self.edits, strict=True)):
            cuts = [len(w) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(b - a, {}).setdefault(int(rolling(w[a:b], b - a)[0]), []).append((i, a))
        self.pieces = {}
        for length, by in pieces.items():
            keys = np.array(sorted(by), np.uint64)
            hold = np.zeros(1 << 20, bool)
            hold[(keys >> np.uint64(44)).astype(np.int64)] = True
            first = np.cumsum([0] + [len(by[int(k)]) for k in keys])
            flat = [x for k in keys for x in by[int(k)]]
            self.pieces[length] = keys, hold, first, np.array([x[0] for x in flat]), np.array([x[1] for x in flat])
        self.place = np.zeros(len(self.words), np.int64)  # of an item among those of its length
        self.same: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            self.place[i] = len(self.same.setdefault(len(w), []))
            self.same[len(w)].append(i)
        self.samples: dict[tuple[int, int], np.ndarray] = {}
        self.repeats = {n: repeats_for(n, share, recall) for n in {len(w) for w in self.words}}

    def seeds(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, start) of the windows that an intact piece in h points to."""
        items, starts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for length, (keys, hold, first, item, offset) in self.pieces.items():
            r = rolling(h, length)
            at = np.flatnonzero(hold[(r >> np.uint64(44)).astype(np.int64)])
            k = np.searchsorted(keys, r[at])
            ok = keys[np.minimum(k, len(keys) - 1)] == r[at]
            at, k = at[ok], k[ok]
            n = first[k + 1] - first[k]
            which = np.repeat(first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            items.append(item[which])
            starts.append(np.repeat(at, n) - offset[which])
        return np.concatenate(items), np.concatenate(starts)

    def seen(self, n: int, repeat: int) -> np.ndarray:
        """What a repeat sees of the items of n words."""
        if (n, repeat) not in self.samples:
            self.samples[n, repeat] = sample(np.stack([self.words[i] for i in self.same[n]]), repeat)
        return self.samples[n, repeat]

    def find(self, docs: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """(document, item, edits, start, end) of the best stretch for every document and item it holds."""
        ends = np.cumsum([len(d) for d in docs])
        if not len(ends) or not ends[-1] or not self.words:
            return []
        h = np.concatenate(docs)
        item, start = self.seeds(h)
        if not len(item):
            return []
        # the document of the piece: a piece across two documents gives windows that verification drops
        # a verified stretch reaches as far as the edits to both sides, so one start a piece is enough without repeats
        k = np.array([0 if self.repeats[len(w)] is None else e for w, e in zip(self.words, self.edits, strict=True)])[item]
        spread = np.repeat(start, 2 * k + 1) + np.arange((2 * k + 1).sum()) - np.repeat(np.cumsum(2 * k + 1) - (2 * k + 1), 2 * k + 1) - np.repeat(k, 2 * k + 1)
        item = np.repeat(item, 2 * k + 1)
        pairs = np.unique(np.stack([item, spread], 1), axis=0)
        item, start = pairs[:, 0], pairs[:, 1]
        n = np.array([len(w) for w in self.words])[item]
        middle = np.clip(start + n // 2, 0, ends[-1] - 1)
        doc = np.searchsorted(ends, middle, "right")
        lo, hi = np.concatenate([[0], ends[:-1]])[doc], ends[doc]
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        for size in np.unique(n).tolist():
            rows = np.flatnonzero(n == size)
            most = max(16, min(4096, (1 << 22) // size))
            for a in range(0, len(rows), most):
                some = rows[a : a + most]
                self._verify(h, size, item[some], start[some], lo[some], hi[some], doc[some], out)
        return [(d, i, e, s, t) for (d, i), (e, s, t) in sorted(out.items())]

    def _windows(self, h: np.ndarray, start: np.ndarray, width: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        at = start[:, None] + np.arange(width)[None, :]
        inside = (at >= lo[:, None]) & (at < hi[:, None])
        return np.where(inside, h[np.clip(at, 0, len(h) - 1)], np.uint64(0))

    def _verify(self, h, n, item, start, lo, hi, doc, out) -> None:
        windows = self._windows(h, start, n, lo, hi)
        words = np.stack([self.words[i] for i in item])
        kept = (windows == words).all(1) | (self.repeats[n] is None)  # equal windows agree at every place
        left = np.flatnonzero(~kept)
        for repeat in range(self.repeats[n] or 0):
            if not len(left):
                break
            ok = (sample(windows[left], repeat) == self.seen(n, repeat)[self.place[item[left]]]).all(1)
            kept[left[ok]] = True
            left = left[~ok]
        at = np.flatnonzero(kept)
        if not len(at):
            return
        k = self.edits[item[at[0]]]
        wide = np.full(len(at), k)
        stretch = self._windows(h, start[at] - wide, n + 2 * k, lo[at], hi[at])
        edits, end = edit_distances(words[at], stretch)
        for j in np.flatnonzero(edits <= k).tolist():
            r = at[j]
            base = int(start[r]) - k - int(lo[r])
            got = int(edits[j]), max(0, int(start[r] - lo[r])), base + int(end[j])
            key = int(doc[r]), int(item[r])
            if key not in out or got < out[key]:
                out[key] = got


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The items in blocks of about block_bytes of text."""
    rows = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        some = rows.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b) if blocks > 1 else rows
        yield [(r.i, r.t) for r in some.toLocalIterator()]


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = SHARE, recall: float = RECALL) -> DataFrame:
    """Rows (id, item_id, n_words, edits, start, end): each document with each item it holds, in normalised words."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = narrow.schema["id"].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    out = None
    for block in item_blocks(items, item_col, item_text):
        shared = spark.sparkContext.broadcast(Index(block, share, recall))

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, words = shared.value, Words()
            item_type = pa.array(index.ids).type if index.ids else pa.int64()
            for batch in batches(it, "text", SCAN_BYTES):
                got = index.find([words(t) for t in batch.column(1).to_pylist()])
                cols = [
                    batch.column(0).take(pa.array([g[0] for g in got], pa.int64())),
                    pa.array([index.ids[g[1]] for g in got], item_type),
                    pa.array([len(index.words[g[1]]) for g in got], pa.int64()),
                    *(pa.array([g[c] for g in got], pa.int64()) for c in (2, 3, 4)),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["id", "item_id", "n_words", "edits", "start", "end"])

        one = narrow.mapInArrow(tidy(run), f"id {kinds[0]}, item_id {kinds[1]}, n_words long, edits long, start long, end long")
        out = one if out is None else out.unionByName(one)
    return out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = SHARE, recall: float = RECALL) -> DataFrame:
    """docs without the rows that hold an item; other rows and all columns stay as they are."""
    spark = docs.sparkSession
    names, at = docs.columns, docs.columns.index(text_col)
    for block in item_blocks(items, item_col, item_text):
        shared = spark.sparkContext.broadcast(Index(block, share, recall))

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, words = shared.value, Words()
            for batch in batches(it, text_col, SCAN_BYTES):
                held = {g[0] for g in index.find([words(t) for t in batch.column(at).to_pylist()])}
                rest = [k for k in range(batch.num_rows) if k not in held]
                yield pa.RecordBatch.from_arrays([c.take(pa.array(rest, pa.int64())) for c in batch.columns], names)

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs


def op8_cgk_decontamination(spark, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")
