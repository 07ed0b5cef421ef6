"""Byte-level BPE by length-bucketed, padded numpy matrices, and decoding.

A text is split by the tokenizer's pattern; distinct pieces of a batch are encoded together. Pieces are
bucketed by length and padded into one matrix of ids a bucket. In each round every row looks up the ranks of
its neighbouring pairs in a hashed table, merges its leftmost pair of least rank, and is compacted by one
place; rows without a ranked pair leave. That is the order in which merges are made by rank, so the ids equal
those of the tiktoken library.

A piece of over `LONG` bytes would take a round of its own length for each merge; its least pairs stand in a heap
instead, in the same order of merges.

Defined cases: a null text counts as an empty one and has no ids; pieces of any length are encoded whole (a
bucket's rows shrink as its columns grow, so memory is bounded); repeated rows are encoded alike; an empty
table gives no rows; extra columns are kept out of the result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, table, tidy

#: Pieces that a worker keeps with their ids; beyond it the store starts anew (speed only).
KEPT_PIECES = 100_000
#: Cells of a bucket's matrix.
CELLS = 1 << 18
#: Bytes of a piece from which on a heap takes the matrix's part.
LONG = 2048
NONE = np.int32(2**31 - 1)


class Merges:
    """Open-addressing table from pairs of ids to rank, in two arrays."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray):
        self.bits = max(4, int(len(pairs) * 4 - 1).bit_length())
        self.shift = np.uint64(64 - self.bits)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        left, slots = np.arange(len(pairs)), self._slot(pairs)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[slots] < 0
            at, first = np.unique(slots[free], return_index=True)
            won = left[free][first]
            self.keys[at], self.values[at] = pairs[won], ranks[won]
            lost = np.ones(len(pairs), bool)
            lost[won] = False
            keep = lost[left]
            left, slots = left[keep], (slots[keep] + 1) & ((1 << self.bits) - 1)

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, pairs: np.ndarray) -> np.ndarray:
        slot = self._slot(pairs)
        out = np.where(self.keys[slot] == pairs, self.values[slot], NONE)
        open_ = np.flatnonzero((self.keys[slot] != pairs) & (self.keys[slot] >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            s = slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            k = self.keys[s]
            hit = k == pairs[open_]
            out[open_[hit]] = self.values[s[hit]]
            open_ = open_[~hit & (k >= 0)]
        return out


class ByteBPE:
    """Encoder and decoder from lines of `base64 rank`."""

    def __init__(self, rank_lines: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_lines.splitlines() if line.strip())}
        self.size = max(self.ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        for token, i in self.ranks.items():
            self.bytes_of[i] = token
        self.find = regex.compile(pattern).findall
        self.first = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs, ranks = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append(a * self.size + b)
                    ranks.append(rank)
        self.merges = Merges(np.array(pairs, np.int64), np.array(ranks, np.int32))
        low = self.first.astype(np.int64)
        self.byte_pairs = self.merges((low[:, None] * self.size + low[None, :]).ravel())
        self.kept: dict[str, bytes] = {}
        self.spelled: dict[str, str] = {}

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece."""
        out: list[list[int]] = [[]] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            n = int(sizes[order[at]])
            if n > LONG:
                out[order[at]] = self._long(pieces[order[at]])
            if not n or n > LONG:
                at += 1
                continue
            width = 1 << (n - 1).bit_length()  # one bucket: lengths over width/2, up to width
            end = min(int(np.searchsorted(sizes[order], width, "right")), at + max(1, CELLS // width))
            rows = order[at:end]
            for i, ids in zip(rows.tolist(), self._bucket([pieces[i] for i in rows], sizes[rows], width), strict=True):
                out[i] = ids
            at = end
        return out

    def _bucket(self, pieces: list[bytes], sizes: np.ndarray, width: int) -> list[list[int]]:
        n = len(pieces)
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = self.first[flat]
        sizes = sizes.copy()
        column = np.arange(width)
        done: list = [None] * n
        live = np.arange(n)
        wide = flat.astype(np.int32)
        ranks = self.byte_pairs[(wide[:, :-1] << 8) | wide[:, 1:]] if width > 1 else np.empty((n, 0), np.int32)
        ranks[column[None, : width - 1] >= sizes[:, None] - 1] = NONE
        while len(live):
            best = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(live), np.int64)  # the first of the least: leftmost
            least = ranks[np.arange(len(live)), best] if ranks.shape[1] else np.full(len(live), NONE, np.int32)
            ended = least >= NONE
            if ended.any():
                for i in np.flatnonzero(ended):
                    done[live[i]] = ids[i, : sizes[i]].tolist()
                go = ~ended
                live, ids, sizes, ranks, best, least = live[go], ids[go], sizes[go], ranks[go], best[go], least[go]
                if not len(live):
                    break
                top = int(sizes.max())  # compaction: narrower as the longest row shrinks
                ids, ranks = ids[:, :top], ranks[:, : top - 1]
            row = np.arange(len(live))
            ids[row, best] = least
            at = np.arange(ids.shape[1] - 1)[None, :]
            after = at > best[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            if ranks.shape[1] > 1:
                late = at[:, :-1] > best[:, None]
                ranks[:, :-1] = np.where(late, ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            sizes -= 1
            for place in (best - 1, best):  # the two pairs about the merged place
                ok = (place >= 0) & (place < sizes - 1)
                r, c = row[ok], place[ok]
                ranks[r, c] = self.merges(ids[r, c].astype(np.int64) * self.size + ids[r, c + 1])
            past = (best >= sizes - 1) & (best < ranks.shape[1])
            ranks[row[past], best[past]] = NONE
        return done

    def _long(self, piece: bytes) -> list[int]:
        """Ids of a long piece: the leftmost pair of least rank comes from a heap of rank and place."""
        n, token, rank = len(piece), self.bytes_of, self.ranks.get
        ids = [*self.first[np.frombuffer(piece, np.uint8)].tolist(), -1]
        after, before = [*range(1, n + 1), n], list(range(-1, n))
        raw = np.frombuffer(piece, np.uint8).astype(np.int64)
        pair = np.append(self.byte_pairs[(raw[:-1] << 8) | raw[1:]], [NONE, NONE])
        now = pair.tolist()  # rank of the pair that begins at a place
        heap = [(r, i) for i, r in enumerate(now) if r < NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if now[i] != r:
                continue
            j = after[i]
            ids[i], ids[j], now[j] = r, -1, NONE
            after[i] = k = after[j]
            before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0:
                    got = rank(token[ids[a]] + token[ids[b]]) if b < n else None
                    now[a] = NONE if got is None else got
                    if got is not None:
                        heapq.heappush(heap, (got, a))
        return [i for i in ids if i >= 0]

    def learn(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text, all of them in `kept` afterwards."""
        pieces = [self.find(t) for t in texts]
        if len(self.kept) > KEPT_PIECES:
            self.forget()
        new: set[str] = set()
        for p in pieces:
            new.update(p)
        fresh = list(new.difference(self.kept))
        for piece, ids in zip(fresh, self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in fresh]), strict=True):
            self.kept[piece] = np.array(ids, np.int32).tobytes()
            self.spelled[piece] = " ".join(map(str, ids))
        return pieces

    def forget(self) -> None:
        """Drop the pieces kept."""
        self.kept.clear()
        self.spelled.clear()

    def ids_of(self, pieces: list[str]) -> np.ndarray:
        """Ids of pieces that are kept, one after the other."""
        return np.frombuffer(b"".join(map(self.kept.__getitem__, pieces)), np.int32)

    def encode(self, text: str | None) -> list[int]:
        return self.ids_of(self.learn([text or ""])[0]).tolist()

    def decode(self, ids) -> bytes:
        """Bytes of ids; an id without a token raises."""
        out = []
        for i in ids:
            if not 0 <= i < self.size or not self.bytes_of[i]:
                raise ValueError(f"no token has id {i}")
            out.append(self.bytes_of[i])
        return b"".join(out)


def tokenizer_file(name_or_path: str) -> bytes:
    with open(name_or_path, "rb") as f:
        return f.read()


_CODECS: dict[tuple, ByteBPE] = {}


def codec(path: str, pattern: str) -> ByteBPE:
    """One codec a worker process."""
    key = path, pattern
    if key not in _CODECS:
        _CODECS[key] = ByteBPE(tokenizer_file(path), pattern)
    return _CODECS[key]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256[, ids array<int>]) of whole texts.

    ids_sha256 is over the decimal ids joined by a space; decoded_sha256 over the bytes that decoding the
    ids gives back. No shuffle: each partition of the scan is encoded where it is read.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        try:
            for batch in batches(it, "text", 2 << 20):
                yield coded(bpe, batch)
        finally:
            bpe.forget()

    def coded(bpe: ByteBPE, batch: pa.RecordBatch) -> pa.RecordBatch:
        sha, spelled, token = hashlib.sha256, bpe.spelled.__getitem__, bpe.bytes_of.__getitem__
        each, spellings, decoded = [], [], []
        for found in bpe.learn([t or "" for t in batch.column(1).to_pylist()]):
            ids = bpe.ids_of(found)
            each.append(ids)
            spellings.append(sha(" ".join(map(spelled, found)).encode()).hexdigest())
            decoded.append(sha(b"".join(map(token, ids.tolist()))).hexdigest())
        counts = np.array([len(x) for x in each], np.int64)
        cols = [batch.column(0), pa.array(counts), pa.array(spellings, pa.string()), pa.array(decoded, pa.string())]
        names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(each))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names)

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(tidy(run), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode_documents(coded: DataFrame, path: str, pattern: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, raw binary): the bytes of arrays of ids; a null array gives null."""

    def run(it):
        bpe = codec(path, pattern)
        for batch in it:
            raw = [None if ids is None else bpe.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["id", "raw"])

    narrow = coded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return narrow.mapInArrow(tidy(run), f"id {narrow.schema['id'].dataType.simpleString()}, raw binary")


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False).withColumnRenamed("id", "doc_id")
