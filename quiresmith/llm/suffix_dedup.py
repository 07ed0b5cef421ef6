"""Removal of repeated byte strings, judged by suffix arrays.

A byte goes if a string of `LENGTH` bytes over it also starts earlier: in a document before (by id), or in the
same document before. Comparing every such string needs every suffix of the corpus in one order; instead the
corpus is cut into small pieces that can be compared alone, without loss:

1. Anchors. Of the `GRAM`-byte strings inside a window of LENGTH bytes, the one of least hash (leftmost of equals)
   is the window's anchor. Equal windows have equal anchors at equal places, so windows need comparing only
   among those of one anchor string. Windows that follow each other mostly share theirs: an anchor with its run of
   windows is a context of some 130 bytes.
2. A shuffle of packed hashes finds anchors that occur once (nothing repeats there), contexts that equal an
   earlier one (all of it goes), and first contexts of an anchor that has several; only those move as text. Copies
   within a batch of texts are told there, and the earliest alone is sent: a hot context is one entry a batch.
3. The contexts of an anchor are joined, each ended by a mark of its own, and their suffix array is built by
   linear grouping (see suffix_array). Windows that are neighbours in it and agree in LENGTH bytes are equal; all
   but the earliest go.

An anchor with over `MOST` different contexts isn't gathered: its windows' hashes (two of 64 bits) travel packed as the
anchors' did and are judged in the same way, so no group is large however common a passage is. A context none of whose
windows has the hash of another's is left out of the suffix array; nothing in it repeats.

Defined cases: null and empty texts have no bytes; matches never cross documents; texts under LENGTH bytes lose
nothing; rows equal in id and text count as one document and get the same result; a null id comes before all
others; texts that share an id count as one document cut at unspecified places; ids must be integers; an empty table
gives no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, discard, groups, materialise, mix, partitions_for, rolling, table, tidy
from .suffix_array import suffix_array

LENGTH, GRAM, MOST, SEGMENT = 100, 50, 4096, 1 << 20
SECOND = 0x2545F4914F6CDD1D
BYTE = mix(np.arange(1, 257, dtype=np.uint64))
LOW = np.uint64((1 << 24) - 1)


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash, place, first, last, context hash) of each anchor: it is that of the windows starting at first..last."""
    n = len(raw)
    got: list[tuple] = []
    for a in range(0, max(0, n - length + 1), SEGMENT):
        got.append(_anchors(raw[a : a + SEGMENT + length - 1], a, length, gram))
    if not got:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)), np.empty(0, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*got, strict=True)) if len(got) > 1 else got[0]


def _anchors(raw: bytes, base: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    h = rolling(BYTE[np.frombuffer(raw, np.uint8)], gram)
    m = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
    span, width = 1, length - gram + 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
    at = (m & LOW).astype(np.int64)
    cut = np.flatnonzero(np.diff(at)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1
    place = at[first]
    # the context: its ends by two rolling hashes of windows, its length and the anchor's place in it
    w = rolling(BYTE[np.frombuffer(raw, np.uint8)], length)
    context = mix(w[first] ^ mix(w[last] + (last - first).astype(np.uint64))) ^ mix((place - first).astype(np.uint64) + np.uint64(7))
    return h[place], place + base, first + base, last + base, context


SINGLE, COPY, ALONE, COMPARE = 0, 1, 2, 3


def judge(key: np.ndarray, context: np.ndarray, doc: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
    """For each anchor of a bucket: SINGLE, COPY of an earlier context, or first context, ALONE or to COMPARE.

    Without place, the entries of a document stand in ascending order already.
    """
    order = np.lexsort((doc, context, key) if place is None else (place, doc, context, key))  # stable
    k, c = key[order], context[order]
    new_key = np.concatenate([[True], k[1:] != k[:-1]])
    new = new_key | np.concatenate([[True], c[1:] != c[:-1]])
    group = np.cumsum(new_key) - 1
    size, kinds = np.bincount(group), np.bincount(group, new)
    state = np.where(size[group] == 1, SINGLE, np.where(~new, COPY, np.where(kinds[group] == 1, ALONE, COMPARE)))
    out = np.empty(len(key), np.uint8)
    out[order] = state
    return out


def earliest(key: np.ndarray, context: np.ndarray, doc: np.ndarray, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of a batch's anchors: which are the earliest of an equal context, and which of these have copies in the batch."""
    order = np.lexsort((doc, context, key) if place is None else (place, doc, context, key))  # stable
    k, c = key[order], context[order]
    new = np.ones(len(k) + 1, bool)
    new[1:-1] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    sent, several = np.empty(len(k), bool), np.empty(len(k), bool)
    sent[order] = new[:-1]
    several[order] = new[:-1] & ~new[1:]
    return sent, several


def states(docs: DataFrame, length: int, gram: int, buckets: int, batch_bytes: int, windows: bool = False) -> DataFrame:
    """(id, h, start, states) of the rows (id, h, start, text) that have an anchor found elsewhere; one byte an anchor.

    With windows, texts are contexts that begin at `start` of their document, and every window takes an anchor's part.
    """
    shift = np.uint64(64 - (buckets - 1).bit_length())
    small = np.uint8 if buckets <= 256 else np.uint16 if buckets <= 65536 else np.uint32

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        for batch in batches(it, "text", batch_bytes):
            raws = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(2)]
            if windows:
                codes = [BYTE[np.frombuffer(r, np.uint8)] for r in raws]
                found = [(rolling(c, length), None, None, None, rolling(c, length, SECOND)) for c in codes]
            else:
                found = [anchors(r, length, gram) for r in raws]
            sizes = np.array([len(f[0]) for f in found], np.int64)
            if not sizes.sum():
                continue
            ids = np.array([-(1 << 63) if i is None else i for i in batch.column(0).to_pylist()], np.int64)
            key, context, doc = np.concatenate([f[0] for f in found]), np.concatenate([f[4] for f in found]), np.repeat(ids, sizes)
            entries = [key, context, doc]
            if windows:
                start = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
                entries.append(np.repeat(start - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum()))
            sent, several = earliest(*entries)
            entries = [x[sent] for x in entries]
            bucket = (mix(entries[0]) >> shift).astype(small)
            order = np.argsort(bucket, kind="stable")
            n = np.bincount(bucket, minlength=buckets)
            ends, has = np.cumsum(n), np.flatnonzero(n)
            entries = [x[order] for x in entries]
            blobs = [b"".join(x[ends[b] - n[b] : ends[b]].tobytes() for x in entries) for b in has]
            uid = (part << 32) | count
            count += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(has, -1 - (uid * 7919) % 1_000_003).astype(np.int64)),
                    pa.array(np.full(len(has) + 1, uid, np.int64)),
                    pa.array([*blobs, bucket.tobytes()], pa.binary()),
                    pa.array([None] * len(has) + [np.packbits(sent).tobytes()], pa.binary()),
                    pa.array([None] * len(has) + [np.packbits(several).tobytes()], pa.binary()),
                    pa.array([None] * len(has) + [sizes.tolist()], pa.list_(pa.int64())),
                    pa.array([None] * len(has) + [batch.column(0).to_pylist()], pa.list_(pa.int64())),
                    pa.array([None] * len(has) + [batch.column(1).to_pylist()], pa.list_(pa.int64())),
                    pa.array([None] * len(has) + [batch.column(3).to_pylist()], pa.list_(pa.int32())),
                ],
                ["bucket", "uid", "blob", "sent", "several", "sizes", "ids", "hs", "starts"],
            )

    packed = "bucket long, uid long, blob binary, sent binary, several binary, sizes array<long>, ids array<long>, hs array<long>, starts array<int>"

    def mark(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), rows in groups(it, ["bucket"]):
            if bucket >= 0:
                parts = [np.frombuffer(b.as_buffer(), np.uint64).reshape(3 + windows, -1) for b in rows.column("blob")]
                whole = np.concatenate(parts, axis=1)
                state = judge(whole[0], whole[1], *(x.view(np.int64) for x in whole[2:]))
                cuts = np.cumsum([p.shape[1] for p in parts])[:-1]
                at = rows.schema.get_field_index("blob")
                rows = rows.set_column(at, rows.schema.field(at), pa.array([s.tobytes() for s in np.split(state, cuts)], pa.binary()))
            yield from rows.to_batches()

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(it, ["uid"]):
            bucket = np.frombuffer(rows.column("blob")[0].as_buffer(), small)  # the row of the batch itself is first
            got = [np.frombuffer(b.as_buffer(), np.uint8) for b in rows.column("blob").slice(1)]
            judged = np.empty(len(bucket), np.uint8)
            judged[np.argsort(bucket, kind="stable")] = np.concatenate(got)
            total = sum(rows.column("sizes")[0].as_py())
            sent, several = (np.unpackbits(np.frombuffer(rows.column(c)[0].as_buffer(), np.uint8), count=total).astype(bool) for c in ("sent", "several"))
            state = np.full(total, COPY, np.uint8)
            state[sent] = judged
            state[several & (state == SINGLE)] = ALONE
            out, at = ([], [], [], []), 0
            for i, h, a, n in zip(*(rows.column(c)[0].as_py() for c in ("ids", "hs", "starts", "sizes")), strict=True):
                s = state[at : at + n]
                at += n
                if (s != SINGLE).any():
                    out[0].append(i)
                    out[1].append(h)
                    out[2].append(a)
                    out[3].append(s.tobytes())
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["id", "h", "start", "states"])

    def once(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for rows equal in id and text: what is first in any of them is first."""
        for batch in it:
            lists = batch.column(3)
            best = [np.max([np.frombuffer(x.as_buffer(), np.uint8) for x in one.values], axis=0).tobytes() if len(one) > 1 else one.values[0].as_py() for one in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(best, pa.binary())], ["id", "h", "start", "states"])

    tasks = partitions_for(docs.sparkSession, docs, 8)
    hashed = docs.mapInArrow(tidy(pack), packed).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    marked = hashed.mapInArrow(tidy(mark), packed).repartition(tasks, "uid").sortWithinPartitions("uid", "bucket")
    each = marked.mapInArrow(tidy(merge), "id long, h long, start int, states binary")
    return each.groupBy("id", "h", "start").agg(F.collect_set("states").alias("all")).mapInArrow(tidy(once), "id long, h long, start int, states binary")


def contexts(docs: DataFrame, known: DataFrame, length: int, gram: int) -> DataFrame:
    """(id, h, cuts, found): int32 pairs of bytes that go, and the contexts to compare, of documents in known."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "text"):
            cuts, found = [], []
            for t, s in zip(batch.column(2), batch.column(3), strict=True):
                raw, state = t.as_buffer().to_pybytes(), np.frombuffer(s.as_buffer(), np.uint8)
                key, place, first, last, _ = anchors(raw, length, gram)
                gone = state == COPY
                cuts.append(np.stack([first[gone], last[gone] + length], 1).astype(np.int32).tobytes())
                todo = np.flatnonzero(state == COMPARE)
                found.append([{"key": k, "start": a, "anchor": p, "raw": raw[a : b + length]} for k, a, b, p in zip(key[todo].astype(np.int64).tolist(), first[todo].tolist(), last[todo].tolist(), place[todo].tolist(), strict=True)])
            kind = pa.list_(pa.struct([("key", pa.int64()), ("start", pa.int32()), ("anchor", pa.int32()), ("raw", pa.binary())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cuts, pa.binary()), pa.array(found, kind)], ["id", "h", "cuts", "found"])

    other = known.select(F.col("id").alias("kid"), F.col("h").alias("kh"), "states")
    both = docs.join(other.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("kid")) & (F.col("h") == F.col("kh"))).select("id", "h", "text", "states")
    return both.mapInArrow(tidy(run), "id long, h long, cuts binary, found array<struct<key:long,start:int,anchor:int,raw:binary>>")


def repeated_windows(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its windows of `length` bytes start earlier too; parts stand in their order."""
    joined: list[int] = []
    m = len(parts)
    for k, raw in enumerate(parts):
        joined += [b + m for b in raw]
        joined.append(k)
    sizes = np.array([len(p) for p in parts])
    home = np.repeat(np.arange(m), sizes + 1)
    starts = np.cumsum(sizes + 1) - sizes - 1
    order = np.array(suffix_array(joined))
    inside = order - starts[home[order]]
    order = order[inside <= sizes[home[order]] - length]  # suffixes that begin a whole window
    out = [np.zeros(s - length + 1, bool) for s in sizes]
    text = np.array(joined, np.int32)
    if len(order) < 2:
        return out
    same = np.empty(len(order) - 1, bool)
    for a in range(0, len(same), 4096):
        x, y = order[a : a + 4096][: len(same) - a], order[a + 1 : a + 4097]
        same[a : a + 4096] = (text[x[:, None] + np.arange(length)] == text[y[:, None] + np.arange(length)]).all(1)
    run = np.concatenate([[0], np.cumsum(~same)])
    least = np.full(run[-1] + 1, len(text))
    np.minimum.at(least, run, order)
    for i in order[order != least[run]].tolist():
        k = int(home[i])
        out[k][i - int(starts[k])] = True
    return out


def compare(rows: DataFrame, length: int, tasks: int, most: int) -> DataFrame:
    """rows (key, id, h, start, anchor, raw) -> the same with cuts: int32 pairs, or null where the group is too large."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, large in _streams(it, most):
            table_ = pa.Table.from_batches(held)
            start = table_.column("start").to_pylist()
            raw = table_.column("raw").to_pylist()
            if large:
                cuts = [None] * len(raw)
            else:
                cuts = _cuts(table_.column("id").to_pylist(), table_.column("h").to_pylist(), start, raw, length)
            none = [k for k, c in enumerate(cuts) if c == b""]
            if len(none) < len(cuts):
                keep = pa.array([k for k, c in enumerate(cuts) if c != b""], pa.int64())
                slim = raw if large else [b""] * len(raw)
                out = table_.set_column(table_.schema.get_field_index("raw"), "raw", pa.array(slim, pa.binary())).append_column("cuts", pa.array(cuts, pa.binary())).take(keep)
                yield from out.combine_chunks().to_batches()

    dealt = rows.repartition(tasks, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(tidy(run), "key long, id long, h long, start int, anchor int, raw binary, cuts binary")


def _streams(it: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[pa.RecordBatch], bool]]:
    """Groups of one key, whole if of at most `most` rows; larger ones in parts, marked."""
    key, held, n, large = None, [], 0, False
    for batch in it:
        keys = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b == a:
                continue
            if keys[a] != key:
                if held:
                    yield held, large
                key, held, n, large = keys[a], [], 0, False
            held.append(batch.slice(a, b - a))
            n += b - a
            if n > most:
                large = True
                yield held, True
                held = []
    if held:
        yield held, large


def _cuts(ids: list, hs: list, starts: list[int], raws: list[bytes], length: int) -> list[bytes]:
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, hs[k], starts[k]))
    first: dict[bytes, int] = {}
    out = [b""] * len(ids)
    for k in order:
        if raws[k] in first:  # equal contexts: all of the later one goes
            if (ids[k], hs[k], starts[k]) != (ids[first[raws[k]]], hs[first[raws[k]]], starts[first[raws[k]]]):
                out[k] = np.array([starts[k], starts[k] + len(raws[k])], np.int32).tobytes()
        else:
            first[raws[k]] = k
    some = _sharing(raws, list(first.values()), length)
    if len(some) > 1:
        for k, gone in zip(some, repeated_windows([raws[k] for k in some], length), strict=True):
            if gone.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]))).reshape(-1, 2)
                out[k] = (edge + [0, length - 1] + starts[k]).astype(np.int32).tobytes()
    return out


def _sharing(raws: list[bytes], some: list[int], length: int) -> list[int]:
    """Those contexts that have a window whose hash another window has too."""
    hashes = [rolling(BYTE[np.frombuffer(raws[k], np.uint8)], length) for k in some]
    flat = np.concatenate(hashes)
    order = np.argsort(flat)
    same = flat[order[1:]] == flat[order[:-1]]
    hit = np.zeros(len(flat), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    owner = np.repeat(np.arange(len(some)), [len(h) for h in hashes])
    return [some[k] for k in np.unique(owner[hit]).tolist()]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST, buckets: int | None = None, batch_bytes: int = 8 << 20, with_bytes: bool = True) -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) of every document."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    tasks = partitions_for(spark, narrow, 8)
    buckets = buckets or max(64, 1 << (partitions_for(spark, narrow, 8) - 1).bit_length())
    known = materialise(states(narrow.select("id", "h", "text", F.lit(0).alias("start")), length, gram, buckets, batch_bytes), "states")
    found = materialise(contexts(narrow, known, length, gram), "contexts")
    discard(known)
    rows = found.select("id", "h", F.explode("found").alias("c")).select("c.key", "id", "h", "c.start", "c.anchor", "c.raw")
    done = materialise(compare(rows, length, tasks, most), "compared")
    cuts = [found.where(F.length("cuts") > 0).select("id", "h", "cuts"), done.where("cuts is not null").select("id", "h", "cuts")]
    large = done.where("cuts is null").select("id", "h", F.col("raw").alias("text"), "start")
    cuts.append(_copies(states(large, length, gram, buckets, batch_bytes, windows=True), length))
    every = cuts[0]
    for c in cuts[1:]:
        every = every.unionByName(c)
    gone = every.groupBy("id", "h").agg(F.collect_list("cuts").alias("cuts")).select(F.col("id").alias("kid"), F.col("h").alias("kh"), "cuts")
    both = narrow.join(gone.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("kid")) & (F.col("h") == F.col("kh")), "left").select("id", "text", "cuts")
    return both.mapInArrow(tidy(lambda it: _apply(it, with_bytes)), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes)


def _copies(judged: DataFrame, length: int) -> DataFrame:
    """(id, h, cuts): runs of windows that are copies."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            cuts = []
            for a, s in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                gone = np.frombuffer(s.as_buffer(), np.uint8) == COPY
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]))).reshape(-1, 2)
                cuts.append((edge + [0, length - 1] + a).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cuts, pa.binary())], ["id", "h", "cuts"])

    return judged.mapInArrow(tidy(run), "id long, h long, cuts binary").where(F.length("cuts") > 0)


def _apply(it: Iterator[pa.RecordBatch], with_bytes: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches(it, "text"):
        out: tuple = ([], [], [], [], [])
        for t, lists in zip(batch.column(1), batch.column(2), strict=True):
            raw = t.as_buffer().to_pybytes() if t.is_valid else b""
            kept, removed, spans = raw, 0, 0
            if lists.is_valid:
                pairs = np.concatenate([np.frombuffer(c.as_buffer(), np.int32).reshape(-1, 2) for c in lists.values])
                step = np.bincount(pairs[:, 0], minlength=len(raw) + 1) - np.bincount(pairs[:, 1], minlength=len(raw) + 1)
                gone = np.cumsum(step)[:-1] > 0
                removed, spans = int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            for c, v in zip(out, (len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                c.append(v)
        cols = [batch.column(0), *(pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))]
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        yield pa.RecordBatch.from_arrays(cols[: 5 + with_bytes], names[: 5 + with_bytes])


def op4_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_bytes=False).withColumnRenamed("id", "doc_id")
