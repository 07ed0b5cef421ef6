"""Removal of repeated fixed-length word windows, by Rabin-Karp hashes counted in Spark.

Every window of `width` consecutive words gets a 64-bit Rabin-Karp hash over word hashes, plus the number of
its bucket, which comes from a second base, so equal windows meet in one bucket and two different windows
pass for equal only when both agree (64 bits and log2(buckets) more). A shuffle brings the hashes of a bucket
together, packed in arrays; those that occur more than once are marked; the marks travel back to their
documents, where marked windows merge into maximal intervals of words to remove. Windows that repeat within a batch of
texts are marked there, and only the first of them is sent, so a very common window reaches its bucket once a batch.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. Defined cases: null and empty texts have no
words; texts under `width` words lose nothing; a window repeated inside one document counts; rows that repeat
an id, with the same or another text, are documents of their own; an empty table gives no rows; other columns of the input don't
matter. A very common window is at most one entry a batch in one array, never many rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, batches, groups, partitions_for, rolling, table, tidy

WIDTH = 35
#: Bytes of text hashed together; a bucket gets one row from each such batch.
BATCH_BYTES = 8 << 20
SECOND = 0x2545F4914F6CDD1D


def _buckets(docs: DataFrame, mb: int = 2) -> int:
    n = partitions_for(docs.sparkSession, docs, mb)
    return max(64, 1 << (n - 1).bit_length())


def removal_intervals(docs: DataFrame, width: int = WIDTH, buckets: int | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(id, h, cuts) for rows of docs (id, h, text) that lose words; cuts: int32 pairs [start, end) of words."""
    buckets = buckets or _buckets(docs)
    small = np.uint8 if buckets <= 256 else np.uint16 if buckets <= 65536 else np.uint32
    shift = np.uint64(64 - (buckets - 1).bit_length()) if buckets > 1 else np.uint64(63)
    id_type = docs.schema["id"].dataType.simpleString()

    def hash_windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, count = WordHashes(), 0
        part = TaskContext.get().partitionId()
        for batch in batches(it, "text", batch_bytes):
            lengths, keys, seconds = [], [], []
            for t in batch.column(2):
                words = t.as_buffer().to_pybytes().split() if t.is_valid else []
                lengths.append(max(0, len(words) - width + 1))
                if lengths[-1]:
                    h = hashes(words)
                    keys.append(rolling(h, width))
                    seconds.append(rolling(h, width, SECOND) >> shift)
            if not keys:
                continue
            uid = (part << 32) | count
            count += 1
            key, bucket = np.concatenate(keys), np.concatenate(seconds).astype(small)
            sent, local = once(key, bucket)
            key, bucket = key[sent], bucket[sent]
            order = np.argsort(bucket, kind="stable")
            sizes = np.bincount(bucket, minlength=buckets)
            ends = np.cumsum(sizes)
            key = key[order]
            has = np.flatnonzero(sizes)
            blobs = [key[ends[b] - sizes[b] : ends[b]].tobytes() for b in has]
            n = len(blobs)
            no = pa.nulls(n, pa.binary())
            meta = [pa.concat_arrays([no, pa.array([a.tobytes()], pa.binary())]) for a in (np.array(lengths, np.int32), np.packbits(sent), np.packbits(local))]
            kind = batch.column(0).type
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(has, -1 - (uid * 7919 + 1) % 1_000_003).astype(np.int64)),
                    pa.array(np.full(n + 1, uid, np.int64)),
                    pa.array([*blobs, bucket.tobytes()], pa.binary()),
                    *meta,
                    pa.array([None] * n + [batch.column(0).to_pylist()], pa.list_(kind)),
                    pa.array([None] * n + [batch.column(1).to_pylist()], pa.list_(pa.int64())),
                ],
                ["bucket", "uid", "blob", "lengths", "sent", "local", "ids", "hs"],
            )

    packed = f"bucket long, uid long, blob binary, lengths binary, sent binary, local binary, ids array<{id_type}>, hs array<long>"

    def mark(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), rows in groups(it, ["bucket"]):
            if bucket >= 0:
                blobs = [np.frombuffer(b.as_buffer(), np.uint64) for b in rows.column("blob")]
                key = np.concatenate(blobs)
                order = np.argsort(key)
                ranked = key[order]
                same = np.zeros(len(key) + 1, bool)
                np.equal(ranked[1:], ranked[:-1], out=same[1:-1])
                flag = np.zeros(len(key), bool)
                flag[order] = same[1:] | same[:-1]
                cuts = np.cumsum([len(b) for b in blobs])[:-1]
                masks = [np.packbits(f).tobytes() for f in np.split(flag, cuts)]
                at = rows.schema.get_field_index("blob")
                rows = rows.set_column(at, rows.schema.field(at), pa.array(masks, pa.binary()))
            yield from rows.to_batches()

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(it, ["uid"]):
            masks, info = {}, None
            for b, blob in zip(rows.column("bucket").to_pylist(), rows.column("blob"), strict=True):
                if b >= 0:
                    masks[b] = np.frombuffer(blob.as_buffer(), np.uint8)
                else:
                    bucket = np.frombuffer(blob.as_buffer(), small)
            info = rows.slice(0, 1)
            order = np.argsort(bucket, kind="stable")
            sizes = np.bincount(bucket, minlength=buckets)
            ends = np.cumsum(sizes)
            marked = np.zeros(len(bucket), bool)
            for b, m in masks.items():
                marked[order[ends[b] - sizes[b] : ends[b]]] = np.unpackbits(m, count=sizes[b])
            lengths = np.frombuffer(info.column("lengths")[0].as_buffer(), np.int32)
            sent, flag = (np.unpackbits(np.frombuffer(info.column(c)[0].as_buffer(), np.uint8), count=lengths.sum()).astype(bool) for c in ("sent", "local"))
            flag[sent] |= marked
            ids, hs = info.column("ids")[0].as_py(), info.column("hs")[0].as_py()
            out = [], [], []
            at = 0
            for i, h, n in zip(ids, hs, lengths.tolist(), strict=True):
                f = flag[at : at + n]
                at += n
                if f.any():
                    out[0].append(i)
                    out[1].append(h)
                    out[2].append(intervals(f, width).tobytes())
            kind = rows.schema.field("ids").type.value_type
            yield pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["id", "h", "cuts"])

    tasks = partitions_for(docs.sparkSession, docs, 8)
    hashed = docs.mapInArrow(tidy(hash_windows), packed).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    marked = hashed.mapInArrow(tidy(mark), packed).repartition(tasks, "uid").sortWithinPartitions("uid", "bucket")
    return marked.mapInArrow(tidy(merge), f"id {id_type}, h long, cuts binary").distinct()


def once(key: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a batch's windows: which are sent (one of each), and which occur more than once here."""
    order = np.argsort(key)
    k, b = key[order], bucket[order]
    again = np.zeros(len(k) + 1, bool)
    again[1:-1] = (k[1:] == k[:-1]) & (b[1:] == b[:-1])
    sent, local = np.empty(len(k), bool), np.empty(len(k), bool)
    sent[order] = ~again[:-1]
    local[order] = again[:-1] | again[1:]
    return sent, local


def intervals(flag: np.ndarray, width: int) -> np.ndarray:
    """Maximal intervals [start, end) of what the flagged windows cover, as an array of pairs."""
    step = np.zeros(len(flag) + width + 1, np.int32)
    at = np.flatnonzero(flag)
    step[at] += 1
    np.subtract.at(step, at + width, 1)
    covered = np.cumsum(step) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]])))
    return edge.astype(np.int32)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, buckets: int | None = None, with_text: bool = True, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Rows (id, n_words, n_removed, cuts, kept_sha256[, kept]) of every document; kept: remaining words joined by a space."""
    narrow = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    id_type = narrow.schema["id"].dataType.simpleString()
    cuts = removal_intervals(narrow, width, buckets, batch_bytes).select(F.col("id").alias("cut_id"), F.col("h").alias("cut_h"), "cuts")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "text"):
            n_words, n_removed, shas, texts = [], [], [], []
            for t, c in zip(batch.column(1), batch.column(2), strict=True):
                words = t.as_buffer().to_pybytes().split() if t.is_valid else []
                n_words.append(len(words))
                if c.is_valid:
                    pairs = np.frombuffer(c.as_buffer(), np.int32).reshape(-1, 2)
                    keep, at = [], 0
                    for a, b in pairs.tolist():
                        keep += words[at:a]
                        at = b
                    words = keep + words[at:]
                n_removed.append(n_words[-1] - len(words))
                kept = b" ".join(words)
                shas.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode())
            cols = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), batch.column(2), pa.array(shas, pa.string())]
            names = ["id", "n_words", "n_removed", "cuts", "kept_sha256"]
            if with_text:
                cols.append(pa.array(texts, pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names)

    joined = narrow.join(cuts.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("cut_id")) & (F.col("h") == F.col("cut_h")), "left").select("id", "text", "cuts")
    return joined.mapInArrow(tidy(cut), f"id {id_type}, n_words long, n_removed long, cuts binary, kept_sha256 string" + ", kept string" * with_text)


def op6_repeated_windows(spark, sf_dir: str) -> DataFrame:
    got = remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return got.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


#: DuckDB SQL for op6's rows.
OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), spans AS (
  SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 33))) AS i FROM w)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS c FROM spans) WHERE c > 1
), gone AS (
  SELECT DISTINCT doc_id, i + unnest(range(0, 35)) AS p FROM rep
), word AS (
  SELECT doc_id, p, words[p] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM w)
), kept AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS kept FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
