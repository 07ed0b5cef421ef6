"""Minimax contiguous partition of documents into shards, by DataFrame functions only.

Rows of equal text are one atomic group; groups stand in the order of the SHA-256 of their text. The least
capacity C for which a greedy pass over the ordered group sizes fills at most k shards is found by binary
search, and the order is cut where that pass cuts. The driver sees totals of at most `width` key ranges at a
time, never the groups: ranges that a cut could fall in are divided further until each holds one group, so
the capacity and the cuts are the exact ones.

Defined cases: a null text has no bytes (size 1) and forms a group of its own; an empty text likewise; repeated rows and
equal texts stay together; an empty table gives no rows; with fewer groups than shards some shards are empty;
extra columns of the input aren't looked at. One group larger than total/k sets the capacity by itself.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise

HEX = 64


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, size, text_crc32): key orders the groups; null texts come first."""
    text = F.col(text_col)
    raw = F.encode(text, "utf-8")
    return docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.sha2(raw, 256), F.lit("0" * HEX)).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(raw, F.encode(F.lit(""), "utf-8"))).cast("long").alias("text_crc32"),
    )


def _greedy(total: int, k: int, capacity: int, reach) -> list[int] | None:
    """Ends of the shards in bytes, or None if k shards of this capacity don't hold everything."""
    ends, at = [], 0
    for _ in range(k):
        at = reach(at + capacity, at)
        ends.append(at)
    return ends if at >= total else None


def _least(lo: int, hi: int, total: int, k: int, reach) -> int:
    """Least feasible capacity in lo..hi, hi being feasible."""
    while lo < hi:
        mid = (lo + hi) // 2
        if _greedy(total, k, mid, reach) is not None:
            hi = mid
        else:
            lo = mid + 1
    return lo


def minimax_cuts(groups: DataFrame, shards: int, width: int = 4096) -> list[str]:
    """First keys of the shards after the first (`shards - 1` of them; "~" where no group is left).

    groups: (key, size), any number of rows for a key. width bounds what one round brings to the driver,
    but for a factor of 16.
    """
    digits = 1
    while 16 ** (digits + 1) <= width:
        digits += 1

    def ranges(df: DataFrame, n: int) -> list[tuple[str, int, bool]]:
        got = df.groupBy(F.substring("key", 1, n).alias("p")).agg(F.sum("size").alias("s"), F.min("key").alias("a"), F.max("key").alias("b"))
        return sorted((r.a if r.a == r.b else r.p, r.s, r.a == r.b) for r in got.toLocalIterator())

    parts = ranges(groups, digits)
    total = sum(s for _, s, _ in parts)
    if not total:
        return ["~"] * (shards - 1)
    while True:
        starts, opens = [0], []
        for _, s, alone in parts:
            opens.append(not alone)
            starts.append(starts[-1] + s)

        def low(x: int, at: int, starts=starts) -> int:
            """Where a pass certainly can cut: ends of known ranges only."""
            return max(at, starts[bisect_right(starts, x) - 1])

        def high(x: int, at: int, starts=starts, opens=opens) -> int:
            """Where it could cut at best: anywhere within a range that isn't one group."""
            i = bisect_right(starts, x) - 1
            return max(at, starts[i] if i >= len(opens) or not opens[i] else x)

        hi = _least(0, total, total, shards, low)
        lo = _least(0, hi, total, shards, high)
        want: set[int] = set()
        worst = best = 0
        for _ in range(shards):
            worst, best = low(worst + lo, worst), min(total, high(best + hi, best))
            first = max(0, bisect_right(starts, worst) - 1)
            last = min(len(parts) - 1, bisect_right(starts, best) - 1)
            want.update(i for i in range(first, last + 1) if opens[i])
        if not want:
            ends = _greedy(total, shards, hi, low)
            return [parts[i][0] if (i := bisect_right(starts, e) - 1) < len(parts) else "~" for e in ends[:-1]]
        digits, size = digits + 1, len(want) * 16
        while size * 16 <= width and digits < HEX:  # few ranges: divide them further at once
            digits, size = digits + 1, size * 16
        lengths: dict[int, list[str]] = {}
        for i in want:
            lengths.setdefault(len(parts[i][0]), []).append(parts[i][0])
        chosen = F.lit(False)
        for n, prefixes in sorted(lengths.items()):
            chosen = chosen | F.substring("key", 1, n).isin(prefixes)
        inside = groups.where(chosen)
        finer = ranges(inside, digits)
        parts = sorted([x for i, x in enumerate(parts) if i not in want] + finer)


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", width: int = 4096, buckets: int = 256) -> DataFrame:
    """Rows (id, key, size, text_crc32, shard, slot); slots are gapless from 0 in each shard.

    Shards differ in bytes by no more than the atomic groups force: the largest is as small as contiguous
    cuts allow. A slot is the row's place in its shard by (hash bucket of id and key, id): buckets are numbered
    apart and offset by the counts of those before, so neither a shard nor a hot group is sorted in one task.
    """
    rows = materialise(sized(docs, id_col, text_col), "sized")
    groups = materialise(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    cuts = minimax_cuts(groups, shards, width)
    discard(groups)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("key") >= F.lit(c)).cast("int")
    placed = rows.select("*", shard.alias("shard"), F.pmod(F.xxhash64("id", "key"), F.lit(buckets)).cast("int").alias("bucket"))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    # before has at most shards * buckets rows, whatever the input
    numbered = placed.withColumn("place", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(F.col("id").asc_nulls_first(), "key")).cast("long"))
    return numbered.join(F.broadcast(before), ["shard", "bucket"]).select("id", "key", "size", "text_crc32", "shard", (F.col("before") + F.col("place") - 1).alias("slot"))


def op2_minimax_sharding(spark, sf_dir: str) -> DataFrame:
    from .common import table

    got = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
