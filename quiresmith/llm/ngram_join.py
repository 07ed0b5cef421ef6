"""N-gram Jaccard join by MinHash banding.

Words are runs of characters other than white space; a document's set holds its n-grams of five words (a text
of one to four words has one n-gram, of all of them), as 64-bit hashes. Documents of equal sets are one class. MinHash
signatures are cut into bands; rows and bands are the most selective that reach the target recall at the
threshold. A shuffle on band hashes finds buckets; each bucket links its members to its least one only, and
components of these links are the groups within which pairs are verified on full sets. Inside a group, sets
are dealt by size strata (a pair's sizes differ by no more than the threshold allows) and, over `tile` rows, to pairs
of salted parts; a tile intersects its sets by matrix products, counts links and emits sums and spanning
links, never rows of pairs.

Defined cases: null texts and texts without words have no n-grams and link with nothing; equal rows are copies
and link with each other; rows that repeat an id with another text are documents of their own, with that id;
null ids are allowed; an empty table gives no rows; extra columns are left out of the result.
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

from .common import WordHashes, batches, components, groups, join_totals, materialise, mix, partitions_for, rolling, table, tidy
from .embedding_dedup import local_roots

WIDTH, THRESHOLD, RECALL, HASHES, TILE = 5, 0.8, 0.999, 64, 1024
#: Bytes of n-gram hashes in a salted part of a tile.
TILE_BYTES = 12 << 20


@lru_cache(maxsize=None)
def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which `hashes` suffice to reach the recall at the threshold.

    Where they don't even for bands of one row, there are as many such bands as the recall takes.
    """

    def bands_for(rows: int) -> int:
        hit = threshold**rows
        return 1 if hit >= recall else math.ceil(math.log(1 - recall) / math.log1p(-hit))

    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("threshold must be over 0 and at most 1, recall between 0 and 1")
    best = bands_for(1), 1
    for rows in range(2, hashes + 1):
        if threshold**rows < 1e-12 or bands_for(rows) * rows > hashes:
            break
        best = bands_for(rows), rows
    return best


def shingles(raw: bytes | None, hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Distinct n-gram hashes of a text, ascending."""
    words = raw.decode("utf-8").split() if raw else []
    if not words:
        return np.empty(0, np.uint64)
    h = hashes([w.encode() for w in words])
    return np.unique(rolling(h, min(width, len(h))))


def signatures(it: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    rng = np.random.default_rng(5)
    factors = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in batches(it, "text", 4 << 20):
        sets = [shingles(t.as_buffer().to_pybytes() if t.is_valid else None, hashes, width) for t in batch.column(batch.schema.get_field_index("text"))]
        sizes = np.array([len(s) for s in sets], np.int64)
        node = [xxhash.xxh3_128_hexdigest(s.tobytes())[:24] if len(s) else None for s in sets]
        has = np.flatnonzero(sizes)
        keys = np.zeros((len(sets), bands), np.uint64)
        if len(has):
            flat = np.concatenate([sets[i] for i in has])
            starts = np.concatenate([[0], np.cumsum(sizes[has])[:-1]])
            fold = flat >> np.uint64(29)
            for b in range(bands):
                key = np.full(len(has), b + 1, np.uint64)
                for k in range(b * rows, (b + 1) * rows):
                    key = mix(key ^ np.minimum.reduceat(flat * factors[k] ^ fold, starts))
                keys[has, b] = key
        lists = pa.array([k.tolist() if n else None for k, n in zip(keys.astype(np.int64), sizes, strict=True)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.string()), pa.array(sizes, pa.int64()), lists], ["id", "h", "node", "n", "bands"])


def intersections(sets: list[np.ndarray], dense_from: int = 24) -> np.ndarray:
    """Matrix of the sizes of all pairwise intersections of a tile's sets."""
    n = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    edge = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    df = np.diff(np.append(edge, len(flat)))
    out = np.zeros(n * n, np.float32)
    held: list[np.ndarray] = []

    def flush() -> None:
        if held:
            np.add(out, np.bincount(np.concatenate(held), minlength=n * n), out=out, casting="unsafe")
            held.clear()

    waiting = 0
    for k in np.unique(df[(df >= 2) & (df < dense_from)]).tolist():
        rows = owner[edge[df == k][:, None] + np.arange(k)]
        i, j = np.triu_indices(k, 1)
        step = max(1, (1 << 20) // len(i))
        for a in range(0, len(rows), step):  # owners ascend within a column
            held.append((rows[a : a + step, i] * n + rows[a : a + step, j]).ravel())
            waiting += len(held[-1])
            if waiting > 1 << 21:
                flush()
                waiting = 0
    flush()
    out = out.reshape(n, n)
    out = out + out.T
    often = np.flatnonzero(df >= dense_from)
    for a in range(0, len(often), 1024):
        some = often[a : a + 1024]
        x = np.zeros((n, len(some)), np.float32)
        x[owner[np.concatenate([np.arange(edge[c], edge[c] + df[c]) for c in some])], np.repeat(np.arange(len(some)), df[some])] = 1
        out += x @ x.T
    return out


def _join_tiles(it: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for (_, p, q), rows in groups(it, ["cell", "p", "q"]):
        node = rows.column("node").combine_chunks()
        n = rows.num_rows
        once = np.unique([x + "hv"[not y] for x, y in zip(node.to_pylist(), rows.column("home").to_pylist(), strict=True)], return_index=True)[1] if n > 1 else []
        if len(once) < n:  # rows equal in id and text bring a class more than once
            rows, n = rows.take(pa.array(np.sort(once), pa.int64())), len(once)
            node = rows.column("node").combine_chunks()
        if n < 2:
            continue
        home, salt, size = rows.column("home").to_numpy(), rows.column("salt").to_numpy(), rows.column("size").to_numpy()
        if not home.any():
            continue
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows.column("grams")]
        lengths = np.array([len(s) for s in sets], np.float64)
        common = intersections(sets)
        linked = common >= threshold * (lengths[:, None] + lengths[None, :] - common) - 1e-6
        # pairs of this tile: home with home, home with visitor; across the parts if there are two
        mine = np.triu(home[:, None] & home[None, :], 1) | (home[:, None] & ~home[None, :])
        if p != q:
            mine &= salt[:, None] != salt[None, :]
        a, b = np.nonzero(linked & mine)
        if not len(a):
            continue
        links = np.bincount(a, size[b], n) + np.bincount(b, size[a], n)
        has = np.flatnonzero(links)
        root = local_roots(n, a, b)
        yield pa.RecordBatch.from_arrays([node.take(pa.array(has)), node.take(pa.array(root[has])), pa.array(links[has].astype(np.int64))], ["a", "b", "links"])


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """Rows (id, h, copy_of, n_links, class_id, kept), one a row of docs.

    h is xxhash64 of the text; copy_of the least id of the documents of the same n-grams; n_links the other documents at the
    threshold or over it; class_id the least id reachable by links; kept marks the documents to keep, those of the
    least (id, h) of a class (rows that are equal in both are all marked).
    """
    spark = docs.sparkSession
    bands, rows_ = choose_bands(threshold, recall)
    narrow = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    signed = materialise(narrow.mapInArrow(tidy(lambda it: signatures(it, width, bands, rows_)), f"id {kind}, h long, node string, n long, bands array<long>"), "signed")
    first = F.min(F.struct("id", "h"))
    nodes = materialise(signed.where("node is not null").groupBy("node").agg(first.alias("rep"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    keys = nodes.select("node", F.explode("bands").alias("key"))
    least = materialise(keys.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("_n")).where("_n > 1"), "buckets")
    near = join_totals(keys, "key", least, bands * nodes.count()).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    # strings of one length: their order is the bytes' order
    group = materialise(components(near), "groups")
    stratum = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9) if threshold < 1 else F.lit(0)
    members = nodes.join(group, "node").select("node", "size", "n", F.col("rep.id").alias("rid"), F.col("rep.h").alias("rh"), "root", stratum.cast("int").alias("s"))
    members = materialise(members, "members")
    held = narrow.join(members.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("rid")) & (F.col("h") == F.col("rh"))).select("node", "size", "root", "s", "text")

    def grams(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches(it, "text", 4 << 20):
            got = [shingles(t.as_buffer().to_pybytes(), hashes, width).tobytes() for t in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(got, pa.binary())], ["node", "size", "root", "s", "grams"])

    sets = held.mapInArrow(tidy(grams), "node string, size long, root string, s int, grams binary")

    def spread(df: DataFrame, *more: str) -> DataFrame:
        """A home row in the cell of the own stratum and a visit to the one below."""
        at = F.array(F.struct(F.col("s").alias("at"), F.lit(True).alias("home")), F.struct((F.col("s") - 1).alias("at"), F.lit(False).alias("home")))
        return df.withColumn("e", F.explode(at)).select(F.xxhash64("root", "e.at").alias("cell"), "e.home", "node", *more)

    parts = F.ceil(F.greatest(F.col("c") / tile, F.col("grams") * 8 / TILE_BYTES)).cast("int").alias("parts")
    counts = spread(members, "n").groupBy("cell").agg(F.count("*").alias("c"), F.count_if("home").alias("homes"), F.sum("n").alias("grams")).where("c > 1 and homes > 0")
    counts = materialise(counts.select(F.col("cell").alias("known"), parts), "cells")
    dealt = spread(sets, "size", "grams").join(counts, F.col("cell") == F.col("known")).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("cell", F.least("salt", "k").alias("p"), F.greatest("salt", "k").alias("q"), "home", "node", "size", "salt", "grams")
    tasks = partitions_for(spark, docs, 8)
    found = materialise(dealt.repartition(tasks, "cell", "p", "q").sortWithinPartitions("cell", "p", "q").mapInArrow(tidy(lambda it: _join_tiles(it, threshold)), "a string, b string, links long"), "links")
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found).select(F.col("node").alias("rn"), "root")
    each = nodes.select("node", "rep", "size").join(links, "node", "left").join(roots, F.col("node") == F.col("rn"), "left").withColumn("root", F.coalesce("root", "node"))
    each = materialise(each.select("node", "rep", "size", "links", "root"), "linked")
    tops = each.groupBy("root").agg(F.min("rep").alias("top"))
    info = each.join(tops, "root").select(F.col("node").alias("of"), F.col("rep.id").alias("copy_of"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "top")
    out = signed.select("id", "h", "node").join(info, F.col("node") == F.col("of"), "left")
    mine = F.struct("id", "h")
    return out.select(
        "id",
        "h",
        F.when(F.col("of").isNull(), F.col("id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("of").isNull(), F.col("id")).otherwise(F.col("top.id")).alias("class_id"),
        (F.col("of").isNull() | mine.eqNullSafe(F.col("top"))).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each class: that of the least id; all its columns as they were.

    Rows equal in id and text are one document too: one stays. Texts without words are in no class.
    """
    from pyspark.sql import Window

    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("h"))
    got = join(docs, id_col, text_col, **options).where("kept").select(F.col("id").alias("kid"), F.col("h").alias("kh")).distinct()
    found = whole.join(got.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("kid")) & (F.col("h") == F.col("kh")), "left_semi")
    numbered = found.withColumn("n", F.row_number().over(Window.partitionBy("id", "h").orderBy(F.lit(0))))
    return numbered.where("n = 1").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op10_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    got = join(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select(F.col("id").alias("doc_id"), "class_id", "n_links", "copy_of", "kept")
