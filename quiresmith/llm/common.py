"""What the training-data operators share: tables, materialised steps, word hashes, components."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by Spark's own reader; the path may be in any store that Spark knows."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, unless their Python path has it already."""
    import os
    import tempfile
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(p and Path(p).resolve() == root for p in known) or getattr(spark.sparkContext, "_quire_shipped", False):
        return
    out = f"{tempfile.mkdtemp(prefix='quiresmith-')}/quiresmith.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((root / "quiresmith").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(out)
    spark.sparkContext._quire_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a folder of our own only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        sc = spark.sparkContext
        named = sc.getCheckpointDir()
        if not named:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            sc.setCheckpointDir(tempfile.mkdtemp(prefix="quiresmith-"))
            named = sc.getCheckpointDir()
    return named.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._quire_path = path
    return out


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop's."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder."""
    store, there = _hadoop(spark, path)
    store.delete(there, True)


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Rename a folder, into a folder that is made if need be; false if there is none."""
    store, there = _hadoop(spark, path)
    if not store.exists(there):
        return False
    goal = _hadoop(spark, to)[1]
    store.mkdirs(goal.getParent())
    if not store.rename(there, goal):
        raise OSError(f"{path} can't be renamed to {to}")
    return True


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder."""
    store, there = _hadoop(spark, path)
    return [x.getPath().getName() for x in store.listStatus(there)]


def discard(df: DataFrame | None) -> None:
    """Delete what materialise() wrote for df, once nothing reads it any more."""
    path = getattr(df, "_quire_path", None)
    if path:
        remove(df.sparkSession, path)


def collect_garbage(spark: SparkSession) -> None:
    """Shuffle files of steps that are over go once the driver's JVM has collected what stood for them."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


Batches = Iterator[pa.RecordBatch]


def tidy(f: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """f for mapInArrow, with its memory given back to the machine when the task ends, as workers outlive tasks."""

    def run(it: Batches) -> Batches:
        try:
            yield from f(it)
        finally:
            give_back()

    return run


def give_back() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def partitions_for(spark: SparkSession, df: DataFrame, mb: int = 16) -> int:
    """Shuffle partitions for df, from the optimiser's estimate of its bytes on disk."""
    stats = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    size = int(str(stats))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if size > 1 << 50:  # no estimate
        return least
    return max(least, -(-size // (mb << 20)))


class WordHashes:
    """64-bit hashes of words (bytes); keeps those seen, at most `bound` of them (a cache: results are the same without)."""

    def __init__(self, bound: int = 200_000):
        self.bound, self.seen = bound, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        seen = self.seen
        try:
            return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(seen) > self.bound:
                seen.clear()
            for w in set(words).difference(seen):
                seen[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Powers that a worker keeps for each base; longer texts have theirs worked out anew.
KEPT_POWERS = 1 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def rolling(hashes: np.ndarray, width: int, base: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2**64, of all windows of `width` items."""
    n = len(hashes)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = _POWERS.get(base, (np.empty(0, np.uint64),) * 2)
    if len(up) < n + 1:
        m = max(4096, n + 1 if n > KEPT_POWERS else min(2 * n, KEPT_POWERS))
        inverse = pow(base, -1, 1 << 64)
        up = np.cumprod(np.insert(np.full(m, base, np.uint64), 0, np.uint64(1)), dtype=np.uint64)
        down = np.cumprod(np.insert(np.full(m, inverse, np.uint64), 0, np.uint64(1)), dtype=np.uint64)
        if m <= KEPT_POWERS:
            _POWERS[base] = up, down
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=total[1:])
    return mix((total[width:] - total[:-width]) * down[: n - width + 1])


def batches(it: Iterable[pa.RecordBatch], text: str = "text", most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that their texts stay near most_bytes."""
    for batch in it:
        col = batch.column(batch.schema.get_field_index(text))
        if not len(col):
            continue
        if col.nbytes <= most_bytes:
            yield batch
            continue
        sizes = np.cumsum(np.array([len(x.as_buffer()) if x.is_valid else 0 for x in col], np.int64))
        at = 0
        while at < len(col):
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + most_bytes, "right")))
            yield batch.slice(at, end - at)
            at = end


def groups(it: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal keys in batches that are sorted by them; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    key: tuple | None = None
    for batch in it:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in itertools.pairwise(cuts):
            now = tuple(c[a] for c in cols)
            if key is not None and now != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


#: A key is hot from so many rows on, or from this share of all rows.
HOT_ROWS, HOT_SHARE = 256, 1 / 4096


def join_totals(rows: DataFrame, key: str, totals: DataFrame, n_rows: int, count: str = "_n") -> DataFrame:
    """rows with the columns of totals, a written table of one row a key, whose column `count` says how many rows the key has.

    Rows of hot keys, however many, are joined where they are: hot keys have over `HOT_SHARE` of n_rows each, so there
    are under 1 / HOT_SHARE of them, and those totals are broadcast. The others meet in a shuffle.
    """
    least = max(HOT_ROWS, int(n_rows * HOT_SHARE))
    hot, cold = totals.where(F.col(count) > least).drop(count), totals.where(F.col(count) <= least).drop(count)
    if hot.isEmpty():
        return rows.join(cold, key)
    left = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(left.join(cold, key))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges: pairs of node ids of one type; null ends and loops are ignored. Returns (node, root), root being
    the least node of the component, for every node of an edge that isn't a loop. Every round is a written
    table, so no lineage grows; no links reach the driver, only a count and a checksum a round. Hubs don't meet
    in one task (see join_totals).
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    now = materialise(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    signed = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = signed(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("_n")), "least")
        large = join_totals(both, "u", least, 2 * seen[0]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "edges")
        smallest = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")), "least")
        small = join_totals(large, "u", smallest, 2 * seen[0]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        then = materialise(small, "edges")
        for df in (now, least, large, smallest):
            discard(df)
        now, sign = then, signed(then)
        if sign == seen:
            break
        seen = sign
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
