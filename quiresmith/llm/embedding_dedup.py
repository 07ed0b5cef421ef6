"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors are rotated by a fixed random orthogonal matrix and split into blocks of a few dimensions. Two
vectors of cosine at least c have a squared distance of at most 2 - 2c, so in at least one block theirs is
within that block's share of it, in proportion to its dimensions. Components are coded in whole steps of a byte,
which moves a distance by a step for each unit of the root of the dimensions at most; radii are wider by that, so no
pair is lost. Each block is joined for itself: a task gets a label's codes of this block and the next two,
packed, sorts them into a grid over some dimensions, compares block distances of neighbouring places, then the
distance over all three blocks, and returns the components of what is left as stars. So vectors don't
travel: about a block's bytes three times and an id for each block, whatever the number of vectors.

Candidates make components; a component's vectors meet once and all its pairs of a label and length are
judged by cosine in double precision, those next to the threshold from the original components alone.

Equal vectors of a label are one class before all this. A label of over `cell` classes is cut into slabs, in which vectors
near an edge lie twice; a slab that stays over twice as large, and a component over `tile` vectors, is dealt to pairs of
salted parts, each a task's group of its own. Tasks give sums of links and spanning links, never rows of pairs, so
a dense group of thousands costs arithmetic but no quadratic output; components come from those links.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null
label or id, link with nothing; vectors of different length don't link; rows that repeat an id and vector are
copies of each other; an id repeated with other vectors is one node of its components; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collect_garbage, components, discard, groups, materialise, partitions_for, table, tidy

COSINE, BLOCK, TILE, SLACK = 0.98, 8, 1024, 2e-6
#: Steps of a code in a block's radius; classes of a label that meet in one task; blocks whose codes travel together.
FINE, CELL, TOGETHER = 28, 1 << 19, 3
#: Cosines this near to the threshold are worked out again from the original components.
CLOSE = 1e-9
MASK = (1 << 64) - 1


def rotation(d: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng((seed, d)).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def blocks_of(d: int, cosine: float, width: int = BLOCK) -> list[tuple[int, int, float]]:
    """(start, end, squared-distance budget) of each block, of at most `width` dimensions; budgets are a hair wide for rounding."""
    total = max(0.0, 2 - 2 * cosine) + 4 * SLACK
    m = -(-d // width)
    return [(a, e, total * (e - a) / d) for a, e in itertools.pairwise(d * k // m for k in range(m + 1))]


def step_of(d: int, cosine: float, width: int = BLOCK) -> float:
    """What a step of a code stands for: a fraction of a block's radius, but codes reach over most components."""
    a, e, budget = blocks_of(d, cosine, width)[-1]
    return max(math.sqrt(budget) / FINE, 2.6 / (127 * math.sqrt(d)))


def together(d: int, cosine: float, block: int, width: int = BLOCK) -> tuple[list[tuple[int, int]], float, float]:
    """The blocks that travel with a block, itself first; radii in steps for it alone and for all of them."""
    blocks, step = blocks_of(d, cosine, width), step_of(d, cosine, width)
    some = [blocks[(block + k) % len(blocks)] for k in range(min(TOGETHER, len(blocks)))]
    (a, e, budget), total = some[0], sum(x[2] for x in blocks)
    return [x[:2] for x in some], math.sqrt(budget) / step + math.sqrt(e - a) + 1e-6, math.sqrt(total) / step + math.sqrt(sum(y - x for x, y, _ in some)) + 1e-6


def _vectors(batch: pa.RecordBatch, name: str) -> list[np.ndarray | None]:
    col = batch.column(batch.schema.get_field_index(name))
    d, rest = divmod(len(col.flatten()), max(1, len(col)))
    if d and not rest and not col.null_count and not col.flatten().null_count and pc.all(pc.equal(pc.list_value_length(col), d)).as_py():
        x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        ok = np.isfinite(x).all(1) & x.any(1)
        return [v if k else None for v, k in zip(x, ok.tolist(), strict=True)]
    out = []
    for x in col:
        v = None
        if x.is_valid and len(x) and not x.values.null_count:
            v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(v).all() or not v.any():
                v = None
        out.append(v)
    return out


def classes(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """vectors as (id, label, same, vec): same names the class of equal vectors of a label, null where nothing links.

    vec holds floats of 4 bytes where the vectors do, else of 8.
    """
    narrow = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("vec"))
    kind, like = narrow.schema["id"].dataType.simpleString(), float_of(narrow)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            raw, same = [], []
            for i, label, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _vectors(batch, "vec"), strict=True):
                ok = v is not None and label is not None and i is not None
                raw.append((v + 0.0).astype(like).tobytes() if ok else None)
                same.append(blake2b(raw[-1] + label.encode("utf-8", "surrogatepass"), digest_size=16).digest() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.binary()), pa.array(raw, pa.binary())], ["id", "label", "same", "vec"])

    return narrow.mapInArrow(tidy(run), f"id {kind}, label string, same binary, vec binary")


def float_of(vectors: DataFrame, name: str = "vec") -> str:
    return "<f4" if vectors.schema[name].dataType.elementType.simpleString() == "float" else "<f8"


def _matrix(raw: list[bytes], like: str) -> np.ndarray:
    """Vectors of one length in double precision, each scaled by a power of two so that no square overflows."""
    x = np.frombuffer(b"".join(raw), like).reshape(len(raw), -1).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _cells(it: Iterator[pa.RecordBatch], cosine: float, width: int, slabs: int, like: str, payload: bool) -> Iterator[pa.RecordBatch]:
    """Rows of (cell, check, n, d, block, node, code): the nodes of a batch in a cell, with their codes end to end.

    cell and check are hashes of label, length, block and slab, 128 bits in all: a cell's rows agree in these. slabs: over
    how many dimensions; half a radius to either side of a vector decides where it lies, so a pair meets where its middle is.
    """
    turn: dict[int, np.ndarray] = {}
    for batch in it:
        names = batch.column(batch.schema.get_field_index("label")).to_pylist()
        vecs = batch.column(batch.schema.get_field_index("vec")).to_pylist()
        nodes = batch.column(batch.schema.get_field_index("node"))
        by: dict[int, list[int]] = {}
        for k, raw in enumerate(vecs):
            by.setdefault(len(raw), []).append(k)
        for size, all_rows in by.items():
            d = size // np.dtype(like).itemsize
            if d not in turn:
                turn[d] = rotation(d)
            most = max(64, (1 << 19) // d)
            for at in range(0, len(all_rows), most):
                rows = np.array(all_rows[at : at + most])
                x = _unit(_matrix([vecs[k] for k in rows], like)) @ turn[d].T
                codes = np.clip(np.rint(x / step_of(d, cosine, width)), -127, 127).astype(np.int8)
                known: dict[str, int] = {}
                label = np.array([known.setdefault(names[k], len(known)) for k in rows])
                heads = [x.encode("utf-8", "surrogatepass") for x in known]
                for b in range(len(blocks_of(d, cosine, width))):
                    some, near, _ = together(d, cosine, b, width)
                    who, place = np.arange(len(rows)), label.astype(np.int64)
                    for k in range(some[0][0], some[0][0] + min(slabs, some[0][1] - some[0][0])):
                        lo, hi = (np.floor((codes[who, k] + shift) / (2 * near)).astype(np.int64) + 128 for shift in (-near / 2, near / 2))
                        more = np.flatnonzero(hi > lo)
                        who, place = np.concatenate([who, who[more]]), np.concatenate([place << 8 | lo, place[more] << 8 | hi[more]])
                    order = np.argsort(place, kind="stable")
                    who, place = who[order], place[order]
                    starts = np.flatnonzero(np.insert(place[1:] != place[:-1], 0, True))
                    lens = np.diff(np.append(starts, len(who)))
                    n_bits = 8 * min(slabs, some[0][1] - some[0][0])
                    keys = [xxhash.xxh3_128_intdigest(heads[x >> n_bits] + b"\0%d %d %d" % (d, b, x & ((1 << n_bits) - 1))) for x in place[starts].tolist()]
                    cols = [pa.array(np.array([f(x) for x in keys], np.uint64).view(np.int64)) for f in (lambda x: x & MASK, lambda x: x >> 64)]
                    cols += [pa.array(lens, pa.int64())]
                    if payload:
                        code = np.concatenate([codes[:, a:e] for a, e in some], axis=1)[who]
                        ends = np.append(starts, len(who)).astype(np.int32)
                        cols += [pa.array(np.full(len(keys), d, np.int32)), pa.array(np.full(len(keys), b, np.int32))]
                        cols += [pa.ListArray.from_arrays(pa.array(ends), nodes.take(pa.array(rows[who])))]
                        cols += [pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(ends * np.int32(code.shape[1])), pa.py_buffer(np.ascontiguousarray(code))])]
                    yield pa.RecordBatch.from_arrays(cols, ["cell", "check", "n", "d", "block", "node", "code"][: len(cols)])


#: Entries of a matrix of distances; dimensions of the grid, at most; places to either side that a radius reaches.
ENTRIES, GRID, REACH = 1 << 22, 4, 2


def _near(code: np.ndarray, w: int, near: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within `near` in their first w codes."""
    n = len(code)
    x = code[:, :w].astype(np.float32)
    side = near / REACH * (1 + 1e-6)
    spread = np.argsort(-x.std(0), kind="stable")[: min(GRID, w, int(math.log(max(n, 7) / 7, 16)))]  # some 16 places a dimension, 7 rows a place
    place = np.zeros(n, np.int64)
    for k in spread:
        place = place << 9 | np.floor((x[:, k] + 128) / side).astype(np.int64) + REACH
    order = np.argsort(place, kind="stable")
    x, place = x[order], place[order]
    square = (x * x).sum(1, keepdims=True)
    one = np.ones((n, 1), np.float32)
    left, right = np.hstack([x, square, one]), np.hstack([-2 * x, one, square])  # whole numbers: exact
    starts = np.append(np.flatnonzero(np.insert(place[1:] != place[:-1], 0, True)), n)
    each = place[starts[:-1]]
    shifts = [sum(s << 9 * (len(spread) - 1 - k) for k, s in enumerate(p)) for p in itertools.product(range(-REACH, REACH + 1), repeat=max(0, len(spread) - 1))]
    shifts = [s for s in shifts if s > 0] if len(spread) > 1 else []
    reach = REACH if len(spread) else 0
    for at in range(0, len(each), 2048):
        some = each[at : at + 2048]
        lo = [starts[:-1][at : at + 2048]] + [starts[np.searchsorted(each, some + s - reach)] for s in shifts]
        hi = [starts[np.searchsorted(each, some + reach, "right")]] + [starts[np.searchsorted(each, some + s + reach, "right")] for s in shifts]
        lo, hi = np.array(lo).T, np.array(hi).T
        for c in range(len(some)):
            a, e = starts[at + c], starts[at + c + 1]
            full = hi[c] > lo[c]
            begin, end = lo[c][full], hi[c][full]
            other = np.concatenate([right[p:q] for p, q in zip(begin.tolist(), end.tolist(), strict=True)]).T
            m, ends = other.shape[1], np.cumsum(end - begin)
            high = max(1, min(e - a, ENTRIES // m))
            for h in range(a, e, high):
                top = left[h : min(e, h + high)]
                for v in range(0, m, ENTRIES):
                    i, j = np.divmod(np.flatnonzero(top @ other[:, v : v + ENTRIES] <= near * near), min(ENTRIES, m - v))
                    run = np.searchsorted(ends, j + v, "right")
                    i, j = i + h, j + v - ends[run] + end[run]
                    ok = i < j
                    yield order[i[ok]], order[j[ok]]


def _stars(code: np.ndarray, w: int, near: float, whole: float) -> np.ndarray:
    """Least row of each row's component, over pairs within `near` in the first w codes and within `whole` in all."""
    n = len(code)
    root, a, b, held = np.arange(n), [], [], 0
    for i, j in itertools.chain(_near(code, w, near), [(None, None)]):
        if i is not None and len(i):
            ok = root[i] != root[j]
            i, j = i[ok], j[ok]
            far = [((code[i[k : k + 65536]].astype(np.int32) - code[j[k : k + 65536]]) ** 2).sum(1) > whole * whole for k in range(0, len(i), 65536)]
            ok = ~np.concatenate(far) if far else slice(0)
            a.append(i[ok])
            b.append(j[ok])
            held += len(a[-1])
        if held and (i is None or held > 1 << 18):
            at = np.arange(n)
            root = local_roots(n, np.concatenate([at, *a]), np.concatenate([root, *b]))
            a, b, held = [], [], 0
    return root


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of each node's component, for links a-b among n nodes."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            return root


def _join_cells(it: Iterator[pa.RecordBatch], cosine: float, width: int) -> Iterator[pa.RecordBatch]:
    """Per cell, or pair of its parts: candidates as links of nodes to the first of their component."""
    for _, rows in groups(it, ["cell", "check", "p", "q"]):
        node = pa.concat_arrays([x.flatten() for x in rows.column("node").chunks])
        if len(node) < 2:
            continue
        some, near, whole = together(rows.column("d")[0].as_py(), cosine, rows.column("block")[0].as_py(), width)
        code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.int8).reshape(len(node), -1)
        root = _stars(code, some[0][1] - some[0][0], near, whole)
        has = np.flatnonzero(root != np.arange(len(root)))
        if len(has):
            yield pa.RecordBatch.from_arrays([node.take(pa.array(has)), node.take(pa.array(root[has]))], ["a", "b"])


def _judge(x: np.ndarray, first: np.ndarray, second: np.ndarray | None, size: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row of x and its root, by pairs of first and second, or within first if that is None."""
    n, u = len(x), _unit(x)
    links, root, a, b = np.zeros(n, np.int64), np.arange(n), [], []
    for at in range(0, len(first), 512):
        i = first[at : at + 512]
        j = first[at:] if second is None else second
        c = u[i] @ u[j].T
        hit = c >= cosine
        for p, q in np.argwhere(np.abs(c - cosine) < CLOSE):
            v, w = x[i[p]], x[j[q]]
            hit[p, q] = float(v @ w) / float(np.sqrt(v @ v) * np.sqrt(w @ w)) >= cosine
        if second is None:
            hit = np.triu(hit, 1)
        links[i] += hit @ size[j]
        links[j] += size[i] @ hit
        p, q = np.nonzero(hit)
        p, q = i[p], j[q]
        ok = root[p] != root[q]
        root = local_roots(n, np.concatenate([np.arange(n), p[ok]]), np.concatenate([root, q[ok]]))
    return links, root


def _verify(it: Iterator[pa.RecordBatch], cosine: float, like: str) -> Iterator[pa.RecordBatch]:
    """Per component of candidates, or pair of its parts: links of each node and its root."""
    for (_, p, q), rows in groups(it, ["root", "p", "q"]):
        if rows.num_rows < 2:
            continue
        raw, size, salt = rows.column("vec").to_pylist(), rows.column("size").to_numpy(), rows.column("salt").to_numpy()
        node = rows.column("node").combine_chunks()
        kinds: dict[tuple, list[int]] = {}
        for k, key in enumerate(zip(rows.column("label").to_pylist(), map(len, raw), strict=True)):
            kinds.setdefault(key, []).append(k)
        for at in map(np.array, kinds.values()):
            first, second = np.flatnonzero(salt[at] == p), np.flatnonzero(salt[at] == q)
            if len(first) < 1 + (p == q) or not len(second):
                continue
            links, root = _judge(_matrix([raw[k] for k in at], like), first, None if p == q else second, size[at], cosine)
            has = np.flatnonzero(links)
            if len(has):
                yield pa.RecordBatch.from_arrays([node.take(pa.array(at[has])), node.take(pa.array(at[root[has]])), pa.array(links[has])], ["a", "b", "links"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, width: int = BLOCK, tile: int = TILE, cell: int = CELL) -> DataFrame:
    """Rows (id, n_links, component_id, kept), one for each row of vectors."""
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be over 0 and at most 1")
    spark = vectors.sparkSession
    every, like = classes(vectors, id_col, vec_col, label_col), float_of(vectors, vec_col)
    rows = materialise(every.select("id", "same"), "vectors")
    kind = rows.schema["id"].dataType.simpleString()
    nodes = materialise(every.where("same is not null").groupBy("same").agg(F.min("id").alias("node"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("vec").alias("vec")), "classes")
    collect_garbage(spark)
    tasks = partitions_for(spark, nodes, 1)

    largest = nodes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    slabs = min(4, math.ceil(math.log2(largest / cell))) if largest > cell else 0  # a slab in the middle holds some half
    coded = lambda payload: nodes.select("node", "label", "vec").mapInArrow(tidy(lambda it: _cells(it, cosine, width, slabs, like, payload)), "cell long, check long, n long" + f", d int, block int, node array<{kind}>, code binary" * payload)
    dealt = coded(True).drop("n").withColumn("p", F.lit(0)).withColumn("q", F.lit(0))
    hot = None
    if slabs:
        hot = materialise(coded(False).groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > 2 * cell).select(F.col("cell").alias("hot"), F.ceil(2 * F.col("n") / cell).cast("int").alias("parts")), "hot-cells")
        parts = F.coalesce("parts", F.lit(1))
        dealt = dealt.drop("p", "q").join(hot, F.col("cell") == F.col("hot"), "left").withColumn("salt", F.pmod(F.xxhash64("code"), parts).cast("int"))
        # both parts of a pair are searched as one, so a part needs no group of its own
        dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), parts - 1))).where(parts.eqNullSafe(1) | (F.col("k") != F.col("salt")))
        dealt = dealt.select("cell", "check", F.least("salt", "k").alias("p"), F.greatest("salt", "k").alias("q"), "d", "block", "node", "code")
    dealt = dealt.repartition(tasks, "cell", "p", "q").sortWithinPartitions("cell", "check", "p", "q")
    edges = materialise(dealt.mapInArrow(tidy(lambda it: _join_cells(it, cosine, width)), f"a {kind}, b {kind}").distinct(), "candidates")
    discard(hot)
    near = components(edges)
    alone = edges.where("a = b").select(F.col("a").alias("node"))  # an id with several vectors
    if not alone.isEmpty():
        near = near.unionByName(alone.join(near, "node", "left_anti").distinct().withColumn("root", F.col("node")))
    near = materialise(near, "near")
    discard(edges)
    collect_garbage(spark)

    large = near.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > tile).select("root", F.ceil(F.col("n") / tile).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    members = nodes.join(near.join(large, "root", "left"), "node").withColumn("salt", F.pmod(F.xxhash64("same"), parts).cast("int"))
    members = members.withColumn("k", F.explode(F.sequence(F.lit(0), parts - 1)))
    members = members.select("root", F.least("salt", "k").alias("p"), F.greatest("salt", "k").alias("q"), "node", "label", "size", "vec", "salt")
    members = members.repartition(tasks, "root", "p", "q").sortWithinPartitions("root", "p", "q")
    links = materialise(members.mapInArrow(tidy(lambda it: _verify(it, cosine, like)), f"a {kind}, b {kind}, links long"), "links")
    discard(near)
    collect_garbage(spark)
    counts = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(links).withColumnRenamed("node", "root_node")
    each = nodes.select("same", "node", "size").join(counts, "node", "left").join(roots, F.col("node") == F.col("root_node"), "left")
    each = each.select(F.col("same").alias("s"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    out = rows.select("id", "same").join(each, F.col("same") == F.col("s"), "left")
    component = F.coalesce("component_id", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op3_subspace_pigeonhole(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


#: DuckDB SQL for op3's rows.
OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
), pair AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, pair.b FROM reach JOIN pair ON reach.b = pair.a
), comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM pair GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM comp LEFT JOIN n USING (vec_id)
"""
