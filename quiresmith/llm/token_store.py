"""Token ids in a content-addressed store.

Layout of a store, three folders of Parquet files:

- chunks    (digest binary, n long, data binary): every distinct chunk once, in a folder buckets=N as files of N
            buckets by Spark's hash of the digest, so a reader joins them where they lie; digest is the BLAKE2b-128 of the
            ids as little-endian unsigned 32-bit integers; data holds the bytes of an id (2 where all ids of the chunk
            are under 65,536, else 4), then the ids in planes of their bytes, compressed by zstd.
- recipes   (part int, doc_id, start long, n_tokens long, root binary, digests array<binary>): one row a
            document in ascending doc_id order; root is the Merkle root over its chunk digests.
- manifest  (part int, first_id, last_id, n_docs long, n_tokens long, start long, root binary): one row a file
            of recipes; root is the Merkle root over its documents, each with id, start, count and root.

A document's ids are cut where a rolling hash of the last `WINDOW` ids has its high bits zero, so equal
passages give equal chunks wherever they stand. Chunks and documents leave the encoder together and are dealt in
one shuffle, chunks by digest, so texts are encoded once and ids are written once.

Defined cases: a null or empty text has the end id only; repeated rows are documents of their own; a null id
sorts first; an empty table gives a store without rows; other columns of the input don't matter.
"""

from __future__ import annotations

import itertools
import os
import re
import unicodedata
import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, batches, collect_garbage, discard, groups, materialise, mix, move, names_in, partitions_for, remove, shared_dir, table, tidy

WINDOW, MEAN, LEAST, MOST = 16, 1024, 256, 8192
#: Words that a worker keeps with their ids, from task to task of a run (speed only).
KEPT_WORDS = 700_000
#: New words that the library gets in one call.
TOGETHER = 512
#: Uses of a chunk that meet in one task, at least.
HOT_USES = 4096
#: Marks that the pre-tokenizer cuts off a word of letters before them.
STOPS = frozenset(".,;:!?")
#: Words of ASCII letters, for Arrow.
PLAIN = r"^[a-z]+$"
#: What the pre-tokenizer takes for one piece each, of a word in lower-case ASCII.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)


def cuts_in(ids: np.ndarray) -> np.ndarray:
    """Where a stream of ids may be cut: ends of windows whose hash has its high bits zero."""
    h = (ids + np.uint32(1)) * np.uint32(0x9E3779B1)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(13)
    w = 1
    while w < WINDOW:  # sums over twice as many ids, each shifted by its place
        h = h[w:] + (h[:-w] << np.uint32(w))
        w *= 2
    return np.flatnonzero(h < np.uint32((1 << 32) // MEAN)) + WINDOW


def cut_points(n: int, cuts: list[int]) -> list[int]:
    """Ends of the chunks of n ids that may be cut at cuts."""
    if n <= LEAST:
        return [n] if n else []
    ends, at = [], 0
    for p in cuts:
        while p - at > MOST:
            at += MOST
            ends.append(at)
        if p - at >= LEAST:
            ends.append(p)
            at = p
    while n - at > MOST:
        at += MOST
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def digest(raw: bytes) -> bytes:
    return blake2b(raw, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree; an odd node moves up unchanged, leaves and inner nodes are told apart."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"\2")]
    while len(level) > 1:
        level = [digest(b"\1" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


_COMPRESS, _DECOMPRESS = zstandard.ZstdCompressor(level=1, write_checksum=False), zstandard.ZstdDecompressor()


def pack(raw: bytes) -> bytes:
    """Ids as little-endian unsigned 32-bit integers, in short."""
    planes = [raw[k::4] for k in range(4)]
    width = 4 if planes[2].strip(b"\0") or planes[3].strip(b"\0") else 2
    return bytes([width]) + _COMPRESS.compress(b"".join(planes[:width]))


def unpack(data: bytes) -> bytes:
    planes, width = _DECOMPRESS.decompress(data[1:]), data[0]
    n = len(planes) // width
    raw = bytearray(4 * n)
    for k in range(width):
        raw[k::4] = planes[k * n : (k + 1) * n]
    return bytes(raw)


def lowered(t: str, added: tuple[str, ...] = ()) -> str | None:
    """t in lower case where that is what the tokenizer makes of it anyway, else null.

    It isn't where letters lower by context or to more than one character, where composing would come between, or
    where the lower-case form holds one of `added`, which the tokenizer looks for before it lowers anything.
    """
    if not (t.isascii() or "Σ" not in t and "İ" not in t and unicodedata.is_normalized("NFC", t)):
        return None
    low = t.lower()
    return None if any(a in low for a in added) else low


def byte_letters() -> dict[int, str]:
    """The letters that byte-level tokenizers write bytes as: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


def inside(words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of words with 8 zeros before and after, and where there each word begins and ends."""
    if not len(words):
        return np.zeros(16, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)
    _, offsets, data = words.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(words) + 1, 8 * words.offset)
    raw = np.zeros(bounds[-1] - bounds[0] + 16, np.uint8)
    if len(raw) > 16:
        raw[8:-8] = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0] + 8
    return raw, bounds[:-1], bounds[1:]


#: The first k of 8 bytes, by k.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_keys(words: pa.LargeStringArray) -> np.ndarray:
    """64-bit hashes of words, by their length, first 32 and last 8 bytes; different words may share one."""
    raw, starts, ends = inside(words)
    eights = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    h = mix((ends - starts).astype(np.uint64) + np.uint64(1))
    for k in range(0, 32, 8):
        some = np.flatnonzero(ends - starts > k)
        if not len(some):
            return h
        at = starts[some] + k
        h[some] = mix(h[some] ^ (eights[at] & FIRST[np.minimum(ends[some] - at, 8)]))
    some = np.flatnonzero(ends - starts > 32)
    h[some] = mix(h[some] ^ eights[ends[some] - 8])
    return h


class WordEncoder:
    """Ids of texts by the tokenizers library.

    The tokenizer's normaliser and pre-tokenizer never join across a space or a newline (both are dropped), so a text's
    ids are those of its space-separated words one after the other, and a word's those of its pieces. New pieces are
    encoded by the library, together, and kept with their words. Where it is plain what the normaliser and the
    pre-tokenizer make of a word, the library's model is given its pieces alone; other words go the whole way. A mark
    that ends a word after a letter is a piece of its own, so words are kept without it.
    """

    def __init__(self, path: str):
        """path: a tokenizer whose normaliser is NFC, white space to spaces, lower case, and whose pieces are PIECES'."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        bare = json.loads(self.tokenizer.to_str()) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.model = Tokenizer.from_str(json.dumps(bare))
        self.run = ""
        self.forget()
        self.added = tuple(a.content.lower() for a in self.tokenizer.get_added_tokens_decoder().values())
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.spelled = np.array([ord(" ") if b == 32 else ord(c) for b, c in sorted(byte_letters().items())], "<u4")
        self.marks = np.full(256, -1)  # ids of STOPS that have one each
        for c in STOPS:
            got = self.tokenizer.encode(c, add_special_tokens=False).ids
            if len(got) == 1:
                self.marks[ord(c)] = got[0]
        self.letters: set[str] = set("abcdefghijklmnopqrstuvwxyz")
        self.others: set[str] = set()

    def _lettered(self, w: str) -> bool:
        """Whether a word beyond ASCII is one piece of letters that the normaliser leaves as they are."""
        chars = set(w)
        if not chars <= self.letters:
            for c in chars - self.letters - self.others:
                split = self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{c}a")
                (self.letters if c.isalpha() and len(split) == 1 and self.tokenizer.normalizer.normalize_str(c) == c else self.others).add(c)
            if not chars <= self.letters:
                return False
        return unicodedata.is_normalized("NFC", w)

    def _together(self, texts: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words by the model, and how many each has; texts: runs of pieces with spaces between, counts: pieces a word.

        Null where the number of ends isn't that of the pieces.
        """
        got = []
        for t in texts:
            spelled = t if t.isascii() else self.spelled[np.frombuffer(t.encode(), np.uint8)].tobytes().decode("utf-32-le")
            got.append(np.array(self.model.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<u4"))
        ids = np.concatenate([np.empty(0, "<u4"), *got])
        ends = np.append(0, np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1)
        if len(ends) != counts.sum() + 1 or ends[-1] != len(ids):
            return None
        return ids, np.diff(ends[np.cumsum(counts)], prepend=0)

    def _endings(self, words: pa.LargeStringArray) -> np.ndarray:
        """The id of the mark that ends each word after a lower-case letter of ASCII or Latin-1, else -1."""
        raw, starts, ends = inside(words)
        last, one, two = (raw[ends - k] for k in (1, 2, 3))
        ascii = (one >= 97) & (one <= 122) & (ends - starts > 1)
        latin = (two == 0xC3) & (one >= 0x9F) & (one <= 0xBF) & (one != 0xB7) & (ends - starts > 2)
        return np.where(ascii | latin, self.marks[last], -1)

    def _find(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word is kept, -1 for new ones, and the words' keys. A key leads to a word, which has to be the same."""
        keys, at = word_keys(words), np.full(len(words), -1)
        if len(self.keys) and len(keys):
            order = np.argsort(keys)
            places = np.minimum(np.searchsorted(self.keys, keys[order]), len(self.keys) - 1)
            hit = self.keys[places] == keys[order]
            some, kept = order[hit], self.places[places[hit]]
            same = pc.equal(self.words.take(pa.array(kept)), words.take(pa.array(some))).to_numpy(zero_copy_only=False)
            at[some[same]] = kept[same]
        return at, keys

    def _keep(self, words: pa.LargeStringArray, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Add words to those kept; of words that share a key the first is found."""
        order = np.argsort(keys, kind="stable")
        before = np.searchsorted(self.keys, keys[order], "right")
        self.keys, self.places = np.insert(self.keys, before, keys[order]), np.insert(self.places, before, len(self.words) + order)
        self.words = pa.concat_arrays([self.words, words])
        self.again = np.append(self.again, np.zeros(len(words), bool))
        self.ids, self.bounds = np.concatenate([self.ids, ids]), np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])

    def _learn(self, words: pa.LargeStringArray, keys: np.ndarray, easy: bool) -> np.ndarray:
        """Keep the ids of words, of lowered texts if easy: from their pieces where these are plain, else by the whole tokenizer.

        keys: theirs. Returns where each is kept.
        """
        plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False) if easy else np.zeros(len(words), bool)
        parts: list[tuple[int, list[str]]] = []
        rest: list[int] = []
        others = words.filter(pa.array(~plain)).to_pylist()
        for k, w in enumerate(others):
            if easy and w.isascii():
                parts.append((k, PIECES.findall(w))) if w.isprintable() else rest.append(k)
            elif easy and w.isalpha() and self._lettered(w):
                parts.append((k, [w]))
            elif easy and w[-1:] in STOPS and w[:-1].isalpha() and self._lettered(w[:-1]):
                parts.append((k, [w[:-1], w[-1]]))
            else:
                rest.append(k)
        some = words.filter(pa.array(plain))
        runs = pa.ListArray.from_arrays(pa.array([*range(0, len(some), TOGETHER), len(some)], pa.int32()), some)
        texts = pc.binary_join(runs, pa.scalar(" ", pa.large_string())).to_pylist()
        joined = [" ".join(x) for _, x in parts]
        texts += [" ".join(joined[a : a + TOGETHER]) for a in range(0, len(joined), TOGETHER)]
        counts = np.concatenate([np.ones(len(some), np.int64), np.array([len(x) for _, x in parts], np.int64)])
        at = np.flatnonzero(~plain)
        order = np.concatenate([np.flatnonzero(plain), at[[k for k, _ in parts]], at[rest]]).astype(np.int64)
        got = self._together(texts, counts)
        if got is None:
            got, rest = (np.empty(0, "<u4"), np.empty(0, np.int64)), words.take(pa.array(order)).to_pylist()
        else:
            rest = [others[k] for k in rest]
        whole = [np.array(e.ids, "<u4") for a in range(0, len(rest), 4096) for e in self.tokenizer.encode_batch_fast(rest[a : a + 4096], add_special_tokens=False)]
        ids, sizes = np.concatenate([got[0], *whole]), np.append(got[1], [len(x) for x in whole]).astype(np.int64)
        where = np.empty(len(words), np.int64)
        where[order] = len(self.words) + np.arange(len(words))
        self._keep(words.take(pa.array(order)), keys[order], ids, sizes)
        return where

    def _joined(self, texts: list[str], easy: bool) -> list[bytes]:
        """Ids of texts, of lowered ones if easy: words are told apart by Arrow, each distinct one is looked up once."""
        lists = pc.split_pattern(pa.array([t.replace("\n", " ") for t in texts], pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        ending = self._endings(words) if easy else np.full(len(words), -1)
        marked = ending >= 0
        order = np.concatenate([np.flatnonzero(~marked), np.flatnonzero(marked)])
        stems = pc.ascii_rtrim(words.filter(pa.array(marked)), "".join(STOPS))
        bare = pa.concat_arrays([words.filter(pa.array(~marked)), stems]).dictionary_encode()
        at, keys = self._find(bare.dictionary)
        new = at < 0
        self.again[at[~new]] = True
        if new.any():
            at[new] = self._learn(bare.dictionary.filter(pa.array(new)), keys[new], easy)
        kept = np.empty(len(words), np.int64)
        kept[order] = at[bare.indices.to_numpy()]
        # the ids of each distinct word with its mark, then those of all words from there
        n = self.bounds[kept + 1] - self.bounds[kept] + marked
        ends = np.cumsum(n)
        own = self.ids.take(np.repeat(self.bounds[kept] - (ends - n), n) + np.arange(n.sum()), mode="clip")
        own[ends[marked] - 1] = ending[marked]
        which = coded.indices.to_numpy()
        n, froms = n[which], (ends - n)[which]
        ends = np.cumsum(n)
        raw = own[np.repeat(froms - (ends - n), n) + np.arange(n.sum())].tobytes()
        cuts = (4 * np.insert(ends, 0, 0)[lists.offsets.to_numpy()]).tolist()
        return [raw[a:b] for a, b in itertools.pairwise(cuts)]

    def forget(self) -> None:
        """Drop the words kept."""
        self.words, self.ids, self.bounds = pa.array([], pa.large_string()), np.zeros(1, "<u4"), np.ones(1, np.int64)  # the first id is no word's
        self.keys, self.places, self.again = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool)

    def _thin(self) -> None:
        """Drop the words that weren't met again since the last time, or all where too many were."""
        kept = np.flatnonzero(self.again)
        words, ids, starts, n = self.words, self.ids, self.bounds[kept], np.diff(self.bounds)[kept]
        self.forget()
        if 2 * len(kept) <= KEPT_WORDS:
            words = words.take(pa.array(kept))
            self._keep(words, word_keys(words), ids[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())], n)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > KEPT_WORDS:
            self._thin()
        low = [lowered(t, self.added) for t in texts]
        easy = iter(self._joined([t for t in low if t is not None], True))
        hard = iter(self._joined([t for t, x in zip(texts, low, strict=True) if x is None], False))
        return [next(hard if x is None else easy) for x in low]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str, run: str = "") -> WordEncoder:
    """The worker's encoder; it keeps words for the tasks of one run, the next run starts without any."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    of = _ENCODERS[path]
    if of.run != run:
        of.forget()
        of.run = run
    return of


def write_store(docs: DataFrame, to: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the three folders under `to`."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    last = np.array([end_id], "<u4").tobytes()

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, task, count = encoder(path, to), TaskContext.get().partitionId(), 0
        for batch in batches(it, "text", 4 << 20):
            seen: set[bytes] = set()  # once a batch is enough
            names, sizes, data, counts, lists, roots = [], [], [], [], [], []
            raws = [raw + last for raw in of([t or "" for t in batch.column(1).to_pylist()])]
            stops = np.cumsum([len(raw) // 4 for raw in raws])
            starts = np.insert(stops[:-1], 0, 0)
            cuts = cuts_in(np.frombuffer(b"".join(raws), "<u4"))
            some = zip(np.searchsorted(cuts, starts + WINDOW).tolist(), np.searchsorted(cuts, stops, "right").tolist(), strict=True)
            for raw, start, (a, b) in zip(raws, starts, some, strict=True):
                at, own = 0, []
                for end in cut_points(len(raw) // 4, (cuts[a:b] - start).tolist()):
                    piece = raw[4 * at : 4 * end]
                    own.append(name := digest(piece))
                    if name not in seen:
                        seen.add(name)
                        names.append(name)
                        sizes.append(end - at)
                        data.append(pack(piece))
                    at = end
                counts.append(len(raw) // 4)
                lists.append(own)
                roots.append(merkle(own))
            n, m = len(names), len(counts)
            keys = [b"%d %d" % (task, count + k) for k in range(m)]  # one for each document
            count += m
            cols = [
                pa.array(["chunks"] * n + ["documents"] * m), pa.array(names + keys, pa.binary()), pa.array(sizes + counts, pa.int64()), pa.array(data + [None] * m, pa.binary()),
                pa.concat_arrays([pa.nulls(n, batch.column(0).type), batch.column(0)]), pa.array([None] * n + lists, pa.list_(pa.binary())), pa.array([None] * n + roots, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["what", "digest", "n", "data", "doc_id", "digests", "root"])

    schema = f"digest binary, n long, data binary, doc_id {kind}, digests array<binary>, root binary"
    n_buckets = partitions_for(spark, narrow)
    rows = narrow.mapInArrow(tidy(encode), f"what string, {schema}").repartition(n_buckets, "digest")
    once = rows.groupBy("what", "digest").agg(*(F.first(c).alias(c) for c in ("n", "data", "doc_id", "digests", "root")))
    name = f"draft_{uuid.uuid4().hex}"  # only tables can be written in buckets; its files stay when it goes
    once.write.partitionBy("what").bucketBy(n_buckets, "digest").format("parquet").option("compression", "uncompressed").option("path", f"{to}/draft").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    if not move(spark, f"{to}/draft/what=chunks", f"{to}/chunks/buckets={n_buckets}"):  # no documents
        spark.createDataFrame([], schema).write.parquet(f"{to}/chunks")
    coded = spark.read.schema(f"{schema}, what string").parquet(f"{to}/draft").select("doc_id", F.col("n").alias("n_tokens"), "digests", "root")
    collect_garbage(spark)

    tasks = partitions_for(spark, coded, 64)
    ordered = coded.repartitionByRange(tasks, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root").withColumn("part", F.spark_partition_id())
    numbered = materialise(ordered, "recipes")
    # at most `tasks` rows, one a part
    parts = numbered.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    offsets = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("offset"))
    by = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "root").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    recipes = numbered.withColumn("running", F.sum("n_tokens").over(by)).join(F.broadcast(offsets), "part")
    recipes = recipes.select("part", "doc_id", (F.col("offset") + F.col("running") - F.col("n_tokens")).cast("long").alias("start"), "n_tokens", "root", "digests")
    recipes.sortWithinPartitions("part", F.col("start")).write.option("compression", "zstd").parquet(f"{to}/recipes")

    manifest(spark.read.parquet(f"{to}/recipes")).write.parquet(f"{to}/manifest")
    remove(spark, f"{to}/draft")
    discard(numbered)
    collect_garbage(spark)  # the encoder's shuffle, if something still held it before


def leaf(doc_id, start: int, n_tokens: int, root: bytes) -> bytes:
    """What stands for a document in the Merkle tree of its part."""
    return f"{doc_id!r},{start},{n_tokens},".encode("utf-8", "surrogatepass") + root


def manifest(recipes: DataFrame) -> DataFrame:
    """The manifest that these recipes should have."""
    kind = recipes.schema["doc_id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part,), rows in groups(it, ["part"]):
            ids, n = rows.column("doc_id"), rows.column("n_tokens").to_numpy()
            leaves = [leaf(*x) for x in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens", "root")), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(part)], pa.int32()), ids.slice(0, 1).combine_chunks(), ids.slice(len(ids) - 1, 1).combine_chunks(), pa.array([len(ids)]), pa.array([int(n.sum())]), pa.array([rows.column("start")[0].as_py()]), pa.array([merkle(leaves)], pa.binary())],
                ["part", "first_id", "last_id", "n_docs", "n_tokens", "start", "root"],
            )

    narrow = recipes.select("part", "doc_id", "start", "n_tokens", "root").repartition("part").sortWithinPartitions("part", "start")
    return narrow.mapInArrow(tidy(run), f"part int, first_id {kind}, last_id {kind}, n_docs long, n_tokens long, start long, root binary")


def check_manifest(recipes: DataFrame, stored: DataFrame) -> None:
    """Raise unless the stored manifest is that of the recipes, and its parts follow each other without a gap."""
    names = [c for c in stored.columns if c != "part"]
    own, kept = (df.select("part", F.struct(*names).alias(c)) for df, c in ((manifest(recipes), "own"), (stored, "kept")))
    # one row a part
    before = F.sum(F.col("kept.n_tokens")).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    got = own.join(kept, "part", "full").withColumn("before", F.coalesce(before, F.lit(0)))
    wrong = got.where(~F.col("own").eqNullSafe(F.col("kept")) | ~F.col("kept.start").eqNullSafe(F.col("before")))
    parts = [r.part for r in wrong.select("part").limit(5).collect()]
    if parts:
        raise ValueError(f"recipes don't match the manifest in parts {parts}")


def read_store(spark: SparkSession, at: str) -> DataFrame:
    """Documents of a store: (doc_id, start, n_tokens, ids binary), ids as little-endian unsigned 32-bit integers.

    The manifest is computed anew from the recipes and compared before anything is returned; every chunk's
    digest, every document's root and count as they are read; a difference raises. Recipes go to the buckets of the
    chunks they name, then the chunks of a document meet; chunks that aren't in buckets are dealt out first.
    """
    recipes = spark.read.parquet(f"{at}/recipes")
    check_manifest(recipes, spark.read.parquet(f"{at}/manifest"))
    chunks = spark.read.parquet(f"{at}/chunks").select("digest", "data")
    kind = recipes.schema["doc_id"].dataType.simpleString()
    tasks = partitions_for(spark, chunks, 16)
    wanted = recipes.select("start", F.posexplode("digests").alias("pos", "digest"))
    n_buckets = buckets_of(spark, at)
    found = join_chunks(wanted, chunks, bucketed(spark, at, n_buckets) if n_buckets else None, n_buckets)
    heads = recipes.select("start", "doc_id", "n_tokens", "root")
    rows = heads.select("start", F.lit(-1).alias("pos"), F.col("root").alias("digest"), F.lit(None).cast("binary").alias("data"), "doc_id", "n_tokens")
    rows = rows.unionByName(found.select("start", "pos", "digest", "data", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("long").alias("n_tokens")))
    return rows.repartition(tasks, "start").sortWithinPartitions("start", "pos").mapInArrow(tidy(_rebuild), f"doc_id {kind}, start long, n_tokens long, ids binary")


def buckets_of(spark: SparkSession, at: str) -> int:
    """How many buckets the chunks of a store lie in; 0 if they are plain files."""
    found = [re.fullmatch(r"buckets=(\d+)", name) for name in names_in(spark, f"{at}/chunks") if name[0] not in "._"]
    return int(found[0][1]) if len(found) == 1 and found[0] else 0


def bucketed(spark: SparkSession, at: str, n_buckets: int) -> DataFrame:
    """Digests and data of a store's chunks, which Spark knows to lie in buckets: a join on the digest moves none of them."""
    name = f"chunks_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (digest BINARY, data BINARY) USING parquet CLUSTERED BY (digest) INTO {n_buckets} BUCKETS LOCATION '{at}/chunks/buckets={n_buckets}'")
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")  # the files stay, and the table read has them


def join_chunks(wanted: DataFrame, chunks: DataFrame, lying: DataFrame | None = None, n_buckets: int = 0) -> DataFrame:
    """wanted (start, pos, digest) with the data of each digest, null where it is missing.

    lying: the chunks again, as a table of n_buckets buckets. Uses go to their chunks there. A chunk that very many
    documents hold goes to several tasks, each with some of its uses. Those chunks are under 1 / HOT_SHARE, as each
    has more than that share of all uses, so their list is broadcast.
    """
    uses = wanted.groupBy("digest").agg(F.count("*").alias("uses"))
    total = wanted.agg(F.count("*")).first()[0]
    most = max(HOT_USES, int(total * HOT_SHARE))
    hot = uses.where(F.col("uses") > most).select("digest", F.ceil(F.col("uses") / most).cast("int").alias("parts"))
    if lying is not None:
        any_hot = not hot.isEmpty()
        cold = wanted.join(F.broadcast(hot), "digest", "left_anti") if any_hot else wanted
        # the uses, which are small, are hashed; the chunks stream by unsorted
        cold = cold.repartition(n_buckets, "digest").hint("shuffle_hash").join(lying, "digest", "left")
        if not any_hot:
            return cold
        wanted, chunks = wanted.join(F.broadcast(hot.select("digest")), "digest", "left_semi"), chunks.join(F.broadcast(hot.select("digest")), "digest", "left_semi")
    parts = F.coalesce("parts", F.lit(1))
    left = wanted.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.pmod(F.xxhash64("start", "pos"), parts).cast("int")).drop("parts")
    right = chunks.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    found = left.join(right, ["digest", "salt"], "left").drop("salt")
    return found if lying is None else cold.unionByName(found)


def _rebuild(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents from rows sorted by start and pos: a head (pos -1), then the chunks."""
    head, leaves, pieces, out = None, [], [], []

    def close() -> None:
        raw = b"".join(pieces)
        if merkle(leaves) != head[2] or len(raw) != 4 * head[3]:
            raise ValueError(f"document at {head[0]} doesn't match its recipe")
        out.append((head[1], head[0], head[3], raw))

    kind = None
    for batch in it:
        kind = batch.column(4).type
        for start, pos, name, data, doc_id, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if pos < 0:
                if head:
                    close()
                head, leaves, pieces = (start, doc_id, name, n), [], []
            else:
                raw = unpack(data) if data is not None else b""
                if head is None or head[0] != start or digest(raw) != name:
                    raise ValueError(f"chunk {name.hex()} is missing or damaged")
                leaves.append(name)
                pieces.append(raw)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((kind, pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "start", "n_tokens", "ids"])
            out = []
    if head:
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((kind, pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "start", "n_tokens", "ids"])


def op9_token_store(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    to = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_store(table(spark, sf_dir, "documents"), to, public_tokenizers.path("word_bpe_49k.json"))
    return read_store(spark, to).select("doc_id", "start", "n_tokens", F.crc32("ids").cast("long").alias("ids_crc32"))
