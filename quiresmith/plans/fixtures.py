"""Page geometry, words and ink derived from the documents table by integer arithmetic."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_WIDTH = 2200
SPACES = re.compile(r"[ \n]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(docs: DataFrame) -> DataFrame:
    """(page_id, words): words of a text, split at runs of spaces and newlines."""
    return docs.where("text is not null").select(F.col("doc_id").alias("page_id"), F.split(F.regexp_replace("text", r"[ \n]+", " "), " ").alias("words"))


def _pick(values: list, k: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (k + 1).cast("int"))


#: Lines, words or pages that Python works on together; more pass in further batches.
CHUNK = 20_000
SIX = re.compile(r"((?:[^ ]* ){5}[^ ]*) ")
LINE_COLUMNS = "line_idx long, text string, x0 double, y0 double, x1 double, y1 double, line_conf double"
Batches = Iterator[pa.RecordBatch]


def six_words(text: str) -> list[str]:
    """Lines of six words."""
    return SIX.sub(r"\1\n", SPACES.sub(" ", text)).split("\n")


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int | None, str]]:
    """(page_id, text) of rows whose second column is a text or a list of them."""
    for at in range(0, batch.num_rows, 256):  # texts become Python's a few at a time, as they can be long
        part = batch.slice(at, 256)
        for p, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            if isinstance(t, list):
                yield from ((p, x) for x in t)
            elif t is not None:
                yield p, t


def _defects(p: int | None, rows: list[str]) -> list[str]:
    """Texts of a page's lines with injected recognition defects."""
    if p is None:
        return rows
    out = rows[:]
    for kind in range(14):
        for n in range((kind - p) % 14, len(rows), 14):
            if p + n < 0 and kind:  # a remainder has the sign of its dividend
                continue
            t = rows[n]
            if kind == 0:
                t = f"1 1/2 cups {t}"
            elif kind == 1:
                t = f"11\u20442 cups {t}"
            elif kind == 2:
                t = f"<b>{t}</b>"
            elif kind == 3:
                t = f"\u2022 {t}"
            elif kind == 4:
                t = f"{t} <math>\\frac{{3}}{{4}}</math> cup"
            elif kind == 5:
                t = f"{t}-"
            elif kind == 6:
                t = t.lower()
            elif kind == 7:
                t = f"| {t} |"
            elif kind == 8:
                t = f"{t}:"
            elif kind == 9:
                t = f"\u00bd cup {t}"
            elif kind == 10:
                t = f"Salt {t[:20]}"
            elif kind == 11:
                t = "BEANE NRA RENE"
            elif kind == 12:
                t = f"\ufb01{t}"
            elif n % 3 == 0:
                t = f"12/31/24 or 92/71/2 {t}"
            out[n] = t
    return out


def line_batches(it: Batches) -> Batches:
    """Lines of batches (page_id, text), or (page_id, texts): page_id and LINE_COLUMNS. A page's lines stay in one batch."""

    def columns(ids: list, counts: list[int], texts: list[str], kind: pa.DataType) -> pa.RecordBatch:
        size = np.array(counts, np.int64)
        known = np.repeat(np.array([x is not None for x in ids], bool), size)
        p = np.repeat(np.array([x or 0 for x in ids], np.int64), size)
        n = np.arange(len(texts), dtype=np.int64) - np.repeat(np.cumsum(size) - size, size)
        rest = np.fmod  # of the sign of its dividend
        two = known & (p % 3 == 0)
        banner = two & (n % 17 == 5)
        x0 = np.where(banner, 120, 120 + np.where(two, n % 2, 0) * 1100 + rest(p * 7 + n * 13, 40)).astype(np.float64)
        r = np.where(two, n // 2, n)
        y0 = (200 + r * 60 + r // 5 * 70).astype(np.float64)
        x1 = x0 + (np.where(banner, 1600, np.where(two, 900, 1800)) - n * 37 % 150)
        y1 = y0 + 40 + np.where(n % 9 == 4, 24, 0)
        conf = (np.where(rest(p, 4) == 1, 40, 55) + rest(p * 31 + n * 17, 45)) / 100.0
        some = lambda a: pa.array(a, mask=None if known.all() else ~known)
        values = [pa.array(p, kind, mask=None if known.all() else ~known), pa.array(n), pa.array(texts, pa.string()), some(x0), pa.array(y0), some(x1), pa.array(y1), some(conf)]
        return pa.RecordBatch.from_arrays(values, ["page_id", "line_idx", "text", "x0", "y0", "x1", "y1", "line_conf"])

    for batch in it:
        ids, counts, texts = [], [], []
        for p, t in _texts(batch):
            if len(texts) >= CHUNK and p != ids[-1]:
                yield columns(ids, counts, texts, batch.schema.field(0).type)
                ids, counts, texts = [], [], []
            rows = six_words(t)
            ids.append(p)
            counts.append(len(rows))
            texts += _defects(p, rows)
        if ids:
            yield columns(ids, counts, texts, batch.schema.field(0).type)


def texts(docs: DataFrame) -> DataFrame:
    """(page_id, text) of documents that have a text."""
    return docs.where("text is not null").select(F.col("doc_id").alias("page_id"), "text")


def page_texts(docs: DataFrame) -> DataFrame:
    """(page_id, texts): one row a page. Only raw texts are shuffled, so what is derived from a page is made where it lies."""
    return texts(docs).groupBy("page_id").agg(F.collect_list("text").alias("texts"))


def id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def page_rows(p: int | None, found: list[str]) -> list[tuple[int, str]]:
    """(line_idx, text) of a page's lines, in that order; found: its texts, several where an id repeats."""
    rows = [x for t in found for x in enumerate(_defects(p, six_words(t)))]
    return sorted(rows) if len(found) > 1 else rows


def line_texts(docs: DataFrame) -> DataFrame:
    """(page_id, text): a page's lines joined by newlines."""

    def run(it: Batches) -> Batches:
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                joined = ["\n".join(t for _, t in page_rows(p, found)) for p, found in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(joined, pa.string())], ["page_id", "text"])

    return page_texts(docs).mapInArrow(run, f"page_id {id_type(docs)}, text string")


def ocr_lines(docs: DataFrame) -> DataFrame:
    """Lines of six words with boxes, confidence and injected recognition defects."""
    return texts(docs).mapInArrow(line_batches, f"page_id {id_type(docs)}, {LINE_COLUMNS}")


WORD_COLUMNS = ["page_id", "psm", "word_idx", "block_num", "par_num", "line_num", "left", "text", "conf"]


def word_batches(it: Batches) -> Batches:
    """Words of batches (page_id, texts) in four segmentation modes, as ocr_words has them. A page's words stay in one batch."""

    def columns(ids: list, counts: list[int], found: list[str], kind: pa.DataType) -> pa.RecordBatch:
        size = np.array(counts, np.int64)
        i = np.arange(len(found), dtype=np.int64) - np.repeat(np.cumsum(size) - size, size)
        known = np.tile(np.repeat(np.array([x is not None for x in ids], bool), size), 4)
        p = np.tile(np.repeat(np.array([x or 0 for x in ids], np.int64), size), 4)
        text = pa.array(["" if k % 23 == 7 else w for k, w in zip(i.tolist(), found, strict=True)], pa.string())
        psm, i = np.repeat(np.array([1, 3, 4, 6], np.int64), len(found)), np.tile(i, 4)
        left = (5 - i % 6) * 180 + np.fmod(p, 50)
        conf = np.fmod(p * 13 + i * 7 + psm * np.fmod(p, 5) * 11, 101) - 1
        some = lambda a, t=pa.int64(): pa.array(a, t, mask=None if known.all() else ~known)
        plain = [some(p, kind), *map(pa.array, (psm, i, i // 60, i // 30 % 2, i // 6 % 5)), some(left), pa.concat_arrays([text] * 4), some(conf)]
        return pa.RecordBatch.from_arrays(plain, WORD_COLUMNS)

    for batch in it:
        ids, counts, found = [], [], []
        for p, t in _texts(batch):
            if len(found) >= CHUNK and p != ids[-1]:
                yield columns(ids, counts, found, batch.schema.field(0).type)
                ids, counts, found = [], [], []
            row = SPACES.sub(" ", t).split(" ")
            ids.append(p)
            counts.append(len(row))
            found += row
        if ids:
            yield columns(ids, counts, found, batch.schema.field(0).type)


LABELS = ["PageHeader", "SectionHeader", "Text", "ListItem", "Table", "Picture", "Caption", "Footnote", "TableOfContents", "Figure", "PageFooter"]


def blocks(docs: DataFrame) -> DataFrame:
    """Nine layout blocks a page; the last overlaps the first two."""
    k, p = F.col("block_idx"), F.col("page_id")
    rows = docs.where("text is not null").select(F.col("doc_id").alias("page_id")).withColumn("block_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))))
    label = (
        F.when(p % 7 == 3, _pick(["Text", "ListItem", "SectionHeader"], k % 3))
        .when(p % 7 == 4, F.when(k < 2, F.lit("Text")).otherwise("Footnote"))
        .when(p % 7 == 5, F.when(k == 0, F.lit("TableOfContents")).otherwise("Footnote"))
        .when(p % 7 == 6, F.lit("Footnote"))
        .when((p % 5 == 2) & k.isin(2, 3), F.lit("Caption"))
        .when((p % 5 == 2) & (k == 4), F.lit("Picture"))
        .otherwise(_pick(LABELS, (p + k) % 11))
    )
    return rows.select(
        "page_id",
        "block_idx",
        ((k * 5) % 9).alias("position"),
        label.alias("label"),
        F.lit(100.0).alias("x0"),
        F.when(k == 8, F.lit(180.0)).otherwise(180.0 + k * 300).alias("y0"),
        F.when((p % 3 == 0) & (k % 2 == 1), F.lit(1150.0)).otherwise(2150.0).alias("x1"),
        F.when(k == 8, F.lit(700.0)).otherwise(450.0 + k * 300).alias("y1"),
    )


def ocr_words(docs: DataFrame) -> DataFrame:
    """Recognised words of four segmentation modes; blank and unscored ones among them."""
    i, p, psm = F.col("word_idx"), F.col("page_id"), F.col("psm")
    rows = words(docs).select("page_id", F.posexplode("words").alias("word_idx", "word"))
    rows = rows.withColumn("word_idx", i.cast("long")).withColumn("psm", F.explode(F.array(*(F.lit(x).cast("long") for x in (1, 3, 4, 6)))))
    return rows.select(
        "page_id",
        "psm",
        "word_idx",
        F.floor(i / 60).alias("block_num"),
        (F.floor(i / 30) % 2).alias("par_num"),
        (F.floor(i / 6) % 5).alias("line_num"),
        ((5 - i % 6) * 180 + p % 50).alias("left"),
        F.when(i % 23 == 7, F.lit("")).otherwise(F.col("word")).alias("text"),
        ((p * 13 + i * 7 + psm * (p % 5) * 11) % 101 - 1).alias("conf"),
    )


def ink(docs: DataFrame) -> DataFrame:
    """Ink of each pixel column of a page's raster, 600 wide and 1000 high."""
    p, x = F.col("page_id"), F.col("x")
    rows = docs.select(F.col("doc_id").alias("page_id")).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(599).cast("long"))))
    value = (
        F.when((x < 40) | (x >= 560), F.lit(0))
        .when((p % 3 == 0) & x.between(295, 309), F.lit(0))
        .when((p % 5 == 0) & x.between(200, 216), F.lit(900))
        .when((p % 4 == 1) & x.between(460, 480), F.lit(0))
        .otherwise(200 + (p * 7 + x * 3) % 90)
    )
    return rows.select("page_id", "x", value.cast("double").alias("ink"), F.lit(600).cast("long").alias("w"), F.lit(1000).cast("long").alias("h"))


RASTER_W, RASTER_H = 360, 30


def rasters(docs: DataFrame) -> DataFrame:
    """(page_id, w, h, pixels): gray images with text, gutters and rules."""
    return raster_ids(docs).mapInArrow(raster_batches, f"page_id {id_type(docs)}, w long, h long, pixels binary")


def raster_ids(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select("doc_id")


def raster_batches(it: Batches) -> Batches:
    """Images of batches (page_id), a few to a batch."""
    y, x = np.mgrid[:RASTER_H, :RASTER_W]
    for whole in it:
        for at in range(0, whole.num_rows, 256):
            batch, out = whole.slice(at, 256), []
            for p in batch.column(0).to_pylist():
                text = (y % 10 < 6) & ((x * 7 + y * 3 + p) % 5 < 3) & (x >= 12) & (x < 348) & ~((p % 3 == 0) & (x >= 172) & (x < 188))
                rule = (p % 2 == 0) & (y == 24) & (x >= 20) & (x < 340) | (p % 5 == 0) & (x >= 178) & (x < 181)
                out.append(np.where(rule, 20, np.where(text, (x * y + p) % 70, 190 + (p * 7 + x * 3 + y * 5) % 50)).astype(np.uint8).tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([RASTER_W] * n, pa.int64()), pa.array([RASTER_H] * n, pa.int64()), pa.array(out, pa.binary())], ["page_id", "w", "h", "pixels"])


def lexicon(docs: DataFrame) -> DataFrame:
    """(token, cnt, total): English tokens with their counts; stands in for a word-frequency list."""
    token = F.explode(F.split(F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}]+", " ")), " "))
    counts = docs.where("lang = 'en' and text is not null").select(token.alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("cnt"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("cnt").alias("total"))))  # the total is one row


SQL = {
    "words": r"""words AS (SELECT doc_id AS page_id, string_split(regexp_replace(text, '[ \n]+', ' ', 'g'), ' ') AS words FROM documents WHERE text IS NOT NULL)""",
    "ocr_lines": r"""words AS (SELECT doc_id AS page_id, string_split(regexp_replace(text, '[ \n]+', ' ', 'g'), ' ') AS words FROM documents WHERE text IS NOT NULL),
line0 AS (SELECT page_id, words, unnest(range(0, (len(words) + 5) // 6)) AS line_idx FROM words),
line1 AS (SELECT page_id, CAST(line_idx AS BIGINT) AS line_idx, array_to_string(words[line_idx * 6 + 1 : line_idx * 6 + 6], ' ') AS t,
  page_id % 3 = 0 AS two, page_id % 3 = 0 AND line_idx % 17 = 5 AS banner,
  CASE WHEN page_id % 3 = 0 THEN line_idx % 2 ELSE 0 END AS c, CASE WHEN page_id % 3 = 0 THEN line_idx // 2 ELSE line_idx END AS r FROM line0),
line2 AS (SELECT page_id, line_idx, CASE (page_id + line_idx) % 14 WHEN 0 THEN '1 1/2 cups ' || t WHEN 1 THEN '11⁄2 cups ' || t WHEN 2 THEN '<b>' || t || '</b>'
  WHEN 3 THEN '• ' || t WHEN 4 THEN t || ' <math>\frac{3}{4}</math> cup' WHEN 5 THEN t || '-' WHEN 6 THEN lower(t) WHEN 7 THEN '| ' || t || ' |'
  WHEN 8 THEN t || ':' WHEN 9 THEN '½ cup ' || t WHEN 10 THEN 'Salt ' || substr(t, 1, 20) WHEN 11 THEN 'BEANE NRA RENE' WHEN 12 THEN 'ﬁ' || t WHEN 13 THEN CASE WHEN line_idx % 3 = 0 THEN '12/31/24 or 92/71/2 ' || t ELSE t END ELSE t END AS text,
  CAST(CASE WHEN banner THEN 120 ELSE 120 + c * 1100 + (page_id * 7 + line_idx * 13) % 40 END AS DOUBLE) AS x0,
  CASE WHEN banner THEN 1600 WHEN two THEN 900 ELSE 1800 END - (line_idx * 37) % 150 AS width,
  CAST(200 + r * 60 + (r // 5) * 70 AS DOUBLE) AS y0,
  (CASE WHEN page_id % 4 = 1 THEN 40 ELSE 55 END + (page_id * 31 + line_idx * 17) % 45) / 100.0 AS line_conf FROM line1),
ocr_lines AS (SELECT page_id, line_idx, text, x0, y0, x0 + width AS x1, y0 + 40 + CASE WHEN line_idx % 9 = 4 THEN 24 ELSE 0 END AS y1, CAST(line_conf AS DOUBLE) AS line_conf FROM line2)""",
    "blocks": r"""block0 AS (SELECT doc_id AS page_id, CAST(unnest(range(0, 9)) AS BIGINT) AS block_idx FROM documents WHERE text IS NOT NULL),
blocks AS (SELECT page_id, block_idx, (block_idx * 5) % 9 AS position,
  CASE WHEN page_id % 7 = 3 THEN ['Text', 'ListItem', 'SectionHeader'][1 + block_idx % 3]
       WHEN page_id % 7 = 4 THEN CASE WHEN block_idx < 2 THEN 'Text' ELSE 'Footnote' END
       WHEN page_id % 7 = 5 THEN CASE WHEN block_idx = 0 THEN 'TableOfContents' ELSE 'Footnote' END
       WHEN page_id % 7 = 6 THEN 'Footnote'
       WHEN page_id % 5 = 2 AND block_idx IN (2, 3) THEN 'Caption' WHEN page_id % 5 = 2 AND block_idx = 4 THEN 'Picture'
       ELSE ['PageHeader', 'SectionHeader', 'Text', 'ListItem', 'Table', 'Picture', 'Caption', 'Footnote', 'TableOfContents', 'Figure', 'PageFooter'][1 + (page_id + block_idx) % 11] END AS label,
  CAST(100 AS DOUBLE) AS x0, CAST(CASE WHEN block_idx = 8 THEN 180 ELSE 180 + block_idx * 300 END AS DOUBLE) AS y0,
  CAST(CASE WHEN page_id % 3 = 0 AND block_idx % 2 = 1 THEN 1150 ELSE 2150 END AS DOUBLE) AS x1, CAST(CASE WHEN block_idx = 8 THEN 700 ELSE 450 + block_idx * 300 END AS DOUBLE) AS y1 FROM block0)""",
    "ocr_words": r"""words AS (SELECT doc_id AS page_id, string_split(regexp_replace(text, '[ \n]+', ' ', 'g'), ' ') AS words FROM documents WHERE text IS NOT NULL),
word0 AS (SELECT page_id, words, CAST(unnest(range(0, len(words))) AS BIGINT) AS i FROM words),
word1 AS (SELECT page_id, words[i + 1] AS word, i, CAST(unnest([1, 3, 4, 6]) AS BIGINT) AS psm FROM word0),
ocr_words AS (SELECT page_id, psm, i AS word_idx, i // 60 AS block_num, (i // 30) % 2 AS par_num, (i // 6) % 5 AS line_num, (5 - i % 6) * 180 + page_id % 50 AS left_,
  CASE WHEN i % 23 = 7 THEN '' ELSE word END AS text, (page_id * 13 + i * 7 + psm * (page_id % 5) * 11) % 101 - 1 AS conf FROM word1)""",
    "ink": r"""ink AS (SELECT page_id, x, CAST(CASE WHEN x < 40 OR x >= 560 THEN 0 WHEN page_id % 3 = 0 AND x BETWEEN 295 AND 309 THEN 0 WHEN page_id % 5 = 0 AND x BETWEEN 200 AND 216 THEN 900
  WHEN page_id % 4 = 1 AND x BETWEEN 460 AND 480 THEN 0 ELSE 200 + (page_id * 7 + x * 3) % 90 END AS DOUBLE) AS ink, 600 AS w, 1000 AS h
  FROM (SELECT doc_id AS page_id, CAST(unnest(range(0, 600)) AS BIGINT) AS x FROM documents))""",
    "raster_ink": r"""px AS (SELECT page_id, x, y, CASE WHEN page_id % 2 = 0 AND y = 24 AND x >= 20 AND x < 340 OR page_id % 5 = 0 AND x >= 178 AND x < 181 THEN 20
  WHEN y % 10 < 6 AND (x * 7 + y * 3 + page_id) % 5 < 3 AND x >= 12 AND x < 348 AND NOT (page_id % 3 = 0 AND x >= 172 AND x < 188) THEN (x * y + page_id) % 70
  ELSE 190 + (page_id * 7 + x * 3 + y * 5) % 50 END AS g FROM (SELECT doc_id AS page_id FROM documents), range(0, 360) xs(x), range(0, 30) ys(y)),
shade AS (SELECT page_id, g, count(*) AS c FROM px GROUP BY ALL),
cum AS (SELECT page_id, g, sum(c) OVER (PARTITION BY page_id ORDER BY g) AS n, sum(c * g) OVER (PARTITION BY page_id ORDER BY g) AS s,
  sum(c) OVER (PARTITION BY page_id) AS tn, sum(c * g) OVER (PARTITION BY page_id) AS ts FROM shade),
sp AS (SELECT page_id, g, CAST(tn * s - n * ts AS DOUBLE) * CAST(tn * s - n * ts AS DOUBLE) / CAST(n * (tn - n) AS DOUBLE) AS spread FROM cum WHERE n < tn),
lev AS (SELECT page_id, g AS level FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY spread DESC, g) AS k FROM sp) WHERE k = 1),
dark AS (SELECT page_id, y, x, x - row_number() OVER (PARTITION BY page_id, y ORDER BY x) AS run FROM px JOIN lev USING (page_id) WHERE g <= level),
runs AS (SELECT page_id, x, count(*) OVER (PARTITION BY page_id, y, run) AS n FROM dark),
ci AS (SELECT page_id, x, count(*) AS c FROM runs WHERE n < 40 GROUP BY ALL),
ink AS (SELECT page_id, x, CAST(coalesce(c, 0) AS DOUBLE) AS ink, 360 AS w, 30 AS h FROM (SELECT doc_id AS page_id, CAST(unnest(range(0, 360)) AS BIGINT) AS x FROM documents) LEFT JOIN ci USING (page_id, x))""",
    "lexicon": r"""lex0 AS (SELECT unnest(string_split(lower(regexp_replace(text, '[^\p{L}\p{N}]+', ' ', 'g')), ' ')) AS token FROM documents WHERE lang = 'en' AND text IS NOT NULL),
lex1 AS (SELECT token, count(*) AS cnt FROM lex0 WHERE token <> '' GROUP BY token),
lexicon AS (SELECT token, cnt, (SELECT sum(cnt) FROM lex1) AS total FROM lex1)""",
}


def with_(*names: str) -> str:
    """WITH clause of the named fixtures in DuckDB's SQL."""
    seen, out = set(), []
    for n in names:
        text = SQL[n]
        if text.startswith("words AS") and n != "words":
            head, _, rest = text.partition(",\n")
            if "words" in seen:
                text = rest
            seen.add("words")
        out.append(text)
    return "WITH RECURSIVE " + ",\n".join(out)
