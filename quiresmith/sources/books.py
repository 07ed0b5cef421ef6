"""Books and their progress: scans, page lists, checkpoints, resuming, Markdown output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT = "page INT, conf DOUBLE, mode STRING, chars INT"


class NoBooks(SystemExit):
    """No input found; the process ends with status 1."""

    def __init__(self, where: str):
        super().__init__(1)
        self.where = where


def scan_pdfs(spark: SparkSession, folder: str, required: bool = True) -> DataFrame:
    """(path, book, modificationTime, length, content) of the PDFs in a folder, by name; content is read only where used."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    rows = rows.withColumn("book", F.regexp_extract("path", r"([^/]+)\.pdf$", 1)).orderBy("path")
    if required and rows.select("path").isEmpty():
        raise NoBooks(folder)
    return rows


def pages(books: DataFrame) -> DataFrame:
    """(book, page) for page = 1..page_count; books without pages give none."""
    return books.where("page_count > 0").select("book", F.explode(F.sequence(F.lit(1).cast("long"), F.col("page_count").cast("long"))).alias("page"))


def batch_of(page: Column, size: int) -> Column:
    return F.floor((page - 1) / max(1, size)).cast("long")


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON lines; a row's book is its own or, without one, the file's name. Malformed lines are skipped."""
    of_file = F.regexp_extract(F.input_file_name(), r"([^/]+?)\.(?:jsonl|json)$", 1)
    text = spark.read.option("recursiveFileLookup", "true").text(path).withColumn("book", F.coalesce(F.get_json_object("value", "$.book"), of_file))
    return parse_checkpoints(text)


def parse_checkpoints(rows: DataFrame) -> DataFrame:
    """(book, value) with JSON text in value to (book, page, conf, mode, chars); what isn't JSON is dropped."""
    return rows.withColumn("r", F.from_json("value", CHECKPOINT + ", _bad STRING", {"columnNameOfCorruptRecord": "_bad"})).where("r is not null and r._bad is null").select("book", "r.page", "r.conf", "r.mode", "r.chars")


def last_page(books: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(book, last): the highest page recorded, 0 where none."""
    done = checkpoints.groupBy("book").agg(F.max("page").alias("last"))
    return books.join(done, "book", "left").select("book", F.coalesce("last", F.lit(0)).cast("long").alias("last"))


def resume(books: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(book, page) still to do: an anti join on recorded pages, so gaps are filled as well."""
    return pages(books).join(checkpoints.select("book", F.col("page").cast("long").alias("page")).distinct(), ["book", "page"], "left_anti")


def resume_state(total: Column, last: Column, tmp_pages: Column) -> Column:
    """What to do with a book: tmp_pages counts the headings written so far, null without a partial file."""
    return (
        F.when(last + 1 > total, F.when(F.coalesce(tmp_pages, F.lit(0)) >= total, "finalize").otherwise("restart"))
        .when(last == 0, "start")
        .when(tmp_pages.isNull(), "restart_without_checkpoint")
        .otherwise("resume")
    )


def page_headers(text: Column) -> Column:
    """How many page headings a book's Markdown has."""
    return F.regexp_count(text, F.lit(r"(?m)^##(?U:\s+)Page(?U:\s+)\d+(?U:\s*)$"))


def incomplete(books: DataFrame, written: DataFrame) -> DataFrame:
    """Books (book, page_count) whose Markdown (book, text) has fewer page headings than pages, or is missing."""
    full = books.join(written.select("book", page_headers(F.col("text")).alias("n")), "book").where("n >= page_count").select("book")
    return books.join(full, "book", "left_anti")


def header(book: Column, file: Column, total: Column, engine: str) -> Column:
    """The head of a book's Markdown; file: the name of the PDF, total: its pages."""
    return F.concat(F.lit("# "), book, F.lit("\n\n*OCR transcription of `"), file, F.lit("` ("), total, F.lit(f" pages). Engine: {engine}.*\n\n---\n"))


def section(page: Column, markdown: Column) -> Column:
    body = F.when(F.coalesce(F.trim(markdown), F.lit("")) == "", F.lit("_(no text detected)_")).otherwise(markdown)
    return F.concat(F.lit("\n## Page "), page, F.lit("\n\n"), body, F.lit("\n"))


def book_markdown(pages_md: DataFrame) -> DataFrame:
    """(book, markdown) of (book, page, markdown): sections in page order."""
    rows = pages_md.select("book", F.struct("page", section(F.col("page"), F.col("markdown")).alias("s")).alias("r"))
    return rows.groupBy("book").agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["s"]), "").alias("markdown"))


def write_books(books: DataFrame, path: str, force: bool = False) -> None:
    """(book, markdown) as text files, a partition a book, committed as a whole by Spark's writer.

    Books beside them under path stay. A book that is there already is an error, or replaced by force.
    """
    spark = books.sparkSession
    rows = books.select("book", F.col("markdown").alias("value"))
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not force and where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        there = spark.read.text(path)
        if "book" in there.columns:
            both = rows.select(F.col("book").cast("string")).join(there.select(F.col("book").cast("string")).distinct(), "book", "left_semi")
            if some := [r.book for r in both.limit(5).collect()]:
                raise FileExistsError(f"books already written under {path}: {some}")
    rows.write.mode("overwrite" if force else "append").option("partitionOverwriteMode", "dynamic").partitionBy("book").text(path)


def append_checkpoints(rows: DataFrame, path: str) -> None:
    """(book, page, conf, mode, chars) as JSON lines, added to what is there."""
    rows.select("book", "page", "conf", "mode", "chars").write.mode("append").json(path)


def scaled_size(width: Column, height: Column, dpi: Column, least: int = 320) -> tuple[Column, Column]:
    """Dimensions of a raster brought up to at least `least` DPI; those that have it stay."""
    grow = F.when(dpi >= least, F.lit(1.0)).otherwise(least / dpi)
    return (width * grow).cast("long"), (height * grow).cast("long")
