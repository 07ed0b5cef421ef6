"""Incremental digitisation: a file stream of pages, each committed with its progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def page_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def run_available(pages: DataFrame, digitise, out: str, checkpoint: str):
    """Everything that has arrived, once: pages (book, page, ...) through digitise to Parquet under out.

    Data and progress are committed together: a micro-batch's folder is rewritten as a whole if it is repeated, and
    the stream's checkpoint moves on only after it is complete.
    """

    def commit(batch: DataFrame, number: int) -> None:
        digitise(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = pages.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def running_confidence(pages: DataFrame, watermark: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Pages done and mean confidence by book and hour, of a stream (book, ts, conf); late rows within the watermark count."""
    return pages.withWatermark("ts", watermark).groupBy(F.window("ts", window), "book").agg(F.count("*").alias("pages"), F.avg("conf").alias("mean_conf"))
