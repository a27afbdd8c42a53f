"""Streaming counterparts: an extension, as the batch operators have no stream semantics of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionflow import schemas
from captionflow.functions import text as T


def caption_stream(spark: SparkSession, path: str) -> DataFrame:
    """TSV caption files as they arrive, with the time each file was written."""
    files = spark.readStream.schema(schemas.schema("captions")).options(sep="\t", quote='"', escape='"', multiLine=True, emptyValue="", nullValue="\u0000").csv(path)
    return files.withColumn("arrived", F.col("_metadata.file_modification_time"))


def first_uses(captions: DataFrame, time: str = "arrived", late: str = "1 hour") -> DataFrame:
    """Rows with the first use of a caption in a listing within the watermark; empty captions pass.

    Later uses are dropped, not blanked, as an append stream can't change rows it has given out.
    """
    marked = captions.withWatermark(time, late)
    return marked.where(~T.is_empty(F.col("caption"))).dropDuplicatesWithinWatermark(["listing_id", "caption"])


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, key, n) in tumbling windows; rows later than the watermark are left out."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, width), key).count()
    return counted.select(F.col("window.start").alias("start"), key, F.col("count").alias("n"))
