"""Sinks: TSV, JSON, text, partitioned text, key-value and document tables. All commit atomically, one file for each task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "error", line_end: str = "\n", header: bool = False) -> None:
    """Minimal quotes doubled inside, white space kept; columns not asked for are left out, nulls become empty texts. ``line_end`` may be CRLF."""
    chosen = df.select(*columns) if columns else df
    chosen.write.mode(mode).csv(path, sep="\t", quote='"', escape='"', emptyValue="", nullValue="", lineSep=line_end, header=header, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json(df: DataFrame, path: str, mode: str = "error", document: bool = False) -> None:
    """JSON lines, or with ``document`` one indented array in each part file; ``files.read_json_items`` reads either."""
    if not document:
        df.write.mode(mode).json(path, ignoreNullFields=False)
        return
    items = df.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))

    def array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = False
        for batch in batches:
            rows = []
            for item in batch.column(0).to_pylist():
                rows.append(("," if opened else "[") + item)
                opened = True
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if opened else "[]"])], names=["value"])

    items.mapInArrow(array, "value string").write.mode(mode).text(path)


def write_lines(df: DataFrame, column: str, path: str, mode: str = "error") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode(mode).text(path)


def write_partitioned_lines(df: DataFrame, key: str, column: str, path: str, mode: str = "error") -> None:
    """One folder of text files for each key. Rows are hashed on key and a salt, so a hot key is written by many tasks."""
    salted = df.select(F.col(key), F.col(column).cast("string").alias("value")).withColumn("_salt", F.pmod(F.xxhash64("value"), F.lit(8)))
    salted.repartition(key, "_salt").drop("_salt").write.mode(mode).partitionBy(key).text(path)


def write_key_values(df: DataFrame, key: str, path: str, mode: str = "error", existing: DataFrame | None = None) -> None:
    """Parquet in key order with a ``key`` column, so a look-up prunes to few row groups; keys in ``existing`` are skipped."""
    rows = df if key == "key" else df.withColumnRenamed(key, "key")
    if existing is not None:
        rows = rows.join(existing.select("key"), "key", "left_anti")
    rows.dropDuplicates(["key"]).repartitionByRange("key").sortWithinPartitions("key").write.mode(mode).parquet(path)


def write_documents(rooms: DataFrame, reviews: DataFrame, images: DataFrame, path: str, reset: bool = False) -> None:
    """The three collections of the document store; ``reset`` replaces all three."""
    for name, df in (("rooms", rooms), ("reviews", reviews), ("images", images)):
        df.write.mode("overwrite" if reset else "append").parquet(f"{path}/{name}")


def quarantine(df: DataFrame, good, path: str) -> DataFrame:
    """Writes the rows for which ``good`` isn't true beside the data and returns the others."""
    df.where(~F.coalesce(good, F.lit(False))).write.mode("append").json(path)
    return df.where(good)


def put(spark: SparkSession, path: str, content: str | bytes) -> None:
    """One small file by the Hadoop file system: an answer of a crawl, a list of scans, an image."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(content.encode() if isinstance(content, str) else content))
    finally:
        out.close()


def write_images(images: DataFrame, path: str, metadata=None, mode: str = "error", existing: DataFrame | None = None) -> None:
    """Key-value table of images (path, content): key is the file stem, with ``metadata`` (bytes -> map of texts, or None).

    The metadata reader, such as one of EXIF tags, is given, as no image library is required. Images it
    can't read have none. Keys in ``existing`` are skipped.
    """
    rows = images.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("key"), "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        for batch in batches:
            found = []
            for content in batch.column("content").to_pylist():
                try:
                    tags = metadata(content) if metadata else None
                except Exception:  # noqa: BLE001 - whatever the reader says, there are no tags
                    tags = None
                found.append(None if tags is None else [(str(k), str(v)) for k, v in tags.items()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=["key", "content", "metadata"])

    made = rows.mapInArrow(read, "key string, content binary, metadata map<string, string>")
    write_key_values(made, "key", path, mode, existing)
