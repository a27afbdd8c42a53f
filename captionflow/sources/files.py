"""File sources: TSV, JSON, text, CSV, images, graphs and key-value tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from captionflow import schemas
from captionflow.functions import text as T
from captionflow.functions import views


def read_tsv(spark: SparkSession, path: str | list[str], schema: StructType | str, header: bool = False, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """TSV with quotes doubled inside quotes and line breaks inside fields, of any field length.

    There are no nulls in the format: empty and missing text fields are read as empty texts,
    numbers that can't be read as null.
    """
    reader = spark.read.schema(schemas.schema(schema) if isinstance(schema, str) and schema in schemas.names() else schema).options(sep="\t", header=header, multiLine=True, quote='"', escape='"', emptyValue="", nullValue="\u0000", maxCharsPerColumn=-1)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.option("recursiveFileLookup", recursive).csv(path).fillna("")


def read_captions(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    return read_tsv(spark, path, "captions", **options)


def read_json_items(spark: SparkSession, path: str, schema: StructType | str, lines: bool = False) -> DataFrame:
    """One row for each element of the array documents, or with ``lines`` for each line object."""
    wanted = schemas.schema(schema) if isinstance(schema, str) and schema in schemas.names() else schema
    return spark.read.schema(wanted).json(path, multiLine=not lines)


def read_lines(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """Stripped lines; with a pattern, of all matching files below the folders."""
    reader = spark.read.option("recursiveFileLookup", pattern is not None)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(path).select(T.strip(F.col("value")).alias("value"))


def read_listing_documents(spark: SparkSession, path: str, file_name: str = "photos.json", root: str | None = None) -> DataFrame:
    """(listing_id, body, path) of the first readable document of each listing.

    The listing is the folder above the file, ``file_name`` a glob such as ``reviews*.json``. Folders whose
    name is no number and documents that are no JSON, or have nothing at the JSON path ``root``, are left
    out; the first path of the rest counts.
    """
    good = all_documents(spark, path, file_name).where(F.col("listing_id").isNotNull() & F.try_parse_json("body").isNotNull())
    if root:
        good = good.where(F.try_variant_get(F.try_parse_json("body"), root, "variant").isNotNull())
    first = Window.partitionBy("listing_id").orderBy("path")
    return good.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def all_documents(spark: SparkSession, path: str, file_name: str) -> DataFrame:
    """(listing_id, body, path) of all files of that name or glob: rooms, details, reviews or photos of a crawl."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", file_name).text(path, wholetext=True)
    place = F.col("_metadata.file_path")
    return files.select(F.regexp_extract(place, r"/(\d+)/[^/]+$", 1).try_cast("long").alias("listing_id"), F.col("value").alias("body"), place.alias("path"))


def unreadable_documents(spark: SparkSession, path: str, file_name: str = "photos.json") -> DataFrame:
    """(path, reason) of the documents that ``read_listing_documents`` leaves out as empty or corrupt."""
    blank = F.trim("body") == ""
    bad = all_documents(spark, path, file_name).where(blank | F.try_parse_json("body").isNull())
    return bad.select("path", F.when(blank, "empty").otherwise("corrupt").alias("reason"))


def read_open_data(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Semicolon CSV with named columns; its header line is skipped, not believed."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path, sep=";", header=True, enforceSchema=True, multiLine=True, quote='"', escape='"')


def read_place_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of comma files without the first of each file, uncut: fields are split plainly later.

    Files are read line by line in splits. The first line of a file is the one that a reader with a
    header takes off the split at the file's start; no separator of the format cuts a line.
    """
    reader = spark.read.schema("line string").options(sep="\u0001", header=True, enforceSchema=True, quote="", maxCharsPerColumn=-1)
    return reader.csv(path).where("line <> ''")


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """Keys of a key-value table written by ``sinks.write_key_values``; only the key column is read."""
    return spark.read.parquet(path).select("key")


def read_key_values(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """All rows of a key-value table, or those of ``keys`` (key); files are sorted by key, so a filter on it prunes row groups."""
    rows = spark.read.parquet(path)
    return rows if keys is None else rows.join(keys.select("key").distinct(), "key", "left_semi")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, listing_id, photo_id, length, content) of all files but those of no bytes, which Spark doesn't list; the content is read only where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jpg,jpeg,png}").load(path)
    name = F.regexp_extract("path", r"/(\d+)[-_](\d+)\.[^./]+$", 1).try_cast("long")
    return files.select("path", name.alias("listing_id"), T.photo_of_path(F.col("path")).alias("photo_id"), "length", "content")


def decoded_images(images: DataFrame, decode) -> DataFrame:
    """Adds width, height by ``decode(bytes) -> (width, height) or None``; unreadable images are dropped.

    ``decode`` is given, as no image library is required; it runs in Arrow batches.
    """
    @F.pandas_udf("struct<width: int, height: int>")
    def size(content: pd.Series) -> pd.DataFrame:
        got = []
        for data in content:
            try:
                got.append(decode(data))
            except Exception:  # noqa: BLE001 - whatever the decoder says, the image can't be read
                got.append(None)
        return pd.DataFrame([g or (None, None) for g in got], columns=["width", "height"]).astype("Int32")

    return images.withColumn("_s", size("content")).where("_s.width is not null").select("*", "_s.width", "_s.height").drop("_s")


def read_graph(spark: SparkSession, path: str, scans: DataFrame | None = None) -> DataFrame:
    """(scan, image_id) of the included nodes of ``{scan}_connectivity.json`` files, of the ``scans`` (value) if given."""
    nodes = spark.read.schema("image_id string, included boolean").option("pathGlobFilter", "*_connectivity.json").json(path, multiLine=True)
    named = nodes.where("included").select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_connectivity\.json$", 1).alias("scan"), "image_id")
    return named if scans is None else named.join(scans.select(F.col("value").alias("scan")).distinct(), "scan", "left_semi")


def panorama(nodes: DataFrame) -> DataFrame:
    """(scan, viewpoint, view, elevation, heading): 36 views of each node."""
    return nodes.select(F.explode(views.panorama_views(F.col("scan"), F.col("image_id"))).alias("v")).select("v.*")
