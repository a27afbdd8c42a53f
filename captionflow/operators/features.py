"""Box-feature tables: decoding of text cells, key-value build and the end-to-end job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionflow.functions import arrays as A
from captionflow.functions import text as T
from captionflow.operators import boxes, captions

#: Matrix columns of a feature table and their widths; None: as many columns as ``feature_width``.
MATRICES = {"features": None, "boxes": 4, "featureHeading": 1, "featureElevation": 1, "featureViewIndex": 1}


def has_boxes(cell: Column) -> Column:
    """False for an empty, null or undecodable matrix cell."""
    return F.coalesce(F.octet_length(F.try_to_binary(cell, F.lit("base64"))) > 0, F.lit(False))


def keyed(rows: DataFrame, keys: DataFrame, order: str) -> DataFrame:
    """Feature rows of the wanted photos: the first row of each photo, left out if it has no boxes, though it hides later copies."""
    typed = rows.withColumn("photo_id", F.col("photo_id").try_cast("long"))
    return captions.first_match(typed, keys, "photo_id", order, has_boxes(F.col("boxes")))


def key_values(rows: DataFrame, keys: DataFrame, order: str) -> DataFrame:
    """(key, columns) ready for ``sinks.write_key_values``: key is ``listing-photo``, one row each."""
    kept = keyed(rows, keys, order)
    return kept.select(T.photo_key(F.col("listing_id"), F.col("photo_id")).alias("key"), *[c for c in kept.columns if c not in ("listing_id", "photo_id", order)])


def decoded(rows: DataFrame, feature_width: int, kind: str = "float64") -> DataFrame:
    """Text cells decoded to arrays of arrays; cells that can't be decoded become null."""
    present = {c: w or feature_width for c, w in MATRICES.items() if c in rows.columns}
    return rows.withColumns({c: A.decode_matrix(F.col(c), F.lit(w), kind) for c, w in present.items()})


def per_box(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, box, x1, y1, x2, y2, feature): one row for each box of decoded rows, numbered from 0."""
    pairs = rows.select(*keys, F.posexplode(F.arrays_zip("boxes", F.slice("features", F.lit(1), F.size("boxes")).alias("features"))).alias("box", "z"))
    corner = lambda i: F.get(F.col("z.boxes"), F.lit(i))
    return pairs.select(*keys, "box", corner(0).alias("x1"), corner(1).alias("y1"), corner(2).alias("x2"), corner(3).alias("y2"), F.col("z.features").alias("feature"))


def build(images: DataFrame, detector, schema: str, image: str, threshold: float, nms_threshold: float, least: int = 5, most: int = 20) -> DataFrame:
    """One job from images to selected boxes: detect, suppress, select by confidence. ``schema`` holds image, box, confidence, x1, y1, x2, y2 and more."""
    found = boxes.extract(images, detector, schema)
    return boxes.select_boxes(boxes.non_maximum(found, nms_threshold), image, "confidence", threshold, least, most)
