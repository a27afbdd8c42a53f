"""Reports on what is missing, empty or corrupt."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def listing_report(listings: DataFrame, documents: DataFrame, images: DataFrame) -> DataFrame:
    """(reason, location, listing_id) for listings (listing_id, location) without images, and without, with an empty or with a corrupt document.

    ``documents`` has listing_id and body. A listing may have both kinds of entry.
    """
    no_images = listings.join(images.select("listing_id"), "listing_id", "left_anti").select(F.lit("missing images").alias("reason"), "location", "listing_id")
    body = F.when(F.trim(F.coalesce("body", F.lit(""))) == "", F.lit("empty document")).when(F.try_parse_json("body").isNull(), F.lit("corrupt document")).otherwise("good")
    state = documents.where("listing_id is not null").groupBy("listing_id").agg(F.max_by(body, F.when(body == "good", 2).when(body == "corrupt document", 1).otherwise(0)).alias("reason"))
    joined = listings.join(state, "listing_id", "left").select(F.coalesce("reason", F.lit("missing document")).alias("reason"), "location", "listing_id")
    return no_images.unionByName(joined.where("reason <> 'good'"))


def download_report(listings: DataFrame, images: DataFrame, documents: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(reason, location, listing_id) of listings (listing_id, location) that a crawl left incomplete.

    ``documents`` has listing_id, kind and body; ``kinds`` names each kind wanted and the JSON path that a
    good body has a value at. ``no folder``: no image of the listing; ``no <kind>``: no document of it, or
    only null or ``{}`` ones; ``corrupted <kind>``: other bodies, but none with a value at the path. A file
    of no bytes is not listed by Spark and counts as none.
    """
    out = listings.join(images.select("listing_id"), "listing_id", "left_anti").select(F.lit("no folder").alias("reason"), "location", "listing_id")
    for kind, path in kinds.items():
        parsed = F.try_parse_json("body")
        blank = F.trim(F.coalesce("body", F.lit("{}"))) == "{}"
        state = F.when(blank, 0).when(parsed.isNull() | F.try_variant_get(parsed, path, "variant").isNull(), 1).otherwise(2)
        best = documents.where((F.col("kind") == kind) & F.col("listing_id").isNotNull()).groupBy("listing_id").agg(F.max(state).alias("_s"))
        joined = listings.join(best, "listing_id", "left").where(F.coalesce("_s", F.lit(0)) < 2)
        reason = F.when(F.col("_s") == 1, f"corrupted {kind}").otherwise(f"no {kind}")
        out = out.unionByName(joined.select(reason.alias("reason"), "location", "listing_id"))
    return out


def missing_images(captions: DataFrame, files: DataFrame) -> DataFrame:
    """(reason, listing_id, photo_id) of captioned photos without a file."""
    return captions.join(files.select("photo_id"), "photo_id", "left_anti").select(F.lit("missing image").alias("reason"), "listing_id", "photo_id")


def corrupt_images(images: DataFrame, decode) -> DataFrame:
    """(reason, path) of image files that ``decode(bytes)`` can't read, and of those without metadata if it returns None."""
    @F.pandas_udf("string")
    def reason(content: pd.Series) -> pd.Series:
        out = []
        for data in content:
            try:
                out.append("no metadata" if decode(data) is None else None)
            except Exception:  # noqa: BLE001 - whatever the decoder says, the image can't be read
                out.append("corrupt image")
        return pd.Series(out, dtype=object)

    return images.select(reason("content").alias("reason"), "path").where("reason is not null")
