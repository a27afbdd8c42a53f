"""Positive and negative photo sequences of a listing, by seeded hash order.

The shapes follow the published call signatures; their bodies are not public, so the
definitions are our own: a positive is ``length`` photos of one listing in hash order,
a caption negative keeps the photos and permutes the captioned ones, an image negative
permutes the photos, a random negative takes photos of another listing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionflow.functions import text as T
from captionflow.operators.running import hash_order
from captionflow.session import written

#: Seed of the slots in which listings find each other.
SLOT_SEED = 5


def positives(photos: DataFrame, seed: int = 0, min_length: int = 4, max_length: int = 7, min_captioned: int = 2, max_captioned: int = 7) -> DataFrame:
    """(listing_id, photos, captioned): the sequence of each listing (listing_id, photo_id, caption) with enough photos and captions.

    Captioned photos come first into the choice, at most ``max_captioned``; ranks are cut
    before anything is gathered, so a hot listing gives at most ``max_length`` rows.
    """
    rows = photos.where("listing_id is not null and photo_id is not null").groupBy("listing_id", "photo_id").agg(F.min("caption").alias("caption"))
    rows = rows.withColumns({"captioned": ~T.is_captionless(F.col("caption")), "h": T.hash_rank_key(seed, F.col("photo_id"))})
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("listing_id", "captioned").orderBy("h", "photo_id"))).where(F.col("r") <= F.when(F.col("captioned"), max_captioned).otherwise(max_length))
    line = Window.partitionBy("listing_id").orderBy(F.col("captioned").desc(), "h", "photo_id")
    cut = ranked.withColumn("k", F.row_number().over(line)).where(F.col("k") <= max_length)
    made = cut.groupBy("listing_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("h", "photo_id"))), lambda x: x["photo_id"]).alias("photos"), F.transform(F.sort_array(F.collect_list(F.when(F.col("captioned"), F.struct("h", "photo_id")))), lambda x: x["photo_id"]).alias("captioned"))
    return made.where((F.size("photos") >= min_length) & (F.size("captioned") >= min_captioned))


def rotated(values: Column, by: Column) -> Column:
    n = F.size(values)
    k = F.pmod(by, n)
    return F.concat(F.slice(values, k + 1, n), F.slice(values, F.lit(1), k))


def with_negatives(positive: DataFrame, n_negatives: int = 2, per_slot: int = 1000) -> DataFrame:
    """Adds neg_captions, neg_images and neg_randoms with ``n_negatives`` sequences each.

    Permutations are rotations by 1, 2, ...; the other listing of a random negative is
    found by hash order: listings are put into slots of about ``per_slot`` by hash, each takes the photos of
    the listing that follows it in its slot (the slot's first after its last). A listing
    alone in its slot has no random negatives.
    """
    positive = written(positive, "positives")
    slots = max(1, positive.count() // per_slot)
    times = F.sequence(F.lit(1), F.lit(n_negatives))
    turned = positive.withColumns({"neg_images": F.transform(times, lambda k: rotated(F.col("photos"), k)), "neg_captions": F.transform(times, lambda k: rotated(F.col("captioned"), k))})
    line = Window.partitionBy(F.shiftright(hash_order("listing_id", seed=SLOT_SEED), 3) % slots).orderBy(F.sha1(F.col("listing_id").cast("string")), "listing_id")
    every = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    size, place = F.count("*").over(every), F.row_number().over(line)
    # the last listings of a slot go on at its first ones
    around = lambda k: [F.when((size > k) & (place == size - k + j), F.nth_value("photos", j).over(every)) for j in range(1, k + 1)]
    others = [F.coalesce(F.lead("photos", k).over(line), *around(k)) for k in range(1, n_negatives + 1)]
    return turned.withColumn("neg_randoms", F.filter(F.array(*others), lambda x: x.isNotNull() & (x != F.col("photos"))))


def fixed_samples(photos: DataFrame, seed: int = 0, min_length: int = 4, **limits: int) -> DataFrame:
    """The test set: (listing_id, positive, neg_captions, neg_images, neg_randoms)."""
    made = with_negatives(positives(photos, seed=seed, min_length=min_length, **limits))
    return made.select("listing_id", F.col("photos").alias("positive"), "neg_captions", "neg_images", "neg_randoms")
