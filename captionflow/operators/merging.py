"""Photos of one room merged into groups of bounded size.

Guards, grouping and re-chunking are window arithmetic over (listing, room), so a hot
listing is spread over its rooms. Balancing takes photos out of groups by ranks that are
cut before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from captionflow.functions import text as T
from captionflow.session import written

# The rooms whose photos are merged.
MERGING_ROOMS = ("bedroom", "living_room", "bathroom", "kitchen")


def fit_detections(photos: DataFrame, min_captioned: int = 2, min_length: int = 4) -> DataFrame:
    """Photos (listing_id, photo_id, room, score, captioned, pos) of listings with enough photos and captioned ones."""
    fit = photos.groupBy("listing_id").agg(F.count("*").alias("n"), F.count_if("captioned").alias("c")).where((F.col("n") >= min_length) & (F.col("c") >= min_captioned)).select("listing_id")
    return photos.join(fit, "listing_id", "left_semi")


def grouped(photos: DataFrame, rooms: tuple[str, ...] = MERGING_ROOMS) -> DataFrame:
    """Adds ``room_group``: photos of a merging room share it, any other photo stands alone."""
    return photos.withColumn("room_group", F.when(F.col("room").isin(*rooms), F.col("room")).otherwise(F.concat_ws("#", "room", "photo_id")))


def chunked(photos: DataFrame, most: int = 10) -> DataFrame:
    """Adds ``chunk``: groups of more than ``most`` photos are cut into max(1, min(ceil(n / most), captioned)) chunks.

    The first captioned photos seed one chunk each, any other photo goes to the chunk of
    its place modulo the number of chunks. Every group is cut once.
    """
    group = Window.partitionBy("listing_id", "room_group")
    line = group.orderBy("pos")
    n, c = F.count("*").over(group), F.count_if("captioned").over(group)
    place = F.row_number().over(line) - 1
    rank = F.count_if("captioned").over(line.rowsBetween(Window.unboundedPreceding, 0)) - 1
    m = F.greatest(F.lit(1), F.least(F.ceil(n / most), c))
    return photos.withColumn("chunk", F.when(n <= most, F.lit(0)).when(F.col("captioned") & (rank < m), rank).otherwise(place % m).cast("int"))


def balanced(photos: DataFrame, min_captioned: int = 2, min_length: int = 4, seed: int = 1) -> DataFrame:
    """Adds ``part``: photos are taken out of their groups until a listing has enough captioned groups and enough groups.

    ``part`` is 0 for a photo that stays and its own id for one that stands alone. In every group one
    photo stays, a captioned one if there is any, the first in hash order. Of the others, captioned ones go
    first while too few groups hold a caption, then any while there are too few groups, uncaptioned
    ones of a group before captioned ones. A listing that hasn't enough photos for it gives all it can.
    A listing needs at most ``min_captioned + min_length`` photos taken out, so ranks are cut there
    before the rows are shuffled, and no listing is gathered.
    """
    photos = written(photos, "chunked")  # read again for counts, keepers and both choices
    spare = min_captioned + min_length
    group = ["listing_id", "room_group", "chunk"]
    mark = F.struct((~F.col("captioned")).alias("plain"), T.hash_rank_key(seed, F.col("photo_id")).alias("h"), F.col("photo_id").alias("id"))
    per_group = photos.groupBy(*group).agg(F.max("captioned").alias("c"), F.min(mark)["id"].alias("keeper"))
    need = per_group.groupBy("listing_id").agg(F.count("*").alias("groups"), F.count_if("c").alias("rich"))
    need = need.where((F.col("groups") < min_length) | (F.col("rich") < min_captioned))
    free = photos.join(need, "listing_id").join(per_group.select(*group, "keeper"), group).where(F.col("photo_id") != F.col("keeper"))
    place = [T.hash_rank_key(seed, F.col("room_group"), F.col("chunk")), "room_group", "chunk"]
    order = [T.hash_rank_key(seed, F.col("photo_id")), "photo_id"]
    first = Window.partitionBy("listing_id").orderBy(*place, *order)
    rich = free.where("captioned").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= spare)
    rich = written(rich.where(F.col("_r") <= min_captioned - F.col("rich")).select("listing_id", "photo_id"), "first_taken")
    taken = rich.groupBy("listing_id").agg(F.count("*").alias("_t"))
    left = free.join(rich, ["listing_id", "photo_id"], "left_anti").join(taken, "listing_id", "left")
    second = Window.partitionBy("listing_id").orderBy(*place, "captioned", *order)
    more = left.withColumn("_r", F.row_number().over(second)).where(F.col("_r") <= spare)
    more = more.where(F.col("_r") <= min_length - F.col("groups") - F.coalesce("_t", F.lit(0))).select("listing_id", "photo_id")
    out = rich.unionByName(more).withColumnsRenamed({"listing_id": "_l", "photo_id": "_p"})
    joined = photos.join(out, (F.col("listing_id") == F.col("_l")) & (F.col("photo_id") == F.col("_p")), "left")
    return joined.withColumn("part", F.coalesce(F.col("_p"), F.lit(0))).drop("_l", "_p")


def merged_groups(photos: DataFrame, block: int = 1000) -> DataFrame:
    """(listing_id, room_group, chunk, part, block, n, members): the groups of ``balanced`` by blocks of their photos.

    ``members`` is at most about ``block`` photos in order, so a group as large as a listing, which
    chunking leaves where captions are few, is in no single row; ``n`` is the size of the block.
    """
    sizes = photos.groupBy("listing_id", "room_group", "chunk", "part").agg(F.count("*").alias("_n"))
    cols = ["listing_id", "room_group", "chunk", "part"]
    blocks = F.when(F.col("_n") <= block, F.lit(0)).otherwise(F.pmod(F.xxhash64("photo_id"), F.ceil(F.col("_n") / block).cast("int"))).cast("int")
    rows = photos.join(sizes, cols).withColumn("block", blocks)
    made = rows.groupBy(*cols, "block").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "photo_id"))).alias("g"))
    return made.select(*cols, "block", "n", F.transform("g", lambda x: x["photo_id"]).alias("members"))


def merged_photos(photos: DataFrame) -> DataFrame:
    """(photo_id, merging, weights, room) for every photo: the photos of its group, itself first.

    This is the shape of the dataset items, so each row carries its whole group; ``merged_groups`` gives
    every group once. Chunking bounds a group by its captions: a group of n photos of which c have one
    holds about n / min(c, n / 10) photos.
    """
    cols = ["listing_id", "room_group", "chunk", "part"]
    members = photos.groupBy(*cols).agg(F.sort_array(F.collect_list(F.struct("pos", "photo_id", "score"))).alias("g"))
    joined = photos.join(members, cols)
    others = F.filter("g", lambda x: x["photo_id"] != F.col("photo_id"))
    own = F.filter("g", lambda x: x["photo_id"] == F.col("photo_id"))
    every = F.concat(own, others)
    return joined.select("photo_id", F.transform(every, lambda x: x["photo_id"]).alias("merging"), F.transform(every, lambda x: x["score"]).alias("weights"), "room")
