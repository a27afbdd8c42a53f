"""Room and indoor votes over class probabilities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scene names and the room each belongs to, in the order that decides ties.
HIERARCHY = (
    ("alcove", "alcove"), ("attic", "attic"), ("basement", "garage"), ("bathroom", "bathroom"), ("bedchamber", "bedroom"),
    ("bedroom", "bedroom"), ("bow_window/indoor", "alcove"), ("childs_room", "bedroom"), ("closet", "closet"), ("dining_room", "living_room"),
    ("dorm_room", "bedroom"), ("garage/indoor", "garage"), ("home_office", "office"), ("home_theater", "living_room"), ("hotel_room", "bedroom"),
    ("kitchen", "kitchen"), ("laundromat", "laundry"), ("living_room", "living_room"), ("nursery", "nursery"), ("nursing_home", "nursing"),
    ("pantry", "pantry"), ("playroom", "bedroom"), ("recreation_room", "bedroom"), ("restaurant_kitchen", "kitchen"), ("shower", "bathroom"),
    ("staircase", "staircase"), ("television_room", "living_room"), ("utility_room", "utility"), ("wet_bar", "kitchen"), ("youth_hostel", "bedroom"),
)
ROOMS = tuple(dict.fromkeys(room for _, room in HIERARCHY))
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def parse_scores(text: Column) -> Column:
    """array<struct<prob, name>> of a printed list of (number, 'name') pairs; numbers may stand in a wrapper like ``float32(0.3)``. Never evaluated."""
    pair = rf"\((?:[\w.]+\()?({_NUMBER})\)?,\s*['\"]([^'\"]*)['\"]\)"
    numbers = F.regexp_extract_all(text, F.lit(pair), 1)
    names = F.regexp_extract_all(text, F.lit(pair), 2)
    return F.zip_with(numbers, names, lambda p, n: F.struct(p.try_cast("double").alias("prob"), n.alias("name")))


def parse_flag(text: Column) -> Column:
    """The boolean of a printed (number, boolean) pair; null if there is none."""
    got = F.regexp_extract(text, r"\b(True|False)\b", 1)
    return F.when(got != "", got == "True")


def top_scores(scores: Column, k: int) -> Column:
    """The k most probable entries of array<struct<prob, name>>, ties by name downwards."""
    return F.slice(F.sort_array(scores, asc=False), 1, k)


def room_votes(scores: DataFrame, hierarchy: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, room, score): probability summed by coarse class, greatest first, ties by the order of the hierarchy.

    ``scores`` has the keys, name and prob; names outside the hierarchy count for nothing;
    a photo without any known name gets the first room with score 0. ``hierarchy`` has
    name, room, pos and is a fixed small table.
    """
    rooms = hierarchy.groupBy("room").agg(F.min("pos").alias("room_pos"))
    known = scores.join(F.broadcast(hierarchy), "name").groupBy(*keys, "room").agg(F.sum("prob").alias("score"))
    best = known.join(F.broadcast(rooms), "room").groupBy(*keys).agg(F.max_by(F.struct("room", "score"), F.struct(F.col("score"), -F.col("room_pos"))).alias("b"))
    first = hierarchy.orderBy("pos").first()
    return scores.select(*keys).distinct().join(best, keys, "left").select(*keys, F.coalesce("b.room", F.lit(first["room"] if first else None)).alias("room"), F.coalesce("b.score", F.lit(0.0)).alias("score"))


def indoor_votes(scores: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """(keys, mean, indoor) over the k most probable classes: outdoor is 1, indoor 0, and a mean below one half is indoor."""
    top = scores.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(F.struct("prob", "name", "outdoor")), asc=False), 1, k).alias("t"))
    mean = F.aggregate("t", F.lit(0.0), lambda a, x: a + x["outdoor"]) / F.size("t")
    return top.select(*keys, mean.alias("mean")).withColumn("indoor", F.col("mean") < 0.5)


def indoor_keys(detections: DataFrame) -> DataFrame:
    """``listing-photo`` keys of the photos whose printed indoor cell says so."""
    return detections.where(parse_flag(F.col("is_indoor"))).select(F.concat_ws("-", "listing_id", "photo_id").alias("key"))


def infer(images: DataFrame, model, batch: int = 100) -> DataFrame:
    """Detections of any model: ``model(list of bytes) -> list of (category, attributes, is_indoor)``, in Arrow batches."""
    def run(batches):
        for pdf in batches:
            got = []
            for at in range(0, len(pdf), batch):
                got += model(list(pdf["content"].iloc[at : at + batch]))
            yield pd.DataFrame({"listing_id": pdf["listing_id"], "photo_id": pdf["photo_id"], "category": [g[0] for g in got], "attributes": [g[1] for g in got], "is_indoor": [g[2] for g in got]})

    kind = "array<struct<prob: double, name: string>>"
    return images.select("listing_id", "photo_id", "content").mapInPandas(run, f"listing_id long, photo_id long, category {kind}, attributes {kind}, is_indoor struct<mean: double, flag: boolean>")
