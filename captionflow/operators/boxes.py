"""Detection boxes: selection by confidence, non-maximum suppression and redundancy filter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def class_maximum(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, confidence) the greatest score over the classes of each box, background (class 0) left out."""
    return scores.where("class > 0").groupBy(*keys).agg(F.max("score").alias("confidence"))


def select_boxes(boxes: DataFrame, image: str, confidence: str, threshold: float, least: int = 5, most: int = 20, tie: str = "box") -> DataFrame:
    """Boxes at or above the threshold; fewer than ``least`` are filled up to it, more than ``most`` cut to it."""
    every = Window.partitionBy(image)
    rank = F.row_number().over(every.orderBy(F.col(confidence).desc(), tie))
    good = F.count_if(F.col(confidence) >= threshold).over(every)
    ranked = boxes.withColumns({"_r": rank, "_g": good})
    return ranked.where(F.col("_r") <= F.least(F.greatest(F.col("_g"), F.lit(least)), F.lit(most))).drop("_r", "_g")


def top_boxes(boxes: DataFrame, image: str, confidence: str, k: int = 100, tie: str = "box") -> DataFrame:
    """The k most confident boxes of each image and ``num_boxes``, how many of them have any confidence."""
    rank = F.row_number().over(Window.partitionBy(image).orderBy(F.col(confidence).desc(), tie))
    kept = boxes.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")
    return kept.withColumn("num_boxes", F.count_if(F.col(confidence) != 0).over(Window.partitionBy(image)))


def suppress(xyxy: np.ndarray, scores: np.ndarray, threshold: float) -> list[int]:
    """Places of the boxes that greedy non-maximum suppression keeps, best first; boxes include both border pixels."""
    area = (xyxy[:, 2] - xyxy[:, 0] + 1) * (xyxy[:, 3] - xyxy[:, 1] + 1)
    left, kept = np.argsort(-scores, kind="stable"), []
    while len(left):
        best, rest = left[0], left[1:]
        kept.append(int(best))
        low = np.maximum(xyxy[rest, :2], xyxy[best, :2])
        high = np.minimum(xyxy[rest, 2:], xyxy[best, 2:])
        both = np.clip(high - low + 1, 0, None).prod(1)
        left = rest[both / (area[rest] + area[best] - both) <= threshold]
    return kept


def by_groups(df: DataFrame, keys: list[str], order: str, columns: list[str], keep: Callable[..., list[int]]) -> DataFrame:
    """Rows that ``keep`` names within each group, in the given order; it gets the group's part of each of the columns.

    Rows are hashed and sorted by group once and cut into groups as the batches pass, so
    many small groups cost no call each and a group may span batches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def finished(rows: pd.DataFrame, last: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
            ids = rows[keys].apply(lambda c: c.ne(c.shift()) & ~(c.isna() & c.shift().isna())).any(axis=1).to_numpy()
            starts = np.flatnonzero(ids)
            ends = np.append(starts[1:], len(rows))
            if not last:
                starts, ends, rest = starts[:-1], ends[:-1], rows.iloc[starts[-1] :]
            else:
                rest = rows.iloc[:0]
            cells = [rows[c].to_numpy() for c in columns]
            places = [a + i for a, b in zip(starts, ends) for i in (keep(*[x[a:b] for x in cells]) if b - a > 1 else [0])]
            return rows.iloc[places], rest

        for batch in batches:
            if len(batch):
                rows = pd.concat([*held, batch], ignore_index=True) if held else batch
                done, rest = finished(rows, False)
                held = [rest]
                yield done
        if held and len(held[0]):
            yield finished(held[0].reset_index(drop=True), True)[0]

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, df.schema)


def non_maximum(boxes: DataFrame, threshold: float, classes: str | None = None) -> DataFrame:
    """Rows that survive suppression within their image and, if given, class. Columns: image, box, confidence, x1, y1, x2, y2.

    Grouped by image and class: a group is the detections of one view, which the detector
    bounds (300 proposals), so it fits a task at any corpus size.
    """
    keys = ["image", *([classes] if classes else [])]

    def keep(confidence: np.ndarray, *corners: np.ndarray) -> list[int]:
        return suppress(np.stack(corners, 1).astype(float), confidence.astype(float), threshold)

    return by_groups(boxes, keys, "box", ["confidence", "x1", "y1", "x2", "y2"], keep)


def thin_out(features: np.ndarray, headings: np.ndarray, elevations: np.ndarray, best: np.ndarray, most: int) -> list[int]:
    """Places kept when, closest pair first, the less confident box of two surviving ones goes until ``most`` are left."""
    n = len(features)
    alive = np.ones(n, dtype=bool)
    left = n
    if n > most:
        unit = features / np.maximum(np.linalg.norm(features, axis=1, keepdims=True), 1e-12)
        turn = np.abs(headings[:, None] - headings[None, :])
        distance = 1 - unit @ unit.T + np.minimum(turn, 2 * np.pi - turn) + np.abs(elevations[:, None] - elevations[None, :])
        i, j = np.tril_indices(n, -1)
        for at in np.argsort(distance[i, j], kind="stable"):
            if left <= most:
                break
            a, b = i[at], j[at]
            if alive[a] and alive[b]:
                alive[b if best[a] > best[b] else a] = False
                left -= 1
    return np.flatnonzero(alive).tolist()


def without_redundant(boxes: DataFrame, most: int = 100) -> DataFrame:
    """Rows kept by ``thin_out`` within each image. Columns: image, box, feature, heading, elevation, best. A group is one panorama's boxes."""

    def keep(feature: np.ndarray, heading: np.ndarray, elevation: np.ndarray, best: np.ndarray) -> list[int]:
        return thin_out(np.array(feature.tolist(), dtype=float), heading.astype(float), elevation.astype(float), best.astype(float), most)

    return by_groups(boxes, ["image"], "box", ["feature", "heading", "elevation", "best"], keep)


def extract(images: DataFrame, detector, schema: str) -> DataFrame:
    """Box rows of any detector: ``detector(listing_id, photo_id, bytes) -> list of rows``; images without boxes give none."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [row for r in pdf.itertuples() for row in detector(r.listing_id, r.photo_id, r.content)]
            yield pd.DataFrame(rows, columns=names)

    return images.select("listing_id", "photo_id", "content").mapInPandas(run, schema)
