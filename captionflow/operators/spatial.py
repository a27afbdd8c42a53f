"""Points near points and points in regions, by range joins on space-filling-curve codes.

A cell of the Z-order curve is a range of codes with a common prefix, so joining a
point's code with the ranges that cover a disc or a region is a join on prefixes: both
sides are hashed and sorted on the cell code, adaptive execution splits hot cells, and
the exact test follows on the candidates only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionflow.functions import geo

#: Bits for each axis of the cells that cover regions; a region uses cells of several of these sizes.
LEVELS = (2, 4, 6, 8, 10, 12, 14, 16)


def located(df: DataFrame, id_col: str, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Distinct (id, lat, lng) of the rows with a usable location; null ids are left out."""
    return df.where(F.col(id_col).isNotNull() & geo.has_location(F.col(lat), F.col(lng))).select(F.col(id_col).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lng).cast("double").alias("lng")).distinct()


def _check_radius(radius_m: float) -> None:
    cell = math.pi * geo.EARTH_RADIUS_M / (1 << geo.AXIS_BITS)
    if not 0 < radius_m <= 50 * cell:
        raise ValueError(f"the radius must lie in (0, {50 * cell:.0f}] m")


def near_pairs(points: DataFrame, radius_m: float) -> DataFrame:
    """(id_a, id_b, metres) with id_a < id_b for points at most ``radius_m`` apart.

    ``points`` has id, lat, lng, one row for each place of an id (see ``located``); an id
    with several places counts with its nearest. Every point lies in one cell; its disc
    is covered by the cells of the rows it touches, whose width is kept above half the
    cell height towards the poles, so the cover stays small at any latitude, wraps at
    the antimeridian and holds for discs around a pole. An empty table gives no pairs.
    """
    _check_radius(radius_m)
    reach = math.degrees(radius_m * (1 + 1e-9) / geo.EARTH_RADIUS_M) + 1e-9
    row = geo.row_of(F.col("lat"))
    home = points.withColumn("_row", row).select(F.col("id").alias("id_b"), F.col("lat").alias("lat_b"), F.col("lng").alias("lng_b"), geo.zorder(geo.drop_bits(geo.col_of(F.col("lng")), geo.thinning(F.col("_row"))), F.col("_row")).alias("cell"))
    low, high = geo.row_of(F.greatest(F.col("lat") - reach, F.lit(-90.0))), geo.row_of(F.least(F.col("lat") + reach, F.lit(90.0)))
    rows = points.withColumn("_row", F.explode(F.sequence(low, high))).withColumn("_thin", geo.thinning(F.col("_row")))
    # the widest longitude the disc reaches; the whole circle when it holds a pole
    ratio = math.sin(math.radians(reach)) / F.cos(F.radians("lat"))
    width = F.when((F.abs("lat") + reach >= 90) | (ratio >= 1), F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) + 1e-9)
    full = 1 << geo.AXIS_BITS
    first = F.floor((F.col("lng") - width + 180) / 360 * full).cast("long")
    last = F.floor((F.col("lng") + width + 180) / 360 * full).cast("long")
    step = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_thin"))
    begin = geo.drop_bits(first, F.col("_thin"))
    spans = rows.withColumn("_step", step).withColumn("_begin", begin).withColumn("_last", F.least(last, F.col("_begin") + full - F.col("_step")))
    covers = spans.withColumn("_col", F.explode(F.sequence(F.col("_begin"), F.greatest(F.col("_last"), F.col("_begin")), F.col("_step"))))
    covers = covers.select(F.col("id").alias("id_a"), F.col("lat").alias("lat_a"), F.col("lng").alias("lng_a"), geo.zorder(F.col("_col").bitwiseAND(F.lit(full - 1)), F.col("_row")).alias("cell"))
    metres = geo.distance_m(F.col("lat_a"), F.col("lng_a"), F.col("lat_b"), F.col("lng_b"))
    close = F.abs(F.col("lat_a") - F.col("lat_b")) <= reach
    pairs = covers.join(home, "cell").where((F.col("id_a") < F.col("id_b")) & close).withColumn("metres", metres).where(F.col("metres") <= radius_m)
    pairs = pairs.select("id_a", "id_b", "metres")
    # a point has one home cell and a cover has each cell once, so only ids with several places repeat a pair
    if points.groupBy("id").count().where("count > 1").isEmpty():
        return pairs
    return pairs.groupBy("id_a", "id_b").agg(F.min("metres").alias("metres"))


def _ring(points: list | None) -> np.ndarray | None:
    """Closed ring of (lng, lat), moved to one side of the antimeridian where it crosses it; None if it has no area."""
    if points is None:
        return None
    xy = np.array([(p["lng"], p["lat"]) for p in points if p is not None and p["lng"] is not None and p["lat"] is not None], dtype=float)
    if len(xy) < 3:
        return None
    if not (xy[0] == xy[-1]).all():
        xy = np.vstack([xy, xy[:1]])
    if (np.abs(np.diff(xy[:, 0])) > 180).any():
        xy[xy[:, 0] < 0, 0] += 360
    return xy


def _holds(xy: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Even-odd test of many points against one closed ring."""
    x1, y1, x2, y2 = xy[:-1, 0], xy[:-1, 1], xy[1:, 0], xy[1:, 1]
    crosses = (y1 > y[:, None]) != (y2 > y[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (x2 - x1) * (y[:, None] - y1) / (y2 - y1) + x1
    return (crosses & (x[:, None] < at)).sum(1) % 2 == 1


def _touches(xy: np.ndarray, x0: np.ndarray, y0: np.ndarray, w: float, h: float) -> np.ndarray:
    """Which boxes an edge of the ring may touch: edge and box are clipped against each other."""
    ax, ay = xy[:-1, 0], xy[:-1, 1]
    dx, dy = np.diff(xy[:, 0]), np.diff(xy[:, 1])
    enter = np.zeros((len(x0), len(ax)))
    leave = np.ones_like(enter)
    slack = 1e-12
    for a, d, lo, size in ((ax, dx, x0, w), (ay, dy, y0, h)):
        lo = lo[:, None] - slack
        hi = lo + size + 2 * slack
        with np.errstate(divide="ignore", invalid="ignore"):
            t0, t1 = (lo - a) / d, (hi - a) / d
        flat = d == 0
        out = flat & ((a < lo) | (a > hi))
        enter = np.maximum(enter, np.where(flat, np.where(out, 2.0, 0.0), np.minimum(t0, t1)))
        leave = np.minimum(leave, np.where(flat, 1.0, np.maximum(t0, t1)))
    return (enter <= leave).any(1)


def cover(ring: list | None, hole: list | None, fine: int = 160) -> list[tuple[int, int, int, bool]]:
    """(bits, column, row, whole) of the cells that cover a region; ``whole`` cells need no further test.

    Cells are cut until there are about ``fine`` of them or the smallest size is reached.
    """
    outer, inner = _ring(ring), _ring(hole)
    if outer is None:
        return []
    if inner is not None and outer[:, 0].max() > 180 and inner[:, 0].max() <= 180:
        inner[inner[:, 0] < 0, 0] += 360
    bits = LEVELS[0]
    w, h = 360 / (1 << bits), 180 / (1 << bits)
    lo, hi = outer.min(0), outer.max(0)
    cols = np.arange(math.floor((lo[0] + 180) / w), math.floor((hi[0] + 180) / w) + 1)
    rows = np.arange(math.floor((lo[1] + 90) / h), min(math.floor((hi[1] + 90) / h), (1 << bits) - 1) + 1)
    c, r = (a.ravel() for a in np.meshgrid(cols, rows))
    done: list[tuple[int, int, int, bool]] = []
    for level, bits in enumerate(LEVELS):
        w, h = 360 / (1 << bits), 180 / (1 << bits)
        x0, y0 = c * w - 180, r * h - 90
        edge = _touches(outer, x0, y0, w, h)
        within = _holds(outer, x0 + w / 2, y0 + h / 2)
        if inner is not None:
            edge_in = _touches(inner, x0, y0, w, h)
            within &= edge_in | ~_holds(inner, x0 + w / 2, y0 + h / 2)
            edge |= edge_in & within
        done += [(bits, int(a) % (1 << bits), int(b), True) for a, b in zip(c[within & ~edge], r[within & ~edge])]
        c, r = c[edge], r[edge]
        if not len(c):
            return done
        if level + 1 == len(LEVELS) or len(done) + 4 * len(c) > fine and len(c) > 2:
            return done + [(bits, int(a) % (1 << bits), int(b), False) for a, b in zip(c, r)]
        k = 1 << (LEVELS[level + 1] - bits)
        grid_c, grid_r = (a.ravel() for a in np.meshgrid(np.arange(k), np.arange(k)))
        c, r = (c[:, None] * k + grid_c).ravel(), (r[:, None] * k + grid_r).ravel()
    return done


def region_cells(regions: DataFrame) -> DataFrame:
    """(region, bits, cell, whole) for regions with columns region, ring, hole."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(int(i), *cell) for i, ring, hole in zip(batch["region"], batch["ring"], batch["hole"]) for cell in cover(ring, hole)]
            yield pd.DataFrame(out, columns=["region", "bits", "col", "row", "whole"]).astype({"region": "int64", "bits": "int32", "col": "int64", "row": "int64", "whole": "bool"})

    made = regions.select("region", "ring", "hole").mapInPandas(cells, "region long, bits int, col long, row long, whole boolean")
    return made.select("region", "bits", geo.zorder(F.col("col"), F.col("row")).alias("cell"), "whole")


def in_ring(ring: Column, lat: Column, lng: Column) -> Column:
    """Even-odd test of a point against a ring column (array of lat, lng), edges straight in lat and lng.

    A ring with neighbouring points more than 180 degrees of longitude apart crosses the
    antimeridian and is tested with negative longitudes moved by 360.
    """
    closed = F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    legs = F.arrays_zip(F.slice(closed, F.lit(1), F.size(closed) - 1).alias("p"), F.slice(closed, F.lit(2), F.size(closed) - 1).alias("q"))
    crossing = F.exists(legs, lambda e: F.abs(e["p"]["lng"] - e["q"]["lng"]) > 180)
    turn = lambda x: F.when(crossing & (x < 0), x + 360).otherwise(x)

    def hit(e: Column) -> Column:
        x1, y1, x2, y2 = turn(e["p"]["lng"]), e["p"]["lat"], turn(e["q"]["lng"]), e["q"]["lat"]
        return ((y1 > lat) != (y2 > lat)) & (turn(lng) < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)

    return F.size(F.filter(legs, hit)) % 2 == 1


def in_regions(points: DataFrame, regions: DataFrame) -> DataFrame:
    """Distinct (id, region) for points (id, lat, lng) inside regions (region, ring, hole).

    Regions may overlap, wind either way, repeat the first point, cross the antimeridian
    and have a hole. A null or two-point ring holds nothing. Cells wholly inside need no
    test; on the others the ring itself decides.
    """
    cells = region_cells(regions)
    coded = points.withColumn("_row", geo.row_of(F.col("lat"), LEVELS[-1])).withColumn("_col", geo.col_of(F.col("lng"), LEVELS[-1]))
    ladder = F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), geo.zorder(F.shiftright("_col", LEVELS[-1] - b), F.shiftright("_row", LEVELS[-1] - b)).alias("cell")) for b in LEVELS]))
    met = coded.select("id", "lat", "lng", ladder.alias("at")).select("id", "lat", "lng", "at.bits", "at.cell").join(cells, ["bits", "cell"])
    # cells wholly inside take no part in the join with the rings
    shapes = regions.select(F.col("region").alias("_region"), "ring", "hole")
    tested = met.join(shapes, (F.col("region") == F.col("_region")) & ~F.col("whole"), "left")
    hole = F.coalesce(in_ring(F.col("hole"), F.col("lat"), F.col("lng")), F.lit(False))
    inside = F.col("whole") | (in_ring(F.col("ring"), F.col("lat"), F.col("lng")) & ~hole)
    return tested.where(inside).select("id", "region").distinct()
