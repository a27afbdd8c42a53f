"""Sphere and space-filling-curve expressions over latitude and longitude columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8
#: Bits for each axis of a full-resolution code.
AXIS_BITS = 16


def has_location(lat: Column, lng: Column) -> Column:
    """False for null, NaN, infinite or out-of-range coordinates and for (0, 0)."""
    inside = lat.isNotNull() & lng.isNotNull() & ~F.isnan(lat) & ~F.isnan(lng) & lat.between(-90, 90) & lng.between(-180, 180)
    return F.coalesce(inside & ~((lat == 0) & (lng == 0)), F.lit(False))


def distance_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Haversine distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def row_of(lat: Column, bits: int = AXIS_BITS) -> Column:
    return F.least(F.floor((lat + 90) / 180 * (1 << bits)), F.lit((1 << bits) - 1)).cast("long")


def col_of(lng: Column, bits: int = AXIS_BITS) -> Column:
    return (F.floor((lng + 180) / 360 * (1 << bits)).cast("long")).bitwiseAND(F.lit((1 << bits) - 1))


def _spread(x: Column) -> Column:
    """Puts a zero bit before each of the low 16 bits."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def zorder(col: Column, row: Column) -> Column:
    """Z-order code of a cell: column bits at even, row bits at odd places."""
    return _spread(col).bitwiseOR(F.shiftleft(_spread(row), 1))


def thinning(row: Column, bits: int = AXIS_BITS) -> Column:
    """How many low column bits a row of cells drops so that its cells keep their width towards the poles."""
    south = row * (180.0 / (1 << bits)) - 90
    edge = F.greatest(F.abs(south), F.abs(south + 180.0 / (1 << bits)))
    cosine = F.greatest(F.cos(F.radians(edge)), F.lit(2.0**-bits))
    return F.least(F.floor(-F.log2(cosine)), F.lit(bits)).cast("int")


def drop_bits(x: Column, n: Column) -> Column:
    return F.call_function("shiftleft", F.call_function("shiftright", x, n), n)
