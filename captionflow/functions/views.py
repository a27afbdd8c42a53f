"""Camera geometry of boxes in views: angles, reject rule, scaling."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def focal_length(height: float, vertical_degrees: float) -> float:
    return height / 2 / math.tan(math.radians(vertical_degrees) / 2)


def horizontal_degrees(width: float, height: float, vertical_degrees: float) -> float:
    return math.degrees(2 * math.atan(width / 2 / focal_length(height, vertical_degrees)))


def wrapped(angle: Column) -> Column:
    """The angle in (-pi, pi]."""
    turn = F.pmod(angle, F.lit(2 * math.pi))
    return F.when(turn > math.pi, turn - 2 * math.pi).otherwise(turn)


def circular_difference(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 2 * math.pi - d)


def box_heading(view_heading: Column, centre_x: Column, width: Column, focal: float) -> Column:
    return wrapped(view_heading + F.atan2(centre_x - width / 2, F.lit(focal)))


def box_elevation(view_elevation: Column, centre_y: Column, height: Column, focal: float) -> Column:
    return view_elevation + F.atan2(height / 2 - centre_y, F.lit(focal))


def off_centre(centre_x: Column, centre_y: Column, width: Column, height: Column, view: Column, focal: float, step_degrees: float = 30, margin_degrees: float = 5, per_sweep: int = 12, n_views: int = 36) -> Column:
    """True for a box better seen in another view: its centre lies past half a step plus the margin.

    The lowest sweep has no view below it and the highest none above.
    """
    reach = focal * math.tan(math.radians(step_degrees / 2 + margin_degrees))
    sideways = F.abs(centre_x - width / 2) > reach
    below = (view >= per_sweep) & (centre_y > height / 2 + reach)
    above = (view < n_views - per_sweep) & (centre_y < height / 2 - reach)
    return sideways | below | above


def scale_factor(width: Column, height: Column, shortest: int = 800, longest: int = 1333) -> Column:
    """Factor that brings the short side to ``shortest`` unless the long side would then pass ``longest``."""
    short, long = F.least(width, height), F.greatest(width, height)
    plain = F.lit(float(shortest)) / short
    return F.when(F.bround(plain * long) > longest, F.lit(float(longest)) / long).otherwise(plain)


def panorama_views(scan: Column, viewpoint: Column) -> Column:
    """36 views of a viewpoint: three elevations of -30, 0 and 30 degrees by twelve headings."""
    step = math.radians(30)
    return F.transform(F.sequence(F.lit(0), F.lit(35)), lambda i: F.struct(scan.alias("scan"), viewpoint.alias("viewpoint"), i.alias("view"), (F.floor(i / 12) * step - step).alias("elevation"), (i % 12 * step).alias("heading")))
