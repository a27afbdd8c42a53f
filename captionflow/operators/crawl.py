"""Work lists of a crawl: pages of a search, and locations found from locations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionflow.session import written


def page_offsets(totals: DataFrame, name: str, total: str, limit: int = 50) -> DataFrame:
    """(name, offset) of the pages after the first; none where the total is at most the limit, zero or null."""
    pages = F.when(F.col(total) > limit, F.sequence(F.lit(limit), F.col(total) - 1, F.lit(limit)))
    return totals.select(name, F.explode(pages).alias("offset"))


def closure(edges: DataFrame, start: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(node, depth) of all nodes reached from ``start`` (node) over ``edges`` (a, b), with the fewest steps.

    Each round expands only the frontier; nodes already seen are left out by an anti-join.
    """
    frontier = written(start.select("node").distinct().withColumn("depth", F.lit(0)), "frontier")
    seen = frontier
    for depth in range(1, most_rounds):
        step = frontier.join(edges, frontier["node"] == edges["a"]).select(F.col("b").alias("node")).distinct()
        frontier = written(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError("the closure did not settle")


def in_country(locations: DataFrame, column: str, country: str) -> DataFrame:
    return locations.where(F.contains(F.col(column), F.lit(country)))


def todo(found: DataFrame, done: DataFrame, failed: DataFrame, column: str) -> DataFrame:
    """Found values that are neither done nor failed."""
    return found.select(column).distinct().join(done.select(column).unionByName(failed.select(column)), column, "left_anti")
