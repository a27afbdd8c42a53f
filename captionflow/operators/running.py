"""Running totals without a single-task window.

A plain window over one key puts a hot key into one task. Here the order is cut into slices of about
even size: a 63-bit hash by its leading bits, any other order by a slice column of the caller's. Slice
totals make a small table, its prefix sums are the offsets, and the window runs inside a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(*cols: Column | str, seed: int = 0) -> Column:
    """A non-negative 63-bit hash that fixes a reproducible shuffled order, equal in any engine with MD5.

    It is taken of the texts of the columns, nulls left out, with bars between them.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])
    return F.shiftleft(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), 3)


def hash_order_sql(*cols: str, seed: int = 0) -> str:
    """The same order in DuckDB SQL."""
    return f"CAST('0x' || md5(concat_ws('|', '{seed}', {', '.join(cols)}))[1:15] AS BIGINT) * 8"


def running_total(
    df: DataFrame,
    keys: list[str],
    order: str,
    tie: list[str],
    value: str,
    out: str,
    rows_hint: int,
    rows_per_slice: int = 20_000,
    slice_of: Column | None = None,
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the key up to this one, in (order, tie) order.

    ``order`` must be a ``hash_order`` column, or ``slice_of`` an int column that never falls along the
    order and cuts it into slices of about even size. ``rows_hint`` is the row count; it sets the
    number of slices of a hash, so a slice holds about ``rows_per_slice`` rows whatever the input.
    Rows equal in order and tie are ordered arbitrarily. Null values count as 0. An empty input gives
    an empty result.
    """
    bits = 0
    while bits < 20 and (rows_hint >> bits) > rows_per_slice:
        bits += 1
    cut = F.shiftright(F.col(order), 63 - bits).cast("int") if slice_of is None else slice_of
    sliced = df.withColumn("_slice", cut).withColumn("_v", F.coalesce(F.col(value), F.lit(0)))
    totals = sliced.groupBy(*keys, "_slice").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    names = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    offsets = totals.select(*names, F.col("_slice").alias("_s"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    match = F.col("_slice") == F.col("_s")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, 0)
    summed = sliced.withColumn(out, F.sum("_v").over(inside))
    joined = summed.join(offsets, match).withColumn(out, F.col(out) + F.col("_off"))
    return joined.drop("_slice", "_v", "_s", "_off", *[f"_k{i}" for i in range(len(keys))])
