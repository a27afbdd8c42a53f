"""Vector and matrix expressions over arrays of doubles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(values: Column) -> Column:
    shifted = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(shifted, lambda x: x / total(shifted))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def matvec(matrix: Column, vector: Column) -> Column:
    return F.transform(matrix, lambda row: dot(row, vector))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for a null or zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, 1 - dot(a, b) / norm)


def unit(values: Column) -> Column:
    """The vector over its length; null for a zero vector."""
    norm = F.sqrt(dot(values, values))
    return F.when(norm > 0, F.transform(values, lambda x: x.cast("double") / norm))


def argmax(values: Column) -> Column:
    """Place from 0 of the first greatest value."""
    return F.array_position(values, F.array_max(values)) - 1


def best_class(probabilities: Column) -> Column:
    """Greatest probability without the background class at place 0."""
    return F.array_max(F.slice(probabilities, F.lit(2), F.greatest(F.size(probabilities) - 1, F.lit(0))))


def min_max_bytes(values: Column) -> Column:
    """Scaled to 0..255 by the least and greatest value; all zero where they are equal."""
    low, high = F.array_min(values), F.array_max(values)
    return F.transform(values, lambda x: F.when(high > low, F.floor((x - low) / (high - low) * 255)).otherwise(0).cast("int"))


def normalised_channels(values: Column, mean: list[float], std: list[float]) -> Column:
    """Values of interleaved channels in 0..255 scaled to 0..1, less the channel mean, over the channel deviation."""
    n = len(mean)
    pick = lambda table, i: F.element_at(F.array(*[F.lit(float(x)) for x in table]), (i % n + 1).cast("int"))
    return F.transform(values, lambda x, i: (x / 255.0 - pick(mean, i)) / pick(std, i))


def restored_channels(values: Column, mean: list[float], std: list[float]) -> Column:
    """The inverse of ``normalised_channels``."""
    n = len(mean)
    pick = lambda table, i: F.element_at(F.array(*[F.lit(float(x)) for x in table]), (i % n + 1).cast("int"))
    return F.transform(values, lambda x, i: (x * pick(std, i) + pick(mean, i)) * 255.0)


def channel_means_removed(values: Column, means: list[float]) -> Column:
    pick = lambda i: F.element_at(F.array(*[F.lit(float(x)) for x in means]), (i % len(means) + 1).cast("int"))
    return F.transform(values, lambda x, i: x - pick(i))


def take_rows(matrix: Column, keep: Column) -> Column:
    """Rows of a matrix at the places (from 0) in ``keep``."""
    return F.transform(keep, lambda i: F.get(matrix, i))


def padded(matrix: Column, rows: int, width: int) -> Column:
    """(values, mask): cut or filled with zero rows to ``rows`` rows of ``width``; the mask is 1 for given rows."""
    zero = F.array_repeat(F.lit(0.0), width)
    given = F.least(F.size(matrix), F.lit(rows))
    filled = F.slice(F.concat(F.slice(matrix, 1, rows), F.array_repeat(zero, rows)), 1, rows)
    mask = F.slice(F.concat(F.array_repeat(F.lit(1), given), F.array_repeat(F.lit(0), rows)), 1, rows)
    return F.struct(filled.alias("rows"), mask.alias("mask"))


def stacked(first: Column, second: Column) -> Column:
    """Rows of two matrices one after the other; a null matrix has no rows."""
    none = F.array().cast("array<array<double>>")
    return F.concat(F.coalesce(first, none), F.coalesce(second, none))


def _decoded(text: pd.Series, width: pd.Series, kind: pd.Series) -> pd.Series:
    import base64
    import binascii

    out = []
    for t, w, k in zip(text, width, kind):
        try:
            flat = None if t is None else np.frombuffer(base64.b64decode(t, validate=True), dtype=k)
            out.append(None if flat is None or w <= 0 or len(flat) % w else flat.reshape(-1, w).astype(float).tolist())
        except (ValueError, binascii.Error):
            out.append(None)
    return pd.Series(out, dtype=object)


def decode_matrix(text: Column, width: Column, kind: str = "float64") -> Column:
    """Rows of ``width`` numbers from base64 of raw bytes of a numpy type; no rows for an empty text, null for null or bad text."""
    return F.pandas_udf(_decoded, "array<array<double>>")(text, width, F.lit(kind))


def _encoded(matrix: pd.Series, kind: pd.Series) -> pd.Series:
    import base64

    return pd.Series([None if m is None else base64.b64encode(np.array([list(r) for r in m], dtype=k).tobytes()).decode() for m, k in zip(matrix, kind)], dtype=object)


def encode_matrix(matrix: Column, kind: str = "float64") -> Column:
    """Base64 of the raw bytes of a matrix in a numpy type."""
    return F.pandas_udf(_encoded, "string")(matrix, F.lit(kind))


def combinations(values: list, k: int) -> Iterator[tuple]:
    import itertools

    return itertools.combinations(values, k)


def pairs_of(values: Column) -> Column:
    """All (first, second) with the place of first before that of second."""
    n = F.size(values)
    every = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.transform(F.filter(F.sequence(F.lit(0), n), lambda j: (j > i) & (j < n)), lambda j: F.struct(F.get(values, i).alias("first"), F.get(values, j).alias("second")))))
    return F.when(n > 1, every).otherwise(F.slice(every, 1, 0))


def index_difference(every: Column, rejected: Column) -> Column:
    """The distinct values of one array that another lacks, ascending."""
    return F.array_sort(F.array_except(every, rejected))


def resized(values: Column, width: int, height: int, to_width: int, to_height: int, channels: int = 3) -> Column:
    """Nearest-neighbour resize of interleaved pixels, row by row."""
    places = F.sequence(F.lit(0), F.lit(to_width * to_height * channels - 1))
    row = lambda i: F.floor(F.floor(i / (to_width * channels)) * height / to_height)
    column = lambda i: F.floor(F.floor(i % (to_width * channels) / channels) * width / to_width)
    return F.transform(places, lambda i: F.get(values, ((row(i) * width + column(i)) * channels + i % channels).cast("int")))
