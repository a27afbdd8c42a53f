"""Operators on caption tables: blanking repeats, conditions on listings, key joins and row splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionflow.functions import text as T
from captionflow.session import written


def blank_repeats(captions: DataFrame, order: str, listing: str = "listing_id", caption: str = "caption") -> DataFrame:
    """The second and later use of a caption within a listing becomes the empty text; no row is removed.

    Equality is of the raw text. ``order`` says which use is first; rows that share the
    first place all keep their caption. Empty captions and null stay as they are. First
    uses are pre-aggregated and joined back, so a caption that fills a hot listing is in
    no single task.
    """
    filled = captions.where(~T.is_empty(F.col(caption)))
    first = filled.groupBy(F.col(listing).alias("_l"), F.col(caption).alias("_c")).agg(F.min(order).alias("_first"))
    joined = captions.join(first, F.col(listing).eqNullSafe(F.col("_l")) & (F.col(caption) == F.col("_c")), "left")
    return joined.withColumn(caption, F.when(F.col("_first") < F.col(order), F.lit("")).otherwise(F.col(caption))).drop("_l", "_c", "_first")


def fit_listings(captions: DataFrame, min_captions: int = 2, min_length: int = 4, captionless: bool = True, listing: str = "listing_id", caption: str = "caption") -> DataFrame:
    """Rows of listings with at least ``min_length`` photos and ``min_captions`` captioned ones.

    Without ``captionless`` the captionless rows are dropped first. The counts are
    pre-aggregated and joined back, so no listing is gathered in one task.
    """
    rows = captions if captionless else captions.where(~T.is_captionless(F.col(caption)))
    fit = rows.groupBy(listing).agg(F.count("*").alias("_n"), F.count_if(~T.is_captionless(F.col(caption))).alias("_c")).where((F.col("_n") >= min_length) & (F.col("_c") >= min_captions)).select(F.col(listing).alias("_l"))
    return rows.join(fit, F.col(listing).eqNullSafe(F.col("_l"))).drop("_l")


def listing_items(captions: DataFrame, order: str) -> DataFrame:
    """Dataset items (listing_id, photo_id, instructions) with one instruction each, null ids as they are."""
    return captions.select("listing_id", "photo_id", T.caption_items(F.col("caption")).alias("instructions"), order)


def listing_counts(captions: DataFrame) -> DataFrame:
    """(listing_id, n_photos, n_captioned) of each listing."""
    return captions.groupBy("listing_id").agg(F.count("*").alias("n_photos"), F.count_if(~T.is_captionless(F.col("caption"))).alias("n_captioned"))


def value_lists(rows: DataFrame, key: str, value: str, span: int = 100_000) -> DataFrame:
    """(key, part, values): the sorted values of each key, cut into parts by ranges of ``span`` of an integer value, so no list grows with the data."""
    return rows.groupBy(key, F.floor(F.col(value) / span).alias("part")).agg(F.sort_array(F.collect_set(value)).alias("values"))


def totals(captions: DataFrame) -> DataFrame:
    """One row: rows, listings, photos, captioned and captionless rows."""
    empty = T.is_captionless(F.col("caption"))
    return captions.agg(F.count("*").alias("n_rows"), F.count_distinct("listing_id").alias("n_listings"), F.count_distinct("photo_id").alias("n_photos"), F.count_if(~empty).alias("n_captioned"), F.count_if(empty).alias("n_captionless"))


def first_match(rows: DataFrame, keys: DataFrame, on: str, order: str, then: Column | None = None) -> DataFrame:
    """Left-semi join in which each key is used up by the first row that has it.

    ``then`` is a condition tested after the key is used up, so a first row that fails it
    still hides the later ones. Null keys match nothing.
    """
    first = Window.partitionBy(on).orderBy(order)
    kept = rows.join(keys.select(on).distinct(), on, "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return kept if then is None else kept.where(then)


def strict_lookup(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Inner join that fails, when run, on the first row without a partner."""
    joined = rows.join(table.withColumn("_hit", F.lit(True)), on, "left")
    return joined.where(F.when(F.col("_hit"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"no {on} "), F.coalesce(F.col(on).cast("string"), F.lit("null")))).cast("boolean"))).drop("_hit")


def last_value(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value) of the last row of each key."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias(value))


def with_merging(items: DataFrame, merged: DataFrame) -> DataFrame:
    """Left join of merged photo groups, with the photo alone, weight 1 and an unknown room where there is none."""
    m = merged.select(F.col("photo_id").alias("_p"), "merging", "weights", "room")
    return items.join(m, F.col("photo_id") == F.col("_p"), "left").drop("_p").withColumns({"merging": F.coalesce("merging", F.array("photo_id")), "weights": F.coalesce("weights", F.array(F.lit(1.0))), "room": F.coalesce("room", F.lit("unknown"))})


def row_numbers(df: DataFrame, order: str) -> DataFrame:
    """Adds ``row_no`` from 0 in the order of a unique column, whatever its values.

    The rows are range-partitioned by a sample of the order and sorted inside; the count of each
    partition, one row for each, gives its offset. Sparse ids and hashes are cut as evenly as dense ones.
    """
    ranged_rows = written(df.repartitionByRange(order).withColumn("_b", F.spark_partition_id()), "ranged")
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged_rows.groupBy("_b").count()
    offsets = counts.select(F.col("_b").alias("_k"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_b").orderBy(order)
    numbered = ranged_rows.withColumn("_n", F.row_number().over(inside) - 1)
    joined = numbered.join(offsets, F.col("_b") == F.col("_k"))
    return joined.withColumn("row_no", F.col("_n") + F.col("_off")).drop("_b", "_k", "_n", "_off")


def _counted(numbered: DataFrame) -> DataFrame:
    """Adds ``_rows``, the number of rows, as a scalar subquery."""
    return numbered.withColumn("_rows", numbered.agg(F.count("*")).scalar())


def strided(numbered: DataFrame, n: int) -> DataFrame:
    """Adds ``stride``, the worker of ``n`` that takes the row."""
    return numbered.withColumn("stride", F.col("row_no") % n)


def ranged(numbered: DataFrame, n: int, start: int = 0) -> DataFrame:
    """Adds ``part``: contiguous parts of ceil(rows / n) rows from row ``start`` on; rows before it are left out."""
    per = F.greatest(F.lit(1), F.ceil((F.col("_rows") - start) / n))
    after = _counted(numbered).where(F.col("row_no") >= start)
    return after.withColumn("part", F.floor((F.col("row_no") - start) / per)).drop("_rows")


def tail_split(numbered: DataFrame, share: float = 0.05) -> DataFrame:
    """Adds ``split``: the last rows, rounded half to even, are the test set and the others the training set."""
    test = F.col("row_no") >= F.col("_rows") - F.bround(F.col("_rows") * share, 0)
    return _counted(numbered).withColumn("split", F.when(test, "test").otherwise("train")).drop("_rows")


def caption_keys(*tables: DataFrame) -> DataFrame:
    """All ``listing-photo`` keys of several tables, repeats kept."""
    out = None
    for t in tables:
        keys = t.select(T.photo_key(F.col("listing_id"), F.col("photo_id")).alias("key"))
        out = keys if out is None else out.unionByName(keys)
    return out


def missing(rows: DataFrame, done: DataFrame, on: str) -> DataFrame:
    """Rows whose key isn't there yet: what a resumed run still has to do."""
    return rows.join(done.select(on), on, "left_anti")


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, first): the distinct keys with the place of their first row, which orders them as they were seen."""
    return rows.groupBy(*keys).agg(F.min(order).alias("first"))


def restricted(rows: DataFrame, dataset: DataFrame, on: str = "photo_id") -> DataFrame:
    """Rows whose key is in the dataset, repeats and order kept; null keys are in none."""
    return rows.join(dataset.select(on).distinct(), on, "left_semi")


def nested_map(rows: DataFrame, outer: str, inner: str, values: list[str], order: str) -> DataFrame:
    """(outer, inner, values) of the last row of each pair: a map of maps in which the last write wins."""
    last = rows.groupBy(outer, inner).agg(F.max_by(F.struct(*values), order).alias("_v"))
    return last.select(outer, inner, *[F.col("_v")[v].alias(v) for v in values])


def running_mean(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds ``mean`` of the values of the key up to each row. A key is one worker's timings, which one task holds."""
    line = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("mean", F.avg(value).over(line))


def worker_parts(numbered: DataFrame, n: int, name: str, width: int = 0) -> DataFrame:
    """Adds ``worker`` of ``n``, by stride, ``place``, the row's number at that worker, and ``part``, its output name."""
    worker = F.col("row_no") % n
    part = F.concat(F.lit(name + "."), F.lpad(worker.cast("string"), max(width, len(str(n - 1))), "0"))
    return numbered.withColumns({"worker": worker, "place": F.floor(F.col("row_no") / n), "part": part})


def reassembled(parts: list[DataFrame], n: int) -> DataFrame:
    """Strides 0..n-1, each with its ``row_no``, put together; a row that is in the wrong stride fails the run."""
    out = None
    for i, part in enumerate(parts):
        wrong = F.raise_error(F.concat(F.lit(f"row not of stride {i}: "), F.col("row_no").cast("string")))
        checked = part.where(F.when(F.col("row_no") % n == i, F.lit(True)).otherwise(wrong.cast("boolean")))
        out = checked if out is None else out.unionByName(checked)
    return out


def next_of(values: Column) -> Column:
    """The value after each one of an array; the last stands for its own next."""
    return F.concat(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, F.greatest(F.size(values), F.lit(1)), F.lit(1)))
