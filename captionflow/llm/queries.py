"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionflow.llm import language, markup, mixing, overlap, packing, pii, spans, splits, tokens
from captionflow.session import written
from captionflow.tables import table

SPLIT_SHARES = {"train": 0.8, "valid": 0.1, "test": 0.1}


LISTING_TEXTS = ("description", "neighborhood", "getting_around")


def p1_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return markup.cleaned(table(spark, d, "listings"), "listing_id", LISTING_TEXTS).withColumnRenamed("id", "listing_id").distinct()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = markup.marked(table(spark, d, "listings").where("listing_id is not null"), "listing_id", LISTING_TEXTS)
    return found.select(F.col("id").alias("listing_id"), "field").distinct()


def _review_languages(spark: SparkSession, d: str) -> DataFrame:
    reviews = table(spark, d, "reviews")
    return language.detect(reviews, "review_id", "comment", "language", language.train(reviews, "review_id", "comment", "language"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return language.mislabelled(_review_languages(spark, d)).select(F.col("id").alias("review_id"), "lang")


def p2_languages(spark: SparkSession, d: str) -> DataFrame:
    return language.assigned(_review_languages(spark, d)).withColumnRenamed("id", "review_id").distinct()


def p2_stretches(spark: SparkSession, d: str) -> DataFrame:
    return language.stretches(_review_languages(spark, d)).withColumnRenamed("id", "review_id").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.linked_groups(table(spark, d, "images"), "listing_id", "photo_id")


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "images")
    return splits.split_rows(images, "listing_id", "photo_id", SPLIT_SHARES).select("listing_id", "photo_id", "caption", "split")


def p4_units(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_units(table(spark, d, "images"), "listing_id", "photo_id", SPLIT_SHARES)


def _caption_pairs(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_pairs(table(spark, d, "captions"), "item_id", "caption", "split", "photo_id")


def private_texts(spark: SparkSession, d: str) -> DataFrame:
    reviews = table(spark, d, "reviews").select(F.lit("comment").alias("field"), F.col("review_id").alias("id"), F.col("comment").alias("text"))
    return reviews.unionByName(table(spark, d, "listings").select(F.lit("description").alias("field"), F.col("listing_id").alias("id"), F.col("description").alias("text")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(private_texts(spark, d)).select("field", F.col("id").alias("record_id"), "kind")


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(private_texts(spark, d)).withColumnRenamed("id", "record_id").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _caption_pairs(spark, d).select("item_a", "item_b")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "captions"), "item_id", "split", "source", _caption_pairs(spark, d))


def p6_links(spark: SparkSession, d: str) -> DataFrame:
    return overlap.item_links(table(spark, d, "captions"), "item_id", "caption", "split", "photo_id")


def document_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_counts(table(spark, d, "documents"), "doc_id", "text", ("source",))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    # one row more than packing allows is read, and then packing refuses
    capacities = {r["pack_id"]: r["capacity_tokens"] for r in table(spark, d, "pack_sizes").take(packing.MOST_PACKS + 1)}
    return packing.packed(document_tokens(spark, d), capacities)


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(p8_packed(spark, d))


def p9_mixed(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(document_tokens(spark, d), table(spark, d, "mix_targets"))


def p9_filled(spark: SparkSession, d: str) -> DataFrame:
    """Mixes of a set size, all tokens of the mix's sources: capped sources fall short and the others fill."""
    docs, targets = written(document_tokens(spark, d), "tokens"), table(spark, d, "mix_targets")
    sizes = docs.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("t"))
    named = targets.where("target_share > 0").select("mix_name", "source").distinct()
    budget = {r["mix_name"]: r["t"] for r in named.join(sizes, "source").groupBy("mix_name").agg(F.sum("t").alias("t")).collect()}
    return mixing.mix_report(mixing.mixed(docs, targets, budget), targets)


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(p9_mixed(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.sharing_pairs(spans.occurrences(table(spark, d, "documents"), "doc_id", "text"))


def p10_passages(spark: SparkSession, d: str) -> DataFrame:
    return spans.passages(table(spark, d, "documents"), "doc_id", "text")


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_parts(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {
    "p1_found": p1_found,
    "p1_cleaned": p1_cleaned,
    "p2_found": p2_found,
    "p2_languages": p2_languages,
    "p2_stretches": p2_stretches,
    "p4_found": p4_found,
    "p4_splits": p4_splits,
    "p4_units": p4_units,
    "p5_found": p5_found,
    "p5_redacted": p5_redacted,
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p6_links": p6_links,
    "p8_packed": p8_packed,
    "p8_report": p8_report,
    "p9_mixed": p9_mixed,
    "p9_report": p9_report,
    "p9_filled": p9_filled,
    "p10_found": p10_found,
    "p10_passages": p10_passages,
    "p10_shared": p10_shared,
}
