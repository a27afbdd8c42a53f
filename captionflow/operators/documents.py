"""Photo, review, search and room documents flattened to tables. Bodies are JSON texts read as VARIANT; broken ones give nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def get(body: Column, path: str, kind: str) -> Column:
    """A value at a JSON path, null if it is missing or of another type."""
    return F.try_variant_get(body, path, kind)


def exploded(df: DataFrame, body: str, path: str, keep: list[str], outer: bool = False) -> DataFrame:
    """(keep, pos, item): the members of the array at a path; a missing or null array gives none."""
    arrays = df.select(*keep, get(F.col(body), path, "array<variant>").alias("_a"))
    made = F.posexplode_outer("_a") if outer else F.posexplode("_a")
    return arrays.select(*keep, made.alias("pos", "item"))


def photos(documents: DataFrame) -> DataFrame:
    """(listing_id, photo_id, url, caption, pos) of photo documents (listing_id, body); a null caption becomes empty."""
    items = exploded(documents.withColumn("v", F.try_parse_json("body")), "v", "$.data.merlin.pdpPhotoTour.images", ["listing_id"])
    item = F.col("item")
    return items.select("listing_id", get(item, "$.id", "long").alias("photo_id"), get(item, "$.baseUrl", "string").alias("url"), F.coalesce(get(item, "$.imageMetadata.caption", "string"), F.lit("")).alias("caption"), "pos")


def reviews(documents: DataFrame) -> DataFrame:
    """(listing_id, review_id, comment, created_at, language, is_superhost) of review documents."""
    items = exploded(documents.withColumn("v", F.try_parse_json("body")), "v", "$.data.merlin.pdpReviews.reviews", ["listing_id"])
    item = F.col("item")
    return items.select("listing_id", get(item, "$.id", "long").alias("review_id"), get(item, "$.comments", "string").alias("comment"), get(item, "$.createdAt", "string").alias("created_at"), get(item, "$.language", "string").alias("language"), get(item, "$.reviewee.isSuperhost", "boolean").alias("is_superhost"))


def search_results(pages: DataFrame, only_first: bool = False) -> DataFrame:
    """Distinct (name, listing_id) of search pages (name, body): items of the listing sections, or of the first one only."""
    sections = exploded(pages.withColumn("v", F.try_parse_json("body")), "v", "$.data.dora.exploreV3.sections", ["name", "body"])
    wanted = sections.where(get(F.col("item"), "$.__typename", "string") == "DoraExploreV3ListingsSection")
    if only_first:
        line = Window.partitionBy("name", "body").orderBy("pos")
        wanted = wanted.withColumn("_n", F.row_number().over(line)).where("_n = 1").drop("_n")
    items = exploded(wanted.withColumnsRenamed({"item": "section"}), "section", "$.items", ["name"])
    return items.select("name", get(F.col("item"), "$.listing.id", "long").alias("listing_id")).where("listing_id is not null").distinct()


def total_count(pages: DataFrame) -> DataFrame:
    return pages.select("name", get(F.try_parse_json("body"), "$.data.dora.exploreV3.metadata.paginationMetadata.totalCount", "int").alias("total"))


#: Section kind, path of its value, column and type. Of several sections that give a column, the last one counts.
_ROOM = (
    ("DESCRIPTION_DEFAULT", "$.section.htmlDescription.htmlText", "description", "string"),
    ("BOOK_IT_FLOATING_FOOTER", "$.section.reviewItem.title", "rating", "double"),
    ("BOOK_IT_SIDEBAR", "$.section.reviewItem.title", "rating", "double"),
    ("NAV_MOBILE", "$.section.sharingConfig.title", "title", "string"),
    ("NAV_MOBILE", "$.section.sharingConfig.personCapacity", "person_capacity", "int"),
    ("NAV_MOBILE", "$.section.sharingConfig.starRating", "rating", "double"),
    ("NAV_MOBILE", "$.section.sharingConfig.propertyType", "property_type", "string"),
    ("LOCATION_DEFAULT", "$.section.previewLocationDetails.title", "location", "string"),
    ("LOCATION_DEFAULT", "$.section.previewLocationDetails.content.htmlText", "neighborhood", "string"),
    ("LOCATION_DEFAULT", "$.section.lat", "lat", "double"),
    ("LOCATION_DEFAULT", "$.section.lng", "lng", "double"),
)


def room_records(pages: DataFrame, key: str = "page_id", body: str = "body") -> DataFrame:
    """One record for each page with a readable section array: typed columns by section kind, amenities and sleeping arrays.

    A missing or ill-typed value is null, and null stays out of the way of an earlier
    section that has the value.
    """
    parsed = pages.select(key, F.try_parse_json(body).alias("v"))
    sections = exploded(parsed, "v", "$.data.merlin.pdpSections", [key])
    kind = get(F.col("item"), "$.sectionId", "string")
    columns = dict.fromkeys(c for _, _, c, _ in _ROOM)
    aggregates = []
    for column in columns:
        value = F.coalesce(*[F.when(kind == section, get(F.col("item"), path, "string").try_cast(typ)) for section, path, c, typ in _ROOM if c == column])
        aggregates.append(F.max_by(value, F.when(value.isNotNull(), F.col("pos"))).alias(column))
    ways = F.filter(get(F.col("item"), "$.section.seeAllLocationDetails", "array<variant>"), lambda x: F.startswith(F.try_variant_get(x, "$.id", "string"), F.lit("getting")))
    getting = F.when(kind == "LOCATION_DEFAULT", F.try_variant_get(F.try_element_at(ways, F.lit(-1)), "$.content.htmlText", "string"))
    beds = F.when(kind == "SLEEPING_ARRANGEMENT_DEFAULT", F.transform(get(F.col("item"), "$.section.arrangementDetails", "array<variant>"), lambda x: F.struct(F.try_variant_get(x, "$.title", "string").alias("title"), F.try_variant_get(x, "$.subtitle", "string").alias("subtitle"))))
    aggregates += [F.max_by(getting, F.when(getting.isNotNull(), F.col("pos"))).alias("getting_around"), F.max_by(beds, F.when(beds.isNotNull(), F.col("pos"))).alias("sleeping")]
    return sections.groupBy(key).agg(*aggregates)


def amenity_map(rows: DataFrame, key: str, group: str, title: str, subtitle: str, order: str) -> DataFrame:
    """(key, amenities): map from group title to its (title, subtitle) pairs in order; of repeated titles the last group counts."""
    grouped = rows.where(F.col(group).isNotNull()).groupBy(key, group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(title).alias("title"), F.col(subtitle).alias("subtitle")))).alias("l"))
    pairs = grouped.select(key, F.struct(F.col(group).alias("key"), F.transform("l", lambda x: F.struct(x["title"].alias("title"), x["subtitle"].alias("subtitle"))).alias("value")).alias("e"))
    return pairs.groupBy(key).agg(F.map_from_entries(F.collect_list("e")).alias("amenities"))


def existing_images(image_rows: DataFrame, files: DataFrame) -> DataFrame:
    """Image rows whose photo has a file."""
    return image_rows.join(files.select("photo_id").distinct(), "photo_id", "left_semi")


def amenities(listings: DataFrame, key: str = "listing_id", column: str = "amenities") -> DataFrame:
    """(key, title, pos, amenity, subtitle): one row for each pair of each group of a map; repeated rows count once, null keys not."""
    groups = listings.where(F.col(key).isNotNull()).select(key, F.explode(F.map_entries(column)).alias("e"))
    distinct = groups.select(key, F.col("e.key").alias("title"), F.col("e.value").alias("items")).distinct()
    pairs = distinct.select(key, "title", F.posexplode("items").alias("pos", "i"))
    return pairs.select(key, "title", "pos", F.col("i.title").alias("amenity"), F.col("i.subtitle").alias("subtitle"))


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """One record for each review: the last loaded row, of equal times the one of the lowest listing. A null id is one review."""
    columns = ["listing_id", "comment", "created_at", "language", "is_superhost"]
    rank = F.struct(F.col("loaded_at").isNotNull(), F.col("loaded_at"), -F.coalesce("listing_id", F.lit(-(1 << 62))))
    last = reviews.groupBy("review_id").agg(F.max_by(F.struct(*columns), rank).alias("r")).select("review_id", "r.*")
    return last.withColumn("language", F.lower(F.split_part(F.trim("language"), F.lit("-"), F.lit(1))))
