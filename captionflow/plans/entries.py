"""Queries of sources, sinks, streams and of functions that no other query goes through.

Files are written to the shared folder by a sink and read back by a source, so a row that comes out has
gone through both.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionflow.functions import arrays as A
from captionflow.functions import text as T
from captionflow.functions import views as V
from captionflow.operators import audit, boxes, captions, crawl, detections, documents, features, phrases
from captionflow.plans.registry import Registry
from captionflow.session import scratch
from captionflow.sources import files, search, sinks
from captionflow.streaming import captions as streams
from captionflow.tables import table

_R = Registry()
QUERIES, ORACLE, query = _R.queries, _R.oracle, _R.query

# Files ------------------------------------------------------------------------------------------------

_TSV = "SELECT listing_id, photo_id, coalesce(url, '') AS url, coalesce(caption, '') AS caption FROM captions"


@query(_TSV)
def tsv_round_trip(spark, d):
    """Chosen columns to a headerless TSV and back; quotes, tabs and line breaks in fields stay."""
    path = scratch(spark, "tsv")
    sinks.write_tsv(table(spark, d, "captions"), path, ["listing_id", "photo_id", "url", "caption"])
    return files.read_captions(spark, path)


@query(f"{_TSV} UNION ALL {_TSV} WHERE listing_id IS NOT NULL")
def tsv_header_glob(spark, d):
    """TSV files with a header in folders below one another, chosen by their names."""
    path, rows = scratch(spark, "tsv"), table(spark, d, "captions").select("listing_id", "photo_id", "url", "caption")
    sinks.write_tsv(rows, f"{path}/a", header=True)
    sinks.write_tsv(rows.where("listing_id is not null"), f"{path}/b/c", header=True, line_end="\r\n")
    return files.read_captions(spark, path, header=True, pattern="part-*.csv", recursive=True)


@query("SELECT item_id, listing_id, caption FROM captions UNION ALL SELECT item_id, listing_id, caption FROM captions WHERE split = 'test'")
def json_round_trip(spark, d):
    """Indented array documents and line objects."""
    path, rows = scratch(spark, "json"), table(spark, d, "captions").select("item_id", "listing_id", "caption", "split")
    sinks.write_json(rows, f"{path}/documents", document=True)
    sinks.write_json(rows.where("split = 'test'"), f"{path}/lines")
    kind = "item_id long, listing_id long, caption string"
    return files.read_json_items(spark, f"{path}/documents", kind).unionByName(files.read_json_items(spark, f"{path}/lines", kind, lines=True))


@query("SELECT listing_id::VARCHAR AS value FROM listings UNION ALL SELECT listing_id::VARCHAR FROM room_pages WHERE listing_id IS NOT NULL")
def lines_round_trip(spark, d):
    """Lists of listings in several folders, read as one."""
    path = scratch(spark, "lines")
    sinks.write_lines(table(spark, d, "listings"), "listing_id", f"{path}/a")
    sinks.write_lines(table(spark, d, "room_pages").where("listing_id is not null"), "listing_id", f"{path}/b")
    return files.read_lines(spark, path, pattern="part-*.txt")


@query("SELECT coalesce(state, '') AS state, photo_id::VARCHAR AS value FROM images WHERE photo_id IS NOT NULL AND state IS NOT NULL")
def partitioned_lines(spark, d):
    """One folder of text files for each key."""
    path = scratch(spark, "parts")
    rows = table(spark, d, "images").where("photo_id is not null and state is not null")
    sinks.write_partitioned_lines(rows, "state", "photo_id", path)
    return spark.read.text(path).select(F.col("state").cast("string").alias("state"), "value")


@query("SELECT c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS kind FROM customer")
def open_data(spark, d):
    """Semicolon CSV whose header is passed over."""
    path = scratch(spark, "open")
    table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").write.csv(path, sep=";", header=True, quote='"', escape='"')
    return files.read_open_data(spark, path, ["id", "name", "kind"])


@query("SELECT DISTINCT replace(regexp_replace(split_part(location, ',', 1), '[''/\"]', '', 'g'), '-', ' ') || ' ' || regexp_replace(split_part(location || ',x', ',', 2), '[''/\"]', '', 'g') || ' Land' AS place FROM listings WHERE location IS NOT NULL AND trim(location) <> ''")
def place_file(spark, d):
    """Comma files without their first lines, cut plainly."""
    path = scratch(spark, "places")
    rows = table(spark, d, "listings").where("location is not null and trim(location) <> ''").select(F.concat("location", F.lit(",x,y")).alias("value"))
    text = rows.repartition(4).mapInArrow(_with_header, "value string")
    text.write.text(path)
    return files.read_place_lines(spark, path).select(T.place_line(F.col("line"), 1, 2, suffix=" Land").alias("place")).distinct()


def _with_header(batches):
    import pyarrow as pa

    yield pa.RecordBatch.from_arrays([pa.array(["name,country"])], names=["value"])
    yield from batches


@query("WITH k AS (SELECT DISTINCT listing_id || '-' || photo_id AS key FROM captions WHERE listing_id IS NOT NULL AND photo_id IS NOT NULL) SELECT key, 1 AS n FROM k")
def key_value_round_trip(spark, d):
    """Two writes into key-value tables, the second without the keys of the first; then all keys and all rows."""
    rows = table(spark, d, "captions").select(T.photo_key(F.col("listing_id"), F.col("photo_id")).alias("key"), "caption", "split").where("key is not null")
    path = scratch(spark, "kv")
    sinks.write_key_values(rows.where("split = 'train'"), "key", f"{path}/a")
    sinks.write_key_values(rows, "key", f"{path}/b", existing=files.read_keys(spark, f"{path}/a"))
    both = files.read_key_values(spark, f"{path}/a").unionByName(files.read_key_values(spark, f"{path}/b"))
    return both.groupBy("key").agg(F.count("*").cast("int").alias("n"))


@query("SELECT listing_id || '-' || photo_id AS key FROM captions WHERE split = 'test' AND listing_id IS NOT NULL AND photo_id IS NOT NULL GROUP BY 1")
def key_value_look_up(spark, d):
    rows = table(spark, d, "captions").select(T.photo_key(F.col("listing_id"), F.col("photo_id")).alias("key"), "caption", "split").where("key is not null")
    path = scratch(spark, "kv")
    sinks.write_key_values(rows, "key", path)
    return files.read_key_values(spark, path, rows.where("split = 'test'")).select("key")


@query("SELECT 'rooms' AS name, count(*) AS n FROM room_pages UNION ALL SELECT 'reviews', 2 * count(*) FROM reviews UNION ALL SELECT 'images', count(*) FROM images WHERE photo_id > 0")
def document_store(spark, d):
    """Three collections replaced, one of them then appended to."""
    rooms, reviews, images = (table(spark, d, n) for n in ("room_pages", "reviews", "images"))
    path = scratch(spark, "store")
    sinks.write_documents(rooms, reviews, images, path, reset=True)
    sinks.write_documents(rooms, reviews, images.where("photo_id > 0"), path, reset=True)
    sinks.write_documents(rooms.limit(0), reviews, images.limit(0), path)
    counts = [spark.read.parquet(f"{path}/{n}").agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("rooms", "reviews", "images")]
    return counts[0].union(counts[1]).union(counts[2])


@query("SELECT photo_id > 0 AND photo_id IS NOT NULL AS good, count(*) AS n FROM images GROUP BY 1")
def quarantined(spark, d):
    path = scratch(spark, "bad")
    good = sinks.quarantine(table(spark, d, "images"), F.col("photo_id") > 0, path)
    bad = spark.read.json(path)
    return good.agg(F.lit(True).alias("good"), F.count("*").alias("n")).union(bad.agg(F.lit(False), F.count("*")))


# Small files of a crawl: one for each of the 25 nations -------------------------------------------------

_TOUR = "$.data.merlin.pdpPhotoTour.images"


def crawl_folder(spark: SparkSession) -> str:
    """Documents, images, search pages and graphs as a crawl leaves them; their contents follow from the number."""
    path = scratch(spark, "crawl")
    for i in range(25):
        body = '{"data": {"merlin": {"pdpPhotoTour": {"images": [{"id": %d, "baseUrl": "u%d"}]}}}}' % (100 + i, i)
        bad = {0: " ", 1: "{", 2: "{}", 3: '{"data": {"merlin": null}}'}
        sinks.put(spark, f"{path}/merlin/here/{i}/photos.json", bad.get(i, body))
        if i % 5 == 0:
            sinks.put(spark, f"{path}/merlin/zz/{i}/photos.json", body.replace('"u', '"v'))
        if i % 2:
            sinks.put(spark, f"{path}/merlin/here/{i}/room1.json", '{"data": {"merlin": {"pdpSections": []}}}' if i > 3 else "[")
        sinks.put(spark, f"{path}/merlin/here/n{i}/photos.json", body)
        if i % 3:
            sinks.put(spark, f"{path}/images/{i}/{i}-{100 + i}.jpg", bytes([i]) * (i % 7 + 1) if i % 4 else b"\0")
        items = ", ".join('{"listing": {"id": %d}}' % (i * 10 + k) for k in range(3))
        sections = '{"__typename": "Other"}, {"__typename": "DoraExploreV3ListingsSection", "items": [%s]}, {"__typename": "DoraExploreV3ListingsSection", "items": [{"listing": {"id": %d}}]}' % (items, 1000 + i)
        page = '{"data": {"dora": {"exploreV3": {"metadata": {"paginationMetadata": {"totalCount": %d}}, "sections": [%s]}}}}' % (i * 30, sections)
        sinks.put(spark, f"{path}/search/town{i}_{i * 50}.json", page if i else "{")
        nodes = ", ".join('{"image_id": "v%d", "included": %s}' % (k, "true" if k % 2 else "false") for k in range(i % 4 + 1))
        sinks.put(spark, f"{path}/graph/s{i}_connectivity.json", f"[{nodes}]")
    sinks.put(spark, f"{path}/graph/scans.txt", "\n".join(f" s{i} " for i in range(0, 25, 2)))
    return path


@query("SELECT i AS listing_id, 100 + i AS photo_id, CASE WHEN i IN (0) THEN 'v' ELSE 'u' END || i AS url, '' AS caption FROM range(25) t(i) WHERE i NOT IN (1, 2, 3)")
def listing_documents(spark, d):
    """Of each listing the first readable photo document, its photos exploded."""
    found = files.read_listing_documents(spark, f"{crawl_folder(spark)}/merlin", root=_TOUR)
    return documents.photos(found).select("listing_id", "photo_id", "url", "caption")


@query("SELECT CASE WHEN i = 0 THEN 'empty' ELSE 'corrupt' END AS reason, 1 AS n FROM range(2) t(i)")
def unreadable_documents(spark, d):
    bad = files.unreadable_documents(spark, f"{crawl_folder(spark)}/merlin")
    return bad.groupBy("reason").agg(F.count("*").cast("int").alias("n"))


_AUDIT = """SELECT 'no folder' AS reason, 'here' AS location, i AS listing_id FROM range(25) t(i) WHERE i % 3 = 0 UNION ALL SELECT CASE WHEN i IN (0, 1, 3) THEN 'corrupted photos.json' ELSE 'no photos.json' END, 'here', i FROM range(25) t(i) WHERE i IN (0, 1, 2, 3)
UNION ALL SELECT CASE WHEN i IN (1, 3) THEN 'corrupted room1.json' ELSE 'no room1.json' END, 'here', i FROM range(25) t(i) WHERE i % 2 = 0 OR i IN (1, 3)"""


@query(_AUDIT)
def download_audit(spark, d):
    """Missing folders, and missing and corrupt documents of two kinds."""
    path = crawl_folder(spark)
    kinds = {"photos.json": _TOUR, "room1.json": "$.data.merlin.pdpSections"}
    docs = None
    for kind in kinds:
        rows = files.all_documents(spark, f"{path}/merlin/here", kind).select("listing_id", F.lit(kind).alias("kind"), "body")
        docs = rows if docs is None else docs.unionByName(rows)
    listings = spark.range(25).select(F.col("id").alias("listing_id"), F.lit("here").alias("location"))
    images = files.read_images(spark, f"{path}/images")
    return audit.download_report(listings, images, docs, kinds)


@query("SELECT i AS listing_id, 100 + i AS photo_id, i % 7 + 1 AS width, i AS height FROM range(25) t(i) WHERE i % 3 <> 0 AND i % 4 <> 0")
def image_files(spark, d):
    """Images with their sizes by a given decoder; empty ones can't be read and are dropped."""
    images = files.read_images(spark, f"{crawl_folder(spark)}/images")
    return files.decoded_images(images, _decode).select("listing_id", "photo_id", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))


def _decode(data: bytes) -> tuple[int, int]:
    if not data[0]:
        raise ValueError("no image")
    return len(data), data[0]


def _tags(data: bytes) -> dict | None:
    return {"first": _decode(data)[1], "length": len(data)} if data[0] % 2 or not data[0] else None


@query("SELECT CASE WHEN i % 4 = 0 THEN 'corrupt image' ELSE 'no metadata' END AS reason, count(*) AS n FROM range(25) t(i) WHERE i % 3 <> 0 AND i % 2 = 0 GROUP BY 1")
def image_audit(spark, d):
    images = files.read_images(spark, f"{crawl_folder(spark)}/images")
    return audit.corrupt_images(images, _tags).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT i || '-' || (100 + i) AS key, CASE WHEN i % 4 = 0 THEN 1 ELSE i % 7 + 1 END AS length, CASE WHEN i % 2 = 1 THEN i::VARCHAR END AS first FROM range(25) t(i) WHERE i % 3 <> 0")
def image_store(spark, d):
    """Images and what a tag reader finds in them as a key-value table."""
    path = crawl_folder(spark)
    sinks.write_images(files.read_images(spark, f"{path}/images"), f"{path}/kv", _tags)
    rows = files.read_key_values(spark, f"{path}/kv")
    return rows.select("key", F.length("content").cast("long").alias("length"), F.try_element_at("metadata", F.lit("first")).alias("first"))


@query("SELECT 'town' || i AS name, i * 10 + k AS listing_id FROM range(1, 25) t(i), range(3) u(k) UNION SELECT 'town' || i, 1000 + i FROM range(1, 25) t(i)")
def search_pages(spark, d):
    """Listings of all listing sections of stored search answers; broken answers are skipped."""
    search.register(spark)
    return documents.search_results(spark.read.format("stored_search").load(f"{crawl_folder(spark)}/search"))


@query("SELECT 'town' || i AS name, i * 10 + k AS listing_id FROM range(1, 25) t(i), range(3) u(k)")
def search_first_section(spark, d):
    search.register(spark)
    return documents.search_results(spark.read.format("stored_search").load(f"{crawl_folder(spark)}/search"), only_first=True)


@query('SELECT \'town\' || i AS name, unnest(range(50, i * 30, 50)) AS "offset" FROM range(1, 25) t(i)')
def search_offsets(spark, d):
    """The further pages of each search by the total it gives."""
    search.register(spark)
    totals = documents.total_count(spark.read.format("stored_search").load(f"{crawl_folder(spark)}/search"))
    return crawl.page_offsets(totals, "name", "total").select("name", F.col("offset").cast("long").alias("offset"))


_VIEWS = "round((v // 12 - 1) * radians(30), 6) AS elevation, round(v % 12 * radians(30), 6) AS heading"


@query(f"SELECT 's' || i AS scan, 'v' || k AS viewpoint, v AS view, {_VIEWS} FROM range(0, 25, 2) t(i), range(4) u(k), range(36) w(v) WHERE k <= i % 4 AND k % 2 = 1")
def graph_views(spark, d):
    """36 views of the included nodes of the scans listed."""
    path = f"{crawl_folder(spark)}/graph"
    nodes = files.read_graph(spark, path, files.read_lines(spark, f"{path}/scans.txt"))
    views = files.panorama(nodes)
    return views.select("scan", "viewpoint", F.col("view").cast("long").alias("view"), F.round("elevation", 6).alias("elevation"), F.round("heading", 6).alias("heading"))


# Documents made of rows ---------------------------------------------------------------------------------

@query("SELECT listing_id, photo_id, 'u' || photo_id AS url, coalesce(caption, '') AS caption FROM images WHERE listing_id IS NOT NULL AND photo_id IS NOT NULL")
def photo_explode(spark, d):
    """Photos of photo documents, one row each. A document holds the photos of a listing that share a hash, so none grows with it."""
    image = F.struct(F.col("photo_id").alias("id"), F.concat(F.lit("u"), "photo_id").alias("baseUrl"), F.struct("caption").alias("imageMetadata"))
    rows = table(spark, d, "images").where("listing_id is not null and photo_id is not null")
    held = rows.groupBy("listing_id", F.pmod(F.xxhash64("photo_id"), F.lit(256)).alias("b")).agg(F.collect_list(image).alias("images"))
    tour = F.struct(F.struct(F.struct(F.struct("images").alias("pdpPhotoTour")).alias("merlin")).alias("data"))
    return documents.photos(held.select("listing_id", F.to_json(tour.getField("data").alias("x")).alias("m")).select("listing_id", F.concat(F.lit('{"data": '), "m", F.lit("}")).alias("body"))).select("listing_id", "photo_id", "url", "caption")


@query("SELECT listing_id, review_id, comment, created_at, language, is_superhost FROM reviews WHERE listing_id IS NOT NULL")
def review_explode(spark, d):
    item = F.struct(F.col("review_id").alias("id"), F.col("comment").alias("comments"), F.col("created_at").alias("createdAt"), "language", F.struct(F.col("is_superhost").alias("isSuperhost")).alias("reviewee"))
    rows = table(spark, d, "reviews").where("listing_id is not null")
    held = rows.groupBy("listing_id", F.pmod(F.xxhash64("review_id"), F.lit(256)).alias("b")).agg(F.collect_list(item).alias("reviews"))
    body = F.to_json(F.struct(F.struct(F.struct(F.struct("reviews").alias("pdpReviews")).alias("merlin")).alias("data")))
    return documents.reviews(held.select("listing_id", body.alias("body")))


@query("SELECT listing_id, list_sort(list(DISTINCT k.key)) AS titles, sum(len(k.value)) AS n FROM (SELECT DISTINCT listing_id, k FROM listings, unnest(map_entries(amenities)) AS u(k) WHERE listing_id IS NOT NULL) GROUP BY 1")
def amenity_maps(spark, d):
    """Amenity rows back to a map of each listing."""
    rows = documents.amenities(table(spark, d, "listings"))
    maps = documents.amenity_map(rows, "listing_id", "title", "amenity", "subtitle", "pos")
    sizes = F.aggregate(F.map_values("amenities"), F.lit(0).cast("long"), lambda a, x: a + F.size(x))
    return maps.select("listing_id", F.array_sort(F.map_keys("amenities")).alias("titles"), sizes.alias("n"))


# Detections -----------------------------------------------------------------------------------------------

def printed_detections(spark: SparkSession, d: str) -> DataFrame:
    """Events as printed Python values, some numbers within a wrapper."""
    pair = F.concat(F.lit("(np.float32("), F.col("value").cast("string"), F.lit("), 'kitchen'), ("), (F.col("value") / 2).cast("string"), F.lit(", 'bed room')"))
    flag = F.concat(F.lit("("), F.col("value").cast("string"), F.when(F.col("event_id") % 2 == 0, ", True)").otherwise(", False)"))
    return table(spark, d, "events").select(F.col("user_id").alias("listing_id"), F.col("event_id").alias("photo_id"), F.concat(F.lit("["), pair, F.lit("]")).alias("category"), flag.alias("is_indoor"))


@query("SELECT event_id AS photo_id, round(value, 6) AS best, CASE WHEN value >= value / 2 THEN 'kitchen' ELSE 'bed room' END AS name, event_id % 2 = 0 AS indoor FROM events")
def printed_scores(spark, d):
    """The most probable class of a printed list and the printed flag."""
    top = detections.top_scores(detections.parse_scores(F.col("category")), 1)
    rows = printed_detections(spark, d).withColumn("t", top[0])
    return rows.select("photo_id", F.round("t.prob", 6).alias("best"), "t.name", detections.parse_flag(F.col("is_indoor")).alias("indoor"))


@query("SELECT user_id || '-' || event_id AS key FROM events WHERE event_id % 2 = 0")
def indoor_keys(spark, d):
    return detections.indoor_keys(printed_detections(spark, d))


@query("SELECT user_id || '-' || event_id AS key FROM events WHERE event_id % 2 = 0 AND event_id IN (SELECT o_orderkey FROM orders)")
def indoor_restricted(spark, d):
    """Indoor detections of the photos of a dataset."""
    dataset = table(spark, d, "orders").select(F.col("o_orderkey").alias("photo_id"))
    return detections.indoor_keys(captions.restricted(printed_detections(spark, d), dataset))


def _score_model(contents: list[bytes]) -> list[tuple]:
    return [([(0.25, "hall"), (0.5 if len(c) % 2 else 0.125, "kitchen")], [(float(len(c)), "wood")], (len(c) % 3 / 2, len(c) % 3 == 0)) for c in contents]


@query("SELECT listing_id, photo_id, CASE WHEN strlen(caption) % 2 = 1 THEN 'kitchen' ELSE 'hall' END AS name, strlen(caption) % 3 = 0 AS indoor FROM images WHERE caption IS NOT NULL")
def inferred_rooms(spark, d):
    """Detections of a given model over image contents, in Arrow batches."""
    images = table(spark, d, "images").where("caption is not null").select("listing_id", "photo_id", F.col("caption").cast("binary").alias("content"))
    found = detections.infer(images, _score_model)
    return found.select("listing_id", "photo_id", detections.top_scores(F.col("category"), 1)[0]["name"].alias("name"), F.col("is_indoor.flag").alias("indoor"))


def _box_model(listing: int, photo: int, content: bytes) -> list[tuple]:
    n = len(content)
    return [(photo, i, 1.0 - i / 4, float(i * 100), 0.0, float(i * 100 + n), 9.0) for i in range(n % 4)]


@query("""SELECT photo_id AS image, count(*) AS n FROM (SELECT photo_id, unnest(range(s % 4)) AS i FROM (SELECT DISTINCT photo_id, strlen(caption) AS s FROM images WHERE caption IS NOT NULL AND photo_id IS NOT NULL AND strlen(caption) < 100)) WHERE i < 2 GROUP BY 1""")
def built_boxes(spark, d):
    """Detect, suppress and select in one job; the boxes of short captions lie apart."""
    images = table(spark, d, "images").where("caption is not null and photo_id is not null and octet_length(caption) < 100").groupBy("photo_id", "caption").agg(F.min("listing_id").alias("listing_id"))
    one = images.select("listing_id", "photo_id", F.col("caption").cast("binary").alias("content"))
    schema = "image long, box int, confidence double, x1 double, y1 double, x2 double, y2 double"
    found = boxes.extract(one, _box_model, schema).dropDuplicates(["image", "box", "x2"])
    kept = boxes.non_maximum(found.withColumn("box", F.xxhash64("box", "x2")), 0.99)
    return kept.where("confidence > 0.5").groupBy("image").agg(F.count("*").alias("n"))


def feature_rows(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as printed feature rows: two boxes each, none where the number is a multiple of 5."""
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    matrix = F.array(F.slice("e", 1, 4), F.slice("e", 5, 4))
    cell = F.when(F.col("vec_id") % 5 == 0, F.lit("")).otherwise(A.encode_matrix(F.col("m")))
    return rows.withColumn("m", matrix).select((F.col("vec_id") % 7).cast("string").alias("listing_id"), F.col("vec_id").cast("string").alias("photo_id"), F.col("vec_id").alias("pos"), cell.alias("boxes"), A.encode_matrix(F.col("m")).alias("features"))


@query("SELECT (vec_id % 7) || '-' || vec_id AS key FROM embeddings WHERE vec_id % 5 <> 0 AND vec_id % 3 <> 0")
def feature_keys(spark, d):
    """Feature rows of the wanted photos that have boxes, keyed."""
    wanted = table(spark, d, "embeddings").where("vec_id % 3 <> 0").select(F.col("vec_id").alias("photo_id"))
    return features.key_values(feature_rows(spark, d), wanted, "pos").select("key")


@query("SELECT vec_id AS photo_id, b AS box, round(embedding[b * 4 + 1]::DOUBLE, 6) AS x1, round(embedding[b * 4 + 4]::DOUBLE, 6) AS y2 FROM embeddings, range(2) t(b) WHERE vec_id % 5 <> 0")
def feature_boxes(spark, d):
    """Matrices encoded, decoded and taken apart by box."""
    flat = features.per_box(features.decoded(feature_rows(spark, d), 4), ["photo_id"])
    return flat.select(F.col("photo_id").cast("long").alias("photo_id"), F.col("box").cast("long").alias("box"), F.round("x1", 6).alias("x1"), F.round("y2", 6).alias("y2"))


_E = "embedding::DOUBLE[]"


@query(f"""SELECT vec_id, round(list_dot_product(({_E})[1:4], ({_E})[5:8]), 6) AS product, [round(x, 6) FOR x IN list_concat(({_E})[9:12], ({_E})[1:4])] AS rows_taken,
[CASE WHEN list_max(({_E})[1:6]) > list_min(({_E})[1:6]) THEN CAST(floor((x - list_min(({_E})[1:6])) / (list_max(({_E})[1:6]) - list_min(({_E})[1:6])) * 255) AS INT) ELSE 0 END FOR x IN ({_E})[1:6]] AS bytes FROM embeddings""")
def matrix_functions(spark, d):
    """Product with a matrix, rows of two stacked matrices by their places, and scaling to bytes."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    part = lambda i: F.slice("e", i * 4 + 1, 4)
    both = A.stacked(F.array(part(0), part(1)), F.array(part(2)))
    taken = F.flatten(A.take_rows(both, F.array(F.lit(2), F.lit(0))))
    return e.select("vec_id", F.round(A.matvec(F.array(part(0)), part(1))[0], 6).alias("product"), F.transform(taken, lambda x: F.round(x, 6)).alias("rows_taken"), A.min_max_bytes(F.slice("e", 1, 6)).alias("bytes"))


_PIX = "[(vec_id * 7 + i * 13) % 256 FOR i IN range(24)]"


@query(f"""SELECT vec_id, [round((x / 255.0 - [0.5, 0.4, 0.3][(i - 1) % 3 + 1]) / [0.2, 0.25, 0.5][(i - 1) % 3 + 1], 6) FOR x, i IN small] AS scaled, [round(x - [104.0, 117.0, 123.0][(i - 1) % 3 + 1], 6) FOR x, i IN small] AS centred, small AS back
FROM (SELECT vec_id, [p[((i // 6) * 2 // 2 * 4 + (i % 6 // 3) * 4 // 2) * 3 + i % 3 + 1]::DOUBLE FOR i IN range(12)] AS small FROM (SELECT vec_id, {_PIX} AS p FROM embeddings))""")
def pixel_functions(spark, d):
    """A picture of 4 x 2 pixels made 2 x 2, its channels normalised, restored, and centred."""
    pixels = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: ((F.col("vec_id") * 7 + i * 13) % 256).cast("double"))
    rows = table(spark, d, "embeddings").select("vec_id", A.resized(pixels, 4, 2, 2, 2).alias("small"))
    mean, std = [0.5, 0.4, 0.3], [0.2, 0.25, 0.5]
    scaled = A.normalised_channels(F.col("small"), mean, std)
    rounded = lambda c: F.transform(c, lambda x: F.round(x, 6))
    return rows.select("vec_id", rounded(scaled).alias("scaled"), rounded(A.channel_means_removed(F.col("small"), [104.0, 117.0, 123.0])).alias("centred"), rounded(A.restored_channels(scaled, mean, std)).alias("back"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, round(least(abs(l_discount * 50 - l_tax * 10), {2 * math.pi!r} - abs(l_discount * 50 - l_tax * 10)), 6) AS turn FROM lineitem")
def heading_difference(spark, d):
    turn = V.circular_difference((F.col("l_discount") * 50).cast("double"), (F.col("l_tax") * 10).cast("double"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(turn, 6).alias("turn"))


# Texts and trees --------------------------------------------------------------------------------------------

_W = r"[\p{L}\p{M}\p{N}_]"


@query(rf"""SELECT item_id AS pos, lower(trim(c, ' .,' || chr(10))) AS sentence, c <> '' AND regexp_replace(c, '[!-/:-@\[-`{{-~\s]+', '', 'g') = '' AS punctuation, lower(trim(split_part(c, ',', 1))) AS vocabulary,
array_to_string(regexp_extract_all(lower(c), '{_W}+|[^\p{{L}}\p{{M}}\p{{N}}_\s\p{{Z}}]'), ' ') AS spaced FROM (SELECT item_id, coalesce(caption, '') AS c FROM captions)""")
def text_cleaning(spark, d):
    c = F.coalesce("caption", F.lit(""))
    rows = table(spark, d, "captions").select(F.col("item_id").alias("pos"), c.alias("c"))
    return rows.select("pos", T.clean_sentence(F.col("c")).alias("sentence"), T.is_punctuation(F.col("c")).alias("punctuation"), T.vocabulary_line(F.col("c")).alias("vocabulary"), T.spaced(F.col("c")).alias("spaced"))


@query("SELECT p_partkey, trim(split_part(trim(regexp_replace(replace(substring('/a/' || p_name || '_' || p_size || '/x', 4), '_', ' '), '[0-9]', '', 'g')), '/', 1)) AS scene FROM part")
def scene_names(spark, d):
    name = F.concat(F.lit("/a/"), "p_name", F.lit("_"), F.col("p_size").cast("string"), F.lit("/x"))
    return table(spark, d, "part").select("p_partkey", T.scene_name(name).alias("scene"))


@query("""WITH p AS (SELECT p_partkey, p_name || '. ' || p_type || '. ' || p_brand AS s FROM part), q AS (SELECT p_partkey, unnest(string_split(s, '. ')) AS text, unnest(range(len(string_split(s, '. ')))) AS i FROM p)
SELECT p_partkey, text, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY p_partkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start FROM q""")
def sentence_offsets(spark, d):
    s = F.concat_ws(". ", "p_name", "p_type", "p_brand")
    return table(spark, d, "part").select("p_partkey", F.inline(T.sentence_starts(s)))


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'e') THEN p_name[:instr(p_name, 'e') - 1] || 'EE' || p_name[instr(p_name, 'e') + 1:] ELSE p_name END AS first, replace(p_name, 'e', 'EE') AS every, ' ' || p_type || chr(10) AS \"outer\" FROM part")
def text_replacing(spark, d):
    return table(spark, d, "part").select("p_partkey", T.replace_first(F.col("p_name"), F.lit("e"), F.lit("EE")).alias("first"), F.replace("p_name", F.lit("e"), F.lit("EE")).alias("every"), T.keep_outer_space(F.concat(F.lit(" "), "p_name", F.lit("\n")), F.col("p_type")).alias("outer"))


@query("WITH t AS (SELECT p_partkey, string_split(p_name || ' of ' || p_type, ' ') AS w FROM part), r AS (SELECT p_partkey, w, unnest(range(1, len(w) + 1)) AS i FROM t) SELECT p_partkey, w[i] AS word, CAST(length(array_to_string(w[1:i - 1], ' ')) + CASE WHEN i > 1 THEN 1 ELSE 0 END AS INT) AS start FROM r WHERE contains(w[i], 'e')")
def found_places(spark, d):
    """Words with an e and where they begin."""
    return table(spark, d, "part").select("p_partkey", F.inline(T.found_at(F.concat_ws(" of ", "p_name", "p_type"), r"(?<!\S)\S*e\S*(?!\S)"))).select("p_partkey", F.col("text").alias("word"), "start")


def parse_trees(spark: SparkSession, d: str) -> DataFrame:
    """Parse trees of short sentences: a phrase, a verb and a prepositional phrase with another one in it."""
    leaf = lambda kind, word: F.concat(F.lit('{"nodeType": "%s", "word": "' % kind), word, F.lit('"}'))
    inner = F.concat(F.lit('{"nodeType": "PP", "word": "near '), "p_type", F.lit('", "children": ['), leaf("NP", F.col("p_type")), F.lit("]}"))
    sentence = F.concat("p_name", F.lit(" stands near "), "p_type")
    tree = F.concat(F.lit('{"nodeType": "S", "word": "'), sentence, F.lit('", "children": ['), leaf("NP", F.col("p_name")), F.lit(","), leaf("VBZ", F.lit("stands")), F.lit(","), inner, F.lit("]}"))
    return table(spark, d, "part").select("p_partkey", "p_name", "p_type", sentence.alias("sentence"), tree.alias("tree"))


@query("SELECT p_partkey, [lower(p_name)] AS phrases FROM part")
def tree_phrases(spark, d):
    """Accepted phrases of a parse; those within prepositional phrases are passed over."""
    return parse_trees(spark, d).select("p_partkey", phrases.tree_phrases(F.col("tree")).alias("phrases"))


@query("SELECT p_partkey, 0 AS \"start\", length(p_name)::INT AS \"end\" FROM part UNION ALL SELECT p_partkey, length(p_name || ' stands near ')::INT, length(p_name || ' stands near ' || p_type)::INT FROM part WHERE len(string_split(p_type, ' ')) BETWEEN 2 AND 6")
def tree_spans(spark, d):
    return parse_trees(spark, d).select("p_partkey", F.inline(phrases.tree_spans(F.col("tree"), F.col("sentence"))))


def _tagger(sentence: str) -> list[tuple[str, str]]:
    return [(w, "NN" if w.endswith("t") else "DT") for w in sentence.split()]


@query("SELECT p_partkey, list_filter(string_split(lower(p_name || ' next point'), ' '), lambda w: ends_with(w, 't') AND w NOT IN ('next', 'then', 'there', 'just')) AS words FROM part")
def highlighted_words(spark, d):
    """The words of the tags asked for, by a given tagger."""
    rows = table(spark, d, "part").select("p_partkey", F.array(F.concat("p_name", F.lit(" next point"))).alias("i"))
    return phrases.highlights(rows, "i", _tagger).select("p_partkey", F.col("highlights")[0].alias("words"))


@query("WITH r AS (SELECT DISTINCT p_name AS w, p_brand AS v FROM part) SELECT a.p_partkey, a.p_name = a.p_type OR EXISTS (SELECT 1 FROM r WHERE (w = p_name AND v = p_type) OR (v = p_name AND w = p_type)) OR EXISTS (SELECT 1 FROM r WHERE w = a.p_name AND v = a.p_brand AND a.p_partkey % 2 = 0) AS same FROM part a")
def related_words(spark, d):
    """Pairs that are equal or related either way; every second part is asked about its own brand."""
    part = table(spark, d, "part")
    relations = part.select(F.col("p_name").alias("word"), F.col("p_brand").alias("related")).distinct()
    pairs = part.select("p_partkey", F.col("p_name").alias("a"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type")).alias("b"))
    return phrases.related(pairs, relations).select("p_partkey", "same")


# Rows of work ----------------------------------------------------------------------------------------------

@query("SELECT location, min(item) AS first FROM (SELECT location, photo_id * 100000 + coalesce(listing_id, 0) % 100000 AS item FROM images WHERE photo_id IS NOT NULL) GROUP BY 1")
def first_seen(spark, d):
    rows = table(spark, d, "images").where("photo_id is not null").withColumn("item", F.col("photo_id") * 100000 + F.coalesce("listing_id", F.lit(0)) % 100000)
    return captions.first_seen(rows, ["location"], "item")


@query("SELECT listing_id, photo_id, arg_max(source, item_id) AS source, arg_max(split, item_id) AS split FROM captions GROUP BY 1, 2")
def last_of_pair(spark, d):
    return captions.nested_map(table(spark, d, "captions"), "listing_id", "photo_id", ["source", "split"], "item_id")


@query("SELECT event_id, CAST(floor(avg(value) OVER (PARTITION BY user_id ORDER BY event_id) * 1000 + 0.0001) AS BIGINT) AS mean FROM events")
def running_average(spark, d):
    rows = captions.running_mean(table(spark, d, "events"), "user_id", "event_id", "value")
    return rows.select("event_id", F.floor(F.col("mean") * 1000 + 0.0001).alias("mean"))


@query("SELECT item_id AS pos, n % 12 AS worker, n // 12 AS place, 'train.tsv.' || lpad((n % 12)::VARCHAR, 2, '0') AS part FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS n FROM captions)")
def worker_parts(spark, d):
    rows = table(spark, d, "captions").select(F.col("item_id").alias("pos"))
    return captions.worker_parts(captions.row_numbers(rows, "pos"), 12, "train.tsv").drop("row_no")


@query("SELECT item_id AS pos, (row_number() OVER (ORDER BY item_id) - 1) % 3 AS worker FROM captions")
def stride_reassembly(spark, d):
    """Strides worked on apart, put together again."""
    numbered = captions.row_numbers(table(spark, d, "captions").select(F.col("item_id").alias("pos")), "pos")
    parts = [captions.strided(numbered, 3).where(F.col("stride") == i).drop("stride").withColumn("worker", F.lit(i).cast("long")) for i in range(3)]
    return captions.reassembled(parts, 3).select("pos", "worker")


@query("SELECT listing_id, listing_id || ' of run 7' AS job, row_number() OVER (ORDER BY listing_id, item_id) AS place FROM captions WHERE listing_id IS NOT NULL ORDER BY listing_id, item_id LIMIT 50")
def first_items(spark, d):
    """The first fifty items in listing order, each with the arguments of the run: a limit that is the feature."""
    rows = table(spark, d, "captions").where("listing_id is not null").orderBy("listing_id", "item_id").limit(50)
    lined = captions.row_numbers(rows.withColumn("pos", F.struct("listing_id", "item_id")), "pos")
    return lined.select("listing_id", F.concat(F.col("listing_id").cast("string"), F.lit(" of run 7")).alias("job"), (F.col("row_no") + 1).alias("place"))


@query("SELECT l_orderkey, list(l_linenumber || '=' || CAST(l_quantity AS INT) ORDER BY l_linenumber) AS lines FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def zipped_lines(spark, d):
    """Two lists of an order zipped, names with values."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("int").alias("q"))
    g = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "q"))).alias("g"))
    zipped = F.arrays_zip(F.col("g.l_linenumber").alias("n"), F.col("g.q").alias("q"))
    return g.select("l_orderkey", F.transform(zipped, lambda x: F.concat(x["n"].cast("string"), F.lit("="), x["q"].cast("string"))).alias("lines"))


# Streams ------------------------------------------------------------------------------------------------------

@query("WITH e AS (SELECT date_trunc('day', ts) AS start, event_type, (SELECT max(ts) FROM events) AS last FROM events) SELECT start, event_type, count(*) AS n FROM e WHERE start + INTERVAL 1 DAY <= last - INTERVAL 2 DAY GROUP BY 1, 2")
def stream_windows(spark, d):
    """Daily counts of a finished stream: the windows that its watermark has closed."""
    events = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = _finished(spark, streams.windowed_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type"), "windows")
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT listing_id, caption, 1::BIGINT AS n FROM captions WHERE caption IS NOT NULL AND trim(caption, '., ' || chr(10)) <> '' GROUP BY 1, 2")
def stream_first_uses(spark, d):
    """The first use of each caption of a listing in a stream of caption files."""
    path = scratch(spark, "tsv")
    sinks.write_tsv(table(spark, d, "captions"), path, ["listing_id", "photo_id", "url", "caption"])
    rows = _finished(spark, streams.first_uses(streams.caption_stream(spark, path)), "uses")
    return rows.groupBy("listing_id", "caption").agg(F.count("*").alias("n"))


def _finished(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """All that a stream gives until its present input is used up."""
    path = scratch(spark, name)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
