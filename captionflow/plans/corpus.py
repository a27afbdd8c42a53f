"""Queries of the corpus operators over the test tables, each with the DuckDB SQL it is checked against."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from captionflow.functions import arrays as A
from captionflow.functions import text as T
from captionflow.functions import views as V
from captionflow.operators import audit, boxes, captions, crawl, detections, documents, merging, phrases, trajectories
from captionflow.operators.running import hash_order_sql
from captionflow.plans.registry import Registry
from captionflow.tables import table

_R = Registry()
QUERIES, ORACLE, query = _R.queries, _R.oracle, _R.query


# Stand-ins for the reference's tables ----------------------------------------------------------------

P1 = "trim(coalesce(caption, ''), '., ' || chr(10)) = ''"
P2 = "regexp_replace(coalesce(caption, ''), '^[\\s\\p{Z}\\x0B\\x{85}\\x1C-\\x1F]+|[\\s\\p{Z}\\x0B\\x{85}\\x1C-\\x1F]+$', '', 'g') = ''"


def caption_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "captions").select("listing_id", "photo_id", "url", "caption", F.col("item_id").alias("pos"), "split", "source")


def fine_scores(spark: SparkSession, d: str) -> DataFrame:
    """Events as class scores: a user is a photo, an event type one of five scenes."""
    scene = F.coalesce(*[F.when(F.col("event_type") == e, F.lit(s)) for e, s in SCENES.items()])
    return table(spark, d, "events").select(F.col("user_id").alias("photo_id"), scene.alias("name"), F.col("value").alias("prob"), "event_id", F.when(F.col("event_type").isin("error", "view"), 1).otherwise(0).alias("outdoor"))


SCENES = {"view": "kitchen", "click": "bedroom", "purchase": "shower", "signup": "bow_window/indoor", "error": "parking_lot"}
_SCENE_SQL = "CASE event_type WHEN 'view' THEN 'kitchen' WHEN 'click' THEN 'bedroom' WHEN 'purchase' THEN 'bathroom' WHEN 'signup' THEN 'alcove' END"


def hierarchy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, r, i) for i, (n, r) in enumerate(detections.HIERARCHY)], "name string, room string, pos int")


def room_photos(spark: SparkSession, d: str) -> DataFrame:
    """Events as detected photos: listing = user, room by event type, captioned by event number."""
    room = F.coalesce(*[F.when(F.col("event_type") == e, F.lit(r)) for e, r in {"view": "kitchen", "click": "bedroom", "purchase": "bathroom", "signup": "living_room", "error": "office"}.items()])
    return table(spark, d, "events").select(F.col("user_id").alias("listing_id"), F.col("event_id").alias("photo_id"), room.alias("room"), F.col("value").alias("score"), (F.col("event_id") % 3 == 0).alias("captioned"), F.col("event_id").alias("pos"))


# Captions -----------------------------------------------------------------------------------------

_DEDUP = f"SELECT listing_id, photo_id, url, item_id AS pos, CASE WHEN row_number() OVER (PARTITION BY listing_id, caption ORDER BY item_id) > 1 AND NOT ({P1}) THEN '' ELSE caption END AS caption FROM captions"


@query(_DEDUP)
def caption_dedup_blank(spark, d):
    return captions.blank_repeats(caption_rows(spark, d), "pos").select("listing_id", "photo_id", "url", "pos", "caption")


_FIT = f"""c AS ({_DEDUP}), f AS (SELECT listing_id AS l, count(*) AS n_photos, count(*) FILTER (WHERE NOT ({P2})) AS n_captioned FROM c GROUP BY 1 HAVING count(*) >= 4 AND count(*) FILTER (WHERE NOT ({P2})) >= 2)"""


@query(f"WITH {_FIT} SELECT listing_id, photo_id, pos, [CASE WHEN {P2} THEN '' ELSE caption END] AS instructions FROM c JOIN f ON c.listing_id IS NOT DISTINCT FROM f.l")
def caption_listings(spark, d):
    blanked = captions.blank_repeats(caption_rows(spark, d), "pos")
    return captions.listing_items(captions.fit_listings(blanked), "pos").select("listing_id", "photo_id", "pos", "instructions")


@query(f"WITH {_FIT} SELECT l AS listing_id, n_photos, n_captioned FROM f")
def caption_listing_counts(spark, d):
    blanked = captions.blank_repeats(caption_rows(spark, d), "pos")
    return captions.listing_counts(captions.fit_listings(blanked))


@query(f"""WITH c AS (SELECT * FROM captions WHERE NOT ({P2})), f AS (SELECT listing_id AS l FROM c GROUP BY 1 HAVING count(*) >= 4)
SELECT listing_id, photo_id, item_id AS pos, [caption] AS instructions FROM c JOIN f ON c.listing_id IS NOT DISTINCT FROM f.l""")
def caption_items_captioned(spark, d):
    return captions.listing_items(captions.fit_listings(caption_rows(spark, d), captionless=False), "pos")


@query(f"SELECT item_id AS pos, caption FROM captions WHERE NOT ({P2})")
def captions_nonempty(spark, d):
    return caption_rows(spark, d).where(~T.is_captionless(F.col("caption"))).select("pos", "caption")


@query(f"SELECT item_id AS pos, caption FROM captions WHERE {P1}")
def captions_empty_strict(spark, d):
    return caption_rows(spark, d).where(T.is_empty(F.col("caption"))).select("pos", "caption")


@query(f"SELECT count(*) AS n_rows, count(DISTINCT listing_id) AS n_listings, count(DISTINCT photo_id) AS n_photos, count(*) FILTER (WHERE NOT ({P2})) AS n_captioned, count(*) FILTER (WHERE {P2}) AS n_captionless FROM captions")
def caption_totals(spark, d):
    return captions.totals(caption_rows(spark, d))


@query("SELECT item_id AS pos, listing_id || '-' || photo_id AS key, 'images/' || listing_id || '-' || photo_id || '.jpg' AS path FROM captions")
def key_build(spark, d):
    c = caption_rows(spark, d)
    return c.select("pos", T.photo_key(F.col("listing_id"), F.col("photo_id")).alias("key"), T.photo_path("images", F.col("listing_id"), F.col("photo_id")).alias("path"))


@query("SELECT item_id AS pos, TRY_CAST(split_part(listing_id || '-' || photo_id, '-', 2) AS BIGINT) AS photo, TRY_CAST(regexp_extract('images/' || listing_id || '-' || photo_id || '.jpg', '(?:^|/)\\d+[-_](\\d+)\\.[^./]+$', 1) AS BIGINT) AS path_photo FROM captions")
def key_parse(spark, d):
    return key_build(spark, d).select("pos", T.photo_of_key(F.col("key")).alias("photo"), T.photo_of_path(F.col("path")).alias("path_photo"))


_FIRST = """WITH k AS (SELECT DISTINCT photo_id FROM images WHERE photo_id IN (SELECT photo_id FROM images WHERE state = 'downloaded')),
r AS (SELECT c.*, row_number() OVER (PARTITION BY photo_id ORDER BY item_id) AS n FROM captions c WHERE photo_id IN (SELECT photo_id FROM k))
SELECT listing_id, photo_id, item_id AS pos, caption FROM r WHERE n = 1"""


@query(_FIRST)
def indoor_semi_join(spark, d):
    keys = table(spark, d, "images").where("state = 'downloaded'").select("photo_id")
    return captions.first_match(caption_rows(spark, d), keys, "photo_id", "pos").select("listing_id", "photo_id", "pos", "caption")


@query(f"SELECT * FROM ({_FIRST}) WHERE NOT (trim(coalesce(caption, ''), '., ' || chr(10)) = '')")
def first_match_then_filter(spark, d):
    keys = table(spark, d, "images").where("state = 'downloaded'").select("photo_id")
    return captions.first_match(caption_rows(spark, d), keys, "photo_id", "pos", ~T.is_empty(F.col("caption"))).select("listing_id", "photo_id", "pos", "caption")


@query("""WITH r AS (SELECT l.*, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber, l_suppkey, l_extendedprice) AS n FROM lineitem l WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10))
SELECT l_partkey, l_orderkey, l_linenumber FROM r WHERE n = 1""")
def first_match_semi(spark, d):
    rows = table(spark, d, "lineitem").withColumn("pos", F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_suppkey", "l_extendedprice"))
    keys = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return captions.first_match(rows, keys, "l_partkey", "pos").select("l_partkey", "l_orderkey", "l_linenumber")


@query("""SELECT c.item_id AS pos, coalesce(m.merging, [c.photo_id]) AS merging, coalesce(m.room, 'unknown') AS room
FROM captions c LEFT JOIN (SELECT photo_id, [min(listing_id), max(listing_id)] AS merging, max(location) AS room FROM images WHERE photo_id > 0 GROUP BY 1 HAVING count(DISTINCT listing_id) > 1) m ON m.photo_id = c.photo_id""")
def left_join_defaults(spark, d):
    i = table(spark, d, "images").where("photo_id > 0").groupBy("photo_id").agg(F.count_distinct("listing_id").alias("n"), F.array(F.min("listing_id"), F.max("listing_id")).alias("merging"), F.max("location").alias("room")).where("n > 1").withColumn("weights", F.array(F.lit(1.0), F.lit(1.0)))
    return captions.with_merging(caption_rows(spark, d), i).select("pos", "merging", "room")


@query("SELECT listing_id || '-' || photo_id AS key FROM captions UNION ALL SELECT listing_id || '-' || photo_id FROM images")
def captions_union_keys(spark, d):
    return captions.caption_keys(table(spark, d, "captions"), table(spark, d, "images"))


@query("SELECT photo_id, arg_max_null(caption, item_id) AS caption FROM captions WHERE photo_id IS NOT NULL GROUP BY 1")
def last_caption(spark, d):
    return captions.last_value(caption_rows(spark, d), "photo_id", "caption", "pos")


@query("SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey")
def strict_lookup(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return captions.strict_lookup(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), parts, "l_partkey").select("l_orderkey", "l_linenumber", "p_name")


@query("SELECT item_id AS pos FROM captions c WHERE NOT EXISTS (SELECT 1 FROM images i WHERE i.photo_id = c.photo_id)")
def skip_done(spark, d):
    return captions.missing(caption_rows(spark, d), table(spark, d, "images"), "photo_id").select("pos")


_NO = "(SELECT item_id AS pos, row_number() OVER (ORDER BY item_id) - 1 AS n, count(*) OVER () AS t FROM captions)"


@query(f"SELECT pos, n % 7 AS stride FROM {_NO}")
def stride_split(spark, d):
    return captions.strided(captions.row_numbers(caption_rows(spark, d), "pos"), 7).select("pos", "stride")


@query(f"SELECT pos, (n - 3) // CAST(ceil((t - 3) / 7.0) AS BIGINT) AS part FROM {_NO} WHERE n >= 3")
def range_split(spark, d):
    return captions.ranged(captions.row_numbers(caption_rows(spark, d), "pos"), 7, 3).select("pos", "part")


@query(f"SELECT pos, CASE WHEN n >= t - CAST(round_even(t * 0.05, 0) AS BIGINT) THEN 'test' ELSE 'train' END AS split FROM {_NO}")
def tail_split(spark, d):
    return captions.tail_split(captions.row_numbers(caption_rows(spark, d), "pos")).select("pos", "split")


@query("SELECT item_id AS pos, sha1(concat_ws('|', '1', item_id)) AS h, CAST(row_number() OVER (ORDER BY sha1(concat_ws('|', '1', item_id))) AS BIGINT) AS place FROM captions ORDER BY place LIMIT 100")
def seeded_top(spark, d):
    """The first hundred of a seeded shuffle: a top-k, not a sample of the work."""
    ranked = caption_rows(spark, d).select("pos", T.hash_rank_key(1, F.col("pos")).alias("h")).orderBy("h", "pos").limit(100)
    return ranked.withColumn("place", F.row_number().over(Window.orderBy("h", "pos")).cast("long"))


# Names, places, lists ---------------------------------------------------------------------------------

@query("SELECT DISTINCT lower(replace(replace(location, ' ', '-'), ',', '')) AS slug FROM images WHERE location IS NOT NULL UNION SELECT DISTINCT lower(replace(replace(location, ' ', '-'), ',', '')) FROM listings WHERE location IS NOT NULL")
def distinct_locations(spark, d):
    both = table(spark, d, "images").select("location").union(table(spark, d, "listings").select("location")).where("location is not null")
    return both.select(T.location_slug(F.col("location")).alias("slug")).distinct()


@query("SELECT n_name, c_custkey // 100000 AS part, list(DISTINCT c_custkey ORDER BY c_custkey) AS \"values\" FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(n_name, 'NATION_1') GROUP BY ALL")
def country_listing_lists(spark, d):
    n = crawl.in_country(table(spark, d, "nation"), "n_name", "NATION_1")
    joined = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return captions.value_lists(joined, "n_name", "c_custkey")


@query("SELECT DISTINCT location, sha1(location) AS slug FROM images WHERE location IS NOT NULL")
def slug_hash(spark, d):
    return table(spark, d, "images").where("location is not null").select("location").distinct().withColumn("slug", T.slug(F.col("location")))


@query("SELECT DISTINCT replace(regexp_replace(split_part(line, ',', 1), '[''/\"]', '', 'g'), '-', ' ') || ' ' || regexp_replace(split_part(line, ',', 2), '[''/\"]', '', 'g') || ' Land' AS place FROM (SELECT location || ',x' AS line FROM listings WHERE location IS NOT NULL)")
def place_lines(spark, d):
    lines = table(spark, d, "listings").where("location is not null").select(F.concat("location", F.lit(",x")).alias("line"))
    return lines.select(T.place_line(F.col("line"), 1, 2, suffix=" Land").alias("place")).distinct()


@query("SELECT location, listing_id FROM listings l WHERE NOT EXISTS (SELECT 1 FROM images i WHERE i.listing_id = l.listing_id) AND NOT EXISTS (SELECT 1 FROM room_pages p WHERE p.listing_id = l.listing_id) GROUP BY ALL")
def crawl_todo(spark, d):
    found = table(spark, d, "listings").where("listing_id is not null")
    left = crawl.todo(found, table(spark, d, "images").where("listing_id is not null"), table(spark, d, "room_pages").where("listing_id is not null"), "listing_id")
    return found.join(left, "listing_id", "left_semi").select("location", "listing_id").distinct()


@query("""WITH l AS (SELECT DISTINCT listing_id, location FROM listings), p AS (SELECT listing_id, max(CASE WHEN trim(body) <> '' AND json_valid(body) THEN 3 WHEN trim(body) <> '' THEN 2 ELSE 1 END) AS s FROM room_pages WHERE listing_id IS NOT NULL GROUP BY 1)
SELECT 'missing images' AS reason, location, listing_id FROM l WHERE listing_id NOT IN (SELECT listing_id FROM images WHERE listing_id IS NOT NULL)
UNION ALL SELECT CASE coalesce(s, 0) WHEN 0 THEN 'missing document' WHEN 1 THEN 'empty document' ELSE 'corrupt document' END, location, l.listing_id FROM l LEFT JOIN p ON p.listing_id = l.listing_id WHERE coalesce(s, 0) < 3""")
def missing_audit(spark, d):
    listings = table(spark, d, "listings").select("listing_id", "location").distinct()
    return audit.listing_report(listings, table(spark, d, "room_pages").select("listing_id", "body"), table(spark, d, "images").where("listing_id is not null"))


@query("SELECT 'missing image' AS reason, listing_id, photo_id FROM captions c WHERE NOT EXISTS (SELECT 1 FROM images i WHERE i.photo_id = c.photo_id AND i.photo_id > 0)")
def missing_image_audit(spark, d):
    return audit.missing_images(table(spark, d, "captions"), table(spark, d, "images").where("photo_id > 0"))


@query("SELECT photo_id, listing_id, state FROM images i WHERE photo_id IN (SELECT photo_id FROM captions)")
def existing_images(spark, d):
    return documents.existing_images(table(spark, d, "images"), table(spark, d, "captions")).select("photo_id", "listing_id", "state")


# Detections ---------------------------------------------------------------------------------------

@query(f"""WITH s AS (SELECT user_id AS photo_id, {_SCENE_SQL} AS room, value FROM events), t AS (SELECT photo_id, room, sum(value) AS score FROM s WHERE room IS NOT NULL GROUP BY ALL),
b AS (SELECT photo_id, arg_max(room, round(score, 6)) AS room, max(score) AS score FROM t GROUP BY 1) SELECT p.photo_id, coalesce(room, 'alcove') AS room, round(coalesce(score, 0.0), 6) AS score FROM (SELECT DISTINCT user_id AS photo_id FROM events) p LEFT JOIN b USING (photo_id)""")
def room_scores(spark, d):
    votes = detections.room_votes(fine_scores(spark, d), hierarchy(spark), ["photo_id"])
    return votes.withColumn("score", F.round("score", 6))


@query("""WITH r AS (SELECT user_id AS photo_id, CASE WHEN event_type IN ('error', 'view') THEN 1 ELSE 0 END AS outdoor, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, CASE event_type WHEN 'view' THEN 'kitchen' WHEN 'click' THEN 'bedroom' WHEN 'purchase' THEN 'shower' WHEN 'signup' THEN 'bow_window/indoor' ELSE 'parking_lot' END DESC) AS n FROM events)
SELECT photo_id, round(avg(outdoor), 6) AS mean, avg(outdoor) < 0.5 AS indoor FROM r WHERE n <= 10 GROUP BY 1""")
def indoor_vote(spark, d):
    return detections.indoor_votes(fine_scores(spark, d), ["photo_id"]).withColumn("mean", F.round("mean", 6))


@query("""WITH e AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT vec_id, i, exp(x - max(x) OVER (PARTITION BY vec_id)) AS y FROM e),
s AS (SELECT vec_id, i, y / sum(y) OVER (PARTITION BY vec_id) AS p FROM m), r AS (SELECT vec_id, i, p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i DESC) AS n FROM s)
SELECT vec_id, n AS place, CAST(i AS INT) AS class, round(p, 6) AS prob FROM r WHERE n <= 5""")
def softmax_top5(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", A.softmax(F.transform("embedding", lambda x: x.cast("double"))).alias("p"))
    top = F.slice(F.sort_array(F.transform("p", lambda x, i: F.struct(x.alias("prob"), i.alias("class"))), asc=False), 1, 5)
    return e.select("vec_id", F.posexplode(top).alias("place", "t")).select("vec_id", (F.col("place") + 1).cast("long").alias("place"), F.col("t.class").cast("int").alias("class"), F.round("t.prob", 6).alias("prob"))


_ROOMS = """ph AS (SELECT user_id AS listing_id, event_id AS photo_id, CASE event_type WHEN 'view' THEN 'kitchen' WHEN 'click' THEN 'bedroom' WHEN 'purchase' THEN 'bathroom' WHEN 'signup' THEN 'living_room' ELSE 'office' END AS room, event_id % 3 = 0 AS captioned FROM events),
fit AS (SELECT * FROM ph WHERE listing_id IN (SELECT listing_id FROM ph GROUP BY 1 HAVING count(*) >= 4 AND count(*) FILTER (WHERE captioned) >= 2)),
grp AS (SELECT *, CASE WHEN room IN ('bedroom', 'living_room', 'bathroom', 'kitchen') THEN room ELSE room || '#' || photo_id END AS room_group FROM fit)"""


@query(f"WITH {_ROOMS} SELECT listing_id, room_group, count(*) AS n, count(*) FILTER (WHERE captioned) AS n_captioned FROM grp GROUP BY ALL")
def room_groups(spark, d):
    g = merging.grouped(merging.fit_detections(room_photos(spark, d)))
    return g.groupBy("listing_id", "room_group").agg(F.count("*").alias("n"), F.count_if("captioned").alias("n_captioned"))


@query(f"""WITH {_ROOMS}, w AS (SELECT *, count(*) OVER g AS n, count(*) FILTER (WHERE captioned) OVER g AS c, row_number() OVER (g ORDER BY photo_id) - 1 AS i, count(*) FILTER (WHERE captioned) OVER (g ORDER BY photo_id) - 1 AS k FROM grp WINDOW g AS (PARTITION BY listing_id, room_group)),
m AS (SELECT *, greatest(1, least(CAST(ceil(n / 10.0) AS BIGINT), c)) AS m FROM w) SELECT listing_id, photo_id, room_group, CAST(CASE WHEN n <= 10 THEN 0 WHEN captioned AND k < m THEN k ELSE i % m END AS INT) AS chunk FROM m""")
def room_groups_chunked(spark, d):
    return merging.chunked(merging.grouped(merging.fit_detections(room_photos(spark, d)))).select("listing_id", "photo_id", "room_group", "chunk")


_CHUNKED = f"""{_ROOMS}, w AS (SELECT *, count(*) OVER g AS n, count(*) FILTER (WHERE captioned) OVER g AS c, row_number() OVER (g ORDER BY photo_id) - 1 AS i, count(*) FILTER (WHERE captioned) OVER (g ORDER BY photo_id) - 1 AS k FROM grp WINDOW g AS (PARTITION BY listing_id, room_group)),
chk AS (SELECT listing_id, photo_id, room_group, captioned, CAST(CASE WHEN n <= 10 THEN 0 WHEN captioned AND k < m THEN k ELSE i % m END AS INT) AS chunk FROM (SELECT *, greatest(1, least(CAST(ceil(n / 10.0) AS BIGINT), c)) AS m FROM w))"""
_BALANCED = f"""{_CHUNKED}, ph2 AS (SELECT *, sha1(concat_ws('|', '1', photo_id)) AS h, sha1(concat_ws('|', '1', room_group, chunk)) AS gh FROM chk),
kept AS (SELECT *, row_number() OVER (PARTITION BY listing_id, room_group, chunk ORDER BY captioned DESC, h, photo_id) AS kr FROM ph2),
lst AS (SELECT listing_id, count(*) FILTER (WHERE kr = 1) AS groups, count(*) FILTER (WHERE kr = 1 AND captioned) AS rich FROM kept GROUP BY 1),
one AS (SELECT listing_id, photo_id FROM (SELECT kept.*, row_number() OVER (PARTITION BY listing_id ORDER BY gh, room_group, chunk, h, photo_id) AS r, rich FROM kept JOIN lst USING (listing_id) WHERE captioned AND kr > 1) WHERE r <= 12 - rich),
two AS (SELECT listing_id, photo_id FROM (SELECT kept.*, groups, row_number() OVER (PARTITION BY listing_id ORDER BY gh, room_group, chunk, captioned, h, photo_id) AS r, coalesce(t, 0) AS t FROM kept JOIN lst USING (listing_id) LEFT JOIN (SELECT listing_id, count(*) AS t FROM one GROUP BY 1) USING (listing_id) WHERE kr > 1 AND photo_id NOT IN (SELECT photo_id FROM one)) WHERE r <= 30 - groups - t),
bal AS (SELECT listing_id, photo_id, room_group, chunk, CASE WHEN photo_id IN (SELECT photo_id FROM one UNION ALL SELECT photo_id FROM two) THEN photo_id ELSE 0 END AS part FROM chk)"""


def balanced_photos(spark: SparkSession, d: str) -> DataFrame:
    chunks = merging.chunked(merging.grouped(merging.fit_detections(room_photos(spark, d))))
    return merging.balanced(chunks, min_captioned=12, min_length=30)


@query(f"WITH {_BALANCED} SELECT * FROM bal")
def room_groups_balanced(spark, d):
    return balanced_photos(spark, d).select("listing_id", "photo_id", "room_group", "chunk", "part")


@query(f"WITH {_BALANCED} SELECT listing_id, room_group, chunk, part, 0 AS block, count(*) AS n, list(photo_id ORDER BY photo_id) AS members FROM bal GROUP BY ALL")
def room_groups_merged(spark, d):
    return merging.merged_groups(balanced_photos(spark, d))


@query(f"WITH {_BALANCED} SELECT a.photo_id, [a.photo_id] || coalesce(list(b.photo_id ORDER BY b.photo_id) FILTER (WHERE b.photo_id <> a.photo_id), []) AS merging FROM bal a JOIN bal b USING (listing_id, room_group, chunk, part) GROUP BY 1")
def room_merging_items(spark, d):
    return merging.merged_photos(balanced_photos(spark, d)).select("photo_id", "merging")


# Documents -----------------------------------------------------------------------------------------

_PAGES = """g AS (SELECT page_id, body::JSON AS b FROM room_pages WHERE body IS NOT NULL AND json_valid(body)), a AS (SELECT page_id, b->'data'->'merlin'->'pdpSections' AS s FROM g),
s AS (SELECT page_id, i, s->(i::BIGINT) AS x FROM (SELECT page_id, s, unnest(range(json_array_length(s)::BIGINT)) AS i FROM a WHERE json_type(s) = 'ARRAY')), """


@query(f"""WITH {_PAGES} v AS (SELECT page_id, i, x->>'$.sectionId' AS k, CASE WHEN json_type(x->'$.section.sharingConfig.title') = 'VARCHAR' THEN x->>'$.section.sharingConfig.title' END AS title, TRY_CAST(x->>'$.section.sharingConfig.personCapacity' AS INT) AS cap, CASE WHEN json_type(x->'$.section.previewLocationDetails.title') = 'VARCHAR' THEN x->>'$.section.previewLocationDetails.title' END AS loc FROM s)
SELECT page_id, max_by(title, i) FILTER (WHERE k = 'NAV_MOBILE' AND title IS NOT NULL) AS title, max_by(cap, i) FILTER (WHERE k = 'NAV_MOBILE' AND cap IS NOT NULL) AS person_capacity, max_by(loc, i) FILTER (WHERE k = 'LOCATION_DEFAULT' AND loc IS NOT NULL) AS location FROM v GROUP BY 1""")
def section_pivot(spark, d):
    return documents.room_records(table(spark, d, "room_pages")).select("page_id", "title", "person_capacity", "location")


@query(f"WITH {_PAGES} k AS (SELECT DISTINCT page_id, x->>'$.sectionId' AS section_id FROM s) SELECT section_id, count(*) AS pages FROM k GROUP BY 1")
def section_kinds(spark, d):
    pages = table(spark, d, "room_pages").select("page_id", F.try_parse_json("body").alias("v"))
    kinds = documents.exploded(pages, "v", "$.data.merlin.pdpSections", ["page_id"]).select("page_id", documents.get(F.col("item"), "$.sectionId", "string").alias("section_id"))
    return kinds.distinct().groupBy("section_id").agg(F.count("*").alias("pages"))


@query(f"WITH {_PAGES} f AS (SELECT page_id, min(i) AS i FROM s WHERE x->>'$.sectionId' = 'AMENITIES_DEFAULT' GROUP BY 1) SELECT page_id, i AS pos FROM f")
def first_section(spark, d):
    pages = table(spark, d, "room_pages").select("page_id", F.try_parse_json("body").alias("v"))
    rows = documents.exploded(pages, "v", "$.data.merlin.pdpSections", ["page_id"]).where(documents.get(F.col("item"), "$.sectionId", "string") == "AMENITIES_DEFAULT")
    return rows.groupBy("page_id").agg(F.min("pos").cast("long").alias("pos"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(spark, d):
    return table(spark, d, "events").select("event_id", documents.get(F.try_parse_json("props"), "$.k", "long").alias("k"))


@query("""WITH g AS (SELECT DISTINCT listing_id, k.key AS title, k.value AS items FROM listings, unnest(map_entries(amenities)) AS u(k) WHERE listing_id IS NOT NULL)
SELECT listing_id, title, unnest(items).title AS amenity FROM g""")
def amenities_exploded(spark, d):
    return documents.amenities(table(spark, d, "listings")).select("listing_id", "title", "amenity")


@query("SELECT listing_id, review_id, comment, created_at, lower(split_part(trim(language), '-', 1)) AS language, is_superhost FROM reviews QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY loaded_at DESC NULLS LAST, listing_id) = 1")
def review_records(spark, d):
    return documents.latest_reviews(table(spark, d, "reviews"))


# Phrases and perturbations --------------------------------------------------------------------------

@query("SELECT DISTINCT trim(replace(regexp_replace(regexp_replace(p, '[;?0-9]', '', 'g'), '\\((.*?)\\)', '\\1', 'g'), '  ', ' ')) AS name FROM (SELECT unnest(string_split(replace(p_name || '/' || p_type || ' (' || p_brand || ')', '\\', '/'), '/')) AS p FROM part) WHERE length(name) >= 3")
def np_vocabulary(spark, d):
    raw = F.concat("p_name", F.lit("/"), "p_type", F.lit(" ("), "p_brand", F.lit(")"))
    return table(spark, d, "part").select(F.explode(T.raw_categories(raw)).alias("name")).distinct()


_KNOWN, _FORBID = ["ring", "widget", "bolt"], ["red"]


@query("""WITH p AS (SELECT p_partkey, unnest([p_name, p_type, lower(p_brand)]) AS n FROM part), a AS (SELECT *, contains(n, 'ring') OR contains(n, 'widget') OR contains(n, 'bolt') AS k FROM p WHERE NOT contains(n, 'red')),
w AS (SELECT p_partkey, n, row_number() OVER (PARTITION BY p_partkey ORDER BY k DESC, sha1(concat_ws('|', '0', p_partkey, n)), n) AS r FROM a)
SELECT part.p_partkey, coalesce(n, '') AS phrase FROM part LEFT JOIN w ON w.p_partkey = part.p_partkey AND r = 1""")
def np_best(spark, d):
    names = F.array("p_name", "p_type", F.lower("p_brand"))
    return table(spark, d, "part").select("p_partkey", phrases.best(names, F.array(*[F.lit(w) for w in _KNOWN]), _FORBID, 0, F.col("p_partkey")).alias("phrase"))


@query("SELECT p_partkey FROM part WHERE NOT contains(p_name, 'turn') AND NOT contains(p_name, 'in')")
def forbidden_filter(spark, d):
    return table(spark, d, "part").where(T.lacks_all(F.col("p_name"), ["turn", "in"])).select("p_partkey")


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_\\s\\p{Z}]')) BETWEEN 2 AND 60 AS fits FROM documents WHERE text IS NOT NULL")
def token_bounds(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.token_count_between(F.col("text"), 2, 60).alias("fits"))


@query("SELECT p_partkey, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) AS switched FROM part WHERE split_part(p_name, ' ', 1) <> split_part(p_name, ' ', 2)")
def switch_pairs(spark, d):
    pairs = table(spark, d, "part").select("p_partkey", F.explode(A.pairs_of(F.split("p_name", " "))).alias("x"))
    return pairs.where("x.first <> x.second").select("p_partkey", F.concat_ws(" ", "x.second", "x.first").alias("switched"))


_M = "[^\\p{L}\\p{M}\\p{N}_]"


@query(f"SELECT item_id AS pos, CASE WHEN regexp_matches(regexp_replace(c, '^{_M}+|{_M}+$', '', 'g'), '[\\n\\r]') OR NOT regexp_matches(c, '[\\p{{L}}\\p{{M}}\\p{{N}}_]') THEN c ELSE right(regexp_extract(c, '^{_M}*'), 1) || '[MASK]' || right(regexp_extract(c, '{_M}*$'), 1) END AS masked FROM (SELECT item_id, coalesce(caption, '') AS c FROM captions)")
def mask_tokens(spark, d):
    return caption_rows(spark, d).select("pos", T.masked(F.coalesce("caption", F.lit(""))).alias("masked"))


# Boxes and features ---------------------------------------------------------------------------------

@query("""SELECT a.label, a.vec_id AS i, b.vec_id AS j, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS distance FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id > b.vec_id""")
def cosine_pairs(spark, d):
    # each vector is scaled once, so a pair costs one product
    e = table(spark, d, "embeddings").select("label", "vec_id", A.unit(F.col("embedding")).alias("u"))
    a, b = e.select("label", F.col("vec_id").alias("i"), F.col("u").alias("x")), e.select("label", F.col("vec_id").alias("j"), F.col("u").alias("y"))
    return a.join(b, "label").where("i > j").select("label", "i", "j", F.round(1 - A.dot(F.col("x"), F.col("y")), 4).alias("distance"))


_FOCAL = V.focal_length(480, 60)


@query(f"""WITH h AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_discount * 20 + atan2(l_quantity * 10 - 320, {_FOCAL!r}) AS a, l_tax + atan2(240 - l_quantity * 5, {_FOCAL!r}) AS e FROM lineitem),
m AS (SELECT *, a - 2 * pi() * floor(a / (2 * pi())) AS t FROM h) SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice, round(CASE WHEN t > pi() THEN t - 2 * pi() ELSE t END, 6) AS heading, round(e, 6) AS elevation FROM m""")
def heading_wrap(spark, d):
    heading = V.box_heading(F.col("l_discount") * 20, F.col("l_quantity") * 10, F.lit(640), _FOCAL)
    elevation = V.box_elevation(F.col("l_tax"), F.col("l_quantity") * 5, F.lit(480), _FOCAL)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", F.round(heading, 6).alias("heading"), F.round(elevation, 6).alias("elevation"))


_REACH = _FOCAL * math.tan(math.radians(20))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, abs(l_quantity * 10 - 320) > {_REACH!r} OR (l_suppkey % 36 >= 12 AND l_quantity * 8 > 240 + {_REACH!r}) OR (l_suppkey % 36 < 24 AND l_quantity * 8 < 240 - {_REACH!r}) AS rejected FROM lineitem""")
def box_reject(spark, d):
    rejected = V.off_centre(F.col("l_quantity") * 10, F.col("l_quantity") * 8, F.lit(640), F.lit(480), F.col("l_suppkey") % 36, _FOCAL)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", rejected.alias("rejected"))


@query("""WITH b AS (SELECT l_orderkey AS image, l_partkey * 10 + l_linenumber AS box, l_extendedprice AS confidence FROM lineitem), w AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY confidence DESC, box) AS r, count(*) FILTER (WHERE confidence >= 60000) OVER (PARTITION BY image) AS g FROM b)
SELECT image, box, confidence FROM w WHERE r <= least(greatest(g, 2), 4)""")
def box_topk(spark, d):
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("box"), F.col("l_extendedprice").alias("confidence"))
    return boxes.select_boxes(b, "image", "confidence", 60000.0, least=2, most=4)


@query("""WITH b AS (SELECT l_orderkey AS image, l_linenumber AS class, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL) SELECT image, max(score) AS confidence FROM b WHERE class > 0 GROUP BY 1""")
def class_max(spark, d):
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("class"), F.col("l_extendedprice").alias("score"))
    return boxes.class_maximum(b, ["image"])


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS class, list_max(embedding[2:]) AS best FROM embeddings")
def class_argmax(spark, d):
    return table(spark, d, "embeddings").select("vec_id", A.argmax(F.col("embedding")).alias("class"), A.best_class(F.col("embedding")).alias("best"))


@query("SELECT p_partkey, round(CASE WHEN round_even(800.0 / least(w, h) * greatest(w, h), 0) > 1333 THEN 1333.0 / greatest(w, h) ELSE 800.0 / least(w, h) END, 9) AS factor FROM (SELECT p_partkey, (100 + p_size * 20)::DOUBLE AS w, (100 + p_partkey % 900)::DOUBLE AS h FROM part)")
def scale_factors(spark, d):
    w, h = (100 + F.col("p_size") * 20).cast("double"), (100 + F.col("p_partkey") % 900).cast("double")
    return table(spark, d, "part").select("p_partkey", F.round(V.scale_factor(w, h), 9).alias("factor"))


_IOU = "(greatest(0, least(k.x2, b.x2) - greatest(k.x1, b.x1) + 1) * greatest(0, least(k.y2, b.y2) - greatest(k.y1, b.y1) + 1))"
_AREA = "({0}.x2 - {0}.x1 + 1) * ({0}.y2 - {0}.y1 + 1)"
_BOXES = """b AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY confidence DESC, box) AS n FROM (SELECT l_orderkey AS image, l_partkey * 10 + l_linenumber AS box, l_linenumber AS class, l_extendedprice AS confidence,
(l_quantity * 10)::DOUBLE AS x1, (l_discount * 1000)::DOUBLE AS y1, (l_quantity * 10 + 200)::DOUBLE AS x2, (l_discount * 1000 + 80)::DOUBLE AS y2 FROM lineitem))"""
_KEPT = f"""{_BOXES}, r AS (SELECT image, n, [b] AS kept FROM b WHERE n = 1
UNION ALL SELECT r.image, b.n, CASE WHEN len(list_filter(kept, lambda k: {_IOU} / ({_AREA.format("k")} + {_AREA.format("b")} - {_IOU}) > 0.3)) = 0 THEN kept || [b] ELSE kept END FROM r JOIN b ON b.image = r.image AND b.n = r.n + 1),
k AS (SELECT unnest(arg_max(kept, n)) AS x FROM r GROUP BY image)"""


def detected_boxes(spark: SparkSession, d: str) -> DataFrame:
    x, y = (F.col("l_quantity") * 10).cast("double"), (F.col("l_discount") * 1000).cast("double")
    key = (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("box")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), key, F.col("l_linenumber").alias("class"), F.col("l_extendedprice").alias("confidence"), x.alias("x1"), y.alias("y1"), (x + 200).alias("x2"), (y + 80).alias("y2"))


@query(f"WITH RECURSIVE {_KEPT} SELECT x.image, x.box, x.confidence FROM k")
def box_suppressed(spark, d):
    return boxes.non_maximum(detected_boxes(spark, d), 0.3).select("image", "box", "confidence")


@query(f"WITH RECURSIVE {_KEPT} SELECT x.image AS image, max(x.confidence) AS confidence FROM k WHERE x.class > 1 GROUP BY 1")
def box_maximum_after_suppression(spark, d):
    """The greatest score of the boxes that survive, the first class being the background."""
    kept = boxes.non_maximum(detected_boxes(spark, d), 0.3).withColumn("class", F.col("class") - 1)
    return boxes.class_maximum(kept.withColumn("score", F.col("confidence")), ["image"])


@query("""WITH w AS (SELECT l_orderkey AS image, l_partkey * 10 + l_linenumber AS box, l_extendedprice AS confidence FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY confidence DESC, box) AS n FROM w)
SELECT image, box, confidence, count(*) FILTER (WHERE confidence <> 0) OVER (PARTITION BY image) AS num_boxes FROM r WHERE n <= 3""")
def box_top_numbers(spark, d):
    return boxes.top_boxes(detected_boxes(spark, d), "image", "confidence", 3).select("image", "box", "confidence", "num_boxes")


@query("""WITH RECURSIVE e AS (SELECT label AS image, vec_id AS box, embedding::DOUBLE[] AS f, vec_id % 7 / 2.0 AS h, vec_id % 3 / 4.0 AS el, embedding[1]::DOUBLE AS best, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n, count(*) OVER (PARTITION BY label) AS t FROM embeddings),
p AS (SELECT a.image, a.t, a.n AS i, b.n AS j, a.best AS bi, b.best AS bj, row_number() OVER (PARTITION BY a.image ORDER BY 1 - list_cosine_similarity(a.f, b.f) + least(abs(a.h - b.h), 2 * pi() - abs(a.h - b.h)) + abs(a.el - b.el), a.n, b.n) AS k FROM e a JOIN e b ON a.image = b.image AND b.n < a.n),
r AS (SELECT image, 0 AS k, [0]::BIGINT[] AS dead, any_value(t) AS alive FROM e GROUP BY image
UNION ALL SELECT r.image, p.k, CASE WHEN hit THEN dead || [CASE WHEN bi > bj THEN j ELSE i END] ELSE dead END, alive - CASE WHEN hit THEN 1 ELSE 0 END FROM (SELECT r.*, p.* EXCLUDE (image, k), p.k AS pk, NOT list_contains(dead, i) AND NOT list_contains(dead, j) AS hit FROM r JOIN p ON p.image = r.image AND p.k = r.k + 1 WHERE r.alive > 20) AS r(image, k, dead, alive, t, i, j, bi, bj, pk, hit), (SELECT 1) AS one, LATERAL (SELECT pk AS k) AS p),
d AS (SELECT image, arg_max(dead, k) AS dead FROM r GROUP BY image)
SELECT e.image, e.box FROM e JOIN d USING (image) WHERE NOT list_contains(dead, n)""")
def redundancy_filter(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("image"), F.col("vec_id").alias("box"), F.transform("embedding", lambda v: v.cast("double")).alias("feature"), (F.col("vec_id") % 7 / 2.0).alias("heading"), (F.col("vec_id") % 3 / 4.0).alias("elevation"), F.col("embedding")[0].cast("double").alias("best"))
    return boxes.without_redundant(e, most=20).select("image", "box")


@query("SELECT vec_id, embedding[1:8] AS head, [CASE WHEN i <= len(embedding) // 16 THEN 1 ELSE 0 END FOR i IN range(1, 9)] AS mask FROM embeddings")
def padded_matrix(spark, d):
    rows = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 16).cast("int") - 1), lambda i: F.slice("embedding", i * 16 + 1, 16))
    p = table(spark, d, "embeddings").select("vec_id", A.padded(F.transform(rows, lambda r: F.transform(r, lambda x: x.cast("double"))), 8, 16).alias("p"))
    return p.select("vec_id", F.transform(F.slice(F.col("p.rows")[0], 1, 8), lambda x: x.cast("float")).alias("head"), F.col("p.mask").alias("mask"))


# Trajectories, crawl -------------------------------------------------------------------------------

_TRAJ = """WITH r AS (SELECT listing_id, photo_id, min(caption) AS caption FROM images WHERE listing_id IS NOT NULL AND photo_id IS NOT NULL GROUP BY ALL), c AS (SELECT *, NOT (%s) AS k, sha1(concat_ws('|', '0', photo_id)) AS h FROM r),
w AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY k DESC, h, photo_id) AS n FROM c), t AS (SELECT * FROM w WHERE n <= 7)
SELECT listing_id, list(photo_id ORDER BY h, photo_id) AS photos, list(photo_id ORDER BY h, photo_id) FILTER (WHERE k) AS captioned FROM t GROUP BY 1 HAVING count(*) >= 4 AND count(*) FILTER (WHERE k) >= 2""" % P2


@query(_TRAJ)
def trajectories_positive(spark, d):
    return trajectories.positives(table(spark, d, "images"))


_SLOT = f"(({hash_order_sql('listing_id', seed=trajectories.SLOT_SEED)}) // 8) % greatest(1, (SELECT count(*) FROM pos) // 1000)"
_TURN = "list_transform([1, 2], lambda k: list_concat({0}[k % len({0}) + 1:], {0}[1:k % len({0})]))"


@query(f"""WITH pos AS ({_TRAJ}), line AS (SELECT *, {_SLOT} AS slot, sha1(listing_id::VARCHAR) AS lh FROM pos),
nxt AS (SELECT *, count(*) OVER (PARTITION BY slot) AS t, row_number() OVER (PARTITION BY slot ORDER BY lh, listing_id) - 1 AS n FROM line)
SELECT a.listing_id, a.photos AS positive, {_TURN.format("a.captioned")} AS neg_captions, {_TURN.format("a.photos")} AS neg_images, list_filter([b.photos, c.photos], lambda x: x IS NOT NULL AND x <> a.photos) AS neg_randoms
FROM nxt a LEFT JOIN nxt b ON b.slot = a.slot AND b.n = (a.n + 1) % a.t AND a.t > 1 LEFT JOIN nxt c ON c.slot = a.slot AND c.n = (a.n + 2) % a.t AND a.t > 2""")
def trajectories_fixed(spark, d):
    return trajectories.fixed_samples(table(spark, d, "images"))


@query("SELECT n_name AS name, unnest(range(50, t, 50)) AS \"offset\" FROM (SELECT n_name, count(*) AS t FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)")
def page_offsets(spark, d):
    n = table(spark, d, "nation")
    totals = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("name")).agg(F.count("*").alias("total"))
    return crawl.page_offsets(totals, "name", "total")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS a, (n_nationkey * 3 + n_regionkey) % 25 AS b FROM nation), r(node, depth) AS (SELECT 1, 0 UNION SELECT b, depth + 1 FROM r JOIN e ON a = node WHERE depth < 25)
SELECT CAST(node AS BIGINT) AS node, CAST(min(depth) AS INT) AS depth FROM r GROUP BY 1""")
def closure(spark, d):
    e = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("a"), ((F.col("n_nationkey") * 3 + F.col("n_regionkey")) % 25).cast("long").alias("b"))
    return crawl.closure(e, spark.createDataFrame([(1,)], "node long"))


@query("SELECT l_orderkey, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS path, list_concat(list(l_suppkey ORDER BY l_linenumber, l_suppkey)[2:], list(l_suppkey ORDER BY l_linenumber, l_suppkey)[-1:]) AS next FROM lineitem GROUP BY 1")
def next_headings(spark, d):
    """Sorted lists of each order, which hold at most seven lines, and the value after each one."""
    line = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"])
    paths = table(spark, d, "lineitem").groupBy("l_orderkey").agg(line.alias("path"))
    return paths.withColumn("next", captions.next_of(F.col("path")))


@query("SELECT label, list_sort(list(vec_id) FILTER (WHERE vec_id % 3 <> 0)) AS kept FROM embeddings GROUP BY 1")
def index_difference(spark, d):
    g = table(spark, d, "embeddings").groupBy("label").agg(F.collect_list("vec_id").alias("every"), F.collect_list(F.when(F.col("vec_id") % 3 == 0, F.col("vec_id"))).alias("rejected"))
    return g.select("label", A.index_difference(F.col("every"), F.col("rejected")).alias("kept"))
