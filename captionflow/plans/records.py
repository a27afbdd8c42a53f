"""Queries on points, regions and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionflow.operators import nested, spatial
from captionflow.tables import table

RADIUS_M = 150.0
PAGE_ROOT = ("data", "merlin", "pdpSections")
PAGE_SHAPES = {
    "AMENITIES_DEFAULT": {"seeAllAmenitiesGroups": {"amenities": {"options": {}}}},
    "SLEEPING_ARRANGEMENT_DEFAULT": {"arrangementDetails": {"beds": {}}},
}
PAGE_TABLES = {
    "group": "AMENITIES_DEFAULT/seeAllAmenitiesGroups",
    "amenity": "AMENITIES_DEFAULT/seeAllAmenitiesGroups/amenities",
    "option": "AMENITIES_DEFAULT/seeAllAmenitiesGroups/amenities/options",
    "room": "SLEEPING_ARRANGEMENT_DEFAULT/arrangementDetails",
    "bed": "SLEEPING_ARRANGEMENT_DEFAULT/arrangementDetails/beds",
}
#: The columns of each full table: the field that each holds, and its type.
PAGE_FIELDS = {
    "group": {"typename": ("__typename", "string")},
    "amenity": {"subtitle": ("subtitle", "string"), "available": ("available", "boolean")},
    "option": {},
    "room": {"subtitle": ("subtitle", "string")},
    "bed": {"kind": ("kind", "string"), "count": ("count", "long")},
}
PLURALS = {"group": "groups", "amenity": "amenities", "option": "options", "room": "rooms", "bed": "beds"}


def places(spark: SparkSession, d: str) -> DataFrame:
    return spatial.located(table(spark, d, "listings"), "listing_id")


def regions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "areas").select(F.col("area_id").alias("region"), "ring", "hole")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    points = places(spark, d)
    near = spatial.near_pairs(points, RADIUS_M).select(F.lit("near").alias("kind"), "id_a", "id_b")
    inside = spatial.in_regions(points, regions(spark, d)).select(F.lit("inside").alias("kind"), F.col("id").alias("id_a"), F.col("region").alias("id_b"))
    return near.unionByName(inside)


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Of each listing with a location: how many others lie within the radius, and how many areas hold it."""
    points = places(spark, d)
    pairs = spatial.near_pairs(points, RADIUS_M)
    ends = pairs.select(F.col("id_a").alias("id")).union(pairs.select(F.col("id_b").alias("id"))).groupBy("id").agg(F.count("*").alias("n_near"))
    held = spatial.in_regions(points, regions(spark, d)).groupBy("id").agg(F.count("*").alias("n_areas"))
    ids = points.select("id").distinct()
    return ids.join(ends, "id", "left").join(held, "id", "left").select(F.col("id").alias("listing_id"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("n_areas", F.lit(0)).alias("n_areas"))


def page_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nested.nodes(table(spark, d, "room_pages"), "page_id", "body", PAGE_ROOT, "sectionId", "section", PAGE_SHAPES)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    label = F.col("dewey")
    kind = F.coalesce(*[F.when(F.col("path") == path, F.lit(k)) for k, path in PAGE_TABLES.items()])
    place = lambda i: F.coalesce(F.get(label, F.lit(i)), F.lit(-1)).cast("long")
    return page_nodes(spark, d).select(F.col("key").alias("page_id"), kind.alias("kind"), place(0).alias("section_no"), place(1).alias("pos1"), place(2).alias("pos2"), place(3).alias("pos3")).distinct()


def p7_table(kind: str):
    """The keys and titles of one flat table; ``p7_full`` has all of its fields."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        return nested.table_of(page_nodes(spark, d), PAGE_TABLES[kind]).select("node_key", "parent_key", F.col("key").alias("page_id"), "title")

    return query


def p7_full(kind: str):
    """One flat table whole: key, parent key, title, a typed column for each known field, and all else as JSON in ``rest``."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        return nested.columns_of(nested.table_of(page_nodes(spark, d), PAGE_TABLES[kind]), PAGE_FIELDS[kind]).withColumnRenamed("key", "page_id")

    return query


QUERIES = {"p3_found": p3_found, "p3_neighbours": p3_neighbours, "p7_found": p7_found} | {f"p7_{k}s" if k != "amenity" else "p7_amenities": p7_table(k) for k in PAGE_TABLES}
QUERIES |= {f"p7_full_{PLURALS[k]}": p7_full(k) for k in PAGE_TABLES}

_POINTS = """pts AS (SELECT DISTINCT listing_id AS id, lat, lng FROM listings
  WHERE listing_id IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lng)
    AND lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AND NOT (lat = 0 AND lng = 0))"""
_NEAR = """near AS (SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM pts a JOIN pts b ON a.id < b.id AND abs(a.lat - b.lat) < 0.01
  WHERE 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
    + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))) <= 150)"""
_INSIDE = """rings AS (SELECT area_id, 1 AS sgn, ring AS pts FROM areas UNION ALL SELECT area_id, -1, hole FROM areas WHERE hole IS NOT NULL),
closed AS (SELECT area_id, sgn, CASE WHEN pts[1] = pts[-1] THEN pts ELSE list_append(pts, pts[1]) END AS p FROM rings),
raw AS (SELECT area_id, sgn, p[i].lat AS y1, p[i].lng AS x1, p[i + 1].lat AS y2, p[i + 1].lng AS x2
  FROM (SELECT area_id, sgn, p, unnest(range(1, len(p))) AS i FROM closed)),
turned AS (SELECT area_id, sgn, bool_or(abs(x1 - x2) > 180) AS t FROM raw GROUP BY 1, 2),
legs AS (SELECT area_id, sgn, t, y1, y2, CASE WHEN t AND x1 < 0 THEN x1 + 360 ELSE x1 END AS x1, CASE WHEN t AND x2 < 0 THEN x2 + 360 ELSE x2 END AS x2
  FROM raw JOIN turned USING (area_id, sgn)),
hits AS (SELECT id, area_id, sgn FROM pts JOIN legs ON (y1 > lat) <> (y2 > lat)
    AND CASE WHEN t AND lng < 0 THEN lng + 360 ELSE lng END < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
  GROUP BY ALL HAVING count(*) % 2 = 1),
inside AS (SELECT DISTINCT id, area_id FROM hits WHERE sgn = 1 EXCEPT SELECT id, area_id FROM hits WHERE sgn = -1)"""

ORACLE = {
    "p3_found": f"WITH {_POINTS}, {_NEAR}, {_INSIDE} SELECT 'near' AS kind, id_a, id_b FROM near UNION ALL SELECT 'inside', id, area_id FROM inside",
    "p3_neighbours": f"""WITH {_POINTS}, {_NEAR}, {_INSIDE},
ends AS (SELECT id, count(*) AS n FROM (SELECT id_a AS id FROM near UNION ALL SELECT id_b FROM near) GROUP BY 1),
held AS (SELECT id, count(*) AS n FROM inside GROUP BY 1)
SELECT p.id AS listing_id, coalesce(ends.n, 0) AS n_near, coalesce(held.n, 0) AS n_areas
FROM (SELECT DISTINCT id FROM pts) p LEFT JOIN ends ON ends.id = p.id LEFT JOIN held ON held.id = p.id""",
}


def _members(src: str, expr: str, keep: str, place: str) -> str:
    """Objects of an array, a lone object or a bare string, with their places."""
    return f"""SELECT {keep}, i AS {place}, j AS node FROM (
  SELECT {keep}, unnest(range(CASE json_type(v) WHEN 'ARRAY' THEN json_array_length(v) WHEN 'OBJECT' THEN 1 WHEN 'VARCHAR' THEN 1 ELSE 0 END::BIGINT)) AS i, v,
    CASE WHEN json_type(v) = 'ARRAY' THEN v->(i::BIGINT) ELSE v END AS j
  FROM (SELECT {keep}, {expr} AS v FROM {src})) WHERE json_type(j) IN ('OBJECT', 'VARCHAR')"""


ORACLE["p7_found"] = f"""WITH good AS (SELECT page_id, body::JSON AS b FROM room_pages WHERE page_id IS NOT NULL AND body IS NOT NULL AND json_valid(body)),
secs AS ({_members("good", "b->'data'->'merlin'->'pdpSections'", "page_id", "section_no")}),
am AS (SELECT page_id, section_no, node->'section' AS s FROM secs WHERE json_type(node) = 'OBJECT' AND node->>'sectionId' = 'AMENITIES_DEFAULT' AND json_type(node->'section') = 'OBJECT'),
sl AS (SELECT page_id, section_no, node->'section' AS s FROM secs WHERE json_type(node) = 'OBJECT' AND node->>'sectionId' = 'SLEEPING_ARRANGEMENT_DEFAULT' AND json_type(node->'section') = 'OBJECT'),
g AS ({_members("am", "s->'seeAllAmenitiesGroups'", "page_id, section_no", "pos1")}),
a AS ({_members("(SELECT * FROM g WHERE json_type(node) = 'OBJECT')", "node->'amenities'", "page_id, section_no, pos1", "pos2")}),
o AS ({_members("(SELECT * FROM a WHERE json_type(node) = 'OBJECT')", "node->'options'", "page_id, section_no, pos1, pos2", "pos3")}),
r AS ({_members("sl", "s->'arrangementDetails'", "page_id, section_no", "pos1")}),
b AS ({_members("(SELECT * FROM r WHERE json_type(node) = 'OBJECT')", "node->'beds'", "page_id, section_no, pos1", "pos2")})
SELECT DISTINCT page_id, 'group' AS kind, section_no, pos1, -1 AS pos2, -1 AS pos3 FROM g
UNION ALL SELECT DISTINCT page_id, 'amenity', section_no, pos1, pos2, -1 FROM a
UNION ALL SELECT DISTINCT page_id, 'option', section_no, pos1, pos2, pos3 FROM o
UNION ALL SELECT DISTINCT page_id, 'room', section_no, pos1, -1, -1 FROM r
UNION ALL SELECT DISTINCT page_id, 'bed', section_no, pos1, pos2, -1 FROM b"""


_TABLES = f"""WITH good AS (SELECT page_id, body::JSON AS b FROM room_pages WHERE page_id IS NOT NULL AND body IS NOT NULL AND json_valid(body)),
secs AS ({_members("good", "b->'data'->'merlin'->'pdpSections'", "page_id", "section_no")}),
am AS (SELECT page_id, section_no, node->'section' AS s FROM secs WHERE json_type(node) = 'OBJECT' AND node->>'sectionId' = 'AMENITIES_DEFAULT' AND json_type(node->'section') = 'OBJECT'),
sl AS (SELECT page_id, section_no, node->'section' AS s FROM secs WHERE json_type(node) = 'OBJECT' AND node->>'sectionId' = 'SLEEPING_ARRANGEMENT_DEFAULT' AND json_type(node->'section') = 'OBJECT'),
g AS ({_members("am", "s->'seeAllAmenitiesGroups'", "page_id, section_no", "pos1")}),
a AS ({_members("(SELECT * FROM g WHERE json_type(node) = 'OBJECT')", "node->'amenities'", "page_id, section_no, pos1", "pos2")}),
o AS ({_members("(SELECT * FROM a WHERE json_type(node) = 'OBJECT')", "node->'options'", "page_id, section_no, pos1, pos2", "pos3")}),
r AS ({_members("sl", "s->'arrangementDetails'", "page_id, section_no", "pos1")}),
b AS ({_members("(SELECT * FROM r WHERE json_type(node) = 'OBJECT')", "node->'beds'", "page_id, section_no, pos1", "pos2")})"""
_TITLE = "CASE WHEN json_type(node) = 'VARCHAR' THEN node->>'$' WHEN json_type(node->'title') = 'VARCHAR' THEN node->>'title' END AS title"
for _name, _from, _label in (("groups", "g", "section_no, pos1"), ("amenities", "a", "section_no, pos1, pos2"), ("options", "o", "section_no, pos1, pos2, pos3"), ("rooms", "r", "section_no, pos1"), ("beds", "b", "section_no, pos1, pos2")):
    ORACLE[f"p7_{_name}"] = f"{_TABLES} SELECT concat_ws('.', page_id, {_label}) AS node_key, concat_ws('.', page_id, {_label.rpartition(', ')[0]}) AS parent_key, page_id, {_TITLE} FROM {_from}"


def _column(name: str, field: str, kind: str) -> tuple[str, str]:
    """SQL of a typed column, and the condition that it, or a null, holds the whole field."""
    at, of = f"node->'{field}'", f"json_type(node->'{field}')"
    fits = {"string": f"{of} = 'VARCHAR'", "boolean": f"{of} = 'BOOLEAN'", "long": f"({of} IN ('BIGINT', 'UBIGINT') AND TRY_CAST({at} AS BIGINT) IS NOT NULL OR {of} = 'VARCHAR' AND regexp_full_match(node->>'{field}', '[0-9]{{1,18}}'))"}[kind]
    value = {"string": f"node->>'{field}'", "boolean": f"({at})::BOOLEAN", "long": f"(node->>'{field}')::BIGINT"}[kind]
    return f"CASE WHEN {fits} THEN {value} END AS {name}", f"({fits} OR {of} = 'NULL')"


def _full(kind: str, src: str, label: str) -> str:
    made = [(field, *_column(name, field, t)) for name, (field, t) in PAGE_FIELDS[kind].items()]
    below = {"group": ["amenities"], "amenity": ["options"], "room": ["beds"]}.get(kind, [])
    gone = [("title", "json_type(node->'title') IN ('VARCHAR', 'NULL')"), *((f, fits) for f, _, fits in made), *((f, f"json_type(node->'{f}') IN ('ARRAY', 'OBJECT', 'VARCHAR')") for f in below)]
    kept = "list_filter(json_keys(node), lambda k: NOT (" + " OR ".join(f"(k = '{f}' AND {fits})" for f, fits in gone) + "))"
    rest = f"""CASE WHEN json_type(node) = 'OBJECT' AND len({kept}) > 0 THEN '{{' || array_to_string(list_transform({kept}, lambda k: to_json(k)::VARCHAR || ':' || (node->k)::VARCHAR), ',') || '}}' END AS rest"""
    cut = label.rpartition(", ")[0]
    return f"{_TABLES} SELECT concat_ws('.', page_id, {label}) AS node_key, concat_ws('.', page_id, {cut}) AS parent_key, page_id, {_TITLE}, {''.join(sql + ', ' for _, sql, _ in made)}{rest} FROM {src}"


for _kind, _from, _label in (("group", "g", "section_no, pos1"), ("amenity", "a", "section_no, pos1, pos2"), ("option", "o", "section_no, pos1, pos2, pos3"), ("room", "r", "section_no, pos1"), ("bed", "b", "section_no, pos1, pos2")):
    ORACLE[f"p7_full_{PLURALS[_kind]}"] = _full(_kind, _from, _label)
