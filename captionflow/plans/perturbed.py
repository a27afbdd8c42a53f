"""Queries of the perturbations. Their SQL works on rows of tokens, the operators on arrays of text parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionflow.operators import perturb, phrases
from captionflow.plans.registry import Registry
from captionflow.session import spread
from captionflow.tables import table

_R = Registry()
QUERIES, ORACLE, query = _R.queries, _R.oracle, _R.query

OBJECTS = ("brass lamp", "oak table", "wool rug", "glass vase", "steel rack", "tin cup", "cork board", "silk fan", "clay pot", "stone bowl", "straw hat", "iron key")
#: Bytes of the parts' file that are work enough for a task: about 30,000 rows, each with a thousand hashes and more.
WALK_BYTES = 1 << 18
ROOMS = {"kitchen": "wet", "bathroom": "wet", "bedroom": "dry", "hall": "dry", "room": "any", "view": "none"}


def captioned(spark: SparkSession, d: str) -> DataFrame:
    """Captions as navigation items with one instruction."""
    rows = spread(table(spark, d, "captions").where("caption is not null"), "item_id")
    return rows.select(F.col("item_id").alias("pos"), F.array("caption").alias("instructions"))


def walks(spark: SparkSession, d: str) -> DataFrame:
    """Routes past the parts, two instructions an item."""
    one = F.concat(F.lit("Turn left at the "), "p_name", F.lit(", go upstairs and walk straight on the right side of the "), "p_type", F.lit(". Head outside."))
    two = F.concat(F.lit("Keep the "), "p_name", F.lit(" on your left, above the rightmost door; it turns around in the middle of "), "p_brand", F.lit(". Stop."))
    rows = spread(table(spark, d, "part"), "p_partkey", WALK_BYTES)
    return rows.select(F.col("p_partkey").alias("pos"), F.array(one, two).alias("instructions"))


# SQL ------------------------------------------------------------------------------------------------

def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _values(rows, names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + f") AS v({names})"


_SIGN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s\p{Z}]"
_CAPTIONS = "src AS (SELECT item_id AS pos, 0 AS ins, caption AS sentence FROM captions WHERE caption IS NOT NULL)"
_WALKS = """src AS (SELECT p_partkey AS pos, 0 AS ins, 'Turn left at the ' || p_name || ', go upstairs and walk straight on the right side of the ' || p_type || '. Head outside.' AS sentence FROM part
UNION ALL SELECT p_partkey, 1, 'Keep the ' || p_name || ' on your left, above the rightmost door; it turns around in the middle of ' || p_brand || '. Stop.' FROM part)"""
_TOKENS = rf"""s AS (SELECT pos, ins, t, array_to_string(t, ' ') AS text FROM (SELECT pos, ins, regexp_extract_all(lower(sentence), '{_SIGN}') AS t FROM src) WHERE len(t) > 0),
tok AS (SELECT pos, ins, text, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS i FROM s)"""


def _phrases(forbidden) -> str:
    """Finds f (number k, tokens a to z) and slots sl of noun phrases."""
    bad = " AND ".join(f"NOT contains(phrase, '{w}')" for w in forbidden)
    return rf"""run AS (SELECT *, i - row_number() OVER (PARTITION BY pos, ins ORDER BY i) AS g FROM tok WHERE regexp_matches(w, '^\p{{L}}') AND w NOT IN {_in(sorted(phrases._BREAKS))}),
f AS (SELECT pos, ins, text, min(i) AS a, max(i) AS z, string_agg(w, ' ' ORDER BY i) AS phrase, row_number() OVER (PARTITION BY pos, ins ORDER BY min(i)) - 1 AS k FROM run GROUP BY pos, ins, text, g),
fit AS (SELECT * FROM f WHERE z - a + 1 BETWEEN 2 AND 6 AND {bad})"""


def _slots(name: str, options: str) -> str:
    """Slots sl numbered k within the sentence, and their ranked options o, from (pos, ins, text, a, z, phrase, w)."""
    return f"""{name} AS ({options}),
sl AS (SELECT *, row_number() OVER (PARTITION BY pos, ins ORDER BY sha1(concat_ws('|', '0', text, k))) AS p, count(*) OVER (PARTITION BY pos, ins) AS m FROM (
SELECT pos, ins, text, a, z, phrase, row_number() OVER (PARTITION BY pos, ins ORDER BY a) - 1 AS k FROM (SELECT DISTINCT pos, ins, text, a, z, phrase FROM {name}))),
o AS (SELECT sl.*, x.w, row_number() OVER (PARTITION BY sl.pos, sl.ins, sl.k ORDER BY sha1(concat_ws('|', '0', sl.text, sl.k, x.w)), x.w) AS n FROM sl JOIN {name} x ON x.pos = sl.pos AND x.ins = sl.ins AND x.a = sl.a)"""


_ONE = """v AS (SELECT pos, ins, a, z, w, row_number() OVER (PARTITION BY pos, ins ORDER BY n, p) - 1 AS place FROM o)
SELECT v.pos, CAST(v.ins AS INT) AS instruction, CAST(place AS INT) AS place, array_to_string(list_concat(list_concat(t[1:a - 1], [w]), t[z + 1:]), ' ') AS variant FROM v JOIN s ON s.pos = v.pos AND s.ins = v.ins WHERE place < 10"""

_DIRECTION_TABLE = _values([(w, i) for i, g in enumerate(perturb.DIRECTIONS) for w in g], "w, g")
_DIRECTION_OPTIONS = f"""SELECT pos, ins, text, i AS a, i AS z, x.w AS phrase, y.w FROM (SELECT *, lag(w) OVER (PARTITION BY pos, ins ORDER BY i) AS u FROM tok) x
JOIN (SELECT * FROM {_DIRECTION_TABLE}) g ON g.w = x.w JOIN (SELECT * FROM {_DIRECTION_TABLE}) y ON y.g <> g.g WHERE u IN {_in(perturb.ACTION_VERBS)}"""
_ADDED = [("over", "top", 1), ("above", "top", 1), ("underneath", "bottom", 1), ("below", "bottom", 0), ("behind", "behind", 1)]
_SIDES = [(side + end, "-" + side, 1) for side in ("left", "right") for end in perturb.ENDINGS]
_ALONE = [_values([(x,) for x in words], "x") for words in (perturb.PREPOSITIONS, perturb.ARTICLES, perturb.PLACES, perturb.FILLERS)]
_PLACE_TABLE = f"""loc AS (SELECT a.x || b.x || ' ' || c.x || d.x AS w, c.x AS p, 1 AS found FROM (SELECT * FROM {_ALONE[0]}) a, (SELECT * FROM {_ALONE[1]}) b, (SELECT * FROM {_ALONE[2]}) c, (SELECT * FROM {_ALONE[3]}) d
UNION ALL SELECT * FROM {_values(_ADDED + _SIDES, "w, p, found")})"""
_LOCATION_OPTIONS = """SELECT pos, ins, text, a, z, phrase, y.w FROM (SELECT tok.pos, tok.ins, tok.text, i AS a, i + n - 1 AS z, loc.w AS phrase, loc.p, row_number() OVER (PARTITION BY tok.pos, tok.ins, i ORDER BY n DESC) AS r
FROM tok JOIN s ON s.pos = tok.pos AND s.ins = tok.ins, (SELECT unnest(range(1, 6)) AS n) JOIN loc ON loc.found = 1 AND loc.w = array_to_string(t[i:i + n - 1], ' ') WHERE i + n - 1 <= len(t)) x
JOIN loc y ON y.p <> x.p AND (y.p[1] = '-') = (x.p[1] = '-') WHERE r = 1"""
_WORDS = "[" + ", ".join(f"'{w}'" for w in OBJECTS) + "]"
_HASH = "sha1(concat_ws('|', '0', text, k))"
_OBJECT_OPTIONS = f"""SELECT pos, ins, text, a, z, phrase, {_WORDS}[(CAST('0x' || {_HASH}[1:8] AS BIGINT) + j * (CAST('0x' || {_HASH}[9:16] AS BIGINT) % {max(1, len(OBJECTS) // 10)} + 1)) % {len(OBJECTS)} + 1] AS w FROM fit, (SELECT unnest(range(10)) AS j)"""
_ROOM_TABLE = _values([(w, c, i) for i, (w, c) in enumerate(ROOMS.items())], "w, c, o")
_ROOM_OPTIONS = f"""SELECT pos, ins, text, a, z, phrase, replace(phrase, x.w, y.w) AS w FROM (SELECT fit.*, arg_min(r.w, o) AS w, arg_min(c, o) AS c FROM fit JOIN (SELECT * FROM {_ROOM_TABLE}) r ON contains(phrase, r.w) GROUP BY ALL) x
JOIN (SELECT * FROM {_ROOM_TABLE}) y ON y.c <> x.c"""
_ITSELF = "SELECT pos, ins, text, a, z, phrase, phrase AS w FROM fit"
_SWITCHED = """pr AS (SELECT x.pos, x.ins, least(x.a, y.a) AS a, CASE WHEN x.a < y.a THEN x.z ELSE y.z END AS z, CASE WHEN x.a < y.a THEN y.phrase ELSE x.phrase END AS u,
greatest(x.a, y.a) AS b, CASE WHEN x.a < y.a THEN y.z ELSE x.z END AS y, CASE WHEN x.a < y.a THEN x.phrase ELSE y.phrase END AS v, row_number() OVER (PARTITION BY x.pos, x.ins ORDER BY y.p, x.p) - 1 AS place
FROM sl x JOIN sl y ON x.pos = y.pos AND x.ins = y.ins AND x.p < y.p AND x.phrase <> y.phrase)
SELECT pr.pos, CAST(pr.ins AS INT) AS instruction, CAST(place AS INT) AS place, array_to_string(t[1:a - 1] || [u] || t[z + 1:b - 1] || [v] || t[y + 1:], ' ') AS variant FROM pr JOIN s ON s.pos = pr.pos AND s.ins = pr.ins WHERE place < 10"""
# one slot is kept, every other one takes the first of its options by a hash that the kept one enters
_REMAIN = """pick AS (SELECT kept.pos, kept.ins, kept.p - 1 AS place, o.a, o.z, arg_min(o.w, sha1(concat_ws('|', '0', o.text, kept.k, o.k, o.w))) AS w FROM sl kept JOIN o ON o.pos = kept.pos AND o.ins = kept.ins AND o.k <> kept.k WHERE kept.p <= 10 GROUP BY ALL),
put AS (SELECT pick.pos, pick.ins, place, tok.i, CASE WHEN count(CASE WHEN tok.i BETWEEN a AND z THEN 1 END) = 0 THEN any_value(tok.w) ELSE max(CASE WHEN tok.i = a THEN pick.w END) END AS w FROM pick JOIN tok ON tok.pos = pick.pos AND tok.ins = pick.ins GROUP BY ALL)
SELECT pos, CAST(ins AS INT) AS instruction, CAST(place AS INT) AS place, string_agg(w, ' ' ORDER BY i) AS variant FROM put GROUP BY ALL"""
_TWO = """cb AS (SELECT x.pos, x.ins, x.k AS k1, y.k AS k2, row_number() OVER (PARTITION BY x.pos, x.ins ORDER BY y.p, x.p) AS r FROM sl x JOIN sl y ON x.pos = y.pos AND x.ins = y.ins AND x.p < y.p),
n AS (SELECT pos, ins, k, least(count(*), 10) AS n FROM o GROUP BY ALL),
q AS (SELECT cb.*, turn, row_number() OVER (PARTITION BY cb.pos, cb.ins ORDER BY turn, r) - 1 AS place, turn % n2.n + 1 AS i2, (turn // n2.n) % n1.n + 1 AS i1 FROM cb JOIN n n1 ON n1.pos = cb.pos AND n1.ins = cb.ins AND n1.k = k1 JOIN n n2 ON n2.pos = cb.pos AND n2.ins = cb.ins AND n2.k = k2, (SELECT unnest(range(10)) AS turn) WHERE turn < n1.n * n2.n AND r <= 10),
e AS (SELECT q.pos, q.ins, place, least(o1.a, o2.a) AS a, CASE WHEN o1.a < o2.a THEN o1.z ELSE o2.z END AS z, CASE WHEN o1.a < o2.a THEN o1.w ELSE o2.w END AS u, greatest(o1.a, o2.a) AS b, CASE WHEN o1.a < o2.a THEN o2.z ELSE o1.z END AS y, CASE WHEN o1.a < o2.a THEN o2.w ELSE o1.w END AS v
FROM q JOIN o o1 ON o1.pos = q.pos AND o1.ins = q.ins AND o1.k = k1 AND o1.n = i1 JOIN o o2 ON o2.pos = q.pos AND o2.ins = q.ins AND o2.k = k2 AND o2.n = i2 WHERE place < 10)
SELECT e.pos, CAST(e.ins AS INT) AS instruction, CAST(place AS INT) AS place, array_to_string(t[1:a - 1] || [u] || t[z + 1:b - 1] || [v] || t[y + 1:], ' ') AS variant FROM e JOIN s ON s.pos = e.pos AND s.ins = e.ins"""
_STOPPED = f"array_to_string(list_filter(regexp_extract_all(sentence, '(?:[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s\\p{{Z}}])[\\s\\p{{Z}}]*'), lambda x: lower(regexp_replace(x, '[\\s\\p{{Z}}]+$', '')) NOT IN {_in(perturb.STOP_WORDS)}), '')"


def _with(source: str, *parts: str) -> str:
    return "WITH " + ",\n".join((source, _TOKENS, *parts))


def _rows(make, source) :
    return lambda spark, d: perturb.variant_rows(source(spark, d), make, ["pos"])


def _add(name: str, make, source, sql: str) -> None:
    query(sql, name)(_rows(make, source))


_OBJECT = _phrases(perturb.OBJECT_FORBIDDEN)
_ROOM = _phrases(perturb.ROOM_FORBIDDEN)
_OBJECT_SLOTS, _ITSELF_SLOTS = _slots("op", _OBJECT_OPTIONS), _slots("op", _ITSELF)
_add("perturb_objects", perturb.perturbator("object", objects=OBJECTS), captioned, _with(_CAPTIONS, _OBJECT, _OBJECT_SLOTS, _ONE))
_add("perturb_switch", perturb.perturbator("object switch"), captioned, _with(_CAPTIONS, _OBJECT, _ITSELF_SLOTS, _SWITCHED))
_add("perturb_swap", perturb.perturbator("swap"), walks, _with(_WALKS, _ROOM, _ITSELF_SLOTS, _SWITCHED))
_add("perturb_rooms", perturb.perturbator("room", rooms=ROOMS), captioned, _with(_CAPTIONS, _ROOM, _slots("op", _ROOM_OPTIONS), _ONE))
_add("perturb_locations", perturb.perturbator("location"), captioned, _with(_CAPTIONS, _PLACE_TABLE, _slots("op", _LOCATION_OPTIONS), _ONE))
_add("perturb_walk_locations", perturb.perturbator("location"), walks, _with(_WALKS, _PLACE_TABLE, _slots("op", _LOCATION_OPTIONS), _ONE))
_add("perturb_directions", perturb.perturbator("direction"), walks, _with(_WALKS, _slots("op", _DIRECTION_OPTIONS), _ONE))
_add("perturb_two_directions", perturb.perturbator("direction", count=2), walks, _with(_WALKS, _slots("op", _DIRECTION_OPTIONS), _TWO))
_add("perturb_combined", perturb.perturbator("direction+location"), walks, _with(_WALKS, _PLACE_TABLE, _slots("op", f"{_DIRECTION_OPTIONS} UNION ALL {_LOCATION_OPTIONS}"), _ONE))
_add("perturb_masked", perturb.perturbator("object", mask=True, objects=OBJECTS), captioned, _with(_CAPTIONS, _OBJECT, _slots("op", _ITSELF.replace("phrase AS w", "'[MASK]' AS w")), _ONE))
_add("perturb_remain", perturb.perturbator("object remain", objects=OBJECTS), captioned, _with(_CAPTIONS, _OBJECT, _OBJECT_SLOTS, _REMAIN))
_add("perturb_stop", perturb.perturbator("stop"), captioned, f"WITH {_CAPTIONS} SELECT pos, 0 AS instruction, 0 AS place, {_STOPPED} AS variant FROM src WHERE sentence <> ''")
_add("perturb_deaf", perturb.perturbator("deaf"), captioned, f"WITH {_CAPTIONS} SELECT pos, 0 AS instruction, 0 AS place, '' AS variant FROM src WHERE sentence <> ''")
_FIRST = _with(_CAPTIONS, _OBJECT, _OBJECT_SLOTS, _ONE)


@query(f"SELECT src.pos, [coalesce(x.variant, sentence)] AS instructions, [x.variant IS NOT NULL] AS corrupted FROM (SELECT item_id AS pos, caption AS sentence FROM captions WHERE caption IS NOT NULL) src LEFT JOIN ({_FIRST}) x ON x.pos = src.pos AND x.place = 0")
def perturb_testing(spark, d):
    return perturb.for_testing(captioned(spark, d), perturb.perturbator("object", objects=OBJECTS))


@query(f"SELECT src.pos, [sentence] AS instructions, count(*) AS n FROM (SELECT item_id AS pos, caption AS sentence FROM captions) src JOIN ({_FIRST}) x ON x.pos = src.pos GROUP BY ALL")
def perturb_only(spark, d):
    made = perturb.for_training(captioned(spark, d), perturb.perturbator("object", objects=OBJECTS), only_perturbed=True)
    return made.select("pos", "instructions", F.size(F.flatten("perturbations")).cast("long").alias("n"))


@query(f"WITH {_CAPTIONS}, {_TOKENS}, {_ROOM}, keep AS (SELECT pos, ins, phrase, a FROM f WHERE z - a + 1 BETWEEN 1 AND 5 AND NOT contains(phrase, 'turn')) SELECT c.item_id AS pos, coalesce((SELECT list(phrase ORDER BY a) FROM keep WHERE keep.pos = c.item_id), []) AS noun_phrases FROM captions c")
def noun_phrases(spark, d):
    rows = table(spark, d, "captions").select(F.col("item_id").alias("pos"), F.col("caption").alias("sentence"))
    return phrases.extract(rows).select("pos", "noun_phrases")
