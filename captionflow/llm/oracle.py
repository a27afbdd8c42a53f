"""DuckDB SQL for the training-data queries that SQL can express."""

from captionflow.llm.splits import NONE_SLOTS
from captionflow.operators.running import hash_order_sql

_REACH = """WITH RECURSIVE pairs AS (SELECT DISTINCT listing_id AS e, photo_id AS l FROM images WHERE listing_id IS NOT NULL AND photo_id > 0),
star AS (SELECT l, min(e) AS a FROM pairs GROUP BY l HAVING min(e) < max(e)),
link AS (SELECT DISTINCT a, e AS b FROM pairs JOIN star USING (l) WHERE a <> e),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(v, r) AS (SELECT a, a FROM both_ways UNION SELECT b, r FROM reach JOIN both_ways ON a = v)"""
_UNITS = f"""{_REACH}, grp AS (SELECT v AS e, min(r) AS g FROM reach GROUP BY v),
img AS (SELECT listing_id, photo_id, caption, listing_id AS e, CASE WHEN photo_id > 0 THEN photo_id END AS l, CASE WHEN listing_id IS NULL AND NOT coalesce(photo_id > 0, false) THEN (({hash_order_sql("photo_id", "listing_id", "location", "state", "caption", seed=17)}) // 8) % {NONE_SLOTS} END AS s FROM images),
own AS (SELECT l, min(e) AS e FROM img WHERE e IS NOT NULL AND l IS NOT NULL GROUP BY l),
member AS (SELECT 'entity' AS kind, e AS id, 0 AS space, coalesce(any_value(g), e) AS unit, count(*) AS n FROM img LEFT JOIN grp USING (e) WHERE e IS NOT NULL GROUP BY e
UNION ALL SELECT 'link', img.l, CASE WHEN any_value(own.e) IS NULL THEN 1 ELSE 0 END, coalesce(any_value(g), any_value(own.e), img.l), count(*) FROM img LEFT JOIN own USING (l) LEFT JOIN grp ON grp.e = own.e WHERE img.e IS NULL AND img.l IS NOT NULL GROUP BY img.l
UNION ALL SELECT 'none', s, 2, s, count(*) FROM img WHERE s IS NOT NULL GROUP BY s),
unit AS (SELECT space, unit, sum(n) AS n, {hash_order_sql("space", "unit", seed=17)} AS h FROM member GROUP BY space, unit),
line AS (SELECT *, sum(n) OVER () AS total, sum(n) OVER (ORDER BY CASE WHEN n > 0.01 * all_n THEN h >> 40 ELSE h END, space, unit) - n / 2 AS middle FROM (SELECT *, sum(n) OVER () AS all_n FROM unit)),
placed AS (SELECT space, unit, CASE WHEN middle <= total * 0.8 THEN 'train' WHEN middle <= total * 0.9 THEN 'valid' ELSE 'test' END AS split FROM line)"""

ORACLE = {
    "p4_found": f"{_REACH} SELECT v AS listing_id, min(r) AS group_id FROM reach GROUP BY v",
    "p4_units": f"{_UNITS} SELECT kind, id, CASE WHEN space < 2 THEN unit END AS unit, CAST(n AS BIGINT) AS n_rows, split FROM member JOIN placed USING (space, unit)",
    "p4_splits": f"""{_UNITS} SELECT listing_id, photo_id, caption, split FROM img JOIN member ON id = coalesce(img.e, img.l, img.s) AND kind = CASE WHEN img.e IS NOT NULL THEN 'entity' WHEN img.l IS NOT NULL THEN 'link' ELSE 'none' END JOIN placed USING (space, unit)""",
    "p10_found": """WITH w AS (SELECT doc_id, substring(text, i::BIGINT, 200) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
several AS (SELECT s, list(DISTINCT doc_id) AS ids FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1),
a AS (SELECT DISTINCT ids FROM several), x AS (SELECT ids, unnest(ids) AS doc_a FROM a), y AS (SELECT doc_a, unnest(ids) AS doc_b FROM x)
SELECT DISTINCT doc_a, doc_b FROM y WHERE doc_a < doc_b""",
    "p10_shared": """WITH w AS (SELECT doc_id, i, substring(text, i::BIGINT, 200) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
several AS (SELECT s FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w WHERE s IN (SELECT s FROM several)),
tot AS (SELECT doc_id, sum(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) AS n, sum(CASE WHEN p IS NULL THEN 200 ELSE least(200, i - p) END) AS c FROM hit GROUP BY 1)
SELECT d.doc_id, coalesce(length(d.text), 0) AS n_chars, CAST(coalesce(n, 0) AS BIGINT) AS n_passages, CAST(coalesce(c, 0) AS BIGINT) AS shared_chars, coalesce(c / length(d.text), 0.0) AS shared_share
FROM documents d LEFT JOIN tot USING (doc_id) WHERE d.doc_id IS NOT NULL""",
    "p10_passages": """WITH w AS (SELECT doc_id, i, substring(text, i::BIGINT, 200) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
several AS (SELECT s FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w WHERE s IN (SELECT s FROM several)),
run AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM hit),
tot AS (SELECT doc_id, min(i) - 1 AS a, max(i) + 199 AS b FROM run GROUP BY doc_id, n)
SELECT doc_id, a AS start, b AS "end", substring(text, a + 1, b - a) AS passage FROM tot JOIN documents USING (doc_id)""",
}
