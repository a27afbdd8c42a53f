import hashlib
import json
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from captionflow import session
from captionflow.functions import arrays
from captionflow.operators import audit, boxes, captions, crawl, detections, documents, features, merging, nested, perturb, phrases, running, spatial, trajectories
from captionflow.plans import perturbed, records

CAPTIONS = "listing_id long, photo_id long, url string, caption string, pos long"


def test_blank_repeats_keeps_rows_and_is_idempotent(spark):
    rows = [(1, 1, "u", "a", 1), (1, 2, "u", "a", 2), (1, 3, None, ".", 3), (1, 4, "u", ".", 4), (2, 5, "u", "a", 5), (1, 6, "u", None, 6), (None, 7, "u", "a", 7), (None, 8, "u", "a", 8)]
    df = spark.createDataFrame(rows, CAPTIONS)
    once = captions.blank_repeats(df, "pos")
    got = {r.pos: r.caption for r in once.collect()}
    assert got == {1: "a", 2: "", 3: ".", 4: ".", 5: "a", 6: None, 7: "a", 8: ""}
    assert sorted(captions.blank_repeats(once, "pos").collect(), key=str) == sorted(once.collect(), key=str)
    assert captions.blank_repeats(df.limit(0), "pos").count() == 0


def test_fit_listings_counts_photos_and_captions(spark):
    rows = [(1, i, "u", "c" if i < 2 else "", i) for i in range(4)] + [(2, i, "u", "c", 10 + i) for i in range(3)] + [(None, i, "u", "c", 20 + i) for i in range(4)]
    df = spark.createDataFrame(rows, CAPTIONS)
    assert {r.listing_id for r in captions.fit_listings(df).collect()} == {1, None}
    assert {r.listing_id for r in captions.fit_listings(df, captionless=False).collect()} == {None}


def test_first_match_uses_a_key_up(spark):
    df = spark.createDataFrame([(1, 5, "u", "", 1), (1, 5, "u", "x", 2), (1, 6, "u", "x", 3), (1, None, "u", "x", 4)], CAPTIONS)
    keys = spark.createDataFrame([(5,), (5,), (None,), (6,)], "photo_id long")
    assert {r.pos for r in captions.first_match(df, keys, "photo_id", "pos").collect()} == {1, 3}
    assert {r.pos for r in captions.first_match(df, keys, "photo_id", "pos", F.col("caption") != "").collect()} == {3}


def test_strict_lookup_fails_on_a_miss(spark):
    rows, table = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    assert captions.strict_lookup(rows.where("k = 1"), table, "k").count() == 1
    with pytest.raises(Exception, match="no k 2"):
        captions.strict_lookup(rows, table, "k").collect()


def test_splits_of_rows(spark):
    df = spark.createDataFrame([(i * 10,) for i in range(50)], "pos long")
    n = captions.row_numbers(df, "pos")
    assert [r.row_no for r in n.orderBy("pos").collect()] == list(range(50))
    assert [r.split for r in captions.tail_split(n).orderBy("pos").collect()].count("test") == 2  # 2.5 rounds to even
    assert {r.part for r in captions.ranged(n, 4, 2).collect()} == {0, 1, 2, 3}
    assert captions.ranged(captions.row_numbers(df.limit(0), "pos"), 4).count() == 0


def test_running_total_equals_a_plain_one(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i, rng.randint(0, 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i long, v long").withColumn("h", running.hash_order("i"))
    got = running.running_total(df, ["k"], "h", ["i"], "v", "total", rows_hint=400, rows_per_slice=10)
    seen = {}
    for r in sorted(got.collect(), key=lambda r: (str(r.k), r.h, r.i)):
        seen[r.k] = seen.get(r.k, 0) + r.v
        assert r.total == seen[r.k]


def test_printed_scores_are_parsed_not_run(spark):
    text = "[(0.8, 'kitchen'), (np.float32(0.1), 'pantry'), (1e-3, \"bow_window/indoor\")]"
    r = spark.range(1).select(detections.parse_scores(F.lit(text)).alias("s"), detections.parse_flag(F.lit("(0.1, True)")).alias("f"), detections.parse_flag(F.lit("?")).alias("n")).first()
    assert [(x.prob, x.name) for x in r.s] == [(0.8, "kitchen"), (0.1, "pantry"), (0.001, "bow_window/indoor")] and r.f is True and r.n is None


def test_room_vote_ties_and_unknown(spark):
    h = spark.createDataFrame([(n, r, i) for i, (n, r) in enumerate(detections.HIERARCHY)], "name string, room string, pos int")
    s = spark.createDataFrame([(1, "bedroom", 0.5), (1, "bathroom", 0.5), (2, "moon", 0.9), (3, "dorm_room", 0.3), (3, "playroom", 0.3), (3, "kitchen", 0.5)], "photo_id long, name string, prob double")
    got = {r.photo_id: (r.room, r.score) for r in detections.room_votes(s, h, ["photo_id"]).collect()}
    assert got == {1: ("bathroom", 0.5), 2: ("alcove", 0.0), 3: ("bedroom", 0.6)}


PHOTOS = "listing_id long, photo_id long, room string, score double, captioned boolean, pos long"


def test_chunk_example_and_bounds(spark):
    rows = [(1, i, "kitchen", 0.5, i in (3, 4), i) for i in range(12)] + [(2, 100 + i, "office", 0.5, True, i) for i in range(21)]
    got = merging.chunked(merging.grouped(spark.createDataFrame(rows, PHOTOS)))
    chunks = {}
    for r in got.where("listing_id = 1").collect():
        chunks.setdefault(r.chunk, set()).add(r.photo_id)
    assert chunks == {0: {3, 0, 2, 6, 8, 10}, 1: {4, 1, 5, 7, 9, 11}}
    assert {r.chunk for r in got.where("listing_id = 2").collect()} == {0}


def test_balancing_reaches_both_limits_and_keeps_every_photo(spark):
    rng = random.Random(5)
    rows = [(l, l * 1000 + i, rng.choice(["kitchen", "bedroom", "office"]), 0.5, rng.random() < 0.4, i) for l in range(1, 9) for i in range(rng.randint(4, 30))]
    photos = merging.chunked(merging.grouped(merging.fit_detections(spark.createDataFrame(rows, PHOTOS))))
    out = merging.balanced(photos, 4, 6).collect()
    assert len(out) == photos.count() == len({r.photo_id for r in out})
    groups = {}
    for r in out:
        groups.setdefault(r.listing_id, {}).setdefault((r.room_group, r.chunk, r.part), []).append(r.captioned)
    for listing, found in groups.items():
        captioned = sum(r.captioned for r in out if r.listing_id == listing)
        assert len(found) >= min(6, sum(map(len, found.values())))
        assert sum(any(g) for g in found.values()) >= min(4, captioned)
    merged = merging.merged_photos(merging.balanced(photos, 4, 6)).collect()
    assert all(r.merging[0] == r.photo_id and len(r.merging) == len(r.weights) for r in merged) and len(merged) == len(out)


def plain_nms(b, s, t):
    order, kept = sorted(range(len(b)), key=lambda i: -s[i]), []
    for i in order:
        def overlap(j):
            w = min(b[i][2], b[j][2]) - max(b[i][0], b[j][0]) + 1
            h = min(b[i][3], b[j][3]) - max(b[i][1], b[j][1]) + 1
            both = max(w, 0) * max(h, 0)
            area = lambda x: (x[2] - x[0] + 1) * (x[3] - x[1] + 1)
            return both / (area(b[i]) + area(b[j]) - both)
        if all(overlap(j) <= t for j in kept):
            kept.append(i)
    return kept


def test_suppression_equals_a_plain_one(spark):
    rng = random.Random(2)
    rows = []
    for image in range(30):
        for box in range(rng.randint(1, 12)):
            x, y = rng.randint(0, 60), rng.randint(0, 60)
            rows.append((image, box, rng.random(), float(x), float(y), x + 30.0, y + 30.0))
    df = spark.createDataFrame(rows, "image long, box int, confidence double, x1 double, y1 double, x2 double, y2 double")
    got = {(r.image, r.box) for r in boxes.non_maximum(df, 0.3).collect()}
    want = set()
    for image in range(30):
        own = [r for r in rows if r[0] == image]
        want |= {(image, own[i][1]) for i in plain_nms([r[3:] for r in own], [r[2] for r in own], 0.3)}
    assert got == want and boxes.non_maximum(df.limit(0), 0.3).count() == 0


def test_thinning_leaves_the_limit():
    rng = np.random.default_rng(1)
    f, h, e, b = rng.normal(size=(30, 4)), rng.uniform(-3, 3, 30), rng.uniform(-1, 1, 30), rng.random(30)
    assert len(boxes.thin_out(f, h, e, b, 10)) == 10 and boxes.thin_out(f, h, e, b, 30) == list(range(30))
    f[1], h[1], e[1], b[0], b[1] = f[0], h[0], e[0], 0.9, 0.1
    assert 1 not in boxes.thin_out(f, h, e, b, 29)


def test_select_boxes_fills_and_cuts(spark):
    df = spark.createDataFrame([(1, i, i / 100) for i in range(30)] + [(2, i, 0.9) for i in range(3)], "image int, box int, c double")
    n = lambda t: {r["image"]: r["count"] for r in boxes.select_boxes(df, "image", "c", t).groupBy("image").count().collect()}
    assert n(0.99) == {1: 5, 2: 3} and n(0.0) == {1: 20, 2: 3} and n(0.2) == {1: 10, 2: 3}


def test_documents(spark):
    body = {"data": {"merlin": {"pdpPhotoTour": {"images": [{"id": 5, "baseUrl": "u", "imageMetadata": {"caption": None}}, {"id": "6", "baseUrl": "v"}, None]}}}}
    df = spark.createDataFrame([(1, json.dumps(body)), (2, '{"data": {"merlin": {"pdpPhotoTour": null}}}'), (3, "{broken"), (4, None)], "listing_id long, body string")
    assert [(r.listing_id, r.photo_id, r.caption) for r in documents.photos(df).where("photo_id is not null").orderBy("pos").collect()] == [(1, 5, ""), (1, 6, "")]
    reviews = {"data": {"merlin": {"pdpReviews": {"reviews": [{"id": 1, "comments": "ok", "reviewee": {"isSuperhost": True}}]}}}}
    r = documents.reviews(spark.createDataFrame([(1, json.dumps(reviews))], "listing_id long, body string")).first()
    assert (r.review_id, r.comment, r.is_superhost, r.language) == (1, "ok", True, None)
    page = {"data": {"dora": {"exploreV3": {"sections": [{"__typename": "Other"}, {"__typename": "DoraExploreV3ListingsSection", "items": [{"listing": {"id": 3}}, {"listing": {"id": "4"}}]}, {"__typename": "DoraExploreV3ListingsSection", "items": [{"listing": {"id": 9}}]}], "metadata": {"paginationMetadata": {"totalCount": 120}}}}}}
    pages = spark.createDataFrame([("x", json.dumps(page))], "name string, body string")
    assert {r.listing_id for r in documents.search_results(pages).collect()} == {3, 4, 9}
    assert {r.listing_id for r in documents.search_results(pages, only_first=True).collect()} == {3, 4}
    assert [r.offset for r in crawl.page_offsets(documents.total_count(pages), "name", "total").collect()] == [50, 100]
    rows = spark.createDataFrame([(1, "Kitchen", "Oven", None, 1), (1, "Kitchen", "Pan", "big", 2), (2, None, "x", "y", 1)], "k int, g string, t string, s string, o int")
    assert documents.amenity_map(rows, "k", "g", "t", "s", "o").first().amenities == {"Kitchen": [("Oven", None), ("Pan", "big")]}


def test_audit_of_images(spark):
    df = spark.createDataFrame([("a", b"ok"), ("b", b""), ("c", b"no")], "path string, content binary")

    def decode(data):
        if not data:
            raise ValueError("empty")
        return None if data == b"no" else {}

    assert {(r.path, r.reason) for r in audit.corrupt_images(df, decode).collect()} == {("b", "corrupt image"), ("c", "no metadata")}


def test_closure_with_a_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (2, 2)], "a long, b long")
    got = {r.node: r.depth for r in crawl.closure(e, spark.createDataFrame([(1,), (1,)], "node long")).collect()}
    assert got == {1: 0, 2: 1, 3: 2}


def test_phrase_walk_and_choice(spark):
    tree = {"word": "turn left at the red sofa", "nodeType": "S", "children": [{"word": "turn left", "nodeType": "NP"}, {"word": "at the red sofa", "nodeType": "PP", "children": [{"word": "the red sofa", "nodeType": "NP"}]}, {"word": "The red sofa.", "nodeType": "NP", "children": [{"word": "red", "nodeType": "NP"}]}]}
    assert phrases.walk(tree) == ["the red sofa"]
    pick = lambda p, known, bad: spark.range(1).select(phrases.best(F.array(*[F.lit(x) for x in p]), F.array(*[F.lit(x) for x in known]), bad, 0, F.lit(1)).alias("b")).first().b
    assert pick(["red sofa", "big window"], ["sofa"], []) == "red sofa" and pick(["turn"], ["x"], ["turn"]) == "" and pick(["a lamp"], ["sofa"], []) == "a lamp"
    df = spark.createDataFrame([(1, "Walk past the brass lamp, then stop."), (2, " "), (3, None)], "i int, sentence string")
    assert {r.i: r.noun_phrases for r in phrases.extract(df).collect()} == {1: ["brass lamp"], 2: [], 3: []}
    rel = phrases.related(spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("a", "c")], "a string, b string"), spark.createDataFrame([("a", "b")], "word string, related string"))
    assert {(r.a, r.b): r.same for r in rel.collect()} == {("a", "b"): True, ("b", "a"): True, ("a", "a"): True, ("a", "c"): False}


def test_parts_make_the_sentence(spark):
    rng = random.Random(5)
    words = "a b left right , . onto on the of side top leftmost turn go lamp red".split()
    texts = [(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 25))),) for _ in range(200)]
    df = spark.createDataFrame(texts, "t string")
    itself = lambda text, phrase, k: F.array(phrase)
    phrase = perturb.noun_phrases(itself)
    for cutter in (perturb.directions(), perturb.directions(lambda t: F.array(F.lit(0))), perturb.locations(), phrase, perturb.combined(perturb.locations(), phrase)):
        for r in df.select("t", cutter(F.col("t")).alias("p")).collect():
            assert "".join(p.text for p in r.p) == r.t
            assert all(p.options is None or p.text for p in r.p)


def variants_of(spark, make, *sentences, most=10):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sentences)], "i int, s string")
    return [r.v for r in df.select("i", make(F.col("s"), most).alias("v")).orderBy("i").collect()]


def test_perturbation_modes(spark):
    first = lambda mode, s, **k: (variants_of(spark, perturb.perturbator(mode, **k), s, most=1)[0] or [None])[0]
    every = lambda mode, s, most=500, **k: variants_of(spark, perturb.perturbator(mode, **k), s, most=most)[0]
    s = "Turn left at the red sofa, then walk past the oak table on the left side of it."
    assert "left at" not in first("direction", s) and first("deaf", s) == "" and " the " not in first("stop", s)
    got = set(every("location", s))
    assert all("red sofa" in v for v in got) and "turn left at the red sofa , then walk past the oak table over it ." in got
    assert all(" below " not in v or "table below it" in v for v in got) and every("location", "the lamp below it") == []
    assert "glass vase" in first("object", s, objects=("glass vase",)) and "[MASK]" in first("object", s, mask=True, objects=("x",))
    assert first("object switch", s).index("oak table") < first("object switch", s).index("red sofa")
    kept = first("object remain", s, objects=("vase",), clues=1)
    assert kept.count("vase") == 2 and sum(w in kept for w in ("red sofa", "oak table", "left side")) == 1
    rooms = {"kitchen": "wet", "bedroom": "dry"}
    assert first("room", "see the kitchen door", rooms=rooms) == "see the bedroom door"
    # swap switches any two phrases; room comes before swap, switch counts within object only
    assert every("swap", "go to the red sofa and the blue chair") == ["go to the blue chair and the red sofa"]
    assert first("room switch", "see the kitchen door", rooms=rooms) == "see the bedroom door"
    assert first("stop direction", "turn left") in {"turn " + w for g in perturb.DIRECTIONS for w in g}
    assert every("swap", "the red sofa and the red sofa") == [] and every("object", "stop .", objects=("x",)) == []
    model = lambda t: iter([t.replace("[MASK]", "cat")])
    df = spark.createDataFrame([([s, ""],), (None,), ([],)], "instructions array<string>")
    filled = perturb.for_training(df, perturb.perturbator("object", mask=True, model=model, objects=("x",))).collect()
    assert sorted(str(r.perturbations and [len(v) for v in r.perturbations]) for r in filled) == ["None", "[3, 0]", "[]"]
    for bad in ("nonsense", "vilbert", "deaf+object"):
        with pytest.raises(ValueError):
            perturb.perturbator(bad)


def test_perturbations_by_brute_force(spark):
    """Two slots at a time: all of the first variants differ from the sentence in exactly two places, none twice, none missing."""
    s = "turn left , go up , walk right , head inside"
    got = variants_of(spark, perturb.perturbator("direction", count=2), s, most=5000)[0]
    slots = {1: "left", 4: "up", 7: "right", 10: "inside"}
    group = {w: g for g in perturb.DIRECTIONS for w in g}
    words, want = s.split(), set()
    for i, j in __import__("itertools").combinations(slots, 2):
        for a in group:
            for b in group:
                if group[a] != group[words[i]] and group[b] != group[words[j]]:
                    want.add(" ".join(a if k == i else b if k == j else w for k, w in enumerate(words)))
    assert len(got) == len(want) and set(got) == want
    assert variants_of(spark, perturb.perturbator("direction", count=2), s, most=10)[0] != []
    many = " and ".join(f"the tall lamp {k % 3}" for k in range(60))
    pairs = variants_of(spark, perturb.perturbator("swap"), many, many.replace("lamp", "tall lamp"), most=10)
    assert pairs[0] == [] and pairs[1] == []  # all phrases are equal
    mixed = " and ".join("the red sofa" if k != 40 else "the blue chair" for k in range(60))
    assert len(set(variants_of(spark, perturb.perturbator("swap"), mixed, most=10)[0])) == 10


def test_parser_hooks(spark):
    tree = json.dumps({"spans": [{"start": 0, "end": 4}], "attributes": ["VERB"], "children": [{"spans": [{"start": 5, "end": 9}], "attributes": ["NOUN"], "children": [{"spans": [{"start": 12, "end": 17}]}]}]})
    df = spark.createDataFrame([("bear left , right", tree), ("bear left", "{"), ("bear left", None)], "t string, tree string")
    nodes = df.select("t", phrases.dependency_nodes(F.col("tree")).alias("n")).cache()
    got = nodes.select(phrases.verb_children(F.col("t"), F.col("n")).alias("v")).collect()
    assert [r.v for r in got] == [[1], None, None]
    make = perturb.perturbator("direction", hangs_on_verb=lambda t: phrases.verb_children(t, F.col("n")))
    out = [r.v for r in nodes.select(make(F.col("t"), 3).alias("v")).collect()]
    assert len(out[0]) == 3 and all(v.startswith("bear ") and v.endswith(" , right") for v in out[0]) and out[1:] == [[], []]
    spans = lambda t: F.array(F.struct(F.lit(4).alias("start"), F.lit(12).alias("end")))
    assert variants_of(spark, perturb.perturbator("object", objects=("cup",), spans=spans), "see red sofa here")[0] == ["see cup here"]


def test_drivers(spark):
    df = spark.createDataFrame([(1, ["walk past the oak table", "stop", None]), (2, ["stop"]), (3, []), (4, None)], "i int, instructions array<string>")
    make = perturb.perturbator("object", objects=tuple(f"thing {k}" for k in range(30)))
    full = {r.i: r.perturbations for r in perturb.for_training(df, make).collect()}
    assert [len(v) for v in full[1]] == [10, 0, 0] and full[3] == [] and full[4] is None
    only = {r.i: r.instructions for r in perturb.for_training(df, make, only_perturbed=True).collect()}
    assert only == {1: ["walk past the oak table"]}
    test = {r.i: (r.instructions, r.corrupted) for r in perturb.for_testing(df, make).collect()}
    assert test[1][1] == [True, False, False] and test[1][0][1] == "stop" and "thing" in test[1][0][0]
    assert "PythonUDF" not in perturb.for_training(df, make)._jdf.queryExecution().toString()
    assert "Exchange" not in perturb.for_training(df, make)._jdf.queryExecution().toString()


def test_variant_rows_make_each_variant_once(spark):
    df = spark.createDataFrame([(1, ["turn left at the left side of it"])], "pos int, instructions array<string>")
    lines = perturb.variant_rows(df, perturb.perturbator("direction+location"), ["pos"])
    assert lines.count() == 10
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(lines._jdf.queryExecution(), "simple")
    assert plan.count("array_join(regexp_extract_all") == 1


def test_options_take_hash_order(spark):
    words = ["lamp", "lamp", None, *(f"thing {k}" for k in range(300))]
    cutter = lambda text: perturb.offered(perturb.cut(text, "sofa"), lambda p, k: F.array(*[F.lit(w) for w in words]))
    got = variants_of(spark, perturb.replaced(cutter), "the red sofa", most=310)[0]
    key = lambda w: hashlib.sha1("|".join(["0", "the red sofa", "0", *([w] if w is not None else [])]).encode()).hexdigest()
    assert got == ["the red " + (w or "sofa") for w in sorted(words, key=key)]


def test_walks_are_spread_over_the_cores(spark):
    assert perturbed.walks(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4
    few = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    assert session.spread(few, "p_partkey", 500).rdd.getNumPartitions() > 8


def test_walk_locations_look_at_each_find_once(spark):
    lines = perturbed.QUERIES["perturb_walk_locations"](spark, "/root/testdata/sf0.001")
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(lines._jdf.queryExecution(), "simple")
    assert plan.count("array_join(regexp_extract_all") == plan.count("regexp_extract(") == 1 and "Exchange hashpartitioning" in plan
    options = lambda text: F.flatten(F.transform(perturb.locations()(text), lambda p: F.coalesce(p["options"], F.array())))
    groups = perturb.location_phrases()
    looked_for = [(w, place) for place, words in groups.items() for w in words if w not in perturb.NOT_LOOKED_FOR]
    for r in spark.createDataFrame(looked_for, "w string, place string").select("w", "place", options(F.col("w")).alias("o")).collect():
        assert r.o == [w for q, ws in groups.items() if q != r.place for w in ws], r.w
    assert spark.range(1).select(options(F.lit("rightmost"))).first()[0] == ["leftmost", "leftside"]


def test_trajectories(spark):
    rows = [(l, l * 100 + i, "cap" if i % 2 else "") for l in range(5) for i in range(3 + l * 3)] + [(None, 1, "x"), (1, None, "x")]
    got = trajectories.fixed_samples(spark.createDataFrame(rows, "listing_id long, photo_id long, caption string")).collect()
    assert {r.listing_id for r in got} == {1, 2, 3, 4}
    for r in got:
        assert 4 <= len(r.positive) <= 7 and len(set(r.positive)) == len(r.positive)
        assert all(sorted(n) == sorted(r.positive) and n != r.positive for n in r.neg_images) and len(r.neg_captions) == 2
        assert all(not set(n) & set(r.positive) for n in r.neg_randoms)


def near_by_hand(points, limit):
    out = set()
    for i, (a, la, lo) in enumerate(points):
        for b, lb, ob in points:
            if a < b:
                h = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(ob - lo) / 2) ** 2
                if 2 * 6371008.8 * math.asin(min(1, math.sqrt(h))) <= limit:
                    out.add((a, b))
    return out


@pytest.mark.parametrize("radius", [150.0, 5000.0])
def test_near_pairs_everywhere_on_the_sphere(spark, radius):
    rng = random.Random(7)
    points, i = [], 0
    for lat, lng in [(0, 0.01), (48, 180), (48, -180), (-33, 179.999), (89.9995, 10), (90, 0), (-89.9999, -120), (60, 0), (80, -179.9999)]:
        for _ in range(25):
            i += 1
            d = radius / 60000
            la = max(-90.0, min(90.0, lat + rng.uniform(-d, d)))
            lo = (lng + rng.uniform(-d, d) / max(math.cos(math.radians(la)), 1e-4) + 540) % 360 - 180
            points.append((i, la, lo))
    df = spark.createDataFrame(points, "id long, lat double, lng double")
    got = {(r.id_a, r.id_b) for r in spatial.near_pairs(df, radius).collect()}
    assert got == near_by_hand(points, radius) and spatial.near_pairs(df.limit(0), radius).count() == 0


def test_locations_that_are_none(spark):
    rows = [(1, 1.0, 2.0), (2, None, 2.0), (3, float("nan"), 2.0), (4, float("inf"), 1.0), (5, 91.0, 0.0), (6, 0.0, 0.0), (7, 0.0, 5.0), (None, 1.0, 1.0), (1, 1.0, 2.0), (8, 1.0, -180.5)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "listing_id long, lat double, lng double, id string")
    assert {(r.id, r.lat) for r in spatial.located(df.drop("id"), "listing_id").collect()} == {(1, 1.0), (7, 0.0)}


def test_regions(spark):
    square = lambda a, b, c, d: [(a, b), (a, d), (c, d), (c, b)]
    areas = [
        (1, square(0, 0, 10, 10), square(4, 4, 6, 6)), (2, list(reversed(square(0, 0, 10, 10))) + [(10.0, 0.0)], None), (3, [(10.0, 170.0), (10.0, -170.0), (20.0, -170.0), (20.0, 170.0)], [(14.0, -179.0), (14.0, -175.0), (16.0, -175.0), (16.0, -179.0)]),
        (4, None, None), (5, [(1.0, 1.0), (2.0, 2.0)], None), (6, [(0.0, 0.0), (0.0, 0.001), (0.001, 0.0)], None),
    ]
    a = spark.createDataFrame([(i, None if r is None else [dict(lat=float(x), lng=float(y)) for x, y in r], None if h is None else [dict(lat=float(x), lng=float(y)) for x, y in h]) for i, r, h in areas], "region long, ring array<struct<lat: double, lng: double>>, hole array<struct<lat: double, lng: double>>")
    p = spark.createDataFrame([(1, 5.0, 5.0), (2, 3.0, 3.0), (3, 15.0, 179.0), (4, 15.0, -179.5), (5, 15.0, -177.0), (6, 15.0, 0.0), (7, 0.0002, 0.0002), (8, -1.0, 5.0), (9, 15.0, 180.0)], "id long, lat double, lng double")
    got = {(r.id, r.region) for r in spatial.in_regions(p, a).collect()}
    assert got == {(1, 2), (2, 1), (2, 2), (3, 3), (4, 3), (7, 1), (7, 2), (7, 6), (9, 3)}


def test_nested_nodes(spark):
    shapes, root = {"A": {"groups": {"items": {"options": {}}}}}, ("data", "list")
    body = {"data": {"list": [{"sectionId": "X"}, None, {"sectionId": "A", "section": {"groups": [None, {"title": "g", "items": "bare"}, {"title": 5, "items": {"title": "one", "n": 1}}, "h", 7]}}, {"sectionId": "A", "section": {"groups": {"title": "lone"}}}, {"sectionId": "A", "section": None}, {"sectionId": ["A"]}]}}
    rows = [(1, json.dumps(body)), (2, "{"), (3, None), (4, '{"data": {}}'), (5, '{"data": {"list": NaN}}'), (None, json.dumps(body)), (6, ""), (7, json.dumps({"data": {"list": {"sectionId": "A", "section": {"groups": ["z"]}}}}))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, body string, key string")
    found = nested.nodes(df, "id", "body", root, "sectionId", "section", shapes)
    got = {(r.key, r.path, tuple(r.dewey), r.title) for r in found.collect()}
    assert got == {
        (1, "A/groups", (2, 1), "g"), (1, "A/groups/items", (2, 1, 0), "bare"), (1, "A/groups", (2, 2), None), (1, "A/groups/items", (2, 2, 0), "one"), (1, "A/groups", (2, 3), "h"), (1, "A/groups", (3, 0), "lone"), (7, "A/groups", (0, 0), "z"),
    }
    items = nested.table_of(found, "A/groups/items")
    parents = {r.node_key for r in nested.table_of(found, "A/groups").collect()}
    assert {r.parent_key for r in items.collect()} <= parents and items.where("fields is not null").first().fields == '{"n": 1}'
    deep = '{"data": ' * 50_000
    assert nested.nodes(spark.createDataFrame([(1, deep)], "id long, body string"), "id", "body", root, "sectionId", "section", shapes).count() == 0


def test_feature_tables(spark):
    m = lambda rows: arrays._encoded(__import__("pandas").Series([rows]), __import__("pandas").Series(["float64"]))[0]
    box, feature = m([[1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.0]]), m([[0.5, 0.25], [1.0, 2.0]])
    rows = [("7", "71", 1, "", feature), ("7", "71", 2, box, feature), ("7", "72", 3, box, feature), ("8", "x", 4, box, feature), ("8", "73", 5, "???", feature), ("9", "74", 6, None, None)]
    df = spark.createDataFrame(rows, "listing_id string, photo_id string, pos int, boxes string, features string")
    keys = spark.createDataFrame([(71,), (72,), (73,), (74,)], "photo_id long")
    kv = features.key_values(df, keys, "pos")
    assert [r.key for r in kv.collect()] == ["7-72"]  # the first copy of 71 has no boxes and hides the second
    flat = features.per_box(features.decoded(features.keyed(df, keys, "pos"), 2), ["listing_id", "photo_id"]).orderBy("box").collect()
    assert [(r.box, r.x1, r.y2, r.feature) for r in flat] == [(0, 1.0, 4.0, [0.5, 0.25]), (1, 5.0, 8.0, [1.0, 2.0])]
    images = spark.createDataFrame([(7, 71, b"x"), (7, 72, b"")], "listing_id long, photo_id long, content binary")
    found = features.build(images, lambda l, p, c: [(p, i, 0.9 - i / 10, 0.0, 0.0, 10.0, 10.0) for i in range(3)] if c else [], "image long, box int, confidence double, x1 double, y1 double, x2 double, y2 double", "image", 0.5, 0.3)
    assert [(r.image, r.box) for r in found.collect()] == [(71, 0)]


def test_highlights(spark):
    df = spark.createDataFrame([(["walk then stop"], [["walk next"]]), (None, None)], "i array<string>, p array<array<string>>")
    tagger = lambda s: [(w, "VB") for w in s.split()]
    got = phrases.highlights(df, "i", tagger, perturbations="p").collect()
    assert [(r.highlights, r.perturbation_highlights) for r in got] == [([["walk", "stop"]], [[["walk"]]]), (None, None)]


def test_near_pairs_of_ids_with_several_places(spark):
    rows = [(1, 10.0, 10.0), (1, 50.0, 50.0), (2, 10.0005, 10.0), (2, 50.0001, 50.0), (3, -10.0, 0.0)]
    got = spatial.near_pairs(spark.createDataFrame(rows, "id long, lat double, lng double"), 150.0).collect()
    assert [(r.id_a, r.id_b) for r in got] == [(1, 2)] and got[0].metres < 12


def test_flat_tables_hold_every_field(spark, tmp_path):
    bed = [{"kind": "cot", "count": 3}, {"kind": "cot", "count": "2"}, {"kind": None, "count": "two", "size": {"cm": [90, 200]}}, {"title": 5, "kind": 1, "count": 2.5}, "bare"]
    amenity = [{"title": "Dryer", "subtitle": "In the hallway", "available": True, "options": 7}, {"title": "Iron", "available": "yes", "options": [{"title": "x", "extra": 1}]}]
    body = {"data": {"merlin": {"pdpSections": [{"sectionId": "SLEEPING_ARRANGEMENT_DEFAULT", "section": {"arrangementDetails": [{"title": "r", "subtitle": "s", "beds": bed}]}}, {"sectionId": "AMENITIES_DEFAULT", "section": {"seeAllAmenitiesGroups": [{"title": "g", "__typename": "T", "amenities": amenity}]}}]}}}
    spark.createDataFrame([(1, json.dumps(body))], "page_id long, body string").write.parquet(f"{tmp_path}/room_pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW room_pages AS SELECT * FROM '{tmp_path}/room_pages.parquet/*.parquet'")
    got = {}
    for name in ("groups", "amenities", "options", "rooms", "beds"):
        df = records.QUERIES[f"p7_full_{name}"](spark, str(tmp_path))
        got[name] = sorted(map(tuple, df.collect()), key=str)
        assert got[name] == sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({records.ORACLE[f'p7_full_{name}']})").fetchall(), key=str)
    assert [r[3:] for r in got["beds"]] == [(None, "cot", 3, None), (None, "cot", 2, None), (None, None, None, '{"count":"two","size":{"cm":[90,200]}}'), (None, None, None, '{"title":5,"kind":1,"count":2.5}'), ("bare", None, None, None)]
    assert [r[3:] for r in got["amenities"]] == [("Dryer", "In the hallway", True, '{"options":7}'), ("Iron", None, None, '{"available":"yes"}')]
    assert got["groups"][0][3:] == ("g", "T", None) and got["rooms"][0][3:] == ("r", "s", None) and got["options"][0][3:] == ("x", '{"extra":1}')
