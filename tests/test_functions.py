import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from captionflow import schemas
from captionflow.functions import arrays as A
from captionflow.functions import text as T
from captionflow.functions import views as V


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_every_schema_parses(spark):
    for name in schemas.names():
        assert len(schemas.schema(name)) > 0


def test_two_meanings_of_empty(spark):
    cases = ["", ".", " ,\n", "\t", " ", None, "a"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    got = {r.i: (r.p1, r.p2) for r in df.select("i", T.is_empty(F.col("c")).alias("p1"), T.is_captionless(F.col("c")).alias("p2")).collect()}
    assert got == {0: (True, True), 1: (True, False), 2: (True, False), 3: (False, True), 4: (False, True), 5: (True, True), 6: (False, False)}


def test_keys_and_paths(spark):
    got = one(spark, k=T.photo_key(F.lit(7), F.lit(71)), p=T.photo_of_key(F.lit("7-71")), q=T.photo_of_path(F.lit("/x/7_71.jpg")), n=T.photo_key(F.lit(None).cast("long"), F.lit(1)), bad=T.photo_of_key(F.lit("7-x")))
    assert got == {"k": "7-71", "p": 71, "q": 71, "n": None, "bad": None}


def test_names_and_vocabulary(spark):
    got = one(
        spark,
        s=T.scene_name(F.lit("/b/bow_window/indoor 12")), c=T.clean_category(F.lit("red (sofa); 12?")), r=T.raw_categories(F.lit("sofa\\tv/armchair (big)")),
        v=T.vocabulary_line(F.lit(" Sofa,couch")), l=T.location_slug(F.lit("New Town, Land")), t=T.spaced(F.lit("Turn left, then STOP.")),
        p=T.is_punctuation(F.lit(" ?!")), np=T.is_punctuation(F.lit("a!")), e=T.is_punctuation(F.lit("")),
    )
    assert got == {"s": "bow window", "c": "red sofa", "r": ["sofa", "armchair big"], "v": "sofa", "l": "new-town-land", "t": "turn left , then stop .", "p": True, "np": False, "e": False}


def test_replacing_and_masking(spark):
    got = one(
        spark,
        f=T.replace_first(F.lit("a red red sofa"), F.lit("red"), F.lit("blue")), k=T.keep_outer_space(F.lit(" sofa "), F.lit("lamp")), m=T.masked(F.lit(", the sofa.")),
        w=T.without_stop_words(F.lit("Walk to the sofa"), F.array(F.lit("to"), F.lit("the"))), s=T.sentence_starts(F.lit("One. Two. Three")),
    )
    assert got["f"] == "a blue red sofa" and got["k"] == " lamp " and got["w"] == "Walk sofa" and "[MASK]" in got["m"]
    assert [(r.text, r.start) for r in got["s"]] == [("One", 0), ("Two", 5), ("Three", 10)]


def test_vectors(spark):
    x = F.array(*[F.lit(v) for v in (1.0, 2.0, 4.0)])
    got = one(spark, s=A.softmax(x), d=A.cosine_distance(x, x), z=A.cosine_distance(x, F.array(*[F.lit(0.0)] * 3)), m=A.argmax(x), b=A.best_class(x), h=A.min_max_bytes(x), mv=A.matvec(F.array(x, x), x))
    e = np.exp(np.array([1, 2, 4.0]) - 4)
    assert np.allclose(got["s"], e / e.sum()) and abs(got["d"]) < 1e-12 and got["z"] is None and got["m"] == 2 and got["b"] == 4.0 and got["h"] == [0, 85, 255] and got["mv"] == [21.0, 21.0]


def test_matrices_round_trip(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]]), (2, []), (3, None)], "i int, m array<array<double>>")
    out = {r.i: r.x for r in df.select("i", A.decode_matrix(A.encode_matrix(F.col("m")), F.lit(2)).alias("x")).collect()}
    assert out == {1: [[1.0, 2.0], [3.0, 4.0]], 2: [], 3: None}
    assert spark.range(1).select(A.decode_matrix(F.lit("not base64!"), F.lit(2)).alias("x")).first().x is None
    p = spark.range(1).select(A.padded(F.array(F.array(F.lit(1.0), F.lit(2.0))), 3, 2).alias("p")).first().p
    assert p.rows == [[1.0, 2.0], [0.0, 0.0], [0.0, 0.0]] and p.mask == [1, 0, 0]


def test_channels_invert(spark):
    x = F.array(*[F.lit(float(v)) for v in (0, 128, 255, 10, 20, 30)])
    mean, std = [0.485, 0.456, 0.406], [0.229, 0.224, 0.225]
    got = spark.range(1).select(A.restored_channels(A.normalised_channels(x, mean, std), mean, std).alias("y")).first().y
    assert np.allclose(got, [0, 128, 255, 10, 20, 30])


def test_pairs(spark):
    got = one(spark, a=A.pairs_of(F.array(F.lit(1), F.lit(2), F.lit(3))), b=A.pairs_of(F.array(F.lit(1))))
    assert [(p.first, p.second) for p in got["a"]] == [(1, 2), (1, 3), (2, 3)] and got["b"] == []


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.floats(-50, 50))
def test_wrapped_angles(spark, angle):
    got = spark.range(1).select(V.wrapped(F.lit(angle)).alias("w")).first().w
    assert -math.pi < got <= math.pi and math.isclose(math.cos(got), math.cos(angle), abs_tol=1e-9)


def test_views(spark):
    got = one(spark, d=V.circular_difference(F.lit(0.1), F.lit(2 * math.pi - 0.1)), s=V.scale_factor(F.lit(400.0), F.lit(1000.0)), t=V.scale_factor(F.lit(1000.0), F.lit(800.0)), n=F.size(V.panorama_views(F.lit("s"), F.lit("v"))))
    assert math.isclose(got["d"], 0.2) and math.isclose(got["s"], 1.333) and got["t"] == 1.0 and got["n"] == 36
