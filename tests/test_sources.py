import json

from pyspark.sql import functions as F

from captionflow.operators import detections
from captionflow.sources import files, search, sinks
from captionflow.streaming import captions as stream


def test_tsv_round_trip(spark, tmp_path):
    rows = [(7, 71, "u", 'a "quoted"\ttab'), (7, 72, "u", "two\nlines"), (8, 73, "u", ""), (9, 74, "", "x" * 200_000)]
    df = spark.createDataFrame(rows, "listing_id long, photo_id long, url string, caption string")
    sinks.write_tsv(df.withColumn("extra", F.lit(1)), str(tmp_path / "t"), ["listing_id", "photo_id", "url", "caption"])
    assert sorted(map(tuple, files.read_captions(spark, str(tmp_path / "t")).collect())) == sorted(rows)


def test_crlf_and_header(spark, tmp_path):
    (tmp_path / "a.tsv").write_bytes(b'1\t2\tu\t"say ""hi"""\r\n3\t4\tu\t\r\n')
    assert [r.caption for r in files.read_captions(spark, str(tmp_path / "a.tsv")).orderBy("listing_id").collect()] == ['say "hi"', ""]
    (tmp_path / "h.tsv").write_text("name\tcat\nsofa\tred\n")
    assert files.read_tsv(spark, str(tmp_path / "h.tsv"), "name string, cat string", header=True).first().name == "sofa"


def test_listing_documents(spark, tmp_path):
    for folder, body in [("a/1", '{"x": 1}'), ("b/1", '{"x": 2}'), ("a/2", "{broken"), ("b/2", '{"x": 3}'), ("a/x", "{}"), ("a/3", " ")]:
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "photos.json").write_text(body)
    got = {r.listing_id: json.loads(r.body)["x"] for r in files.read_listing_documents(spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 3}
    assert {r.reason for r in files.unreadable_documents(spark, str(tmp_path)).collect()} == {"corrupt", "empty"}


def test_lines_places_open_data(spark, tmp_path):
    (tmp_path / "listings.txt").write_text(" 1 \n2\n")
    assert [r.value for r in files.read_lines(spark, str(tmp_path), "listings.txt").collect()] == ["1", "2"]
    (tmp_path / "p.csv").write_text("h1,h2\nx,y\nz,w\n")
    assert [r.line for r in files.read_place_lines(spark, str(tmp_path / "p.csv")).collect()] == ["x,y", "z,w"]
    (tmp_path / "o.csv").write_text("A;B\n1;two\n")
    assert files.read_open_data(spark, str(tmp_path / "o.csv"), ["id", "name"]).first().asDict() == {"id": "1", "name": "two"}


def test_json_items_and_graph(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"listing_id": 7, "photo_id": 71, "instructions": ["a"]}]))
    assert files.read_json_items(spark, str(tmp_path / "d.json"), "item").first().instructions == ["a"]
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "s1_connectivity.json").write_text(json.dumps([{"image_id": "v", "included": True}, {"image_id": "w", "included": False}]))
    nodes = files.read_graph(spark, str(tmp_path / "g"))
    assert [tuple(r) for r in nodes.collect()] == [("s1", "v")] and files.panorama(nodes).count() == 36


def test_images_and_inference(spark, tmp_path):
    (tmp_path / "7-71.jpg").write_bytes(b"abc")
    (tmp_path / "7-72.jpg").write_bytes(b"bad")
    (tmp_path / "7-73.jpg").write_bytes(b"")
    images = files.read_images(spark, str(tmp_path))

    def decode(data):
        if bytes(data) == b"bad":
            raise ValueError
        return len(data), 2

    assert [(r.photo_id, r.width) for r in files.decoded_images(images, decode).collect()] == [(71, 3)]
    found = detections.infer(images, lambda batch: [([(0.9, "kitchen")], [], (0.1, True)) for _ in batch]).collect()
    assert {r.photo_id for r in found} == {71, 72} and found[0].category[0].name == "kitchen"


def test_other_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 3)], "k string, v int")
    sinks.write_key_values(df, "k", str(tmp_path / "kv"))
    assert sorted(r.key for r in files.read_keys(spark, str(tmp_path / "kv")).collect()) == ["a", "b"]
    sinks.write_key_values(spark.createDataFrame([("a", 9), ("c", 4)], "k string, v int"), "k", str(tmp_path / "kv"), mode="append", existing=files.read_keys(spark, str(tmp_path / "kv")))
    assert sorted(r.key for r in files.read_keys(spark, str(tmp_path / "kv")).collect()) == ["a", "b", "c"]
    sinks.write_partitioned_lines(df, "k", "v", str(tmp_path / "p"))
    assert {r.value for r in spark.read.text(str(tmp_path / "p")).where("k = 'a'").collect()} == {"2", "3"}
    sinks.write_json(df, str(tmp_path / "j"))
    sinks.write_lines(df, "v", str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3 and spark.read.text(str(tmp_path / "l")).count() == 3
    for reset in (False, True):
        sinks.write_documents(df, df, df, str(tmp_path / "s"), reset=reset)
    assert spark.read.parquet(str(tmp_path / "s/rooms")).count() == 3
    assert sinks.quarantine(df, F.col("v") > 1, str(tmp_path / "bad")).count() == 2 and spark.read.json(str(tmp_path / "bad")).count() == 1


def test_search_source(spark, tmp_path):
    (tmp_path / "town_50.json").write_text('{"a": 1}')
    (tmp_path / "town_0.json").write_text("{")
    search.register(spark)
    assert [(r.name, r.offset) for r in spark.read.format("stored_search").load(str(tmp_path)).collect()] == [("town", 50)]


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("1\t1\tu\tcap\n1\t2\tu\tcap\n1\t3\tu\t.\n2\t4\tu\tcap\n")
    first = stream.first_uses(stream.caption_stream(spark, str(tmp_path / "in")))
    q = first.writeStream.format("memory").queryName("uses").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.listing_id, r.caption) for r in spark.table("uses").collect()} == {(1, "cap"), (2, "cap")} and spark.table("uses").count() == 2
    spark.createDataFrame([(i, f"2024-01-0{1 + i % 3} 10:00:00", "a") for i in range(6)], "i int, t string, k string").withColumn("t", F.to_timestamp("t")).write.parquet(str(tmp_path / "ev"))
    events = spark.readStream.schema("i int, t timestamp, k string").parquet(str(tmp_path / "ev"))
    q = stream.windowed_counts(events, "t", "k").writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.table("days").collect()] == [2, 2, 2]
