import random

from pyspark.sql import functions as F

from captionflow.llm import splits

IMAGES = "photo_id long, listing_id long, e long, unit string"


def by_hand(edges):
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {v: top(v) for v in parent}


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randint(1, 300), rng.randint(1, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1150)] + [(5000, 5000 + i) for i in range(1, 200)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {v: c for v, c in by_hand([e for e in edges if e[0] != e[1]]).items()}
    assert {r.v: r.component for r in splits.components(df).collect()} == want
    assert splits.components(df.limit(0)).count() == 0


def test_star_has_no_pairs(spark):
    rows = [(1, i, 0, "x") for i in range(50)] * 2 + [(0, 1, 0, "x"), (-1, 1, 0, "x"), (None, 2, 0, "x"), (5, None, 0, "x")]
    assert splits.star_links(spark.createDataFrame(rows, IMAGES), "listing_id", "photo_id").count() == 49


def test_splits_keep_groups_and_shares(spark):
    rng = random.Random(6)
    rows = [(rng.randint(1, 4000), rng.randint(1, 500), 0, "x") for _ in range(300)] + [(10_000 + i, 600 + i % 300, 0, "x") for i in range(3000)] + [(3, None, 0, "x"), (99_999, None, 0, "x"), (None, None, 0, "x"), (0, None, 0, "x")] + [(50_000 + i, 7, 0, "x") for i in range(1000)]
    df = spark.createDataFrame(rows, IMAGES)
    got = splits.split_units(df, "listing_id", "photo_id", {"train": 0.8, "valid": 0.1, "test": 0.1}).collect()
    where = {(r.kind, r.id): r.split for r in got}
    groups = {r.listing_id: r.group_id for r in splits.linked_groups(df, "listing_id", "photo_id").collect()}
    for listing, group in groups.items():
        assert where["entity", listing] == where["entity", group]
    owner = next((l for p, l, _, _ in rows if p == 3 and l is not None), None)
    if owner is not None:
        assert where["link", 3] == where["entity", owner]
    total = sum(r.n_rows for r in got)
    share = {s: sum(r.n_rows for r in got if r.split == s) / total for s in ("train", "valid", "test")}
    assert all(abs(share[s] - w) <= 0.005 for s, w in (("train", 0.8), ("valid", 0.1), ("test", 0.1)))
    assert total == len(rows)
    split = sorted((r.photo_id or 0, r.listing_id or 0, r.e, r.unit) for r in splits.split_rows(df, "listing_id", "photo_id", {"train": 0.8, "valid": 0.1, "test": 0.1}).collect())
    assert split == sorted((p or 0, l or 0, e, u) for p, l, e, u in rows)
    assert splits.split_units(df.limit(0), "listing_id", "photo_id", {"train": 0.8, "test": 0.2}).count() == 0


def test_every_row_gets_a_split(spark, tmp_path):
    shares = {"train": 0.8, "valid": 0.1, "test": 0.1}
    rows = [(i, i % 900, 0, "x") for i in range(1, 2001)] + [(None, 1000, 0, "x")] * 1000 + [(0, None, 0, "x")] * 900 + [(None, None, i, "y") for i in range(600)] + [(9999, None, 0, "x")]
    path = str(tmp_path / "images.parquet")
    spark.createDataFrame(rows, IMAGES).write.parquet(path)
    df = spark.read.parquet(path)
    got = splits.split_units(df, "listing_id", "photo_id", shares).collect()
    assert sum(r.n_rows for r in got) == len(rows) and len({(r.kind, r.id) for r in got}) == len(got)
    share = {s: sum(r.n_rows for r in got if r.split == s) / len(rows) for s in shares}
    assert all(abs(share[s] - shares[s]) < 0.01 for s in shares)
    none = {r.id: r for r in got if r.kind == "none"}
    assert all(r.unit is None for r in none.values()) and {r.split for r in none.values()} == set(shares)
    each = splits.split_rows(df.withColumn("split", F.lit("clash")).withColumn("kind", F.lit("clash")), "listing_id", "photo_id", shares).collect()
    assert len(each) == len(rows) and {r.split for r in each} == set(shares)
    assert len({r.split for r in each if r.photo_id == 0 and r.e == 0}) == 1  # copies of a row stay together
    assert splits.split_rows(df.limit(0), "listing_id", "photo_id", shares).count() == 0
