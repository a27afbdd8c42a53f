import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
import verify

SMALL = "/root/testdata/sf0.001"
#: One of each family; ``verify.py`` compares all of them.
CHECKED = ("captions_empty_strict", "perturb_two_directions", "perturb_remain", "room_groups_balanced", "box_suppressed", "trajectories_fixed", "tsv_round_trip", "download_audit", "stream_windows", "p7_found")


def test_flagship_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["listing_id", "photo_id", "pos", "instructions"]


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_a_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    relation = con.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, SMALL)
    assert sorted(df.columns) == sorted(relation.columns)
    got = verify.frame([tuple(r) for r in df.collect()], df.columns)
    assert verify.canon(got) == verify.canon(verify.frame(relation.fetchall(), relation.columns))
