import pytest
from pyspark.sql import functions as F

from spindle.llm import warc
from tests.conftest import SMALL, duck, same_rows


def test_sql(spark):
    same_rows(warc.op9_warc_revisit(spark, SMALL), duck(SMALL, warc.OP9_SQL))


SCHEMA = "record_id long, url string, at long, revisit boolean, digest string, headers map<string,string>, extra int, slice int"


def test_resolution(spark):
    rows = [
        (1, "http://www.A.com/x/?utm_source=y#f", 10, False, "d1", {"etag": "1", "date": "a", "server": "s"}), (2, "https://a.com:443/x", 20, True, None, {"etag": "1", "date": "b", "server": "evil"}),
        (3, "https://user@a.com/x", 9000, True, None, {"etag": "2"}), (4, "a.com/x", 5, True, None, {"etag": "1"}), (5, "https://a.com/x", 9500, False, "d2", {"etag": "2"}),
        (6, "https://a.com/x/", 9500, True, None, {"date": "z"}), (7, None, 1, True, None, None), (8, None, None, False, "d3", None), (9, "b.com", 1, False, "d4", None), (9, "b.com", 1, False, "d4", None),
    ]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    got = {r["record_id"]: r for r in warc.resolve(df).collect()}
    assert warc.resolve(df).count() == len(rows)
    assert {k: (r["status"], r["source_id"], r["source_digest"]) for k, r in got.items()} == {
        1: ("full", 1, "d1"), 2: ("resolved", 1, "d1"), 3: ("mismatch", None, None), 4: ("missing", None, None), 5: ("full", 5, "d2"), 6: ("unchecked", 5, "d2"), 7: ("unchecked", 8, "d3"), 8: ("full", 8, "d3"), 9: ("full", 9, "d4"),
    }
    assert got[2]["merged"] == {"etag": "1", "date": "b", "server": "s"}
    assert got[6]["merged"] == {"etag": "2", "date": "z"}


def test_header_names_have_no_case(spark):
    rows = [
        (1, "a.com/", 1, False, "d1", {"ETag": "1", "Date": "a", "Server": "s"}), (2, "a.com/", 2, True, None, {"ETAG": "2"}), (3, "a.com/", 3, True, None, {"eTag": "1", "DATE": "b", "Server": "evil"}),
        (4, "a.com/", 4, True, None, {"Last-Modified": "x"}), (5, "b.com/", 1, False, "d2", {"Last-Modified": "x", "last-modified": "y"}), (6, "b.com/", 2, True, None, {"LAST-MODIFIED": "y"}), (7, "b.com/", 3, True, None, {"last-modified": "x"}),
    ]
    got = {r["record_id"]: (r["status"], r["merged"]) for r in warc.resolve(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)).collect()}
    assert [got[k][0] for k in range(1, 8)] == ["full", "mismatch", "resolved", "unchecked", "full", "resolved", "mismatch"]
    assert got[3][1] == {"etag": "1", "date": "b", "server": "s"} and got[5][1] == {"last-modified": "y"}


@pytest.mark.parametrize("size", [None, 1, 7, 300])
def test_ranges_do_not_matter(spark, size):
    """A hot URL over many slices."""
    rows = spark.range(400).select(
        F.col("id").alias("record_id"), F.lit("h.com/").alias("url"), (F.col("id") / 3).cast("long").alias("at"), (F.xxhash64("id") % 3 != 0).alias("revisit"), F.col("id").cast("string").alias("digest"), F.lit(None).cast("map<string,string>").alias("headers"),
    )
    source = rows.collect()
    got = {r["record_id"]: r["source_id"] for r in warc.resolve(rows, size).collect()}
    last = None
    for r in sorted(source, key=lambda r: (r["at"], r["record_id"])):
        last = last if r["revisit"] else r["record_id"]
        assert got[r["record_id"]] == last


def test_empty(spark):
    assert warc.resolve(spark.createDataFrame([], SCHEMA)).count() == 0
