"""Every registered query against its SQL oracle on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry

DATA = os.environ.get("WEFTMARK_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
WEB = sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in sorted(os.listdir(DATA)):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def clean(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", WEB)
def test_query_equals_oracle(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(clean(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert name in entry.oracle_sql()
    found = con.sql(entry.oracle_sql()[name])
    names = found.columns
    assert columns == sorted(names)
    assert got == sorted((tuple(clean(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)


@pytest.fixture
def cut_pages(spark, tmp_path):
    """Pages whose titles end inside a character reference, as titles cut to a length do."""
    page = "<!DOCTYPE html><html lang=\"en\"><head><title>{0}</title></head><body><article><h1>{0}</h1><p>b &amp; c</p></article></body></html>"
    titles = ["a &amp;&amp", "b &quot", "c &quo", "d &am", "e &ampquot;", "f &amp;"]
    spark.createDataFrame([(k, f"http://h{k}.example.com/", page.format(t)) for k, t in enumerate(titles)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["flagship_article_stats", "page_title"])
def test_cut_references_equal_oracle(spark, cut_pages, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{cut_pages}/pages.parquet/*.parquet'")
    found = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, cut_pages).select(*found.columns).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
