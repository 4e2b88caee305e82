import os

import pytest

import __spark_entry__

ROOT = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(ROOT), reason="no test tables")


def test_every_statement_has_a_query():
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert "issues_by_type" in names


@needs_data
def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 5


@needs_data
@pytest.mark.parametrize("name", ["crawl_summary", "robots_decisions", "view_by_depth", "bfs_depths", "issues_by_severity", "url_parts"])
def test_against_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(ROOT):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{ROOT}/{f}'")
    got = __spark_entry__.queries()[name](spark, ROOT)
    want = db.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    rows = sorted(map(str, want.fetchall()))
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == rows
