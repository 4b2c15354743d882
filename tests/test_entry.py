"""The registered queries agree with their SQL on the smallest data."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
FEW = ["keyword_topk_global", "semantic_topk", "heading_paths", "lint_layout", "upsert_merge", "change_summary", "corpus_inspect"]


def _plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", FEW)
def test_query_like_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(DATA + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted([tuple(str(_plain(r[c])) for c in columns) for r in df.collect()])
    cursor = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    wanted = sorted([tuple(str(_plain(r[names.index(c)])) for c in columns) for r in cursor.fetchall()])
    assert rows == wanted


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
