"""Every registered query with an oracle gives the rows of its SQL on the smallest tables."""

import math

import duckdb
import pytest

from strandlake.plans.catalogue import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    return repr(round(x, 9)) if isinstance(x, float) else str(list(x)) if isinstance(x, (list, tuple)) else str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    if name not in ORACLE:
        return
    answer = duck.execute(ORACLE[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted([plain(r[i]) for i in at] for r in answer.fetchall())
