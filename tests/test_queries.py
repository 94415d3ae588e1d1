"""Every engine query against its SQL on the smallest tables."""

import os

import pytest

from radmine.plans.oracles import ORACLES
from radmine.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
#: Pairs of findings are too rare there.
PAIRS = {"pair_table", "pair_export", "pair_stats", "candidates_pair", "candidates_legacy"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def value(v):
    return f"{v:.9g}" if isinstance(v, float) else repr(v)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark_session, name):
    folder = DATA.replace("0.001", "0.01") if name in PAIRS else DATA
    df = QUERIES[name](spark_session, folder)
    c = duck(folder)
    want = c.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in sorted(want.columns)]
    b = sorted(tuple(value(r[i]) for i in order) for r in want.fetchall())
    a = sorted(tuple(value(v) for v in r) for r in df.select(*sorted(df.columns)).collect())
    assert a == b and a
