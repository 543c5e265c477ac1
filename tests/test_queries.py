"""Every registered query over tracks against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from trackengine.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def text(value):
    if value is None or value != value:
        return "null"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    rows = sorted(tuple(text(r[c]) for c in sorted(got.columns)) for r in got.collect())
    if name in catalogue.ORACLES:
        want = con.sql(catalogue.ORACLES[name])
        assert sorted(want.columns) == sorted(got.columns)
        frame = want.fetchall()
        at = sorted(range(len(want.columns)), key=lambda k: want.columns[k])
        assert rows == sorted(tuple(text(r[k]) for k in at) for r in frame)
    else:
        assert rows


def test_entry_points():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark).collect()
    assert len(out) == 12 and [r["metric_pct"] for r in out] == sorted((r["metric_pct"] for r in out), reverse=True)
