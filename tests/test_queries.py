import duckdb
import pytest
from conftest import SMALL

import __spark_entry__
from ledgerflow.plans import oracle, queries


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("orders", "customer"):
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def rows(names, records):
    tidy = lambda v: f"{v + 0.0:.6f}" if isinstance(v, float) else str(v)
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(tidy(r[k]) for k in order) for r in records)


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_oracle(spark, duck, name):
    got = queries.QUERIES[name](spark, SMALL)
    want = duck.sql(oracle.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
