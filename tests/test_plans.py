import duckdb
import pytest

import __spark_entry__ as entry
from cadenza.plans import registry
from tests.conftest import SF_SMALL
from tools.oracle_check import TABLES, compare

entry.queries()
KEYS = sorted(registry.QUERIES)  # the optional corpus queries have tests of their own


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "severity" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    # operators without a SQL form are few and named
    own = set(registry.QUERIES)
    assert own - set(entry.oracle_sql()) == {"train_score_ml"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_plan_matches_sql(spark, duck, key):
    sdf = entry.queries()[key](spark, SF_SMALL).toPandas()
    sql = entry.oracle_sql().get(key)
    if sql is None:  # the iterative fit against the exact one
        sql = entry.oracle_sql()["train_fixed_effects"]
        want = duck.execute(sql).fetchdf()["predicted"].sort_values(ignore_index=True)
        got = sdf["predicted"].sort_values(ignore_index=True)
        assert len(got) == len(want) and (got - want).abs().max() < 0.05
        return
    status, msg = compare(sdf, duck.execute(sql).fetchdf())
    assert status == "OK", msg
