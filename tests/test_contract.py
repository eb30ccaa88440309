"""Every registered query against its oracle, and the contract of the entry module."""

import os

import duckdb
import pytest
from compare import norm

import __spark_entry__ as contract
from surco.sources.adapters import TABLES

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()
# Every query by default; CORE_QUERIES=1 leaves out those that train many models.
SLOW = {"cross_validate", "permutation_importance", "rf_flat", "rf_hierarchical", "fit_final", "predict_map", "kmeans_groups", "pipeline"}
NAMES = sorted(set(QUERIES) - SLOW) if os.environ.get("CORE_QUERIES") else sorted(QUERIES)


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 120


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, sf_dir, oracle):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in ORACLES:
        assert rows, "no rows"
        return
    cur = oracle.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    got = sorted(tuple(norm(r[c]) for c in order) for r in rows)
    want = sorted(tuple(norm(r[cols.index(c)]) for c in order) for r in cur.fetchall())
    assert got == want


def test_entry(spark):
    assert contract.entry(spark).limit(1).collect()
