"""Every registered query with an SQL twin, whole results compared; the others must return rows.

The table folder is sf0.001 unless TEST_SF_DIR names another one.
"""

import importlib.util
import inspect
import os

import duckdb
import pytest

from airframe.plans import regress, workflows
from airframe.plans.base import STATIONS

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def load(name, path):
    spec = importlib.util.spec_from_file_location(name, os.path.join(ROOT, path))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


entry = load("entry_module", "__spark_entry__.py")
check = load("check_module", "tools/check.py")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(df.columns) == {"station", "date", "min_aqi", "max_aqi", "mean_aqi", "hours", "category"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = check.canonical([tuple(r) for r in df.collect()], df.columns)
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert got == check.canonical(cur.fetchall(), names)


#: Model queries, registered at 300 trees and 300 rounds; here with sizes that take seconds.
SIZED = {
    "train_forest": (regress.train_forest, {"trees": 5}, 1),
    "train_gbt": (regress.train_gbt, {"rounds": 5}, 1),
    "train_and_rank": (regress.train_and_rank, {"trees": 3, "rounds": 3}, 4),
    "feature_importance": (regress.feature_importance, {"trees": 5}, 5),
    "permutation_importance": (regress.permutation_importance, {"trees": 5}, 5),
    "run_training": (workflows.run_training, {"trees": 3, "rounds": 3}, 4),
    "run_serve": (workflows.run_serve, {"trees": 3, "rounds": 3}, 72 * STATIONS),
}


@pytest.mark.parametrize("name", sorted(SIZED))
def test_model_queries(spark, sf, name):
    query, sizes, rows = SIZED[name]
    assert {p.default for k, p in inspect.signature(query).parameters.items() if k in sizes} == {300}
    assert query(spark, sf, **sizes).count() == rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - set(SIZED)))
def test_returns_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
