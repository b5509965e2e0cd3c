"""Every registered query against its DuckDB twin on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from notelattice.plans import oracle
from notelattice.plans.queries import REGISTRY

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for file in glob.glob(f"{SF_DIR}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return db


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(None if pd.isna(v) else v for v in r) for r in frame.values.tolist()), key=repr)


def test_every_query_has_a_twin():
    assert REGISTRY.keys() == oracle.statements().keys()
    assert REGISTRY.keys() <= entry.queries().keys() and entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, duck, name):
    got = REGISTRY[name](spark, SF_DIR).toPandas()
    want = duck.execute(oracle.statements()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["slug", "title", "preview", "rank"]
