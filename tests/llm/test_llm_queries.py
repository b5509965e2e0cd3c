"""Registered queries against their DuckDB twins, and the pipeline stage by stage."""

import glob
import os

import corpus_pipeline
import duckdb
import pandas as pd
import pytest
from cases import no_documents, odd_documents

from notelattice.llm import oracle, queries

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


def test_one_query_each():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.REGISTRY) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.REGISTRY))
def test_query(spark, duck, name):
    got = queries.REGISTRY[name](spark, SF_DIR).toPandas()
    assert len(got)
    if name in oracle.STATEMENTS:
        want = duck.execute(oracle.STATEMENTS[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert set(ids) <= before
        if name == "SimHash near-dedup":
            assert len(ids) == len(set(ids)) < len(before)
        if name == "language ID":
            assert set(ids) == before
    packed = corpus_pipeline.run(spark, SF_DIR).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048


@pytest.mark.parametrize("make", [odd_documents, no_documents])
def test_stages_take_odd_documents(spark, make):
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, make(spark), SF_DIR).collect()
