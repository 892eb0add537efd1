"""Registered queries against DuckDB SQL, and every operator on awkward and empty tables."""

import os

import duckdb
import pytest

from tests.conftest import SF_SMALL
from turnwise import llm

from .cases import edge_docs, empty_docs, write_tables

KEYS = ["op1_secret_scan", "op2_bpe_codec", "op3_language_id", "op4_simhash_near_dedup", "op5_sharding",
        "op6_quality_classifier", "op7_exact_dedup", "op8_mixing", "op9_license_scan", "op10_document_fingerprints", "op13_ppm_score"]
OTHER_TABLES = ["op11_vector_codes", "op12_prefix_trie"]  # awkward tables of theirs: test_codes_tries_lm


def _compare(spark, key, folder, files):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "conversations"):
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet{files}')")
    df = llm.queries()[key](spark, str(folder))
    res = con.execute(llm.oracle_sql()[key])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(r[cols.index(c)] for c in df.columns) for r in res.fetchall()), key=str)
    assert sorted((tuple(r) for r in df.collect()), key=str) == want


def test_all_registered():
    assert sorted(llm.queries()) == sorted(KEYS + OTHER_TABLES)


@pytest.mark.parametrize("key", sorted(llm.oracle_sql()))
def test_given_tables(spark, key):
    _compare(spark, key, SF_SMALL, "")


@pytest.mark.parametrize("key", sorted(set(llm.oracle_sql()) - set(OTHER_TABLES)))
def test_awkward_table(spark, key, tmp_path):
    _compare(spark, key, write_tables(spark, tmp_path, edge_docs(spark)), "/*.parquet")


@pytest.mark.parametrize("key", KEYS)
def test_every_row_once(spark, key, tmp_path):
    docs = edge_docs(spark)
    folder = write_tables(spark, tmp_path, docs, [(7, 1, 0), (49, 0, 0), (None, 1, None), (7, 1, 0)])
    df = llm.queries()[key](spark, folder)
    got = sorted((r["doc_id"] for r in df.collect()), key=str)
    assert got == sorted((r["doc_id"] for r in docs.collect()), key=str)


@pytest.mark.parametrize("key", KEYS)
def test_empty_table(spark, key, tmp_path):
    assert llm.queries()[key](spark, write_tables(spark, tmp_path, empty_docs(spark))).collect() == []
