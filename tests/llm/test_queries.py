"""Registered queries: contract columns, and SQL where there is some."""

from __future__ import annotations

import duckdb
import pytest

pytest.importorskip("public_tokenizers")

from bulletinlake.llm import queries  # noqa: E402

COLUMNS = {
    "op1_simhash": "doc_id fingerprint component_id",
    "op2_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op3_pieces": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op4_html": "page_id url text n_chars",
    "op5_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op6_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op7_toxicity": "doc_id severity toxic",
    "op8_quality": "doc_id held_out score predicted",
    "op9_substring": "doc_id class_id passages",
    "op10_topk": "query_id rank vec_id score",
    "op11_collocations": "lang rank phrase a l r n score",
    "op12_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op13_sortmeans": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
}


def test_each_operator_has_its_query():
    assert sorted(queries.QUERIES) == sorted(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_rows_and_columns(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert set(COLUMNS[name].split()) <= set(df.columns) and df.count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, sf).select(*rel.columns)
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())
