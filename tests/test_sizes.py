"""Queries on rows that the small tables lack: larger keys, anchors that overlap themselves, floats beside whole numbers."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from bulletinlake.plans import catalogue
from bulletinlake.plans import feed_queries, notice_queries, page_queries, stream_queries  # noqa: F401


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{file}'")
    rel = con.sql(catalogue.ORACLE_SQL[name])
    mine = [tuple(r) for r in catalogue.QUERIES[name](spark, str(folder)).select(*rel.columns).collect()]
    assert sorted(mine, key=repr) == sorted(rel.fetchall(), key=repr)
    return mine


def test_anchored_windows_leave_out_anchors_that_overlap_themselves(spark, tmp_path):
    texts = ["0123456789" + "Of " * 10, "0123456789" + "Of " * 4 + "Off and on once more", "short", None, r"0123456789a\Eb\Qc.*(d)[e] f \Ea\Eb\Q", "x" * 40]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)}), tmp_path / "documents.parquet")
    assert {r[0] for r in same_as_sql(spark, tmp_path, "anchored_windows")} == {1, 2, 3, 4}


def test_vector_literals_take_components_as_double(spark, tmp_path):
    x = np.nextafter(np.arange(-999, 1000, dtype=np.float32) / np.float32(1000), np.float32(-2))
    pq.write_table(pa.table({"vec_id": pa.array([1], pa.int64()), "embedding": pa.array([x.tolist()], pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    literal = same_as_sql(spark, tmp_path, "vector_literals")[0][1]
    assert literal == "[" + ",".join(str(int(np.floor(1000 * float(v)))) for v in x) + "]"


@pytest.mark.parametrize("key", [1, 9_999, 10_000, 6_000_000, 1_234_567_890_123])
def test_candidate_units_of_larger_numbers(spark, tmp_path, key):
    con = duckdb.connect()
    con.sql(f"COPY (SELECT {key}::BIGINT AS o_orderkey, DATE '1996-01-01' AS o_orderdate) TO '{tmp_path}/orders.parquet'")
    assert len(same_as_sql(spark, tmp_path, "candidate_units")) == (5 if key < 10_000 else 6)
