"""Rows made of documents, range-partitioned by two whole numbers without being made twice.

``repartitionByRange`` runs what makes its rows once to sample them and again to shuffle them. Here the
bounds come from a sample of the documents, so the rest are read once; bounds decide only where a row
is worked on, never what comes out. The sample is ``DOCS`` documents and ``ROWS`` rows for each
partition, the latter's keys being all that the driver gets.

A first key that many rows hold spreads over partitions by the second. An empty table has no bounds
and one partition with rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOCS = 20
ROWS = 100
SEED = 7


def part_of(a: np.ndarray, b: np.ndarray, a_bounds: np.ndarray, b_bounds: np.ndarray) -> np.ndarray:
    """How many of the ascending bounds are not above each (a, b)."""
    low, high = (np.searchsorted(a_bounds, a, side) for side in ("left", "right"))
    part = low.astype(np.int32)
    same = np.flatnonzero(low != high)
    for at in np.unique(low[same]).tolist():
        rows = same[low[same] == at]
        part[rows] = at + np.searchsorted(b_bounds[at : high[rows[0]]], b[rows], "right")
    return part


def _bounds(rows: DataFrame, first: str, second: str, parts: int) -> tuple[np.ndarray, np.ndarray]:
    found = rows.select(first, second).orderBy(F.rand(SEED)).limit(parts * ROWS).toArrow()
    a, b = (found[c].to_numpy() for c in (first, second))
    order = np.lexsort((b, a))
    at = np.arange(1, parts) * len(order) // parts
    return (a[order][at], b[order][at]) if len(order) else (a, b)


def packed(docs: DataFrame, n_docs: int, emit: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, first: str, second: str, parts: int) -> DataFrame:
    """As ``ranged`` in ``parts`` partitions, but what a batch of ``emit`` has for a partition is one row: each column (of numbers) as bytes.

    ``unpacked`` reads all of a partition; choose ``parts`` so that this fits a task.
    """
    share = parts * DOCS / max(1, n_docs)
    sampled = docs.sample(share, SEED) if share < 1 else docs
    bounds = _bounds(sampled.mapInArrow(emit, schema), first, second, parts)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in emit(batches):
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            part = part_of(*(cols[b.schema.names.index(c)] for c in (first, second)), *bounds)
            order = np.argsort(part, kind="stable")
            part = part[order]
            starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.empty(0, np.int64)
            ends = [*starts[1:].tolist(), len(part)]
            out = [pa.array([c[order[s:e]].tobytes() for s, e in zip(starts.tolist(), ends)], pa.binary()) for c in cols]
            yield pa.record_batch([*out, pa.array(part[starts], pa.int32())], names=[*b.schema.names, "_part"])

    names = [x.split()[0] for x in schema.split(", ")]
    return docs.mapInArrow(placed, ", ".join(f"{n} binary" for n in names) + ", _part int").repartitionById(parts, F.col("_part")).drop("_part")


def unpacked(batches: Iterator[pa.RecordBatch], kinds: dict[str, str]) -> list[np.ndarray]:
    """All rows of a partition of ``packed``, a column each of ``kinds`` (numpy types), in no order."""
    held: list[list[bytes]] = [[] for _ in kinds]
    for b in batches:
        for some, name in zip(held, kinds):
            some.extend(b[name].to_pylist())
    return [np.frombuffer(b"".join(some), kind) for some, kind in zip(held, kinds.values())]


def ranged(docs: DataFrame, n_docs: int, emit: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, first: str, second: str) -> DataFrame:
    """``docs.mapInArrow(emit, schema)`` range-partitioned by the long columns ``first`` and ``second``, without nulls in them.

    ``n_docs`` is about the number of docs; the partitions are as many as ``spark.sql.shuffle.partitions``.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    share = parts * DOCS / max(1, n_docs)
    sampled = docs.sample(share, SEED) if share < 1 else docs
    bounds = _bounds(sampled.mapInArrow(emit, schema), first, second, parts)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in emit(batches):
            part = part_of(*(b[c].to_numpy(zero_copy_only=False) for c in (first, second)), *bounds)
            yield pa.record_batch([*b.columns, pa.array(part, pa.int32())], names=[*b.schema.names, "_part"])

    return docs.mapInArrow(placed, f"{schema}, _part int").repartitionById(parts, F.col("_part")).drop("_part")
