"""Exact top-k inner products over an impact-ordered, score-at-a-time index.

Components are quantised to ``floor(scale * x)``. Vectors lie in blocks; a block's postings
(component, vector, value) are held in segments of one impact level each, the bit length of the
value's magnitude, highest first. A block of queries goes through a block's segments in that
order and adds scores. After each segment a vector's rest (its values in lower segments) has a
known norm, so each score has exact bounds: rest times query norm, by Cauchy and Schwarz. A
query stops when the k-th best lower bound proves all but a few vectors out, or when no segment
is left; the possible members are rescored in integers. Ties go to the smaller vec_id, so
vectors at the threshold itself are never proved out.

A block's segments are made once for some query blocks, which are sent to it. The queries go through one block
first: the k-th best score found there is their floor in all other blocks, where vectors under it are
out and whole blocks too, if query norm times their longest vector is under it. The best k of each
block are merged by query.

Vectors that are null, or hold a null, NaN or infinite component, and rows without vec_id take no
part. Vectors of other lengths are padded with zeros. Rows that share a query's vec_id are its
own and no candidates; repeated query rows each get their result. Scores are exact while sums
stay under 2**53. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import pick, stash

FEW = 64
QUERY_BLOCKS = 16  # query blocks that go through one copy of an index


def segments(values: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The block's postings by impact level (bit length of the magnitude), highest first: level, component, vector, value."""
    component, vector = np.nonzero(values.T)
    impact = values[vector, component]
    level = np.frexp(np.abs(impact).astype(np.float64))[1]
    out = []
    for b in np.unique(level)[::-1].tolist():
        at = level == b
        out.append((b, component[at].astype(np.int32), vector[at].astype(np.int32), impact[at].astype(np.float64)))
    return out


class Index:
    """A block of vectors: its posting segments and, after each of them, the norm of what is left of every vector."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values, self.levels, self.rest = ids, values, segments(values), []
        left = (values.astype(np.float64) ** 2).sum(1)
        self.norm = np.sqrt(left)
        for _, _, vector, impact in self.levels:
            left = np.maximum(left - np.bincount(vector, impact * impact, len(values)), 0)
            self.rest.append(np.sqrt(left))
        self.read = self.offered = 0  # postings read for queries, and what there were

    def top(self, q_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> Iterator[tuple[int, int, int]]:
        """(query row, vec_id, score) of the k best of each query, ties to smaller ids; ``floor``: scores under which nobody counts."""
        n = len(self.values)
        qf = queries.astype(np.float64)
        norm = np.sqrt((qf * qf).sum(1))
        floor = np.full(len(queries), -np.inf) if floor is None else floor
        self.offered += len(queries) * sum(len(v) for _, _, v, _ in self.levels)
        scores = np.zeros((len(queries), n))
        own = q_ids[:, None] == self.ids[None, :]
        # by Cauchy and Schwarz nobody in the block reaches the floor of some queries
        active = np.flatnonzero(norm * self.norm.max(initial=0) * (1 + 1e-9) + 1e-6 >= floor)
        possible: dict[int, np.ndarray] = {}
        steps = [*zip(self.levels, self.rest)] or [((0, *(np.empty(0, np.int32),) * 2, np.empty(0)), np.zeros(n))]
        for at, ((_, component, vector, impact), rest) in enumerate(steps):
            if not len(active):
                break
            part = np.zeros((qf.shape[1], n))
            part[component, vector] = impact
            scores[active] += qf[active] @ part
            self.read += len(active) * len(vector)
            slack = norm[active, None] * rest[None, :] * (1 + 1e-9) + 1e-6
            low = np.where(own[active], -np.inf, scores[active] - slack)
            bar = np.partition(low, n - k, axis=1)[:, n - k] if n >= k else np.full(len(active), -np.inf)
            bar = np.maximum(bar, floor[active])
            maybe = (scores[active] + slack >= bar[:, None]) & ~own[active]
            done = (maybe.sum(1) <= max(FEW, k)) | (at == len(steps) - 1)
            for row, members in zip(active[done].tolist(), maybe[done]):
                possible[row] = np.flatnonzero(members)
            active = active[~done]
        for row, members in possible.items():
            exact = self.values[members] @ queries[row]
            for i in np.lexsort((self.ids[members], -exact))[:k].tolist():
                yield row, int(self.ids[members[i]]), int(exact[i])


def _pack(scale: float):
    """All rows of one block to one row: ids, values and floors as little-endian 64-bit numbers."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        vectors = table["embedding"].to_pylist()
        dim = max(map(len, vectors))
        values = np.zeros((len(vectors), dim))
        for i, v in enumerate(vectors):
            values[i, : len(v)] = v
        values = np.floor(scale * values).astype("<i8")
        floors = np.array([-np.inf if x is None else x for x in table["floor"].to_pylist()], "<f8")
        cols = [pa.array([key[0].as_py()], pa.int64()), pa.array([dim], pa.int32())]
        cols += [pa.array([np.array(table[c].to_pylist(), "<i8").tobytes()], pa.binary()) for c in ("rid", "vec_id")] + [pa.array([x.tobytes()], pa.binary()) for x in (values, floors)]
        return pa.table(cols, names=["block", "dim", "rids", "ids", "values", "floors"])

    return run


PACKED = "block long, dim int, rids binary, ids binary, values binary, floors binary"


def _scan(k: int):
    """Rows sorted by (block, salt, kind): a block's vectors are indexed once, then its query blocks go through the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = values = None
        for batch in batches:
            for row in batch.to_pylist():
                some = np.frombuffer(row["values"], "<i8").reshape(-1, row["dim"])
                ids = np.frombuffer(row["ids"], "<i8")
                if row["kind"] == 0:
                    values, index = some, None
                    held = ids
                    continue
                dim = max(some.shape[1], values.shape[1])
                if index is None or index.values.shape[1] != dim:
                    index = Index(held, np.pad(values, ((0, 0), (0, dim - values.shape[1]))))
                queries = np.pad(some, ((0, 0), (0, dim - some.shape[1])))
                rids = np.frombuffer(row["rids"], "<i8")
                found = list(index.top(ids, queries, k, np.frombuffer(row["floors"], "<f8")))
                cols = ([int(rids[f[0]]) for f in found], [int(ids[f[0]]) for f in found], [f[1] for f in found], [f[2] for f in found])
                yield pa.record_batch([pa.array(x, pa.int64()) for x in cols], names=["rid", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: str, k: int = 5, scale: float = 256.0, query_rows: int = 512, block_rows: int = 4096) -> DataFrame:
    """``vectors(vec_id, embedding)`` to ``(query_id, rank, vec_id, score)``; ``is_query``: SQL over vec_id."""
    usable = pick(vectors, vec_id="vec_id", embedding="embedding").where("vec_id is not null and embedding is not null").selectExpr("cast(vec_id as long) as vec_id", "transform(embedding, x -> cast(x as double)) as embedding")
    usable = usable.where("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))").withColumn("rid", F.monotonically_increasing_id())
    rows = stash(usable, "vectors")
    n, n_queries = rows.agg(F.count("*"), F.count_if(F.expr(is_query))).first()
    c_blocks, q_blocks = max(1, -(-n // block_rows)), max(1, -(-n_queries // query_rows))

    def packed(df: DataFrame, blocks: int) -> DataFrame:
        dealt = df.withColumn("_block", F.pmod(F.xxhash64("rid"), F.lit(blocks)))
        return dealt.groupBy("_block").applyInArrow(_pack(scale), PACKED)

    blocks = stash(packed(rows.withColumn("floor", F.lit(None).cast("double")), c_blocks), "blocks")

    salts = max(1, -(-q_blocks // QUERY_BLOCKS))

    def scanned(queries: DataFrame, first: int, last: int) -> DataFrame:
        """The k best of each query in each of the blocks first..last; a task has one block and at most ``QUERY_BLOCKS`` or so of query blocks."""
        sent = queries.withColumn("salt", F.pmod("block", F.lit(salts))).withColumn("block", F.explode(F.sequence(F.lit(first), F.lit(last)).cast("array<long>"))).withColumn("kind", F.lit(1))
        held = blocks.where(F.col("block").between(first, last)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>"))).withColumn("kind", F.lit(0))
        dealt = held.unionByName(sent).repartition((last - first + 1) * salts, "block", "salt").sortWithinPartitions("block", "salt", "kind")
        return dealt.mapInArrow(_scan(k), "rid long, query_id long, vec_id long, score long")

    asked = rows.where(is_query)
    best = stash(scanned(packed(asked.withColumn("floor", F.lit(None).cast("double")), q_blocks), 0, 0), "first_block")
    if c_blocks > 1:
        # what k vectors of the first block reach is a floor in all others
        floors = best.groupBy("rid").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor")).where(F.col("n") >= k).select("rid", "floor")
        best = best.unionByName(scanned(packed(asked.join(floors, "rid", "left"), q_blocks), 1, c_blocks - 1))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 50 = 0")


OP10_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
