"""Centroid clustering by sort-means over whole-number vectors, exact to the last unit.

Components are ``floor(scale * x)``. Each round assigns every vector to its nearest centroid (squared
Euclidean distance, ties to the smaller number) and then moves each centroid to the floor of its
vectors' mean; one without vectors stays. After the last round vectors are assigned once more.

Sort-means: at the start of a round every centroid gets the list of the others by distance from it, nearest first. A
vector knows the centroid it was assigned to in the round before (in the first round: 0) and its
distance d to it, and scans that centroid's list. A centroid further than 2d from the own one is
further than d from the vector (triangle inequality), so the scan stops there; at exactly 2d it may tie
and is still looked at. Vectors of one centroid are scanned together, those with the greatest d first, so at
each place of the list those that still scan are a beginning of them.

Scale: each round reads the vectors once and writes them with their assignment, for the next round to begin
from; the table of the round before goes. Tasks return one row of sums for each centroid that they met, which Spark adds up.
Only centroids (k of them) and their sums pass through the driver and travel with the tasks. A cluster that a third of all
vectors fall into is a sum like the others.

Kept are vectors of exactly ``dim`` components, none null, NaN or infinite. First centroids are the ``k``
kept vectors of smallest ``sha256("<seed>:<vec_id>")`` (null vec_id: "<seed>:"; among equal ids the
smaller vector), all of them if there are fewer. Repeated rows are vectors of their own. Distances
must fit a long: a component that scales beyond 2**27 either way raises. Other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import drop, pick, stash

GREATEST = 1 << 27  # of a scaled component, either way: 64 squared differences of twice that fit a long
AT_ONCE = 8192  # vectors that are scanned together


def neighbours(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The other centroids of each by distance from it (ties by number), and the squared distances."""
    apart = np.array([((centroids - c) ** 2).sum(1) for c in centroids])
    np.fill_diagonal(apart, -1)
    order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
    return order, np.take_along_axis(apart, order, 1)


def nearest(vectors: np.ndarray, centroids: np.ndarray, order: np.ndarray, apart: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and squared distance of each vector, scanning from ``before``; and how many distances that took."""
    cluster, distance = before.copy(), np.zeros(len(vectors), np.int64)
    taken = len(vectors)
    for own in np.unique(before).tolist():
        rows = np.flatnonzero(before == own)
        first = ((vectors[rows] - centroids[own]) ** 2).sum(1)
        deepest = np.argsort(-first, kind="stable")
        rows, first = rows[deepest], first[deepest]
        best, where = first.copy(), np.full(len(rows), own)
        some = vectors[rows]
        for other, between in zip(order[own].tolist(), apart[own].tolist()):
            n = int(np.searchsorted(-4 * first, -between, "right"))  # those with 4 d^2 >= between
            if not n:
                break
            new = ((some[:n] - centroids[other]) ** 2).sum(1)
            taken += n
            better = (new < best[:n]) | ((new == best[:n]) & (other < where[:n]))
            best[:n][better], where[:n][better] = new[better], other
        cluster[rows], distance[rows] = where, best
    return cluster, distance, taken


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, AT_ONCE):
            yield b.slice(at, AT_ONCE)


def _assign(centroids: np.ndarray):
    """Vectors with the cluster of the round before to their new cluster and distance."""
    order, apart = neighbours(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            cluster, distance, _ = nearest(_matrix(b["vector"], centroids.shape[1]), centroids, order, apart, b["cluster"].to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.record_batch([b["vec_id"], b["vector"], pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "vector", "cluster", "distance"])

    return run


ASSIGNED = "vec_id long, vector array<int>, cluster int, distance long"


def _sums(k: int, dim: int):
    """A task's vectors to the sum of each cluster that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in _parts(batches):
            cluster = b["cluster"].to_numpy(zero_copy_only=False)
            vectors = _matrix(b["vector"], dim)
            for c in np.unique(cluster).tolist():
                own = vectors[cluster == c]
                n[c] += len(own)
                total[c] += own.sum(0)
        met = np.flatnonzero(n)
        yield pa.record_batch([pa.array(met, pa.int32()), pa.array(n[met]), pa.array(list(total[met]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def moved(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the floor of its vectors' mean; those without vectors where they were."""
    k, dim = centroids.shape
    parts = assigned.select("vector", "cluster").mapInArrow(_sums(k, dim), "cluster int, n long, sums array<long>")
    totals = parts.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)])
    out = centroids.copy()
    for row in totals.collect():  # at most k rows
        out[row["cluster"]] = [int(row[f"s{i}"]) // int(row["n"]) for i in range(dim)]
    return out


def usable(vectors: DataFrame, dim: int, scale: float) -> DataFrame:
    """``(vec_id, vector, cluster)`` of the kept vectors, all in cluster 0."""
    rows = pick(vectors, vec_id="vec_id", embedding="embedding").selectExpr("cast(vec_id as long) as vec_id", "transform(embedding, x -> cast(x as double)) as e")
    kept = rows.where(f"size(e) = {dim} and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    too_large = f"raise_error('a component scales beyond {GREATEST}')"
    return kept.selectExpr("vec_id", f"transform(e, x -> case when abs({scale}D * x) < {GREATEST}D then cast(floor({scale}D * x) as int) else cast({too_large} as int) end) as vector", "0 as cluster")


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: float = 256.0, seed: int = 2) -> tuple[DataFrame, np.ndarray]:
    """``vectors(vec_id, embedding)`` to ``(vec_id, vector, cluster, distance)`` and the final centroids."""
    rows = stash(usable(vectors, dim, scale), "vectors")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(drawn, "vector").limit(k).select("vector").collect()  # k rows
    centroids = np.array([r["vector"] for r in first], np.int64).reshape(-1, dim)
    if not len(centroids):
        return rows.select("vec_id", "vector", "cluster", F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        now = stash(rows.mapInArrow(_assign(centroids), ASSIGNED), "round")
        drop(rows)
        centroids = moved(now, centroids)
        rows = now
    last = stash(rows.mapInArrow(_assign(centroids), ASSIGNED), "assigned")
    drop(rows)
    return last, centroids


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def op13_sortmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    each = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # at most k rows
    inertia = sum(int(r["s"]) for r in each)
    known = [(r["cluster"], int(r["s"]), inertia, digest(centroids[r["cluster"]])) for r in each]
    about = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql_rounds(rounds: int) -> str:
    out = []
    for i in range(rounds + 1):
        out.append(f"""
d{i} AS (
  SELECT v.rid, v.e, c.cluster, CAST(list_sum([(v.e[i] - c.e[i]) * (v.e[i] - c.e[i]) FOR i IN range(1, 65)]) AS BIGINT) AS distance
  FROM v CROSS JOIN c{i} c),
a{i} AS (SELECT rid, any_value(e) AS e, arg_min(cluster, distance * 64 + cluster) AS cluster, min(distance) AS distance FROM d{i} GROUP BY rid)""")
        if i < rounds:
            out.append(f"""
s{i} AS (
  SELECT cluster, i, count(*) AS n, CAST(sum(x) AS BIGINT) AS s
  FROM (SELECT cluster, unnest(range(1, 65)) AS i, unnest(e) AS x FROM a{i}) GROUP BY cluster, i),
m{i} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM s{i} GROUP BY cluster),
c{i + 1} AS (SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN m{i} m USING (cluster))""")
    return ",".join(out)


OP13_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
f AS (SELECT e, row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), e) - 1 AS cluster FROM v),
c0 AS (SELECT CAST(cluster AS INT) AS cluster, e FROM f WHERE cluster < 40),{_sql_rounds(5)}
SELECT v.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a5 a JOIN v USING (rid) JOIN c5 c USING (cluster)
"""
