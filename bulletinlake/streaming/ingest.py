"""The batch merges as streams: each micro-batch goes through the same functions as a snapshot.

Sinks keep snapshots in numbered folders: a batch writes ``v=<batch id>`` from the one before, so
a batch that runs again after a failure writes the same folder again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.merge import expire, fold_batch, upsert


def dedupe(stream: DataFrame, keys: Sequence[str], stamp: str, late: str = "30 days") -> DataFrame:
    """First rows by key; state is kept as long as rows may come late."""
    return stream.withWatermark(stamp, late).dropDuplicatesWithinWatermark(list(keys))


def calendar_counts(stream: DataFrame, stamp: str, by: Sequence[str] = (), late: str = "2 days", width: str = "7 days", start: str = "4 days") -> DataFrame:
    """Counts by week from Monday (or another fixed width) as an event-time stream."""
    window = F.window(stamp, width, width, start)
    grouped = stream.withWatermark(stamp, late).groupBy(window, *by).agg(F.count("*").alias("n"))
    return grouped.select(F.to_date("window.start").alias("week_start"), *by, "n")


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the written snapshots, ascending, on whatever store the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    found = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName().startswith("v=")]
    done = [f for f in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
    return sorted(int(f.getName()[2:]) for f in done)


def latest(spark: SparkSession, path: str, schema: StructType, before: int | None = None) -> DataFrame:
    """The newest snapshot (under ``before``, if given), empty if there is none."""
    known = [v for v in snapshots(spark, path) if before is None or v < before]
    return spark.read.schema(schema).parquet(f"{path}/v={known[-1]}") if known else spark.createDataFrame([], schema)


def upsert_sink(path: str, schema: StructType, keys: Sequence[str], pos: str, always: Sequence[str], if_given: Sequence[str] = (), ratchet: Sequence[str] = (), ttl: tuple[str, Callable[[], Column]] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges each micro-batch into the snapshot under ``path``.

    ``ttl``: a stamp column and a function for the oldest stamp to keep.
    """

    def write(batch: DataFrame, number: int) -> None:
        old = latest(batch.sparkSession, path, schema, number)
        merged = upsert(old, fold_batch(batch, keys, pos, ratchet).select(*schema.fieldNames()), keys, always, if_given, ratchet)
        if ttl:
            merged = expire(merged, ttl[0], ttl[1]())
        merged.write.mode("overwrite").parquet(f"{path}/v={number}")

    return write


def recheck_due(stream: DataFrame, key: str, content_hash: str, stamp: str, hours: int = 24) -> DataFrame:
    """(key, hash, due): whether a row is to be checked again: new, changed, or checked long ago.

    State by key is the last hash and when it was checked, by event time.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, at = state.get if state.exists else (None, None)
        rows = []
        for f in frames:
            for h, t in f.sort_values(stamp)[[content_hash, stamp]].itertuples(index=False):
                now = int(pd.Timestamp(t).timestamp())
                due = h != seen or at is None or now - at >= hours * 3600
                if due:
                    seen, at = h, now
                rows.append((k[0], h, due))
        state.update((seen, at))
        yield pd.DataFrame(rows, columns=[key, "hash", "due"])

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, hash string, due boolean", "hash string, at long", "append", GroupStateTimeout.NoTimeout)
