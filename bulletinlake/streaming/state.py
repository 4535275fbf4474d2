"""Streams with state: spans that end some time after they were last seen, checks that fall due without a new row,
tables of which a micro-batch rewrites only what it touches, evidence in any order, and fair rotation under a quota.

Stateful operators decide nothing before the watermark has passed it: rows wait in the state, by event time, and timers
bring them out in order. So the result doesn't depend on the order of arrival within the lateness, nor on how rows fall into
micro-batches; a key's state is its rows within the lateness and one record more, and goes when its last timer has fired.
They need the RocksDB state store (``use_rocksdb``).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructType

from ..operators.merge import fold_batch, upsert

HOUR = 3600 * 1000
DAY = 24 * HOUR


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _InOrder(StatefulProcessor):
    """Holds rows until the watermark has passed them, then hands them on by time, with alarms that fall due in between.

    A subclass says what a row does to the key's record (``seen``) and what an alarm does (``rings``); both return the record
    (None: forgotten), the time of its next alarm (None: none) and rows to return. Times are milliseconds; at equal times alarms ring first.
    """

    def __init__(self, stamp: str, value: str, names: list[str]):
        self.stamp, self.value, self.names = stamp, value, names

    def seen(self, record, at: int, value):
        raise NotImplementedError

    def rings(self, record, at: int):
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "waiting string, record string, alarm long, timer long")

    def _load(self):
        """Rows that wait, the record, its alarm, and the timer that is set."""
        got = self.held.get()
        return (json.loads(got[0]), json.loads(got[1]), got[2], got[3]) if got else ([], None, None, None)

    def _keep(self, waiting: list, record, alarm: int | None, timer: int | None) -> None:
        """Each call to the state is a message to the JVM: the one timer is set anew only where its time changes."""
        times = [x for x in (waiting[0][0] if waiting else None, alarm) if x is not None]
        following = min(times) if times else None
        if timer is not None and timer != following:
            self.handle.deleteTimer(timer)
        if following is None:
            self.held.clear()
            return
        self.held.update((json.dumps(waiting), json.dumps(record), alarm, following))
        if timer != following:
            self.handle.registerTimer(following)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting, record, alarm, timer = self._load()
        for frame in rows:
            times = (frame[self.stamp].astype("datetime64[us]").astype("int64") // 1000).tolist()
            waiting += [[t, v] for t, v in zip(times, frame[self.value].tolist())]
        self._keep(sorted(waiting, key=lambda x: (x[0], str(x[1]))), record, alarm, timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting, record, alarm, timer = self._load()
        out: list[tuple] = []
        passed = 0  # of the rows that wait
        while True:
            row = waiting[passed][0] if passed < len(waiting) else None
            if alarm is not None and alarm <= now and (row is None or alarm <= row):
                record, alarm, some = self.rings(record, alarm)
            elif row is not None and row <= now:
                at, value = waiting[passed]
                passed += 1
                record, alarm, some = self.seen(record, at, value)
            else:
                break
            out += [(*key, *x) for x in some]
        self._keep(waiting[passed:], record, alarm, timer)
        if out:
            yield pd.DataFrame({n: np.array(c, "datetime64[ms]") if n.endswith("_at") else list(c) for n, c in zip(self.names, zip(*out))})

    def close(self) -> None:
        pass


class _Spans(_InOrder):
    def __init__(self, stamp: str, value: str, names: list[str], ttl: int):
        super().__init__(stamp, value, names)
        self.ttl = ttl

    def seen(self, record, at, value):
        first, _, n = record or (at, at, 0)
        return (first, at, n + 1), at + self.ttl, []

    def rings(self, record, at):
        return None, None, [(*record[:2], at, record[2])]


class _Rechecks(_InOrder):
    def __init__(self, stamp: str, value: str, names: list[str], every: int, keep: int):
        super().__init__(stamp, value, names)
        self.every, self.keep = every, keep

    def seen(self, record, at, value):
        known, checked, _ = record or (None, None, None)
        if checked is None or known != value:
            return (value, at, at), at + self.every, [(value, at, "changed" if checked is not None else "new")]
        return (known, checked, at), checked + self.every, []

    def rings(self, record, at):
        value, _, last = record
        if at > last + self.keep:
            return None, None, []
        return (value, at, last), at + self.every, [(value, at, "elapsed")]


def _stateful(stream: DataFrame, key: str, stamp: str, late: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    use_rocksdb(stream.sparkSession)
    grouped = stream.withWatermark(stamp, late).groupBy(key)
    return grouped.transformWithStateInPandas(processor, schema, "append", "eventTime")


def last_seen_spans(stream: DataFrame, key: str, stamp: str, days: int = 30, late: str = "1 day") -> DataFrame:
    """``(key, first_at, last_at, expired_at, n)``: each span of rows of a key that ended because none came for ``days``; n rows."""
    names = [key, "first_at", "last_at", "expired_at", "n"]
    rows = stream.select(key, stamp, F.date_format(stamp, "yyyy").alias("held_value"))
    return _stateful(rows, key, stamp, late, _Spans(stamp, "held_value", names, days * DAY), f"{key} {dict(stream.dtypes)[key]}, first_at timestamp, last_at timestamp, expired_at timestamp, n long")


def rechecks(stream: DataFrame, key: str, content_hash: str, stamp: str, hours: int = 24, keep_days: int = 3, late: str = "1 day") -> DataFrame:
    """``(key, hash, due_at, why)``: when rows are to be checked: ``new``, ``changed``, or ``elapsed`` since the last check.

    A check falls due without a new row, until none has come for ``keep_days``; then the key is forgotten.
    """
    names = [key, "hash", "due_at", "why"]
    rows = stream.select(key, stamp, F.col(content_hash).cast("string").alias("held_value"))
    return _stateful(rows, key, stamp, late, _Rechecks(stamp, "held_value", names, hours * HOUR, keep_days * DAY), f"{key} {dict(stream.dtypes)[key]}, hash string, due_at timestamp, why string")


# Tables in buckets


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def bucketed(spark: SparkSession, path: str, schema: StructType, only: Sequence[int] | None = None) -> DataFrame:
    """The table under ``path`` (empty if there is none), or some of its buckets."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType([*schema]).add("bucket", IntegerType())).parquet(path)
    return (rows if only is None else rows.where(F.col("bucket").isin(list(only)))).select(*schema.fieldNames())


def rewrite_buckets(batch: DataFrame, path: str, schema: StructType, keys: Sequence[str], merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int) -> None:
    """Merge a batch into the table under ``path``, of which only the buckets of the batch's keys are read and written.

    ``merge`` gets the old rows and the batch and must give the same rows if the batch is merged again: so a batch
    that runs again after a failure leaves the table as if it had run once.
    """
    spark = batch.sparkSession
    touched = sorted(r[0] for r in batch.select(bucket_of(keys, buckets)).distinct().collect())  # as many as buckets at most
    if touched:
        merged = merge(bucketed(spark, path, schema, touched), batch).select(*schema.fieldNames())
        out = merged.withColumn("bucket", bucket_of(keys, buckets)).repartition(len(touched), "bucket")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def bucketed_upsert_sink(path: str, schema: StructType, keys: Sequence[str], pos: str, always: Sequence[str], if_given: Sequence[str] = (), ratchet: Sequence[str] = (), buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: ``merge.upsert`` of each micro-batch, of whose buckets alone the table is rewritten."""

    def merge(old: DataFrame, batch: DataFrame) -> DataFrame:
        return upsert(old, fold_batch(batch, keys, pos, ratchet).select(*schema.fieldNames()), keys, always, if_given, ratchet)

    return lambda batch, number: rewrite_buckets(batch, path, schema, keys, merge, buckets)


# Evidence in any order


def evidence_schema(key: str, kind: str, fields: Sequence[str]) -> StructType:
    return StructType.fromDDL(f"{key} {kind}, " + ", ".join(f"{f} struct<stamp: timestamp, seq: long, value: string>" for f in fields))


def evidence_of(rows: DataFrame, key: str, fields: Sequence[str], stamp: str, seq: str) -> DataFrame:
    """Each key's newest given value of every field, with its stamp and number; blank values are none."""
    newest = [F.max(F.when(F.trim(F.coalesce(f, F.lit(""))) != "", F.struct(F.col(stamp).cast("timestamp").alias("stamp"), F.col(seq).cast("long").alias("seq"), F.col(f).cast("string").alias("value")))).alias(f) for f in fields]
    return rows.groupBy(key).agg(*newest)


def fold_evidence(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Both tables of ``evidence_of`` as one: by field the newer of both, so any order of folding gives the same."""
    return old.select(key, *fields).unionByName(new.select(key, *fields)).groupBy(key).agg(*[F.max(f).alias(f) for f in fields])


def current_evidence(folded: DataFrame, key: str, fields: Sequence[str], derived: Sequence[str] = (), source: str | None = None) -> DataFrame:
    """``(key, *fields)`` as values; ``derived`` fields older than the field ``source`` that they were read from are void."""
    of = lambda f: F.when(F.struct(f"{f}.stamp", f"{f}.seq") >= F.struct(f"{source}.stamp", f"{source}.seq"), F.col(f"{f}.value")) if f in derived and source else F.col(f"{f}.value")
    values = [F.when(F.col(f"{source}.value").isNull(), F.col(f"{f}.value")).otherwise(of(f)) if f in derived and source else of(f) for f in fields]
    return folded.select(key, *[v.alias(f) for v, f in zip(values, fields)])


def evidence_sink(path: str, key: str, kind: str, fields: Sequence[str], stamp: str, seq: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that folds late evidence into the bucketed table under ``path``."""
    schema = evidence_schema(key, kind, fields)

    def merge(old: DataFrame, batch: DataFrame) -> DataFrame:
        return fold_evidence(old, evidence_of(batch, key, fields, stamp, seq), key, fields)

    return lambda batch, number: rewrite_buckets(batch, path, schema, [key], merge, buckets)


# Rotation under a quota


def rotation(candidates: DataFrame, ledger: DataFrame, key: str, pos: str, quota: int) -> DataFrame:
    """The ``quota`` candidates whose turn was longest ago (``ledger(key, turn)``; never: first), ties by ``pos``, then key.

    A top-k, not a sort of all candidates.
    """
    known = candidates.select(key, pos).groupBy(key).agg(F.min(pos).alias(pos)).join(ledger.select(key, "turn"), key, "left")
    return known.orderBy(F.col("turn").asc_nulls_first(), pos, key).limit(quota).select(key, pos)


def rotation_sink(path: str, key: str, kind: str, pos: str, quota: int, buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each batch's turns go to ``path/turns/batch=N``, and into the ledger under ``path/ledger``.

    Turns are written first and the ledger from them; a batch that runs again leaves out its own turns of the ledger, so it chooses the same.
    """
    schema = StructType.fromDDL(f"{key} {kind}, turn long, before long")

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ledger = bucketed(spark, f"{path}/ledger", schema)
        past = ledger.select(key, F.when(F.col("turn") < number, F.col("turn")).otherwise(F.col("before")).alias("turn"))
        rotation(batch, past, key, pos, quota).write.mode("overwrite").parquet(f"{path}/turns/batch={number}")
        served = spark.read.parquet(f"{path}/turns/batch={number}").select(key, F.lit(number).cast("long").alias("turn"))

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            both = old.join(new.select(key, F.col("turn").alias("_now")), key, "full_outer")
            before = F.when(F.col("_now").isNull(), F.col("before")).when(F.col("turn") < F.col("_now"), F.col("turn")).otherwise(F.col("before"))
            return both.select(key, F.coalesce("_now", "turn").alias("turn"), before.alias("before"))

        rewrite_buckets(served, f"{path}/ledger", schema, [key], merge, buckets)

    return run
