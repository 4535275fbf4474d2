"""Streams with state against plain loops over all rows: shuffled micro-batches, restarts, batches that run again."""

from __future__ import annotations

import datetime as dt
import shutil
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bulletinlake.streaming import state

START = dt.datetime(2026, 1, 1)
DAY = 24 * 3600


@pytest.fixture(scope="module")
def rows():
    """(key, seconds, hash, seq) over forty days."""
    rng = np.random.default_rng(12)
    out = []
    for key in range(12):
        at = 0
        while at < 40 * DAY:
            at += int(rng.choice([600, 3 * 3600, DAY, 2 * DAY, 6 * DAY])) + int(rng.integers(0, 5)) * 60
            out.append((key, at, str(rng.choice(["a", "b"])), len(out)))
    out.append((99, 60 * DAY, "z", len(out)))  # moves the watermark past all of them
    return out


def staged(spark, rows, folder, batches, seed):
    """Files of rows that come up to a day late and in no order within a file."""
    rng = np.random.default_rng(seed)
    shuffled = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 0.8 * DAY))
    shuffled = [r for r in shuffled if r[0] != 99]
    parts = np.array_split(np.arange(len(shuffled)), batches - 1)
    for i, part in enumerate([*parts, None]):
        some = [shuffled[j] for j in part] if part is not None else [r for r in rows if r[0] == 99]
        frame = spark.createDataFrame([(k, START + dt.timedelta(seconds=s), h, q) for k, s, h, q in some], "key long, ts timestamp, hash string, seq long")
        frame.coalesce(1).write.parquet(f"{folder}/stage{i}")
    return [f"{folder}/stage{i}" for i in range(batches)]


def fed(spark, make, parts, folder):
    """Run the stream anew for every part: each run goes on from the checkpoint of the one before."""
    schema = "key long, ts timestamp, hash string, seq long"
    source = f"{folder}/in"
    spark.createDataFrame([], schema).write.parquet(source)
    for i, part in enumerate(parts):
        spark.read.parquet(part).coalesce(1).write.mode("append").parquet(source)
        out = make(spark.readStream.schema(schema).parquet(source))
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return [tuple(r) for r in spark.read.schema(out.schema).parquet(f"{folder}/out").collect()]


def seconds(t):
    return int((t - START).total_seconds())


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_end_when_a_key_was_not_seen(spark, rows, tmp_path, seed):
    got = fed(spark, lambda s: state.last_seen_spans(s, "key", "ts", days=3, late="1 day"), staged(spark, rows, tmp_path, 4, seed), tmp_path)
    want = []
    for key in range(12):
        times = sorted(r[1] for r in rows if r[0] == key)
        span = [times[0]]
        for t in [*times[1:], 10**9]:
            if t >= span[-1] + 3 * DAY:
                want.append((key, span[0], span[-1], span[-1] + 3 * DAY, len(span)))
                span = []
            span.append(t)
    assert sorted((k, seconds(a), seconds(b), seconds(c), n) for k, a, b, c, n in got) == sorted(want)


@pytest.mark.parametrize("seed", [3, 4])
def test_checks_fall_due_without_new_rows(spark, rows, tmp_path, seed):
    got = fed(spark, lambda s: state.rechecks(s, "key", "hash", "ts", hours=24, keep_days=2, late="1 day"), staged(spark, rows, tmp_path, 4, seed), tmp_path)
    want = []
    for key in range(12):
        known = checked = last = None
        for at, value in [*sorted((r[1], r[2]) for r in rows if r[0] == key), (59 * DAY, None)]:
            while checked is not None and checked + DAY <= at:
                checked += DAY
                if checked > last + 2 * DAY:
                    known = checked = last = None
                else:
                    want.append((key, known, checked, "elapsed"))
            if value is None:
                break
            if checked is None or value != known:
                want.append((key, value, at, "new" if checked is None else "changed"))
                known, checked = value, at
            last = at
    assert sorted((k, h, seconds(t), w) for k, h, t, w in got if k != 99) == sorted(want)


def test_a_batch_rewrites_only_the_buckets_of_its_keys(spark, tmp_path):
    schema = T.StructType().add("k", T.LongType()).add("v", T.StringType()).add("flag", T.IntegerType())
    path = str(tmp_path / "table")
    sink = state.bucketed_upsert_sink(path, schema, ["k"], "pos", ["v"], ratchet=["flag"], buckets=8)
    batch = lambda items: spark.createDataFrame([(*x, i) for i, x in enumerate(items)], "k long, v string, flag int, pos long")
    first = batch([(i, f"v{i}", 1) for i in range(50)])
    sink(first, 0)
    files = {p.name: p.parent.name for p in (tmp_path / "table").rglob("*.parquet")}
    second = batch([(3, "new", 0), (3, "newer", 1), (70, "more", 1)])
    sink(second, 1)
    touched = {f"bucket={r[0]}" for r in second.select(state.bucket_of(["k"], 8)).collect()}
    now = {p.name: p.parent.name for p in (tmp_path / "table").rglob("*.parquet")}
    assert {b for f, b in files.items() if f not in now} == touched & set(files.values()) and len(now) == len(set(now.values()))
    sink(second, 1)  # runs again
    got = {r["k"]: (r["v"], r["flag"]) for r in state.bucketed(spark, path, schema).collect()}
    assert got == {**{i: (f"v{i}", 1) for i in range(50)}, 3: ("newer", 0), 70: ("more", 1)}
    sink(first.limit(0), 2)
    assert state.bucketed(spark, path, schema).count() == 51 and state.bucketed(spark, str(tmp_path / "none"), schema).count() == 0


def test_evidence_folds_alike_in_any_order(spark, tmp_path):
    rng = np.random.default_rng(6)
    fields = ("deadline", "period", "amount")
    rows = []
    for i in range(120):
        given = [None if rng.random() < 0.5 else ("" if rng.random() < 0.2 else f"{f}{i}") for f in fields]
        rows.append((int(rng.integers(0, 9)), START + dt.timedelta(hours=int(rng.integers(0, 30))), i, *given))
    newest = defaultdict(dict)
    for key, t, seq, *given in rows:
        for f, v in zip(fields, given):
            if v:
                newest[key][f] = max(newest[key].get(f, (t, seq, v)), (t, seq, v))
    want = set()
    for key in {r[0] for r in rows}:
        d, p, a = (newest[key].get(f) for f in fields)
        want.add((key, d and d[2], p[2] if p and (not d or p[:2] >= d[:2]) else None, a and a[2]))
    for seed in (1, 2):
        folder = str(tmp_path / f"t{seed}")
        sink = state.evidence_sink(folder, "key", "long", fields, "ts", "seq", buckets=4)
        for number, part in enumerate(np.array_split(np.random.default_rng(seed).permutation(len(rows)), 4)):
            batch = spark.createDataFrame([rows[i] for i in part], "key long, ts timestamp, seq long, deadline string, period string, amount string")
            sink(batch, number)
            if number == 1:
                sink(batch, number)
        folded = state.bucketed(spark, folder, state.evidence_schema("key", "long", fields))
        assert {tuple(r) for r in state.current_evidence(folded, "key", fields, derived=["period"], source="deadline").collect()} == want


def test_turns_go_round_under_the_quota(spark, tmp_path):
    rng = np.random.default_rng(7)
    sink = state.rotation_sink(str(tmp_path), "k", "long", "pos", 5, buckets=4)
    turn, want = {}, {}
    for number in range(5):
        offered = rng.permutation(14)[: int(rng.integers(3, 14))].tolist()
        batch = spark.createDataFrame([(k, i) for i, k in enumerate(offered)], "k long, pos long")
        sink(batch, number)
        if number == 2:
            sink(batch, number)  # runs again
        chosen = sorted(offered, key=lambda k: (turn.get(k, -1), offered.index(k)))[:5]
        want[number] = sorted(chosen)
        turn.update(dict.fromkeys(chosen, number))
    got = defaultdict(list)
    for r in spark.read.parquet(f"{tmp_path}/turns").collect():
        got[r["batch"]].append(r["k"])
    assert {b: sorted(ks) for b, ks in got.items()} == want
    shutil.rmtree(tmp_path)
