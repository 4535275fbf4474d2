"""Line dedup across documents: keep bitmaps from range-partitioned line hashes.

A document's lines are its text split at ``\\n`` (null or empty text: one empty line). A line's
key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. A key of at least
``min_chars`` code points found in at least ``min_docs`` documents loses all its lines except in
the largest doc_id holding it (there they all stay). Shorter keys are never touched.

Method: each text becomes rows (128-bit key hash, doc_id, positions). They are range-partitioned
by hash and doc_id, so a key held by a third of all documents spreads over many partitions, and
sorted by hash, document (descending) and position. Each partition streams its runs: the first
document of a run keeps its lines, later ones lose them once the run has ``min_docs`` documents.
Only a partition's first and last run may go on in a neighbour; for these it returns their rows
and a summary, and the summaries (at most two keys a partition) decide. What comes back per
document is a compressed keep bitmap; text isn't shuffled with the hashes.

Nulls: a null doc_id is a document below all others. Rows that repeat a doc_id are one document;
each row gets its own bitmap, by doc_id and a hash of its text. Other columns are ignored.
An empty table gives no bitmaps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import numbered, pick, place_of, stash

STRIP = b" \t\n\x0b\x0c\r"
EMIT = "h1 long, h2 long, doc_id long, tx long, n_lines int, positions array<int>"
SEEN = "kind int, h1 long, h2 long, doc_id long, tx long, n_lines int, positions array<int>, n_docs long"
DROP, OPEN, SUMMARY = 0, 1, 2


def line_keys(text: str | None) -> list[bytes]:
    return [x.strip(STRIP) for x in (text or "").encode("utf-8").lower().split(b"\n")]


def _long_enough(key: bytes, least: int) -> bool:
    n = len(key)
    return n >= least and (n >= 4 * least or len(key.decode("utf-8")) >= least)


def _emit(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_intdigest
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for doc_id, text, tx in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["tx"].to_pylist()):
                keys = line_keys(text)
                at: dict[bytes, list[int]] = {}
                for i, key in enumerate(keys):
                    if _long_enough(key, min_chars):
                        at.setdefault(key, []).append(i)
                for key, positions in at.items():
                    h = digest(key)
                    for c, x in zip(cols, ((h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), doc_id, tx, len(keys), positions)):
                        c.append(x)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32())))], names=["h1", "h2", "doc_id", "tx", "n_lines", "positions"])

    return run


def _stream(min_docs: int):
    """Runs of equal hashes in sorted order; ``first`` is the run that may have begun before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, True
        docs, held, kept_doc = 0, [], None
        out: list[tuple] = []

        def row(kind, b, i, n=None):
            return (kind, *[b[c][i].as_py() for c in ("h1", "h2", "doc_id", "tx", "n_lines", "positions")], n)

        def close(is_last: bool):
            nonlocal held
            if key is None:
                return
            if first or is_last:
                out.append((SUMMARY, key[0], key[1], top, None, None, None, docs))
                if not first and docs < min_docs:
                    out.extend((OPEN, *r[1:]) for r in held)
            held = []

        def pour():
            nonlocal out
            cols = list(zip(*out)) if out else [()] * 8
            out = []
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int64()))], names=["kind", "h1", "h2", "doc_id", "tx", "n_lines", "positions", "n_docs"])

        top = None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            h1, h2 = b["h1"].to_numpy(zero_copy_only=False), b["h2"].to_numpy(zero_copy_only=False)
            change = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
            starts = np.flatnonzero(change)
            ends = np.concatenate((starts[1:], [n]))
            # a run of one row inside a batch needs no look; the batch's first and last run may go on
            looked = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == n))
            for s, e in zip(starts[looked].tolist(), ends[looked].tolist()):
                this = (int(h1[s]), int(h2[s]))
                if this != key:
                    close(False)
                    first = key is None
                    key, docs, held, kept_doc, top = this, 0, [], (), None
                for i in range(s, e):
                    d = b["doc_id"][i].as_py()
                    if docs == 0 or d != kept_doc:
                        docs += 1
                        kept_doc = d
                        if docs == 1:
                            top = d
                        if docs == min_docs and not first:
                            out.extend((DROP, *r[1:]) for r in held if r[3] != top)
                            held = []
                    if first:
                        out.append(row(OPEN, b, i))
                    elif docs < min_docs:
                        held.append(row(OPEN, b, i))
                    elif d != top:
                        out.append(row(DROP, b, i))
                if len(out) > 20_000:
                    yield pour()
        close(True)
        if out:
            yield pour()

    return run


def _bitmaps(n_lines: pd.Series, positions: pd.Series) -> pd.Series:
    def one(n, at):
        keep = np.ones(int(n), bool)
        keep[np.concatenate(list(at)).astype(np.int64)] = False
        return zlib.compress(np.packbits(keep).tobytes())

    return pd.Series([one(n, at) for n, at in zip(n_lines, positions)], dtype=object)


def read_bitmap(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """Booleans by line, true: stays. No bitmap: all stay."""
    if bitmap is None:
        return np.ones(n_lines, bool)
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines].astype(bool)


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``(doc_id, tx, n_lines, keep)`` of each row that loses lines; ``tx`` is xxhash64(text)."""
    rows = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tx"))
    lines = stash(rows.mapInArrow(_emit(min_chars), EMIT), "lines")
    parts = max(1, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc_nulls_last()]
    ranged = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order, "tx")
    seen = stash(ranged.mapInArrow(_stream(min_docs), SEEN), "runs")
    # at most two runs a partition are open: as few rows as twice the partitions
    verdict = seen.where(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(F.sum("n_docs").alias("docs"), F.max("doc_id").alias("top"))
    verdict = verdict.where(F.col("docs") >= min_docs).select("h1", "h2", "top")
    late = seen.where(F.col("kind") == OPEN).join(F.broadcast(verdict), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("top")))
    drops = seen.where(F.col("kind") == DROP).select("doc_id", "tx", "n_lines", "positions").union(late.select("doc_id", "tx", "n_lines", "positions")).distinct()
    return drops.groupBy("doc_id", "tx", "n_lines").agg(F.collect_list("positions").alias("at")).select("doc_id", "tx", "n_lines", F.pandas_udf(_bitmaps, "binary")("n_lines", "at").alias("keep"))


def with_kept(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and others) with columns n_lines, n_dropped and kept (the text left); columns of these names are replaced."""

    @F.pandas_udf("n_lines long, n_dropped long, kept string")
    def cut(text: pd.Series, keep: pd.Series) -> pd.DataFrame:
        out = []
        for t, k in zip(text, keep):
            lines = (t or "").split("\n")
            if k is None:
                out.append((len(lines), 0, t or ""))
            else:
                stays = read_bitmap(k, len(lines))
                left = [x for x, s in zip(lines, stays) if s]
                out.append((len(lines), len(lines) - len(left), "\n".join(left)))
        return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept"])

    rows, names = numbered(docs)
    doc_id, body = (place_of(names, c) for c in ("doc_id", "text"))
    stays = [i for i, n in enumerate(names) if n.lower() not in ("n_lines", "n_dropped", "kept")]
    maps = bitmaps.select(F.col("doc_id").alias("_id"), F.col("tx").alias("_tx"), F.col("keep").alias("_keep"))
    joined = rows.join(maps, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.xxhash64(body) == F.col("_tx")), "left")
    out = joined.withColumn("_cut", cut(body, "_keep")).select(*[f"_{i}" for i in stays], "_cut.n_lines", "_cut.n_dropped", "_cut.kept")
    return out.toDF(*[names[i] for i in stays], "n_lines", "n_dropped", "kept")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text")
    out = with_kept(docs, keep_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, i, lines[i] AS line,
    trim(translate(lines[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM split)),
common AS (
  SELECT key, max(doc_id) AS top FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT l.doc_id, l.i, l.line, c.key IS NOT NULL AND l.doc_id < c.top AS dropped
  FROM lines l LEFT JOIN common c ON l.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
