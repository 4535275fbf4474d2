"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration.

Each whole text becomes a fixed list of statistics (lengths, letter and symbol shares, repeats of
words and lines, compressibility). They are standardised and mapped to ``n_features`` random
cosines, which approximate a Gaussian kernel. Each partition sums its share of the normal
equations, the sums add up by row of the matrix in Spark, and the driver solves the ridge
system, whose size doesn't depend on the data. Raw scores of the fitted rows are counted in
``bins`` equal steps, and isotonic regression (pool adjacent violators) over these counts makes
them probabilities; between its levels scores are interpolated, so they keep their order.

Labels are learned only from rows whose ``crc32(doc_id as text) % folds`` isn't 0. Labels,
language, source and doc_id are no inputs.

Nulls: null text counts as empty; empty texts are scored too. Labels with null doc_id or quality
are ignored; contradicting labels of a doc_id count by their largest. Without labels of both
kinds the score is the labels' mean, or 1. Repeated rows give repeated results; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import pick, stash

_LETTERS = re.compile(r"[^\W\d_]+")
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGITS = re.compile(r"\d")
_SYMBOLS = re.compile(r"[^\w\s.,;:'\"()!?-]")
_MARKED = re.compile(r"[^\w\s.,;:'\")-]{2,}(?=\s|$)")
N_STATS = 19


def statistics(text: str | None) -> list[float]:
    """The text's ``N_STATS`` statistics; all finite, also for an empty text."""
    text = text or ""
    n = len(text)
    words = text.split()
    w = len(words)
    if not w:
        return [0.0] * N_STATS
    counts = Counter(words)
    folded = Counter(x.lower() for x in counts)
    top = counts.most_common(1)[0][1]
    lines = text.split("\n")
    n_lines = len(lines)
    same = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    letters = sum(map(len, _LETTERS.findall(text)))
    raw = text.encode("utf-8")
    lengths = np.fromiter(map(len, words), np.float64, w)
    marked = len(_MARKED.findall(text))
    return [
        math.log1p(n),
        math.log1p(w),
        float(lengths.mean()),
        float(lengths.std()),
        len(_CAPITALS.findall(text)) / max(letters, 1),
        letters / n,
        len(_DIGITS.findall(text)) / n,
        len(_SYMBOLS.findall(text)) / n,
        marked / w,
        text.count("|") / w,
        text.count("!") / w,
        same / w,
        len(counts) / w,
        top / w,
        pairs / max(w - 1, 1),
        math.log1p(w / n_lines),
        len(set(lines)) / n_lines,
        len(zlib.compress(raw, 1)) / len(raw),
        len(folded) / len(counts) * min(1.0, w / 50),
    ]


@dataclass
class QualityModel:
    """Standardisation, cosines, ridge weights and calibration knots."""

    mean: np.ndarray
    spread: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def expand(self, stats: np.ndarray) -> np.ndarray:
        """Standardised statistics' cosines, and a constant."""
        x = np.clip((stats - self.mean) / self.spread, -8, 8)
        z = np.cos(x @ self.waves + self.phases) * math.sqrt(2 / self.waves.shape[1])
        return np.concatenate((z, np.ones((len(z), 1))), 1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.expand(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0.0, 1.0)


def pool(counts: np.ndarray, means: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: centres and levels of the pools."""
    pools: list[list[float]] = []  # weight, sum, sum of positions
    for c, m, x in zip(counts.tolist(), means.tolist(), at.tolist()):
        pools.append([c, c * m, c * x])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            c2, s2, x2 = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], (c2, s2, x2))]
    weight, total, place = np.array(pools).T
    return place / weight, total / weight


def _sums(model: QualityModel):
    """Rows of a partition's share of the normal equations: row number and the row, its target last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                z = model.expand(np.array(batch["stats"].to_pylist()))
                y = np.array(batch["quality"].to_pylist(), np.float64)
                part = z.T @ np.concatenate((z, y[:, None]), 1)
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "row"])

    return run


def _add(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(r) for r in table["row"].to_pylist())
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["i", "row"])


def fit(stats: DataFrame, labels: DataFrame, n_features: int = 256, gamma: float = 0.05, ridge: float = 1.0, folds: int = 5, bins: int = 1000, seed: int = 7) -> QualityModel | float:
    """The model of ``stats(doc_id, stats)`` and ``labels(doc_id, quality)``; a number if it can only be constant."""
    marked = pick(labels, _id="doc_id", quality="quality").where("_id is not null and quality is not null").groupBy("_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    marked = marked.where(F.crc32(F.col("_id").cast("string").cast("binary")) % folds != 0)
    rows = stash(stats.join(marked, stats["doc_id"] == marked["_id"]).select("stats", "quality"), "labelled")
    each = [f(F.col("stats")[i]) for i in range(N_STATS) for f in (F.avg, F.stddev_pop)]
    first = rows.agg(F.count("*"), F.avg("quality"), *each).first()
    n, share = first[0], first[1]
    if not n or share in (0.0, 1.0):
        return 1.0 if share is None else float(share)
    rng = np.random.default_rng(seed)
    moments = np.array(first[2:]).reshape(N_STATS, 2)
    model = QualityModel(moments[:, 0], np.maximum(moments[:, 1], 1e-6), rng.normal(0, math.sqrt(2 * gamma), (N_STATS, n_features)), rng.uniform(0, 2 * math.pi, n_features), np.zeros(n_features + 1), np.array([0.0]), np.array([0.0]))
    summed = rows.mapInArrow(_sums(model), "i int, row binary").groupBy("i").applyInArrow(_add, "i int, row binary").collect()  # n_features + 1 rows
    system = np.stack([np.frombuffer(r["row"]) for r in sorted(summed, key=lambda r: r["i"])])
    penalty = ridge * np.eye(n_features + 1)
    penalty[-1, -1] = 0
    model.weights = np.linalg.solve(system[:, :-1] + penalty, system[:, -1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bin_of = np.clip(np.floor(model.raw(np.array(batch["stats"].to_pylist())) * bins), -bins, 2 * bins).astype(np.int32)
                yield pa.record_batch([pa.array(bin_of), batch["quality"]], names=["bin", "quality"])

    hist = rows.mapInArrow(place, "bin int, quality int").groupBy("bin").agg(F.count("*").alias("n"), F.avg("quality").alias("mean")).orderBy("bin").collect()  # 3 * bins rows at most
    counts, means, at = (np.array(x, np.float64) for x in zip(*[(r["n"], r["mean"], (r["bin"] + 0.5) / bins) for r in hist]))
    model.knots, model.levels = pool(counts, means, at)
    # outside the pools' centres scores go on to 0 and 1, so ends don't tie
    model.knots = np.concatenate(([min(-1.0, model.knots[0] - 1)], model.knots, [max(2.0, model.knots[-1] + 1)]))
    model.levels = np.concatenate(([0.0], model.levels, [1.0]))
    return model


def measured(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, stats)``."""

    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts], dtype=object)

    rows = pick(docs, doc_id="doc_id", text="text")
    return rows.select("doc_id", F.pandas_udf(of, "array<double>")("text").alias("stats"))


def score(docs: DataFrame, labels: DataFrame, cut: float = 0.3, folds: int = 5) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs(doc_id, text)``."""
    stats = stash(measured(docs), "stats")
    model = fit(stats, labels, folds=folds)
    if isinstance(model, float):
        scored = stats.select("doc_id", F.lit(model).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by n_features

        def of(rows: pd.Series) -> pd.Series:
            return pd.Series(shared.value.score(np.array(rows.tolist())) if len(rows) else [], dtype="float64")

        scored = stats.select("doc_id", F.pandas_udf(of, "double")("stats").alias("score"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
