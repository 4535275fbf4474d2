"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

Features are a text's distinct words (letters only, lower case) and their beginnings of 4, 5 and
6 letters, which cover inflected forms. Grades are ordered: 0 for texts labelled not toxic; texts
labelled toxic get 1, 2 or 3 by how many distinct words with toxic features they hold (up to
``steps[0]``, up to ``steps[1]``, more), as the labels themselves have no degrees. The model is
``P(grade <= j) = sigmoid(theta_j - w.x)`` with one weight vector for all thresholds. A text's
severity is its expected grade; it is toxic if ``P(grade >= 1)`` is at least ``cut``.

Fitting: the distinct texts of the labelled rows whose hashed doc_id falls under a share that makes them about
``fit_rows`` (a bound, by default 20,000). Which features are kept is counted in Spark; the
driver gets at most ``n_features`` of them and, for the fitted rows, the numbers of their kept
features. Scoring runs over every whole text.

Nulls: null or empty text has no features and gets the grade that the thresholds alone give.
Labels with null doc_id or toxic are ignored; labels that contradict each other on a doc_id
count as toxic. Without labels of both kinds every text gets severity 0 and isn't toxic. Repeated
rows give repeated results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import numbered, pick, place_of, stash

_WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)
REMEMBER = 300_000


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n)]


@dataclass
class OrdinalModel:
    """Weights shared by all thresholds; ``weights`` by feature, ``thetas`` ascending."""

    weights: dict[str, float] = field(default_factory=dict)
    thetas: tuple[float, ...] = ()
    _cache: dict = field(default_factory=dict, repr=False)

    def score(self, text: str | None) -> float:
        """w.x, each feature once a text."""
        known, weights = self._cache, self.weights
        if len(known) > REMEMBER:
            known.clear()
        seen: set[str] = set()
        for w in words(text):
            hit = known.get(w)
            if hit is None:
                hit = known[w] = tuple(f for f in features_of(w) if f in weights)
            if hit:
                seen.update(hit)
        return sum(weights[f] for f in sorted(seen))

    def at_least(self, score: float) -> list[float]:
        """P(grade >= 1), P(grade >= 2), ..."""
        return [1 / (1 + math.exp(min(700, t - score))) for t in self.thetas]

    def __getstate__(self):
        return {"weights": self.weights, "thetas": self.thetas, "_cache": {}}


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n: int, ridge: float = 1.0, rounds: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by penalised likelihood (Adam); ``rows``: numbers of each text's features."""
    top = int(grades.max())
    flat = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    share = np.array([(grades > j).mean() for j in range(top)])
    base = np.log((1 - share + 1e-6) / (share + 1e-6))
    par = np.concatenate((np.zeros(n), base[:1], np.log(np.maximum(np.diff(base), 0.1))))
    m, v = np.zeros_like(par), np.zeros_like(par)
    one = np.eye(top + 1)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for step in range(1, rounds + 1):
        w, gaps = par[:n], np.exp(par[n + 1 :])
        theta = par[n] + np.concatenate(([0], np.cumsum(gaps)))
        s = np.bincount(owner, w[flat], minlength=len(rows))
        cdf = np.concatenate((np.zeros((len(rows), 1)), sig(theta[None, :] - s[:, None]), np.ones((len(rows), 1))), 1)
        dens = cdf * (1 - cdf)
        p = np.maximum((np.diff(cdf, axis=1) * one[grades]).sum(1), 1e-12)
        at = np.arange(len(rows))
        up, low = dens[at, grades + 1], dens[at, grades]
        ds = (up - low) / p  # of the negative likelihood by s
        g_theta = np.zeros(top)
        np.add.at(g_theta, np.minimum(grades, top - 1), np.where(grades < top, -up / p, 0))
        np.add.at(g_theta, np.maximum(grades - 1, 0), np.where(grades > 0, low / p, 0))
        g = np.concatenate((np.bincount(flat, ds[owner], minlength=n) + ridge * w, [g_theta.sum()], [g_theta[j:].sum() * gaps[j - 1] for j in range(1, top)]))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        par = par - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return par[:n], par[n] + np.concatenate(([0], np.cumsum(np.exp(par[n + 1 :]))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts by feature, toxic and all, summed over the partition before anything is shuffled."""
    toxic, every = Counter(), Counter()

    def pour():
        names = list(every)
        out = pa.record_batch([pa.array(names, pa.string()), pa.array([toxic[f] for f in names], pa.int64()), pa.array([every[f] for f in names], pa.int64())], names=["feature", "toxic", "texts"])
        toxic.clear(), every.clear()
        return out

    for batch in batches:
        for text, label in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
            found = {f for w in words(text) for f in features_of(w)}
            every.update(found)
            if label:
                toxic.update(found)
            if len(every) > 500_000:
                yield pour()
    if every:
        yield pour()


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, n_features: int = 4096, least: int = 5, odds: float = 10.0, steps: tuple[int, int] = (2, 5)) -> OrdinalModel:
    """The model of ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    A feature is kept if it occurs in at least ``least`` fitted texts and in toxic ones over
    ``odds`` times more often than elsewhere, by log odds (smoothed).
    """
    marked = pick(labels, _id="doc_id", toxic="toxic").where("_id is not null and toxic is not null").groupBy("_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n_labels = marked.count()
    if not n_labels:
        return OrdinalModel()
    share = min(1.0, fit_rows / n_labels)
    marked = marked.where(F.pmod(F.xxhash64("_id", F.lit("fit")), F.lit(1 << 40)) < math.ceil(share * (1 << 40)))
    rows = pick(docs, doc_id="doc_id", text="text")
    fitted = stash(rows.join(marked, rows["doc_id"] == marked["_id"]).groupBy("text", "toxic").agg(F.min("doc_id").alias("doc_id")), "fitted")
    totals = fitted.agg(F.count("*"), F.sum("toxic")).first()
    n, n_toxic = totals[0], totals[1] or 0
    if not n_toxic or n_toxic == n:
        return OrdinalModel()
    counts = fitted.mapInArrow(_count, "feature string, toxic long, texts long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("texts").alias("texts")).where(F.col("texts") >= least)
    ratio = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("texts") - F.col("toxic") + 0.5) / (n - n_toxic + 1))
    kept = counts.withColumn("ratio", ratio).where(F.col("ratio") > math.log(odds)).orderBy((F.col("ratio") * F.sqrt("toxic")).desc(), "feature").limit(n_features)
    names = [r["feature"] for r in kept.select("feature").collect()]  # n_features at most
    number = {f: i for i, f in enumerate(names)}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n_words = [], []
            for text in batch["text"].to_pylist():
                by_word = [[number[f] for f in features_of(w) if f in number] for w in words(text)]
                out.append(sorted({i for hits in by_word for i in hits}))
                n_words.append(sum(bool(h) for h in by_word))
            yield pa.record_batch([batch["doc_id"], batch["toxic"], pa.array(n_words, pa.int32()), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "toxic", "n_words", "found"])

    seen = fitted.selectExpr("cast(doc_id as long) as doc_id", "text", "toxic").mapInArrow(look, "doc_id long, toxic int, n_words int, found array<int>").orderBy("doc_id").collect()  # about fit_rows at most
    grades = np.array([0 if not r["toxic"] else 1 + sum(r["n_words"] > s for s in steps) for r in seen])
    grades = np.unique(grades, return_inverse=True)[1]  # no grade without a text
    weights, thetas = fit_ordinal([np.array(r["found"], np.int64) for r in seen], grades, len(names))
    return OrdinalModel(dict(zip(names, weights.tolist())), tuple(thetas.tolist()))


def assess(docs: DataFrame, model: OrdinalModel, cut: float = 0.4) -> DataFrame:
    """``docs`` (with a text column) with severity, p_toxic and toxic (0 or 1) added; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # n_features weights at most

    def grade(texts: pd.Series) -> pd.DataFrame:
        own = shared.value
        out = [own.at_least(own.score(t)) or [0.0] for t in texts]
        return pd.DataFrame({"severity": [float(sum(p)) for p in out], "p_toxic": [float(p[0]) for p in out], "toxic": [int(p[0] >= cut) for p in out]})

    graded = F.pandas_udf(grade, "severity double, p_toxic double, toxic int")
    rows, names = numbered(docs)
    stays = [i for i, n in enumerate(names) if n.lower() not in ("severity", "p_toxic", "toxic")]
    out = rows.withColumn("_g", graded(F.col(place_of(names, "text")))).select(*[f"_{i}" for i in stays], "_g.severity", "_g.p_toxic", "_g.toxic")
    return out.toDF(*[names[i] for i in stays], "severity", "p_toxic", "toxic")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text")
    return assess(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).select("doc_id", "severity", "p_toxic", "toxic")
