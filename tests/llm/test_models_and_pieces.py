"""Fitted models against plain versions of what they compute, and every packed piece against the tokens it names."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

public = pytest.importorskip("public_tokenizers")

from bulletinlake.llm import packing, quality, toxicity  # noqa: E402


def test_every_piece_has_the_checksum_of_its_tokens(spark):
    import tokenizers

    rng = np.random.default_rng(3)
    texts = ["", "a", "日本語 テスト " * 900, "plain words " * 3000, "é̀ñ 😀 <|endoftext|> x", "\x00\ttabs\r\n" * 50]
    texts += [" ".join(rng.choice(["alpha", "beta", "Γάμμα", "δ", "\n", "123"], int(n))) for n in rng.integers(0, 900, 30)]
    docs = spark.createDataFrame([(i, t, "abc"[i % 3]) for i, t in enumerate(texts)] + [(999, None, None)], "doc_id long, text string, source string")
    slow = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    ids = {i: np.array([*slow.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)} | {999: np.array([1], "<u4")}
    pieces = defaultdict(list)
    for r in packing.packed(docs).collect():
        at = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(at) == r["length"] and zlib.crc32(at.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
    assert pieces.keys() == ids.keys() and any(len(p) > 1 for p in pieces.values())
    for i, parts in pieces.items():
        ends = [0]
        for start, length in sorted(parts):
            assert start == ends[-1]
            ends.append(start + length)
        assert ends[-1] == len(ids[i])


def test_quality_equals_a_ridge_and_isotonic_fit_in_one_place(spark):
    rng = np.random.default_rng(8)
    rows, labels = [], {}
    for i in range(600):
        good = i % 3 > 0
        rows.append((i, " ".join(f"w{int(k)}" if good or rng.random() < 0.3 else "spam&&&" for k in rng.integers(0, 300, int(rng.integers(5, 60))))))
        labels[i] = int(good)
    docs = spark.createDataFrame([*rows, (700, "word " * 100_000), (701, None)], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()}
    stats = {i: np.array(quality.statistics(t)) for i, t in rows} | {700: np.array(quality.statistics("word " * 100_000)), 701: np.array(quality.statistics(None))}
    train = [i for i in labels if zlib.crc32(str(i).encode()) % 5]
    x, y = np.array([stats[i] for i in train]), np.array([labels[i] for i in train], float)
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    draws = np.random.default_rng(7)
    waves, phases = draws.normal(0, math.sqrt(0.1), (len(mean), 256)), draws.uniform(0, 2 * math.pi, 256)
    wide = lambda s: np.append(np.cos(np.clip((s - mean) / spread, -8, 8) @ waves + phases) * math.sqrt(2 / 256), 1.0)
    z = np.array([wide(s) for s in x])
    w = np.linalg.lstsq(np.vstack([z, np.eye(257)[:256]]), np.append(y, np.zeros(256)), rcond=None)[0]  # ridge as added rows
    raw = {i: float(wide(s) @ w) for i, s in stats.items()}
    bins = defaultdict(list)
    for i in train:
        bins[int(np.clip(math.floor(raw[i] * 1000), -1000, 2000))].append(labels[i])
    steps = sorted((b, len(v), sum(v)) for b, v in bins.items())
    # isotonic by the greatest slope from each place on (max-min formula)
    blocks, at = [], 0
    while at < len(steps):
        slopes = [(sum(s for *_, s in steps[at:e]) / sum(n for _, n, _ in steps[at:e]), e) for e in range(at + 1, len(steps) + 1)]
        least = min(s for s, _ in slopes)
        end = max(e for s, e in slopes if s <= least + 1e-12)
        weight = sum(n for _, n, _ in steps[at:end])
        blocks.append((sum(n * (b + 0.5) / 1000 for b, n, _ in steps[at:end]) / weight, least))
        at = end
    knots = [min(-1.0, blocks[0][0] - 1), *(b for b, _ in blocks), max(2.0, blocks[-1][0] + 1)]
    levels = [0.0, *(v for _, v in blocks), 1.0]
    off = [i for i in stats if abs(got[i] - float(np.clip(np.interp(raw[i], knots, levels), 0, 1))) > 1e-6]
    assert len(off) <= 0.02 * len(stats)  # a score at the edge of a bin may fall on its other side
    assert 0 <= got[700] <= 1 and 0 <= got[701] <= 1


def plain_loss(rows, grades, w, theta, ridge):
    total = 0.5 * ridge * float(w @ w)
    for found, g in zip(rows, grades):
        s = float(w[found].sum())
        cdf = [0.0, *(1 / (1 + math.exp(-(t - s))) for t in theta), 1.0]
        total -= math.log(cdf[g + 1] - cdf[g])
    return total


def test_ordinal_weights_are_at_the_least_of_the_likelihood():
    rng = np.random.default_rng(5)
    rows = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(200)]
    true = np.array([2.0, 1.0, 0.5, -1.0, 0.0, 1.5])
    grades = np.array([int(np.searchsorted([0.5, 2.0], true[r].sum() + rng.logistic())) for r in rows])
    w, theta = toxicity.fit_ordinal(rows, grades, 6, ridge=1.0, rounds=3000)
    here = plain_loss(rows, grades, w, theta, 1.0)
    assert (np.diff(theta) > 0).all()
    for i in range(6):
        for step in (0.02, -0.02):
            assert plain_loss(rows, grades, w + step * np.eye(6)[i], theta, 1.0) >= here - 1e-4
    for i in range(2):
        for step in (0.02, -0.02):
            assert plain_loss(rows, grades, w, theta + step * np.eye(2)[i], 1.0) >= here - 1e-4
    found = toxicity.OrdinalModel(dict(zip("abcdef", w.tolist())), tuple(theta.tolist()))
    p = found.at_least(1.0)
    assert p == [pytest.approx(1 - 1 / (1 + math.exp(-(t - 1.0)))) for t in theta]


def test_severity_follows_planted_degrees(spark):
    rng = np.random.default_rng(6)
    clean = [f"word{i}" for i in range(300)]
    nasty = [f"vile{c}{d}" for c in "abcdef" for d in "uvwxyz"]
    rows, labels, degree = [], [], {}
    for i in range(900):
        n = int(rng.integers(1, 9)) if i % 3 == 0 else 0
        text = [*rng.choice(clean, 60), *rng.choice(nasty, n, replace=False)]
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        degree[i] = n
        if i % 2:
            labels.append((i, int(n > 0)))
    rows += [(1000, "very long " * 60_000 + " ".join(nasty[:5])), (1001, None), (1002, "")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, Severity double")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.assess(docs, model).select("doc_id", "severity", "toxic").collect()}
    unseen = [i for i in degree if i % 2 == 0]
    means = [np.mean([got[i]["severity"] for i in unseen if low <= degree[i] <= high]) for low, high in ((0, 0), (1, 2), (3, 5), (6, 8))]
    assert means == sorted(means) and means[-1] > means[0] + 1
    assert sum(got[i]["toxic"] == int(degree[i] > 0) for i in unseen) >= 0.97 * len(unseen)
    assert got[1000]["toxic"] == 1 and got[1001]["toxic"] == got[1002]["toxic"] == 0
