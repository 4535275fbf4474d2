"""Collocations, sharding and sort-means against brute force, with nulls, ties, repeated rows, very long
texts, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from bulletinlake.llm import collocations, sharding, sortmeans

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_collocations(rows, least, longest, share, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    out = defaultdict(list)
    some = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    for (lang, p), a in some.items():
        if any(o == lang and len(q) > len(p) and inside(p, q) and 100 * b >= share * a for (o, q), b in some.items()):
            continue
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, lf, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, lf, r) in enumerate(sorted(found)[:top]))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(21)
    words = ["New", "york", "new", "city", "of", "The", "é", "año", "日本", "a", "b", "x y"]
    shares = np.array([4, 4, 2, 3, 6, 6, 1, 1, 1, 3, 3, 1]) / 35
    rows = []
    for i in range(160):
        some = [str(w) + str(rng.choice(["", "", "", ",", ".", " ;", "\n", "\t"])) for w in rng.choice(words, int(rng.integers(0, 40)), p=shares)]
        rows.append((" ".join(some), ["en", "de", None, "und"][i % 4]))
    rows += [(None, "en"), ("", "en"), ("...", "xx"), ("word " * 30_000, "en"), ("new york city " * 12, None)] + [rows[3]] * 5
    return rows


@pytest.mark.parametrize("least, longest, share, top, block", [(10, 3, 50, 2000, 1 << 22), (5, 4, 80, 7, 300), (2, 2, 50, 50, 1)])
def test_collocations(spark, texts, least, longest, share, top, block):
    docs = spark.createDataFrame([(t, g, "clash", 1) for t, g in texts], "text string, lang string, TEXT string, n long").repartition(3)
    got = [tuple(r) for r in collocations.collocations(docs, least, longest, share, top, block).collect()]
    assert sorted(got) == brute_collocations(texts, least, longest, share, top)


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([(None, None), ("", "en"), ("one two three", "en")], "text string, lang string")
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_lists_are_the_places_of_every_phrase():
    rng = np.random.default_rng(2)
    words, codes = collocations.coded([b" ".join(rng.choice([b"a", b"b", b"c", b"d,"], 50)) for _ in range(6)])
    plain = [words[c] if c < len(words) else None for c in codes.tolist()]
    word, word_at = collocations.postings(codes, np.arange(len(words)))
    assert word.tolist() == sorted(word.tolist())
    left, right, n, at = collocations.extended(word, word_at, 1, word, word_at)
    bounds = np.append(0, np.cumsum(n))
    got = {(words[a], words[b]): at[s:e].tolist() for a, b, s, e in zip(left, right, bounds, bounds[1:])}
    want = defaultdict(list)
    for i, pair in enumerate(zip(plain, plain[1:])):
        if None not in pair:
            want[pair].append(i)
    assert got == want


def plain_place(tree, key):
    node, nodes = (), sharding.children(tree)
    while node in nodes:
        draws = []
        for kid, weight in nodes[node].items():
            name = "/".join(map(str, kid))
            bits = int(hashlib.md5(f"{key}:{name}".encode()).hexdigest()[:13], 16)
            draws.append((-math.log((bits + 0.5) / 16**13) / weight, kid))
        node = min(draws)[1]
    return node[2]


@pytest.fixture(scope="module")
def sized(spark):
    rows = [(i, f"text {i % 50} é" * (i % 7)) for i in range(3000)] + [(7, "again"), (7, "again"), (None, None), (None, "x"), (5000, "long " * 200_000), (5001, None), (5002, "")]
    return rows, spark.createDataFrame([(*r, "clash", 9) for r in rows], "doc_id long, text string, TEXT string, shard int").repartition(5)


def test_shards(spark, sized):
    rows, docs = sized
    tree = sharding.topology(8)
    more = sharding.grow(tree)
    got = [r.asDict() for r in sharding.sharded(docs, tree, more).collect()]
    key = lambda i: "" if i is None else str(i)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", plain_place(tree, key(i)), plain_place(more, key(i))) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append((r["slot"], -1 if r["doc_id"] is None else r["doc_id"]))
    for found in slots.values():
        assert [s for s, _ in sorted(found)] == list(range(len(found))) and [i for _, i in sorted(found)] == sorted(i for _, i in found)
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got) and 0.07 < sum(r["grown_shard"] == 8 for r in got) / len(got) < 0.16
    assert all(300 < len(found) < 460 for found in slots.values())
    assert sharding.sharded(docs.limit(0), tree).count() == 0


def test_growing_again_moves_rows_into_the_new_shard_only():
    tree = sharding.topology(5)
    for _ in range(4):
        more = sharding.grow(tree)
        for key in range(400):
            old, new = plain_place(tree, str(key)), plain_place(more, str(key))
            assert new in (old, more[-1].shard)
        tree = more


def test_weights_move_rows_only_where_they_change():
    tree = [sharding.Shard(r, k, 4 * r + 2 * k + s, 1.0 + s) for r in range(2) for k in range(2) for s in range(2)]
    heavier = [s._replace(weight=s.weight * 3) if s.shard == 6 else s for s in tree]
    where = {s.shard: s[:2] for s in tree}
    moved = 0
    for key in range(2000):
        old, new = plain_place(tree, str(key)), plain_place(heavier, str(key))
        if old != new:
            moved += 1
            assert where[new][0] == 1  # region 1 alone has grown
            assert where[old][0] != 1 or where[new] == (1, 1)  # inside it, rack 1
            assert where[old] != (1, 1) or new == 6  # inside that, shard 6
    assert 0 < moved < 1000
    with pytest.raises(ValueError):
        sharding.children([sharding.Shard(0, 0, 0, 0.0)])
    with pytest.raises(ValueError):
        sharding.children([sharding.Shard(0, 0, 0, -1.0)])


def test_moves_and_written_shards(spark, sized, tmp_path):
    rows, docs = sized
    tree = sharding.topology(8)
    more = sharding.grow(tree)
    dealt = sharding.sharded(docs, tree, more)
    moves = [r.asDict() for r in sharding.moves(dealt, tree, more).collect()]
    assert {(r["to_region"], r["to_rack"], r["to_shard"]) for r in moves} == {(2, 0, 8)}
    assert sum(r["n_rows"] for r in moves) == dealt.where("shard <> grown_shard").count()
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, tree, path, 2)
    back = spark.read.parquet(path)
    assert back.count() == len(rows) and set(back.columns) == {"doc_id", "text", "shard"}
    assert {r["doc_id"]: r["shard"] for r in back.select("doc_id", "shard").collect()} == {r["doc_id"]: r["shard"] for r in dealt.collect()}


def brute_clusters(kept, k, rounds, seed):
    order = sorted(range(len(kept)), key=lambda i: (hashlib.sha256(f"{seed}:{'' if kept[i][0] is None else kept[i][0]}".encode()).hexdigest(), kept[i][1]))
    centroids = [list(kept[i][1]) for i in order[:k]]
    assign = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[assign(v)[1]].append(v)
        for j, vs in own.items():
            centroids[j] = [sum(x) // len(vs) for x in zip(*vs)]
    return sorted(((i is not None, i or 0), assign(v)[1], assign(v)[0]) for i, v in kept), centroids


def test_sort_means(spark):
    rng = np.random.default_rng(33)
    middles = rng.normal(0, 1, (6, 8))
    rows = [(i, (middles[i % 6] + rng.normal(0, 0.1, 8)).tolist()) for i in range(250)]
    rows += [(400 + i, [float(i % 2), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, float(i % 3) / 256]) for i in range(40)]  # ties
    rows += [(3, rows[5][1]), (3, rows[5][1]), (None, rows[9][1]), (500, None), (501, [None] * 8), (502, [1.0] * 7), (503, [float("nan")] * 8), (504, [float("inf")] * 8), (505, []), (506, [-1000.0] * 8)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, Embedding string").repartition(3)
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v)]
    for k, rounds in ((7, 3), (1, 1), (400, 2)):
        got, centroids = sortmeans.cluster(df, k, rounds, 8)
        want, middle = brute_clusters(kept, k, rounds, 2)
        assert sorted(((r["vec_id"] is not None, r["vec_id"] or 0), r["cluster"], r["distance"]) for r in got.collect()) == want
        assert centroids.tolist() == middle
    none, centroids = sortmeans.cluster(df.limit(0), 7, 3, 8)
    assert none.count() == 0 and len(centroids) == 0
    with pytest.raises(Exception, match="scales beyond"):
        sortmeans.cluster(spark.createDataFrame([(1, [1e30] * 8)], "vec_id long, embedding array<double>"), 2, 1, 8)


def test_sort_means_skips_distances_that_cannot_win():
    rng = np.random.default_rng(4)
    centroids = rng.integers(-5000, 5000, (40, 16))
    vectors = centroids[rng.integers(0, 40, 3000)] + rng.integers(-300, 300, (3000, 16))
    order, apart = sortmeans.neighbours(centroids)
    first, _, _ = sortmeans.nearest(vectors, centroids, order, apart, np.zeros(3000, np.int64))
    cluster, distance, taken = sortmeans.nearest(vectors, centroids, order, apart, first)
    exact = ((vectors[:, None, :] - centroids[None]) ** 2).sum(2)
    assert (cluster == exact.argmin(1)).all() and (distance == exact.min(1)).all() and taken < 0.2 * exact.size
