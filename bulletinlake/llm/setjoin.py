"""Exact links between texts whose sets of word shingles have a Jaccard similarity of t or more.

Prefix filter: with the shingles of all sets in one order, rarest first, two such sets share one of
the first ``n - ceil(t n) + 1`` of the larger and of the first ``n - ceil(2t n / (1 + t)) + 1`` of
the smaller; and at the first one they share, what is left of either set must be enough. A set with
more shingles of its own than its prefix is long has no partner, which leaves few of a corpus:

1. Of every set the shingles whose hash is divisible by ``SHARE`` are counted. Sets whose own ones
   among these already fill their prefix are out. This moves a third of the shingles.
2. All shingles of the remaining sets are counted and ordered; only prefixes go on.
3. Members of a shingle's group are linked to the group's representative, the one with the most
   left behind the shingle. After that only pairs that aren't yet in one component are joined, so a
   large group of copies of one text isn't spelled out as pairs.
4. Every candidate pair is compared set by set; no link rests on a sketch.

Equal sets are one class from the start. Hashes are range-partitioned with the class as second key,
so one that a third of all texts hold spreads over partitions; runs at the ends of partitions, and
those longer than a chunk, are summed from summaries (a few rows a partition, broadcast).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .ranges import ranged
from .scratch import asked_for, pick, stash
from .shingles import shingle_hashes, words_of

SHARE = 3
ROW, OPEN, SUMMARY = 0, 1, 2
REMEMBERED = 100_000  # classes a task remembers so as not to give them out twice
RUNS = "kind int, hash long, class long, size int, freq long"


def shingle_set(text: str | None, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(words_of(text), k))


def class_of(of: np.ndarray) -> int:
    """A signed 64-bit name of the set."""
    return xxhash.xxh64_intdigest(of.tobytes()) - (1 << 63)


def _emit(k: int, share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            hashes, classes, sizes = [np.empty(0, np.uint64)], [], []
            for text in batch["text"].to_pylist():
                own = shingle_set(text, k)
                name = class_of(own)
                if not len(own) or name in known:
                    continue
                if len(known) >= REMEMBERED:
                    known.clear()
                known.add(name)
                part = own[own % share == 0]
                hashes.append(part)
                classes.append((name, len(part)))
                sizes.append(len(own))
            times = [n for _, n in classes]
            yield pa.record_batch([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.repeat(np.array([c for c, _ in classes], np.int64), times)), pa.array(np.repeat(np.array(sizes, np.int32), times))], names=["hash", "class", "size"])

    return run


def _runs(chunk: int = 1 << 16):
    """Rows sorted by (hash, class) to those whose hash has at least two classes, with their number.

    Rows of a partition's first and last run, and of runs over ``chunk``, are open: summaries tell their numbers.
    """

    def out(kind, h, c, n, f):
        return pa.record_batch([pa.array(np.full(len(h), kind, np.int32)), pa.array(h), pa.array(c), pa.array(n), pa.array(f)], names=["kind", "hash", "class", "size", "freq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]
        last = opened = None  # the last (hash, class) given out; the hash of a run that is open
        first = True
        for b in chain(batches, (None,)):
            now = held if b is None else [np.concatenate((a, b[x].to_numpy(zero_copy_only=False))) for a, x in zip(held, ("hash", "class", "size"))]
            h, c, n = now
            if not len(h):
                continue
            new = np.concatenate(([last != (h[0], c[0])], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
            h, c, n = h[new], c[new], n[new]
            if not len(h):
                held = [h, c, n]
                continue
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(h)])))
            whole = len(starts) if b is None or sizes[-1] > chunk else len(starts) - 1
            end = len(h) if whole == len(starts) else int(starts[-1])
            held = [x[end:] for x in (h, c, n)]
            if not whole:
                continue
            is_open = np.zeros(whole, bool)
            is_open[0] = first or h[0] == opened
            if whole == len(starts):
                is_open[-1] = True
                opened = h[-1]
            first = False
            last = (h[end - 1], c[end - 1])
            lengths = sizes[:whole]
            freq = np.repeat(lengths, lengths)
            opens = np.repeat(is_open, lengths)
            done = ~opens & (freq > 1)
            yield out(ROW, h[:end][done], c[:end][done], n[:end][done], freq[done])
            if opens.any():
                yield out(OPEN, h[:end][opens], c[:end][opens], n[:end][opens], freq[opens])
                heads = starts[:whole][is_open]
                yield out(SUMMARY, h[heads], c[heads], n[heads], lengths[is_open])

    return run


def shared_shingles(texts: DataFrame, n_texts: int, k: int, share: int) -> DataFrame:
    """``texts(text)``, about ``n_texts`` of them, to ``(hash, class, size, freq)`` of the shingles that at least two classes hold."""
    rows = ranged(texts.select("text"), n_texts, _emit(k, share), "hash long, class long, size int", "hash", "class")
    seen = stash(rows.sortWithinPartitions("hash", "class").mapInArrow(_runs(), RUNS), "shared")
    totals = seen.where(F.col("kind") == SUMMARY).groupBy("hash").agg(F.sum("freq").alias("freq")).where("freq > 1")
    late = seen.where(F.col("kind") == OPEN).drop("kind", "freq").join(F.broadcast(totals), "hash")
    return seen.where(F.col("kind") == ROW).drop("kind").unionByName(late)


def ratio(similarity: float) -> tuple[int, int]:
    """The similarity as a fraction of small integers, so that no bound is lost by rounding."""
    exact = Fraction(similarity).limit_denominator(1000)
    return exact.numerator, exact.denominator


def _least(size: str, num: int, den: int) -> str:
    return f"({size} * {num} + {den - 1}) div {den}"


def _may_match(num: int, den: int) -> str:
    """Conditions on a shared shingle's rows l (of the larger set) and r."""
    need = _least("(l.size + r.size)", num, num + den)
    inside = f"r.pos <= r.size - {_least('r.size', 2 * num, num + den)}"
    larger = "(l.size > r.size or l.size = r.size and l.class > r.class)"
    return f"{larger} and {inside} and r.size * {den} >= l.size * {num} and least(l.size - l.pos, r.size - r.pos) >= {need}"


def _prefixes(shared: DataFrame, num: int, den: int) -> DataFrame:
    """``(hash, class, size, pos)``: the shingles in each set's prefix, rarest first, and their places in it."""
    ordered = shared.groupBy("class", "size").agg(F.array_sort(F.collect_list(F.struct("freq", "hash"))).alias("of")).withColumn("own", F.expr("size - size(of)"))
    left = f"size - {_least('size', num, den)} + 1 - own"
    cut = ordered.where(f"{left} > 0").selectExpr("class", "size", "own", f"posexplode(slice(of, 1, int({left}))) as (at, s)")
    return cut.selectExpr("s.hash as hash", "class", "size", "own + at as pos")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``pairs(a, b)`` of classes that are similar indeed."""

    @F.pandas_udf("boolean")
    def alike(one: pd.Series, two: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(one, two):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            out.append(len(np.intersect1d(p, q, assume_unique=True)) * (num + den) >= num * (len(p) + len(q)))
        return pd.Series(out, dtype=bool)

    left, right = sets.selectExpr("class as a", "of as s"), sets.selectExpr("class as b", "of as t")
    return pairs.join(left, "a").join(right, "b").where(alike("s", "t")).select("a", "b")


def similar_links(docs: DataFrame, classes: DataFrame, links: DataFrame, similarity: float, k: int) -> DataFrame:
    """``links(u, v)`` between nodes, and further ones for each two texts that are similar but not yet in one component.

    ``docs(doc_id, text)``; ``classes(class, size, part, node, doc_id, text_hash)`` has a row for each
    different set of ``k``-word shingles: its size, how many of its hashes are divisible by ``SHARE``, the node
    that stands for it, and one document that has it (``text_hash`` is xxhash64 of its text).
    """
    num, den = ratio(similarity)
    rows = pick(docs, doc_id="doc_id", text="text")
    counts = shared_shingles(rows, rows.count(), k, SHARE).groupBy("class").agg(F.count("*").alias("n"))
    left = classes.where("size > 0").join(counts, "class", "left").where(f"part - coalesce(n, 0) <= size - {_least('size', num, den)}")
    left = stash(left.drop("n"), "left")

    def texts_of(some: DataFrame) -> DataFrame:
        named = some.selectExpr("class", "doc_id as _id", "text_hash as _hash")
        near = asked_for(rows, some, "doc_id").withColumn("hash", F.xxhash64("text"))
        return near.join(named, F.expr("doc_id <=> _id and hash = _hash")).dropDuplicates(["class"]).select("class", "text")

    prefixes = stash(_prefixes(shared_shingles(texts_of(left), left.count(), k, 1), num, den), "prefixes")
    rule = _may_match(num, den)
    head = prefixes.groupBy("hash").agg(F.min(F.struct((F.col("pos") / F.col("size")).alias("share"), "class", "size", "pos")).alias("h")).selectExpr("hash", "h.class", "h.size", "h.pos")
    turned = rule.replace("l.", "_.").replace("r.", "l.").replace("_.", "r.")
    first = prefixes.alias("l").join(head.alias("r"), F.expr(f"l.hash = r.hash and (({rule}) or ({turned}))")).selectExpr("least(l.class, r.class) as a", "greatest(l.class, r.class) as b")
    first = stash(first.distinct(), "stars")
    asked = left.join(prefixes.select("class").distinct(), "class", "left_semi")

    @F.pandas_udf("binary")
    def members(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, k).tobytes() for t in texts], dtype=object)

    sets = stash(texts_of(asked).select("class", members("text").alias("of")), "sets")
    nodes = classes.select("class", "node")

    def as_links(pairs: DataFrame) -> DataFrame:
        named = pairs.join(nodes.selectExpr("class as a", "node as u"), "a").join(nodes.selectExpr("class as b", "node as v"), "b")
        return named.select("u", "v").where("u <> v")

    found = stash(links.select("u", "v").union(as_links(_verified(first, sets, num, den))), "star_links")
    roots = components(found)
    labels = asked.select("class", "node").join(roots.withColumnRenamed("node", "_node"), F.expr("node = _node"), "left").selectExpr("class", "coalesce(root, node) as label")
    labelled = prefixes.join(labels, "class")
    rest = labelled.alias("l").join(labelled.alias("r"), F.expr(f"l.hash = r.hash and l.label <> r.label and {rule}")).selectExpr("least(l.class, r.class) as a", "greatest(l.class, r.class) as b").distinct()
    rest = stash(rest.join(first, ["a", "b"], "left_anti"), "rest")
    return found.union(as_links(_verified(rest, sets, num, den)))
