"""SimHash near-dedup with pigeonring filtering.

Fingerprint: words are lower-cased (A-Z only) and split at ``[\\x20\\x09-\\x0D]``; every k-word
shingle, repeats included, votes with its XXH64 (seed 42); a bit is 1 if over half of the
hashes have it. Documents of no words (null, empty, white space) get fingerprint zero and are
linked like any other.

Links: 64 bits lie on a ring of ``boxes`` segments. If two fingerprints differ in at most
``budget`` bits, there is a segment from which every chain of the next l segments differs in
at most ``l * budget / boxes`` bits (rounded down), for l from 1 to ``boxes``. So a pair is
joined on the bits of the first ``chain`` segments of such a chain: one side as they are, the
other with every difference that the chain's budgets allow. Longer chains prune the pairs
before the full Hamming check. With 5 segments, budget 4 and chain 2 a key has 26 bits and 14
allowed differences; a longer chain makes keys more selective for larger corpora.

Scale: equal fingerprints are one row from the start, so exact copies never meet in the join.
Where many different fingerprints share a key (large groups of near copies), those one bit
apart are linked first through groups of two (the fingerprint with one bit cleared); the join
then gives only pairs that are not yet in one component.

The operator can also link documents by a stated similarity of their shingle sets, whatever their
fingerprints: ``setjoin`` finds these links exactly and joins them to those of the fingerprints.

Nulls: a null doc_id is kept with its fingerprint and gets the component of its fingerprint's
group (null if no id is known there). Repeated rows give repeated results. Other columns of
the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .scratch import numbered, pick, place_of, stash
from .setjoin import SHARE, class_of, similar_links
from .shingles import shingle_hashes, words_of

_CHUNK = 1 << 18


def simhash(hashes: np.ndarray) -> int:
    """Majority bits of unsigned 64-bit hashes as a signed 64-bit integer."""
    n = len(hashes)
    if n == 0:
        return 0
    votes = np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        part = np.ascontiguousarray(hashes[i : i + _CHUNK])
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.int64)[0])


def fingerprint_column(text, k: int = 4):
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(shingle_hashes(words_of(t), k)) for t in texts], dtype="int64")

    return of(text)


def _widths(boxes: int) -> list[int]:
    return [64 // boxes + (i < 64 % boxes) for i in range(boxes)]


def chain_masks(widths: list[int], budget: int, boxes: int) -> list[int]:
    """Differences of the first len(widths) segments that every chain's budget allows."""
    total = sum(widths)
    ends = np.cumsum(widths).tolist()
    masks = []
    for n in range(budget * len(widths) // boxes + 1):
        for at in combinations(range(total), n):
            if all(sum(p < end for p in at) <= (j + 1) * budget // boxes for j, end in enumerate(ends)):
                masks.append(sum(1 << (total - 1 - p) for p in at))
    return masks


def _ring(fps: DataFrame, boxes: int, chain: int) -> DataFrame:
    """A row for each segment of each fingerprint: the ring turned to start there, and its key."""
    widths = _widths(boxes)
    starts = np.cumsum([0, *widths]).tolist()
    turned = []
    for i in range(boxes):
        bits = sum(widths[(i + j) % boxes] for j in range(chain))
        turn = f"shiftleft(fp, {starts[i]}) | shiftrightunsigned(fp, {64 - starts[i]})" if i else "fp"
        turned.append(f"named_struct('start', {i}, 'rot', {turn}, 'bits', shiftrightunsigned({turn}, {64 - bits}))")
    return fps.selectExpr("*", f"explode(array({', '.join(turned)})) as r").selectExpr("*", "r.start", "r.rot", "r.bits").drop("r")


def _within(boxes: int, budget: int, chain: int) -> str:
    """The chain conditions on l.rot and r.rot, shortest first, and the full Hamming check.

    Segments are turned to the front, so l of them are the first bits; their widths depend on
    the start.
    """
    widths = _widths(boxes)
    tests = []
    for n in range(chain + 1, boxes):
        shifts = ", ".join(str(64 - sum(widths[(i + j) % boxes] for j in range(n))) for i in range(boxes))
        tests.append(f"bit_count(shiftrightunsigned(l.rot ^ r.rot, element_at(array({shifts}), l.start + 1))) <= {n * budget // boxes}")
    return " and ".join([*tests, f"bit_count(l.rot ^ r.rot) <= {budget}"])


def hamming_pairs(labelled: DataFrame, budget: int, boxes: int, chain: int) -> DataFrame:
    """``labelled(fp, label)`` to the pairs ``(u, v)`` of fingerprints within ``budget`` bits whose labels differ."""
    if not 0 <= budget < 2 * boxes or not 1 <= chain <= boxes:
        raise ValueError("the budget must be under twice the number of segments, the chain within it")
    index = stash(_ring(labelled.select("fp", "label"), boxes, chain).selectExpr("start", "rot", f"bits * {boxes} + start as key", "bits", "fp", "label"), "ring")
    widths = _widths(boxes)
    masks = [chain_masks([widths[(i + j) % boxes] for j in range(chain)], budget, boxes) for i in range(boxes)]
    every = "array(" + ", ".join("array(" + ", ".join(f"{m}L" for m in of) + ")" for of in masks) + ")"
    # of two keys that differ, the one with the highest differing bit set looks for the other
    probes = index.selectExpr("start", "rot", "fp", "label", "bits", f"explode(element_at({every}, start + 1)) as mask").where("mask = 0 or (bits & ~(bits ^ mask)) > ((bits ^ mask) & ~bits)").selectExpr("start", "rot", "fp", "label", f"(bits ^ mask) * {boxes} + start as key", "mask")
    pairs = probes.alias("l").join(index.alias("r"), F.expr(f"l.key = r.key and l.label <> r.label and (l.mask <> 0 or l.fp < r.fp) and {_within(boxes, budget, chain)}"))
    return pairs.select(F.col("l.fp").alias("u"), F.col("r.fp").alias("v"))


def hamming_links(fps: DataFrame, budget: int = 4, boxes: int = 5, chain: int = 2, crowd: int = 64) -> DataFrame:
    """Distinct ``fps(fp)`` to edges ``(u, v)`` with the same components as all pairs within budget.

    Keys of more than ``crowd`` fingerprints are crowded: their members are first linked one
    bit apart, and pairs already in one component are left out.
    """
    crowded = _ring(fps.select("fp"), boxes, chain).selectExpr("fp", f"bits * {boxes} + start as key")
    members = crowded.join(crowded.groupBy("key").count().where(F.col("count") > crowd), "key", "left_semi").select("fp").distinct()
    cleared = members.selectExpr("fp", "explode(sequence(0, 63)) as bit").selectExpr("fp", "bit", "fp & ~shiftleft(1L, bit) as rest")
    near = cleared.groupBy("bit", "rest").agg(F.min("fp").alias("u"), F.max("fp").alias("v")).where("u <> v").select("u", "v") if budget else members.selectExpr("fp as u", "fp as v").limit(0)
    near = stash(near, "near")
    return hamming_pairs(_labelled(fps, components(near)), budget, boxes, chain).union(near)


def _labelled(fps: DataFrame, roots: DataFrame) -> DataFrame:
    """``fps`` with ``label``, the root of each fingerprint (itself, if it has none)."""
    return fps.join(roots, fps.fp == roots.node, "left").select(*fps.columns, F.coalesce("root", "fp").alias("label"))


def near_duplicates(docs: DataFrame, k: int = 4, budget: int = 4, boxes: int = 5, chain: int = 2, similarity: float | None = None, set_k: int = 5) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, fingerprint, component_id, text_hash)``, one row each.

    With ``similarity``, documents whose sets of ``set_k``-word shingles have that Jaccard similarity
    are linked too, whatever their bits (see ``setjoin``).
    """
    rows = pick(docs, doc_id="doc_id", text="text")
    own = ["doc_id", F.xxhash64("text").alias("text_hash")]
    if similarity is None:
        marked = rows.select(*own, fingerprint_column("text", k).alias("fp"))
    else:
        marked = rows.select(*own, _marks("text", k, set_k).alias("m")).select("doc_id", "text_hash", "m.*")
    marked = stash(marked, "marked")
    fps = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    links = hamming_links(fps, budget, boxes, chain)
    if similarity is not None:
        one = F.min(F.struct("doc_id", "text_hash"))
        classes = stash(marked.groupBy("class").agg(F.first("size").alias("size"), F.first("part").alias("part"), F.min("fp").alias("node"), one.alias("d")).selectExpr("class", "size", "part", "node", "d.doc_id", "d.text_hash"), "classes")
        same = marked.join(classes.select("class", "node"), "class").where("size > 0 and fp <> node").selectExpr("fp as u", "node as v").distinct()
        links = similar_links(docs, classes, stash(links.union(same), "links"), similarity, set_k)
    roots = components(links)
    rooted = stash(fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    named = stash(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash")


def _marks(text, k: int, set_k: int):
    """The fingerprint and, of the set of ``set_k``-word shingles, name, size and how many are in the sampled share."""

    @F.pandas_udf("fp long, class long, size int, part int")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            words = words_of(t)
            own = np.unique(shingle_hashes(words, set_k))
            rows.append((simhash(shingle_hashes(words, k)), class_of(own), len(own), int((own % SHARE == 0).sum())))
        return pd.DataFrame(rows, columns=["fp", "class", "size", "part"]).astype({"fp": "int64", "class": "int64", "size": "int32", "part": "int32"})

    return of(text)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs(doc_id, text, ...)`` so that one document of each component stays: that of the
    smallest doc_id (of rows that share it, the one of the smallest text hash, once). Documents of
    a similarity of 0.8 or more in five-word shingles are near copies here, whatever their bits.
    Rows of null doc_id stay, one for each text, where no row with an id is in their component."""
    found = near_duplicates(docs, **{"similarity": 0.8} | options)
    group = ["component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("_alone")]
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(*group).agg(F.min("text_hash").alias("_hash")).select(F.col("component_id").alias("_id"), "_hash")
    first = stash(first, "first")
    rows, names = numbered(docs)
    doc_id, text = (place_of(names, c) for c in ("doc_id", "text"))
    same = F.col(doc_id).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash"))
    return rows.join(first, same, "left_semi").dropDuplicates([doc_id, text]).toDF(*names)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "fingerprint", "component_id")
