"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

Paragraphs are a text's lines; a long one is cut after words that end in one of a few fixed
bytes, so an edit inside it leaves the other pieces as they are. A piece's digest is a 64-bit
hash of its text and of how often it has occurred before in the document, so repeats count.

A sketch has three rows of cells; each digest goes into one cell of each row and adds to the
cell's count, to its sum of digests and to its sum of check hashes (modulo 2**64). Two sketches
subtract cell by cell; what both hold cancels. Peeling takes a cell with count +1 or -1 whose
check sum fits its digest, removes that digest everywhere and goes on, which recovers the
digests that only one side holds. If cells are left over, both sketches are made again larger,
then with twice the cells and so on; should a sketch of far more cells than digests still hold a knot (some of the
digests share all their cells), the digests themselves are compared.

Likeness of two sketches: 2 * shared / (digests of both), from the recovered difference; 1 for
equal texts (two empty ones too), 0 if nothing is shared.

The whole batch peels at once in numpy, so no Python step is taken per digest.

``with_next`` gives each row the row after it in descending doc_id (after the last: the first):
rows go to ranges of doc_id, whose bounds are quantiles, and are sorted there; the first row of
the range below is sent along as a guest. Each text moves once.

Nulls: null text is empty, null doc_id is below all others. Rows that share a doc_id are ordered
by text. Other columns are ignored; an empty table gives an empty result, and the only row of a
table is its own next one.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import pick

ROWS = 3
LONG = 80
# White space after a word that ends in one of these bytes ends a piece, and so does a line end.
_ENDS = re.compile(rb"\n|(?<=[abdhlprt.,|;!?])[ \t]+")


def digests(text: str) -> np.ndarray:
    """The text's paragraph digests, as a set that counts repeats."""
    h = xxhash.xxh3_64_intdigest
    found: Counter = Counter()
    for p in _ENDS.split(text.encode("utf-8")):
        if len(p) <= LONG:
            found[p] += 1
        else:  # no such word for long: word by word, and long words bit by bit
            for word in p.split():
                for i in range(0, len(word), LONG):
                    found[word[i : i + LONG]] += 1
    found.pop(b"", None)
    out = []
    for p, n in found.items():
        out.append(h(p))
        if n > 1:
            out.extend(h(b"%b\n%d" % (p, i)) for i in range(1, n))
    return np.unique(np.array(out, np.uint64))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Field:
    """Sketches of several documents side by side, ``ROWS * widths[i]`` cells for the i-th."""

    def __init__(self, widths: np.ndarray):
        self.widths = widths
        self.base = np.concatenate(([0], np.cumsum(ROWS * widths)))
        size = int(self.base[-1])
        self.count, self.keys, self.checks = np.zeros(size, np.int64), np.zeros(size, np.uint64), np.zeros(size, np.uint64)

    def add(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray | int = 1) -> None:
        sign = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
        unsigned = sign.astype(np.uint64)  # minus one is 2**64 - 1
        sums, checks = keys * unsigned, _mix(keys, 77) * unsigned
        width, base = self.widths[owner], self.base[owner]
        for r in range(ROWS):
            at = base + r * width + (_mix(keys, r + 1) % width.astype(np.uint64)).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.add.at(self.keys, at, sums)
            np.add.at(self.checks, at, checks)

    def minus(self, other: Field) -> Field:
        out = Field(self.widths)
        out.count, out.keys, out.checks = self.count - other.count, self.keys - other.keys, self.checks - other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(digest, document, +1 or -1) of what could be recovered, and which documents came out empty."""
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = len(self.widths)
        owner_of = np.repeat(np.arange(n), ROWS * self.widths)
        row_of = (np.arange(len(owner_of)) - self.base[owner_of]) // np.maximum(self.widths[owner_of], 1)
        quiet = 0
        row = 0
        while quiet < ROWS:
            # a digest has one cell in each row, so within a row no digest is found twice
            look = np.flatnonzero((np.abs(self.count) == 1) & (row_of == row))
            row = (row + 1) % ROWS
            sign = self.count[look]
            keys = np.where(sign > 0, self.keys[look], np.uint64(0) - self.keys[look])
            sums = np.where(sign > 0, self.checks[look], np.uint64(0) - self.checks[look])
            pure = _mix(keys, 77) == sums
            keys, sign, owner = keys[pure], sign[pure], owner_of[look[pure]]
            if len(keys):
                got.append((keys, owner, sign))
                self.add(keys, owner, -sign)
            quiet = 0 if len(keys) else quiet + 1
        left = owner_of[(self.count != 0) | (self.keys != 0) | (self.checks != 0)]
        whole = np.bincount(left, minlength=n) == 0
        if not got:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), whole
        return *(np.concatenate(x) for x in zip(*got)), whole

    def strings(self) -> list[str]:
        """Each sketch as text: counts as 16, digest sums as 64, check sums as 32 bits."""
        parts = [(self.count & 0xFFFF).astype("<u2"), self.keys.astype("<u8"), (self.checks & np.uint64(0xFFFFFFFF)).astype("<u4")]
        ends = self.base.tolist()
        return [base64.b85encode(b"".join(p[i:j].tobytes() for p in parts)).decode("ascii") for i, j in zip(ends, ends[1:])]


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate(lists) if lists else np.empty(0, np.uint64)
    return keys.astype(np.uint64), np.repeat(np.arange(len(lists)), [len(x) for x in lists])


def sketch(lists: list[np.ndarray], widths: int | np.ndarray) -> Field:
    field = Field(np.broadcast_to(np.asarray(widths, np.int64), (len(lists),)))
    field.add(*_flat(lists))
    return field


def difference_sizes(a: list[np.ndarray], b: list[np.ndarray], width: int, made: tuple[Field, Field] | None = None) -> np.ndarray:
    """How many digests only one of each two documents holds, by peeling, larger on failure.

    ``made``: the sketches of that width, if they are at hand.
    """
    both = np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64)
    out = np.zeros(len(a), np.int64)
    todo = np.arange(len(a))
    widths = np.full(len(a), width, np.int64)
    while len(todo):
        if made is None:
            made = tuple(sketch([x[i] for i in todo], widths[todo]) for x in (a, b))
        _, owner, _, whole = made[0].minus(made[1]).peel()
        made = None
        sizes = np.bincount(owner, minlength=len(todo))
        out[todo[whole]] = sizes[whole]
        todo = todo[~whole]
        # first as large as a difference in everything needs, then twice that and so on
        widths[todo] = np.maximum(2 * widths[todo], both[todo] // 2 + width)
        knots = todo[widths[todo] > 64 * (both[todo] + width)]
        for i in knots:
            out[i] = len(np.setxor1d(a[i], b[i], assume_unique=True))
        todo = np.setdiff1d(todo, knots) if len(knots) else todo
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray], width: int, made: tuple[Field, Field] | None = None) -> np.ndarray:
    both = np.array([len(x) + len(y) for x, y in zip(a, b)], np.float64)
    differ = difference_sizes(a, b, width, made)
    return np.where(both > 0, (both - differ) / np.maximum(both, 1), 1.0)


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """``docs(doc_id, text)`` to (bucket, guest, doc_id, text) in buckets of doc_id, for ``_follow``.

    Buckets hold descending ids; a guest is the row that comes after a bucket's last one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = ranges or 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))  # several to a task, so tasks are even
    ids = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    bounds = sorted(set(ids)) if parts > 1 else []
    # a row's bucket: how many bounds are at or below it; ids that equal share a bucket
    bucket = F.coalesce(F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<long>"), lambda x: x <= F.col("doc_id"))), F.lit(0)) if bounds else F.lit(0)
    dealt = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(bucket))
    # each bucket's first row in the order (largest id, then text) follows the last of the next bucket up
    heads = dealt.groupBy("bucket").agg(F.max("doc_id").alias("head")).orderBy("bucket").collect()  # one row per range
    above = {heads[i]["bucket"]: heads[(i + 1) % len(heads)]["bucket"] for i in range(len(heads))}
    tops = {h["bucket"]: h["head"] for h in heads}
    if not tops:
        return dealt.select("bucket", F.lit(False).alias("guest"), "doc_id", "text")
    top_of = F.create_map(*[F.lit(x) for b, h in tops.items() for x in (b, h)])
    to = F.create_map(*[F.lit(x) for kv in above.items() for x in kv])
    is_head = F.col("doc_id").eqNullSafe(top_of[F.col("bucket")])
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(to[F.col("bucket")].alias("bucket"), F.lit(True).alias("guest"))
    return dealt.withColumn("p", F.explode(F.when(is_head, F.array(own, guest)).otherwise(F.array(own)))).select("p.bucket", "p.guest", "doc_id", "text")


def _follow(width: int, batch_rows: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(rows: list[tuple]) -> pa.RecordBatch:
            edited = []
            for _, text, nxt in rows:
                half = len(text) // 2
                edited.append(text[: len(text) - half] + nxt[:half])
            own: dict[str, np.ndarray] = {}  # a row's next text is mostly the next row's own
            for r in rows:
                for t in r[1:]:
                    if t not in own:
                        own[t] = digests(t)
            mine, theirs, other = [own[r[1]] for r in rows], [digests(t) for t in edited], [own[r[2]] for r in rows]
            fields = [sketch(x, width) for x in (mine, theirs, other)]
            cols = [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(r[1]) for r in rows], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in edited], pa.string()),
                pa.array(fields[0].strings(), pa.string()),
                pa.array(fields[1].strings(), pa.string()),
                pa.array(likeness(mine, theirs, width, (fields[0], fields[1])), pa.float64()),
                pa.array(likeness(mine, other, width, (fields[0], fields[2])), pa.float64()),
            ]
            return pa.record_batch(cols, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        held: tuple | None = None  # the row that waits for its next one
        ready: list[tuple] = []
        for batch in batches:
            for bucket, guest, doc_id, text in zip(*[batch[c].to_pylist() for c in ("bucket", "guest", "doc_id", "text")]):
                if held is not None and held[0] == bucket:
                    ready.append((held[1], held[2], text))
                # only the first guest counts; a bucket's rows end with it
                held = None if guest else (bucket, doc_id, text)
                if len(ready) >= batch_rows:
                    yield work(ready)
                    ready = []
        if ready:
            yield work(ready)

    return run


def fingerprints(docs: DataFrame, width: int = 8) -> DataFrame:
    """``docs(doc_id, text)`` to fingerprints, edited fingerprints and likenesses, as ``op2`` returns them.

    ``width``: cells in each of a fingerprint's three rows.
    """
    rows = with_next(pick(docs, doc_id="doc_id", text="text"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(parts, "bucket").sortWithinPartitions(F.col("bucket"), F.col("guest"), F.col("doc_id").desc_nulls_last(), F.col("text"))
    return dealt.mapInArrow(_follow(width), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
