"""Mixture-controlled packing of documents into fixed-length token sequences.

Deficit round-robin: documents queue by source. Every round adds to each source's deficit
counter its quantum, the window's tokens times the source's target share, and sends the queue's
documents while the counter covers them; what is left carries over to the next window. A
document whose queue has brought e tokens up to its end therefore goes in round
``ceil(e / quantum)``, so rounds follow from running sums, which are taken over range
partitions with the partitions' own sums carried on: no queue passes through one task.

The rounds' documents, in order, form one stream of tokens that is cut every ``length`` tokens.
Documents may be cut anywhere and nothing is dropped; the rest of the stream is cut into
sequences of falling powers of two, so there is no padding. A window is ``window`` sequences.

Targets: by default each source's share of all tokens, which drains all queues together. A
source that ``targets`` doesn't name keeps its own share; queues that last longer than the
others fill the later windows.

Nulls: null text is empty (its only id is the end id), null source is a queue of its own, null
doc_id sorts first and is returned. Repeated rows are packed each. Other columns are ignored.
An empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import pick, stash

# On texts of these characters both libraries split words alike (tested); others take the slower one.
PLAIN = re.compile("[\t\n\r -~¡-¬®-ſ‐-‧]*")


class ByteBpe:
    """Ids as the tokenizers library gives them, by tiktoken with the same vocabulary where that is sure."""

    def __init__(self, path: str, ranks_path: str | None, pattern: str | None):
        import tokenizers

        self.slow = tokenizers.Tokenizer.from_file(path)
        self.added = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.dtype = "<u2" if self.slow.get_vocab_size() <= 1 << 16 else "<u4"
        self.fast = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and PLAIN.fullmatch(text) and not any(t in text for t in self.added):
            return self.fast.encode_to_numpy(text)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=4)
def load(path: str, ranks_path: str | None, pattern: str | None) -> ByteBpe:
    return ByteBpe(path, ranks_path, pattern)


def _tokenise(path: str, ranks_path: str | None, pattern: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, ranks_path, pattern)
        end = np.array([end_id], bpe.dtype).tobytes()
        for batch in batches:
            ids = [bpe.encode(t or "").astype(bpe.dtype).tobytes() + end for t in batch["text"].to_pylist()]
            width = np.dtype(bpe.dtype).itemsize
            yield pa.record_batch([batch["rid"], batch["doc_id"], batch["source"], pa.array([len(x) // width for x in ids], pa.int64()), pa.array([width] * len(ids), pa.int32()), pa.array(ids, pa.binary())], names=["rid", "doc_id", "source", "n", "width", "ids"])

    return run


def running_sum(df: DataFrame, order: list[Column], value: str, group: str | None = None) -> DataFrame:
    """``df`` with ``upto``, the sum of ``value`` (of the row's group) up to and with the row in ``order``,
    and ``total``, the sum of all (of the group). ``order`` starts with the group.

    Rows are range-partitioned; sums within partitions are carried on by the partitions' totals,
    of which there is one for each partition (and group in it).
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cols = df.columns
    key = F.col(group) if group else F.lit(0)
    ranged = stash(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).withColumn("_key", F.xxhash64(key)), "ranged")
    local = ranged.withColumn("_local", F.sum(value).over(Window.partitionBy("_part", "_key").orderBy(*order)))
    sums = ranged.groupBy("_part", "_key").agg(F.sum(value).alias("_sum"))
    each = Window.partitionBy("_key")
    base = stash(sums.select(F.col("_part").alias("_p"), F.col("_key").alias("_k"), (F.sum("_sum").over(each.orderBy("_part")) - F.col("_sum")).alias("_base"), F.sum("_sum").over(each).alias("total")), "base")
    joined = local.join(base, (local["_part"] == base["_p"]) & (local["_key"] == base["_k"]))
    return joined.select(*cols, (F.col("_local") + F.col("_base")).alias("upto"), "total")


def _cut(length: int, total: int):
    """Pieces of documents at positions of the stream; the rest after full sequences by powers of two."""
    full = total // length
    tail, at = [], full * length
    for bit in range(length.bit_length(), -1, -1):
        if (total - full * length) >> bit & 1:
            tail.append(at)
            at += 1 << bit
    ends = [*tail[1:], total] if tail else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
        for batch in batches:
            rows = []
            for doc_id, source, n, width, raw, begin in zip(*[batch[c].to_pylist() for c in ("doc_id", "source", "n", "width", "ids", "begin")]):
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                at = 0
                while at < n:
                    pos = begin + at
                    if pos < full * length:
                        seq, first, last = pos // length, pos // length * length, (pos // length + 1) * length
                    else:
                        k = max(i for i, x in enumerate(tail) if x <= pos)
                        seq, first, last = full + k, tail[k], ends[k]
                    size = min(n - at, last - pos)
                    rows.append((doc_id, at, size, zlib.crc32(ids[at : at + size].tobytes()), n, seq, pos - first, source))
                    at += size
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return run


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, end_id: int = 1, length: int = 2048, window: int = 64, targets: dict[str, float] | None = None) -> DataFrame:
    """``docs(doc_id, text, source)`` to pieces ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source)``.

    ``targets``: shares of the tokens of each window by source, put in proportion; a source not named has its own
    share of all tokens. ``ranks_path`` and ``pattern`` name the same vocabulary for the faster library, if there is one.
    """
    rows = pick(docs, doc_id="doc_id", text="text", source="source").select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"))
    tokens = stash(rows.mapInArrow(_tokenise(tokenizer_path, ranks_path, pattern, end_id), "rid long, doc_id long, source string, n long, width int, ids binary"), "tokens")
    total = tokens.agg(F.sum("n")).first()[0] or 0
    queues = running_sum(tokens.select("rid", "doc_id", "source", "n"), [F.col("source"), F.col("doc_id"), F.col("rid")], "n", "source")
    share = F.col("total") / F.lit(float(max(total, 1)))
    if targets:
        if min(targets.values()) <= 0:
            raise ValueError("a source's target share must be over 0")
        given = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])
        share = F.coalesce(F.try_element_at(given, F.col("source")), share)
        whole = queues.groupBy("source").agg(F.first("total").alias("total")).agg(F.sum(share)).first()[0] or 1.0
        share = share / F.lit(whole)  # of a window all sources together get the whole
    rounds = queues.withColumn("round", F.ceil(F.col("upto") / (F.lit(float(window * length)) * share)).cast("long"))
    stream = _stream(rounds)
    placed = tokens.join(stream, "rid")
    return placed.mapInArrow(_cut(length, total), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")


def _stream(rounds: DataFrame) -> DataFrame:
    """Each row's first position in the stream of all rounds."""
    rows = rounds.select("rid", "n", "round", "source", F.col("upto").alias("at"))
    summed = running_sum(rows, [F.col("round"), F.col("source"), F.col("at")], "n")
    return summed.select("rid", (F.col("upto") - F.col("n")).alias("begin"))


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers as public

    return pack(docs, public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
