"""Phrase collocation mining over vertical positional inverted lists, each language for itself.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at blanks and tabs into words.
A phrase's list holds the places where it begins; the list's length is its exact frequency.
Lists of k words are extended to k + 1 by a merge join of the places right after each occurrence with the
lists of single words. Only phrases of at least ``least`` occurrences are extended, by words of as many,
and (from three words on) only where the k words one further on are as frequent too; no other phrase can reach ``least``.

A candidate (2 to ``longest`` words) is scored for each cut into two parts as
``floor(1000000 a^2 / (l r))`` with the frequencies of the whole and the parts; the lowest counts,
ties to the smallest first part. Candidates inside a longer one that has ``100 f(longer) >= share a`` are
dropped; as a longer one's frequency is never above that of the parts in between, those one word longer tell all.
Of each language the best ``top`` stay, by score, frequency and the phrase's UTF-8 bytes. Decimals of 38 digits hold the
products exactly up to 10**15 occurrences.

Scale: texts are read once, into blocks of about ``BLOCK`` bytes of one language (a task holds eight blocks' worth of all
languages at most) with words as small numbers; a longer text is a block of its own. Lists live inside
blocks, where they are made again for each length: blocks move, and no list of a frequent word is
ever in one place. Most of a block's phrases are rare, so before any is counted as a row, 32-bit hashes of all of them
go to parts by further bits of the hash (``PART`` of them a part, as many parts as that takes); what is too rare by hash is too rare.
Bits that tell which phrases stay go back to the blocks; these are counted exactly, as one row a block
however often they occur in it, so frequent words and phrases are no hot keys. Nothing is broadcast, and a
language that holds most of the words is many blocks. The best of a language are taken in two steps, the first in many tasks.

Null text is empty, null lang is ``und``. Repeated rows count each time. Other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import pick, stash

BLOCK = 1 << 21  # bytes of text
PART = 1 << 21  # hashes that one task counts
SALTS = 64  # tasks that share a language's candidates
END = b"\xff"  # between pieces; no byte of UTF-8
_BYTES = bytes(0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
BLOCKS = "block long, lang string, n_words long, words array<string>, counts array<long>, codes binary"
PASSED = "block long, ids array<long>, n array<long>, parts array<int>, hashes array<binary>, counts array<binary>"


def coded(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of texts and, for every place, the number of its word; one past the last between pieces."""
    places = b" \xff ".join(texts).translate(_BYTES).replace(END, b" \xff ").split()
    number: defaultdict[bytes, int] = defaultdict(count(1).__next__)
    number[END] = 0
    codes = np.fromiter(map(number.__getitem__, places), np.int64, len(places)) - 1
    codes[codes < 0] = len(number) - 1
    return list(number)[1:], codes.astype("<u2" if len(number) <= 1 << 16 else "<u4")


def _block(texts: list[bytes], lang: str, block: int) -> pa.RecordBatch | None:
    words, codes = coded(texts)
    if not words:
        return None
    counts = np.bincount(codes, minlength=len(words) + 1)[: len(words)]
    cols = [pa.array([block], pa.int64()), pa.array([lang], pa.string()), pa.array([int(counts.sum())], pa.int64()), pa.array([words], pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64())), pa.array([zlib.compress(codes.tobytes(), 1)], pa.binary())]
    return pa.record_batch(cols, names=["block", "lang", "n_words", "words", "counts", "codes"])


def _blocks(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = count(TaskContext.get().partitionId() << 32)
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def close(langs: list[str]) -> Iterator[pa.RecordBatch]:
            for lang in langs:
                size.pop(lang)
                made = _block(held.pop(lang), lang, next(numbers))
                if made is not None:
                    yield made

        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
                if text:
                    held.setdefault(lang, []).append(text)
                    size[lang] = size.get(lang, 0) + len(text)
                    if size[lang] >= block_bytes:
                        yield from close([lang])
            if sum(size.values()) >= 8 * block_bytes:
                yield from close(list(size))
        yield from close(list(size))

    return run


def postings(codes: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of the frequent words (their numbers, ascending), one after the other: whose it is, and the place."""
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    which = np.full(int(max(codes.max(), frequent.max(initial=0))) + 1, -1)
    which[frequent] = np.arange(len(frequent))
    owner = which[codes]
    at = np.flatnonzero(owner >= 0)
    at = at[np.argsort(owner[at], kind="stable")]
    return owner[at], at


def extended(owner: np.ndarray, at: np.ndarray, k: int, word: np.ndarray, word_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lists of k-word phrases, merge-joined with those of words k places on: phrase, word and length of each new list, and their places."""
    if k > 1:  # the k words from the second on must be frequent as well
        goes_on = np.isin(at + 1, at)
        owner, at = owner[goes_on], at[goes_on]
    order = np.argsort(word_at)
    there = word_at[order]
    i = np.searchsorted(there, at + k)
    hit = np.flatnonzero(i < len(there))
    hit = hit[there[i[hit]] == at[hit] + k]
    width = int(word.max(initial=0)) + 1
    key = owner[hit] * width + word[order[i[hit]]]
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[hit[order]]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    return key[starts] // width, key[starts] % width, np.diff(np.append(starts, len(key))), at


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of word ids."""
    h = np.zeros(len(ids), np.uint64)
    for column in ids.T:
        h = (h ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def dealt(ids: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases (rows of word ids) by part and hash: their order, and in it part and 32-bit hash."""
    h = _mixed(ids)
    part, low = ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int32), h.astype(np.uint32)
    order = np.lexsort((low, part))
    return order, part[order], low[order]


def _list(values, kind: pa.DataType) -> pa.Array:
    return pa.array([values], pa.list_(kind))


def _pass(length: int, longest: int, least: int, parts: int):
    """Blocks, their frequent words and what passed by hash of 2 .. ``length`` words, to the phrases of ``length`` words with
    the lengths of their lists (``length`` > 1) and, by part, to hashes and lengths of the lists that are one word longer."""
    kind = np.dtype("<u1" if least < 256 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                numbers, word_ids = (b[c][row].values.to_numpy(zero_copy_only=False) for c in ("numbers", "ids"))
                codes = np.frombuffer(zlib.decompress(b["codes"][row].as_py()), f"<u{b['width'][row].as_py()}")
                word, word_at = postings(codes, numbers)
                owner, at, phrases = word, word_at, np.arange(len(numbers))[:, None]
                for k in range(1, min(length + 1, longest)):
                    left, right, n, at = extended(owner, at, k, word, word_at)
                    phrases = np.concatenate((phrases[left], right[:, None]), axis=1)
                    if k < length:  # keep what passed
                        order, _, _ = dealt(word_ids[phrases], parts)
                        bits = np.concatenate([np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["size"]) for x in b[f"passed{k + 1}"][row].as_py() or ()] or [np.zeros(0, np.uint8)])
                        stays = np.zeros(len(n), bool)
                        stays[order[bits > 0]] = True
                        phrases, owner = phrases[stays], np.repeat(np.where(stays, np.cumsum(stays) - 1, -1), n)
                        at, owner, n = at[owner >= 0], owner[owner >= 0], n[stays]
                        counted = phrases, n
                if length == longest:
                    counted = phrases, n
                ids, sizes = (word_ids[counted[0]].ravel(), counted[1]) if length > 1 else ((), ())
                each, hashes, counts = [], [], []
                if length < longest and len(n):
                    order, part, low = dealt(word_ids[phrases], parts)
                    n = np.minimum(n[order], least).astype(kind)
                    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(part)]):
                        each.append(int(part[s]))
                        hashes.append(low[s:e].astype("<u4").tobytes())
                        counts.append(n[s:e].tobytes())
                cols = [b["block"].slice(row, 1), _list(ids, pa.int64()), _list(sizes, pa.int64()), _list(each, pa.int32()), _list(hashes, pa.binary()), _list(counts, pa.binary())]
                yield pa.record_batch(cols, names=["block", "ids", "n", "parts", "hashes", "counts"])

    return run


def _judge(least: int):
    """All rows of one part to the bits of what occurs often enough by hash."""
    kind = np.dtype("<u1" if least < 256 else "<u4")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, "<u4") for x in table["hashes"].to_pylist()]
        counts = np.concatenate([np.frombuffer(x, kind) for x in table["counts"].to_pylist()])
        _, which = np.unique(np.concatenate(hashes), return_inverse=True)
        passed = (np.bincount(which, counts) >= least)[which]
        sizes = [len(h) for h in hashes]
        bits = [np.packbits(x).tobytes() for x in np.split(passed, np.cumsum(sizes)[:-1])]
        return pa.table([table["block"], table["part"], pa.array(sizes, pa.int32()), pa.array(bits, pa.binary())], names=["block", "part", "size", "bits"])

    return run


def mined(docs: DataFrame, least: int = 10, longest: int = 3, block_bytes: int = BLOCK) -> list[DataFrame]:
    """Tables of the frequent phrases of 1, 2, ... ``longest`` words of ``docs(lang, text)``, and last the words of each language ``(lang, n)``.

    Columns: ids (of the words), lang, text, a (frequency), firsts and rests (frequencies of both parts of each cut).
    """
    rows = pick(docs, lang="lang", text="text").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    blocks = stash(rows.mapInArrow(_blocks(block_bytes), BLOCKS), "blocks")
    n_blocks, n_words = blocks.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_blocks // 8)
    hash_parts = max(1, n_words // PART)
    each = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts"))).select("block", "lang", F.col("pos").alias("i"), F.col("col.words").alias("text"), F.col("col.counts").alias("n"))
    # a word has one row a block; the smallest of its rows' numbers is its id
    numbered = each.repartition(parts, "lang", "text").withColumn("rid", F.monotonically_increasing_id())
    of_word = Window.partitionBy("lang", "text")
    held = stash(numbered.withColumn("a", F.sum("n").over(of_word)).where(F.col("a") >= least).withColumn("id", F.min("rid").over(of_word)), "words")
    none = F.array().cast("array<long>")
    words = held.where("rid = id").select(F.array("id").alias("ids"), "lang", "text", "a", none.alias("firsts"), none.alias("rests"))
    frequent = held.select("block", "i", "id").repartition(parts, "block").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("i", "id"))).alias("f")).select("block", F.col("f.i").alias("numbers"), F.col("f.id").alias("ids"))
    joined = blocks.select("block", "codes", F.when(F.size("words") < 1 << 16, 2).otherwise(4).alias("width")).repartition(parts, "block").join(stash(frequent, "frequent"), "block")
    levels = [words]
    for length in range(1, longest + 1):
        if length == longest == 1:
            break
        done = stash(joined.mapInArrow(_pass(length, longest, least, hash_parts), PASSED), "passed")
        if length > 1:
            phrase = F.explode(F.expr(f"transform(sequence(0, size(n) - 1), i -> struct(slice(ids, i * {length} + 1, {length}) as ids, n[i] as n))")).alias("p")
            found = done.where("size(n) > 0").select(phrase).groupBy("p.ids").agg(F.sum("p.n").alias("a")).where(F.col("a") >= least)
            levels.append(stash(_described(found, levels[-1], words, length), "phrases"))
        if length < longest:
            sent = done.select("block", F.explode(F.arrays_zip("parts", "hashes", "counts")).alias("c")).select("block", F.col("c.parts").alias("part"), "c.hashes", "c.counts")
            bits = sent.groupBy("part").applyInArrow(_judge(least), "block long, part int, size int, bits binary")
            back = stash(bits.repartition(parts, "block").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "size", "bits"))).alias(f"passed{length + 1}")), "back")
            joined = joined.join(back, "block", "left")
    return [*levels, blocks.groupBy("lang").agg(F.sum("n_words").alias("n"))]


def _described(found: DataFrame, shorter: DataFrame, words: DataFrame, length: int) -> DataFrame:
    """Phrases with their text and the frequencies of their parts, by the phrases without the last and without the first word."""
    first = shorter.select(F.col("ids").alias("_p"), "lang", F.col("text").alias("_begin"), F.concat("firsts", F.array("a")).alias("firsts"))
    last = words.select(F.col("ids").alias("_w"), F.col("text").alias("_word"))
    rest = shorter.select(F.col("ids").alias("_s"), F.concat(F.array("a"), "rests").alias("rests"))
    out = found.withColumn("_p", F.slice("ids", 1, length - 1)).withColumn("_w", F.slice("ids", length, 1)).withColumn("_s", F.slice("ids", 2, length - 1))
    out = out.join(first, "_p").join(last, "_w").join(rest, "_s")
    return out.select("ids", "lang", F.concat_ws(" ", "_begin", "_word").alias("text"), "a", "firsts", "rests")


def candidates(levels: list[DataFrame], share: int = 50) -> DataFrame:
    """``(lang, phrase, a, l, r, score)`` of the phrases of two words and more that no longer one stands for."""
    wide = lambda c: f"cast({c} as decimal(15,0))"
    cut = F.expr(f"array_min(transform(sequence(1, size(firsts)), k -> struct((cast(1000000 as decimal(7,0)) * ({wide('a')} * {wide('a')})) div ({wide('firsts[k - 1]')} * {wide('rests[k - 1]')}) as score, k as k)))")
    out = None
    for at, level in enumerate(levels):
        if at + 1 < len(levels):
            k = at + 2
            longer = levels[at + 1].select(F.explode(F.array(F.slice("ids", 1, k), F.slice("ids", 2, k))).alias("ids"), F.col("a").alias("_longer")).groupBy("ids").agg(F.max("_longer").alias("_longer"))
            level = level.join(longer, "ids", "left").where(f"_longer is null or cast(100 as decimal(3,0)) * {wide('_longer')} < cast({share} as decimal(3,0)) * {wide('a')}")
        some = level.withColumn("_cut", cut).select("lang", F.col("text").alias("phrase"), "a", F.expr("firsts[_cut.k - 1]").alias("l"), F.expr("rests[_cut.k - 1]").alias("r"), F.col("_cut.score").alias("score"))
        out = some if out is None else out.union(some)
    return out


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, share: int = 50, top: int = 2000, block_bytes: int = BLOCK) -> DataFrame:
    """``docs(lang, text)`` to ``(lang, rank, phrase, a, l, r, n, score)``: each language's best ``top``."""
    words, *levels, totals = mined(docs, least, longest, block_bytes)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    found = candidates(levels, share).withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("rank", F.col("rank").cast("long"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
places AS (SELECT lang, w, len(w) AS m, unnest(range(1, len(w) + 1)) AS i FROM pieces),
f AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, any_value(w[i : i + k - 1]) AS ws, count(*) AS a
  FROM places, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= m GROUP BY lang, k, phrase HAVING count(*) >= 10),
totals AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
longer AS (
  SELECT lang, part, max(a) AS a FROM (
    SELECT lang, a, array_to_string(ws[1:2], ' ') AS part FROM f WHERE k = 3
    UNION ALL SELECT lang, a, array_to_string(ws[2:3], ' ') FROM f WHERE k = 3) GROUP BY lang, part),
cuts AS (SELECT lang, k, phrase, ws, a, unnest(range(1, k)) AS j FROM f WHERE k > 1),
scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.j, x.a AS l, y.a AS r,
    (CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.a AS HUGEINT) * y.a) AS score
  FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1 : c.j], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.j + 1 : c.k], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM scored),
kept AS (
  SELECT b.* FROM best b LEFT JOIN longer g ON b.k = 2 AND g.lang = b.lang AND g.part = b.phrase
  WHERE b.o = 1 AND (g.a IS NULL OR 100 * g.a < 50 * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, CAST(r.rank AS BIGINT) AS rank, r.phrase, CAST(r.a AS BIGINT) AS a, CAST(r.l AS BIGINT) AS l, CAST(r.r AS BIGINT) AS r,
  CAST(t.n AS BIGINT) AS n, CAST(r.score AS BIGINT) AS score
FROM ranked r JOIN totals t USING (lang) WHERE r.rank <= 2000
"""
