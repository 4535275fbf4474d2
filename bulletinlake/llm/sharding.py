"""Sharding by a hierarchical weighted hash tree of regions, racks and shards.

A row descends from the root: at each node every child draws ``-ln(u) / weight``, u being a hash of the
row's key and the child's name, and the smallest draw takes the row; so a child gets its share of the
node's rows. A rack weighs what its shards weigh, a region what its racks weigh. A draw depends on nothing but
key, name and weight: a node whose weight grows only wins rows, one whose weight shrinks only loses
some, and rows whose path crosses no changed weight stay where they are.

``grow`` opens a region of its own for one more shard. Only that region's weight changes, so rows move
only into the new shard (the ``key`` law), however often the tree has grown before. A shard put into a rack that
has others wins rows for its rack and region too, and some of these descend to its neighbours.

Slots number a shard's rows from 0 in the order of doc_id (null first), size and checksum. The numbers come from a
range partitioning by shard and that order, and from the number of rows each partition has of each
shard: a shard isn't one task's, and neither is a doc_id or a text that a third of all rows have.

Rows of one key go to one shard; null doc_id is the empty key. Null text has size 1, as empty text
has. Repeated rows are rows of their own. Other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import numbered, pick, place_of, stash

DRAWN = 13  # hex digits of the MD5 that make a draw: 52 bits
LEVELS = ("region", "rack", "shard")


class Shard(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int, racks: int = 2, per_rack: int = 2) -> list[Shard]:
    """A tree of ``shards`` equal shards, ``racks`` racks a region, ``per_rack`` shards a rack."""
    return [Shard(i // (racks * per_rack), i // per_rack % racks, i) for i in range(shards)]


def grow(tree: Iterable[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a region of its own."""
    old = list(tree)
    return [*old, Shard(max(s.region for s in old) + 1, 0, max(s.shard for s in old) + 1, weight)]


def children(tree: Iterable[Shard]) -> dict[tuple[int, ...], dict[tuple[int, ...], float]]:
    """Each inner node's children and their weights; nodes are paths from the root. Shards without weight are left out."""
    found: dict[tuple[int, ...], dict[tuple[int, ...], float]] = {}
    for s in sorted(tree):
        if s.weight < 0:
            raise ValueError(f"shard {s.shard} has a negative weight")
        path = s[:3]
        for depth in range(3 if s.weight else 0):
            below = found.setdefault(path[:depth], {})
            below[path[: depth + 1]] = below.get(path[: depth + 1], 0.0) + s.weight
    if not found:
        raise ValueError("no shard has a weight")
    return found


def _name(node: tuple[int, ...]) -> str:
    return "/".join(map(str, node))


def _drawn(key: Column, name: Column, weight: Column) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", key, name).cast("binary")), 1, DRAWN), 16, 10).cast("long")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(16**DRAWN))) / weight


def placed(tree: Iterable[Shard], key: Column) -> Column:
    """The shard of a key (a string)."""
    nodes = children(tree)
    below = F.create_map(*[x for node, kids in nodes.items() for x in (F.lit(_name(node)), F.array(*[F.struct(F.lit(_name(k)).alias("name"), F.lit(w).alias("weight")) for k, w in kids.items()]))])
    at = F.lit("")
    for _ in LEVELS:
        at = F.array_min(F.transform(F.element_at(below, at), lambda c: F.struct(_drawn(key, c["name"], c["weight"]), c["name"]).alias("drawn")))["name"]
    return F.substring_index(at, "/", -1).cast("int")


def key_of(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def with_slots(rows: DataFrame, shard: str, *order: str) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 in each shard in the given order; written tables in between, so numbers hold."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(shard), *map(F.col, order), F.col("_rid")]
    plain = stash(rows.withColumn("_rid", F.monotonically_increasing_id()), "rows")
    ranged = stash(plain.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_at", 33)
    each = ranged.groupBy(part.alias("_part"), F.col(shard).alias("_shard")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # as many rows as partitions and shards together: a partition begins at most one shard more than it ends
    before = F.sum("_n").over(Window.partitionBy("_shard").orderBy("_part")) - F.col("_n")
    base = stash(each.select("_part", "_shard", (before - F.col("_first")).alias("_base")), "bases")
    joined = ranged.join(F.broadcast(base), (part == F.col("_part")) & (F.col(shard) == F.col("_shard")))
    return joined.select(*rows.columns, (F.col("_at") + F.col("_base")).alias("slot"))


def sharded(docs: DataFrame, tree: Iterable[Shard], grown: Iterable[Shard] | None = None) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, size, text_crc32, law, shard, grown_shard, slot)``; ``grown``: another tree to place rows in as well."""
    rows = pick(docs, doc_id="doc_id", text="text")
    text = F.coalesce("text", F.lit("")).cast("binary")
    key = key_of(F.col("doc_id"))
    again = placed(grown, key) if grown else F.lit(None).cast("int")
    dealt = rows.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), placed(tree, key).alias("shard"), again.alias("grown_shard"))
    return with_slots(dealt, "shard", "doc_id", "size", "text_crc32")


def moves(dealt: DataFrame, tree: Iterable[Shard], grown: Iterable[Shard]) -> DataFrame:
    """What moves between two trees: ``(from_region, from_rack, from_shard, to_region, to_rack, to_shard, n_rows, n_bytes)``.

    ``dealt``: rows of ``sharded``. One row for each pair of shards that rows move between.
    """
    spark = dealt.sparkSession
    total = dealt.where("shard <> grown_shard").groupBy("shard", "grown_shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))

    def named(some: Iterable[Shard], side: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame([s[:3] for s in some], f"{side}_region int, {side}_rack int, {side}_shard int"))

    joined = total.join(named(tree, "from"), F.col("shard") == F.col("from_shard")).join(named(grown, "to"), F.col("grown_shard") == F.col("to_shard"))
    return joined.select(*[f"{side}_{level}" for side in ("from", "to") for level in LEVELS], "n_rows", "n_bytes")


def write_shards(docs: DataFrame, tree: Iterable[Shard], path: str, files: int = 1) -> None:
    """Write whole rows to ``path/shard=N``, each shard in about ``files`` files that as many tasks write."""
    rows, names = numbered(docs)
    doc_id = F.col(place_of(names, "doc_id"))
    shards = list(tree)
    dealt = rows.withColumn("_shard", placed(shards, key_of(doc_id))).withColumn("_file", F.pmod(F.xxhash64(*rows.columns), F.lit(files)))
    out = dealt.repartition(max(1, len(shards) * files), "_shard", "_file").drop("_file")
    kept = [i for i, n in enumerate(names) if n.lower() != "shard" and n.lower() not in [m.lower() for m in names[:i]]]
    out.select(*[F.col(f"_{i}").alias(names[i]) for i in kept], F.col("_shard").alias("shard")).write.partitionBy("shard").parquet(path)


#: The tree of the query: two regions of two racks of two shards, each of the same weight.
SHARDS = topology(8)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"), SHARDS, grow(SHARDS))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _sql_pick(kids: dict[tuple[int, ...], float]) -> str:
    draw = "-ln((CAST('0x' || substr(md5(key || ':{name}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / {weight}"
    each = ", ".join("{'d': " + draw.format(name=_name(k), weight=w) + f", 'c': '{_name(k)}'" + "}" for k, w in kids.items())
    return f"list_sort([{each}])[1].c"


def sql_place(tree: Iterable[Shard], name: str, source: str) -> str:
    """DuckDB CTEs that descend the tree level by level; the last is ``name``."""
    nodes = children(tree)
    regions = f"{name}_1 AS (SELECT *, {_sql_pick(nodes[()])} AS node FROM {source})"
    deeper = lambda depth: " ".join(f"WHEN '{_name(n)}' THEN {_sql_pick(kids)}" for n, kids in nodes.items() if len(n) == depth)
    racks = f"{name}_2 AS (SELECT * REPLACE (CASE node {deeper(1)} END AS node) FROM {name}_1)"
    shards = f"{name}_3 AS (SELECT * REPLACE (CASE node {deeper(2)} END AS node) FROM {name}_2)"
    return f"{regions},\n{racks},\n{shards},\n{name} AS (SELECT * EXCLUDE (node), CAST(split_part(node, '/', 3) AS INT) AS {name} FROM {name}_3)"


OP12_SQL = f"""
WITH RECURSIVE crcs AS (
  SELECT CAST(b AS UBIGINT) AS b, CAST(b AS UBIGINT) AS c, 0 AS i FROM range(256) t(b)
  UNION ALL
  SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS UBIGINT)) ELSE c // 2 END, i + 1 FROM crcs WHERE i < 8),
steps AS (SELECT list(c ORDER BY b) AS step FROM crcs WHERE i = 8),
rows AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, strlen(coalesce(text, '')) + 1 AS size,
    [CAST('0x' || x AS UBIGINT) FOR x IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')] AS bytes FROM documents),
summed AS (
  SELECT doc_id, key, size, xor(list_reduce(bytes, lambda c, b: xor(c // 256, step[CAST(xor(c % 256, b) + 1 AS BIGINT)]), CAST(4294967295 AS UBIGINT)), CAST(4294967295 AS UBIGINT)) AS crc
  FROM rows, steps),
{sql_place(SHARDS, "shard", "summed")},
{sql_place(grow(SHARDS), "grown_shard", "shard")}
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, crc) - 1 AS slot, grown_shard
FROM grown_shard
"""
