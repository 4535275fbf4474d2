"""Identity joins, in-list merges and set-similarity pairs."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_rows(incoming: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    return incoming.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def known_rows(incoming: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    return incoming.join(existing.select(*keys).distinct(), list(keys), "left_semi")


def merge_same(df: DataFrame, keys: Sequence[str], signature: Sequence[str], pos: str, id_col: str, renewal: str | None = None, prefer: str | None = None) -> DataFrame:
    """Rows of a key that equal its first row in ``signature`` merge into one; others stay alone.

    Renewals (a boolean column) never merge. The representative is the first preferred row, else
    the first. Returns the representatives with ``merged_ids`` (in order) and ``n_merged``.
    """
    order = Window.partitionBy(*keys).orderBy(pos, id_col)
    is_renewal = F.coalesce(F.col(renewal), F.lit(False)) if renewal else F.lit(False)
    first = df.withColumn("_first", F.first(F.struct(*signature, is_renewal.alias("_renewal"))).over(order))
    same = ~is_renewal & ~F.col("_first._renewal")
    for c in signature:
        same = same & F.col(c).eqNullSafe(F.col("_first")[c])
    grouped = first.withColumn("_alone", F.when(same, F.lit(None)).otherwise(F.col(id_col)))
    members = F.struct(F.col(pos).alias("p"), F.col(id_col).alias("i"))
    rank = F.struct((~F.coalesce(F.col(prefer), F.lit(False)) if prefer else F.lit(False)).alias("o"), F.col(pos).alias("p"), F.col(id_col).alias("i"))
    merged = grouped.groupBy(*keys, "_alone").agg(F.min(rank)["i"].alias(id_col), F.transform(F.array_sort(F.collect_list(members)), lambda m: m["i"]).alias("merged_ids"))
    return merged.withColumn("n_merged", F.size("merged_ids")).drop("_alone")


def canonical(df: DataFrame, keys: Sequence[str], rank: Sequence[Column], id_col: str) -> DataFrame:
    """One row per key, the greatest in ``rank`` (ties: the smallest id), with its group's size."""
    best = F.max_by(F.col(id_col), F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], (-F.col(id_col)).alias("t")))
    return df.groupBy(*keys).agg(best.alias(id_col), F.count("*").alias("n_rows"))


def keys_compatible(subject_a: Column, subject_b: Column, rounds_a: Column, rounds_b: Column, deadline_a: Column, deadline_b: Column, ignore_deadline: bool = False) -> Column:
    """May two duplicate keys mean one notice? An empty subject fits any; rounds that differ conflict."""
    subjects = (subject_a == "") | (subject_b == "") | (subject_a == subject_b)
    rounds = (rounds_a == "") | (rounds_b == "") | (rounds_a == rounds_b)
    return subjects & rounds if ignore_deadline else subjects & rounds & deadline_a.eqNullSafe(deadline_b)


def plan_duplicates(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """Dry-run plan of rows to remove: (id, keeper, rule); nothing is both keeper and removed.

    ``rows``: id, source, source_id, title_key, subjects, rounds, deadline, rank (greater is
    better). ``merged``: id of a row and source_id that its list page had merged into it. Rule A
    removes merged ids that still have rows of compatible keys; rule B all but the best row of
    equal keys.
    """
    other = rows.select(*[F.col(c).alias(f"v_{c}") for c in rows.columns])
    a = merged.join(rows, "id").join(other, (F.col("merged_id") == F.col("v_source_id")) & (F.col("source") == F.col("v_source")) & (F.col("id") != F.col("v_id")))
    a = a.where(keys_compatible(F.col("subjects"), F.col("v_subjects"), F.col("rounds"), F.col("v_rounds"), F.col("deadline"), F.col("v_deadline"), True))
    a = a.groupBy(F.col("v_id").alias("id")).agg(F.min("id").alias("keeper")).withColumn("rule", F.lit("A"))
    key = Window.partitionBy("source", "title_key", "subjects", "deadline", "rounds")
    b = rows.withColumn("keeper", F.first("id").over(key.orderBy(F.desc("rank"), "id"))).where("id <> keeper").select("id", "keeper", F.lit("B").alias("rule"))
    both = a.unionByName(b).groupBy("id").agg(F.min(F.struct("rule", "keeper")).alias("m")).select("id", "m.keeper", "m.rule")
    doomed = both.select(F.col("id").alias("keeper"))
    return both.join(doomed, "keeper", "left_anti")


def plan_violations(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows that break a plan's rules: a keeper that is removed too, or that doesn't exist."""
    removed = plan.select(F.col("id").alias("keeper")).distinct()
    doomed = plan.join(removed, "keeper", "left_semi").withColumn("problem", F.lit("keeper is removed"))
    missing = plan.join(rows.select(F.col("id").alias("keeper")), "keeper", "left_anti").withColumn("problem", F.lit("keeper is missing"))
    return doomed.unionByName(missing)


def similar_classes(sets: DataFrame, id_col: str, items: str, least: float) -> tuple[DataFrame, DataFrame]:
    """Rows of equal item sets as classes ``(id, class)``, and pairs ``(a, b, similarity)`` of classes with Jaccard >= ``least``.

    Prefix filter: items are ordered by how rare they are; two sets that similar share one of
    their first ``size - ceil(least * size) + 1`` items, so only these join, not all rows.
    """
    exact = Fraction(least).limit_denominator(1000)  # so that no bound is lost by rounding
    num, den = exact.numerator, exact.denominator
    classed = sets.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(items)).alias("items")).where(F.size("items") > 0).withColumn("class", F.sha2(F.to_json("items").cast("binary"), 256))
    reps = classed.groupBy("class").agg(F.first("items").alias("items"))
    counted = reps.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    each = reps.select("class", F.size("items").alias("size"), F.explode("items").alias("item")).join(counted, "item")
    ranked = each.groupBy("class", "size").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("by_rarity"))
    prefix = ranked.selectExpr("class", "size", f"explode(slice(by_rarity, 1, int(size - (size * {num} + {den - 1}) div {den} + 1))) as p").select("class", "size", F.col("p.item").alias("item"))
    l, r = prefix.alias("l"), prefix.alias("r")
    near = l.join(r, F.expr(f"l.item = r.item and l.class < r.class and l.size * {den} >= r.size * {num} and r.size * {den} >= l.size * {num}"))
    near = near.select(F.col("l.class").alias("a"), F.col("r.class").alias("b")).distinct()
    one, two = reps.select(F.col("class").alias("a"), F.col("items").alias("ia")), reps.select(F.col("class").alias("b"), F.col("items").alias("ib"))
    shared = F.size(F.array_intersect("ia", "ib"))
    checked = near.join(one, "a").join(two, "b").withColumn("_n", shared).withColumn("_all", F.size("ia") + F.size("ib") - F.col("_n"))
    return classed.select("id", "class"), checked.where(f"_n * {den} >= _all * {num}").select("a", "b", (F.col("_n") / F.col("_all")).alias("similarity"))


def similar_pairs(sets: DataFrame, id_col: str, items: str, least: float) -> DataFrame:
    """Pairs (left_id < right_id, similarity) that tell all similar rows: the first rows of similar classes, and
    each row with the first of its class. Members of two classes aren't spelled out as pairs."""
    members, pairs = similar_classes(sets, id_col, items, least)
    first = members.groupBy("class").agg(F.min("id").alias("rep"))
    named = pairs.join(first.select(F.col("class").alias("a"), F.col("rep").alias("x")), "a").join(first.select(F.col("class").alias("b"), F.col("rep").alias("y")), "b")
    across = named.select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"), "similarity")
    within = members.join(first, "class").where("id <> rep").select(F.col("rep").alias("left_id"), F.col("id").alias("right_id"), F.lit(1.0).alias("similarity"))
    return across.unionByName(within)


def similar_counts(sets: DataFrame, id_col: str, items: str, least: float) -> DataFrame:
    """(id, n_similar): how many other rows are similar to each, from the sizes of classes."""
    members, pairs = similar_classes(sets, id_col, items, least)
    sizes = members.groupBy("class").agg(F.count("*").alias("n"))
    both = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("class", "other")
    near = both.join(sizes.select(F.col("class").alias("other"), "n"), "other").groupBy("class").agg(F.sum("n").alias("near"))
    by_class = sizes.join(near, "class", "left").select("class", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_similar"))
    counted = members.join(by_class, "class").select("id", "n_similar")
    return sets.select(F.col(id_col).alias("id")).join(counted, "id", "left").select(F.col("id").alias(id_col), F.coalesce("n_similar", F.lit(0)).alias("n_similar"))
