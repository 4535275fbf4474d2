"""Ranking under caps: exact forms that don't sort a whole table in one task."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Key = tuple[str, bool]  # a column and whether it descends


def ordering(keys: Sequence[Key]) -> list[Column]:
    """Sort expressions; nulls last either way."""
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in keys]


def at_or_before(keys: Sequence[Key], bound: dict[str, Column]) -> Column:
    """Does a row come no later than ``bound`` in the order of ``keys``?"""
    out = F.lit(True)
    for c, down in reversed(keys):
        mine, other = F.col(c), bound[c]
        less = F.coalesce(mine > other if down else mine < other, mine.isNotNull() & other.isNull())
        out = less | (mine.eqNullSafe(other) & out)
    return out


def top_per_group(df: DataFrame, group: Sequence[str], keys: Sequence[Key], n: int, name: str = "rank") -> DataFrame:
    """The first n of each group; Spark limits each group before it shuffles, so large groups stay small."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*ordering(keys))))
    return ranked.where(F.col(name) <= n)


def capped_topk(df: DataFrame, id_col: str, source: str, keys: Sequence[Key], cap: int, per_source: int, pinned: str | None = None) -> DataFrame:
    """``df`` with ``selected`` and ``reason``: at most ``cap`` rows in the order of ``keys``, at most
    ``per_source`` of a source; pinned rows (a boolean column) come first and don't obey the source limit.

    Reasons: 'selected', 'pin_cap' (a pin beyond the cap), 'diversity' (its source was full while
    there was room), 'cap'. ``keys`` end with ``id_col``, which makes the order total.

    Only the first ``per_source`` rows of a source and the first ``cap`` of these can be chosen,
    so no window spans the table: sources are limited within partitions, the chosen rows come
    from a top-k, and the last one's keys tell whether the list was full when a row came up.
    """
    names = [c for c, _ in keys]
    if id_col not in names:
        raise ValueError("the order must end with the id")
    is_pin = F.coalesce(F.col(pinned), F.lit(False)) if pinned else F.lit(False)
    slim = df.select(*dict.fromkeys([*names, source]), is_pin.alias("_pin"))
    pins = slim.where("_pin").orderBy(*ordering(keys)).limit(cap)
    pins = pins.select(F.col(id_col).alias("_id"), F.col(source).alias("_source"))
    taken = pins.groupBy("_source").agg(F.count("*").alias("_taken"))  # cap rows at most
    room = pins.agg((F.lit(cap) - F.count("*")).alias("_room"))  # one row
    ranked = top_per_group(slim.where("not _pin"), [source], keys, per_source, "_rank")
    eligible = ranked.join(F.broadcast(taken), ranked[source].eqNullSafe(taken["_source"]), "left").where(F.col("_rank") + F.coalesce("_taken", F.lit(0)) <= per_source)
    first = eligible.orderBy(*ordering(keys)).limit(cap).select(*names, source)
    placed = first.withColumn("_place", F.row_number().over(Window.orderBy(*ordering(keys)))).join(F.broadcast(room), F.col("_place") <= F.col("_room"))
    chosen = placed.select(F.col(id_col).alias("_id"))
    last = F.max_by(F.struct(*names), F.col("_place"))
    full = placed.agg(last.alias("_last"), F.count("*").alias("_n")).crossJoin(room).select("_last", (F.col("_n") >= F.col("_room")).alias("_full"), (F.col("_room") <= 0).alias("_none"))
    picked = pins.select("_id", F.lit(True).alias("_is_pin")).unionByName(chosen.select("_id", F.lit(False).alias("_is_pin")))
    joined = df.crossJoin(F.broadcast(full)).join(F.broadcast(picked), F.col(id_col) == F.col("_id"), "left")  # one row, and cap rows
    before = F.coalesce(~F.col("_none") & (~F.col("_full") | at_or_before(keys, {c: F.col("_last")[c] for c in names})), F.lit(True))
    reason = F.when(F.col("_id").isNotNull(), "selected").when(is_pin, "pin_cap").when(before, "diversity").otherwise("cap")
    return joined.withColumn("selected", F.col("_id").isNotNull()).withColumn("reason", reason).select(*df.columns, "selected", "reason")


def demoted_by_pins(df: DataFrame, id_col: str, source: str, keys: Sequence[Key], cap: int, per_source: int, pinned: str) -> DataFrame:
    """Rows that are chosen without pins and lose their place to them."""
    without = capped_topk(df, id_col, source, keys, cap, per_source).where("selected").select(id_col)
    with_pins = capped_topk(df, id_col, source, keys, cap, per_source, pinned).where("selected").select(id_col)
    return without.join(with_pins, id_col, "left_anti")  # cap rows each


def round_robin(df: DataFrame, issue: str, rule: str, source: str, id_col: str, keys: Sequence[Key], rules: Sequence[str], cap: int, per_source: int) -> DataFrame:
    """Per issue, rules take turns; each takes its next row whose source isn't full, until ``cap``.

    Returns (issue, id, position) in the order of choosing. A turn's outcome depends on all before
    it, so an issue's list is walked in a task; only rows that can be reached take part: a rule's
    first ``cap * per_source``-limited rows of each source.
    """
    reachable = top_per_group(df.where(F.col(rule).isin(list(rules))), [issue, rule, source], keys, min(cap, per_source), "_rs")
    reachable = top_per_group(reachable, [issue, rule], keys, cap * max(1, len(rules)) * max(1, per_source) + cap, "_rank")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        queues = {r: g.sort_values("_rank")[[id_col, source]].values.tolist() for r, g in pdf.groupby(rule)}
        used: dict = {}
        out = []
        while len(out) < cap and any(queues.get(r) for r in rules):
            for r in rules:
                queue = queues.get(r) or []
                while queue:
                    row_id, src = queue.pop(0)
                    if used.get(src, 0) < per_source:
                        used[src] = used.get(src, 0) + 1
                        out.append(row_id)
                        break
                if len(out) == cap:
                    break
        return pd.DataFrame({issue: [pdf[issue].iloc[0]] * len(out), id_col: out, "position": range(1, len(out) + 1)})

    kinds = dict(df.dtypes)
    return reachable.select(issue, rule, source, id_col, "_rank").groupBy(issue).applyInPandas(walk, f"{issue} {kinds[issue]}, {id_col} {kinds[id_col]}, position int")


def fair_rotation(candidates: DataFrame, prior: DataFrame, key: str, stamp: str, pos: str, quota: int, source: str | None = None) -> DataFrame:
    """Candidates whose evidence is oldest (none at all first), up to ``quota`` (of each source, if given)."""
    seen = candidates.join(prior.select(key, F.col(stamp).cast("string").alias("_stamp")), key, "left").withColumn("_stamp", F.coalesce("_stamp", F.lit("")))
    keys = [("_stamp", False), (pos, False), (key, False)]
    if source:
        return top_per_group(seen, [source], keys, quota, "turn").drop("_stamp")
    first = seen.orderBy(*ordering(keys)).limit(quota)
    return first.withColumn("turn", F.row_number().over(Window.orderBy(*ordering(keys)))).drop("_stamp")


def gap_select(df: DataFrame, group: str, day: str, min_days: int) -> DataFrame:
    """Of each group's distinct days, the first and then each at least ``min_days`` after the last one kept."""
    days = df.select(group, F.to_date(day).alias("_day")).distinct().groupBy(group).agg(F.array_sort(F.collect_list("_day")).alias("_days"))
    kept = F.aggregate(
        F.col("_days"),
        F.array().cast("array<date>"),
        lambda acc, d: F.when((F.size(acc) == 0) | (F.datediff(d, F.try_element_at(acc, F.lit(-1))) >= min_days), F.array_append(acc, d)).otherwise(acc),
    )
    return days.select(group, F.explode(kept).alias(day))


def stratified_sample(df: DataFrame, stratum: str, id_col: str, n: int, seed: str = "0") -> DataFrame:
    """n rows of each stratum (all, if fewer) in the order of a seeded hash of the id."""
    keyed = df.withColumn("_draw", F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary")))
    return top_per_group(keyed, [stratum], [("_draw", False), (id_col, False)], n, "_rank").drop("_draw", "_rank")
