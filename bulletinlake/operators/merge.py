"""Table maintenance as pure functions: old snapshot and incoming rows to a new snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_patch, mask_contacts


def fold_batch(incoming: DataFrame, keys: Sequence[str], pos: str, lowest: Sequence[str] = ()) -> DataFrame:
    """One row per key: the last in ``pos``, but the least value ever of the ``lowest`` columns."""
    rest = [c for c in incoming.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.col(pos))
    out = incoming.groupBy(*keys).agg(last.alias("_last"), *[F.min(c).alias(f"_low_{c}") for c in lowest])
    return out.select(*keys, *[F.col(f"_low_{c}").alias(c) if c in lowest else F.col("_last")[c].alias(c) for c in rest])


def upsert(old: DataFrame, incoming: DataFrame, keys: Sequence[str], always: Sequence[str], if_given: Sequence[str] = (), ratchet: Sequence[str] = ()) -> DataFrame:
    """``old`` with ``incoming`` (one row a key) merged in; columns are those of ``old``.

    On a match, ``always`` columns take the new value, ``if_given`` the new one unless null,
    ``ratchet`` flags only ever fall (1 to 0, new null keeps the old); others stay. New keys are added.
    """
    o, n = (df.select(*old.columns).withColumn("_in", F.lit(True)).alias(a) for df, a in ((old, "o"), (incoming, "n")))
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    in_old, in_new = (F.coalesce(F.col(f"{a}._in"), F.lit(False)) for a in "on")

    def merged(c: str) -> Column:
        was, now = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in keys:
            return F.coalesce(was, now)
        if c in always:
            both = now
        elif c in if_given:
            both = F.coalesce(now, was)
        elif c in ratchet:
            both = F.when(now == 0, F.lit(0)).otherwise(F.coalesce(was, F.lit(0)))
        else:
            both = was
        return F.when(in_old & in_new, both).when(in_old, was).otherwise(now)

    return joined.select(*[merged(c).alias(c) for c in old.columns])


def set_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """``df`` with columns replaced in the rows where the condition holds."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def mark_notified(df: DataFrame, sent: DataFrame, id_col: str = "id") -> DataFrame:
    ids = sent.select(F.col(id_col).alias("_sent")).distinct()
    return df.join(ids, F.col(id_col) == F.col("_sent"), "left").withColumn("is_notified", F.when(F.col("_sent").isNotNull(), 1).otherwise(F.col("is_notified"))).drop("_sent")


def record_drops(ledger: DataFrame, drops: DataFrame, now: Column, keys: Sequence[str] = ("source", "source_id"), masked: Sequence[str] = ("title", "reason")) -> DataFrame:
    """The drop ledger with this run's drops written over, stamped and without contact details."""
    fresh = drops.withColumns({c: mask_contacts(F.col(c)) for c in masked}).withColumn("seen_at", now)
    return upsert(ledger, fresh, keys, always=[c for c in ledger.columns if c not in keys])


def expire(df: DataFrame, stamp: str, cutoff: Column) -> DataFrame:
    """Rows last seen at or after the cutoff."""
    return df.where(F.col(stamp) >= cutoff)


def null_except(df: DataFrame, group: str, keep: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The columns nulled in all groups but those to keep."""
    return set_where(df, ~F.col(group).isin(*keep), **{c: F.lit(None) for c in columns})


def patch_evidence(df: DataFrame, patches: DataFrame, keys: Sequence[str], allowed: Sequence[str], clears: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """``df`` with its raw_data patched by ``patches`` (keys, patch map); periods aren't touched."""
    p = patches.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("patch").alias("_patch"))
    joined = df.join(p, [F.col(k) == F.col(f"_{k}") for k in keys], "left")
    new = F.when(F.col("_patch").isNotNull(), json_patch(F.col("raw_data"), F.col("_patch"), allowed, clears)).otherwise(F.col("raw_data"))
    return joined.withColumn("raw_data", new).select(*df.columns)


def carry_forward(current: DataFrame, previous: DataFrame, keys: Sequence[str], url: str, evidence: str) -> DataFrame:
    """Earlier evidence for rows without any, only where key and url are the same."""
    p = previous.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(url).alias("_url"), F.col(evidence).alias("_evidence"))
    joined = current.join(p, [F.col(k) == F.col(f"_{k}") for k in keys], "left")
    return joined.withColumn(evidence, F.coalesce(F.col(evidence), F.when(F.col(url) == F.col("_url"), F.col("_evidence")))).select(*current.columns)


def revalidate(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Recomputed periods with a flag for rows that change; '' and null are the same."""
    as_null = lambda c: F.nullif(c, F.lit(""))
    changed = ~(as_null(F.col("period_start")).eqNullSafe(as_null(start)) & as_null(F.col("period_end")).eqNullSafe(as_null(end)))
    return df.select(*[c for c in df.columns if c not in ("period_start", "period_end")], start.alias("period_start"), end.alias("period_end"), changed.alias("changed"))


def insert_missing(old: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` and those incoming rows whose keys it lacks."""
    return old.unionByName(incoming.select(*old.columns).dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti"))


def next_id(df: DataFrame, id_col: str = "id") -> DataFrame:
    return df.agg((F.coalesce(F.max(id_col), F.lit(0)) + 1).alias("next_id"))
