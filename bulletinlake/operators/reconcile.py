"""Manifest and state checks that return the rows in breach."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reconcile(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, problem): missing on either side, repeated, or a field that differs (nulls equal)."""
    l = left.groupBy(key).agg(F.count("*").alias("n"), *[F.first(f).alias(f) for f in fields])
    r = right.groupBy(key).agg(F.count("*").alias("n"), *[F.first(f).alias(f) for f in fields])
    both = l.alias("l").join(r.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"), "full_outer")
    ln, rn = F.col("l.n"), F.col("r.n")
    tests = [
        F.when(rn.isNull(), F.lit("missing")),
        F.when(ln.isNull(), F.lit("extra")),
        F.when((ln > 1) | (rn > 1), F.lit("repeated")),
        *[F.when(ln.isNotNull() & rn.isNotNull() & ~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")), F.lit(f"{f} differs")) for f in fields],
    ]
    return both.select(F.coalesce(F.col(f"l.{key}"), F.col(f"r.{key}")).alias(key), F.explode(F.array_compact(F.array(*tests))).alias("problem"))


def schema_problems(df: DataFrame, id_col: str, required: Sequence[str]) -> DataFrame:
    """A row for every required field that is null or ''."""
    tests = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in required]))
    return df.select(id_col, F.explode(tests).alias("field"))


def expired(df: DataFrame, deadline: Column, today: Column) -> DataFrame:
    return df.where(deadline < today)


def first_failure(tests: Sequence[tuple[str, Column]]) -> Column:
    """struct(passed, reason): the first test that fails, in order."""
    reason = None
    for name, ok in tests:
        failed = ~F.coalesce(ok, F.lit(False))
        reason = F.when(failed, name) if reason is None else reason.when(failed, name)
    return F.struct(reason.isNull().alias("passed"), reason.alias("reason"))


def stamp_expired(stamp: Column, now: Column, hours: int) -> Column:
    """Older than ``hours``, missing or unreadable."""
    return F.coalesce(F.timestamp_diff("SECOND", F.try_to_timestamp(stamp), now) > hours * 3600, F.lit(True))


def exact_batch(expected: DataFrame, answers: DataFrame, batch: str, n: str) -> DataFrame:
    """(batch, accepted): whether a batch's answers have exactly the expected numbers, each once."""
    e = expected.groupBy(batch).agg(F.count("*").alias("e"))
    a = answers.groupBy(batch).agg(F.count("*").alias("a"), F.countDistinct(n).alias("d"))
    hit = expected.join(answers.select(batch, n).distinct(), [batch, n], "left_semi").groupBy(batch).agg(F.count("*").alias("h"))
    joined = e.join(a, batch, "left").join(hit, batch, "left").fillna(0, ["a", "d", "h"])
    return joined.select(batch, ((F.col("a") == F.col("d")) & (F.col("a") == F.col("e")) & (F.col("h") == F.col("e"))).alias("accepted"))


def multiset_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Values that one side has more often."""
    l, r = (df.groupBy(key).agg(F.count("*").alias(n)) for df, n in ((left, "in_left"), (right, "in_right")))
    return l.join(r, key, "full_outer").fillna(0, ["in_left", "in_right"]).where("in_left <> in_right")


def transitions(requests: DataFrame, legal: Mapping[str, Sequence[str]]) -> DataFrame:
    """Requests (from_status, to_status) with whether the table of legal transitions has them."""
    pairs = [f"{a}>{b}" for a, bs in legal.items() for b in bs]
    return requests.withColumn("legal", F.concat_ws(">", "from_status", "to_status").isin(pairs))


def newest_later(issues: DataFrame, key: str, open_now: Column, group: str | None = None) -> DataFrame:
    """Each issue with the newest later one (of its group) that is open, null if there is none.

    The newest open issue of a group answers for all before it, so a group needs only its maximum.
    """
    by = [group] if group else []
    top = issues.where(open_now).groupBy(*by).agg(F.max(key).alias("_top"))
    joined = issues.join(top, group, "left") if group else issues.crossJoin(F.broadcast(top))  # one row
    return joined.withColumn("superseded_by", F.when(F.col("_top") > F.col(key), F.col("_top"))).drop("_top")


def bounded_history(df: DataFrame, by: str, order: Sequence[Column], keep: int) -> DataFrame:
    """The last ``keep`` rows of each group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_rn") <= keep).drop("_rn")


def add_to_set(old: Column, new: Column) -> Column:
    return F.array_union(old, new)


def drop_from_set(old: Column, gone: Column) -> Column:
    return F.array_except(old, gone)


def can_send(status: Column, approved_hash: Column, body_hash: Column, passed: Column, n_items: Column, newer: Column) -> Column:
    """struct(passed, reason) for sending an issue; anything unknown stops it."""
    return first_failure([("not approved", status == "approved"), ("body changed since approval", approved_hash == body_hash), ("checks failed", passed), ("no items", n_items > 0), ("a newer issue is open", newer.isNull())])
