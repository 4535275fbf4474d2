"""Counts, coverage and health reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overview(df: DataFrame, notified: Column) -> DataFrame:
    """total, notified and the rest in one pass."""
    n = F.count_if(notified)
    return df.agg(F.count("*").alias("total"), n.alias("notified"), (F.count("*") - n).alias("unnotified"))


def count_by(df: DataFrame, *by: str, name: str = "cnt") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias(name))


def count_by_month(df: DataFrame, stamp: str, months: int = 12) -> DataFrame:
    """Rows by month, the latest ``months`` of them."""
    return count_by(df.withColumn("month", F.date_format(stamp, "yyyy-MM")), "month").orderBy(F.desc("month")).limit(months)


def with_total(df: DataFrame, by: str, total: str, **aggregates: Column) -> DataFrame:
    """Aggregates by group with a grand total row, whose group is ``total``."""
    out = df.rollup(by).agg(F.grouping(by).alias("_g"), *[a.alias(n) for n, a in aggregates.items()])
    return out.withColumn(by, F.when(F.col("_g") == 1, total).otherwise(F.col(by))).drop("_g")


def conditional_counts(df: DataFrame, by: str, value: str) -> DataFrame:
    """Rows by group that match (1), don't (0) or are unmeasured (null)."""
    v = F.col(value)
    return df.groupBy(by).agg(F.count("*").alias("total"), F.count_if(v == 1).alias("matched"), F.count_if(v == 0).alias("unmatched"), F.count_if(v.isNull()).alias("unmeasured"))


def score_bands(df: DataFrame, score: str, high: float, low: float) -> DataFrame:
    s = F.col(score)
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(s >= high).alias("high"),
        F.count_if((s >= low) & (s < high)).alias("medium"),
        F.count_if(s < low).alias("low"),
        F.round(F.coalesce(F.avg(s), F.lit(0.0)), 3).alias("average"),
    )


def last_runs(runs: DataFrame, source: str, stamp: str, id_col: str, n: int) -> DataFrame:
    """The latest n runs of each source."""
    ranked = runs.withColumn("_rn", F.row_number().over(Window.partitionBy(source).orderBy(F.desc(stamp), F.desc(id_col))))
    return ranked.where(F.col("_rn") <= n)


def run_health(runs: DataFrame, source: str, stamp: str, id_col: str, ok: Column, amount: str, n: int = 7) -> DataFrame:
    """By source: sums over the latest n runs, successes among them, the latest success of all."""
    recent = last_runs(runs.withColumn("_ok", ok), source, stamp, id_col, n).groupBy(source).agg(F.count("*").alias("runs"), F.count_if("_ok").alias("ok_runs"), F.round(F.sum(amount), 3).alias("amount"))
    ever = runs.groupBy(source).agg(F.max(F.when(ok, F.col(stamp))).alias("last_ok"))
    return recent.join(ever, source)


def coverage(registry: DataFrame, observed: DataFrame, key: str, measures: Sequence[str]) -> DataFrame:
    """Registry and observations side by side; what either lacks counts as zero."""
    r, o = registry.withColumn("_r", F.lit(1)), observed.withColumn("_o", F.lit(1))
    both = r.join(o, key, "full_outer")
    status = F.when(F.col("_r").isNull(), "unregistered").when(F.col("_o").isNull(), "silent").otherwise("seen")
    return both.withColumn("status", status).fillna(0, list(measures)).drop("_r", "_o")


def histogram(df: DataFrame, verdict: str, order: Sequence[str]) -> DataFrame:
    """Counts for every verdict in a fixed order, zero ones too."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(i, v) for i, v in enumerate(order)], "position int, verdict string")
    counts = df.groupBy(F.col(verdict).alias("verdict")).agg(F.count("*").alias("n"))
    return dim.join(counts, "verdict", "left").select("position", "verdict", F.coalesce("n", F.lit(0)).alias("n"))


def cap_violations(counts: DataFrame, section: str, n: str, caps: Mapping[str, int]) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    return counts.withColumn("cap", F.try_element_at(table, F.col(section))).where(F.col(n) > F.col("cap"))


def ordered_list(df: DataFrame, by: str, pos: str, value: str, name: str) -> DataFrame:
    """The values of each group in the order of ``pos``."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v"))))
    return df.groupBy(by).agg(F.transform(pairs, lambda x: x["v"]).alias(name))


def markdown_table(df: DataFrame, columns: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """A report-sized table as one markdown text."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    numbered = df.select(F.row_number().over(Window.orderBy(*order)).alias("p"), line.alias("line"))
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "line"))), lambda x: x["line"]), "\n")
    return numbered.agg(F.concat(F.lit(head), body).alias("markdown"))
