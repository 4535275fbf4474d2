"""A calendar of working days, numbered without gaps, so that days apart and days ahead are differences of numbers.

The calendar has a row a day, so its size is that of the years it covers; it is the side that is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LONGEST = 200_000  # days: over 500 years


def calendar(spark: SparkSession, first: str, last: str, holidays: DataFrame, off: Sequence[int] = (7,)) -> DataFrame:
    """``(day, working, number)``: every day, whether it is worked on, and how many working days there were up to and with it.

    ``off``: week days without work (1: Monday); ``holidays(begin, end)``: ranges of days, both ends in them, overlapping or not.
    """
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    if (n := days.count()) > LONGEST:
        raise ValueError(f"a calendar of {n} days")
    inside = holidays.selectExpr(f"greatest(begin, date'{first}') as begin", f"least(end, date'{last}') as end").where("begin <= end")
    free = inside.select(F.explode(F.sequence("begin", "end")).alias("_free")).distinct()
    worked = ~(F.weekday("day") + 1).isin(*off) & F.col("_free").isNull()
    days = days.join(free, F.col("day") == F.col("_free"), "left")
    counted = F.sum(F.col("working").cast("int")).over(Window.orderBy("day"))  # a row a day
    return days.select("day", worked.alias("working")).withColumn("number", counted.cast("int"))


def numbered(df: DataFrame, days: DataFrame, day: str, name: str) -> DataFrame:
    """``df`` with the number of working days up to and with the date ``day`` (null outside the calendar)."""
    known = days.select(F.col("day").alias("_day"), F.col("number").alias(name))
    return df.join(F.broadcast(known), F.to_date(day) == F.col("_day"), "left").drop("_day")


def ahead(df: DataFrame, days: DataFrame, day: str, n: int, name: str) -> DataFrame:
    """``df`` with the date of the ``n``-th working day after ``day``."""
    worked = days.where("working").select(F.col("number").alias("_number"), F.col("day").alias(name))
    counted = numbered(df, days, day, "_upto")
    return counted.join(F.broadcast(worked), F.col("_upto") + n == F.col("_number"), "left").drop("_upto", "_number")


def schedule(days: DataFrame, first: str, last: str) -> DataFrame:
    """``(no, day)``: the working days of a stretch of the calendar, numbered from 1."""
    some = days.where(F.col("working") & F.col("day").between(first, last))
    return some.select((F.col("number") - F.min("number").over(Window.partitionBy(F.lit(1))) + 1).alias("no"), "day")
