"""Exact vector search by cosine or Euclidean distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x))


METRICS = {"cosine": cosine_distance, "l2": l2_distance}


def similar_to(df: DataFrame, id_col: str, vector: str, query: Sequence[float], k: int, metric: str = "cosine", exclude_id: int | None = None, at_most: float | None = None) -> DataFrame:
    """The k nearest rows to a given vector: one scan and a top-k, the vector is a literal."""
    distance = METRICS[metric](F.col(vector), F.lit([float(x) for x in query]))
    rows = df if exclude_id is None else df.where(F.col(id_col) != exclude_id)
    near = rows.select(id_col, distance.alias("distance"))
    if at_most is not None:
        near = near.where(F.col("distance") <= at_most)
    return near.orderBy("distance", id_col).limit(k)


def similar_to_row(df: DataFrame, id_col: str, vector: str, row_id: int, k: int, metric: str = "cosine") -> DataFrame:
    """The k nearest rows to a stored one, itself left out; an unknown id gives no rows."""
    stored = df.where(F.col(id_col) == row_id).select(vector).first()  # one row
    if stored is None or stored[0] is None:
        return df.select(id_col, F.lit(None).cast("double").alias("distance")).limit(0)
    return similar_to(df, id_col, vector, stored[0], k, metric, row_id)


def vector_literal(c: Column) -> Column:
    """'[1.0,2.0]', the text form that a vector column of a SQL database takes."""
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("]"))
