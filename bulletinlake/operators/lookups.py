"""Small lookups, listings and orders over stored notices, applications and hits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import date_parse_failed
from ..functions.text import blank


def rows_of_ids(df: DataFrame, id_col: str, wanted: DataFrame) -> DataFrame:
    """The rows whose id is in ``wanted``, however many ids that are."""
    return df.join(wanted.select(F.col(id_col)).distinct(), id_col, "left_semi")


def with_defaults_of(wanted: DataFrame, df: DataFrame, id_col: str, defaults: Mapping[str, Column]) -> DataFrame:
    """Each wanted id with the columns of its row; defaults where there is no row or no value."""
    found = df.select(id_col, *defaults)
    return wanted.select(id_col).join(found, id_col, "left").select(id_col, *[F.coalesce(c, d).alias(c) for c, d in defaults.items()])


def is_legacy_id(source: Column, source_id: Column, families: Sequence[str] = ("seis",)) -> Column:
    """Ids of these sources without a kind before a colon are of the old form."""
    return source.isin(*families) & ~F.contains(blank(source_id), F.lit(":"))


def seen_since(df: DataFrame, **cutoffs: Column) -> DataFrame:
    """Rows whose stamps are all at or after their cutoffs."""
    for stamp, cutoff in cutoffs.items():
        df = df.where(F.col(stamp) >= cutoff)
    return df


def listing(df: DataFrame, order: Sequence[Column], limit: int, **equal) -> DataFrame:
    """The first rows in an order among those with the given values; a value of None doesn't filter."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df.orderBy(*order).limit(limit)


def display_name(key: Column, names: Mapping[str, str], otherwise: str = "기관 미상") -> Column:
    """A source's display name, the key itself if it has none, ``otherwise`` if there is no key."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.create_map().cast("map<string,string>")
    return F.when(F.trim(blank(key)) == "", otherwise).otherwise(F.coalesce(F.try_element_at(table, key), key))


def media_day(raw: Column, fallback: Column) -> Column:
    """The day a media row was posted: of its raw data, else of the fallback stamp."""
    return F.substring(F.coalesce(F.nullif(F.get_json_object(raw, "$.posted"), F.lit("")), fallback), 1, 10)


def joined_hits(hits: DataFrame, rows: DataFrame, on: str) -> DataFrame:
    """Vector hits with the rows they stand for, in one join instead of a lookup a hit."""
    return hits.join(rows, on)


def with_titles(applications: DataFrame, rows: DataFrame, key: str, title: str = "title", most: int = 40) -> DataFrame:
    """Applications with the (cut) title of their notice, '공고 #id' where it is gone."""
    titled = rows.select(key, F.substring(title, 1, most).alias("_title"))
    return applications.join(titled, key, "left").withColumn(title, F.coalesce("_title", F.concat(F.lit("공고 #"), F.col(key).cast("string")))).drop("_title")


def first_match(left: DataFrame, right: DataFrame, on: str, order: str, columns: Sequence[str]) -> DataFrame:
    """``left`` with columns of the first row (in ``order``) of ``right`` that has its key."""
    best = right.groupBy(on).agg(F.min_by(F.struct(*columns), F.col(order)).alias("_best"))
    return left.join(best, on, "left").select(*left.columns, *[F.col(f"_best.{c}").alias(c) for c in columns])


def still_present(excluded: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Excluded keys that are present all the same."""
    return excluded.select(key).distinct().join(present.select(key).distinct(), key, "left_semi")


def first_occurrences(df: DataFrame, key: Sequence[str], pos: str) -> DataFrame:
    """The first row of each key in the order of ``pos``."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(pos)).alias("_first")).select(*[F.col(c) if c in key else F.col(f"_first.{c}").alias(c) for c in df.columns])


def kind_capped(df: DataFrame, group: str, capped: Column, order: Sequence[Column], cap: int = 2) -> DataFrame:
    """``kept``: of each group's rows with ``capped`` the first ``cap`` in the order, and all others; only capped rows are ranked."""
    flagged = df.withColumn("_capped", F.coalesce(capped, F.lit(False)))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    ranked = flagged.where("_capped").withColumn("kept", rank <= cap)
    return ranked.unionByName(flagged.where("not _capped").withColumn("kept", F.lit(True))).drop("_capped")


def numbered_holds(df: DataFrame, issue: str, held: Column, order: Sequence[Column]) -> DataFrame:
    """The held rows of each issue, numbered from 1 in the order they are given out."""
    return df.where(held).withColumn("number", F.row_number().over(Window.partitionBy(issue).orderBy(*order)))


def first_of_week(df: DataFrame, stamp: str, tie: str, n: int) -> DataFrame:
    """The first ``n`` rows of every ISO week."""
    week = F.date_trunc("week", F.col(stamp))
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(week).orderBy(stamp, tie))).where(F.col("_rn") <= n).drop("_rn")


def monthly_order(rule: Column, ranks: Sequence[str], posted: Column, score: Column, id_col: Column) -> list[Column]:
    """Sort keys of a monthly issue: rule in the given order (unknown last), newest, highest score (null is 0), id."""
    rank = F.lit(len(ranks))
    for i, name in reversed(list(enumerate(ranks))):
        rank = F.when(rule == name, i).otherwise(rank)
    return [rank.asc(), posted.desc_nulls_last(), F.coalesce(score, F.lit(0.0)).desc(), id_col.asc()]


def within_rule_order(posted: Column, id_col: Column) -> list[Column]:
    return [posted.desc_nulls_last(), id_col.asc()]


def link_audit(blocks: DataFrame, by: str, kind: str, url: str) -> DataFrame:
    """Links by issue: those of items, those in commentary and stray ones."""
    linked = F.col(url).isNotNull()
    of = lambda c: F.count_if(linked & c)
    return blocks.groupBy(by).agg(of(F.col(kind) == "item").alias("item_links"), of(F.col(kind) == "comment").alias("comment_links"), of(~F.col(kind).isin("item", "comment")).alias("stray_links"))


def failed_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many texts of the columns hold something that is no date."""
    return df.agg(sum((F.count_if(date_parse_failed(F.col(c))) for c in columns), F.lit(0)).alias("failed"))
