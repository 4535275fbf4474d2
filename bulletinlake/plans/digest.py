"""From stored announcements to a weekly digest: window, verdict, merge, deadline, caps, reasons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, notices, text
from ..operators import linkage, ranking
from ..session import work_dir

CAPS: Mapping[str, int] = {"apply": 5, "notice": 3}
PER_SOURCE = 2


def window_rows(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Rows created in the days first..last by Korean time.

    The stored text is cut to a range one day wider, which a scan can use; the exact day comes after it.
    """
    begin, end = (F.date_add(F.lit(d).cast("date"), n).cast("string") for d, n in ((first, -1), (last, 2)))
    near = rows.where((F.col("created_at") >= begin) & (F.col("created_at") < end))
    return near.withColumn("created_day", dates.kst_date(F.col("created_at"))).where(F.col("created_day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def items(rows: DataFrame, today: str) -> DataFrame:
    """Announcements with verdict, keys, deadline, label and the sort keys of their section."""
    day = F.lit(today).cast("date")
    c = notices.classify(F.col("title"), F.col("summary"), F.col("source"))
    posted = F.coalesce(dates.parse_deadline(F.get_json_object("raw_data", "$.posted")), dates.kst_date(F.col("created_at")))
    deadline = dates.effective_deadline(F.col("period_start"), F.col("period_end"))
    out = rows.withColumn("c", c).withColumn("posted", posted).withColumn("deadline", deadline)
    body = F.concat_ws("\n", F.col("title"), F.col("summary"))
    return out.select(
        "id",
        "source",
        text.sanitise_title(F.col("title")).alias("title"),
        "url",
        "c.verdict",
        F.col("c.reason").alias("why"),
        "c.matched",
        "c.tags",
        "c.region",
        "c.pin_section",
        "posted",
        "deadline",
        dates.days_left(F.col("deadline"), day).alias("days_left"),
        dates.deadline_label(F.col("deadline"), F.col("posted"), day).alias("label"),
        dates.deadline_bucket(F.col("deadline"), F.col("posted"), day).alias("bucket"),
        text.merge_title_key(F.col("title")).alias("title_key"),
        text.prefix_signature(F.col("title")).alias("prefix"),
        text.holds_any(F.col("title"), notices.BUSINESS).alias("b2b"),
        F.contains(F.col("title"), F.lit("재공고")).alias("renewal"),
        notices.quoted(body, notices.ELIGIBILITY_QUOTES).alias("eligibility"),
        notices.quoted(body, notices.AMOUNT_QUOTES).alias("amount"),
        F.coalesce(F.datediff("deadline", F.lit("2000-01-01").cast("date")), F.lit(1_000_000)).alias("due"),
        F.coalesce(F.datediff("posted", F.lit("2000-01-01").cast("date")), F.lit(-1)).alias("age"),
    )


def merged(found: DataFrame) -> DataFrame:
    """One row for the notices that a source posted more than once, with the ids it stands for."""
    signed = found.withColumn("signature", F.concat_ws("|", "verdict", F.array_join("tags", ","), F.coalesce("region", F.lit("")), "prefix"))
    reps = linkage.merge_same(signed.withColumn("due_key", F.coalesce(F.col("deadline").cast("string"), F.lit(""))), ["source", "title_key", "due_key"], ["signature"], "id", "id", "renewal", "b2b")
    return found.join(reps.select("id", "merged_ids"), "id")


def _kept(df: DataFrame) -> DataFrame:
    """The rows, written to the folder that the cluster shares and read again."""
    folder = work_dir(df.sparkSession, "digest")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def compose(rows: DataFrame, first: str, last: str, today: str, pins: Sequence[int] = (), caps: Mapping[str, int] = CAPS, per_source: int = PER_SOURCE) -> DataFrame:
    """(section, position, id, ..., outcome): every classified row of the window, chosen or with why not.

    Order matters: rows merge first, then past deadlines go, then sections fill under their caps. Classified rows are written
    once, as every section reads them several times.
    """
    listed = merged(items(window_rows(rows, first, last), today))
    pinned = F.col("id").isin(list(pins)) if pins else F.lit(False)
    section = F.when(F.col("verdict").isin(*caps), F.col("verdict")).when(pinned & (F.col("verdict") == "hold"), F.col("pin_section"))
    past = (F.col("verdict") == "apply") & (F.col("days_left") < 0)
    placed = _kept(listed.withColumn("section", F.when(~F.coalesce(past, F.lit(False)), section)).withColumn("pinned", pinned & F.col("section").isNotNull()))
    orders = {"apply": [("bucket", False), ("due", False), ("age", True), ("id", False)], "notice": [("age", True), ("id", False)]}
    parts = []
    for name, cap in caps.items():
        keys = orders.get(name, orders["notice"])
        chosen = ranking.capped_topk(placed.where(F.col("section") == name), "id", "source", keys, cap, per_source, "pinned")
        shown = chosen.where("selected").withColumn("position", F.row_number().over(Window.orderBy(F.desc("pinned"), *ranking.ordering(keys))))  # cap rows
        parts.append(shown.unionByName(chosen.where("not selected").withColumn("position", F.lit(None).cast("int"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("outcome", F.col("reason")).drop("selected")
    rest = placed.where("section is null").withColumn("outcome", F.when(F.coalesce(past, F.lit(False)), "마감 경과").otherwise(F.col("why"))).withColumn("position", F.lit(None).cast("int"))
    columns = ["section", "position", "id", "source", "title", "url", "verdict", "tags", "region", "label", "deadline", "merged_ids", "outcome"]
    return out.select(*columns).unionByName(rest.select(*columns))


def markdown(digest: DataFrame, heads: Mapping[str, str] | None = None) -> DataFrame:
    """The chosen items as one markdown text: a heading for each section, a line for each item."""
    heads = heads or {"apply": "신청하세요", "notice": "알아두세요"}
    number = {s: i for i, s in enumerate(heads)}
    table = F.create_map(*[F.lit(x) for s, i in number.items() for x in (s, i)])
    line = F.concat(F.lit("- ["), F.col("label"), F.lit("] "), F.col("title"), F.lit(" — "), notices.target_display(F.col("tags"), F.col("region")), F.lit(" (원문: "), F.col("url"), F.lit(")"))
    lines = digest.where("position is not null").select(F.try_element_at(table, F.col("section")).alias("s"), "position", line.alias("line"))
    spark = digest.sparkSession
    titles = spark.createDataFrame([(i, 0, f"## {heads[s]}") for s, i in number.items()], "s int, position int, line string")
    every = F.array_sort(F.collect_list(F.struct("s", "position", "line")))
    return titles.unionByName(lines).agg(F.array_join(F.transform(every, lambda x: x["line"]), "\n").alias("markdown"))
