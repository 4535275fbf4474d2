"""Queries of the notice rules: listings and upkeep over the driver's tables, Korean rules over texts made from ``orders``.

The driver's tables hold no Korean text. So each order writes a text of its own by one of some patterns, which its number chooses, with
its number and dates in it (``MARKS``); the SQL fills the same marks into what the rule must give for the pattern. Rules that compare rows
get a group of rows for each customer.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, evidence, notices, text
from ..operators import linkage, lookups, merge, ranking, reconcile, reports, scoring, upkeep, vectors
from ..operators import sentences as sentence_ops
from ..session import table
from . import digest
from .catalogue import ORACLE_SQL, QUERIES, query  # noqa: F401


def _value(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, float):
        return f"{x!r}::DOUBLE"
    return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def values(columns: str, rows: Sequence[tuple]) -> str:
    """A table of rows as DuckDB SQL."""
    names = [c.split()[0] for c in columns.split(", ")]
    return f"(VALUES {', '.join('(' + ', '.join(map(_value, r)) + ')' for r in rows)}) t({', '.join(names)})"


# Marks in patterns, and what stands for them: the row's number, its date thirty years on and the date twenty days later, with and without zeros.
MARKS = {
    "@K": ("cast(k as string)", "CAST(k AS VARCHAR)"), "@I": ("date_format(d, 'yyyy-MM-dd')", "strftime(d, '%Y-%m-%d')"), "@J": ("date_format(e, 'yyyy-MM-dd')", "strftime(e, '%Y-%m-%d')"),
    "@N": ("date_format(d, 'yyyyMMdd')", "strftime(d, '%Y%m%d')"), "@O": ("date_format(e, 'yyyyMMdd')", "strftime(e, '%Y%m%d')"), "@P": ("date_format(d, 'yyyy. M. d.')", "strftime(d, '%Y. %-m. %-d.')"),
    "@Q": ("date_format(e, 'yyyy. M. d.')", "strftime(e, '%Y. %-m. %-d.')"), "@R": ("date_format(d, 'yyyy.MM.dd')", "strftime(d, '%Y.%m.%d')"), "@S": ("date_format(e, 'yyyy.MM.dd')", "strftime(e, '%Y.%m.%d')"),
    "@T": ("date_format(d, 'yy-MM-dd')", "strftime(d, '%y-%m-%d')"), "@U": ("date_format(d, 'EEE, dd MMM yyyy')", "strftime(d, '%a, %d %b %Y')"), "@V": ("date_format(d, 'M.d')", "strftime(d, '%-m.%-d')"),
    "@W": ("concat(extract(yearofweek from d), '-W', lpad(weekofyear(d), 2, '0'))", "strftime(d, '%G-W%V')"), "@X": ("date_format(d, 'yyyy')", "strftime(d, '%Y')"),
    "@Y": ("date_format(date_trunc('week', d), 'yyyy-MM-dd')", "strftime(date_trunc('week', d), '%Y-%m-%d')"), "@Z": ("date_format(date_add(to_date(date_trunc('week', d)), 6), 'yyyy-MM-dd')", "strftime(date_trunc('week', d) + INTERVAL 6 DAY, '%Y-%m-%d')"),
    "@A": ("date_format(d, 'yyyy-MM')", "strftime(d, '%Y-%m')"), "@B": ("date_format(last_day(d), 'yyyy-MM-dd')", "strftime(last_day(d), '%Y-%m-%d')"),
}
_ORDERS = "SELECT o_orderkey AS k, CAST(o_orderdate + INTERVAL 30 YEAR AS DATE) AS d, CAST(o_orderdate + INTERVAL 30 YEAR AS DATE) + 20 AS e FROM orders"
_CUSTOMERS = "SELECT c_custkey AS k, DATE '2026-09-01' AS d, DATE '2026-09-21' AS e FROM customer"


def _numbered(rows: Sequence[tuple]) -> int:
    """What a pattern's own number, if it has one, starts from."""
    return rows[0][0] if isinstance(rows[0][0], int) and not isinstance(rows[0][0], bool) else 0


def expected(columns: str, rows: Sequence[tuple], cases: Sequence[tuple]) -> str:
    """SQL: for each order the rows of its pattern, with marks filled in. ``id`` is the order's number; the first column of ``rows`` chooses them."""
    names = [c.split() for c in columns.split(", ")]
    marked = lambda n: _filled_sql(n) if any("@" in str(r[[x[0] for x in names].index(n)]) for r in rows) else n
    shown = ", ".join("k AS id" if i == 0 else f"{marked(n)} AS {n}" for i, (n, _) in enumerate(names))
    return f"SELECT {shown} FROM ({_ORDERS}) JOIN (SELECT * FROM {values(columns, rows)}) ON k % {len(cases)} = {names[0][0]} - {_numbered(cases)}"


def expected_groups(columns: str, rows: Sequence[tuple], ids: Sequence[str]) -> str:
    """SQL: ``rows`` for each customer; ``ids`` are columns of row numbers, which become ten times the customer's number and them."""
    shown = ", ".join(f"k * 10 + {n} AS {n}" if n in ids else n for n in (c.split()[0] for c in columns.split(", ")))
    return f"SELECT {shown} FROM ({_CUSTOMERS}), (SELECT * FROM {values(columns, rows)})"


def _filled_sql(column: str) -> str:
    for mark, (_, sql) in MARKS.items():
        column = f"replace({column}, '{mark}', {sql})"
    return column


def _filled(c: Column) -> Column:
    for mark, (expr, _) in MARKS.items():
        unquoted = "'".join(re.sub(r"\b([kde])\b", r"_o.\1", x) if i % 2 == 0 else x for i, x in enumerate(expr.split("'")))
        c = F.replace(c, F.lit(mark), F.expr(unquoted))
    return c


def _fill(df: DataFrame, columns: str, rows: Sequence[tuple]) -> DataFrame:
    out = df
    for i, name in enumerate(c.split()[0] for c in columns.split(", ")):
        if any("@" in str(r[i]) for r in rows):
            out = out.withColumn(name, F.transform(name, _filled) if isinstance(next(r[i] for r in rows if r[i]), list) else _filled(F.col(name)))
    return out


# Listings over the driver's tables


@query("SELECT event_id, event_type = 'purchase' AND event_id % 2 = 1 AS legacy FROM events")
def legacy_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    source_id = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("fnc:"), "event_id")).otherwise(F.col("event_id").cast("string"))
    return events.select("event_id", lookups.is_legacy_id(F.col("event_type"), source_id, ("purchase",)).alias("legacy"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def rows_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "labels").where("toxic = 1")
    return lookups.rows_of_ids(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", wanted)


@query("SELECT d.doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def lookup_with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.with_defaults_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", {"quality": F.lit(0), "toxic": F.lit(-1)})


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND value >= 50")
def seen_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.seen_since(table(spark, sf_dir, "events"), ts=F.expr("timestamp_ntz'2024-01-20'"), value=F.lit(50)).select("event_id", "user_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def application_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return lookups.listing(orders, [F.desc("o_orderdate"), F.asc("o_orderkey")], 50, o_orderstatus="O", o_orderpriority="2-HIGH", o_custkey=None).select("o_orderkey", "o_custkey")


@query("SELECT doc_id, CASE source WHEN 'src1' THEN '산림청' WHEN 'src2' THEN '협동조합' WHEN 'src3' THEN '기관 미상' ELSE source END AS name FROM documents")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("source") == "src3", " ").otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", lookups.display_name(key, {"src1": "산림청", "src2": "협동조합"}).alias("name"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '2023-12-31' ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events")
def media_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, '{"posted": "2023-12-31T09:00"}').when(F.col("event_id") % 3 == 1, '{"posted": ""}').otherwise("no json")
    return table(spark, sf_dir, "events").select("event_id", lookups.media_day(raw, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("day"))


@query("SELECT vec_id, label, source, n_chars FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id")
def hits_with_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source", "n_chars")
    return lookups.joined_hits(hits, rows, "vec_id")


@query("SELECT o_orderkey, coalesce(left(c_name, 12), '공고 #' || CAST(o_custkey AS VARCHAR)) AS title FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def application_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    applications = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("id"))
    rows = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    return lookups.with_titles(applications, rows, "id", most=12).select("o_orderkey", "title")


@query("SELECT n_nationkey, arg_min(c_name, c_custkey) AS c_name, arg_min(c_acctbal, c_custkey) AS c_acctbal FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_nationkey")
def first_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return lookups.first_match(table(spark, sf_dir, "nation").select("n_nationkey"), customers, "n_nationkey", "c_custkey", ["c_name", "c_acctbal"])


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND user_id IN (SELECT user_id FROM events WHERE value < 20)")
def excluded_still_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return lookups.still_present(events.where("event_type = 'purchase'"), events.where("value < 20"), "user_id")


@query("SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def first_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.first_occurrences(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT doc_id, source <> 'src1' OR row_number() OVER (PARTITION BY lang, source = 'src1' ORDER BY n_chars DESC, doc_id) <= 2 AS kept FROM documents")
def media_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return lookups.kind_capped(docs, "lang", F.col("source") == "src1", [F.desc("n_chars"), F.asc("doc_id")]).select("doc_id", "kept")


@query("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS number FROM orders WHERE o_orderstatus = 'F'")
def hold_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = lookups.numbered_holds(table(spark, sf_dir, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F", [F.desc("o_totalprice"), F.asc("o_orderkey")])
    return held.select("o_orderkey", "number")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY date_trunc('week', ts) ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= 4")
def first_of_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.first_of_week(table(spark, sf_dir, "events"), "ts", "event_id", 4).select("event_id")


@query(
    """SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
ORDER BY CASE source WHEN 'src2' THEN 0 WHEN 'src1' THEN 1 ELSE 2 END, n_chars DESC, coalesce(quality, 0) DESC, d.doc_id LIMIT 60"""
)
def monthly_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.orderBy(*lookups.monthly_order(F.col("source"), ["src2", "src1"], F.col("n_chars"), F.col("quality").cast("double"), F.col("doc_id"))).select("doc_id").limit(60)


@query(
    """SELECT user_id, count(*) FILTER (WHERE value >= 50 AND event_type = 'purchase') AS item_links, count(*) FILTER (WHERE value >= 50 AND event_type = 'view') AS comment_links,
count(*) FILTER (WHERE value >= 50 AND event_type NOT IN ('purchase', 'view')) AS stray_links FROM events GROUP BY user_id"""
)
def link_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "item").when(F.col("event_type") == "view", "comment").otherwise("prose")
    blocks = table(spark, sf_dir, "events").select("user_id", kind.alias("kind"), F.when(F.col("value") >= 50, F.concat(F.lit("https://x/"), "event_id")).alias("url"))
    return lookups.link_audit(blocks, "user_id", "kind", "url")


@query("SELECT count(*) FILTER (WHERE o_orderkey % 5 = 0) + count(*) FILTER (WHERE o_orderstatus = 'F') AS failed FROM orders")
def failed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy.MM.dd")
    orders = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 5 == 0, "2024-02-31").otherwise(day).alias("a"), F.when(F.col("o_orderstatus") == "F", "추후 공지").when(F.col("o_orderstatus") == "O", "").otherwise(day).alias("b"))
    return lookups.failed_dates(orders, ["a", "b"])


# Upkeep over the driver's tables


@query("SELECT event_id, event_type, value FROM events UNION ALL SELECT event_id + 1000000000, 'again', NULL FROM events WHERE event_type = 'purchase'")
def runs_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return upkeep.appended(events, events.where("event_type = 'purchase'").select((F.col("event_id") + 1_000_000_000).alias("event_id"), F.lit("again").alias("event_type")))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN lang ELSE CASE WHEN quality = 1 THEN 'good' END END AS lang, source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def references_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").alias("lang"))
    return upkeep.set_reference(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), refs, "doc_id", ["lang"])


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_totalprice > 100000 THEN 'closed' END END, o_orderstatus) AS o_orderstatus FROM orders")
def fields_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    updates = orders.where("o_orderstatus = 'F'").select("o_orderkey", F.when(F.col("o_totalprice") > 100_000, "closed").alias("o_orderstatus"))
    return upkeep.update_fields(orders.select("o_orderkey", "o_orderstatus"), updates, "o_orderkey", ["o_orderstatus"])


@query(
    """WITH d AS (SELECT o_custkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS version FROM orders WHERE o_custkey IS NOT NULL)
SELECT id, version FROM d UNION ALL SELECT c_custkey, coalesce(top, 0) + 1 FROM customer LEFT JOIN (SELECT id, max(version) AS top FROM d GROUP BY id) ON c_custkey = id"""
)
def versions_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = ranking.Window.partitionBy("o_custkey").orderBy("o_orderkey")
    documents = table(spark, sf_dir, "orders").where("o_custkey is not null").select(F.col("o_custkey").alias("id"), F.row_number().over(rank).alias("version"))
    return upkeep.next_version(documents, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id")


@query(
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN sha256(coalesce(lang, '') || chr(0) || coalesce(source, '')) END AS council_content_hash,
CASE WHEN l.doc_id IS NOT NULL THEN '2026-04-01' END AS council_rechecked_at FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def recheck_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.lit(None).cast("string").alias("council_content_hash"), F.lit(None).cast("string").alias("council_rechecked_at"))
    return upkeep.rechecked(docs, table(spark, sf_dir, "labels"), "doc_id", text.content_hash(F.col("lang"), F.col("source")), F.lit("2026-04-01")).select("doc_id", "council_content_hash", "council_rechecked_at")


@query("SELECT doc_id, quality FROM labels WHERE quality >= 0.5 AND toxic = 1")
def records_wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.wanted_records(table(spark, sf_dir, "labels"), "quality", 0.5, "toxic").select("doc_id", "quality")


@query(
    """SELECT d.doc_id, 'lang' AS field, d.lang AS shown, coalesce(nullif(d.lang, 'fr'), 'xx') AS stored FROM documents d WHERE d.lang = 'fr'
UNION ALL SELECT doc_id, 'source', 'src1', NULL FROM documents WHERE source = 'src1'"""
)
def classification_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    stored = shown.select("doc_id", F.when(F.col("lang") == "fr", "xx").otherwise(F.col("lang")).alias("lang"), F.nullif("source", F.lit("src1")).alias("source"))
    return upkeep.classification_problems(shown, stored, "doc_id", ["lang", "source"])


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'no snapshot' WHEN o_orderkey % 2 = 1 THEN 'body changed' WHEN o_orderstatus = 'F' THEN 'dead links' END AS problem FROM orders"""
)
def liveness_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot = F.when(F.col("o_orderstatus") != "P", (F.col("o_orderkey") % 2).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", upkeep.liveness_problem(F.lit("0"), snapshot, (F.col("o_orderstatus") == "F").cast("int")).alias("problem"))


@query("SELECT d.doc_id, CASE WHEN toxic > 0 THEN toxic WHEN quality > 0 THEN quality WHEN l.doc_id IS NOT NULL THEN 0 END AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def first_parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select("doc_id", upkeep.first_parse(F.col("toxic"), F.col("quality")).alias("n"))


@query("SELECT 'k' AS kind, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS n FROM events")
def warning_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.warning_summary(table(spark, sf_dir, "events"), "event_id", "props")


@query("SELECT doc_id, CASE WHEN source = 'src1' THEN 'apply' WHEN source = 'src2' THEN 'notice' WHEN lang = 'en' THEN 'apply' ELSE 'unknown' END AS section FROM documents")
def sections_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked, composed = F.when(F.col("source") == "src1", "apply").otherwise(""), F.when(F.col("source") == "src2", "notice")
    return table(spark, sf_dir, "documents").select("doc_id", upkeep.section_of(checked, composed, F.col("lang"), {"en": "apply"}).alias("section"))


@query(
    """SELECT doc_id, CASE WHEN a <= 4096 THEN TRUE WHEN a - 6 <= 4096 THEN TRUE ELSE a - 6 - length(source) - 1 <= 4096 END AS fits,
CAST(CASE WHEN a <= 4096 THEN 0 WHEN a - 6 <= 4096 THEN 1 ELSE 2 END AS INT) AS dropped
FROM (SELECT doc_id, source, length(text) + length(source) + 7 AS a FROM documents)"""
)
def chunk_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = upkeep.fits_chunk([F.col("text"), F.col("source"), F.lit("notes")], 2)
    return table(spark, sf_dir, "documents").select("doc_id", fit.alias("f")).select("doc_id", "f.fits", "f.dropped")


@query(
    """SELECT source, count(*) AS n_items, sha256('body of ' || source) AS sha256,
sha256(string_agg(CAST(n_chars AS VARCHAR), chr(10) ORDER BY doc_id)) AS lines_sha256 FROM documents GROUP BY source"""
)
def manifests_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("n_chars").cast("string").alias("line"))
    return upkeep.bound_manifest(docs, "source", "doc_id", "line", F.concat(F.lit("body of "), "source")).withColumn("n_items", F.col("n_items").cast("long"))


@query("SELECT doc_id, lang, source FROM documents WHERE source <> 'src1' UNION ALL SELECT doc_id, lang, 'new' FROM documents WHERE source = 'src1'")
def missing_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return merge.insert_missing(docs.where("source <> 'src1'"), docs.withColumn("source", F.lit("new")), ["doc_id"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_notified FROM orders")
def notified_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", F.lit(0).alias("is_notified"))
    return merge.mark_notified(orders, orders.where("o_orderstatus = 'F'")).select(F.col("id").alias("o_orderkey"), "is_notified")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'large' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def values_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.set_where(table(spark, sf_dir, "orders"), F.col("o_totalprice") > 100_000, o_orderpriority=F.lit("large")).select("o_orderkey", "o_orderpriority")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'own' WHEN o_orderstatus = 'F' THEN 'earlier' END AS evidence FROM orders"""
)
def evidence_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    now = orders.select("o_orderkey", F.lit("u").alias("url"), F.when(F.col("o_orderkey") % 2 == 0, "own").alias("evidence"))
    before = orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "u").otherwise("other").alias("url"), F.lit("earlier").alias("evidence"))
    return merge.carry_forward(now, before, ["o_orderkey"], "url", "evidence").select("o_orderkey", "evidence")


@query("SELECT max(doc_id) + 1 AS next_id FROM documents")
def next_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.next_id(table(spark, sf_dir, "documents"), "doc_id")


@query("SELECT CAST(p - 1 AS INT) AS position, v AS verdict, (SELECT count(*) FROM orders WHERE o_orderstatus = v) AS n FROM (VALUES (1, 'O'), (2, 'F'), (3, 'X'), (4, 'P')) t(p, v)")
def verdict_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.histogram(table(spark, sf_dir, "orders"), "o_orderstatus", ["O", "F", "X", "P"])


@query("SELECT vec_id, '[' || array_to_string([CAST(CAST(floor(1000 * CAST(x AS DOUBLE)) AS INT) AS VARCHAR) FOR x IN embedding], ',') || ']' AS literal FROM embeddings")
def vector_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousandths of the components, x as double: a product of floats may be rounded up to the next whole number."""
    whole = F.transform("embedding", lambda x: F.floor(1000 * x.cast("double")).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.vector_literal(whole).alias("literal"))


@query(
    """SELECT doc_id, CASE WHEN lang = 'en' AND n_chars % 7 = 0 THEN 0.5 ELSE (n_chars % 7) / 7.0 END AS score FROM documents WHERE lang = 'en' OR (n_chars % 7) / 7.0 >= 0.5"""
)
def relevant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") % 7 / 7.0).alias("score"))
    return scoring.select_relevant(docs, "score", 0.5, F.col("lang") == "en").select("doc_id", "score")


@query("SELECT doc_id, n_chars >= 500 AND row_number() OVER (ORDER BY n_chars < 500, n_chars DESC, doc_id) <= 50 AS evaluated FROM documents")
def budgeted_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.budgeted(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 500, 50).select("doc_id", "evaluated")


@query("SELECT o_orderkey, o_orderdate < TIMESTAMP '1996-06-01' AS late, o_orderstatus IN ('F') AS legal FROM orders")
def state_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    late = reconcile.expired(orders, F.col("o_orderdate"), F.expr("timestamp_ntz'1996-06-01'")).select("o_orderkey", F.lit(True).alias("late"))
    asked = reconcile.transitions(orders.select("o_orderkey", F.lit("draft").alias("from_status"), F.when(F.col("o_orderstatus") == "F", "held").otherwise("sent").alias("to_status")), {"draft": ["held", "annotated"]})
    return asked.join(late, "o_orderkey", "left").select("o_orderkey", F.coalesce("late", F.lit(False)).alias("late"), "legal")


@query("SELECT o_orderkey, 'priority' AS field FROM orders WHERE o_orderpriority = '5-LOW'")
def schema_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority")).alias("priority"))
    return reconcile.schema_problems(orders, "o_orderkey", ["o_orderkey", "o_orderstatus", "priority"])


@query(
    """SELECT o_orderkey, o_orderstatus = 'F' AND o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 AS passed,
CASE WHEN o_orderstatus <> 'F' THEN 'not approved' WHEN o_orderkey % 2 <> 0 THEN 'body changed since approval' WHEN o_orderkey % 3 <> 0 THEN 'a newer issue is open' END AS reason FROM orders"""
)
def send_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    gate = reconcile.can_send(F.when(F.col("o_orderstatus") == "F", "approved").otherwise("draft"), F.lit("0"), (key % 2).cast("string"), F.lit(True), F.lit(3), F.when(key % 3 != 0, key))
    return table(spark, sf_dir, "orders").select("o_orderkey", gate.alias("g")).select("o_orderkey", "g.*")


@query(
    """SELECT event_id, CASE WHEN event_type = 'purchase' THEN '{"k":"' || coalesce(json_extract_string(props, '$.k'), '') || '"}' END AS state FROM events WHERE event_type = 'purchase'"""
)
def sets_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.try_element_at(text.json_map(F.col("props")), F.lit("k"))
    kept = reconcile.drop_from_set(reconcile.add_to_set(F.array(F.lit("a")), F.array(F.coalesce(k, F.lit("")))), F.array(F.lit("a")))
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", F.concat(F.lit('{"k":"'), F.array_join(kept, ","), F.lit('"}')).alias("state"))


# Korean rules over texts of the orders

TITLES = [
    (1, "  [서울] @X년  산림 지원사업 (3차) 공고​ @K"),
    (2, "「마을기업」 육성사업 모집 - 2차·추가"),
    (3, "# 협동조합 <b>지원</b> — 안내"),
    (4, None),
    (5, "12. 사회적기업 (예비) 인증 공고 @R."),
    (6, "[경기][공고] 임업인 교육(상반기) 신청"),
]
TITLE_SQL = f"""WITH r AS (SELECT id, coalesce(title, '') AS raw FROM ({expected("id int, title string", TITLES, TITLES)})),
n AS (SELECT id, raw, trim(regexp_replace(regexp_replace(raw, '[\\x{{200b}}]', '', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g')) AS t FROM r),
d AS (SELECT *, regexp_replace(t, '\\d{{1,4}}\\s*[.\\-/]\\s*\\d{{1,2}}(?:\\s*[.\\-/]\\s*\\d{{1,2}})?\\.?|\\d{{1,4}}\\s*년|\\d{{1,2}}\\s*월|\\d{{1,2}}\\s*일|\\d{{1,2}}\\s*차|\\d{{1,2}}\\s*분기', ' ', 'g') AS undated FROM n)
"""


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir, "id int, title string", TITLES)


@query(
    TITLE_SQL
    + """SELECT id, t AS normal, regexp_replace(t, '[\\s\\p{Z}]', '', 'g') AS merge_key, regexp_replace(raw, '[\\s\\p{Z}·.,()\\[\\]{}「」『』\\-~/]+', '', 'g') AS crawler_key,
trim(regexp_replace(regexp_replace(undated, '[^0-9A-Za-z가-힣ㄱ-ㅎㅏ-ㅣ\\s]', ' ', 'g'), '[\\s\\p{Z}]+', ' ', 'g')) AS dedup_key FROM d"""
)
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    return _titles(spark, sf_dir).select("id", text.normalise_title(t).alias("normal"), text.merge_title_key(t).alias("merge_key"), text.crawler_title_key(t).alias("crawler_key"), text.dedup_key(t).alias("dedup_key"))


@query(
    TITLE_SQL
    + """SELECT id, lower(translate(raw, '()[]{}（）［］【】「」『』<>〈〉《》 ', '')) AS council_key,
array_to_string([x FOR x IN regexp_split_to_array(lower(translate(raw, '()[]{}（）［］【】「」『』<>〈〉《》.,·:;!?/|~"''“”‘’…-', repeat(' ', 42))), '[\\s\\p{Z}]+') IF x <> ''], '|') AS tokens FROM n"""
)
def council_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    return _titles(spark, sf_dir).select("id", text.council_key(t).alias("council_key"), F.array_join(text.council_tokens(t), "|").alias("tokens"))


def _cases(spark: SparkSession, sf_dir: str, columns: str, rows: Sequence[tuple], of: int | None = None) -> DataFrame:
    """A row for each order by its pattern (of ``of``; those without one have none); ``id``, the first column, is the order's number."""
    first = columns.split(" ")[0]
    orders = table(spark, sf_dir, "orders").selectExpr("struct(o_orderkey as k, add_months(to_date(o_orderdate), 360) as d, date_add(add_months(to_date(o_orderdate), 360), 20) as e) as _o")
    patterns = F.broadcast(spark.createDataFrame(list(rows), columns))  # as many rows as written here
    joined = orders.join(patterns, F.expr(f"_o.k % {of or len(rows)} = {first} - {_numbered(rows)}"))
    return _fill(joined, columns, rows).withColumn(first, F.col("_o.k")).drop("_o")


def _groups(spark: SparkSession, sf_dir: str, columns: str, rows: Sequence[tuple]) -> DataFrame:
    """The rows for each customer, numbered by ten times the customer's number and their own."""
    customers = table(spark, sf_dir, "customer").selectExpr("struct(c_custkey as k, date'2026-09-01' as d, date'2026-09-21' as e) as _o")
    joined = customers.crossJoin(F.broadcast(spark.createDataFrame(list(rows), columns)))  # as many rows as written here
    return _fill(joined, columns, rows).withColumn("id", F.col("_o.k") * 10 + F.col("id")).drop("_o")


STRINGS = [(1, "문의 abc@K@d.kr, 010-1234-5678 (담당)", "api_key=XYZ&x=@K", "a/b:c?@K.csv"), (2, None, None, None), (3, "정산 (1차) 안내(공통)", "Authorization: 'q w'", " plain ")]


@query(expected("id int, masked string, safe string, hidden string, notes string, rounds string, numbers string, clean string", [
    (1, "문의 [email], [phone] (담당)", "a_b_c_@K.csv", "api_key=***&x=@K", "문의 abc@K@d.kr, 010-1234-5678", "", "@K|010|1234|5678", "문의 abc@K@d.kr, 010-1234-5678 (담당)"),
    (2, "", "", "", "", "", "", ""),
    (3, "정산 (1차) 안내(공통)", "plain", "Authorization: '*** w'", "정산 (1차) 안내", "1차", "1", "정산 (1차) 안내(공통)"),
], STRINGS))
def string_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    rules = {"masked": text.mask_contacts(a), "safe": text.safe_filename(c), "hidden": text.redact(b), "notes": text.strip_notes(a), "rounds": text.round_tokens(a), "numbers": F.array_join(text.number_tokens(a), "|"), "clean": text.clean_text(a)}
    return _cases(spark, sf_dir, "id int, a string, b string, c string", STRINGS).select("id", *[r.alias(n) for n, r in rules.items()])


BRACKETS = [(1, "[경기][공고] 임업인 @K 교육(상반기) 신청"), (2, "# 협동조합 <b> — 안내"), (3, "[안내](https://x.kr/a(1)) 보기"), (4, None), (5, "1. 시작 (가 (나) 다) 끝")]


@query(expected("id int, shown string, bare string, groups string, prefix string", [
    (1, "[경기][공고] 임업인 @K 교육(상반기) 신청", "임업인 @K 교육 신청", "경기|공고|상반기", "[경기][공고]"),
    (2, "＃ 협동조합 ＜b＞ – 안내", "# 협동조합 — 안내", "", ""),
    (3, "안내 보기", "보기", "안내|1", "[안내]"),
    (4, "", "", "", ""),
    (5, "1． 시작 (가 (나) 다) 끝", "1. 시작 끝", "나", ""),
], BRACKETS))
def bracket_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    return _cases(spark, sf_dir, "id int, title string", BRACKETS).select("id", text.sanitise_title(t).alias("shown"), text.strip_brackets(t).alias("bare"), F.array_join(text.bracket_groups(t), "|").alias("groups"), text.prefix_signature(t).alias("prefix"))


@query("SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9])the([^a-z0-9]|$)') AS short_word, contains(lower(text), 'ation') AS long_word FROM documents")
def keyword_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.keyword_match(low, "the").alias("short_word"), text.keyword_match(low, "ation").alias("long_word"))


URLS = [(1, "https://a.kr/view?bsIdx=10002&bIdx=@K"), (2, "https://a.kr/post/@K.do"), (3, None)]


@query(f"SELECT id, CASE WHEN url IS NULL THEN left(md5(''), 16) ELSE CAST(id AS VARCHAR) END AS source_id, coalesce(url || ' | x', 'x') AS summary FROM ({expected('id int, url string', URLS, URLS)})")
def ids_from_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return _cases(spark, sf_dir, "id int, url string", URLS).select("id", text.id_from_url(url, [r"[?&]bIdx=(\d+)", r"/post/(\d+)"]).alias("source_id"), text.summary_of_parts(url, F.lit(" "), F.lit("x")).alias("summary"))


PLAIN = [(1, "보통의 @K 문장입니다."), (2, "보기 https://x.kr"), (3, "굵게 *쓴* 문장"), (4, " "), (5, "줄\n바꿈")]


@query(expected("id int, problem string", [(1, None), (2, "url"), (3, "markdown character"), (4, "empty"), (5, "control character")], PLAIN))
def format_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir, "id int, t string", PLAIN).select("id", text.format_problem(F.col("t")).alias("problem"))


NOTICES = [
    (1, "산지관리법 시행령 개정 입법예고 공고 @K", "lawmaking", "notice", "제도: 입법예고"),
    (2, "나눔의 숲 캠프 모집", "fowi", "hold", "참가자 모집(B2C): 캠프"),
    (3, "산림 기업 캠프 모집", "fowi", "apply", "기회: 모집"),
    (4, "임업 기본계획 발표", "forest_press", "notice", "제도: 기본계획"),
    (5, "산림 이야기", "forest_press", "hold", "섹션 판정 불명"),
    (6, "자활기업 모집", "seis", "hold", "대상 태그 없음"),
]


@query(expected("id int, verdict string, reason string", [(n[0], n[3], n[4]) for n in NOTICES], NOTICES))
def notice_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, sf_dir, "id int, title string, source string", [n[:3] for n in NOTICES])
    return rows.select("id", notices.classify(F.col("title"), F.lit(""), F.col("source")).alias("c")).select("id", "c.verdict", "c.reason")


PLACES = [(1, "[경기] 사회적협동조합 @I 모집"), (2, "마을기업·산림 지원 (장소: 서울)"), (3, "서울 부산 협동조합 공고"), (4, "사회적경제 수도권 설명회"), (5, "강원특별자치도 임업인 지원")]


@query(expected("id int, region string, tags string, shown string", [
    (1, "경기", "사협", "사협(경기)"), (2, None, "마을기업|산림사업자", "마을기업·산림사업자"), (3, None, "협동조합", "협동조합"), (4, "수도권", "전체", "전체(수도권)"), (5, "강원", "산림사업자", "산림사업자(강원)"),
], PLACES))
def notice_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, sf_dir, "id int, title string", PLACES).withColumn("r", notices.infer_region(F.col("title"))).withColumn("t", notices.target_tags(F.col("title")))
    return rows.select("id", F.col("r").alias("region"), F.array_join("t", "|").alias("tags"), notices.target_display(F.col("t"), F.col("r")).alias("shown"))


CLAIMS = [(1, "공고 신청자격: 협동조합\n최대 3억 원 지원"), (2, "이야기 @K"), (3, "보도 채용 500만 원")]


@query(expected("id int, amount string, eligibility string, rule string, gate string", [
    (1, "최대 3억 원", "신청자격: 협동조합", "notice", None), (2, "원문 확인", "원문 확인", None, "noise: no cue"), (3, "500만 원", "원문 확인", "press", "noise: excluded word"),
], CLAIMS))
def notice_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, sf_dir, "id int, t string", CLAIMS)
    t = F.col("t")
    rule = notices.monthly_rule(t, {"notice": ("공고",), "press": ("보도",)})
    return rows.select("id", notices.quoted(t, notices.AMOUNT_QUOTES).alias("amount"), notices.quoted(t, notices.ELIGIBILITY_QUOTES).alias("eligibility"), rule.alias("rule"), scoring.gate(t, ("채용",), ("공고", "보도")).alias("gate"))


DETAILS = [
    ("ㅇ 접수기간 : @P ~ @Q 18:00까지 ㅇ 문의처 02-1", None, False, 1, "", "@I", "@J", None),
    ("모집기간: ~ 안내 예정", None, False, 1, "", None, None, "형태 불일치"),
    ("접수기간 : @P ~ @Q ○ 9월 30일까지", None, False, 1, "", None, None, "근거 충돌"),
    ("접수기간 @P 까지 신청기간 @Q 까지", None, False, 2, "", None, None, "라벨 중복"),
    ("접수기간 : @P 까지", None, False, 1, "", None, "@I", None),
    ("접수기간 : @Q ~ @P", None, False, 1, "", None, None, None),
    ("접수기간 : @P ~ @Q", None, True, 1, "", None, None, "근거 절단"),
    ("", "@I", False, 0, "", None, None, "근거 소실"),
    (None, None, False, None, None, None, None, "근거 없음"),
]


@query(expected("id int, period_start string, period_end string, reason string", [(i, *d[5:]) for i, d in enumerate(DETAILS)], DETAILS))
def detail_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, sf_dir, "id int, t string, f string, cut boolean, n int, cue string", [(i, *d[:5]) for i, d in enumerate(DETAILS)])
    return rows.select("id", evidence.detail_period(*map(F.col, ("t", "f", "cut", "n", "cue"))).alias("p")).selectExpr("id", "p.*").toDF("id", "period_start", "period_end", "reason")


QUOTES = [
    ("접수기간 @R ~ @S 18:00까지", "@I", "@I", "@J", False, False),
    ("@R부터 @S까지", "2026-09-10", "@I", "@J", False, False),
    ("1차 @R ~ @R 2차 @S ~ @S", "2090-01-01", "@J", "@J", False, False),
    ("@R부터 예산 소진 시까지", "1990-01-01", "@I", None, False, False),
    ("@S까지, 예산 소진 시 조기마감", "1990-01-01", None, "@J", False, True),
    ("상시 접수 @K", "1990-01-01", None, None, True, False),
    (None, "1990-01-01", None, None, False, False),
]


@query(expected("id int, period_start string, period_end string, always boolean, early boolean", [(i, *q[2:]) for i, q in enumerate(QUOTES)], QUOTES))
def quote_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, sf_dir, "id int, q string, today string", [(i, *q[:2]) for i, q in enumerate(QUOTES)])
    return rows.select("id", evidence.quote_period(F.col("q"), F.col("today").cast("date")).alias("p")).selectExpr("id", "p.*").toDF("id", "period_start", "period_end", "always", "early")


LABELLED = [(1, "사업기간 접수기간 신청 기간 @I"), (2, "접수기간 @K 이전글 접수기간"), (3, "기간 연장 변경 @J")]


@query(expected("id int, labels int, cue string", [(1, 2, ""), (2, 1, ""), (3, 0, "연장")], LABELLED))
def period_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, sf_dir, "id int, t string", LABELLED)
    return rows.select("id", evidence.count_period_labels(F.col("t")).cast("int").alias("labels"), evidence.conflict_cue(F.col("t")).alias("cue"))


DATES = [(1, "@R 18시"), (2, "@T까지"), (3, "@N"), (4, "@X-02-31"), (5, None), (6, "추후 @K")]


@query(expected("id int, deadline string, failed boolean, normal string", [
    (1, "@I", False, "@I"), (2, "20@T", False, None), (3, None, True, "@I"), (4, None, True, "@X-02-31"), (5, None, False, None), (6, None, True, None),
], DATES))
def date_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return _cases(spark, sf_dir, "id int, t string", DATES).select("id", dates.parse_deadline(t).cast("string").alias("deadline"), dates.date_parse_failed(t).alias("failed"), dates.normalise_date(t).alias("normal"))


@query(
    """SELECT o_orderkey, CASE WHEN days_left > 0 THEN 'D-' || days_left WHEN days_left = 0 THEN 'D-day' WHEN days_left < 0 THEN '마감' WHEN age BETWEEN 0 AND 7 THEN '새 소식' ELSE '상시' END AS label,
CAST(CASE WHEN days_left IS NOT NULL THEN 0 WHEN age BETWEEN 0 AND 7 THEN 1 ELSE 2 END AS INT) AS bucket, CAST(month(d) AS VARCHAR) || '/' || day(d) AS month_day, year(d) || '년 Q' || quarter(d) AS quarter,
strftime(d - INTERVAL 1 MONTH, '%Y-M%m') AS previous
FROM (SELECT o_orderkey, d, CASE WHEN o_orderkey % 2 = 0 THEN date_diff('day', DATE '1996-06-01', d) END AS days_left, date_diff('day', d, DATE '1996-06-01') AS age FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders))"""
)
def deadline_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    today = F.lit("1996-06-01").cast("date")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    due = F.when(F.col("o_orderkey") % 2 == 0, F.col("d"))
    return orders.select("o_orderkey", dates.deadline_label(due, F.col("d"), today).alias("label"), dates.deadline_bucket(due, F.col("d"), today).alias("bucket"), dates.month_day(F.col("d")).alias("month_day"), dates.quarter_label(F.col("d")).alias("quarter"), dates.previous_month_key(F.col("d")).alias("previous"))


FEEDS = [(1, "@U 09:00:00 +0900", "@N ~ @O", "@P ~ @Q"), (2, "@IT11:00:00Z", "@N", "@S ~ @R"), (3, None, None, "@R 부터")]


@query(expected("id int, posted string, period_start string, period_end string, range_start string, range_end string", [
    (1, "@I", "@I", "@J", "@I", "@J"), (2, "@I", "@I", "@I", None, None), (3, None, None, None, None, None),
], FEEDS))
def feed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = dates.api_period(F.col("p"))
    rows = _cases(spark, sf_dir, "id int, d string, p string, r string", FEEDS).withColumn("x", dates.range_only(F.col("r")))
    return rows.select("id", dates.pub_date(F.col("d")).alias("posted"), start.alias("period_start"), end.alias("period_end"), F.col("x.start").alias("range_start"), F.col("x.end").alias("range_end"))


ISSUES = [(1, "@W"), (2, "@X-M02"), (3, "@X-W54"), (4, "x@K")]


@query(expected("id int, kind string, first string, last string", [(1, "weekly", "@Y", "@Z"), (2, "monthly", "@X-02-01", None), (3, None, None, None), (4, None, None, None)], ISSUES))
def issue_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    issue = F.col("issue")
    week, month, kind = dates.week_range(issue), dates.month_range(issue), dates.issue_kind(issue)
    of = lambda i: F.when(kind == "weekly", week[i]).when(kind == "monthly", month[i]).cast("string")
    return _cases(spark, sf_dir, "id int, issue string", ISSUES).select("id", kind.alias("kind"), of(0).alias("first"), F.when(kind == "weekly", of(1)).alias("last"))


KEYS = [
    (1, "산림 지원 @K (2차)", ["서울  센터", "", "서울 센터"], None, "@A", ["추가"]), (2, "산림·지원(2차)", ["부산"], "@I", "@A", []),
    (3, None, [], None, None, ["02차 여수시청", "상시"]),
]


@query(expected("id int, title string, subjects string, deadline string, round string, region string", [
    (1, "산림지원@K2차", "서울 센터", "month:@A", "2차|추가", "서울  센터"), (2, "산림지원2차", "부산", "@I", "", "부산"), (3, "", "", "", "2차|상시", ""),
], KEYS))
def group_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, sf_dir, "id int, t string, s array<string>, e string, m string, r array<string>", KEYS)
    return rows.select("id", upkeep.group_key(*map(F.col, "tsemr")).alias("k"), upkeep.first_region(F.col("s")).alias("region")).select("id", "k.*", "region")


POSTS = [(1, "fnc:@K", "https://a.kr/v?bsIdx=10002&bIdx=@K"), (2, "x@K", "https://a.kr/v?bsIdx=10002&bIdx=@K"), (3, "5", "https://a.kr/#void"), (4, "", None)]


@query(expected("id int, matches boolean, unresolved boolean", [(1, True, False), (2, False, False), (3, False, True), (4, False, True)], POSTS))
def post_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, sf_dir, "id int, s string, u string", POSTS)
    return rows.select("id", upkeep.id_matches_url(F.col("s"), F.col("u"), ["bIdx"]).alias("matches"), upkeep.url_is_unresolved(F.col("u"), ["bIdx"]).alias("unresolved"))


STORED = [
    (1, "k@K", "서울", "", "2026-09-30", "fnc:7", "https://a/v?bIdx=7"), (2, "k@K", "서울", "", "2026-10-30", "99", "https://a/v?bIdx=7"), (3, "k@K", "서울", "", "2026-09-30", "3", "https://a/#void"),
    (4, "k@K", "부산", "", "2026-09-30", "4", "https://a/#void"), (5, "k@K", "서울", "", "2026-09-30", "8", "https://a/v?bIdx=8"), (6, "other@K", "", "", None, "1", "https://a/#void"), (7, "k@K", "", "", None, "x", ""),
]


@query(expected_groups("id int, keeper int", [(2, 1), (3, 1)], ("id", "keeper")))
def duplicate_rule_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.rule_c(_groups(spark, sf_dir, "id int, title_key string, subjects string, rounds string, deadline string, source_id string, url string", STORED), ["bIdx"])


CUES = [(1, "공고 (~@V)", ""), (2, "접수 9월 16일", "x@K"), (3, "공고", "신청은 9/16(수) 끝"), (4, "1/2 수준", "접수기간 안내"), (5, "공고", None), (6, "오늘까지", "2026-09-01")]


@query(expected("id int, cue string", [(1, "~@V"), (2, "9월 16일"), (3, "9/16(수)"), (4, "접수기간"), (5, None), (6, "까지")], CUES))
def deadline_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir, "id int, t string, s string", CUES).select("id", upkeep.deadline_cue(F.col("t"), F.col("s")).alias("cue"))


RAWS = [(1, '{"url":"https://a","body":"본문 @K","kept":"x@I","note":"old"}'), (2, '{"note":"old"}'), (3, "broken")]


@query(expected("id int, body string, kept string, note string, page string", [(1, "본문 @K", "x@I", None, "u2"), (2, "", None, None, "u2"), (3, "", None, None, "u2")], RAWS))
def evidence_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, sf_dir, "id int, raw string", RAWS)
    raw = upkeep.replaced_evidence(F.col("raw"), F.create_map(F.lit("page"), F.lit("u2"), F.lit("note"), F.lit("")), ["note", "page"])
    read = lambda k: F.get_json_object("new", f"$.{k}")
    out = rows.withColumn("new", raw)
    return out.select("id", F.when(F.col("id") % 3 == 0, F.split(upkeep.string_values(F.col("raw")), "\n")[0]).otherwise("").alias("body"), read("kept").alias("kept"), read("note").alias("note"), read("page").alias("page"))


PERIODS = [(1, "@I", "@J", '{"q":"old","z":"@K"}', "t0"), (2, "@I", None, '{"q":"same"}', "t0"), (3, None, None, "{}", "t0")]
FETCHED = [(1, None, "", '{"q":""}'), (2, "@I", "", '{"q":"same","w":"2"}')]


@query(expected("id int, period_start string, period_end string, raw_data string, updated_at string", [(1, None, None, '{"z":"@K"}', "t1"), (2, "@I", None, '{"q":"same"}', "t0"), (3, None, None, "{}", "t0")], PERIODS))
def periods_overwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _cases(spark, sf_dir, "id int, period_start string, period_end string, raw_data string, updated_at string", PERIODS)
    return upkeep.overwrite_periods(stored, _cases(spark, sf_dir, "id int, period_start string, period_end string, raw_data string", FETCHED, len(PERIODS)), ["id"], ["q"], F.lit("t1"))


OLD = [(1, "seis", "@K", 0, "@I", "@J", '{"q":"x","z":"1"}', "t0"), (2, "seis", "fnc:123", 0, "2026-01-01", None, "{}", "t0"), (3, "coop", "5", 0, None, None, "{}", "t0"), (4, "seis", "9", 1, "2026-01-01", None, "{}", "t0")]


@query(expected("id int, source string, source_id string, legacy int, period_start string, period_end string, raw_data string, updated_at string", [(1, "seis", "@K", 1, None, None, '{"z":"1"}', "t1"), *OLD[1:]], OLD))
def legacy_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, sf_dir, "id int, source string, source_id string, legacy int, period_start string, period_end string, raw_data string, updated_at string", OLD)
    return upkeep.mark_legacy(rows, ["q"], F.lit("t1"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'later' END AS repaired FROM orders WHERE o_orderstatus = 'F'")
def fake_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("day").alias("deadline"), F.when(F.col("o_orderstatus") == "F", "day").otherwise("other").alias("posted"), F.when(F.col("o_orderkey") % 2 == 0, "later").otherwise("day").alias("evidence"))
    return upkeep.fake_deadlines(orders, "deadline", ["posted"], "evidence").select("o_orderkey", "repaired")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 <> 0")
def fake_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("day").alias("start"), F.when(F.col("o_orderstatus") == "F", "day").alias("posted"), F.when(F.col("o_orderkey") % 3 == 0, "접수 기간 안내").alias("body"))
    return upkeep.fake_starts(orders, "start", "posted", "body").select("o_orderkey")


HELD = [(1, "held", [9], [1, 2], [2, 3], "a@K", True), (2, "sent", None, [4], None, "a@K", True), (3, "draft", None, [5], None, "a@K", False)]


@query(expected("id int, status string, queue string, previews int, approval string", [(1, "expired", "9|1|2|3", 0, None), (2, "sent", "", 1, "a@K"), (3, "draft", "", 1, "a@K")], HELD))
def issues_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, sf_dir, "id int, status string, superseded_ids array<bigint>, preview_ids array<bigint>, notice_ids array<bigint>, approval string, newer boolean", HELD)
    out = upkeep.expire_issues(rows, F.col("newer"))
    return out.select("id", "status", F.coalesce(F.array_join(F.col("superseded_ids").cast("array<string>"), "|"), F.lit("")).alias("queue"), F.size("preview_ids").alias("previews"), "approval")


STATES = [(1, '{"status":"held","tries":2,"odd":1}'), (2, None), (3, '{"pins":[@K]}')]


@query(expected("id int, status string, tries int, pins string", [(1, "held", 2, ""), (2, "draft", 0, ""), (3, "draft", 0, "@K")], STATES))
def states_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, sf_dir, "id int, raw string", STATES)
    s = upkeep.normalised_state(F.col("raw"), "status string, tries int, pins array<int>", {"status": F.lit("draft"), "tries": F.lit(0), "pins": F.array().cast("array<int>")})
    return rows.select("id", s.alias("s")).select("id", "s.status", "s.tries", F.array_join(F.col("s.pins").cast("array<string>"), ",").alias("pins"))


WEATHER = [(1, '{"daily":{"day":["@I","@J"],"high":[12.5,null],"code":[0,61]}}')]


@query(expected("id int, day string, high double, code int, label string", [(1, "@I", 12.5, 0, "맑음"), (1, "@J", None, 61, "비")], WEATHER))
def weather_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _cases(spark, sf_dir, "id int, raw string", WEATHER)
    rows = raw.select("id", F.inline(upkeep.weather_rows(F.col("raw"), {"day": "string", "high": "double", "code": "int"})))
    return rows.withColumn("label", lookups.display_name(F.col("code").cast("string"), {"0": "맑음", "61": "비"}))


LONG = [(1, "가나다 라마바 @K / 차카타 파하 ○ 둘째 항목, 셋째 항목입니다. 짧은 문장.")]


# The number goes on in the first unit while that has at most 12 characters; a longer one is a unit of its own.
@query(f"""
WITH o AS (SELECT k, CAST(k AS VARCHAR) AS n FROM ({_ORDERS})),
u AS (SELECT k, CASE WHEN length('가나다 라마바 ' || n) <= 12 THEN ['가나다 라마바 ' || n] ELSE ['가나다 라마바', n] END || ['차카타 파하', '○ 둘째 항목', '셋째 항목입니다.', '짧은 문장.'] AS units FROM o)
SELECT k AS id, CAST(unnest(range(len(units))) AS INT) AS pos, unnest(units) AS unit FROM u""")
def candidate_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir, "id int, t string", LONG).select("id", F.posexplode(sentence_ops.candidate_units(F.col("t"), 12)).alias("pos", "unit"))


SAID = [(1, "첫 문장. 둘째 @K", "요약 문장."), (2, None, "")]


@query(expected("id int, pos int, sentence string", [(1, 0, "첫 문장."), (1, 1, "둘째 @K"), (1, 2, "요약 문장.")], SAID))
def evidence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_ops.evidence_sentences(_cases(spark, sf_dir, "id int, title string, summary string", SAID), "id", "title", "summary")


DIGEST = [(1, "# 주간\n머리말\n## 신청하세요\n- [D-9] 제목 하나 — 설명 (원문: https://a/1)\n<!-- 보류 -->\n## 알아두세요\n- [새 소식] 둘 @K")]


@query(expected("id int, pos int, section string, kind string, label string, title string, url string", [
    (1, 0, "주간", "section", None, None, None), (1, 1, "주간", "prose", None, None, None), (1, 2, "신청하세요", "section", None, None, None), (1, 4, "신청하세요", "comment", None, None, None),
    (1, 5, "알아두세요", "section", None, None, None), (1, 6, "알아두세요", "item", "새 소식", "둘 @K", None),
], DIGEST))
def digest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = sentence_ops.digest_blocks(_cases(spark, sf_dir, "id int, text string", DIGEST), "id", "text")
    return sentence_ops.prune_dead(blocks, F.broadcast(spark.createDataFrame([("https://a/1",)], "url string")), "id", "url")  # one row


def digest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announcements of a week in April 2026, one for each document, with a title of some kinds, repeated now and then."""
    n = "(n_chars + doc_id)"
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id as id",
        f"case {n} % 4 when 0 then 'lawmaking' when 1 then 'kofpi' when 2 then 'media' else 'fowi' end as source",
        f"case {n} % 5 when 0 then '산지관리법 개정 입법예고 ' when 1 then '산림 이야기 ' else '산림 기업 지원사업 모집 ' end || (doc_id div 3) as title",
        "'' as summary", "'https://a/' || doc_id as url", "cast(null as string) as period_start",
        f"case when {n} % 3 > 0 then date_format(date_add(date'2026-04-05', cast({n} % 40 as int)), 'yyyy-MM-dd') end as period_end",
        f"date_format(date_add(date'2026-04-06', cast({n} % 9 as int)), 'yyyy-MM-dd') || 'T09:00:00' as created_at", "'{}' as raw_data",
    )


@query()
def digest_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = digest.compose(digest_rows(spark, sf_dir), "2026-04-06", "2026-04-12", "2026-04-10")
    return out.select("id", "section", "position", "label", "outcome")


@query()
def digest_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.markdown(digest.compose(digest_rows(spark, sf_dir), "2026-04-06", "2026-04-12", "2026-04-10"))


PLANNED = [(1, "s", "11", "k@K", "", "", "2026-09-30", 5, None), (2, "s", "12", "k@K", "", "", "2026-09-30", 9, None), (3, "s", "13", "m@K", "", "", None, 1, "14x@K"), (4, "s", "14x@K", "n@K", "", "", None, 2, None), (5, "s", "15", "z@K", "", "", None, 1, None)]


@query(expected_groups("id int, keeper int, rule string", [(1, 2, "B"), (4, 3, "A")], ("id", "keeper")))
def duplicate_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _groups(spark, sf_dir, "id int, source string, source_id string, title_key string, subjects string, rounds string, deadline string, rank int, merged_id string", PLANNED)
    plan = linkage.plan_duplicates(rows.drop("merged_id"), rows.where("merged_id is not null").select("id", "merged_id"))
    broken = linkage.plan_violations(plan, rows).select("id")
    return plan.join(broken, "id", "left_anti").select("id", "keeper", "rule")
