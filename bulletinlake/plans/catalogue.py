"""Every registered query of the library outside the optional subpackage, with its SQL.

Each query takes (spark, sf_dir), reads whole tables and applies an operator of the library to
them; ``ORACLE_SQL`` has DuckDB SQL with the same columns and rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, text
from ..operators import linkage, merge, ranking, reconcile, reports, scoring, vectors
from ..operators import sentences as sentence_ops
from ..session import table, work_dir
from ..sources import html
from ..streaming import ingest

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Vocabularies of the driver tables' languages, as parameters of the scoring queries.
MUST = ("the", "und", "les", "que")
BOOST = {"thing": 1.0, "ation": 0.5, "keit": 1.5, "eau": 1.0, "ción": 2.0}
EXCLUDE = ("worthless", "licensed under")
DOMAINS = {
    "alpha": {"primary": ["the", "and"], "secondary": ["ation", "er"]},
    "beta": {"primary": ["und", "keit"], "secondary": ["ein", "ch"]},
    "gamma": {"primary": ["les", "eau"], "secondary": ["que", "ment"]},
    "delta": {"primary": ["los", "ción"], "secondary": ["que", "ar"]},
}


def _matches(word: str, column: str) -> str:
    """SQL for a keyword match: short words need a boundary."""
    if len(word) <= 3:
        return f"regexp_matches({column}, '(^|[^a-z0-9]){word}([^a-z0-9]|$)')"
    return f"contains({column}, '{word}')"


def _domain_sql(name: str) -> str:
    words = DOMAINS[name]
    total = 2 * len(words["primary"]) + len(words["secondary"])
    parts = [f"{n} * CAST({_matches(w, 't')} AS INT)" for key, n in (("primary", 2), ("secondary", 1)) for w in words[key]]
    return f"({' + '.join(parts)}) / {float(total)}"


# Ranking


TOPK_SQL = """
WITH base AS ({base}),
pin AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rn FROM base WHERE pinned),
taken AS (SELECT source, count(*) AS pc FROM pin WHERE rn <= {cap} GROUP BY source),
room AS (SELECT {cap} - count(*) AS room FROM pin WHERE rn <= {cap}),
reg AS (
  SELECT b.doc_id, b.source, b.n_chars, row_number() OVER (PARTITION BY b.source ORDER BY n_chars DESC, doc_id) + coalesce(pc, 0) <= {per} AS el
  FROM base b LEFT JOIN taken t ON b.source = t.source WHERE NOT pinned),
cnt AS (
  SELECT *, coalesce(sum(CAST(el AS INT)) OVER (ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS eb FROM reg)
SELECT doc_id, source, n_chars, el AND eb < (SELECT room FROM room) AS selected,
  CASE WHEN eb >= (SELECT room FROM room) THEN 'cap' WHEN el THEN 'selected' ELSE 'diversity' END AS reason FROM cnt
UNION ALL
SELECT doc_id, source, n_chars, rn <= {cap}, CASE WHEN rn <= {cap} THEN 'selected' ELSE 'pin_cap' END FROM pin
"""
ORDER = [("n_chars", True), ("doc_id", False)]


@query(TOPK_SQL.format(base="SELECT doc_id, source, n_chars, FALSE AS pinned FROM documents", cap=25, per=2))
def diversity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return ranking.capped_topk(docs, "doc_id", "source", ORDER, 25, 2)


PINNED = "SELECT d.doc_id, d.source, d.n_chars, coalesce(l.quality = 0 AND l.toxic = 1, FALSE) AS pinned FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def _pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.expr("quality = 0 and toxic = 1").alias("pinned"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return docs.join(labels, "doc_id", "left").withColumn("pinned", F.coalesce("pinned", F.lit(False)))


@query(TOPK_SQL.format(base=PINNED, cap=40, per=2))
def diversity_topk_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.capped_topk(_pinned(spark, sf_dir), "doc_id", "source", ORDER, 40, 2, "pinned").drop("pinned")


@query(
    f"""WITH a AS ({TOPK_SQL.format(base="SELECT doc_id, source, n_chars, FALSE AS pinned FROM documents", cap=40, per=2)}),
b AS ({TOPK_SQL.format(base=PINNED, cap=40, per=2)})
SELECT doc_id FROM a WHERE selected AND doc_id NOT IN (SELECT doc_id FROM b WHERE selected)"""
)
def pin_demotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.demoted_by_pins(_pinned(spark, sf_dir), "doc_id", "source", ORDER, 40, 2, "pinned")


@query()
def monthly_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", F.expr("case pmod(n_chars, 4) when 0 then 'a' when 1 then 'b' when 2 then 'c' else 'd' end").alias("rule"))
    return ranking.round_robin(docs, "lang", "rule", "source", "doc_id", ORDER, ["a", "b", "c"], 12, 2)


@query(
    """WITH last AS (SELECT user_id, max(ts) AS stamp FROM events WHERE event_type = 'purchase' GROUP BY user_id),
c AS (SELECT DISTINCT user_id FROM events)
SELECT c.user_id, CAST(row_number() OVER (ORDER BY coalesce(strftime(stamp, '%Y-%m-%d %H:%M:%S'), ''), c.user_id) AS INT) AS turn
FROM c LEFT JOIN last ON c.user_id = last.user_id QUALIFY turn <= 25"""
)
def fair_rotation_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    prior = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("stamp"))
    candidates = events.select("user_id").distinct().withColumn("pos", F.lit(0))
    return ranking.fair_rotation(candidates, prior, "user_id", "stamp", "pos", 25).select("user_id", "turn")


@query(
    """WITH RECURSIVE days AS (SELECT DISTINCT event_type, CAST(ts AS DATE) AS day FROM events),
kept AS (
  SELECT event_type, min(day) AS day FROM days GROUP BY event_type
  UNION
  SELECT k.event_type, (SELECT min(d.day) FROM days d WHERE d.event_type = k.event_type AND d.day >= k.day + 2) FROM kept k WHERE k.day IS NOT NULL)
SELECT event_type, day FROM kept WHERE day IS NOT NULL"""
)
def gap_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.gap_select(table(spark, sf_dir, "events").select("event_type", F.col("ts").alias("day")), "event_type", "day", 2)


@query(
    """SELECT doc_id, lang FROM (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('0:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents) WHERE rn <= 20"""
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 20)


@query("SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 30")
def bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.bounded_history(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", [F.desc("ts"), F.desc("event_id")], 30)


# Filters and sorts


@query(
    """SELECT o_orderkey, o_totalprice, o_orderdate FROM orders
WHERE o_orderstatus = 'O' AND coalesce(o_orderpriority, '1') <> '5-LOW' AND (o_orderdate IS NULL OR o_orderdate >= TIMESTAMP '1996-01-01')
ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey LIMIT 100"""
)
def unnotified_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    open_now = (F.col("o_orderstatus") == "O") & (F.coalesce("o_orderpriority", F.lit("1")) != "5-LOW") & (F.col("o_orderdate").isNull() | (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")))
    return orders.where(open_now).select("o_orderkey", "o_totalprice", "o_orderdate").orderBy(F.desc("o_totalprice"), F.desc("o_orderdate"), "o_orderkey").limit(100)


@query(
    """SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS priority FROM orders
ORDER BY nullif(o_orderpriority, '1-URGENT') IS NULL, nullif(o_orderpriority, '1-URGENT'), o_orderdate DESC, o_orderkey LIMIT 50"""
)
def nulls_last_sort_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("priority", F.nullif("o_orderpriority", F.lit("1-URGENT")))
    return orders.orderBy(F.asc_nulls_last("priority"), F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "priority").limit(50)


@query("SELECT doc_id, source, n_chars FROM documents WHERE text ILIKE '%ation%' ORDER BY n_chars DESC, doc_id LIMIT 20")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("text").ilike("%ation%"))
    return docs.select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE props LIKE '%\"k\"%' AND coalesce(json_extract_string(props, '$.k'), '') NOT IN ('', '0')")
def json_key_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "events").select("event_id", F.try_element_at(text.json_map(F.col("props")), F.lit("k")).alias("k"))
    return found.where(F.coalesce("k", F.lit("")).isin("", "0") == F.lit(False))


@query("SELECT event_id, CASE WHEN json_extract_string(props, '$.k') <> '' THEN 1 ELSE 0 END AS n_kept, json_extract_string(props, '$.k') AS k FROM events")
def json_submap(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = text.json_submap(F.col("props"), prefix="k")
    return table(spark, sf_dir, "events").select("event_id", F.size(F.map_keys(kept)).alias("n_kept"), F.try_element_at(kept, F.lit("k")).alias("k"))


@query(
    """SELECT event_id, CAST(ts + INTERVAL 9 HOUR AS DATE) AS kst_day FROM events
WHERE CAST(ts + INTERVAL 9 HOUR AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'"""
)
def kst_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a wide range that the scan can use comes first, the exact day by Korean time after it
    near = table(spark, sf_dir, "events").where("ts >= timestamp_ntz'2024-01-07' and ts < timestamp_ntz'2024-01-16'")
    day = dates.kst_date(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    return near.select("event_id", day.alias("kst_day")).where("kst_day between date'2024-01-08' and date'2024-01-14'")


@query(
    """SELECT strftime(CAST(ts AS DATE), '%G-W%V') AS week, event_type, count(*) AS n, round(sum(value), 3) AS amount FROM events GROUP BY 1, 2"""
)
def iso_week_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("week", dates.week_key(F.to_date("ts")))
    return events.groupBy("week", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("amount"))


# Counts


@query("SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'purchase') AS notified, count(*) - count(*) FILTER (WHERE event_type = 'purchase') AS unnotified FROM events")
def stats_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.overview(table(spark, sf_dir, "events"), F.col("event_type") == "purchase")


@query("SELECT source, count(*) AS cnt FROM documents GROUP BY source ORDER BY cnt DESC, source")
def count_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.count_by(table(spark, sf_dir, "documents"), "source").orderBy(F.desc("cnt"), "source")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS cnt FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 12")
def count_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.count_by_month(table(spark, sf_dir, "orders"), "o_orderdate")


@query(
    """SELECT source, count(*) AS total, count(*) FILTER (WHERE quality = 1) AS matched, count(*) FILTER (WHERE quality = 0) AS unmatched, count(*) FILTER (WHERE quality IS NULL) AS unmeasured
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source"""
)
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return reports.conditional_counts(docs.join(table(spark, sf_dir, "labels"), "doc_id", "left"), "source", "quality")


@query(
    """SELECT count(*) AS total, count(*) FILTER (WHERE value >= 70) AS high, count(*) FILTER (WHERE value >= 30 AND value < 70) AS medium, count(*) FILTER (WHERE value < 30) AS low,
round(coalesce(avg(value), 0), 3) AS average FROM events"""
)
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.score_bands(table(spark, sf_dir, "events"), "value", 70, 30)


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
recent AS (SELECT user_id, count(*) AS runs, count(*) FILTER (WHERE event_type = 'purchase') AS ok_runs, round(sum(value), 3) AS amount FROM r WHERE rn <= 7 GROUP BY user_id),
ever AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN ts END) AS last_ok FROM events GROUP BY user_id)
SELECT recent.user_id, runs, ok_runs, amount, last_ok, CASE WHEN last_ok IS NULL THEN 'unreachable' WHEN ok_runs = 0 THEN 'parse_fail'
  WHEN date_diff('day', CAST(last_ok AS DATE), DATE '2024-01-31') >= 14 THEN 'stale' ELSE 'ok' END AS verdict
FROM recent JOIN ever ON recent.user_id = ever.user_id"""
)
def last_n_runs_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    health = reports.run_health(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.col("event_type") == "purchase", "value")
    status = F.when(F.col("last_ok").isNotNull(), 200)
    verdict = scoring.health_verdict(status, F.lit(None).cast("string"), F.col("ok_runs"), F.to_date("last_ok"), F.lit("2024-01-31").cast("date"), F.lit(1), 14)
    return health.withColumn("verdict", verdict["verdict"])


@query(
    """WITH o AS (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY o_custkey)
SELECT coalesce(c_custkey, o_custkey) AS custkey, c_mktsegment, coalesce(n_orders, 0) AS n_orders, coalesce(amount, 0.0) AS amount,
CASE WHEN c_custkey IS NULL THEN 'unregistered' WHEN o_custkey IS NULL THEN 'silent' ELSE 'seen' END AS status
FROM customer FULL OUTER JOIN o ON c_custkey = o_custkey"""
)
def registry_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("amount"))
    registry = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_mktsegment")
    return reports.coverage(registry, observed, "custkey", ["n_orders", "amount"])


@query(
    """SELECT CASE WHEN grouping(l_returnflag) = 1 THEN '(total)' ELSE l_returnflag END AS l_returnflag, count(*) AS lines, round(sum(l_quantity), 2) AS quantity
FROM lineitem GROUP BY ROLLUP (l_returnflag)"""
)
def rollup_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.with_total(table(spark, sf_dir, "lineitem"), "l_returnflag", "(total)", lines=F.count("*"), quantity=F.round(F.sum("l_quantity"), 2))


@query("SELECT source, count(DISTINCT text) AS titles, count(*) AS rows FROM documents GROUP BY source")
def distinct_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a digest is counted instead of the text, so hashes travel and not texts
    docs = table(spark, sf_dir, "documents").select("source", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return docs.groupBy("source").agg(F.countDistinct("digest").alias("titles"), F.count("*").alias("rows"))


@query("SELECT o_orderpriority, count(*) AS n, 200 AS cap FROM orders GROUP BY o_orderpriority HAVING count(*) > 200")
def cap_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = reports.count_by(table(spark, sf_dir, "orders"), "o_orderpriority", name="n")
    return reports.cap_violations(counts, "o_orderpriority", "n", {p: 200 for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")})


@query(
    """SELECT user_id, list(event_id ORDER BY ts, event_id) AS ids_list FROM events GROUP BY user_id""".replace("list(event_id ORDER BY ts, event_id) AS ids_list", "string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS ids")
)
def ordered_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("pos", F.struct("ts", "event_id"))
    return reports.ordered_list(events, "user_id", "pos", "event_id", "ids").select("user_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


# Identity and merges


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-01 06:00:00')")
def new_vs_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    fresh, stored = events.where("ts >= timestamp_ntz'2024-01-20'"), events.where("ts < timestamp_ntz'2024-01-01 06:00:00'")
    return linkage.new_rows(fresh, stored, ["user_id"]).select("event_id", "user_id")


@query(
    """SELECT d.doc_id, CASE WHEN quality IS NULL THEN 'dropped' WHEN quality = 1 THEN 'selected' ELSE 'extra' END AS outcome,
CASE WHEN quality = 1 THEN 0 WHEN quality = 0 THEN 1 END AS council_only FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def profile_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    q = F.col("quality")
    return joined.select("doc_id", F.when(q.isNull(), "dropped").when(q == 1, "selected").otherwise("extra").alias("outcome"), F.when(q == 1, 0).when(q == 0, 1).alias("council_only"))


KEY_SQL = r"regexp_replace(text, '\s', '', 'g')"


@query(
    f"""WITH k AS (SELECT doc_id, source, lang, n_chars, md5({KEY_SQL}) AS key FROM documents),
f AS (SELECT *, first_value(lang) OVER w AS fl, first_value(source) OVER w AS fs FROM k WINDOW w AS (PARTITION BY key ORDER BY doc_id)),
g AS (SELECT *, CASE WHEN lang = fl AND source = fs THEN NULL ELSE doc_id END AS alone FROM f)
SELECT min(doc_id) AS doc_id, CAST(count(*) AS INT) AS n_merged, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS merged FROM g GROUP BY key, alone"""
)
def dedupe_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    keyed = docs.select("doc_id", "source", "lang", F.md5(F.regexp_replace("text", r"\s", "").cast("binary")).alias("key"))
    out = linkage.merge_same(keyed, ["key"], ["lang", "source"], "doc_id", "doc_id")
    return out.select("doc_id", "n_merged", F.array_join(F.col("merged_ids").cast("array<string>"), ",").alias("merged"))


@query(
    """SELECT l_orderkey, l_linenumber, n_rows FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_quantity DESC, l_linenumber) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n_rows FROM lineitem) WHERE rn = 1"""
)
def canonical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.canonical(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.col("l_extendedprice"), F.col("l_quantity")], "l_linenumber")


@query(
    """WITH old AS (SELECT o_orderkey, o_totalprice AS score, o_orderpriority AS tags, 1 AS only_flag FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' OR o_orderdate IS NULL),
inc AS (SELECT o_orderkey, o_totalprice * 2 AS score, CASE WHEN o_orderstatus = 'F' THEN 'new' END AS tags,
  CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS only_flag FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01')
SELECT coalesce(o.o_orderkey, i.o_orderkey) AS o_orderkey, coalesce(i.score, o.score) AS score, coalesce(i.tags, o.tags) AS tags,
  CASE WHEN o.o_orderkey IS NULL THEN i.only_flag WHEN i.only_flag = 0 THEN 0 ELSE o.only_flag END AS only_flag
FROM old o FULL OUTER JOIN inc i ON o.o_orderkey = i.o_orderkey"""
)
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the stored and the incoming rows overlap in three years, and each order is in at least one of them
    orders = table(spark, sf_dir, "orders")
    old = orders.where("o_orderdate < timestamp_ntz'1997-01-01' or o_orderdate is null").select("o_orderkey", F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("tags"), F.lit(1).alias("only_flag"))
    new = orders.where("o_orderdate >= timestamp_ntz'1994-01-01'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("score"), F.when(F.col("o_orderstatus") == "F", "new").alias("tags"), F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("only_flag"))
    return merge.upsert(old, new, ["o_orderkey"], ["score"], ["tags"], ["only_flag"])


@query("SELECT user_id, max(ts) AS seen_at, count(*) AS n FROM events GROUP BY user_id HAVING max(ts) >= TIMESTAMP '2024-01-31' - INTERVAL 8 HOUR")
def ttl_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("seen_at"), F.count("*").alias("n"))
    return merge.expire(seen, "seen_at", F.expr("timestamp_ntz'2024-01-31' - interval 8 hours"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderdate END AS o_orderdate FROM orders")
def null_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.null_except(table(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"], ["o_orderdate"]).select("o_orderkey", "o_orderdate")


@query(
    """SELECT event_id, CAST(json_object('k', coalesce(json_extract_string(props, '$.k'), ''), 'quote', event_type) AS VARCHAR) AS raw FROM events
WHERE event_type <> 'purchase' UNION ALL SELECT event_id, CAST(json_object('quote', event_type) AS VARCHAR) FROM events WHERE event_type = 'purchase'"""
)
def evidence_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("raw_data"), "event_type")
    empty = F.when(F.col("event_type") == "purchase", F.lit("{}")).otherwise(F.col("raw_data"))
    patches = events.select("event_id", F.create_map(F.lit("quote"), F.col("event_type"), F.lit("other"), F.lit("x")).alias("patch"))
    patched = merge.patch_evidence(events.withColumn("raw_data", empty), patches, ["event_id"], ["quote"])
    return patched.select("event_id", F.col("raw_data").alias("raw"))


# Text


@query("SELECT doc_id, sha256(coalesce(text, '') || chr(0) || coalesce(lang, '') || chr(0) || coalesce(source, '')) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text"), F.col("lang"), F.col("source")).alias("content_hash"))


@query(
    rf"""SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '{text.EMAIL}', '[email]', 'g'), '{text.PHONE}', '[phone]', 'g')) AS masked,
len(regexp_extract_all(text, '{text.EMAIL}')) AS emails FROM documents"""
)
def contact_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = F.sha2(text.mask_contacts(F.col("text")).cast("binary"), 256)
    return table(spark, sf_dir, "documents").select("doc_id", masked.alias("masked"), F.regexp_count("text", F.lit(text.EMAIL)).cast("long").alias("emails"))


@query(
    r"""SELECT doc_id, md5(regexp_replace(text, '[ \t\n\r]', '', 'g')) AS merge_key,
md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '\d{1,4}\s*[.\-/]\s*\d{1,2}(?:\s*[.\-/]\s*\d{1,2})?\.?', ' ', 'g'), '[^0-9A-Za-z\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS dedup_key FROM documents"""
)
def title_key_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the Latin form of the keys: the tables hold no Hangul, whose classes SQL can't tell
    no_dates = F.regexp_replace("text", r"\d{1,4}\s*[.\-/]\s*\d{1,2}(?:\s*[.\-/]\s*\d{1,2})?\.?", " ")
    dedup = F.trim(F.regexp_replace(F.regexp_replace(no_dates, r"[^0-9A-Za-z\s]", " "), r"\s+", " "))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.regexp_replace("text", r"[ \t\n\r]", "").cast("binary")).alias("merge_key"), F.md5(dedup.cast("binary")).alias("dedup_key"))


ID_PATTERNS = (r"[?&](?:nttId|idxno|bIdx|page)=(\d+)", r"/(\d{3,})(?:[/?#.]|$)")


@query(
    f"""SELECT page_id, coalesce(nullif(regexp_extract(url, '{ID_PATTERNS[0]}', 1), ''), nullif(regexp_extract(url, '{ID_PATTERNS[1]}', 1), ''), substr(md5(url), 1, 16)) AS source_id FROM pages"""
)
def url_id_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.id_from_url(F.col("url"), ID_PATTERNS).alias("source_id"))


@query(
    f"""WITH t AS (SELECT doc_id, lower(text || ' ' || lang || ' ' || source) AS t FROM documents),
h AS (SELECT doc_id, [w FOR w IN {list(EXCLUDE)} IF contains(t, w)] AS ex, [w FOR w IN {list(MUST)} IF contains(t, w)] AS must,
 [w FOR w IN {list(BOOST)} IF contains(t, w)] AS boost, {' + '.join(f"CASE WHEN contains(t, '{w}') THEN {0.05 * v!r}::DOUBLE ELSE 0 END" for w, v in BOOST.items())} AS gain FROM t)
SELECT doc_id, CASE WHEN len(ex) > 0 THEN 0.0::DOUBLE ELSE round(least(least(gain, 0.5) + CASE WHEN len(must) > 0 THEN 0.5 ELSE 0 END, 1.0), 6)::DOUBLE END AS score,
 CASE WHEN len(ex) > 0 THEN ex[1] ELSE array_to_string(list_concat(must, boost), ',') END AS matched FROM h"""
)
def keyword_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = docs.select("doc_id", scoring.keyword_relevance([F.col("text"), F.col("lang"), F.col("source")], MUST, BOOST, EXCLUDE).alias("r"))
    return scored.select("doc_id", F.round("r.score", 6).alias("score"), F.array_join("r.matched", ",").alias("matched"))


@query(
    r"""WITH t AS (SELECT doc_id, ' ' || array_to_string([w FOR w IN string_split_regex(lower(translate(text, '()[]{}（）［］【】「」『』<>〈〉《》.,·:;!?/|~"''“”‘’…-', repeat(' ', 42))), '\s+') IF w <> ''], ' ') || ' ' AS s FROM documents)
SELECT doc_id, contains(s, ' of the ') AS has_phrase, contains(s, ' worthless ') AS has_word FROM t"""
)
def token_exclude_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", text.council_tokens(F.col("text")).alias("tokens"))
    wanted = lambda s: F.array(*[F.lit(w) for w in s.split()])
    return found.select("doc_id", text.token_sequence_in(F.col("tokens"), wanted("of the")).alias("has_phrase"), text.token_sequence_in(F.col("tokens"), wanted("worthless")).alias("has_word"))


@query(
    f"""WITH t AS (SELECT doc_id, lower(text) AS t FROM documents),
s AS (SELECT doc_id, {', '.join(f'{_domain_sql(d)} AS {d}' for d in DOMAINS)} FROM t),
b AS (SELECT *, greatest({', '.join(DOMAINS)}) AS best FROM s)
SELECT doc_id, CASE WHEN best <= 0 THEN '' {' '.join(f"WHEN {d} = best THEN '{d}'" for d in DOMAINS)} END AS domain, CAST(round(greatest(best, 0), 6) AS DOUBLE) AS confidence FROM b"""
)
def domain_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = table(spark, sf_dir, "documents").select("doc_id", scoring.best_domain(F.col("text"), DOMAINS).alias("d"))
    return best.select("doc_id", "d.domain", F.round("d.confidence", 6).alias("confidence"))


@query(
    f"""WITH t AS (SELECT doc_id, lower(text) AS t FROM documents),
s AS ({' UNION ALL '.join(f"SELECT doc_id, {i} AS ord, '{d}' AS domain, CAST(round({_domain_sql(d)}, 6) AS DOUBLE) AS score FROM t" for i, d in enumerate(DOMAINS))})
SELECT doc_id, domain, score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS INT) AS place FROM s WHERE score > 0"""
)
def domain_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(scoring.all_domains(F.col("text"), DOMAINS)).alias("i", "d"))
    return found.select("doc_id", "d.domain", F.round("d.score", 6).alias("score"), (F.col("i") + 1).alias("place"))


@query(
    """SELECT doc_id, CASE WHEN source NOT IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7') THEN 'exclude' WHEN contains(text, '|') THEN 'hold' WHEN n_chars < 100 THEN 'hold'
WHEN contains(lower(text), 'licensed') THEN 'notice' ELSE 'apply' END AS verdict,
CASE WHEN source NOT IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7') THEN 'outside the pool' WHEN contains(text, '|') THEN 'table' WHEN n_chars < 100 THEN 'short'
WHEN contains(lower(text), 'licensed') THEN 'license' ELSE 'prose' END AS reason FROM documents"""
)
def verdict_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        ("exclude", ~F.col("source").isin(*[f"src{i}" for i in range(8)]), "outside the pool"),
        ("hold", F.contains("text", F.lit("|")), "table"),
        ("hold", F.col("n_chars") < 100, "short"),
        ("notice", F.contains(F.lower("text"), F.lit("licensed")), "license"),
    ]
    return table(spark, sf_dir, "documents").select("doc_id", scoring.decision_list(rules, ("apply", "prose")).alias("v")).select("doc_id", "v.verdict", "v.reason")


GRAMS_SQL = """WITH g AS (SELECT item_id, list_distinct([substr(text, i, 3) FOR i IN range(1, greatest(length(text) - 1, 2))]) AS g FROM benchmark WHERE length(text) > 0)"""


@query(
    GRAMS_SQL
    + """ SELECT a.item_id AS left_id, b.item_id AS right_id, round(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))), 6) AS similarity
FROM g a JOIN g b ON a.item_id < b.item_id WHERE len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) >= 0.3"""
)
def ngram_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = table(spark, sf_dir, "benchmark").select("item_id", text.ngrams(F.col("text")).alias("grams"))
    return linkage.similar_pairs(grams, "item_id", "grams", 0.3).withColumn("similarity", F.round("similarity", 6))


@query(
    GRAMS_SQL
    + """, p AS (SELECT a.item_id AS i FROM g a JOIN g b ON a.item_id <> b.item_id WHERE len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) >= 0.3)
SELECT item_id, count(p.i) AS n_similar FROM benchmark LEFT JOIN p ON item_id = p.i GROUP BY item_id"""
)
def similar_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", text.ngrams(F.col("text")).alias("grams"))
    return linkage.similar_counts(items, "item_id", "grams", 0.3)


# Vectors


@query(
    """SELECT vec_id, round(1 - list_inner_product(embedding::DOUBLE[], q.e) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(q.e, q.e))), 6) AS distance
FROM embeddings, (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 7) q WHERE vec_id <> 7 ORDER BY distance, vec_id LIMIT 10"""
)
def vector_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.similar_to_row(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 7, 10).select("vec_id", F.round("distance", 6).alias("distance"))


@query(
    """SELECT vec_id, round(list_distance(embedding::DOUBLE[], q.e), 6) AS distance
FROM embeddings, (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 7) q WHERE vec_id <> 7 ORDER BY distance, vec_id LIMIT 10"""
)
def vector_topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.similar_to_row(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 7, 10, "l2").select("vec_id", F.round("distance", 6).alias("distance"))


# Verification and state


@query(
    """WITH l AS (SELECT item_id AS id, count(*) AS n, first(length(text)) AS size FROM benchmark GROUP BY item_id),
r AS (SELECT doc_id AS id, count(*) AS n, first(n_chars) AS size FROM documents GROUP BY doc_id),
b AS (SELECT coalesce(l.id, r.id) AS id, l.n AS ln, r.n AS rn, l.size AS ls, r.size AS rs FROM l FULL OUTER JOIN r ON l.id = r.id)
SELECT id, 'missing' AS problem FROM b WHERE rn IS NULL UNION ALL SELECT id, 'extra' FROM b WHERE ln IS NULL
UNION ALL SELECT id, 'repeated' FROM b WHERE ln > 1 OR rn > 1 UNION ALL SELECT id, 'size differs' FROM b WHERE ln IS NOT NULL AND rn IS NOT NULL AND ls IS DISTINCT FROM rs"""
)
def manifest_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.length("text").cast("long").alias("size"))
    stored = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"))
    return reconcile.reconcile(manifest, stored, "id", ["size"])


@query(
    """SELECT o_orderkey, o_custkey, CASE WHEN top > o_orderkey THEN top END AS superseded_by FROM orders LEFT JOIN
(SELECT o_custkey AS c, max(o_orderkey) AS top FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) ON o_custkey = c"""
)
def issue_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return reconcile.newest_later(orders, "o_orderkey", F.col("o_orderstatus") == "O", "o_custkey").select("o_orderkey", "o_custkey", "superseded_by")


@query(
    """WITH e AS (SELECT DISTINCT l_orderkey AS b, l_linenumber AS n FROM lineitem), a AS (SELECT l_orderkey AS b, l_linenumber AS n FROM lineitem WHERE l_returnflag <> 'R'),
ec AS (SELECT b, count(*) AS ne FROM e GROUP BY b), ac AS (SELECT b, count(*) AS na, count(DISTINCT n) AS nd FROM a GROUP BY b),
h AS (SELECT e.b, count(*) AS nh FROM e WHERE EXISTS (SELECT 1 FROM a WHERE a.b = e.b AND a.n = e.n) GROUP BY e.b)
SELECT ec.b AS l_orderkey, coalesce(na, 0) = coalesce(nd, 0) AND coalesce(na, 0) = ne AND coalesce(nh, 0) = ne AS accepted FROM ec LEFT JOIN ac ON ec.b = ac.b LEFT JOIN h ON ec.b = h.b"""
)
def gate_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return reconcile.exact_batch(lines.select("l_orderkey", "l_linenumber").distinct(), lines.where("l_returnflag <> 'R'"), "l_orderkey", "l_linenumber")


@query(
    """SELECT o_orderkey, o_orderstatus AS from_status, lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS to_status,
coalesce(o_orderstatus || '>' || lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IN ('O>P', 'P>F', 'O>F'), FALSE) AS legal FROM orders"""
)
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    steps = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("from_status"), F.lead("o_orderstatus").over(order).alias("to_status"))
    return reconcile.transitions(steps, {"O": ["P", "F"], "P": ["F"]})


@query(
    """SELECT c_custkey, field FROM (SELECT c_custkey, unnest(['c_mktsegment', 'c_name']) AS field, unnest([c_mktsegment IS NULL OR c_mktsegment = '' , c_name IS NULL OR c_name = '']) AS bad FROM
(SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment, c_name FROM customer)) WHERE bad"""
)
def schema_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return reconcile.schema_problems(rows, "c_custkey", ["c_mktsegment", "c_name"])


# Pages, sentences and streams


@query()
def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", html.visible_text(F.col("html")).alias("text"))
    return found.select("page_id", "text", F.length("text").alias("n_chars"))


@query()
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_links(table(spark, sf_dir, "pages"), "page_id", "html")


@query()
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_ops.sentences(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@query()
def candidate_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return sentence_ops.candidates(docs, "doc_id", "text", "source", priority="ation|keit|eau|ción")


@query()
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(sentence_ops.chunks(F.col("text"))).alias("pos", "chunk"))


@query(
    """WITH RECURSIVE o AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS rn FROM lineitem),
b AS (SELECT l_orderkey, rn, s AS used, 0 AS batch FROM o WHERE rn = 1
  UNION ALL SELECT o.l_orderkey, o.rn, CASE WHEN b.used > 0 AND b.used + o.s > 60 THEN o.s ELSE b.used + o.s END, b.batch + CASE WHEN b.used > 0 AND b.used + o.s > 60 THEN 1 ELSE 0 END
  FROM b JOIN o ON o.l_orderkey = b.l_orderkey AND o.rn = b.rn + 1)
SELECT l_orderkey, CAST(count(DISTINCT batch) AS BIGINT) AS batches, max(used) AS fullest FROM b GROUP BY l_orderkey"""
)
def size_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"), F.col("l_quantity").cast("long").alias("size"))
    dealt = sentence_ops.batches_by_size(lines, "l_orderkey", "pos", "size", 60)
    sized = dealt.groupBy("l_orderkey", "batch").agg(F.sum("size").alias("used"))
    last = sized.groupBy("l_orderkey").agg(F.count("*").alias("batches"), F.max("used").alias("fullest"))
    return last


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    # as a pattern, the path may name one file as well as a folder of them
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "dedupe")
    first = ingest.dedupe(_events_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), ["user_id", "event_type"], "ts", "400 days")
    run = first.select("user_id", "event_type").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("user_id long, event_type string").parquet(f"{folder}/out")


@query(
    """SELECT user_id, arg_max(event_type, event_id) AS event_type, max(ts) FILTER (WHERE event_id = last) AS ts, CAST(min(CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END) AS INT) AS only_flag
FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS last FROM events) GROUP BY user_id"""
)
def stream_upsert_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "upsert")
    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("only_flag", T.IntegerType())])
    rows = _events_stream(spark, sf_dir).select("user_id", "event_type", "ts", "event_id", F.when(F.col("event_type") == "purchase", 0).otherwise(1).alias("only_flag"))
    sink = ingest.upsert_sink(f"{folder}/table", schema, ["user_id"], "event_id", ["event_type", "ts"], ratchet=["only_flag"])
    run = rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return ingest.latest(spark, f"{folder}/table", schema)


@query("SELECT CAST(date_trunc('week', ts + INTERVAL 9 HOUR) AS DATE) AS week_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_week_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "weeks")
    events = _events_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp") + F.expr("interval 9 hours"))  # Korean weeks
    counts = ingest.calendar_counts(events, "ts", ["event_type"], late="400 days")
    schema = counts.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/v={number}")

    run = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return ingest.latest(spark, folder, schema)
