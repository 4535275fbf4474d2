"""Queries of streams with state: each equals what a batch over the same table tells (its SQL)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import table, work_dir
from ..streaming import state
from .catalogue import _events_stream, query


def _run(out: DataFrame, folder: str) -> DataFrame:
    """The rows of a stream that goes through all there is, then ends."""
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{folder}/out")


def _in_batches(parts: Sequence[DataFrame], folder: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Each part is a micro-batch: the stream goes on from its checkpoint as often as one has been added."""
    spark = parts[0].sparkSession
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/rows")
        stream = spark.readStream.schema(part.schema).parquet(f"{folder}/rows")
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def _local(df: DataFrame) -> DataFrame:
    """Timestamps as they read in UTC, as the events' are."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else c for c, t in df.dtypes])


@query("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t FROM events), w AS (SELECT max(t) - 86400000 AS wm FROM e),
s AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) < 86400000 THEN 0 ELSE 1 END AS begins FROM e),
g AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS g FROM s)
SELECT user_id, make_timestamp_ms(min(t)) AS first_at, make_timestamp_ms(max(t)) AS last_at, make_timestamp_ms(max(t) + 86400000) AS expired_at, count(*) AS n
FROM g, w GROUP BY user_id, g, wm HAVING max(t) + 86400000 <= wm""")
def stream_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a user's events that ended as none came for a day, from event-time timers."""
    events = _events_stream(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return _local(_run(state.last_seen_spans(events, "user_id", "ts", days=1), work_dir(spark, "spans")))


@query("""
WITH e AS (SELECT user_id, event_type, epoch_us(ts) // 1000 AS t FROM events), w AS (SELECT max(t) - 86400000 AS wm FROM e),
s AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_type) AS known FROM e),
i AS (SELECT user_id, event_type, t AS t0, known, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_type) AS t1 FROM s WHERE known IS NULL OR known <> event_type),
d AS (SELECT user_id, event_type, t0, known, unnest(generate_series(t0, least(coalesce(t1, wm), wm), 86400000)) AS due FROM i, w)
SELECT user_id, event_type AS hash, make_timestamp_ms(due) AS due_at, CASE WHEN due > t0 THEN 'elapsed' WHEN known IS NULL THEN 'new' ELSE 'changed' END AS why FROM d""")
def stream_rechecks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a user's state is to be checked: as it is new or changed, and every day since, by timers that need no new row."""
    events = _events_stream(spark, sf_dir).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return _local(_run(state.rechecks(events, "user_id", "event_type", "ts", hours=24, keep_days=400), work_dir(spark, "rechecks")))


@query(
    """SELECT user_id, arg_max(event_type, event_id) AS event_type, max(ts) FILTER (WHERE event_id = last) AS ts, CAST(min(CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END) AS INT) AS only_flag
FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS last FROM events) GROUP BY user_id"""
)
def stream_bucketed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts of which each micro-batch rewrites only the buckets of its users."""
    folder = work_dir(spark, "buckets")
    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("only_flag", T.IntegerType())])
    rows = _events_stream(spark, sf_dir).select("user_id", "event_type", "ts", "event_id", F.when(F.col("event_type") == "purchase", 0).otherwise(1).alias("only_flag"))
    sink = state.bucketed_upsert_sink(f"{folder}/table", schema, ["user_id"], "event_id", ["event_type", "ts"], ratchet=["only_flag"])
    rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return state.bucketed(spark, f"{folder}/table", schema)


FIELDS = ("quote_deadline", "quote_eligibility", "quote_amount", "quote_period_end")


@query("""
WITH e AS (SELECT user_id, event_type, {'t': ts, 'i': event_id} AS s, event_type || ' ' || event_id AS v, CAST(floor(value) AS BIGINT) AS n FROM events),
f AS (SELECT user_id,
  max(s) FILTER (WHERE event_type = 'view') AS d_at, arg_max(v, s) FILTER (WHERE event_type = 'view') AS quote_deadline,
  arg_max(v, s) FILTER (WHERE event_type = 'click') AS quote_eligibility,
  arg_max(v, s) FILTER (WHERE event_type NOT IN ('view', 'click')) AS quote_amount,
  max(s) FILTER (WHERE n % 3 = 0) AS p_at, arg_max(CAST(n AS VARCHAR), s) FILTER (WHERE n % 3 = 0) AS period FROM e GROUP BY user_id)
SELECT user_id, quote_deadline, quote_eligibility, quote_amount, CASE WHEN d_at IS NULL OR p_at >= d_at THEN period END AS quote_period_end FROM f""")
def stream_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence in four micro-batches, each with rows of all times, folded to the newest value of each field."""
    folder = work_dir(spark, "evidence")
    text = F.concat_ws(" ", "event_type", "event_id")
    whole = F.floor("value").cast("long")
    rows = table(spark, sf_dir, "events").select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id",
        F.when(F.col("event_type") == "view", text).otherwise(F.lit(" ")).alias("quote_deadline"),
        F.when(F.col("event_type") == "click", text).alias("quote_eligibility"),
        F.when(~F.col("event_type").isin("view", "click"), text).alias("quote_amount"),
        F.when(whole % 3 == 0, whole.cast("string")).alias("quote_period_end"),
    )
    sink = state.evidence_sink(f"{folder}/table", "user_id", "long", FIELDS, "ts", "event_id")
    _in_batches([rows.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == i) for i in range(4)], folder, sink)
    folded = state.bucketed(spark, f"{folder}/table", state.evidence_schema("user_id", "long", FIELDS))
    return state.current_evidence(folded, "user_id", FIELDS, derived=["quote_period_end"], source="quote_deadline")


QUOTA = 40


@query(f"""
WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS r, count(*) OVER () AS n FROM customer),
b AS (SELECT unnest([0, 1, 2]) AS batch)
SELECT c_custkey, batch FROM c, b WHERE (r - batch * {QUOTA} % n + n) % n < {QUOTA}""")
def stream_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three micro-batches that each offer all customers: turns go round, ``QUOTA`` at a time, whose turn was longest ago first."""
    folder = work_dir(spark, "rotation")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("pos"))
    _in_batches([customers] * 3, folder, state.rotation_sink(folder, "c_custkey", "long", "pos", QUOTA))
    return spark.read.parquet(f"{folder}/turns").select("c_custkey", F.col("batch").cast("int").alias("batch"))
