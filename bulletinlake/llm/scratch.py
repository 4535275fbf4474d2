"""Cutting lineage: Parquet tables in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir`` of the session. Only where that is unset and
the master is local (tests on one machine) a temporary folder is taken and set as the session's
checkpoint folder; on a cluster an unset folder is an error, since executors couldn't see the driver's.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BUCKETS = 1 << 20  # of ids, to leave out rows that nobody asks for
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def stash(df: DataFrame, name: str = "t", swept: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it.

    What follows reads files, so losing an executor costs no more than its running tasks; and the shuffle files of the
    write go when it ends, not when the driver happens to collect its garbage. ``swept``: ``sweep`` may delete the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/bulletinlake/{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    if swept:
        _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def sweep(spark: SparkSession) -> None:
    """Delete the tables that this application has stashed so far.

    Call it only when no result that reads them is still to be run, e.g. between pipeline
    stages that are written before the next one starts.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in _written.pop(spark.sparkContext.applicationId, []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def drop(table: DataFrame) -> None:
    """Delete a table that ``stash`` returned, when no result still to be run reads it."""
    spark, path = table.sparkSession, table.stashed_at
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _written[spark.sparkContext.applicationId].remove(path)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select columns by exact name (else by the first that matches without case), renamed.

    Works on tables with extra or clashing columns (``text`` and ``TEXT``, or a name twice:
    the first counts), where a plain ``select`` would be ambiguous.
    """
    plain, names = numbered(df)
    return plain.select(*[F.col(place_of(names, old)).alias(new) for new, old in columns.items()])


def asked_for(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``rows`` whose doc_id may be one of ``ids(name)``: by buckets of them, at most ``BUCKETS`` rows to broadcast."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    wanted = ids.select(bucket(name).alias("__bucket")).distinct()
    return rows.join(F.broadcast(wanted), bucket("doc_id") == wanted["__bucket"], "left_semi")


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with columns renamed ``_0``, ``_1``, ... and its own names, to put back with ``toDF``.

    Joins on such a frame can't be ambiguous, whatever its columns are called.
    """
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]), df.columns


def place_of(names: list[str], name: str) -> str:
    """The numbered name of the column ``name`` (exactly, else the first that matches without case)."""
    hits = [i for i, n in enumerate(names) if n == name] or [i for i, n in enumerate(names) if n.lower() == name.lower()]
    if not hits:
        raise ValueError(f"no column {name!r} among {names}")
    return f"_{hits[0]}"
