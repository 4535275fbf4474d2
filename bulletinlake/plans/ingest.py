"""From fetched rows to a new snapshot: relevance, council profile, domain, identity, merge."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import linkage, merge, scoring
from ..schemas import ANNOUNCEMENTS, with_defaults

ALWAYS = ("relevance_score", "relevance_reason", "matched_keywords", "updated_at")
IF_GIVEN = ("council_score", "council_tags", "council_match", "kind")


def scored(fetched: DataFrame, must: Sequence[str], boost: Mapping[str, float], exclude: Sequence[str], profile: Mapping, domains: Mapping, now: Column) -> DataFrame:
    """Fetched rows in the schema's columns with scores; media rows have no company score."""
    rows = with_defaults(fetched, ANNOUNCEMENTS)
    fields = [F.col(c) for c in ("title", "summary", "target", "category")]
    media = F.col("kind") == "media"
    r = scoring.keyword_relevance(fields, must, boost, exclude)
    c = scoring.council_score(F.col("source"), fields, F.col("kind"), profile)
    d = scoring.best_domain(F.concat_ws(" ", *[text.blank(F.col(x)) for x in ("title", "summary", "category", "target")]), domains)
    out = rows.withColumn("_r", r).withColumn("_c", c).withColumn("_d", d)
    return out.withColumns(
        {
            "relevance_score": F.when(media, 0.0).otherwise(F.col("_r.score")),
            "relevance_reason": F.col("_r.reason"),
            "matched_keywords": F.to_json("_r.matched"),
            "council_score": F.col("_c.score"),
            "council_match": F.col("_c.match"),
            "council_tags": F.to_json(F.struct("_c.eligibility", "_c.region")),
            "business_domain": F.col("_d.domain"),
            "domain_confidence": F.col("_d.confidence"),
            "council_content_hash": text.content_hash(*[F.col(x) for x in ("title", "summary", "target", "category")]),
            "created_at": now.cast("string"),
            "updated_at": now.cast("string"),
        }
    ).drop("_r", "_c", "_d")


def outcomes(rows: DataFrame, least: float = 0.3) -> DataFrame:
    """Rows with what becomes of them: 'company', 'council' (stored for the council only) or 'dropped'."""
    company = (F.col("kind") != "media") & (F.col("relevance_score") >= least)
    outcome = F.when(company, "company").when(F.col("council_match") == 1, "council").otherwise("dropped")
    return rows.withColumn("outcome", outcome).withColumn("council_only", F.when(company, 0).otherwise(1))


def ingest(stored: DataFrame, fetched: DataFrame, pos: str, least: float = 0.3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new snapshot, rows that are new, dropped rows) of scored rows merged into the stored ones.

    ``pos`` orders repeated keys of a batch: the last counts, but council_only only falls.
    """
    keys = ["source", "source_id"]
    judged = outcomes(fetched, least)
    kept = judged.where("outcome <> 'dropped'")
    batch = merge.fold_batch(kept.select(*[f.name for f in ANNOUNCEMENTS], pos), keys, pos, ["council_only"])
    snapshot = merge.upsert(with_defaults(stored, ANNOUNCEMENTS), with_defaults(batch, ANNOUNCEMENTS), keys, ALWAYS, IF_GIVEN, ["council_only"])
    return snapshot, linkage.new_rows(batch, stored, keys), judged.where("outcome = 'dropped'")


def to_notify(rows: DataFrame, today: Column) -> DataFrame:
    """Stored rows still to be sent: not sent, not old, for the company, no media, not past."""
    end = F.nullif(F.col("period_end"), F.lit(""))
    return rows.where((F.col("is_notified") == 0) & (F.col("legacy") == 0) & (F.col("council_only") == 0) & (F.coalesce("kind", F.lit("gonggo")) != "media") & (end.isNull() | (end >= today.cast("string")))).orderBy(F.desc("relevance_score"), F.desc("created_at"), "source", "source_id")


def search(rows: DataFrame, q: str, n: int = 20) -> DataFrame:
    """Company rows whose title or summary holds ``q`` (any case; % and _ are wildcards)."""
    like = f"%{q}%"
    return rows.where((F.col("council_only") == 0) & (F.col("title").ilike(like) | F.col("summary").ilike(like))).orderBy(F.desc("relevance_score"), F.desc("created_at"), "source", "source_id").limit(n)
