"""The monthly issue: which rows may be in it, why others are held back, and its places filled by rules in turn.

Stages in a fixed number of passes, each of which gets only what the one before has left:

1. ``staged``: the rule by which a row may come in, rows that the weekly rules excluded and that are taken back, and the first
   reason (of an ordered list) to hold a row back; column expressions only;
2. ``media_capped``: of each issue's media rows without pin only the best ``media_limit`` stay, a top-k by group;
3. ``monthly_issue``: pins first, then rules in turn, each its next row whose source isn't full, until ``limit``. Only rows that
   can be reached are walked, at most a few dozen an issue; why any other row is left out follows from where its rule's turns ended.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import at_or_before, top_per_group

# Outcomes and reasons as the issues write them, prefixes, and the sources whose press releases count.
APPLY, NOTICE, EXCLUDED = "신청하세요", "알아두세요", "제외"
NOT_MONTHLY, HAS_DEADLINE, UNKNOWN_DEADLINE = "월간호 대상 아님 (노이즈·참가자 모집)", "마감 있음 — 주간호 몫", "마감 미확인"
NO_MATCH, ACTIONABLE, NOT_ELIGIBLE, MEDIA_CAP = "협의회 어휘 없음 — 2차 미디어 제외", "행동 대상 — 주간호 몫", "월간 대상 아님", "미디어 상한"
RESCUED_PRESS, RESCUED_MEDIA = "월간 편입: 기관 보도·정책", "월간 편입: 2차 미디어"
DIVERSITY, SECTION_CAP, PIN_CAP, BUMPED = "소스 다양성", "상한 초과", "핀 상한 초과", "핀 승격으로 밀림"
NOISE_PREFIX, HELD_PREFIXES = "노이즈", ("노이즈 의심", "참가자 모집(B2C)")
PRESS_SOURCES = ("forest_press", "mafra", "socialenterprise", "coop")
RULES = ("a", "b", "c")

ORDER = (("posted", True), ("_score", True), ("id", False))


def rule(press_sources: Sequence[str] = PRESS_SOURCES) -> Column:
    """c: media that the council's words match; b: press releases; a: what the weekly rules call a notice."""
    match, only = (F.coalesce(F.col(c), F.lit(False)) for c in ("council_match", "council_only"))
    media = F.col("kind").eqNullSafe("media")
    press = F.coalesce(F.col("source").isin(*press_sources), F.lit(False)) & (match | ~only)
    return F.when(media, F.when(match, F.lit("c"))).when(press, F.lit("b")).when(F.col("verdict") == NOTICE, F.lit("a"))


def staged(rows: DataFrame, press_sources: Sequence[str] = PRESS_SOURCES) -> DataFrame:
    """``rows`` with rule, outcome (``candidate``, ``held``, ``excluded``) and note: why, or why an excluded row was taken back.

    Columns read: id, source, kind, verdict, reason, deadline, deadline_cue, council_match, council_only, noise (has the title noise words?),
    gate (why media or press rows fail their second gate).
    """
    r = rows.withColumn("rule", rule(press_sources))
    reason = F.coalesce("reason", F.lit(""))
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    back = (F.col("verdict") == EXCLUDED) & ~reason.startswith(NOISE_PREFIX) & ~F.coalesce("noise", F.lit(False)) & ~filled("deadline") & F.col("rule").isin("b", "c")
    rescued = F.when(back, F.when(F.col("rule") == "c", RESCUED_MEDIA).otherwise(RESCUED_PRESS))
    media = F.col("kind").eqNullSafe("media")
    match = F.coalesce("council_match", F.lit(False))
    held = (
        F.when(reason.startswith(HELD_PREFIXES[0]) | reason.startswith(HELD_PREFIXES[1]), NOT_MONTHLY)
        .when(filled("deadline"), HAS_DEADLINE)
        .when(filled("deadline_cue"), UNKNOWN_DEADLINE)
        .when(media & ~match, NO_MATCH)
        .when(media, F.col("gate"))
        .when(F.col("verdict") == APPLY, ACTIONABLE)
        .when(F.col("rule") == "b", F.col("gate"))
        .when(F.col("rule") == "a", F.lit(None))
        .otherwise(NOT_ELIGIBLE)
    )
    out = r.withColumn("_rescued", rescued).withColumn("_held", held)
    gone = F.coalesce(F.col("verdict") == EXCLUDED, F.lit(False)) & F.col("_rescued").isNull()
    outcome = F.when(gone, "excluded").when(F.col("_held").isNotNull(), "held").otherwise("candidate")
    return out.withColumn("outcome", outcome).withColumn("note", F.when(gone, F.col("reason")).otherwise(F.coalesce("_held", "_rescued"))).drop("_rescued", "_held")


def media_capped(rows: DataFrame, issue: str, media_limit: int = 2) -> DataFrame:
    """``staged`` rows of which media candidates without pin beyond each issue's best ``media_limit`` are held."""
    scored = rows.withColumn("_score", F.coalesce("council_score", F.lit(0.0)))
    ranked = (F.col("outcome") == "candidate") & F.col("kind").eqNullSafe("media") & ~F.coalesce("pinned", F.lit(False))
    stays = top_per_group(scored.where(ranked), [issue], ORDER, media_limit, "_rank").select(F.col("id").alias("_stays"))
    joined = scored.withColumn("_ranked", F.coalesce(ranked, F.lit(False))).join(stays, F.col("id") == F.col("_stays"), "left")
    over = F.col("_ranked") & F.col("_stays").isNull()
    return joined.withColumn("outcome", F.when(over, "held").otherwise(F.col("outcome"))).withColumn("note", F.when(over, MEDIA_CAP).otherwise(F.col("note"))).drop("_ranked", "_stays")


def _turns(rows: pd.DataFrame, limit: int, per_source: int, honor: bool) -> tuple[list, dict[str, tuple[object, bool]]]:
    """Ids in the order of choosing, and by rule the last id that it chose and whether it went through to its end."""
    rows = rows.sort_values(["rule", "posted", "_score", "id"], ascending=[True, False, False, True])
    chosen: list = []
    used: dict = {}
    if honor:
        for i, source in rows[rows["pinned"]][["id", "source"]].itertuples(index=False):
            if len(chosen) < limit:
                chosen.append(i)
                used[source] = used.get(source, 0) + 1
        rows = rows[~rows["pinned"]]
    queues = {r: g[["id", "source"]].values.tolist()[::-1] for r, g in rows.groupby("rule", sort=True)}
    ends: dict[str, tuple[object, bool]] = dict.fromkeys(queues, (None, False))
    while len(chosen) < limit:
        before = len(chosen)
        for r, queue in queues.items():
            if len(chosen) == limit:
                break
            while queue:
                i, source = queue.pop()
                if used.get(source, 0) < per_source:
                    used[source] = used.get(source, 0) + 1
                    chosen.append(i)
                    ends[r] = (i, False)
                    break
            else:
                ends[r] = (ends[r][0], True)
        if len(chosen) == before:
            break
    return chosen, ends


def monthly_issue(rows: DataFrame, issue: str, limit: int = 5, per_source: int = 2, media_limit: int = 2, press_sources: Sequence[str] = PRESS_SOURCES) -> DataFrame:
    """``(issue, id, rule, outcome, position, note)`` of every row; chosen ones have outcome ``selected`` and a position from 1."""
    judged = media_capped(staged(rows, press_sources), issue, media_limit).withColumn("posted", F.coalesce("posted", F.lit(""))).withColumn("pinned", F.coalesce("pinned", F.lit(False)))
    some = judged.where("outcome = 'candidate'").select(issue, "id", "rule", "source", "posted", "_score", "pinned")

    def reach(df: DataFrame) -> DataFrame:
        own = top_per_group(df, [issue, "rule", "source"], ORDER, per_source, "_rank").drop("_rank")
        return top_per_group(own, [issue, "rule"], ORDER, limit * (per_source + 1), "_rank").drop("_rank")

    pins = top_per_group(some.where("pinned"), [issue], (("rule", False), *ORDER), limit, "_rank").drop("_rank")
    walked = reach(some).union(reach(some.where("not pinned"))).union(pins).distinct()
    kinds = dict(rows.dtypes)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen, ends = _turns(pdf, limit, per_source, True)
        plain = _turns(pdf, limit, per_source, False)[0]
        out = [(pdf[issue].iloc[0], i, chosen.index(i) + 1 if i in chosen else None, i in plain, None, None) for i in {*chosen, *plain}]
        out += [(pdf[issue].iloc[0], last, None, None, r, through) for r, (last, through) in ends.items()]
        return pd.DataFrame(out, columns=[issue, "id", "position", "plain", "rule", "through"]).astype(object)

    told = walked.groupBy(issue).applyInPandas(walk, f"{issue} {kinds[issue]}, id {kinds['id']}, position int, plain boolean, rule string, through boolean")
    places = told.where("rule is null").select(F.col("id").alias("_id"), "position", F.col("plain").alias("_plain"))
    last = some.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_last_{c}") for c, _ in ORDER])
    ends = told.where("rule is not null").join(last, F.col("id") == F.col("_id"), "left").select(F.col(issue).alias("_issue"), F.col("rule").alias("_rule"), F.col("through").alias("_through"), *[f"_last_{c}" for c, _ in ORDER])
    joined = judged.join(places, F.col("id") == F.col("_id"), "left").join(ends, F.col(issue).eqNullSafe(F.col("_issue")) & F.col("rule").eqNullSafe(F.col("_rule")), "left")
    passed = F.coalesce(F.col("_through"), F.lit(False)) | F.coalesce(F.col("_last_id").isNotNull() & at_or_before(ORDER, {c: F.col(f"_last_{c}") for c, _ in ORDER}), F.lit(False))
    left = F.when(F.col("pinned"), PIN_CAP).when(F.coalesce("_plain", F.lit(False)), BUMPED).when(passed, DIVERSITY).otherwise(SECTION_CAP)
    is_in = F.col("position").isNotNull()
    open_row = F.col("outcome") == "candidate"
    return joined.select(issue, "id", "rule", F.when(is_in, "selected").when(open_row, "held").otherwise(F.col("outcome")).alias("outcome"), "position", F.when(open_row & ~is_in, left).otherwise(F.col("note")).alias("note"))
