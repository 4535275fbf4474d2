"""Upkeep of stored notices: identity keys, evidence, periods, ledgers and issue states."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, collapse, crawler_title_key, json_map
from .linkage import keys_compatible
from .lookups import is_legacy_id

# Region names of identity keys, marks of rounds, cues of a deadline and where urls hold a post's number.
REGION_TOKENS = ("서울", "부산", "대구", "인천", "광주", "대전", "울산", "세종", "경기", "강원", "충북", "충청북도", "충남", "충청남도", "전북", "전라북도", "전남", "전라남도", "경북", "경상북도", "경남", "경상남도", "제주")
ROUND_MARK = r"(?<![가-힣])(\d+\s*차(?![가-힣])|상시|추가|연장)"
CUE_WORDS = ("까지", "마감", "접수기간", "접수 기간", "신청기간", "신청 기간", "제출기한", "기한")
CUE_DATE = (
    r"(~\s*\d{1,4}\s*[.\-/]\s*\d{1,2}|\d{4}\s*[.\-/]\s*\d{1,2}\s*[.\-/]\s*\d{1,2}|\d{1,2}\s*\.\s*\d{1,2}\s*\."
    r"|\d{1,2}\s*월\s*\d{1,2}\s*일|\d{1,2}\s*/\s*\d{1,2}\s*(?:\(\s*[월화수목금토일]\s*\)|[월화수목금토일]요일))"
)
LINK_KEYS = ("link", "url", "href")


# Identity keys


def has_region(c: Column) -> Column:
    return blank(c).rlike("|".join(REGION_TOKENS))


def first_region(candidates: Column) -> Column:
    """The first of the candidate texts that names a region, trimmed; '' for none."""
    trimmed = F.transform(candidates, lambda x: F.trim(blank(x)))
    return F.coalesce(F.get(F.filter(trimmed, has_region), F.lit(0)), F.lit(""))


def subject_signature(candidates: Column) -> Column:
    """All non-empty candidate texts, white space collapsed, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(candidates, collapse), lambda x: x != "")))


def round_key(candidates: Column) -> Column:
    """Marks of rounds in any of the texts, numbers without leading zeros, distinct, sorted, joined by '|'."""
    found = F.flatten(F.transform(candidates, lambda x: F.regexp_extract_all(blank(x), F.lit(ROUND_MARK), F.lit(1))))
    plain = F.transform(found, lambda m: F.regexp_replace(F.regexp_replace(m, r"\s", ""), r"^0+(?=\d)", ""))
    return F.array_join(F.array_sort(F.array_distinct(plain)), "|")


def deadline_key(period_end: Column, month: Column) -> Column:
    """The deadline, else the month a row was stored in."""
    return F.when(blank(period_end) != "", period_end).when(blank(month) != "", F.concat(F.lit("month:"), month)).otherwise("")


def group_key(title: Column, subjects: Column, period_end: Column, month: Column, rounds: Column) -> Column:
    """struct(title, subjects, deadline, round): what makes two stored notices one; rounds count only without a deadline."""
    marks = F.when(blank(period_end) == "", round_key(F.array_append(rounds, title))).otherwise("")
    return F.struct(crawler_title_key(title).alias("title"), F.array_join(subject_signature(subjects), "|").alias("subjects"), deadline_key(period_end, month).alias("deadline"), marks.alias("round"))


def id_matches_url(source_id: Column, url: Column, params: Sequence[str]) -> Column:
    """Does the url hold the id (what follows its last colon) in one of the parameters of post numbers?"""
    number = F.element_at(F.split(blank(source_id), ":"), -1)
    found = F.array(*[F.regexp_extract(blank(url), rf"(?i)[?&]{p}=([^&]*)(?:&|$)", 1) for p in params])
    return (number != "") & F.exists(found, lambda x: F.lower(x) == F.lower(number))


def url_is_unresolved(url: Column, params: Sequence[str]) -> Column:
    """No url, a void one, or one without a post's number."""
    named = F.lit(False)
    for p in params:
        named = named | blank(url).rlike(rf"(?i)[?&]{p}=\d+")
    return (blank(url) == "") | F.contains(blank(url), F.lit("#void")) | ~named


def rule_c(rows: DataFrame, params: Sequence[str]) -> DataFrame:
    """(id, keeper) of rows that a provable row of the same title stands for.

    ``rows``: id, title_key, subjects, rounds, deadline, source_id, url. A keeper has its own number in
    its url. A row of the same url goes if keys fit but for the deadline; one whose url says nothing and that
    isn't provable goes if all keys fit. The keeper is the smallest id; equal urls come first.
    """
    known = rows.withColumn("provable", id_matches_url(F.col("source_id"), F.col("url"), params)).withColumn("lost", url_is_unresolved(F.col("url"), params))
    keys = ("subjects", "rounds", "deadline")
    fits = lambda loose: keys_compatible(F.col("subjects"), F.col("k_subjects"), F.col("rounds"), F.col("k_rounds"), F.col("deadline"), F.col("k_deadline"), loose)

    def keepers(*by: str) -> DataFrame:
        """The smallest provable id of each title and its keys, by which a common title is few rows."""
        least = known.where("provable").groupBy(*by, *keys).agg(F.min("id").alias("k_id"))
        return least.select("k_id", *[F.col(c).alias(f"k_{c}") for c in (*by, *keys)])

    same = known.where(blank(F.col("url")) != "").join(keepers("title_key", "url"), (F.col("title_key") == F.col("k_title_key")) & (F.col("url") == F.col("k_url")))
    same = same.where(fits(True) & (F.col("id") != F.col("k_id")) & (~F.col("provable") | (F.col("k_id") < F.col("id")))).select("id", F.lit(False).alias("other"), "k_id")
    # a keeper of the same url comes first, so this may find it again
    lost = known.where("not provable and lost").join(keepers("title_key"), F.col("title_key") == F.col("k_title_key")).where(fits(False)).select("id", F.lit(True).alias("other"), "k_id")
    best = same.union(lost).groupBy("id").agg(F.min(F.struct("other", F.col("k_id").alias("keeper"))).alias("b"))
    return best.select("id", "b.keeper")


def deadline_cue(title: Column, summary: Column) -> Column:
    """What shows a reader that there is a deadline: a date form, else a word; of the title, else of the summary."""

    def of(c: Column) -> Column:
        t = blank(c)
        word = F.get(F.filter(F.array(*[F.lit(w) for w in CUE_WORDS]), lambda w: F.contains(t, w)), F.lit(0))
        return F.coalesce(F.nullif(F.trim(F.regexp_extract(t, CUE_DATE, 1)), F.lit("")), word)

    return F.coalesce(of(title), of(summary))


# Evidence and periods


def string_values(raw: Column, without: Sequence[str] = LINK_KEYS) -> Column:
    """The text values of a JSON object in lines, but for those of links."""
    kept = F.map_filter(json_map(raw), lambda k, v: ~F.lower(k).isin(*without) & (blank(v) != ""))
    return F.array_join(F.map_values(kept), "\n")


def replaced_evidence(raw: Column, new: Column, fields: Sequence[str]) -> Column:
    """JSON text of ``raw`` whose evidence fields are those of the map ``new`` and no others: a lost page leaves none of the old."""
    rest = F.map_filter(json_map(raw), lambda k, v: ~k.isin(*fields))
    return F.to_json(F.map_concat(rest, F.map_filter(new, lambda k, v: k.isin(*fields) & (blank(v) != ""))))


def overwrite_periods(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], evidence: Sequence[str], now: Column) -> DataFrame:
    """``stored`` (period_start, period_end, raw_data, updated_at) with periods and evidence taken from ``incoming``, nulls too.

    Rows whose periods and evidence are the same, '' and null being equal, aren't touched.
    """
    names = ("period_start", "period_end", "raw_data")
    new = incoming.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(f"_{c}") for c in names], F.lit(True).alias("_given"))
    joined = stored.join(new, [F.col(k) == F.col(f"_{k}") for k in keys], "left")
    as_null = lambda c: F.nullif(c, F.lit(""))
    of = lambda raw: F.transform(F.array(*[F.lit(k) for k in evidence]), lambda k: blank(F.try_element_at(json_map(raw), k)))
    same = of(F.col("raw_data")) == of(F.col("_raw_data"))
    for c in ("period_start", "period_end"):
        same = same & as_null(F.col(c)).eqNullSafe(as_null(F.col(f"_{c}")))
    changed = F.coalesce(F.col("_given"), F.lit(False)) & ~same
    raw = replaced_evidence(F.col("raw_data"), json_map(F.col("_raw_data")), evidence)
    values = {"period_start": as_null(F.col("_period_start")), "period_end": as_null(F.col("_period_end")), "raw_data": raw, "updated_at": now}
    return joined.select(*[F.when(changed, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in stored.columns])


def mark_legacy(df: DataFrame, evidence: Sequence[str], now: Column) -> DataFrame:
    """Rows of old ids flagged, without periods and evidence; rows already flagged stay."""
    hit = F.coalesce((F.col("legacy") == 0) & is_legacy_id(F.col("source"), F.col("source_id")), F.lit(False))
    none = F.create_map().cast("map<string,string>")
    values = {"legacy": F.lit(1), "period_start": F.lit(None).cast("string"), "period_end": F.lit(None).cast("string"), "raw_data": replaced_evidence(F.col("raw_data"), none, evidence), "updated_at": now}
    return df.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def fake_deadlines(df: DataFrame, deadline: str, posted: Sequence[str], evidence: str) -> DataFrame:
    """Rows whose deadline is but a posting date, with what it should be: the evidence's deadline, or null."""
    d = F.col(deadline)
    is_posted = F.lit(False)
    for p in posted:
        is_posted = is_posted | (d == F.col(p))
    return df.where(d.isNotNull() & F.coalesce(is_posted, F.lit(False))).withColumn("repaired", F.when(F.col(evidence) != d, F.col(evidence)))


def fake_starts(df: DataFrame, start: str, posted: str, body: str, states: str = r"(?:접수|신청|모집)\s*기간") -> DataFrame:
    """Rows whose start is the posting day though the text states no period of reception."""
    return df.where((F.col(start) == F.col(posted)) & ~blank(F.col(body)).rlike(states))


# Ledgers and states


def appended(old: DataFrame, new: DataFrame) -> DataFrame:
    """A ledger with new rows; columns that these lack are null."""
    return old.unionByName(new, allowMissingColumns=True)


def set_reference(df: DataFrame, refs: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``df`` with reference columns replaced where ``refs`` has the key."""
    new = refs.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = df.join(new, F.col(key) == F.col("_key"), "left")
    return joined.select(*[F.when(F.col("_key").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def update_fields(df: DataFrame, updates: DataFrame, key: str, allowed: Sequence[str]) -> DataFrame:
    """``df`` with the fields of ``updates`` that aren't null; a field that isn't allowed is an error."""
    fields = [c for c in updates.columns if c != key]
    if wrong := sorted(set(fields) - set(allowed)):
        raise ValueError(f"fields that can't be updated: {', '.join(wrong)}")
    new = updates.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in fields])
    joined = df.join(new, F.col(key) == F.col("_key"), "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns])


def next_version(documents: DataFrame, changed: DataFrame, key: str, version: str = "version") -> DataFrame:
    """``documents`` with changed ones appended under the next version of their key (1 for new ones)."""
    top = documents.groupBy(key).agg(F.max(version).alias("_top"))
    fresh = changed.join(top, key, "left").withColumn(version, F.coalesce(F.col("_top"), F.lit(0)) + 1).drop("_top")
    return documents.unionByName(fresh, allowMissingColumns=True)


def rechecked(df: DataFrame, done: DataFrame, key: str, content: Column, now: Column) -> DataFrame:
    """``df`` with hash and time of the recheck for the keys in ``done``."""
    ids = done.select(F.col(key).alias("_key")).distinct()
    joined = df.withColumn("_hash", content).join(ids, F.col(key) == F.col("_key"), "left")
    hit = F.col("_key").isNotNull()
    values = {"council_content_hash": F.col("_hash"), "council_rechecked_at": now}
    return joined.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def expire_issues(issues: DataFrame, newer: Column, open_states: Sequence[str] = ("draft", "annotated", "held")) -> DataFrame:
    """Open issues with a newer one expire: messages move to the queue, the approval goes."""
    hit = F.coalesce(newer & F.col("status").isin(*open_states), F.lit(False))
    none = F.array().cast("array<bigint>")
    queue = F.array_union(F.coalesce("superseded_ids", none), F.concat(F.coalesce("preview_ids", none), F.coalesce("notice_ids", none)))
    values = {"status": F.lit("expired"), "superseded_ids": queue, "preview_ids": none, "notice_ids": none, "approval": F.lit(None).cast("string")}
    return issues.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in issues.columns])


def normalised_state(raw: Column, schema: str, defaults: Mapping[str, Column]) -> Column:
    """A state's JSON in a fixed schema: unknown keys go, missing ones take defaults."""
    s = F.from_json(F.coalesce(raw, F.lit("{}")), schema)
    return F.struct(*[F.coalesce(s[k], d).alias(k) for k, d in defaults.items()])


def bound_manifest(items: DataFrame, issue: str, pos: str, line: str, body: Column) -> DataFrame:
    """(issue, sha256, n_items): a manifest bound to the text it tells of; another text makes another hash."""
    every = F.array_sort(F.collect_list(F.struct(pos, line)))
    return items.groupBy(issue).agg(F.sha2(F.first(body).cast("binary"), 256).alias("sha256"), F.size(every).alias("n_items"), F.sha2(F.array_join(F.transform(every, lambda x: x[line]), "\n").cast("binary"), 256).alias("lines_sha256"))


def signature(df: DataFrame, group: str, pos: str, columns: Sequence[str]) -> DataFrame:
    """SHA-256 of each group's rows as JSON in their order: batches of the same payload have the same."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("_pos"), F.struct(*sorted(columns)).alias("row"))))
    return df.groupBy(group).agg(F.sha2(F.to_json(F.transform(rows, lambda x: x["row"])).cast("binary"), 256).alias("signature"))


def wanted_records(df: DataFrame, score: str, least: float, *flags: str) -> DataFrame:
    """Rows of a score and with all flags set, for which a record is to be made."""
    out = df.where(F.col(score) >= least)
    for f in flags:
        out = out.where(F.coalesce(F.col(f), F.lit(0)) == 1)
    return out


def weather_rows(raw: Column, arrays: Mapping[str, str]) -> Column:
    """An answer's parallel arrays (name to type) as an array of rows."""
    schema = "daily struct<" + ", ".join(f"{k}: array<{t}>" for k, t in arrays.items()) + ">"
    parsed = F.from_json(raw, schema)["daily"]
    return F.arrays_zip(*[parsed[k].alias(k) for k in arrays])


# Digest checks


def classification_problems(shown: DataFrame, stored: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, shown, stored) where what a digest shows isn't what the stored row gives."""
    s = stored.select(F.col(key).alias("_key"), *[F.col(f).cast("string").alias(f"_{f}") for f in fields])
    joined = shown.join(s, F.col(key) == F.col("_key"))
    each = F.array(*[F.when(~F.col(f).cast("string").eqNullSafe(F.col(f"_{f}")), F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("shown"), F.col(f"_{f}").alias("stored"))) for f in fields])
    return joined.select(key, F.explode(F.array_compact(each)).alias("p")).select(key, "p.*")


def liveness_problem(body_hash: Column, snapshot_hash: Column, n_dead: Column) -> Column:
    """Why a liveness snapshot doesn't clear a digest (null: it does): it is of another text, or links are dead."""
    return F.when(snapshot_hash.isNull(), "no snapshot").when(~(body_hash == snapshot_hash), "body changed").when(n_dead > 0, "dead links")


def first_parse(*counts: Column) -> Column:
    """Rows of the first parser that has any; 0 if parsers ran and found none, null if none ran."""
    some = [F.when(c > 0, c) for c in counts]
    ran = F.coalesce(*[c for c in counts])
    return F.coalesce(*some, F.when(ran.isNotNull(), F.lit(0)))


def warning_summary(df: DataFrame, by: str, raw: str) -> DataFrame:
    """Warnings by kind of sidecar JSON objects (kind to count)."""
    each = df.select(by, F.explode(F.from_json(raw, "map<string,bigint>")).alias("kind", "n"))
    return each.groupBy("kind").agg(F.sum("n").alias("n"))


def section_of(checked: Column, composed: Column, heading: Column, headings: Mapping[str, str]) -> Column:
    """An item's section: from the check file, else the composer, else its heading."""
    table = F.create_map(*[F.lit(x) for kv in headings.items() for x in kv])
    return F.coalesce(F.nullif(checked, F.lit("")), F.nullif(composed, F.lit("")), F.try_element_at(table, heading), F.lit("unknown"))


def fits_chunk(parts: Sequence[Column], shrinkable: int, limit: int = 4096) -> Column:
    """struct(fits, dropped): does a block fit a message, whole or after its last ``shrinkable`` parts go?"""
    total = sum((F.length(blank(p)) + 1 for p in parts), F.lit(-1))
    dropped, size, out = 0, total, None
    for p in [None, *reversed(parts[len(parts) - shrinkable :])]:
        if p is not None:
            size, dropped = size - F.length(blank(p)) - 1, dropped + 1
        row = F.struct(F.lit(True).alias("fits"), F.lit(dropped).alias("dropped"))
        out = F.when(size <= limit, row) if out is None else out.when(size <= limit, row)
    return out.otherwise(F.struct(F.lit(False).alias("fits"), F.lit(shrinkable).alias("dropped")))
