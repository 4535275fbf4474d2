"""Relevance, council and domain scores as column expressions over given vocabularies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, council_key, council_tokens, hits, holds_any, keyword_match, let, token_sequence_in


def keyword_relevance(fields: Sequence[Column], must: Sequence[str], boost: Mapping[str, float], exclude: Sequence[str]) -> Column:
    """struct(score, reason, matched) of a text's fields, joined by blanks and lower-cased.

    The first excluded word gives 0; a required word 0.5; boosts 0.05 of their weight each, 0.5 in
    all at most.
    """
    return let({"text": F.lower(F.concat_ws(" ", *[blank(c) for c in fields]))}, lambda v: _relevance(v["text"], must, boost, exclude))


def _relevance(text: Column, must: Sequence[str], boost: Mapping[str, float], exclude: Sequence[str]) -> Column:
    low = lambda ws: [w.lower() for w in ws]
    barred = F.try_element_at(hits(text, low(exclude)), F.lit(1)) if exclude else F.lit(None).cast("string")
    needed = hits(text, low(must))
    boosts = hits(text, low(list(boost)))
    gain = F.least(sum((F.when(F.contains(text, F.lit(w.lower())), F.lit(0.05 * v)).otherwise(F.lit(0.0)) for w, v in boost.items()), F.lit(0.0)), F.lit(0.5))
    score = F.least(F.when(F.size(needed) > 0, 0.5).otherwise(0.0) + gain, F.lit(1.0))
    reason = F.when(score == 0, "관련 키워드 없음").otherwise(
        F.concat_ws(" + ", F.when(F.size(needed) > 0, F.lit("필수 키워드 매칭")), F.when(F.size(boosts) > 0, F.concat(F.lit("추가 키워드 "), F.size(boosts).cast("string"), F.lit("개"))))
    )
    return F.struct(
        F.when(barred.isNotNull(), 0.0).otherwise(score).alias("score"),
        F.when(barred.isNotNull(), "제외 키워드 발견").otherwise(reason).alias("reason"),
        F.when(barred.isNotNull(), F.array(barred)).otherwise(F.concat(needed, boosts)).alias("matched"),
    )


def select_relevant(df: DataFrame, score: str, least: float, keep_all: Column | None = None) -> DataFrame:
    """Rows of at least ``least``; where ``keep_all`` is true all stay and a score of 0 becomes 0.5."""
    free = F.coalesce(keep_all, F.lit(False)) if keep_all is not None else F.lit(False)
    return df.where(free | (F.col(score) >= least)).withColumn(score, F.when(free & (F.col(score) == 0), 0.5).otherwise(F.col(score)))


def budgeted(df: DataFrame, score: str, id_col: str, least: float, max_calls: int) -> DataFrame:
    """Marks which candidates (score at least ``least``, best first) fit the budget of evaluations."""
    first = df.where(F.col(score) >= least).orderBy(F.desc(score), id_col).limit(max_calls).select(F.col(id_col).alias("_id"))
    joined = df.join(F.broadcast(first), F.col(id_col) == F.col("_id"), "left")  # max_calls rows
    return joined.withColumn("evaluated", F.col("_id").isNotNull()).drop("_id")


def council_score(source: Column, fields: Sequence[Column], kind: Column, profile: Mapping) -> Column:
    """struct(score, match, eligibility, region, reason) of a notice under a council profile.

    ``profile``: sources, must_match, exclude (lists), eligibility and region (tag to aliases).
    Fields are judged one by one, title first; media need a required word in the title.
    """
    keys = [council_key(c) for c in fields]
    toks = [council_tokens(c) for c in fields]

    def held(word: str, where: Sequence[Column]) -> Column:
        needle = "".join(ch for ch in word if ch not in "()[]{}（）［］【】「」『』<>〈〉《》 \t\n").lower()
        out = F.lit(False)
        for k in where if needle else ():
            out = out | F.contains(k, F.lit(needle))
        return out

    def tags(table: Mapping[str, Sequence[str]]) -> Column:
        if not table:
            return F.array().cast("array<string>")
        return F.array_compact(F.array(*[F.when(_any([held(a, keys) for a in aliases]), F.lit(t)) for t, aliases in table.items()]))

    out = F.lit(None).cast("string")
    for term in reversed(list(profile.get("exclude", ()))):
        wanted = council_tokens(F.lit(term))
        out = F.when(_any([token_sequence_in(t, wanted) for t in toks]), F.lit(term)).otherwise(out)
    must = list(profile.get("must_match", ()))
    n_must = sum((F.when(kind == "media", held(w, keys[:1])).otherwise(held(w, keys)).cast("int") for w in must), F.lit(0))
    eligibility, region = tags(profile.get("eligibility", {})), tags(profile.get("region", {}))
    score = F.least(F.bround(F.when(n_must > 0, 0.5).otherwise(0.0) + F.least(F.size(eligibility) * 0.05, F.lit(0.25)) + F.least(F.size(region) * 0.05, F.lit(0.25)), 4), F.lit(1.0))
    inside = F.coalesce(source.isin(*profile.get("sources", ())), F.lit(False)) if profile.get("sources") else F.lit(False)
    extra = F.size(eligibility) + F.size(region)
    none = F.array().cast("array<string>")
    ok = inside & out.isNull()
    words = F.concat(F.lit("협의회 어휘 "), n_must.cast("string"), F.lit("개"), F.when(extra > 0, F.concat(F.lit(" + 태그 "), extra.cast("string"), F.lit("개"))).otherwise(""))
    return F.struct(
        F.when(ok, score).otherwise(0.0).alias("score"),
        F.when(ok & (n_must > 0), 1).otherwise(0).alias("match"),
        F.when(ok, eligibility).otherwise(none).alias("eligibility"),
        F.when(ok, region).otherwise(none).alias("region"),
        F.when(~inside, "협의회 소스 아님").when(out.isNotNull(), F.concat(F.lit("제외 키워드: "), out)).when(n_must == 0, "협의회 어휘 없음").otherwise(words).alias("reason"),
    )


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def domain_scores(text: Column, domains: Mapping[str, Mapping[str, Sequence[str]]]) -> Column:
    """Array of struct(score, ord, domain) for all domains: primary words count 2, secondary 1, over their possible sum."""
    return let({"text": F.lower(blank(text))}, lambda v: _domain_scores(v["text"], domains))


def _domain_scores(low: Column, domains: Mapping[str, Mapping[str, Sequence[str]]]) -> Column:
    out = []
    for i, (name, words) in enumerate(domains.items()):
        total = 2 * len(words["primary"]) + len(words["secondary"])
        got = sum((keyword_match(low, w).cast("int") * n for key, n in (("primary", 2), ("secondary", 1)) for w in words[key]), F.lit(0))
        out.append(F.struct((got / F.lit(float(max(total, 1)))).alias("score"), F.lit(-i).alias("ord"), F.lit(name).alias("domain")))
    return F.array(*out)


def best_domain(text: Column, domains: Mapping[str, Mapping[str, Sequence[str]]]) -> Column:
    """struct(domain, confidence); ties go to the first domain, no hit gives ('', 0)."""

    def named(v: Column) -> Column:
        best, hit = v["best"], v["best"]["score"] > 0
        return F.struct(F.when(hit, best["domain"]).otherwise("").alias("domain"), F.when(hit, F.least(best["score"], F.lit(1.0))).otherwise(0.0).alias("confidence"))

    return let({"best": F.array_max(domain_scores(text, domains))}, named)


def all_domains(text: Column, domains: Mapping[str, Mapping[str, Sequence[str]]]) -> Column:
    """The domains with a hit, best first, ties in their order."""
    return F.reverse(F.array_sort(F.filter(domain_scores(text, domains), lambda d: d["score"] > 0)))


def decision_list(rules: Sequence[tuple[str, Column, str]], otherwise: tuple[str, str]) -> Column:
    """struct(verdict, reason) of the first rule (verdict, condition, reason) that holds."""
    verdict = reason = None
    for v, condition, r in rules:
        verdict = F.when(condition, F.lit(v)) if verdict is None else verdict.when(condition, F.lit(v))
        reason = F.when(condition, F.lit(r)) if reason is None else reason.when(condition, F.lit(r))
    return F.struct(verdict.otherwise(otherwise[0]).alias("verdict"), reason.otherwise(otherwise[1]).alias("reason"))


def gate(title: Column, exclude: Sequence[str], cues: Sequence[str]) -> Column:
    """Why a title doesn't pass (null: it does); an empty cue vocabulary lets nothing pass."""
    return F.when(holds_any(title, exclude), "noise: excluded word").when(~holds_any(title, cues), "noise: no cue")


def source_kind(declared: Column, known: Mapping[str, str], source: Column) -> Column:
    """A source's kind; what isn't known is media, which never reaches the company's list."""
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv]) if known else F.create_map().cast("map<string,string>")
    kind = F.coalesce(F.nullif(declared, F.lit("")), F.try_element_at(table, source))
    return F.when(kind.isin("gonggo", "media"), kind).otherwise("media")


def health_verdict(status: Column, error: Column, parsed: Column, latest: Column, today: Column, n_rows: Column, stale_days: int = 90) -> Column:
    """struct(verdict, note) of a source's probe and stored rows."""
    age = F.datediff(today, latest)
    bad = error.isNotNull() | status.isNull() | (status >= 400)
    verdict = F.when(bad, "unreachable").when(parsed == 0, "parse_fail").when(age >= stale_days, "stale").when(n_rows == 0, "empty").otherwise("ok")
    note = (
        F.when(error.isNotNull(), error)
        .when(status.isNull(), "no answer")
        .when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string")))
        .when(parsed == 0, "no rows on the list")
        .when(age >= stale_days, F.concat(F.lit("latest row "), age.cast("string"), F.lit(" days ago")))
        .when(n_rows == 0, "nothing stored")
        .otherwise("")
    )
    return F.struct(verdict.alias("verdict"), note.alias("note"))


def crawl_status(n_rows: Column, n_errors: Column) -> Column:
    return F.when((n_rows == 0) & (n_errors > 0), "error").when(n_errors > 0, "partial").otherwise("success")
