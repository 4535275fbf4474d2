"""String and array column functions: columns in, columns out, no Python at run time."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that keys leave out.
TITLE_KEY_CHARS = r"[\s\p{Z}·.,()\[\]{}「」『』\-~/]+"
COUNCIL_BRACKETS = "()[]{}（）［］【】「」『』<>〈〉《》"
COUNCIL_PUNCTUATION = COUNCIL_BRACKETS + ".,·:;!?/|~\"'“”‘’…-"
DATE_TOKENS = r"\d{1,4}\s*[.\-/]\s*\d{1,2}(?:\s*[.\-/]\s*\d{1,2})?\.?|\d{1,4}\s*년|\d{1,2}\s*월|\d{1,2}\s*일|\d{1,2}\s*차|\d{1,2}\s*분기"
SYMBOLS = r"[^0-9A-Za-z가-힣ㄱ-ㅎㅏ-ㅣ\s]"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+?82[-. ]?)?0?\d{1,2}[-. )]\d{3,4}[-. ]\d{4}"
MARKDOWN_LINK = r"\[([^\]]*)\]\(\s*(?:https?://|www\.)(?:[^()\s]|\([^()]*\))*\)"
AUTOLINK = r"<\s*((?:https?://|www\.)[^>]*?)\s*>"
BRACKETED = r"[(\[{（【［<](?:[^()\[\]{}（）【】［］<>]|\([^()]*\)|\[[^\[\]]*\]|［[^［］]*］)*[)\]}）】］>]"
BRACKET_GROUP = r"[(\[（【［]([^()\[\]（）【】［］]*)[)\]）】］]"
BRACKET_PREFIX = r"^((?:\s*[(\[（【［][^()\[\]（）【】［］]*[)\]）】］])+)"
LEADING_MARKS, LEADING_WIDE = "#*-+>|~=·•", "＃＊－＋＞｜～＝・・"


def let(values: Mapping[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` of a struct of the values, each of which is computed once however often it is used."""
    row = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.get(F.transform(F.array(row), body), F.lit(0))


def blank(c: Column) -> Column:
    """Null as ''."""
    return F.coalesce(c, F.lit(""))


def collapse(c: Column) -> Column:
    """Runs of Unicode white space to one space, trimmed."""
    return F.trim(F.regexp_replace(blank(c), r"(?U)[\s\p{Z}]+", " "))


def strip_controls(c: Column) -> Column:
    """Control, format and separator characters removed but for line feed and tab."""
    return F.regexp_replace(blank(c), r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}&&[^\n\t]]", "")


def normalise_title(c: Column) -> Column:
    return collapse(strip_controls(c))


def merge_title_key(c: Column) -> Column:
    """Equal titles but for white space; punctuation stays, as it tells rounds and sums apart."""
    return F.regexp_replace(normalise_title(c), r"(?U)[\s\p{Z}]", "")


def dedup_key(c: Column) -> Column:
    """Without date tokens and symbols; bracket contents stay."""
    return collapse(F.regexp_replace(F.regexp_replace(normalise_title(c), DATE_TOKENS, " "), SYMBOLS, " "))


def crawler_title_key(c: Column) -> Column:
    """A third normalisation, for in-list merges: white space and common punctuation removed."""
    return F.regexp_replace(blank(c), "(?U)" + TITLE_KEY_CHARS, "")


def council_key(c: Column) -> Column:
    return F.lower(F.translate(blank(c), COUNCIL_BRACKETS + " \t\n", ""))


def council_tokens(c: Column) -> Column:
    spaced = F.translate(blank(c), COUNCIL_PUNCTUATION, " " * len(COUNCIL_PUNCTUATION))
    return F.filter(F.split(F.lower(spaced), r"(?U)[\s\p{Z}]+"), lambda t: t != "")


def sanitise_title(c: Column) -> Column:
    """Links to their text, angle brackets full width, leading markdown defused, em to en dash."""
    t = F.regexp_replace(normalise_title(c), MARKDOWN_LINK, "$1")
    t = collapse(F.translate(F.regexp_replace(t, AUTOLINK, "$1"), "<>", "＜＞"))
    lead = F.regexp_extract(t, r"^([#*\-+>|~=·•]*)", 1)
    t = F.concat(F.translate(lead, LEADING_MARKS, LEADING_WIDE), t.substr(F.length(lead) + 1, F.length(t)))
    t = F.regexp_replace(t, r"^(\d+)\.", "$1．")
    return collapse(F.translate(t, "—", "–"))


def strip_brackets(c: Column) -> Column:
    """Bracket groups with their contents removed, one level of nesting included."""
    return collapse(F.regexp_replace(normalise_title(c), BRACKETED, " "))


def bracket_groups(c: Column) -> Column:
    """Contents of all bracket groups, in order."""
    return F.regexp_extract_all(normalise_title(c), F.lit(BRACKET_GROUP), F.lit(1))


def prefix_brackets(c: Column) -> Column:
    """Contents of the bracket groups that a title starts with."""
    lead = F.regexp_extract(normalise_title(c), BRACKET_PREFIX, 1)
    return F.transform(F.regexp_extract_all(lead, F.lit(BRACKET_GROUP), F.lit(1)), F.trim)


def prefix_signature(c: Column) -> Column:
    return F.array_join(F.transform(prefix_brackets(c), lambda g: F.concat(F.lit("["), g, F.lit("]"))), "")


def clean_text(c: Column) -> Column:
    """'' for null, 'none' and 'null'."""
    t = F.trim(blank(c))
    return F.when(F.lower(t).isin("none", "null"), "").otherwise(t)


def mask_contacts(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(blank(c), EMAIL, "[email]"), PHONE, "[phone]")


def content_hash(*columns: Column) -> Column:
    """SHA-256 of the fields joined by NUL; nulls count as ''."""
    return F.sha2(F.concat_ws("\u0000", *[blank(c) for c in columns]).cast("binary"), 256)


def short_hash(c: Column, n: int = 16) -> Column:
    return F.substring(F.md5(blank(c).cast("binary")), 1, n)


def id_from_url(url: Column, patterns: Sequence[str]) -> Column:
    """The first group of the first pattern that matches, else the short hash of the url."""
    tried = [F.nullif(F.regexp_extract(blank(url), p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*tried, short_hash(url))


def summary_of_parts(*columns: Column) -> Column:
    """Non-empty parts joined by ' | '."""
    return F.concat_ws(" | ", *[F.nullif(F.trim(blank(c)), F.lit("")) for c in columns])


def safe_filename(c: Column) -> Column:
    return F.trim(F.regexp_replace(blank(c), r'[\\/:*?"<>|\x00-\x1f]', "_"))


def redact(c: Column) -> Column:
    """Values of secrets in query strings and headers to ***."""
    return F.regexp_replace(blank(c), r"(?i)((?:service_?key|api_?key|token|secret|password|authorization)[\"']?\s*[=:]\s*[\"']?)[^&\s\"',}]+", "$1***")


def strip_notes(c: Column) -> Column:
    """Parenthesised notes without a digit removed."""
    return collapse(F.regexp_replace(blank(c), r"\([^()\d]*\)", " "))


def anchored_window(text: Column, anchor: Column, n: int) -> Column:
    """struct(window, truncated): n characters from the anchor's last occurrence, else from that of its first 20."""
    t, a = blank(text), blank(anchor)

    def last_of(x: Column) -> Column:
        back = F.position(F.reverse(x), F.reverse(t))
        return F.when((x == "") | (back == 0), F.lit(0)).otherwise(F.length(t) - back - F.length(x) + 2)

    start = F.coalesce(F.nullif(last_of(a), F.lit(0)), F.nullif(last_of(F.substring(a, 1, 20)), F.lit(0)), F.lit(1))
    return F.struct(t.substr(start, F.lit(n)).alias("window"), (F.length(t) - start + 1 > n).alias("truncated"))


def format_problem(c: Column) -> Column:
    """Why a generated sentence can't be used, or null."""
    t = blank(c)
    return (
        F.when(t.rlike(r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]"), "control character")
        .when(t.rlike(r"(?i)https?://|www\."), "url")
        .when(t.rlike(r"[\[\]`*_#<>|]"), "markdown character")
        .when(F.trim(t) == "", "empty")
    )


# Keywords, tokens, sets


def hits(text: Column, words: Sequence[str]) -> Column:
    """The words that the text holds, in dictionary order."""
    if not words:
        return F.array().cast("array<string>")
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def holds_any(text: Column, words: Sequence[str], when_empty: bool = False) -> Column:
    """True if the text holds one of the words; an empty vocabulary gives ``when_empty``."""
    if not words:
        return F.lit(when_empty)
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def keyword_match(text: Column, word: str) -> Column:
    """Short ASCII words (up to 3 letters) need a boundary of non-ASCII-alphanumerics, others may be anywhere."""
    w = word.lower()
    if len(w) <= 3 and w.isascii():
        quoted = "".join(f"\\{ch}" if not ch.isalnum() else ch for ch in w)
        return text.rlike(f"(?<![A-Za-z0-9]){quoted}(?![A-Za-z0-9])")
    return F.contains(text, F.lit(w))


def token_sequence_in(tokens: Column, wanted: Column) -> Column:
    """Is the array ``wanted`` a contiguous part of the array ``tokens``?"""
    mark = "\u0001"
    around = lambda a: F.concat(F.lit(mark), F.array_join(a, mark), F.lit(mark))
    return (F.size(wanted) > 0) & F.contains(around(tokens), around(wanted))


def ngrams(c: Column, n: int = 3) -> Column:
    """Distinct character n-grams; a shorter text is its own only one, an empty text has none."""
    size = F.length(c)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: c.substr(i, F.lit(n)))
    return F.when(size == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def title_ngrams(c: Column, n: int = 3) -> Column:
    return ngrams(F.regexp_replace(dedup_key(c), " ", ""), n)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def round_tokens(c: Column) -> Column:
    """Round marks (3차, 상시, 수시, 추가, 연장, 재공고), distinct, sorted, joined by '|'; numbers without leading zeros."""
    found = F.regexp_extract_all(blank(c), F.lit(r"(\d+\s*차|상시|수시|추가|연장|재공고)"), F.lit(1))
    plain = F.transform(found, lambda t: F.regexp_replace(F.regexp_replace(t, r"\s", ""), r"^0+(?=\d)", ""))
    return F.array_join(F.array_sort(F.array_distinct(plain)), "|")


def number_tokens(c: Column) -> Column:
    return F.regexp_extract_all(blank(c), F.lit(r"(\d[\d,]*(?:\.\d+)?)"), F.lit(1))


def unsupported_numbers(claim: Column, evidence: Column) -> Column:
    """Numbers of the claim that the evidence doesn't have."""
    return F.filter(F.array_distinct(number_tokens(claim)), lambda n: ~F.contains(blank(evidence), n))


# JSON


def json_map(c: Column) -> Column:
    """A JSON object as a map of strings; anything else as an empty map."""
    return F.coalesce(F.from_json(F.when(F.trim(c).startswith("{"), c), "map<string,string>"), F.create_map().cast("map<string,string>"))


def json_submap(c: Column, prefix: str | None = None, keys: Sequence[str] = ()) -> Column:
    """Entries with the prefix or among the keys whose value isn't empty."""
    wanted = lambda k: (k.startswith(prefix) if prefix else F.lit(False)) | (k.isin(*keys) if keys else F.lit(False))
    return F.map_filter(json_map(c), lambda k, v: wanted(k) & (blank(v) != ""))


def json_patch(old: Column, new: Column, allowed: Sequence[str], clears: dict[str, Sequence[str]] | None = None) -> Column:
    """JSON text of ``old`` with the allowed non-empty entries of the map ``new``; a changed key clears its derived keys."""
    given = F.map_filter(new, lambda k, v: k.isin(*allowed) & (blank(v) != ""))
    cleared = F.array().cast("array<string>")
    for key, derived in (clears or {}).items():
        changed = F.coalesce(F.try_element_at(given, F.lit(key)) != blank(F.try_element_at(json_map(old), F.lit(key))), F.lit(False))
        cleared = F.array_union(cleared, F.when(changed, F.array(*[F.lit(d) for d in derived])).otherwise(F.array().cast("array<string>")))
    kept = F.map_filter(json_map(old), lambda k, v: ~F.array_contains(F.map_keys(given), k) & ~F.array_contains(cleared, k))
    return F.to_json(F.map_concat(kept, given))
