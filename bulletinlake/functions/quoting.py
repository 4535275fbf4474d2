"""Quotes of deadlines, eligibility and amounts from text with boundary marks (``sources.boundaries``).

All labels are found in one pass by one automaton; what a quote may hold is decided by looking around each of them. A quote
goes from its label to the end of its value: a bullet, the end of a row, the second cell, another label
at the start of a piece, a repeated word, markup, or ``LONGEST`` characters, but never within a date.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.boundaries import CELL, INNER, ROW

# Labels by quote in order of preference (True: only after a bullet, before a colon or doubled), other labels, characters and patterns.
LABELS = {
    "quote_deadline": (("접수기간", False), ("신청기간", False), ("모집기간", False), ("공모기간", False), ("접수일정", False), ("신청기한", False), ("접수기한", False), ("마감일시", False), ("마감기한", False), ("마감일", False), ("마감", True)),
    "quote_eligibility": (("신청자격", False), ("지원자격", False), ("참가자격", False), ("응모자격", False), ("신청대상", False), ("지원대상", False), ("모집대상", False), ("참여대상", False), ("대상", True)),
    "quote_amount": (("지원금액", False), ("지원규모", False), ("모집규모", False), ("지원사항", False), ("지원내역", False), ("사업규모", False), ("지원내용", True)),
}
FOREIGN = ("교육기간", "운영기간", "사업기간", "협약기간", "수행기간", "활동기간", "심사기간", "발표", "선정", "문의처", "문의", "담당부서", "담당자", "작성일", "등록일", "게시일", "조회수", "첨부파일", "첨부", "추진 일정", "추진일정", "신청방법", "제출방법", "제출서류", "유의사항")
LONGEST = 300
BULLETS = "ㅁ□ㅇ○◦▶■●◆"
OPENERS = "([【<〔「"
MARKS = ROW + CELL + INNER
EMPTY = "()[]:：-–—,."
DECORATION = " ()[]{}<>【】「」:：·-–—"
DATE_CHARS = frozenset("0123456789.-/년월일~∼〜 ")
REPEATED = re.compile(r"(?<![\s\ue000-\ue002])([^\s\ue000-\ue002]{2,})[\s\ue000-\ue002]+\1(?![\s\ue000-\ue002])")
MARKUP = re.compile(r"<\s*/?\s*[A-Za-z]")


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in {*FOREIGN, *(w for labels in LABELS.values() for w, _ in labels)}:
        found.add_word(word, word)
    found.make_automaton()
    return found


def flat(text: str) -> str:
    """Boundary marks and white space as single spaces."""
    return " ".join(re.sub(f"[{MARKS}]", " ", text).split())


def _gap(text: str, at: int, step: int, marks: bool = False) -> int:
    """The first place from ``at`` on (in steps of 1 or -1) that is no blank (and no mark)."""
    while 0 <= at < len(text) and (text[at].isspace() or (marks and text[at] in MARKS)):
        at += step
    return at


def _introduced(text: str, at: int) -> bool:
    """Does a bullet or an opening bracket stand before the label, perhaps with a parenthesis between?"""
    i = _gap(text, at - 1, -1)
    if i >= 0 and text[i] == "(":
        return True
    return i >= 0 and text[i] in BULLETS + OPENERS


def _label_at(text: str, places: list[int], label: str, strict: bool) -> int | None:
    """Where the label begins that the value belongs to: after a bullet, else before a colon, else the second of two, else the first at all."""
    size = len(label)
    for at in places:
        if _introduced(text, at):
            return at
    for at in places:
        after = _gap(text, at + size, 1)
        if after < len(text) and text[after] in ":：":
            return at
    for at in places:
        after = _gap(text, at + size, 1, marks=True)
        if after > at + size and text.startswith(label, after):
            return after
    return None if strict or not places else places[0]


def _value_end(text: str, begin: int, limit: int) -> int:
    """Where the value from ``begin`` on ends by boundaries, bullets and length."""
    said, cells = False, 0
    for i in range(begin, limit):
        c = text[i]
        if c in BULLETS or c == ROW:
            return i
        if c == CELL:
            cells += 1
            if said or cells > 1:
                return i
        elif c != INNER and not c.isspace() and c not in EMPTY:
            said = True
    end = limit
    if end < len(text) and text[end] in DATE_CHARS:
        while end > begin and text[end - 1] in DATE_CHARS:
            end -= 1
    return end if end > begin else limit


def _other_label(text: str, begin: int, end: int, words: list[tuple[int, str]], own: str, same: frozenset[str]) -> int:
    """Where in the value another label starts a piece of its own; ``end`` if none does."""
    spoken = next((i for i in range(begin, end) if not text[i].isspace() and text[i] not in MARKS + DECORATION), end)
    for at, word in words:
        if at >= end or at + len(word) > end:
            continue
        if at <= spoken or word in same or word in own or own in word:
            continue  # no value yet, or a word of this quote
        before = at - 1
        while before >= begin and text[before] in DECORATION:
            before -= 1
        if before < begin or text[before] in MARKS + BULLETS:
            return at
    return end


def quotes_of(text: str | None) -> dict[str, str | None]:
    """The quotes that the text has, by their names in ``LABELS``."""
    text = text or ""
    where: dict[str, list[int]] = defaultdict(list)
    words = sorted((end - len(w) + 1, w) for end, w in _automaton().iter(text))
    for at, word in words:
        where[word].append(at)
    found: dict[str, str | None] = dict.fromkeys(LABELS)
    for key, labels in LABELS.items():
        same = frozenset(w for w, _ in labels) - frozenset(FOREIGN)
        for label, strict in labels:
            at = _label_at(text, where.get(label, []), label, strict)
            if at is None:
                continue
            begin = at + len(label)
            end = _value_end(text, begin, min(len(text), at + LONGEST))
            end = _other_label(text, begin, end, [w for w in words if w[0] >= begin], label, same)
            again = REPEATED.search(text[begin:end])
            end = begin + again.start() if again else end
            markup = MARKUP.search(text, begin, end)
            quote = flat(text[at : markup.start() if markup else end])
            if len(quote) > len(label) + 2:
                found[key] = quote
                break
    return found


def cut_quotes(text: Column) -> Column:
    """struct(quote_deadline, quote_eligibility, quote_amount) of text with boundary marks; null where there is none."""

    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([quotes_of(t) for t in texts], columns=list(LABELS)).astype(object).where(lambda x: x.notna(), None)

    return F.pandas_udf(of, ", ".join(f"{k} string" for k in LABELS))(text)
