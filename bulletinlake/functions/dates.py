"""Date column functions; dates stay ISO text at the edges, ``today`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank

# A leading date, and a range of two of which the second may lack its year.
LEADING_DATE = r"^\s*(\d{4}|\d{2})\s*[.\-/년]\s*(\d{1,2})\s*[.\-/월]\s*(\d{1,2})"
RANGE_ONLY = r"^\s*(\d{4})\s*[.\-/년]\s*(\d{1,2})\s*[.\-/월]\s*(\d{1,2})\s*[.일]?\s*(?:\([^)]*\))?\s*[~∼～\-–]\s*(?:(\d{4})\s*[.\-/년]\s*)?(\d{1,2})\s*[.\-/월]\s*(\d{1,2})\s*[.일]?\s*(?:\([^)]*\))?\s*$"
KST = "Asia/Seoul"


def _date(y: Column, m: Column, d: Column) -> Column:
    """A real calendar date, else null."""
    return F.try_to_timestamp(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")


def parse_deadline(c: Column) -> Column:
    """A date at the start of the text (two-digit years are 20xx), checked against the calendar."""
    y, m, d = (F.regexp_extract(blank(c), LEADING_DATE, i) for i in (1, 2, 3))
    year = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    return F.when(y != "", _date(year, m, d))


def date_parse_failed(c: Column) -> Column:
    """There is text, but no date in it."""
    return (F.trim(blank(c)) != "") & parse_deadline(c).isNull()


def effective_deadline(start: Column, end: Column) -> Column:
    """The end, but null when it equals the start (a posting date, not a deadline)."""
    s, e = parse_deadline(start), parse_deadline(end)
    return F.when(s.isNotNull() & (s == e), F.lit(None).cast("date")).otherwise(e)


def kst_date(c: Column) -> Column:
    """Korean date of a timestamp text: with an offset it is converted, without one it is Korean already."""
    t = F.trim(blank(c))
    zoned = t.rlike(r"(?i)T.*(?:Z|[+-]\d{2}:?\d{2})$")
    utc = F.try_to_timestamp(F.when(zoned, t))
    # independent of the session's zone: to text in the session's zone, from there to Korea's
    local = F.convert_timezone(F.current_timezone(), F.lit(KST), utc.cast("timestamp_ntz"))
    naive = F.try_to_timestamp(F.when(~zoned, F.substring(t, 1, 10)), F.lit("yyyy-MM-dd")).cast("date")
    return F.coalesce(local.cast("date"), naive, parse_deadline(t))


def week_range(issue: Column) -> tuple[Column, Column]:
    """First and last day of an ISO week key (2026-W13)."""
    year = F.regexp_extract(issue, r"^(\d{4})-W(\d{2})$", 1).try_cast("int")
    week = F.regexp_extract(issue, r"^(\d{4})-W(\d{2})$", 2).try_cast("int")
    jan4 = F.make_date(year, F.lit(1), F.lit(4))
    start = F.date_add(F.date_sub(jan4, F.weekday(jan4)), (week - 1) * 7)
    return start, F.date_add(start, 6)


def month_range(issue: Column) -> tuple[Column, Column]:
    """First and last day of a month key (2026-M09)."""
    start = _date(F.regexp_extract(issue, r"^(\d{4})-M(\d{2})$", 1), F.regexp_extract(issue, r"^(\d{4})-M(\d{2})$", 2), F.lit("1"))
    return start, F.last_day(start)


def issue_kind(issue: Column) -> Column:
    """weekly, monthly or null for no valid key."""
    return F.when(issue.rlike(r"^\d{4}-W(0[1-9]|[1-4]\d|5[0-3])$"), "weekly").when(issue.rlike(r"^\d{4}-M(0[1-9]|1[0-2])$"), "monthly")


def week_key(d: Column) -> Column:
    """ISO week key of a date."""
    thursday = F.date_add(d, 3 - F.weekday(d))
    return F.concat(F.year(thursday).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def previous_month_key(d: Column) -> Column:
    return F.date_format(F.add_months(d, -1), "yyyy-'M'MM")


def quarter_label(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("년 Q"), F.quarter(d).cast("string"))


def normalise_date(c: Column) -> Column:
    """Delimited or eight digits to ISO text with months 1-12 and days 1-31, not checked against the calendar."""
    delimited = r"(\d{4})\s*[.\-/년]\s*(\d{1,2})\s*[.\-/월]\s*(\d{1,2})"
    solid = r"(?<!\d)(\d{4})(\d{2})(\d{2})(?!\d)"
    pattern = [F.when(F.regexp_extract(blank(c), delimited, 1) != "", F.regexp_extract(blank(c), delimited, i)).otherwise(F.regexp_extract(blank(c), solid, i)) for i in (1, 2, 3)]
    y, m, d = pattern
    fits = m.try_cast("int").between(1, 12) & d.try_cast("int").between(1, 31)
    return F.when(fits, F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def api_period(c: Column) -> tuple[Column, Column]:
    """'20260401 ~ 20260430' to its two dates; a single date is both."""
    parts = F.split(blank(c), "~")
    one = lambda i: normalise_date(F.regexp_replace(F.coalesce(F.get(parts, F.lit(i)), F.lit("")), r"\D", ""))
    start = one(0)
    return start, F.when(F.size(parts) > 1, one(1)).otherwise(start)


def compact_datetime(c: Column) -> Column:
    """YYYYMMDD[HHmm] or a delimited timestamp to an ISO date text."""
    digits = F.regexp_replace(blank(c), r"\D", "")
    return F.when(F.length(digits) >= 8, normalise_date(F.substring(digits, 1, 8)))


def pub_date(c: Column) -> Column:
    """RFC 822 or ISO feed dates to ISO text, by their own calendar day."""
    t = F.regexp_replace(F.trim(blank(c)), r"^[A-Za-z]{3},\s*", "")
    day, month, year = (F.regexp_extract(t, r"^(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})", i) for i in (1, 2, 3))
    names = "jan feb mar apr may jun jul aug sep oct nov dec".split()
    number = F.coalesce(*[F.when(F.lower(month) == n, F.lit(str(i))) for i, n in enumerate(names, 1)])
    return F.coalesce(_date(year, number, day), parse_deadline(t)).cast("string")


def range_only(c: Column) -> Column:
    """struct(start, end) of a text that is a date range and nothing else; the end may take the start's year.

    Null if a date isn't real or the range runs backwards.
    """
    y, m, d, y2, m2, d2 = (F.regexp_extract(blank(c), RANGE_ONLY, i) for i in range(1, 7))
    start = F.when(y != "", _date(y, m, d))
    end = F.when(y != "", _date(F.when(y2 != "", y2).otherwise(y), m2, d2))
    return F.when(start.isNotNull() & end.isNotNull() & (start <= end), F.struct(start.cast("string").alias("start"), end.cast("string").alias("end")))


def days_left(deadline: Column, today: Column) -> Column:
    return F.datediff(deadline, today)


def deadline_label(deadline: Column, posted: Column, today: Column, fresh_days: int = 7) -> Column:
    """D-n, D-day, 새 소식 (posted within ``fresh_days``) or 상시."""
    left = days_left(deadline, today)
    return (
        F.when(left > 0, F.concat(F.lit("D-"), left.cast("string")))
        .when(left == 0, "D-day")
        .when(left < 0, "마감")
        .when(F.datediff(today, posted).between(0, fresh_days), "새 소식")
        .otherwise("상시")
    )


def deadline_bucket(deadline: Column, posted: Column, today: Column, fresh_days: int = 7) -> Column:
    """0: has a deadline, 1: new, 2: always open."""
    return F.when(deadline.isNotNull(), 0).when(F.datediff(today, posted).between(0, fresh_days), 1).otherwise(2)


def month_day(d: Column) -> Column:
    return F.concat(F.month(d).cast("string"), F.lit("/"), F.day(d).cast("string"))


def recheck_due(old_hash: Column, new_hash: Column, checked_at: Column, now: Column, hours: int = 24) -> Column:
    """Never checked, unreadable stamp, other content, or at least ``hours`` ago."""
    at = F.try_to_timestamp(checked_at)
    return at.isNull() | ~old_hash.eqNullSafe(new_hash) | (F.timestamp_diff("HOUR", at, now) >= hours)


def excel_serial(d: Column) -> Column:
    return F.datediff(d, F.lit("1899-12-30").cast("date"))
