"""Publication dates from fields, URLs and text, and the report clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """Midnight of a calendar day, null if there is no such day."""
    return F.try_make_timestamp(year.cast("int"), month.cast("int"), day.cast("int"), F.lit(0), F.lit(0), F.lit(0))


def month_number(name: Column) -> Column:
    """1 to 12 by the first three letters; null if they name no month."""
    place = F.array_position(F.array(*map(F.lit, params.MONTHS)), F.lower(F.substring(name, 1, 3)))
    return F.nullif(place.cast("int"), F.lit(0))


def flexible_date(value: Column) -> Column:
    """ISO date times, dates, or "Aug 17, 2026"; null for all else. Times without zone are UTC."""
    v = F.trim(value)
    named = r"^([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(20\d{2})$"
    g = lambda k: F.nullif(F.regexp_extract(v, named, k), F.lit(""))
    zoned = F.when(F.rlike(v, F.lit(r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(Z|[+-]\d{2}:?\d{2})$")), F.try_to_timestamp(v))
    plain = F.when(F.rlike(v, F.lit(r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{1,2}:\d{1,2})?$")), F.try_to_timestamp(v))
    return F.coalesce(zoned, plain, safe_date(g(3), month_number(g(1)), g(2)))


def _found(text: Column, pattern: str, order: tuple[int, int, int]) -> Column:
    """All calendar days that a pattern finds; ``order`` says which groups hold year, month and day (0: the first)."""
    named = "[A-Za-z]" in pattern or "Jan|" in pattern

    def day(match: Column) -> Column:
        y, m, d = (F.regexp_extract(match, pattern, k) if k else F.lit("1") for k in order)
        return safe_date(y, month_number(m) if named else m, d)

    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), day), lambda x: x.isNotNull())


def published_date(url: Column, text: Column, as_of: Column) -> Column:
    """Publication date from the URL, else the latest plausible day in the text, else an old month."""

    def dated(x: Column) -> Column:
        low = x["now"] - F.expr(f"INTERVAL {params.DATE_WINDOW_DAYS} DAYS")
        high = x["now"] + F.expr(f"INTERVAL {params.DATE_AHEAD_DAYS} DAYS")
        stale = x["now"] - F.expr(f"INTERVAL {params.STALE_MONTH_DAYS} DAYS")

        def of_url(pattern: str) -> Column:
            # the groups are cut out of the match, not out of the URL again
            found = F.regexp_extract(x["url"], pattern, 0)
            day = safe_date(*[F.regexp_extract(found, pattern, k) for k in (1, 2, 3)])
            return F.when(found != "", F.transform(F.array(day), lambda t: F.when(t.between(low, high), t))[0])

        days = F.filter(F.concat(*[_found(x["text"], *p) for p in params.DAY_PATTERNS]), lambda t: t.between(low, high))
        months = F.filter(F.concat(*[_found(x["text"], *p) for p in params.MONTH_PATTERNS]), lambda t: t < stale)
        # every pattern for texts has a year of this century
        of_text = F.when(F.contains(x["text"], F.lit("20")), F.coalesce(F.array_max(days), F.array_max(months)))
        return F.coalesce(*[of_url(p) for p in params.URL_DATES], of_text)

    return F.transform(F.array(F.struct(url.alias("url"), text.alias("text"), as_of.alias("now"))), dated)[0]


def report_date(now: Column, zone: str = params.REPORT_TIMEZONE) -> Column:
    """The day of an instant in the report's time zone."""
    return F.to_date(F.from_utc_timestamp(now, zone))


def report_day_start(day: Column, zone: str = params.REPORT_TIMEZONE) -> Column:
    """The instant at which a report day starts."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)
