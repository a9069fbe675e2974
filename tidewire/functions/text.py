"""Titles, languages, mentions and snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params


def title_key(title: Column) -> Column:
    """Lower-case letters, digits and underscores of a title."""
    return F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}_]", "")


def bigrams(key: Column, blank: bool) -> Column:
    """Distinct character bigrams of a title key; a key of one character is its own set.

    An empty key gives {""} if ``blank`` (title dedup) and the empty set if not (clustering, history).
    """
    long = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - 1, F.lit(1))), lambda i: F.substring(key, i, F.lit(2))))
    empty = F.array(F.lit("")) if blank else F.array().cast("array<string>")
    return F.when(F.length(key) >= 2, long).when(F.length(key) == 1, F.array(key)).otherwise(empty)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def language(text: Column, letters: str = params.CJK, share: float = 0.2, name: str = "zh", other: str = "en") -> Column:
    """``name`` if more than ``share`` of the characters are of class ``letters``; unknown if empty."""
    n = F.regexp_count(text, F.lit(letters))
    return F.when(F.coalesce(text, F.lit("")) == "", "unknown").when(n / F.greatest(F.length(text), F.lit(1)) > F.lit(share), name).otherwise(other)


def companies(text: Column, dictionary=params.COMPANIES) -> Column:
    """Names whose keyword is a substring of the lower-cased text, in dictionary order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in dictionary]))


def event_type(title: Column, snippet: Column, rules=params.EVENT_RULES) -> Column:
    """The first rule with a keyword in the lower-cased title and snippet, else null."""
    low = F.lower(F.concat_ws(" ", title, snippet))
    out = F.lit(None).cast("string")
    for name, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_snippet(snippet: Column, title: Column) -> Column:
    """Without a repeated title, promotions and a publication prefix."""
    repeated = F.startswith(snippet, title)
    rest = F.regexp_replace(F.substring(snippet, F.length(title) + 1, F.length(snippet)), r"^[ –:|]+", "")
    s = F.when(repeated, rest).otherwise(snippet)
    s = F.regexp_replace(s, r"🚨.*?REGISTER NOW\.?", "")
    s = F.regexp_replace(s, r"(?i)Flash Sale.*?REGISTER NOW\.?", "")
    s = F.regexp_replace(s, r"(?i)^.*?(?:Posted|Published|Updated)[^.]*?(?:\d{4})?\s*[-–—]\s*", "")
    return strip(s)


def numeric_core(value: Column) -> Column:
    """The first number with its separators, else the stripped value."""
    number = F.regexp_extract(value, r"\d+(?:[.,]\d+)*", 0)
    return F.when(number != "", number).otherwise(F.trim(value))


def time_qualified(query: Column, category: Column, as_of: Column) -> Column:
    """A query with words that ask for fresh results, unless it has some."""
    year = F.date_format(as_of, "yyyy")
    last_year = (F.year(as_of) - 1).cast("string")
    low = F.lower(query)
    has = lambda text, words: _any(F.contains(text, w if isinstance(w, Column) else F.lit(w)) for w in words)
    chinese = (
        F.when(has(query, ("最新", "今日", "本周", year, last_year)), query)
        .when(category.isin("funding", "industry"), F.concat_ws(" ", query, F.date_format(as_of, "yyyy年MM月"), F.lit("最新")))
        .otherwise(F.concat_ws(" ", query, F.lit("最新")))
    )
    english = (
        F.when(has(low, ("today", "latest", "new", "this week", year, last_year, F.lower(F.date_format(as_of, "MMMM")))), query)
        .when(category == "funding", F.concat_ws(" ", query, F.date_format(as_of, "MMMM yyyy"), F.lit("latest")))
        .when(category == "policy", F.when(F.contains(low, F.lit("update")), F.concat_ws(" ", query, year)).otherwise(F.concat_ws(" ", query, year, F.lit("update"))))
        .when(category == "research", F.concat_ws(" ", query, year))
        .otherwise(F.concat_ws(" ", query, F.lit("latest news"), F.date_format(as_of, "yyyy-MM-dd")))
    )
    return F.when(F.rlike(query, F.lit(params.CJK)), chinese).otherwise(english)


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def chinese_date(day: Column) -> Column:
    return F.date_format(day, "yyyy年M月d日")
