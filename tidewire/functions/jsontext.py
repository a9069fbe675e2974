"""JSON inside model output, and claims grounded in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import numeric_core


def _valid(text: Column) -> Column:
    """The text if it is JSON, else null."""
    return F.when(F.try_parse_json(text).isNotNull(), text)


def _braces(text: Column) -> Column:
    start, end = F.locate("{", text), F.length(text) - F.locate("}", F.reverse(text)) + 1
    return F.when((start > 0) & (F.locate("}", text) > 0) & (end > start), F.substring(text, start, end - start + 1))


def _bound(value: Column, then) -> Column:
    """``then`` of a value that is evaluated once."""
    return F.transform(F.array(value), then)[0]


def _first_object(text: Column) -> Column:
    """From the first brace to the one that closes it; braces in strings do not count. Null without such.

    The fold goes over braces, quotes and backslashes and over what stands between them, not over characters.
    """
    parts = F.regexp_extract_all(F.substring(text, F.locate("{", text), F.length(text)), F.lit(r'[{}"\\]|[^{}"\\]+'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        closes = ~s["quoted"] & (c == "}")
        depth = s["depth"] + F.when(s["quoted"], 0).when(c == "{", 1).when(c == "}", -1).otherwise(0)
        quoted = F.when((c == '"') & ~s["escaped"], ~s["quoted"]).otherwise(s["quoted"])
        at = s["at"] + F.length(c)
        return F.when(s["end"] > 0, s).otherwise(F.struct(
            depth.alias("depth"), quoted.alias("quoted"), (s["quoted"] & ~s["escaped"] & (c == "\\")).alias("escaped"), at.alias("at"),
            F.when(closes & (depth == 0), at).otherwise(0).alias("end"),
        ))

    cut = lambda end: F.when(end > 0, F.substring(text, F.locate("{", text), end))
    return F.when(F.locate("{", text) > 0, _bound(F.aggregate(parts, start, step, lambda s: s["end"]), cut))


def extract_json_strict(text: Column) -> Column:
    """The whole text, else the body of the first json fence, else first to last brace; null if that is no JSON."""
    t = F.trim(text)
    fence = r"(?s)```json\s*(.*?)\s*```"
    return F.coalesce(_valid(t), F.when(F.rlike(t, F.lit(fence)), _valid(F.regexp_extract(t, fence, 1))).otherwise(_valid(_braces(t))))


def extract_json(text: Column) -> Column:
    """As above, but the fence in any case, braces within it, trailing commas repaired; of several objects the first."""
    t = F.trim(text)
    fence = r"(?is)```json\s*(.*?)\s*```"
    t = F.when(F.rlike(t, F.lit(fence)), F.trim(F.regexp_extract(t, fence, 1))).otherwise(t)
    repaired = lambda x: _valid(F.regexp_replace(x, r",(\s*[}\]])", "$1"))
    closing = lambda x: F.length(x) - F.length(F.replace(x, F.lit("}")))

    def found(x: Column) -> Column:
        whole = _bound(F.coalesce(_braces(x), x), lambda w: F.coalesce(_valid(w), repaired(w)))
        # the parser does not mind what follows a value, so the first object goes first
        first = _bound(_first_object(x), lambda f: F.coalesce(_valid(f), repaired(f)))
        # with one closing brace the first object is the whole, or there is none
        return F.when(closing(x) <= 1, whole).otherwise(F.coalesce(first, whole))

    return _bound(t, found)


def is_grounded(value: Column, text: Column) -> Column:
    """Whether a value's numeric core stands literally in the text; an empty core does not."""
    core = numeric_core(F.coalesce(value, F.lit("")))
    return (core != "") & F.contains(F.coalesce(text, F.lit("")), core)


def grounded(key_data: Column, text: Column) -> Column:
    """The entries of array<struct<label, value>> whose value is grounded."""
    return F.filter(key_data, lambda k: k.isNotNull() & is_grounded(k["value"], text))


def ungrounded(key_data: Column, text: Column) -> Column:
    """Labels "label=value" of the other entries."""
    rest = F.filter(key_data, lambda k: k.isNotNull() & ~is_grounded(k["value"], text))
    return F.transform(rest, lambda k: F.concat(F.coalesce(k["label"], F.lit("?")), F.lit("="), F.coalesce(k["value"], F.lit("?"))))
