"""Table functions for SQL: parsing of search responses, and questions to a model.

They take a table argument and work on Arrow batches, so ``SELECT * FROM parse_results(TABLE(SELECT id, markdown FROM responses))``
runs where the rows are. Parsing follows the rules of ``operators.search``, in Python's terms: white space and digits are those of
ASCII where the patterns say so, and a line ends where theirs do.
"""

from __future__ import annotations

import hashlib
import re
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from .. import params
from .models import ANALYSIS_COLUMNS, ChatModel, Send, _analysis

#: White space of any kind, at either end of a text.
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_STRIP = re.compile(rf"\A{_SPACE}+|{_SPACE}+\Z")
#: One character of a line.
_ANY = r"[^\n\r\x85\u2028\u2029]"
_RESULT = re.compile(params.RESULT_PATTERN, re.ASCII)
_COUNT = re.compile(params.RESULT_COUNT, re.ASCII)
_HEAD = re.compile(params.QUERY_HEAD, re.ASCII)
_LEAD = re.compile(r"\A[ –:|]+")
_PROMOTIONS = (
    re.compile(rf"🚨{_ANY}*?REGISTER NOW\.?"), re.compile(rf"Flash Sale{_ANY}*?REGISTER NOW\.?", re.ASCII | re.IGNORECASE),
    re.compile(rf"\A{_ANY}*?(?:Posted|Published|Updated)[^.]*?(?:\d{{4}})?\s*[-–—]\s*", re.ASCII | re.IGNORECASE),
)
_AUTHORITY = re.compile(r"\A(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)")

RESULTS = "id bigint, pos int, total_found int, title string, url string, snippet string, source_domain string, result_id string"
BLOCKS = "id bigint, pos int, query_text string, markdown string"


def strip(text: str) -> str:
    return _STRIP.sub("", text)


def clean_snippet(snippet: str, title: str) -> str:
    """Without a repeated title, promotions and a publication prefix."""
    if snippet.startswith(title):
        snippet = _LEAD.sub("", snippet[len(title) :])
    for pattern in _PROMOTIONS:
        snippet = pattern.sub("", snippet)
    return strip(snippet)


def results_of(markdown: str):
    """(pos, total_found, title, url, snippet, source_domain, result_id) of the results in a response."""
    count = _COUNT.search(markdown)
    total = int(count[1]) if count and len(count[1]) < 10 else 0
    for pos, found in enumerate(_RESULT.finditer(markdown)):
        title, url = strip(found[1]), strip(found[2])
        domain = _AUTHORITY.match(url)
        digest = hashlib.sha256(f"{url}|{title}".lower().encode()).hexdigest()[:12]
        yield pos, total, title, url, clean_snippet(strip(found[3]), title), domain[1].replace("www.", "") if domain else "", f"res_{digest}"


def blocks_of(markdown: str):
    """(pos, query_text, markdown) of the answers in a batched response."""
    blocks = _HEAD.split(markdown)
    leads = markdown.startswith(params.FIRST_QUERY)
    if (not leads and len(blocks) > 1) or (leads and not blocks[0]):
        blocks = blocks[1:]
    for pos, block in enumerate(b for b in blocks if strip(b)):
        line, newline, _ = block.partition("\n")
        yield pos, strip(line), block[len(line) :] if newline else ""


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _exploding(parse, ddl: str):
    """A table function of (id, markdown) rows with the rows that ``parse`` makes of each."""
    schema = _arrow(ddl)

    @arrow_udtf(returnType=ddl)
    class Exploding:
        def eval(self, batch: pa.RecordBatch):
            ids, texts = batch.column(0).cast(pa.int64()).to_pylist(), batch.column(1).to_pylist()
            yield _batch([(i, *r) for i, text in zip(ids, texts, strict=True) if text is not None for r in parse(text)], schema)

    return Exploding


def register_parsers(spark: SparkSession) -> None:
    """``parse_results`` and ``split_batches`` for tables of (id, markdown)."""
    spark.udtf.register("parse_results", _exploding(results_of, RESULTS))
    spark.udtf.register("split_batches", _exploding(blocks_of, BLOCKS))


def register_model(spark: SparkSession, send: Send, prompt: str = "", retries: int = 2, concurrency: int = 3) -> None:
    """``analyse`` for tables of (seq, event_id, context), and ``ask`` for tables of (id, text): one answer for each row, null where none came."""
    analyses, answers = _arrow(ANALYSIS_COLUMNS), _arrow("id bigint, answer string, calls bigint")
    names = analyses.names

    @arrow_udtf(returnType=ANALYSIS_COLUMNS)
    class Analyse:
        def eval(self, batch: pa.RecordBatch):
            def one(row: tuple):
                try:
                    found = _analysis(row[0], row[1], ChatModel(send, retries).json(prompt, row[2]))
                    return tuple(found[n] for n in names)
                except Exception:  # noqa: BLE001  an event without analysis is left out
                    return None

            with ThreadPoolExecutor(concurrency) as pool:
                rows = [r for r in pool.map(one, zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)) if r]
            yield _batch(rows, analyses)

    @arrow_udtf(returnType="id bigint, answer string, calls bigint")
    class Ask:
        def eval(self, batch: pa.RecordBatch):
            def one(row: tuple):
                model = ChatModel(send, retries)
                for _ in range(retries + 1):
                    try:
                        return row[0], model.text(prompt, row[1] or ""), model.stats["calls"]
                    except Exception:  # noqa: BLE001  another attempt may do
                        continue
                return row[0], None, model.stats["calls"]

            with ThreadPoolExecutor(concurrency) as pool:
                rows = list(pool.map(one, zip(batch.column(0).cast(pa.int64()).to_pylist(), batch.column(1).to_pylist(), strict=True)))
            yield _batch(rows, answers)

    spark.udtf.register("analyse", Analyse)
    spark.udtf.register("ask", Ask)
