"""Search services behind one interface, for tables of queries.

A service is a function from a list of (query, max_results) to Markdown, or to rows; network access lives in
such functions alone, so tests and offline runs put tables in their place. Batches are dealt to tasks, and a
task answers its batches one after the other with retries of its own, since a retried task would repeat all.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import params
from ..operators.filters import count_searches
from ..operators.graph import durable
from ..operators.search import match_batches, parse_results, split_batches

Service = Callable[[list[tuple[str, int]]], str]


class RpcError(RuntimeError):
    """The service answered with an error; not worth a retry on the transport."""


class RpcService:
    """A JSON-RPC search service. ``tool`` is called with one query or, batched, with several."""

    def __init__(self, url: str, key: str | None = None, tool: str = "batch_search", timeout: float = 60, retries: int = 2, sleep: Callable[[float], None] = time.sleep,
                 send: Callable[[urllib.request.Request, float], bytes] | None = None):
        self.url, self.key, self.tool, self.timeout, self.retries = url, key, tool, timeout, retries
        self.sleep, self.send, self.calls = sleep, send, 0

    def call(self, arguments: dict) -> str:
        """The text of the first content block. Transport errors and statuses of 500 and above are retried."""
        self.calls += 1
        body = {"jsonrpc": "2.0", "id": self.calls, "method": "tools/call", "params": {"name": self.tool, "arguments": arguments}}
        headers = {"Content-Type": "application/json", "Accept": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(self.url, json.dumps(body).encode(), headers)
        for attempt in range(self.retries + 1):
            try:
                raw = self.send(request, self.timeout) if self.send else urllib.request.urlopen(request, timeout=self.timeout).read()
                break
            except urllib.error.HTTPError as error:
                if error.code < 500 or attempt == self.retries:
                    raise
            except OSError:
                if attempt == self.retries:
                    raise
            self.sleep(2.0**attempt)
        answer = json.loads(raw)
        if "error" in answer:
            raise RpcError(str(answer["error"]))
        return answer["result"]["content"][0]["text"]

    def __call__(self, queries: list[tuple[str, int]]) -> str:
        return self.call({"queries": [{"query": q, "max_results": n} for q, n in queries]})


def answers(queries: DataFrame, service: Service, batch_size: int = params.SEARCH_BATCH, pause: float = 0.5, tasks: int = 1) -> DataFrame:
    """(batch_no, markdown, error, latency_ms, attempts) for batches of queries (dense seq from 0); a failed batch is tried twice."""
    slots = queries.select(F.floor(F.col("seq") / batch_size).cast("long").alias("batch_no"), "seq", "query", "max_results")

    def run(frames):
        first = True
        for frame in frames:
            for batch_no, part in frame.sort_values("seq").groupby("batch_no"):
                asked = list(zip(part["query"], part["max_results"].astype(int), strict=True))
                if not first:
                    time.sleep(pause)
                first, text, error, began, attempts = False, None, None, time.time(), 0
                for _ in range(2):
                    attempts += 1
                    try:
                        text, error = service(asked), None
                        break
                    except Exception as e:  # noqa: BLE001  a service may fail in any way; the row says how
                        error = str(e)
                yield pd.DataFrame({"batch_no": [batch_no], "markdown": [text], "error": [error], "latency_ms": [int(1000 * (time.time() - began))], "attempts": [attempts]})

    # rows of a batch must arrive together
    dealt = slots.repartition(tasks, "batch_no").sortWithinPartitions("batch_no", "seq")
    whole = dealt.groupBy("batch_no").agg(F.sort_array(F.collect_list(F.struct("seq", "query", "max_results"))).alias("q"))

    def run_lists(frames):
        for frame in frames:
            rows = [{"batch_no": b, "seq": x["seq"], "query": x["query"], "max_results": x["max_results"]} for b, q in zip(frame["batch_no"], frame["q"], strict=True) for x in q]
            yield from run([pd.DataFrame(rows)] if rows else [])

    return whole.mapInPandas(run_lists, "batch_no bigint, markdown string, error string, latency_ms bigint, attempts bigint")


def search(queries: DataFrame, service: Service, as_of: Column, batch_size: int = params.SEARCH_BATCH, pause: float = 0.5, counts: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(responses, results): one response for each query, matched by position, and the parsed results.

    All queries of a failed batch carry its error; a missing block gives "No result in batch response". Answers are written
    once, so no batch is asked for again. ``counts`` gets batches, calls, retries, failed and milliseconds, and total and
    good responses, all observed while the tables are written.
    """
    asked = Observation()
    sums = [F.coalesce(x, F.lit(0)).alias(k) for k, x in (("calls", F.sum("attempts")), ("retries", F.sum(F.col("attempts") - 1)), ("milliseconds", F.sum("latency_ms")))]
    raw = durable(answers(queries, service, batch_size, pause).observe(asked, F.count(F.lit(1)).alias("batches"), F.count_if(F.col("error").isNotNull()).alias("failed"), *sums))
    blocks = split_batches(raw.where("markdown IS NOT NULL").select("batch_no", "markdown"))
    matched = match_batches(queries, blocks, batch_size)
    failed = raw.where("error IS NOT NULL").select(F.col("batch_no").alias("__b"), F.col("error").alias("__e"))
    responses = matched.join(failed, F.col("batch_no") == F.col("__b"), "left").withColumn("error", F.coalesce("__e", "error")).drop("__b", "__e")
    responses, seen = count_searches(responses)
    responses = durable(responses)
    if counts is not None:
        counts |= asked.get | seen.get
    found = parse_results(responses.where("error IS NULL").select("seq", "query", "batch_id", "markdown"), as_of)
    results = found.withColumn("query_origin", F.col("query")).withColumn("seq", F.col("seq") * F.lit(1000) + F.col("pos")).withColumn("fetched_at", as_of)
    return responses.drop("markdown"), results


def register_table_source(spark, name: str, fetch: Callable[[dict], list[tuple]], schema: str) -> None:
    """Make ``spark.read.format(name)`` return the rows of ``fetch(options)``."""
    from pyspark.sql.datasource import DataSource, DataSourceReader

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options = options

        def read(self, partition):
            yield from fetch(self.options)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader(dict(self.options))

    spark.dataSource.register(Source)


class QueryService:
    """A search service that answers one query a request in JSON; an instance is a ``fetch`` of ``supplement``.

    Without a key it answers nothing.
    """

    def __init__(self, url: str, key: str | None, timeout: float = 30, depth: str = "basic", time_range: str | None = None,
                 send: Callable[[urllib.request.Request, float], bytes] | None = None):
        self.url, self.key, self.timeout, self.depth, self.time_range, self.send = url, key, timeout, depth, time_range, send

    def __call__(self, query: str, max_results: int) -> list[dict]:
        if not self.key:
            return []
        body = {"api_key": self.key, "query": query, "max_results": max_results, "search_depth": self.depth, "include_answer": False, "include_images": False}
        if self.time_range:
            body["time_range"] = self.time_range
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        raw = self.send(request, self.timeout) if self.send else urllib.request.urlopen(request, timeout=self.timeout).read()
        return [
            {"title": r.get("title", ""), "url": r.get("url", ""), "snippet": r.get("content", ""), "published": r.get("published_date"), "score": r.get("score"), "domain": r.get("domain")}
            for r in json.loads(raw).get("results", [])
        ]


def supplement(queries: DataFrame, fetch: Callable[[str, int], list[dict]], n: int = 5, most: int = 7, concurrency: int = 5) -> DataFrame:
    """Results of a second service for n queries, balanced over categories; a failed call gives no rows.

    ``fetch`` returns dicts with title, url and, if known, snippet, published, score and domain. Times without a zone
    count as UTC.
    """
    from concurrent.futures import ThreadPoolExecutor

    from ..functions.dates import flexible_date
    from ..functions.urls import result_id, source_domain
    from ..operators.querygen import pick_balanced

    def one(pair: tuple[str, int]) -> list[dict]:
        try:
            return [{"query_origin": pair[0], "pos": k} | {c: r.get(c) for c in ("title", "url", "snippet", "published", "score", "domain")} for k, r in enumerate(fetch(*pair))]
        except Exception:  # noqa: BLE001  the service is optional
            return []

    def run(frames):
        names = ["seq", "query_origin", "pos", "title", "url", "snippet", "published", "score", "domain"]
        with ThreadPoolExecutor(concurrency) as pool:
            for frame in frames:
                asked = list(zip(frame["query"], frame["max_results"].astype(int), strict=True))
                rows = [{"seq": s} | r for s, found in zip(frame["seq"], pool.map(one, asked), strict=True) for r in found]
                yield pd.DataFrame(rows, columns=names)

    picked = pick_balanced(queries, n).withColumn("max_results", F.least("max_results", F.lit(most))).select("seq", "query", "max_results")
    found = picked.mapInPandas(run, "seq bigint, query_origin string, pos int, title string, url string, snippet string, published string, score double, domain string")
    return found.select(
        (F.col("seq") * 1000 + F.col("pos")).alias("seq"), "query_origin", "title", "url", F.coalesce("snippet", F.lit("")).alias("snippet"),
        F.coalesce(F.nullif("domain", F.lit("")), source_domain(F.col("url"))).alias("source_domain"), result_id(F.col("url"), F.col("title")).alias("result_id"), flexible_date(F.col("published")).alias("published_at"), "score",
    )
