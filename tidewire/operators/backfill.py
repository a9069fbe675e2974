"""Completion of categories with too few articles."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params
from .dedup import dedup_by_title, dedup_by_url
from .filters import recent
from .graph import durable
from .search import to_articles, with_queries
from .stats import category_counts


def deficits(articles: DataFrame, categories=tuple(params.BACKFILL_QUERIES), least: int = params.BACKFILL_MIN_ITEMS) -> DataFrame:
    """(category, n) of the categories with fewer than ``least`` articles, none included."""
    wanted = articles.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    counts = category_counts(articles)
    return wanted.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).cast("long").alias("n")).where(F.col("n") < least)


def backfill_queries(lacking: DataFrame, queries: dict[str, tuple[str, ...]] = params.BACKFILL_QUERIES) -> DataFrame:
    """The listed queries of categories that lack articles."""
    rows = [(k, c, q) for k, (c, q) in enumerate((c, q) for c, qs in queries.items() for q in qs)]
    table = lacking.sparkSession.createDataFrame(rows, "seq bigint, category string, query string")
    return table.join(lacking.select("category"), "category", "left_semi").select(
        "seq", "query", "category", F.concat(F.lit("backfill_"), "category").alias("batch_id"), F.lit(params.BACKFILL_MAX_RESULTS).alias("max_results")
    )


class FetchLedger:
    """What was fetched so far, in the folder ``path``: results by fetch, then the queries of each fetch that was written whole.

    A fetch counts only once its queries are listed, so results of one that broke off are never read. Queries that are listed
    are not asked for again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.results_path, self.done_path = spark, f"{path}/results", f"{path}/done"

    def _table(self, path: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(path)
        except AnalysisException:
            return None

    def due(self, queries: DataFrame) -> DataFrame:
        """The queries that no fetch has listed."""
        done = self._table(self.done_path)
        return queries if done is None else queries.join(done.select("category", "query"), ["category", "query"], "left_anti").select(*queries.columns)

    def record(self, queries: DataFrame, results: DataFrame) -> None:
        """Write the results of a fetch, then list its queries."""
        mark = F.lit(uuid.uuid4().hex)
        results.withColumn("fetch", mark).write.mode("append").parquet(self.results_path)
        queries.select("category", "query", F.current_timestamp().alias("fetched"), mark.alias("fetch")).coalesce(1).write.mode("append").parquet(self.done_path)

    def results(self, queries: DataFrame) -> DataFrame | None:
        """The results of listed fetches for these queries."""
        found, done = self._table(self.results_path), self._table(self.done_path)
        if found is None or done is None:
            return None
        fetches = done.join(queries.select("category", "query"), ["category", "query"], "left_semi").select("fetch").distinct()
        return found.join(fetches, "fetch", "left_semi").drop("fetch")


def fetched(queries: DataFrame, fetch: Callable[[DataFrame], DataFrame], ledger: str | None = None) -> DataFrame:
    """Results of the queries; with a ledger category by category, each written before the next one is asked for."""
    if ledger is None:
        return fetch(queries)
    book = FetchLedger(queries.sparkSession, ledger)
    queries = durable(queries)
    due = durable(book.due(queries))
    # one row for each of the listed categories
    for category in sorted(r["category"] for r in due.select("category").distinct().collect()):
        own = due.where(F.col("category") == category)
        book.record(own, fetch(own))
    found = book.results(queries)
    return fetch(queries.limit(0)) if found is None else found


def backfill(articles: DataFrame, fetch: Callable[[DataFrame], DataFrame], as_of: Column, least: int = params.BACKFILL_MIN_ITEMS,
             days: int = params.BACKFILL_DAYS, threshold: float = params.TITLE_THRESHOLD, ledger: str | None = None) -> DataFrame:
    """Articles with those found for lacking categories, deduplicated again; unchanged if none lacks.

    ``fetch`` turns queries into results with seq and query_origin. New articles come after the old ones. A run that names the
    ``ledger`` (a folder) of one that failed goes on where that one stopped.
    """
    lacking = deficits(articles, least=least)
    if lacking.isEmpty():
        return articles
    queries = backfill_queries(lacking)
    found = recent(to_articles(with_queries(fetched(queries, fetch, ledger), queries)), as_of, 24 * days)
    last = articles.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    return dedup_by_title(dedup_by_url(articles.unionByName(found.withColumn("seq", F.col("seq") + F.lit(int(last) + 1)))), threshold)
