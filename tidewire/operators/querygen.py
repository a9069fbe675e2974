"""Search queries from a strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..functions.text import time_qualified

COLUMNS = ("batch_id", "batch_pos", "pos", "query", "category", "max_results")


def cartesian_queries(batches: DataFrame, companies: DataFrame, events: DataFrame) -> DataFrame:
    """Each company's first alias (else its name) with each event keyword of the same batch, companies first.

    Both sides are configuration lists of one batch, joined on the batch.
    """
    name = F.coalesce(F.try_element_at("aliases", F.lit(1)), F.col("name"))
    rows = companies.join(events, "batch_id").join(batches.where("strategy = 'cartesian'"), "batch_id")
    return rows.select(
        "batch_id", "batch_pos", (F.col("company_pos") * F.lit(1_000_000) + F.col("event_pos")).alias("pos"),
        F.concat_ws(" ", name, F.col("keyword")).alias("query"), F.coalesce("event_category", "batch_id").alias("category"), "max_results",
    )


def list_queries(batches: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries that are listed as such; the category defaults to the batch."""
    rows = queries.join(batches.where("strategy = 'list'"), "batch_id")
    return rows.select("batch_id", "batch_pos", "pos", "query", F.coalesce("query_category", "batch_id").alias("category"), "max_results")


def generate(batches: DataFrame, companies: DataFrame, events: DataFrame, queries: DataFrame, as_of: Column | None = None,
             max_per_batch: int = 0, default_results: int = params.MAX_RESULTS) -> DataFrame:
    """All queries of the enabled batches in order of batch and position, with words for freshness if as_of is given."""
    enabled = batches.where(F.coalesce("enabled", F.lit(True))).withColumn("max_results", F.coalesce("max_results", F.lit(default_results)))
    rows = cartesian_queries(enabled, companies, events).unionByName(list_queries(enabled, queries))
    if max_per_batch:
        rows = first_per_batch(rows, max_per_batch)
    if as_of is not None:
        rows = rows.withColumn("query", time_qualified(F.col("query"), F.col("category"), as_of))
    return checked(rows)


def first_per_batch(rows: DataFrame, n: int) -> DataFrame:
    """The first n queries of each batch."""
    of_batch = Window.partitionBy("batch_id").orderBy("pos")
    return rows.withColumn("__n", F.row_number().over(of_batch)).where(F.col("__n") <= n).drop("__n")


def checked(rows: DataFrame) -> DataFrame:
    """Fail on queries that are too long or ask for too many or too few results."""
    ok = (F.length("query") <= params.MAX_QUERY_CHARS) & F.col("max_results").between(1, params.MAX_RESULTS)
    return rows.withColumn("query", F.when(ok, F.col("query")).otherwise(F.raise_error(F.concat(F.lit("invalid query: "), F.substring("query", 1, 80)))))


def batch_summary(rows: DataFrame, default_results: int = params.MAX_RESULTS) -> DataFrame:
    """Queries per batch and the results they may bring at the default number each."""
    name = F.coalesce(F.nullif(F.col("batch_id"), F.lit("")), F.lit("unknown"))
    counts = rows.groupBy(name.alias("batch_id")).agg(F.count("*").alias("n_queries"))
    return counts.withColumn("max_total_results", F.col("n_queries") * F.lit(default_results))


def pick_balanced(rows: DataFrame, n: int) -> DataFrame:
    """n queries: of every category the first max(1, ceil(n / categories)), categories in order of appearance."""
    spans = rows.groupBy("category").agg(F.min("seq").alias("first_seq"))
    categories = spans.count()
    share = max(1, -(-n // max(1, categories)))
    of_category = Window.partitionBy("category").orderBy("seq")
    ranked = rows.withColumn("__n", F.row_number().over(of_category)).where(F.col("__n") <= share)
    return ranked.join(spans, "category").orderBy("first_seq", "seq").limit(n).drop("__n", "first_seq")
