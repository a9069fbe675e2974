"""Search responses to articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions.dates import published_date
from ..functions.text import clean_snippet, language, strip
from ..functions.urls import article_id, canonical_url, reliability, result_id, source_domain

def parse_results(responses: DataFrame, as_of: Column, text: str = "markdown") -> DataFrame:
    """One row for each result in a Markdown response; the other columns stay, total_found and pos are added."""
    total = F.coalesce(F.nullif(F.regexp_extract(text, params.RESULT_COUNT, 1), F.lit("")).cast("int"), F.lit(0))
    rows = responses.withColumn("total_found", total)
    keep = [F.col(c) for c in rows.columns if c != text]
    rows = rows.select(*keep, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(params.RESULT_PATTERN), F.lit(0))).alias("pos", "__m"))
    g = lambda k: strip(F.regexp_extract("__m", params.RESULT_PATTERN, k))
    rows = rows.withColumns({"title": g(1), "url": g(2)}).withColumn("snippet", clean_snippet(g(3), F.col("title")))
    return rows.withColumns({
        "source_domain": source_domain(F.col("url")),
        "result_id": result_id(F.col("url"), F.col("title")),
        "published_at": published_date(F.col("url"), F.concat_ws(" ", F.col("title"), F.col("snippet")), as_of),
    }).drop("__m")


def split_batches(responses: DataFrame, text: str = "markdown") -> DataFrame:
    """One row for each query block of a batched response: pos, query_text and its Markdown; other columns stay."""
    blocks = F.split(F.col(text), params.QUERY_HEAD, -1)
    leads = F.startswith(F.col(text), F.lit(params.FIRST_QUERY))
    # without the prefix the first block is dropped, if it is not alone
    drop = (~leads & (F.size(blocks) > 1)) | (leads & (blocks[0] == ""))
    kept = F.filter(F.when(drop, F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(1)))).otherwise(blocks), lambda b: strip(b) != "")
    keep = [F.col(c) for c in responses.columns if c != text]
    rows = responses.select(*keep, F.posexplode(kept).alias("pos", "__b"))
    line = F.locate("\n", F.col("__b"))
    query = strip(F.when(line > 0, F.substring("__b", F.lit(1), line - 1)).otherwise(F.col("__b")))
    return rows.withColumns({"query_text": query, text: F.when(line > 0, F.substring("__b", line, F.length("__b"))).otherwise(F.lit(""))}).drop("__b")


def match_batches(queries: DataFrame, blocks: DataFrame, batch_size: int = params.SEARCH_BATCH) -> DataFrame:
    """Queries (dense seq from 0) with the answer of their batch at their position; error where there is none."""
    slots = queries.withColumns({"batch_no": F.floor(F.col("seq") / batch_size).cast("long"), "__pos": (F.col("seq") % batch_size).cast("int")})
    found = blocks.select(F.col("batch_no").cast("long").alias("__batch"), F.col("pos").alias("__at"), "markdown")
    met = slots.join(found, (F.col("batch_no") == F.col("__batch")) & (F.col("__pos") == F.col("__at")), "left")
    error = F.when(F.col("markdown").isNull(), F.lit("No result in batch response"))
    return met.withColumn("error", error).drop("__batch", "__at", "__pos")


def batch_stats(responses: DataFrame, results: DataFrame) -> DataFrame:
    """Per batch: queries, successes, failures, results and distinct results.

    ``responses`` has (batch_id, error), ``results`` (batch_id, result_id).
    """
    a = responses.groupBy("batch_id").agg(
        F.count("*").alias("total_queries"), F.count_if(F.col("error").isNull()).alias("success_queries"), F.count_if(F.col("error").isNotNull()).alias("failed_queries")
    )
    b = results.groupBy("batch_id").agg(F.count("*").alias("total_results"), F.count_distinct("result_id").alias("unique_results"))
    zero = F.lit(0).cast("long")
    return a.join(b, "batch_id", "left").withColumns({k: F.coalesce(k, zero) for k in ("total_results", "unique_results")})


def with_queries(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Results with category, batch and text of the query they came from; of equal queries the last counts."""
    last = queries.groupBy(F.col("query").alias("__query")).agg(F.max_by(F.struct(F.col("category"), F.col("batch_id")), "seq").alias("__q"))
    own = [c for c in results.columns if c not in ("category", "search_batch", "search_query")]
    joined = results.select(*own).join(last, F.col("query_origin") == F.col("__query"), "left")
    return joined.select(
        *own, F.col("__q.category").alias("category"), F.col("__q.batch_id").alias("search_batch"), F.coalesce("__query", "query_origin").alias("search_query")
    )


def to_articles(results: DataFrame) -> DataFrame:
    """Results, joined with their queries, as articles."""
    url = canonical_url(F.col("url"))
    title, snippet = strip(F.col("title")), strip(F.coalesce("snippet", F.lit("")))
    opt = lambda c, kind="string": F.col(c).cast(kind) if c in results.columns else F.lit(None).cast(kind)
    return results.select(
        "seq", article_id(url).alias("article_id"), title.alias("title"), url.alias("url"),
        F.col("source_domain"), opt("source_name").alias("source_name"),
        F.coalesce(F.nullif(opt("content"), F.lit("")), snippet).alias("content"), snippet.alias("snippet"), F.lit(None).cast("string").alias("summary"),
        opt("category").alias("category"), opt("published_at", "timestamp").alias("published_at"), opt("fetched_at", "timestamp").alias("fetched_at"),
        language(F.concat_ws(" ", F.col("title"), F.coalesce("snippet", F.lit("")))).alias("language"), opt("country").alias("country"), opt("author").alias("author"),
        opt("search_query").alias("search_query"), opt("search_batch").alias("search_batch"),
        reliability(F.col("source_domain")).alias("source_reliability"), F.lit(1).alias("result_count"),
    )
