"""Filters and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import params


def recent(articles: DataFrame, as_of: Column, max_age_hours: int = params.DAILY_MAX_AGE_HOURS) -> DataFrame:
    """Articles of the last hours and undated ones."""
    cutoff = as_of - F.make_dt_interval(F.lit(0), F.lit(max_age_hours), F.lit(0), F.lit(0))
    return articles.where(F.col("published_at").isNull() | (F.col("published_at") >= cutoff))


def undated_last(articles: DataFrame) -> DataFrame:
    """A new order in which undated articles follow the dated ones; seq stays unique but not dense."""
    return articles.withColumn("seq", F.when(F.col("published_at").isNull(), F.col("seq") + F.lit(1 << 62)).otherwise(F.col("seq")))


def long_enough(articles: DataFrame, min_length: int) -> DataFrame:
    """Articles whose snippet has ``min_length`` characters; 0 keeps all."""
    return articles if min_length <= 0 else articles.where(F.length(F.coalesce("snippet", F.lit(""))) >= min_length)


def valid_analyses(analyses: DataFrame) -> DataFrame:
    """Analyses that do not call themselves invalid, best first."""
    score = F.coalesce("importance_score", F.lit(0.0))
    return analyses.where(F.coalesce("is_valid", F.lit(True))).withColumn("importance_score", score)


def count_searches(responses: DataFrame) -> tuple[DataFrame, Observation]:
    """Responses whose number and successes are counted when they are first written, and where these counts will be."""
    counted = Observation()
    return responses.observe(counted, F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNull()).alias("good")), counted


def check_searches(counts: dict[str, int]) -> None:
    """Fail if there were searches and none succeeded; ``counts`` has total and good, as observed."""
    if counts["total"] and not counts["good"]:
        raise RuntimeError("all searches failed")


def enough(n: int, least: int = params.MIN_ARTICLES) -> None:
    """Fail if there are too few articles to go on."""
    if n < least:
        raise RuntimeError("too few articles")
