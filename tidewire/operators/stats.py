"""Counts over articles and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collection_stats(articles: DataFrame) -> DataFrame:
    """(dimension, value, n): articles by language, reliability and category, in one pass."""
    unknown = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), unknown(c).alias("value")) for d, c in (("language", "language"), ("reliability", "source_reliability"), ("category", "category"))])
    return articles.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def category_counts(articles: DataFrame) -> DataFrame:
    return articles.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"))


def event_stats(events: DataFrame) -> DataFrame:
    """Events, and those with several sources."""
    return events.agg(F.count("*").alias("events"), F.count_if(F.col("article_count") > 1).alias("multi_source"))
