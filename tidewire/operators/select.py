"""Choice of the events to analyse and order of articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..functions.urls import reliability_weight
from .cluster import by_heat


def article_order() -> list[Column]:
    """Reliability, number of results, snippet length, then appearance."""
    return [F.desc(reliability_weight(F.col("source_reliability"))), F.desc("result_count"), F.desc(F.length(F.coalesce("snippet", F.lit("")))), F.col("seq")]


def article_map(articles: DataFrame) -> DataFrame:
    """One row for each article_id, the last of equal ids."""
    rest = [c for c in articles.columns if c != "article_id"]
    best = articles.groupBy("article_id").agg(F.max_by(F.struct(*rest), "seq").alias("r"))
    return best.select("article_id", "r.*")


def event_articles(events: DataFrame, articles: DataFrame, columns: list[str], first: int | None = None) -> DataFrame:
    """(seq, pos, columns of the article) for the known articles of events, of the first ids if so wanted."""
    ids = F.slice("article_ids", 1, first) if first else F.col("article_ids")
    members = events.select("seq", F.posexplode(ids).alias("pos", "article_id"))
    return members.join(article_map(articles).select("article_id", *columns), "article_id")


def majority_category(events: DataFrame, articles: DataFrame, default: str = params.DEFAULT_CATEGORY) -> DataFrame:
    """Events with the most frequent category of their articles, of equals the one met first."""
    votes = event_articles(events, articles, ["category"]).where(F.coalesce("category", F.lit("")) != "")
    counts = votes.groupBy("seq", "category").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = counts.groupBy("seq").agg(F.max_by("category", F.struct("n", -F.col("first"))).alias("category"))
    return events.join(best, "seq", "left").withColumn("category", F.coalesce("category", F.lit(default)))


def balanced(events: DataFrame, max_total: int = params.MAX_EVENTS, categories=params.QUOTA_CATEGORIES) -> DataFrame:
    """max_total events: a few of each category first, then the hottest of the rest; ``rank`` is their order.

    The first step ranks within categories and keeps one or two of each; the second is a top-k. What is ordered
    as a whole is bounded by twice max_total.
    """
    quota = 2 if max_total >= 12 else 1
    place = F.lit(None).cast("int")
    for k, c in enumerate(categories):
        place = F.when(F.col("category") == c, F.lit(k)).otherwise(place)
    of_category = Window.partitionBy("category").orderBy(*by_heat())
    first = (
        events.where(F.col("category").isin(*categories))
        .withColumn("__rn", F.row_number().over(of_category))
        .where(F.col("__rn") <= quota)
        .withColumns({"__phase": F.lit(0), "__cat": place})
        .orderBy("__cat", "__rn")
        .limit(max_total)
    )
    rest = (
        events.join(first.select("event_id").distinct(), "event_id", "left_anti")
        .orderBy(*by_heat())
        .limit(max_total)
        .withColumns({"__rn": F.lit(0), "__phase": F.lit(1), "__cat": F.lit(0)})
    )
    both = first.unionByName(rest).orderBy("__phase", "__cat", "__rn", *by_heat()).limit(max_total)
    whole = Window.orderBy("__phase", "__cat", "__rn", *by_heat())
    return both.withColumn("rank", F.row_number().over(whole)).drop("__phase", "__cat", "__rn")


def unselected(events: DataFrame, selected: DataFrame) -> DataFrame:
    return events.join(selected.select("event_id").distinct(), "event_id", "left_anti")
