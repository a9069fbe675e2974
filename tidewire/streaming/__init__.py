"""Streaming forms of the daily operators: an extension beyond the batch run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import article_id, canonical_url
from ..operators.history import split_seen
from ..types import ARTICLE


def article_stream(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines of articles as they arrive."""
    return spark.readStream.schema(ARTICLE).json(folder)


def first_sightings(articles: DataFrame, delay: str = "48 hours") -> DataFrame:
    """The first row of each article within the delay; state older than the watermark is dropped."""
    named = articles.withColumn("article_id", F.coalesce("article_id", article_id(canonical_url(F.col("url")))))
    return named.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["article_id"])


def counts_by_category(articles: DataFrame, window: str = "1 hour", delay: str = "48 hours") -> DataFrame:
    """Articles by window and category; late rows beyond the delay are dropped."""
    return articles.withWatermark("fetched_at", delay).groupBy(F.window("fetched_at", window).alias("w"), "category").agg(F.count("*").alias("n"))


def suppress_seen(events: DataFrame, history_path: str, sink_path: str, checkpoint: str):
    """Write the events of each micro-batch that the history table does not cover; returns the query."""

    def write(batch: DataFrame, number: int) -> None:
        history = batch.sparkSession.read.parquet(history_path)
        fresh, _ = split_seen(batch, history)
        fresh.withColumn("batch", F.lit(number)).write.mode("append").parquet(sink_path)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
