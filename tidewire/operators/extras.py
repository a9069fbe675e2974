"""Limits for a fuller report: an optional extra that the daily run does not use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.scoring import ITEMS_PER_COMPANY, SECTION_QUOTAS
from ..functions.text import numeric_core
from .graph import durable
from .select import event_articles


def limited_sections(items: DataFrame, quotas: dict[str, tuple[int, int]] = SECTION_QUOTAS) -> DataFrame:
    """The best items of each section up to its quota; items have section_id, importance_score and seq."""
    most = F.lit(0)
    for name, (_, n) in quotas.items():
        most = F.when(F.col("section_id") == name, F.lit(n)).otherwise(most)
    of_section = Window.partitionBy("section_id").orderBy(F.desc("importance_score"), "seq")
    top = max(n for _, n in quotas.values())
    ranked = items.withColumn("__n", F.row_number().over(of_section)).where(F.col("__n") <= top)
    return ranked.where(F.col("__n") <= most).drop("__n")


def limited_companies(items: DataFrame, most: int = ITEMS_PER_COMPANY, max_rounds: int = 1000) -> DataFrame:
    """Items in order of score of which each company has ``most`` at best; items have companies_mentioned.

    An item is taken if none of its companies has ``most`` taken ones before it. In rounds: an open item is refused once a company
    has ``most`` taken ones, and taken once it is among the first that still have room at each of its companies, so every open item
    before it has its room too. Each round decides the best open item at least, and in general most items. Of a company
    with very many items only the first ``most`` open ones travel to where they are ranked.
    """
    rank = F.struct((-F.coalesce("importance_score", F.lit(0.0))).alias("score"), "seq")
    names = F.array_distinct(F.coalesce("companies_mentioned", F.array().cast("array<string>")))
    state = durable(items.select("seq", rank.alias("rank"), names.alias("names"), (F.size(names) == 0).alias("taken")))
    of_company = Window.partitionBy("company").orderBy("rank")
    for _ in range(max_rounds):
        have = state.where("taken").select(F.explode("names").alias("company")).groupBy("company").agg(F.count("*").cast("int").alias("have"))
        full = have.where(F.col("have") >= most)
        open_ = state.where("NOT taken")
        refused = open_.select("seq", F.explode("names").alias("company")).join(full, "company", "left_semi").select("seq").distinct()
        left = open_.join(refused, "seq", "left_anti")
        pairs = left.select("seq", "rank", F.size("names").alias("n"), F.explode("names").alias("company"))
        first = pairs.withColumn("place", F.row_number().over(of_company)).where(F.col("place") <= most)
        fits = first.join(have, "company", "left").where(F.col("place") + F.coalesce("have", F.lit(0)) <= most)
        take = fits.groupBy("seq").agg(F.count("*").alias("rooms"), F.first("n").alias("n")).where("rooms = n").select(F.col("seq").alias("chosen"))
        decided = left.join(take, F.col("seq") == F.col("chosen"), "left").select("seq", "rank", "names", F.col("chosen").isNotNull().alias("taken"))
        counted = Observation()
        state = durable(state.where("taken").union(decided).observe(counted, F.count_if(~F.col("taken")).alias("open")))
        if not counted.get["open"]:
            return items.join(state.where("taken").select("seq"), "seq", "left_semi")
    raise RuntimeError("companies did not settle")


def number_support(analyses: DataFrame, events: DataFrame, articles: DataFrame, least: int = 2) -> DataFrame:
    """(seq, label, value, n_domains, single_source) for each figure of (seq, key_data): how many domains of its event give that number.

    Articles of one domain, or with the same text, are one source: what is copied confirms nothing. A figure below ``least``
    sources is single-sourced and its credibility to be lowered; entries without a digit are no figures.
    """
    figures = analyses.select("seq", F.explode("key_data").alias("k")).select("seq", F.col("k.label").alias("label"), F.col("k.value").alias("value"))
    figures = figures.where(F.rlike(F.coalesce("value", F.lit("")), F.lit(r"\d"))).withColumn("core", numeric_core(F.col("value")))
    texts = event_articles(events, articles, ["source_domain", "title", "snippet"])
    said = F.concat_ws(" ", "title", "snippet")
    voices = texts.groupBy("seq", said.alias("said")).agg(F.min("source_domain").alias("source_domain"))
    # digits beside the number would make it another one
    there = F.rlike("said", F.concat(F.lit(r"(?<![\d.,])\Q"), F.col("core"), F.lit(r"\E(?![.,]?\d)")))
    met = figures.join(voices, "seq", "left").groupBy("seq", "label", "value").agg(F.count_distinct(F.when(there, F.col("source_domain"))).alias("n_domains"))
    return met.withColumn("single_source", F.col("n_domains") < least)


def shortfalls(items: DataFrame, quotas: dict[str, tuple[int, int]] = SECTION_QUOTAS) -> DataFrame:
    """(section_id, n, least) of the sections below their least number."""
    wanted = items.sparkSession.createDataFrame([(k, a) for k, (a, _) in quotas.items()], "section_id string, least int")
    counts = items.groupBy("section_id").agg(F.count("*").alias("n"))
    return wanted.join(counts, "section_id", "left").select("section_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "least").where("n < least")
