"""Collection, the daily run and its report, composed of operators.

Each step takes and returns DataFrames and declares its plan only; steps whose result is used several times are
checkpointed. Language models are functions from a table of contexts to a table of analyses.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import params
from ..functions.dates import report_date
from ..operators import backfill as fill
from ..operators import report as rep
from ..operators.cluster import by_heat, cluster_articles
from ..operators.dedup import dedup_by_title, dedup_by_url
from ..operators.filters import enough, long_enough, recent, undated_last, valid_analyses
from ..operators.graph import durable
from ..operators.history import split_seen
from ..operators.search import to_articles, with_queries
from ..operators.select import article_order, balanced, majority_category
from ..types import RUN_REPORT


class RunReport:
    """Seconds by stage, flags and counts of a run; one row, written whether it succeeds or not."""

    def __init__(self, mode: str):
        self.mode, self.began = mode, datetime.now(UTC)
        self.stages: dict[str, float] = {}
        self.flags: list[str] = []
        self.counts: dict[str, int] = {}
        self.success = False
        self.watched: dict[str, Observation] = {}

    def watch(self, name: str) -> Observation:
        """Where the counts of a step will be observed; ``take`` adds them once the step's rows are written."""
        self.watched[name] = Observation()
        return self.watched[name]

    def take(self, name: str) -> None:
        """Add what was observed under ``name`` to the counts, as name_count."""
        if (seen := self.watched.pop(name, None)) is not None:
            self.add(name, seen.get)

    def add(self, name: str, counts: dict[str, int]) -> None:
        for k, v in counts.items():
            self.counts[f"{name}_{k}"] = self.counts.get(f"{name}_{k}", 0) + int(v or 0)

    @contextmanager
    def stage(self, name: str):
        began = time.time()
        try:
            yield
        finally:
            self.stages[name] = round(time.time() - began, 1)

    def row(self, spark: SparkSession) -> DataFrame:
        now = datetime.now(UTC)
        values = (self.mode, self.began, now, (now - self.began).total_seconds(), self.success, self.stages, self.flags, self.counts)
        return spark.createDataFrame([values], RUN_REPORT)


def collect(results: DataFrame, queries: DataFrame, as_of: Column, *, url_dedup: bool = True, title_dedup: bool = True, threshold: float = params.TITLE_THRESHOLD,
            max_age_hours: int = params.COLLECT_MAX_AGE_HOURS, min_length: int = 0) -> DataFrame:
    """Search results to articles: recent, long enough, deduplicated; ``rank_key`` columns order them."""
    articles = long_enough(undated_last(recent(to_articles(with_queries(results, queries)), as_of, max_age_hours)), min_length)
    if url_dedup:
        articles = dedup_by_url(articles)
    if title_dedup:
        articles = dedup_by_title(durable(articles), threshold)
    return articles


def in_order(articles: DataFrame) -> DataFrame:
    """Articles from the most reliable and most often found on."""
    return articles.orderBy(*article_order())


def fresh_events(articles: DataFrame, as_of: Column, history: DataFrame | None = None, threshold: float = params.CLUSTER_THRESHOLD, by: str | None = None,
                 guard: Callable[[int], None] | None = None, found: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Events of the articles, those of earlier days apart."""
    events = durable(cluster_articles(articles, threshold, by, as_of, guard=guard, found=found))
    return (events, None) if history is None else split_seen(events, history)


def brief(
    articles: DataFrame,
    as_of: Column,
    *,
    history: DataFrame | None = None,
    analyse: Callable[[DataFrame], DataFrame] | None = None,
    verify: Callable[[DataFrame], DataFrame] | None = None,
    summarise: Callable[[list[str]], str | None] | None = None,
    texts: DataFrame | None = None,
    max_events: int | None = None,
    run: RunReport | None = None,
    zone: str = params.REPORT_TIMEZONE,
) -> dict[str, DataFrame]:
    """From articles to events, the selection and, with a model, the report.

    ``analyse`` maps (seq, event_id, context) to analyses without seq order of their own; ``verify`` maps
    (seq, title, details, source_text) of high-scored ones to corrections. Returns the tables made. Counts that the steps observe
    (articles, the largest group of titles that is clustered in one go, and those of ``run.watch("analyse")`` and
    ``run.watch("verify")``) reach the run report; the guard against too few articles reads the first of them.
    """
    run = run or RunReport("brief")

    def guard(n: int) -> None:
        run.counts["articles"] = n
        try:
            enough(n)
        except RuntimeError as error:
            run.flags.append(str(error))
            raise

    out: dict[str, DataFrame] = {}
    with run.stage("cluster"):
        found: dict[str, int] = {}
        events, seen = fresh_events(articles, as_of, history, guard=guard, found=found)
        run.add("cluster", found)
        out["events"] = durable(majority_category(events, articles))
        if seen is not None:
            out["seen"] = seen
    with run.stage("select"):
        out["selected"] = durable(balanced(out["events"], max_events or params.MAX_EVENTS))
    if analyse is None:
        run.success = True
        return out
    with run.stage("analyse"):
        full = rep.full_texts(out["selected"], articles, texts) if texts is not None else None
        contexts = rep.event_contexts(out["selected"], articles, full).join(out["selected"].select("seq", "event_id"), "seq")
        made = durable(valid_analyses(analyse(contexts)))
        run.take("analyse")
        if made.isEmpty():
            raise RuntimeError("no valid analysis")
        grounded = rep.ground_analyses(made, rep.source_texts(out["selected"], articles, full))
        if verify is not None:
            due = grounded.where((F.col("importance_score") >= params.RECHECK_SCORE) & (F.col("source_text") != ""))
            # written once, so that no check is asked for again
            checks = durable(verify(due.select("seq", "title", "details", "source_text")))
            run.take("verify")
            grounded = rep.apply_checks(grounded, checks)
        out["analyses"] = durable(grounded)
    with run.stage("report"):
        plain = out["analyses"].drop("flag", "check_flags", "source_text")
        top = durable(rep.top_news(plain))
        items = rep.section_items(plain, top)
        out["items"] = durable(rep.report_items(items, rep.sources(out["selected"], articles, plain)))
        titles = [r["title"] for r in top.orderBy("rank").limit(params.SUMMARY_TITLES).collect()]
        summary = summarise(titles) if summarise and top.count() >= params.TOP_MIN_ITEMS else None
        flags = out["analyses"].select("seq", "flag")
        if "check_flags" in out["analyses"].columns:
            flags = flags.union(out["analyses"].select("seq", F.explode("check_flags").alias("flag")))
        out["report"] = rep.daily_report(out["items"], report_date(as_of, zone), as_of, F.lit(summary).cast("string"), flags.where("flag IS NOT NULL"), zone)
        out["left_out"] = rep.left_out(plain, items)
    run.success = True
    return out


def complete(articles: DataFrame, fetch: Callable[[DataFrame], DataFrame], as_of: Column, ledger: str | None = None) -> DataFrame:
    """Articles with lacking categories filled up; see ``backfill`` for the ledger."""
    return fill.backfill(articles, fetch, as_of, ledger=ledger)


def hottest(events: DataFrame, n: int = 10) -> DataFrame:
    return events.orderBy(*by_heat()).limit(n)
