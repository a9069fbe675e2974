"""Commands: info, queries, collect, brief and run. Exit code 1 on failure.

``collect`` searches and writes articles; ``brief`` starts from an article file; ``run`` does both and, with a model, writes the
report and its page. Services and the report's time zone come from the environment (see ``settings``).
"""

from __future__ import annotations

import argparse
import sys
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dates import report_date
from .operators.filters import check_searches
from .operators.graph import durable
from .operators.history import recent_titles
from .operators.querygen import batch_summary, generate
from .operators.stats import collection_stats
from .plans import daily
from .session import session
from .settings import Settings
from .sources import files, models, search
from .sources.strategy import load_yaml, strategy


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tidewire", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    planned = argparse.ArgumentParser(add_help=False)
    planned.add_argument("strategy")
    planned.add_argument("--batch")
    planned.add_argument("--queries-per-batch", type=int, default=0)
    clock = argparse.ArgumentParser(add_help=False)
    clock.add_argument("--as-of", help="UTC time, now by default")
    written = argparse.ArgumentParser(add_help=False)
    written.add_argument("--history", help="event table of earlier days; the fresh events are appended")
    written.add_argument("--max-events", type=int)
    written.add_argument("--report", help="folder of the report; needs a model")
    written.add_argument("--prompt", help="file with the prompt of the analysis")
    written.add_argument("--check-prompt", help="file with the prompt of the second check")
    written.add_argument("--quarantine", help="table of article records that could not be read")
    info = commands.add_parser("info", help="queries per batch of a strategy")
    info.add_argument("strategy")
    commands.add_parser("queries", help="the queries of a strategy", parents=[planned])
    collect = commands.add_parser("collect", help="search and write articles", parents=[planned, clock])
    collect.add_argument("--out", required=True)
    collect.add_argument("--ledger", help="folder that lets a broken backfill go on")
    brief = commands.add_parser("brief", help="events, selection and report of an article file", parents=[clock, written])
    brief.add_argument("--from-file", required=True)
    run = commands.add_parser("run", help="collect, then brief", parents=[planned, clock, written])
    run.add_argument("--ledger", help="folder that lets a broken backfill go on")
    return parser


def planned_queries(spark: SparkSession, args: argparse.Namespace, clock: Column) -> DataFrame | None:
    """The strategy's queries, of one batch if so wanted; None if there is no such batch."""
    s = strategy(spark, load_yaml(args.strategy))
    rows = generate(s.batches, s.companies, s.events, s.queries, clock, getattr(args, "queries_per_batch", 0))
    if batch := getattr(args, "batch", None):
        names = sorted(r["batch_id"] for r in s.batches.select("batch_id").collect())
        if batch not in names:
            print("batches: " + ", ".join(names), file=sys.stderr)
            return None
        rows = rows.where(F.col("batch_id") == batch)
    return rows


def numbered(queries: DataFrame) -> DataFrame:
    """Queries with a dense seq from 0, by batch and position; a strategy's list is small."""
    from pyspark.sql import Window

    return durable(queries.withColumn("seq", F.row_number().over(Window.orderBy("batch_pos", "pos")).cast("long") - 1))


def collected(queries: DataFrame, settings: Settings, clock: Column, run: daily.RunReport, ledger: str | None = None, service: search.Service | None = None) -> DataFrame:
    """Articles of the queries' results, with lacking categories filled up."""
    service = service or (search.RpcService(settings.search_url, settings.search_key, timeout=settings.timeout) if settings.search_url else None)
    if service is None:
        raise RuntimeError("no search service: set TIDEWIRE_SEARCH_URL")
    with run.stage("search"):
        queries, counts = numbered(queries), {}
        _, results = search.search(queries, service, clock, counts=counts)
        run.add("search", counts)
        check_searches(counts)
        if settings.second_url:
            more = search.supplement(queries, search.QueryService(settings.second_url, settings.second_key))
            last = results.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
            more = more.withColumns({"seq": F.col("seq") + F.lit(int(last) + 1), "fetched_at": clock})
            results = results.unionByName(durable(more), allowMissingColumns=True)
    with run.stage("collect"):
        articles = durable(daily.collect(results, queries, clock))

    def fetch(due: DataFrame) -> DataFrame:
        found: dict[str, int] = {}
        _, more = search.search(numbered(due.withColumns({"batch_pos": F.lit(0), "pos": F.col("seq")})), service, clock, counts=found)
        run.add("backfill", found)
        return more

    with run.stage("backfill"):
        return durable(daily.complete(articles, fetch, clock, ledger))


def briefed(spark: SparkSession, articles: DataFrame, settings: Settings, clock: Column, args: argparse.Namespace, run: daily.RunReport, send: models.Send | None = None) -> dict[str, DataFrame]:
    """Events, selection and, with a model, the report; the fresh events join the history."""
    today = str(spark.range(1).select(report_date(clock, settings.zone)).first()[0])
    history = None
    if args.history:
        try:
            history = recent_titles(files.read_event_table(spark, args.history), clock, F.lit(today).cast("date"))
        except AnalysisException as error:  # the first day has no table yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
    send = send or (models.chat_service(settings.model_url, settings.model, settings.model_key) if settings.model_url else None)
    steps = {}
    if send is not None:
        steps = {
            "analyse": partial(models.analyse, send=send, prompt=files.load_prompt(args.prompt) if args.prompt else "", watch=run.watch("analyse")),
            "verify": partial(models.verify, send=send, prompt=files.load_prompt(args.check_prompt) if args.check_prompt else "", watch=run.watch("verify")),
        }
    out = daily.brief(articles, clock, history=history, max_events=args.max_events or None, run=run, zone=settings.zone, **steps)
    if args.history:
        files.write_events(out["events"], args.history, today)
    if args.report and "report" in out:
        files.write_report(out["report"], f"{args.report}/report_date={today}")
        files.save_html(files.render_html(out["report"]), args.report, today)
    return out


def main(argv: list[str] | None = None, *, settings: Settings | None = None, service: search.Service | None = None, send: models.Send | None = None) -> int:
    """Run a command; services may be handed in instead of set from outside."""
    args = _parser().parse_args(argv)
    settings = settings or Settings.from_environment()
    spark = session()
    clock = F.lit(args.as_of).cast("timestamp") if getattr(args, "as_of", None) else F.current_timestamp()
    if args.command in ("info", "queries"):
        rows = planned_queries(spark, args, clock)
        if rows is None:
            return 1
        if args.command == "info":
            batch_summary(rows).orderBy("batch_id").show(1000, False)
        else:
            rows.orderBy("batch_pos", "pos").select("batch_id", "category", "query").show(10_000, False)
        return 0
    run = daily.RunReport(args.command)
    try:
        if args.command in ("collect", "run"):
            queries = planned_queries(spark, args, clock)
            if queries is None:
                return 1
            articles = collected(queries, settings, clock, run, args.ledger, service)
        else:
            articles, rejected = files.scan_articles(spark, args.from_file)
            day = str(spark.range(1).select(report_date(clock, settings.zone)).first()[0])
            counts = files.quarantine(rejected, args.quarantine, day) if args.quarantine else {"records": rejected.count()}
            run.add("rejected", counts)
        if args.command == "collect":
            files.write_articles(articles, args.out)
            run.success = True
            return 0
        collection_stats(articles).orderBy("dimension", F.desc("n")).show(100, False)
        out = briefed(spark, articles, settings, clock, args, run, send)
        out["selected"].orderBy("rank").select("rank", "category", "article_count", "canonical_title").show(100, False)
        return 0
    except RuntimeError as error:
        run.flags.append(str(error))
        print(error, file=sys.stderr)
        return 1
    finally:
        run.row(spark).show(1, False)


if __name__ == "__main__":
    sys.exit(main())
