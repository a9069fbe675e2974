"""A search strategy as tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Strategy(NamedTuple):
    batches: DataFrame
    companies: DataFrame
    events: DataFrame
    queries: DataFrame
    filtering: dict


BATCHES = "batch_id string, batch_pos int, strategy string, enabled boolean, max_results int"
COMPANIES = "batch_id string, company_pos int, name string, aliases array<string>"
EVENTS = "batch_id string, event_pos int, keyword string, event_category string"
QUERIES = "batch_id string, pos bigint, query string, query_category string"


def load_yaml(path: str) -> dict:
    """The parsed file; needs a YAML parser."""
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("reading a YAML strategy needs a YAML parser") from error
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def strategy(spark: SparkSession, config: dict) -> Strategy:
    """Tables of a configuration: search_strategy.batches with companies and event types, or listed queries."""
    root = config.get("search_strategy", config)
    batches, companies, events, queries = [], [], [], []
    for n, b in enumerate(root.get("batches", [])):
        name = b["batch_id"]
        kind = "cartesian" if b.get("strategy") == "cartesian" else "list"
        batches.append((name, n, kind, b.get("enabled", True), b.get("max_results") or root.get("defaults", {}).get("max_results_per_query")))
        companies += [(name, k, c["name"], list(c.get("aliases") or [])) for k, c in enumerate(b.get("companies") or [])]
        events += [(name, k, e["keyword"], e.get("category")) for k, e in enumerate(b.get("event_types") or [])]
        queries += [(name, k, q["query"], q.get("category")) for k, q in enumerate(b.get("queries") or [])]
    return Strategy(
        spark.createDataFrame(batches, BATCHES), spark.createDataFrame(companies, COMPANIES), spark.createDataFrame(events, EVENTS),
        spark.createDataFrame(queries, QUERIES), root.get("filtering", {}),
    )
