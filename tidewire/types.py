"""Schemas of the records that pass between operators."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


SEARCH_QUERY = _struct(
    "seq bigint, query string, max_results int, domain string, sub_domain string, sub_domain_params map<string,string>, category string, batch_id string"
)
SEARCH_RESULT = _struct(
    "seq bigint, result_id string, title string, url string, source_domain string, source_name string, snippet string, content string, "
    "published_at timestamp, fetched_at timestamp, language string, country string, author string, score double, query_origin string"
)
ARTICLE = _struct(
    "seq bigint, article_id string, title string, url string, source_domain string, source_name string, content string, snippet string, summary string, "
    "category string, published_at timestamp, fetched_at timestamp, language string, country string, author string, search_query string, "
    "search_batch string, source_reliability string, result_count int"
)
EVENT = _struct(
    "seq bigint, event_id string, canonical_title string, article_ids array<string>, article_count int, event_type_guess string, "
    "earliest_published_at timestamp, latest_published_at timestamp, source_domains array<string>, companies_mentioned array<string>, "
    "cluster_score double, created_at timestamp"
)
HISTORY = _struct("report_date date, file string, pos int, canonical_title string")
ANALYSIS = _struct(
    "seq bigint, event_id string, is_valid boolean, category string, importance_score double, title string, lead string, details string, summary string, "
    "analysis string, key_data array<struct<label:string,value:string>>, source_names array<string>, topics array<string>, published_at string"
)
KEY_DATA = _struct("label string, value string, source_indexes array<int>")
REPORT_SOURCE = _struct("name string, url string, is_official boolean")
REPORT_ITEM = _struct(
    "item_id string, event_id string, rank int, category string, title string, lead string, key_data array<struct<label:string,value:string>>, "
    "details string, analysis string, sources array<struct<name:string,url:string,is_official:boolean>>, word_count int"
)
RUN_REPORT = _struct("mode string, started_at timestamp, finished_at timestamp, elapsed_sec double, success boolean, stages map<string,double>, flags array<string>, counts map<string,bigint>")

EXPORTED = {
    "SearchResultItem": SEARCH_RESULT, "RawNewsArticle": ARTICLE, "NewsEvent": EVENT, "ReportItem": REPORT_ITEM,
}
