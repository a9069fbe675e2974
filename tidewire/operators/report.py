"""Full texts, grounding, top news, sections and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..functions.dates import report_day_start
from ..functions.jsontext import grounded, ungrounded
from ..functions.urls import is_official, item_id, report_id
from .select import event_articles


def full_texts(events: DataFrame, articles: DataFrame, texts: DataFrame, first: int = params.FULLTEXT_ARTICLES, chars: int = params.FULLTEXT_CHARS) -> DataFrame:
    """(seq, fulltexts): the texts (url, text) of an event's first articles, cut; events without any are absent."""
    members = event_articles(events, articles, ["url", "source_domain"], first)
    cut = F.substring(F.trim(F.col("text")), 1, chars)
    met = members.join(texts.select("url", cut.alias("fulltext")), "url").where("fulltext <> ''")
    item = F.struct("pos", F.col("source_domain").alias("domain"), "url", "fulltext")
    lists = met.groupBy("seq").agg(F.sort_array(F.collect_list(item)).alias("l"))
    return lists.select("seq", F.transform("l", lambda x: F.struct(x["domain"].alias("domain"), x["url"].alias("url"), x["fulltext"].alias("fulltext"))).alias("fulltexts"))


def source_texts(events: DataFrame, articles: DataFrame, fulltexts: DataFrame | None = None) -> DataFrame:
    """(seq, source_text): full texts, then snippets of the first six articles, one a line."""
    members = event_articles(events, articles, ["snippet"], params.CONTEXT_ARTICLES)
    snippets = members.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("pos", "snippet"))).alias("s"))
    rows = events.select("seq").join(snippets, "seq", "left")
    parts = F.coalesce(F.transform("s", lambda x: x["snippet"]), F.array().cast("array<string>"))
    if fulltexts is not None:
        rows = rows.join(fulltexts, "seq", "left")
        parts = F.concat(F.coalesce(F.transform("fulltexts", lambda x: x["fulltext"]), F.array().cast("array<string>")), parts)
    return rows.select("seq", F.array_join(parts, "\n").alias("source_text"))


def event_contexts(events: DataFrame, articles: DataFrame, fulltexts: DataFrame | None = None) -> DataFrame:
    """(seq, context): the text block that describes an event to a language model."""
    members = event_articles(events, articles, ["source_domain", "title", "url", "snippet"], params.CONTEXT_ARTICLES)
    block = F.concat(
        F.lit("--- "), (F.col("pos") + 1).cast("string"), F.lit(". ["), F.col("source_domain"), F.lit("] ---\n标题: "), F.col("title"), F.lit("\nURL: "), F.col("url"),
        F.lit("\n摘要: "), F.substring("snippet", 1, params.CONTEXT_SNIPPET_CHARS), F.lit("\n"),
    )
    lists = members.select("seq", "pos", block.alias("b")).groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("pos", "b"))).alias("blocks"))
    rows = events.join(lists, "seq", "left")
    empty = F.array().cast("array<string>")
    texts = empty
    if fulltexts is not None:
        rows = rows.join(fulltexts, "seq", "left")
        some = F.transform(
            F.slice("fulltexts", 1, 2),
            lambda x: F.concat(F.lit("--- ["), x["domain"], F.lit("] "), x["url"], F.lit(" ---\n"), F.substring(x["fulltext"], 1, params.FULLTEXT_CHARS), F.lit("\n")),
        )
        texts = F.when(F.size("fulltexts") > 0, F.concat(F.array(F.lit("### 原文全文（截取，可信度高于摘要）：")), some)).otherwise(empty)
    names = F.when(F.size("companies_mentioned") > 0, F.array_join("companies_mentioned", ", ")).otherwise("未知")
    head = F.array(
        F.concat(F.lit("## 事件："), F.col("canonical_title")), F.concat(F.lit("涉及公司："), names),
        F.concat(F.lit("来源："), F.col("article_count").cast("string"), F.lit(" 篇 / "), F.size("source_domains").cast("string"), F.lit(" 个域名")),
        F.concat(F.lit("类型："), F.coalesce("event_type_guess", F.lit("None"))), F.lit(""), F.lit("### 相关文章："),
    )
    blocks = F.coalesce(F.transform("blocks", lambda x: x["b"]), empty)
    return rows.select("seq", F.array_join(F.concat(head, blocks, texts), "\n").alias("context"))


def ground_analyses(analyses: DataFrame, texts: DataFrame) -> DataFrame:
    """Analyses with grounded key data only; ``flag`` tells what was dropped. Joined on seq."""
    rows = analyses.join(texts, "seq", "left")
    lost = ungrounded(F.col("key_data"), F.col("source_text"))
    dropped = F.coalesce(F.size(lost), F.lit(0)) > 0
    listed = F.concat(F.lit("['"), F.array_join(lost, "', '"), F.lit("']"))
    flag = F.concat(F.lit("key_data 无来源剔除 ["), F.substring(F.coalesce("title", F.lit("")), 1, 25), F.lit("]: "), listed)
    return rows.withColumns({"flag": F.when(dropped, flag), "key_data": F.when(dropped, grounded(F.col("key_data"), F.col("source_text"))).otherwise(F.col("key_data"))})


def apply_checks(analyses: DataFrame, checks: DataFrame) -> DataFrame:
    """Apply second checks (seq, corrected_details, unsupported_claims) to high-scored analyses that have a source text.

    Adds ``check_flags``; details are replaced where a correction is given.
    """
    c = checks.select("seq", "corrected_details", "unsupported_claims")
    rows = analyses.join(c, "seq", "left")
    due = (F.coalesce("importance_score", F.lit(0.0)) >= params.RECHECK_SCORE) & (F.coalesce("source_text", F.lit("")) != "")
    corrected = due & (F.coalesce("corrected_details", F.lit("")) != "")
    short = F.substring(F.coalesce("title", F.lit("")), 1, 25)
    revised = F.when(corrected, F.array(F.concat(F.lit("复核修订 details ["), short, F.lit("]")))).otherwise(F.array().cast("array<string>"))
    claims = F.when(due, F.coalesce(F.transform("unsupported_claims", lambda x: F.concat(F.lit("无依据表述 ["), short, F.lit("]: "), x)), F.array().cast("array<string>"))).otherwise(
        F.array().cast("array<string>")
    )
    return rows.withColumns({"check_flags": F.concat(revised, claims), "details": F.when(corrected, F.col("corrected_details")).otherwise(F.col("details"))}).drop(
        "corrected_details", "unsupported_claims"
    )


def _filled(analyses: DataFrame) -> DataFrame:
    return analyses.withColumns({"category": F.coalesce("category", F.lit(params.DEFAULT_CATEGORY)), "importance_score": F.coalesce("importance_score", F.lit(0.0))})


def _ordered(analyses: DataFrame) -> DataFrame:
    """Analyses with category and score filled and the first place of their category, for ordering."""
    rows = _filled(analyses)
    firsts = rows.groupBy("category").agg(F.min(F.struct(-F.col("importance_score"), F.col("seq"))).alias("__first"))
    return rows.join(firsts, "category")


def top_news(analyses: DataFrame) -> DataFrame:
    """Up to seven analyses of 80 or more, of 70 or more if fewer than three reach 80; ``rank`` is their order."""
    order = [F.desc("importance_score"), F.col("__first"), F.col("seq")]
    best = _ordered(analyses).where(F.col("importance_score") >= params.TOP_FALLBACK_SCORE).orderBy(*order).limit(params.TOP_ITEMS)
    whole = Window.orderBy(*order)  # of seven rows
    high = F.count_if(F.col("importance_score") >= params.TOP_SCORE).over(Window.partitionBy(F.lit(0)))
    rows = best.withColumns({"rank": F.row_number().over(whole), "__high": high})
    return rows.where((F.col("__high") < params.TOP_MIN_ITEMS) | (F.col("importance_score") >= params.TOP_SCORE)).drop("__first", "__high")


def section_items(analyses: DataFrame, top: DataFrame, sections=params.SECTIONS) -> DataFrame:
    """Analyses in their sections with ``rank``: the top news, and up to eight others of each category."""
    rest = _filled(analyses).join(top.select("event_id").distinct(), "event_id", "left_anti")
    names = [s for s, _ in sections if s != "top_news"]
    of_section = Window.partitionBy("category").orderBy(F.desc("importance_score"), "seq")
    ranked = rest.where(F.col("category").isin(*names)).withColumn("rank", F.row_number().over(of_section)).where(F.col("rank") <= params.SECTION_ITEMS)
    return top.withColumn("section_id", F.lit("top_news")).unionByName(ranked.withColumn("section_id", F.col("category")))


def left_out(analyses: DataFrame, items: DataFrame) -> DataFrame:
    """Analyses that no section shows, for diagnosis."""
    return analyses.join(items.select("event_id").distinct(), "event_id", "left_anti")


def sources(events: DataFrame, articles: DataFrame, analyses: DataFrame, limit: int = params.MAX_SOURCES, keywords=params.OFFICIAL_KEYWORDS) -> DataFrame:
    """(seq, sources): for each event the first article of up to five domains, then bare domains.

    Names come from the analysis by position, else from the article or domain.
    """
    members = event_articles(events, articles, ["source_domain", "source_name", "url"])
    firsts = members.groupBy("seq", "source_domain").agg(F.min(F.struct("pos", "source_domain", "source_name", "url")).alias("m"))
    lists = firsts.groupBy("seq").agg(F.slice(F.sort_array(F.collect_list("m")), 1, limit).alias("found"))
    rows = events.select("seq", "source_domains").join(lists, "seq", "left").join(analyses.select("seq", "source_names"), "seq", "left")
    none = "array<struct<pos:int,source_domain:string,source_name:string,url:string>>"
    rows = rows.withColumns({"found": F.coalesce("found", F.array().cast(none)), "source_names": F.coalesce("source_names", F.array().cast("array<string>"))})
    name = lambda k, other: F.coalesce(F.when(k < F.size("source_names"), F.get("source_names", k)), other)

    def source(label: Column, url: Column, domain: Column) -> Column:
        return F.struct(label.alias("name"), url.alias("url"), is_official(domain, keywords).alias("is_official"))

    real = F.transform("found", lambda m, k: source(name(k, F.coalesce(F.nullif(m["source_name"], F.lit("")), m["source_domain"])), m["url"], m["source_domain"]))
    seen = F.transform("found", lambda m: m["source_domain"])
    places = F.transform(F.slice("source_domains", 1, limit), lambda d, k: F.struct(d.alias("d"), k.alias("k")))
    bare = F.transform(F.filter(places, lambda p: ~F.array_contains(seen, p["d"])), lambda p: source(name(p["k"], p["d"]), F.concat(F.lit("https://"), p["d"]), p["d"]))
    return rows.select("seq", F.slice(F.concat(real, bare), 1, limit).alias("sources"))


def report_items(items: DataFrame, source_lists: DataFrame) -> DataFrame:
    """Items as they stand in the report, with section_id."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    details = F.coalesce(F.nullif(text("details"), F.lit("")), text("summary"))
    category = F.when(F.col("section_id").isin(*params.CATEGORIES), F.col("section_id")).otherwise(params.DEFAULT_CATEGORY)
    words = F.length(text("title")) + F.length(text("lead")) + F.length(details) + F.length(text("analysis"))
    return items.join(source_lists, "seq", "left").select(
        "section_id", item_id(F.col("rank")).alias("item_id"), "event_id", "rank", category.alias("category"), text("title").alias("title"), text("lead").alias("lead"),
        F.coalesce("key_data", F.array().cast("array<struct<label:string,value:string>>")).alias("key_data"), details.alias("details"), "analysis",
        F.coalesce("sources", F.array().cast("array<struct<name:string,url:string,is_official:boolean>>")).alias("sources"), words.alias("word_count"),
    )


def report_sections(items: DataFrame, sections=params.SECTIONS) -> DataFrame:
    """All sections in order with their items, empty ones included."""
    names = items.sparkSession.createDataFrame([(k, s, n) for k, (s, n) in enumerate(sections)], "pos int, section_id string, section_name string")
    entry = F.struct("rank", "item_id", "event_id", "category", "title", "lead", "key_data", "details", "analysis", "sources", "word_count")
    lists = items.groupBy("section_id").agg(F.sort_array(F.collect_list(entry)).alias("items"))
    kind = dict(lists.dtypes)["items"]
    rows = names.join(lists, "section_id", "left").withColumn("items", F.coalesce("items", F.array().cast(kind)))
    return rows.select("pos", "section_id", "section_name", F.size("items").alias("item_count"), "items")


def daily_report(items: DataFrame, report_date: Column, as_of: Column, summary: Column | None = None, flags: DataFrame | None = None, zone: str = params.REPORT_TIMEZONE) -> DataFrame:
    """The report as one row. ``flags`` has (seq, flag) rows; ``summary`` is cut to 300 characters."""
    body = report_sections(items).agg(F.sort_array(F.collect_list(F.struct("pos", "section_id", "section_name", "item_count", "items"))).alias("sections"))
    totals = body.withColumns({
        "total_items": F.aggregate("sections", F.lit(0), lambda a, s: a + s["item_count"]),
        "total_word_count": F.aggregate("sections", F.lit(0), lambda a, s: a + F.aggregate(s["items"], F.lit(0), lambda b, i: b + i["word_count"])),
    })
    marks = F.array().cast("array<string>")
    if flags is not None:
        listed = flags.agg(F.sort_array(F.collect_list(F.struct("seq", "flag"))).alias("f")).select(F.transform("f", lambda x: x["flag"]).alias("__flags"))
        totals, marks = totals.join(listed), F.col("__flags")
    day = F.to_date(report_date)
    return totals.select(
        report_id(day).alias("report_id"), F.date_format(day, "yyyy-MM-dd").alias("report_date"), report_day_start(day, zone).alias("time_window_start"), as_of.alias("time_window_end"),
        "total_items", "total_word_count", F.substring(summary if summary is not None else F.lit(None).cast("string"), 1, params.SUMMARY_CHARS).alias("editor_summary"),
        "sections", F.array().cast("array<string>").alias("removed_items"), marks.alias("quality_flags"), as_of.alias("generated_at"), F.lit("1.0.0").alias("version"),
    )
