"""Registered queries of the engine's own operators, each with SQL that DuckDB can run on the same tables.

The tables hold no news, so articles are made from ``pages``, events from ``events`` and ``documents``, and the
dictionaries, which are parameters, name values that occur there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import params
from .functions import dates, jsontext, text, urls
from .operators import backfill, cluster, dedup, extras, filters, history, querygen, report, search, select, stats
from .operators.graph import durable, shared_folder
from .operators.similarity import distinct_sets, similar_sets
from .sources import tablefunctions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

AS_OF = "2024-01-10 00:00:00"
QUERY_CATEGORIES = params.QUOTA_CATEGORIES


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as articles."""
    p = read(spark, sf, "pages")
    n = len(QUERY_CATEGORIES)
    url = urls.canonical_url(F.col("url"))
    return p.select(
        F.col("page_id").alias("seq"), urls.article_id(url).alias("article_id"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), "url",
        urls.source_domain(F.col("url")).alias("source_domain"), F.lit(None).cast("string").alias("source_name"), F.lit("").alias("content"),
        F.regexp_replace("html", "<[^>]*>", "").alias("snippet"),
        F.element_at(F.array(*[F.lit(c) for c in QUERY_CATEGORIES]), (F.col("page_id") % n + 1).cast("int")).alias("category"),
        F.when(F.col("page_id") % 7 != 0, as_of() - F.make_dt_interval(F.lit(0), (F.col("page_id") % 96).cast("int"))).alias("published_at"),
        F.lit(None).cast("string").alias("search_query"), F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "unknown"))), (F.col("page_id") % 4 + 1).cast("int")).alias("source_reliability"),
        F.lit(1).alias("result_count"),
    )


ARTICLES = f"""articles AS (
  SELECT page_id AS seq, url, regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
    replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', '') AS source_domain,
    regexp_replace(html, '<[^>]*>', '', 'g') AS snippet,
    {list(QUERY_CATEGORIES)}[page_id % 5 + 1] AS category,
    CASE WHEN page_id % 7 <> 0 THEN TIMESTAMP '{AS_OF}' - to_hours(page_id % 96) END AS published_at,
    ['high', 'medium', 'low', 'unknown'][page_id % 4 + 1] AS source_reliability, 3 - page_id % 4 AS weight
  FROM pages)"""

#: URL normalisation in SQL, of a column u.
NORMALIZED = """(lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://' || lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))
  || coalesce(nullif(regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/')
  || CASE WHEN len(list_filter(string_split(regexp_extract(u, '^[^?#]*[?]([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(string_split(x, '=')[1]), 'utm_') AND lower(string_split(x, '=')[1]) NOT IN ('fbclid', 'gclid', 'ref', 'ref_src', 'referrer', 'mc_cid', 'mc_eid'))) > 0
     THEN '?' || array_to_string(list_filter(string_split(regexp_extract(u, '^[^?#]*[?]([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(string_split(x, '=')[1]), 'utm_') AND lower(string_split(x, '=')[1]) NOT IN ('fbclid', 'gclid', 'ref', 'ref_src', 'referrer', 'mc_cid', 'mc_eid')), '&') ELSE '' END)"""

KEYS = """keyed AS (SELECT *, regexp_replace(lower(title), '[^\\p{L}\\p{N}_]', '', 'g') AS k FROM articles),
grams AS (SELECT seq, k, CASE WHEN length(k) >= 2 THEN list_distinct(list_transform(range(1, length(k)), lambda i: substring(k, i, 2))) WHEN length(k) = 1 THEN [k] ELSE [] END AS g FROM keyed),
gram AS (SELECT seq, len(g) AS n, unnest(g) AS t FROM grams)"""


def pairs_sql(threshold: float) -> str:
    return f"""SELECT a.seq AS a, b.seq AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS sim
  FROM gram a JOIN gram b ON a.t = b.t AND a.seq < b.seq GROUP BY a.seq, b.seq HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= {threshold}"""


@registered(f"SELECT page_id, {NORMALIZED} AS normal, 'art_' || substr(sha256({NORMALIZED}), 1, 12) AS article_id, 'res_' || substr(sha256(lower(u || '|' || t)), 1, 12) AS result_id FROM (SELECT page_id, url AS u, regexp_extract(html, '<title>(.*?)</title>', 1) AS t FROM pages)")
def url_normalize(spark, sf):
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    u = F.col("url")
    return read(spark, sf, "pages").select("page_id", urls.normalize_url(u).alias("normal"), urls.article_id(u).alias("article_id"), urls.result_id(u, title).alias("result_id"))


_TEST_TIERS = {"high": ("example.com", "news.example.com"), "medium": ("example.org",), "low": ("example.net",)}


@registered(f"""WITH {ARTICLES} SELECT seq, source_domain,
  CASE WHEN source_domain IN ('example.com', 'news.example.com') OR regexp_matches(source_domain, '[.](gov|gov[.]cn|gov[.]uk|gov[.]au|europa[.]eu)$') THEN 'high' WHEN source_domain = 'example.org' THEN 'medium' WHEN source_domain = 'example.net' THEN 'low' ELSE 'unknown' END AS grade FROM articles""")
def reliability_tier(spark, sf):
    a = articles(spark, sf)
    return a.select("seq", "source_domain", urls.reliability(F.col("source_domain"), high=_TEST_TIERS["high"], medium=_TEST_TIERS["medium"], low=_TEST_TIERS["low"]).alias("grade"))


@registered(f"""WITH {ARTICLES} SELECT 'language' AS dimension, CASE WHEN title || ' ' || snippet = '' THEN 'unknown' ELSE 'en' END AS value, count(*) AS n FROM articles GROUP BY ALL
  UNION ALL SELECT 'reliability', source_reliability, count(*) FROM articles GROUP BY ALL UNION ALL SELECT 'category', category, count(*) FROM articles GROUP BY ALL""")
def collection_stats(spark, sf):
    a = articles(spark, sf)
    return stats.collection_stats(a.withColumn("language", text.language(F.concat_ws(" ", "title", "snippet"))))


@registered("""SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'unknown' WHEN len(regexp_extract_all(text, '[àâçéèêëîïôöùûüñáíóúäß]')) / greatest(length(text), 1) > 0.05 THEN 'accented' ELSE 'plain' END AS language FROM documents""")
def language_detect(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.language(F.col("text"), "[àâçéèêëîïôöùûüñáíóúäß]", 0.05, "accented", "plain").alias("language"))


@registered(f"WITH {ARTICLES}, {KEYS} SELECT seq, k AS key, CAST(len(g) AS BIGINT) AS n_grams FROM grams")
def title_bigrams(spark, sf):
    key = text.title_key(F.col("title"))
    return articles(spark, sf).select("seq", key.alias("key"), F.size(text.bigrams(key, False)).cast("long").alias("n_grams"))


@registered(f"WITH {ARTICLES}, {KEYS}, p AS ({pairs_sql(0.6)}) SELECT ka.k AS a, kb.k AS b, any_value(p.sim) AS sim FROM p JOIN grams ka ON ka.seq = p.a JOIN grams kb ON kb.seq = p.b WHERE ka.k <> kb.k GROUP BY least(ka.k, kb.k), greatest(ka.k, kb.k), ka.k, kb.k HAVING ka.k < kb.k UNION SELECT kb.k, ka.k, p.sim FROM p JOIN grams ka ON ka.seq = p.a JOIN grams kb ON kb.seq = p.b WHERE ka.k > kb.k")
def title_pairs(spark, sf):
    key = text.title_key(F.col("title"))
    return similar_sets(durable(distinct_sets(articles(spark, sf), key, text.bigrams(key, False))), None, 0.6)


@registered(f"WITH {ARTICLES} SELECT seq, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published FROM articles WHERE published_at IS NULL OR published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOURS")
def recency_filter(spark, sf):
    kept = filters.recent(articles(spark, sf), as_of())
    return kept.select("seq", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"))


@registered(f"WITH {ARTICLES} SELECT seq, CAST(length(snippet) AS BIGINT) AS n FROM articles WHERE length(snippet) >= 120")
def min_length(spark, sf):
    return filters.long_enough(articles(spark, sf), 120).select("seq", F.length("snippet").cast("long").alias("n"))


def doubled(spark, sf):
    """Articles, and each again under a tracked URL with another snippet and query."""
    a = articles(spark, sf)
    tracked = F.when(F.contains("url", F.lit("?")), F.regexp_replace("url", r"\?", "?utm_source=dup&")).otherwise(F.regexp_replace("url", "(#.*)?$", "?utm_source=dup"))
    url = F.when(F.contains("url", F.lit("#")), F.col("url")).otherwise(tracked)
    again = a.withColumns({
        "seq": F.col("seq") + 10_000_000, "url": url, "article_id": urls.article_id(urls.canonical_url(url)),
        "snippet": F.concat(F.col("snippet"), F.when(F.col("seq") % 2 == 0, " more").otherwise("")), "search_query": F.concat(F.lit("q"), F.col("seq").cast("string")), "content": F.lit("body"),
    })
    return a.unionByName(again)


@registered(f"""WITH {ARTICLES}, one AS (
  SELECT seq, url, snippet, category, '' AS content, CAST(NULL AS VARCHAR) AS q FROM articles UNION ALL
  SELECT seq + 10000000, CASE WHEN contains(url, '#') THEN url WHEN contains(url, '?') THEN replace(url, '?', '?utm_source=dup&') ELSE url || '?utm_source=dup' END,
    snippet || CASE WHEN seq % 2 = 0 THEN ' more' ELSE '' END, category, 'body', 'q' || seq FROM articles
), id AS (SELECT *, 'art_' || substr(sha256({NORMALIZED}), 1, 12) AS article_id FROM (SELECT *, url AS u FROM one))
SELECT article_id, min(seq) AS seq, arg_min(category, seq) AS category, arg_max(snippet, length(snippet) * 100000000 - seq) AS snippet,
  coalesce(nullif(arg_max(content, length(snippet) * 100000000 - seq), ''), arg_max(content, length(snippet) * 100000000 - seq) FILTER (content <> ''), '') AS content,
  arg_min(q, seq) FILTER (q IS NOT NULL) AS search_query, count(*) AS result_count FROM id GROUP BY article_id""")
def dedup_url(spark, sf):
    d = dedup.dedup_by_url(doubled(spark, sf))
    return d.select("article_id", "seq", "category", "snippet", "content", "search_query", F.col("result_count").cast("long").alias("result_count"))


#: Row by row; a list of removed rows is carried along.
@registered(f"""WITH RECURSIVE {ARTICLES}, {KEYS}, p AS MATERIALIZED (SELECT a, b FROM ({pairs_sql(params.TITLE_THRESHOLD)}) UNION SELECT x.seq, y.seq FROM grams x JOIN grams y ON x.k = '' AND y.k = '' AND x.seq < y.seq),
near AS MATERIALIZED (SELECT p.a, p.b, y.weight > x.weight OR (y.weight = x.weight AND length(y.snippet) > length(x.snippet)) AS heavier FROM p JOIN articles x ON x.seq = p.a JOIN articles y ON y.seq = p.b),
starts AS MATERIALIZED (SELECT a, row_number() OVER (ORDER BY a) AS n FROM (SELECT DISTINCT a FROM near)),
scan(n, dead) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT n, list_concat(dead, list_concat(list_filter(later, lambda b: stop IS NULL OR b < stop), CASE WHEN stop IS NULL THEN [] ELSE [a] END))
  FROM (SELECT scan.n + 1 AS n, any_value(scan.dead) AS dead, any_value(starts.a) AS a, coalesce(list(near.b ORDER BY near.b) FILTER (near.b IS NOT NULL), []) AS later, min(near.b) FILTER (near.heavier) AS stop
    FROM scan JOIN starts ON starts.n = scan.n + 1 LEFT JOIN near ON near.a = starts.a AND NOT list_contains(scan.dead, near.a) AND NOT list_contains(scan.dead, near.b) GROUP BY scan.n))
SELECT seq, title, source_reliability FROM articles WHERE NOT list_contains((SELECT arg_max(dead, n) FROM scan), seq)""")
def dedup_title(spark, sf):
    return dedup.dedup_by_title(articles(spark, sf)).select("seq", "title", "source_reliability")


@registered(f"WITH {ARTICLES} SELECT seq, title, row_number() OVER (ORDER BY weight DESC, length(snippet) DESC, seq) AS rank FROM articles QUALIFY rank <= 100")
def article_rank(spark, sf):
    from pyspark.sql import Window

    best = articles(spark, sf).orderBy(*select.article_order()).limit(100)
    # the window ranks a hundred rows
    return best.select("seq", "title", F.row_number().over(Window.orderBy(*select.article_order())).cast("long").alias("rank"))


_EVENT_NAMES = (("the", "The"), ("and", "And"))


def _named(column: str, names) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN contains(lower({column}), '{k}') THEN '{v}' END" for k, v in names) + "], lambda x: x IS NOT NULL)"


#: The share of common bigrams of a cluster x and an article.
_ALIKE = "len(list_intersect(x.g, g))::DOUBLE / (len(x.g) + len(g) - len(list_intersect(x.g, g)))"


#: Article by article of each day; the list of clusters is carried along.
@registered(f"""WITH RECURSIVE {ARTICLES}, {KEYS},
due AS MATERIALIZED (SELECT a.seq, coalesce(strftime(published_at, '%Y-%m-%d'), '') AS bucket, g, {_named("coalesce(a.title, '')", _EVENT_NAMES)} AS c,
  row_number() OVER (PARTITION BY coalesce(strftime(published_at, '%Y-%m-%d'), '') ORDER BY a.seq) AS k FROM articles a JOIN grams USING (seq)),
scan(bucket, k, clusters) AS (
  SELECT DISTINCT bucket, CAST(0 AS BIGINT), CAST([] AS STRUCT(g VARCHAR[], c VARCHAR[], m BIGINT[])[]) FROM due
  UNION ALL
  SELECT bucket, k, CASE WHEN best IS NULL THEN list_append(clusters, {{'g': g, 'c': c, 'm': [seq]}})
    ELSE list_transform(clusters, lambda x, i: CASE WHEN i = best THEN {{'g': list_distinct(list_concat(x.g, g)), 'c': list_distinct(list_concat(x.c, c)), 'm': list_append(x.m, seq)}} ELSE x END) END
  FROM (SELECT *, CASE WHEN list_max(sims) > 0 THEN list_position(sims, list_max(sims)) END AS best FROM (
    SELECT scan.bucket, due.k, clusters, g, c, seq, list_transform(clusters, lambda x: CASE WHEN len(list_intersect(x.g, g)) = 0 THEN 0.0::DOUBLE
        WHEN {_ALIKE} >= CASE WHEN len(list_intersect(x.c, c)) > 0 THEN {max(params.COMPANY_FLOOR, params.CLUSTER_THRESHOLD - params.COMPANY_RELAXATION)} ELSE {params.CLUSTER_THRESHOLD} END THEN {_ALIKE} ELSE 0.0::DOUBLE END) AS sims
    FROM scan JOIN due ON due.bucket = scan.bucket AND due.k = scan.k + 1))),
final AS (SELECT bucket, arg_max(clusters, k) AS clusters FROM scan GROUP BY bucket),
member AS (SELECT bucket, i, unnest(clusters[i].m) AS seq FROM final, unnest(range(1, len(clusters) + 1)) AS t(i)),
ranked AS MATERIALIZED (SELECT bucket, i, a.*, g, row_number() OVER (PARTITION BY bucket, i ORDER BY weight DESC, length(title) DESC, seq) AS r FROM member JOIN articles a USING (seq) JOIN grams USING (seq)),
score AS (SELECT x.bucket, x.i, round_even(sum(CASE WHEN len(x.g) = 0 OR len(y.g) = 0 THEN 0 ELSE len(list_intersect(x.g, y.g))::DOUBLE / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))) END) / count(*), 3) AS s
  FROM ranked x JOIN ranked y ON x.bucket = y.bucket AND x.i = y.i AND x.r < y.r AND y.r <= 5 GROUP BY x.bucket, x.i),
id AS (SELECT *, 'art_' || substr(sha256({NORMALIZED}), 1, 12) AS article_id FROM (SELECT *, url AS u FROM ranked)),
event AS (SELECT bucket, i, min(seq) AS seq, arg_min(title, r) AS canonical_title, string_agg(article_id, '|' ORDER BY r) AS article_ids, count(*) AS article_count, array_to_string(list_sort(list(DISTINCT source_domain)), '|') AS source_domains,
  array_to_string(list_sort(list_distinct(flatten(list({_named("title || ' ' || snippet", _EVENT_NAMES)})))), '|') AS companies FROM id GROUP BY bucket, i)
SELECT seq, 'evt_' || substr(sha256(lower(substr(canonical_title, 1, 50))), 1, 10) AS event_id, canonical_title, article_ids, article_count, source_domains, companies, coalesce(s, 1.0) AS cluster_score FROM event LEFT JOIN score USING (bucket, i)""")
def event_clusters(spark, sf):
    e = cluster.cluster_articles(articles(spark, sf).withColumn("day", F.to_date("published_at")), by="day", as_of=as_of(), dictionary=_EVENT_NAMES)
    return e.select(
        "seq", "event_id", "canonical_title", F.array_join("article_ids", "|").alias("article_ids"), F.col("article_count").cast("long").alias("article_count"),
        F.array_join("source_domains", "|").alias("source_domains"), F.array_join("companies_mentioned", "|").alias("companies"), "cluster_score",
    )


@registered(f"""WITH RECURSIVE {ARTICLES}, {KEYS}, p AS MATERIALIZED ({pairs_sql(0.6)}), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(x, y) AS (SELECT seq, seq FROM articles UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT x AS seq, min(y) AS component FROM r GROUP BY x""")
def cluster_components(spark, sf):
    return cluster.cluster_components(articles(spark, sf))


def _today_and_before(spark, sf):
    a = articles(spark, sf)
    key = F.col("seq").alias("seq")
    today = a.where("seq % 2 = 0").select(key, F.col("title").alias("canonical_title"))
    day = F.date_sub(F.lit("2024-01-10").cast("date"), (F.col("seq") % 5).cast("int"))
    before = a.where("seq % 2 = 1").select(day.alias("report_date"), F.lit("events").alias("file"), F.col("seq").alias("pos"), F.col("title").alias("canonical_title"))
    return today, history.recent_titles(before, F.lit("2024-01-10 06:00:00").cast("timestamp"), F.lit("2024-01-10").cast("date"))


_HISTORY = f"""{ARTICLES}, {KEYS}, old AS (SELECT seq, DATE '2024-01-10' - CAST(seq % 5 AS INTEGER) AS d, title FROM articles WHERE seq % 2 = 1 AND title <> '' AND DATE '2024-01-10' - CAST(seq % 5 AS INTEGER) >= TIMESTAMP '2024-01-07 06:00:00' AND seq % 5 <> 0),
hit AS (SELECT a.seq, b.seq AS o, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS sim FROM gram a JOIN gram b ON a.t = b.t JOIN old ON old.seq = b.seq WHERE a.seq % 2 = 0 GROUP BY a.seq, b.seq HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.7)"""


@registered(f"WITH {_HISTORY} SELECT seq, title AS canonical_title FROM articles WHERE seq % 2 = 0 AND seq NOT IN (SELECT seq FROM hit)")
def cross_day_fresh(spark, sf):
    return history.split_seen(*_today_and_before(spark, sf))[0].select("seq", "canonical_title")


@registered(f"WITH {_HISTORY} SELECT hit.seq, strftime(arg_min(d, (d, o)), '%Y-%m-%d') AS hit_date, arg_min(title, (d, o)) AS hit_title, arg_min(sim, (d, o)) AS sim FROM hit JOIN old ON old.seq = hit.o GROUP BY hit.seq")
def cross_day_first_hit(spark, sf):
    hits = history.first_hits(*_today_and_before(spark, sf))
    return hits.select("seq", F.date_format("hit_date", "yyyy-MM-dd").alias("hit_date"), "hit_title", "sim")


#: The same result from a kept index: bucketed by bigram, with a day for each partition.
@registered(SQL["cross_day_first_hit"])
def cross_day_indexed(spark, sf):
    import uuid

    a = articles(spark, sf)
    day = F.date_sub(F.lit("2024-01-10").cast("date"), (F.col("seq") % 5).cast("int"))
    before = a.where("seq % 2 = 1").select(day.alias("report_date"), F.lit("events").alias("file"), F.col("seq").alias("pos"), F.col("title").alias("canonical_title"))
    table = f"title_index_{uuid.uuid4().hex}"
    history.open_index(spark, table, f"{shared_folder(spark)}/{table}")
    history.index_titles(before, table)
    today = a.where("seq % 2 = 0").select("seq", F.col("title").alias("canonical_title"))
    hits = history.indexed_hits(today, table, F.lit("2024-01-10 06:00:00").cast("timestamp"), F.lit("2024-01-10").cast("date"))
    return hits.select("seq", F.date_format("hit_date", "yyyy-MM-dd").alias("hit_date"), "hit_title", "sim")


_NAMES = (("thatthe", "First"), ("tion", "Second"), ("ción", "Third"), ("heit", "Fourth"), ("eau", "Fifth"))
_RULES = (("one", ("thhe", "ção")), ("two", ("heit", "schaft")), ("three", ("ción", "eau")), ("one", ("ing",)))


@registered("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(lower(coalesce(text, '')), '{k}') THEN '{v}' END" for k, v in _NAMES) + "], lambda x: x IS NOT NULL), '|') AS names FROM documents")
def company_mentions(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.array_join(text.companies(F.coalesce("text", F.lit("")), _NAMES), "|").alias("names"))


@registered("SELECT doc_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce(source, '') || ' ' || coalesce(text, '')), '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in _RULES) + " END AS kind FROM documents")
def event_type_guess(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.event_type(F.coalesce("source", F.lit("")), F.coalesce("text", F.lit("")), _RULES).alias("kind"))


def user_events(spark, sf):
    """Users as events, their rows as articles, the kind of row as category."""
    e = read(spark, sf, "events")
    members = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("article_id"), F.col("event_type").alias("category"), "user_id")
    groups = members.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("seq", "article_id"))).alias("m"), F.array_sort(F.collect_set("category")).alias("source_domains"))
    events = groups.select(
        F.col("user_id").alias("seq"), F.concat(F.lit("evt_"), F.col("user_id").cast("string")).alias("event_id"), F.transform("m", lambda x: x["article_id"]).alias("article_ids"),
        F.size("m").alias("article_count"), "source_domains",
    )
    return events, members


_MAJORITY = "majority AS (SELECT user_id, arg_max(event_type, n * 100000000 - first) AS category FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY user_id)"


@registered(f"WITH {_MAJORITY} SELECT user_id, category FROM majority")
def category_majority(spark, sf):
    events, members = user_events(spark, sf)
    return select.majority_category(events, members).select(F.col("seq").alias("user_id"), "category")


@registered(f"""WITH {_MAJORITY}, e AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS nd, any_value(category) AS category FROM events JOIN majority USING (user_id) GROUP BY user_id),
k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, nd DESC, user_id) AS rn, list_position(['click', 'purchase', 'view'], category) AS c FROM e),
f AS (SELECT * FROM k WHERE c IS NOT NULL AND rn <= 2 ORDER BY c, rn LIMIT 18), g AS (SELECT * FROM e WHERE user_id NOT IN (SELECT user_id FROM f)),
u AS (SELECT user_id, category, 0 AS phase, c, rn, n, nd FROM f UNION ALL SELECT user_id, category, 1, 0, 0, n, nd FROM g)
SELECT user_id, category, row_number() OVER (ORDER BY phase, c, rn, n DESC, nd DESC, user_id) AS rank FROM u QUALIFY rank <= 18""")
def balanced_select(spark, sf):
    events, members = user_events(spark, sf)
    chosen = select.balanced(select.majority_category(events, members), 18, ("click", "purchase", "view"))
    return chosen.select(F.col("seq").alias("user_id"), "category", F.col("rank").cast("long").alias("rank"))


_CHOSEN = f"""{_MAJORITY}, e AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS nd, any_value(category) AS category FROM events JOIN majority USING (user_id) GROUP BY user_id),
k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, nd DESC, user_id) AS rn, list_position(['click', 'purchase', 'view'], category) AS c FROM e),
f AS (SELECT * FROM k WHERE c IS NOT NULL AND rn <= 2 ORDER BY c, rn LIMIT 18),
u AS (SELECT user_id, 0 AS phase, c, rn, n, nd FROM f UNION ALL SELECT user_id, 1, 0, 0, n, nd FROM e WHERE user_id NOT IN (SELECT user_id FROM f)),
chosen AS (SELECT user_id FROM u QUALIFY row_number() OVER (ORDER BY phase, c, rn, n DESC, nd DESC, user_id) <= 18)"""


@registered(f"WITH {_CHOSEN} SELECT user_id, category FROM e WHERE user_id NOT IN (SELECT user_id FROM chosen)")
def events_unselected(spark, sf):
    events, members = user_events(spark, sf)
    named = durable(select.majority_category(events, members))
    left = select.unselected(named, select.balanced(named, 18, ("click", "purchase", "view")))
    return left.select(F.col("seq").alias("user_id"), "category")


@registered("SELECT user_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, count(DISTINCT event_type) DESC, user_id) AS rank FROM events GROUP BY user_id QUALIFY rank <= 10")
def hottest_events(spark, sf):
    from pyspark.sql import Window

    events, _ = user_events(spark, sf)
    best = events.orderBy(*cluster.by_heat()).limit(10)
    # the window ranks ten rows
    return best.select(F.col("seq").alias("user_id"), F.col("article_count").cast("long").alias("n"), F.row_number().over(Window.orderBy(*cluster.by_heat())).cast("long").alias("rank"))


@registered("SELECT count(*) AS events, count(*) FILTER (n > 1) AS multi_source FROM (SELECT count(*) AS n FROM events GROUP BY user_id)")
def event_stats(spark, sf):
    return stats.event_stats(user_events(spark, sf)[0])


@registered(f"WITH {ARTICLES}, w(category) AS (VALUES ('funding'), ('policy'), ('sports'), ('research')) SELECT w.category, CAST(count(a.seq) AS BIGINT) AS n FROM w LEFT JOIN articles a ON a.category = w.category GROUP BY w.category HAVING count(a.seq) < 60")
def backfill_deficit(spark, sf):
    return backfill.deficits(articles(spark, sf), ("funding", "policy", "sports", "research"), 60)


@registered(f"WITH {ARTICLES} SELECT category, count(*) AS n FROM articles GROUP BY category")
def category_counts(spark, sf):
    return stats.category_counts(articles(spark, sf))


def _strategy(spark, sf):
    nations = read(spark, sf, "nation").select(F.lit("matrix").alias("batch_id"), F.col("n_nationkey").alias("company_pos"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lower("n_name"))).alias("aliases"))
    regions = read(spark, sf, "region").select(F.lit("matrix").alias("batch_id"), F.col("r_regionkey").alias("event_pos"), F.lower("r_name").alias("keyword"), F.when(F.col("r_regionkey") > 1, F.lit("policy")).alias("event_category"))
    listed = read(spark, sf, "supplier").select(F.lit("listed").alias("batch_id"), F.col("s_suppkey").alias("pos"), F.concat(F.lit("update "), F.col("s_name")).alias("query"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("funding")).alias("query_category"))
    batches = spark.createDataFrame([("matrix", 0, "cartesian", True, 8), ("listed", 1, "list", None, None), ("off", 2, "list", False, 5)], "batch_id string, batch_pos int, strategy string, enabled boolean, max_results int")
    return batches, nations, regions, listed


_MATRIX = """q AS (
  SELECT 'matrix' AS batch_id, 0 AS batch_pos, CAST(n_nationkey AS BIGINT) * 1000000 + r_regionkey AS pos, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END || ' ' || lower(r_name) AS query,
    CASE WHEN r_regionkey > 1 THEN 'policy' ELSE 'matrix' END AS category, 8 AS max_results FROM nation, region
  UNION ALL SELECT 'listed', 1, s_suppkey, 'update ' || s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'funding' ELSE 'listed' END, 10 FROM supplier)"""


@registered(f"WITH {_MATRIX} SELECT batch_id, pos, query, category, max_results FROM q QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY pos) <= 40")
def query_matrix(spark, sf):
    return querygen.generate(*_strategy(spark, sf), max_per_batch=40).select("batch_id", F.col("pos").cast("long").alias("pos"), "query", "category", "max_results")


@registered(f"""WITH {_MATRIX} SELECT batch_id, pos, CASE WHEN regexp_matches(lower(query), 'today|latest|new|this week|2024|2023|january') THEN query WHEN category = 'funding' THEN query || ' January 2024 latest'
  WHEN category = 'policy' THEN query || CASE WHEN contains(lower(query), 'update') THEN ' 2024' ELSE ' 2024 update' END WHEN category = 'research' THEN query || ' 2024' ELSE query || ' latest news 2024-01-10' END AS query FROM q""")
def time_qualifier(spark, sf):
    return querygen.generate(*_strategy(spark, sf), as_of=as_of()).select("batch_id", F.col("pos").cast("long").alias("pos"), "query")


@registered(f"WITH {_MATRIX} SELECT batch_id, count(*) AS n_queries, count(*) * 10 AS max_total_results FROM q GROUP BY batch_id")
def batch_summary(spark, sf):
    return querygen.batch_summary(querygen.generate(*_strategy(spark, sf)))


#: The matrix has more queries than the limit, the list of suppliers fewer, as many or more, by the size of the tables.
@registered(f"WITH {_MATRIX} SELECT batch_id, pos, query, category, max_results FROM q QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY pos) <= 100")
def per_batch_limit(spark, sf):
    return querygen.generate(*_strategy(spark, sf), max_per_batch=100).select("batch_id", F.col("pos").cast("long").alias("pos"), "query", "category", "max_results")


@registered(f"""WITH q AS (SELECT p_partkey AS seq, p_name AS query, p_partkey // {params.SEARCH_BATCH} AS batch_no, p_size FROM part)
SELECT seq, query, batch_no, CASE WHEN p_size % 4 <> 0 THEN 'found ' || query END AS markdown, CASE WHEN p_size % 4 = 0 THEN 'No result in batch response' END AS error FROM q""")
def batch_match(spark, sf):
    p = read(spark, sf, "part")
    seq = F.col("p_partkey").cast("long")
    queries = p.select(seq.alias("seq"), F.col("p_name").alias("query"))
    blocks = p.where("p_size % 4 <> 0").select(F.floor(seq / params.SEARCH_BATCH).cast("long").alias("batch_no"), (seq % params.SEARCH_BATCH).cast("int").alias("pos"), F.concat(F.lit("found "), "p_name").alias("markdown"))
    return search.match_batches(queries, blocks).select("seq", "query", "batch_no", "markdown", "error")


@registered(f"""WITH {ARTICLES}, r AS (SELECT * REPLACE (trim(snippet, ' ' || chr(9) || chr(10) || chr(13)) AS snippet), url AS u, CASE WHEN seq % 3 = 0 THEN 'Body ' || seq WHEN seq % 3 = 1 THEN '' END AS content FROM articles)
SELECT seq, 'art_' || substr(sha256({NORMALIZED}), 1, 12) AS article_id, trim(title) AS title, coalesce(nullif(content, ''), snippet) AS content, snippet, category, 'en' AS language,
  CASE WHEN regexp_matches(source_domain, '[.](gov|gov[.]cn|gov[.]uk|gov[.]au|europa[.]eu)$') THEN 'high' ELSE 'unknown' END AS source_reliability, 1 AS result_count FROM r""")
def result_normalize(spark, sf):
    a = articles(spark, sf)
    content = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("Body "), F.col("seq").cast("string"))).when(F.col("seq") % 3 == 1, F.lit(""))
    results = a.select("seq", F.concat(F.lit(" "), "title", F.lit("\n")).alias("title"), "url", "source_domain", content.alias("content"), F.concat("snippet", F.lit(" ")).alias("snippet"), "category", "published_at")
    return search.to_articles(results).select("seq", "article_id", "title", "content", "snippet", "category", "language", "source_reliability", "result_count")


_PAGE_FIELDS = "page_id, url, trim(regexp_extract(html, '<title>(.*?)</title>', 1)) AS title, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\n\\t]+', ' ', 'g')) AS body FROM pages"


def _markdown(spark, sf):
    """Five pages a response, written as search results."""
    p = read(spark, sf, "pages").select("page_id", "url", F.trim(F.regexp_extract("html", "<title>(.*?)</title>", 1)).alias("title"), F.trim(F.regexp_replace(F.regexp_replace("html", r"<[^>]*>", " "), r"[ \n\t]+", " ")).alias("body"))
    p = p.where("title <> '' AND body <> ''")
    item = F.concat(F.lit("\n### "), (F.col("page_id") % 5 + 1).cast("string"), F.lit(". "), F.col("title"), F.lit("\n- **URL**: "), F.col("url"), F.lit("\n- "), F.col("title"), F.lit(" – "), F.col("body"), F.lit("\n"))
    lists = p.groupBy(F.floor(F.col("page_id") / 5).cast("long").alias("batch_no")).agg(F.sort_array(F.collect_list(F.struct("page_id", item.alias("t")))).alias("l"), F.count("*").alias("n"))
    head = F.concat(F.lit("## Search Results ("), F.col("n").cast("string"), F.lit(" results, 3ms)\n"))
    return lists.select("batch_no", F.concat(head, F.array_join(F.transform("l", lambda x: x["t"]), "")).alias("markdown"))


@registered(f"SELECT page_id // 5 AS batch_no, CAST(row_number() OVER (PARTITION BY page_id // 5 ORDER BY page_id) - 1 AS BIGINT) AS pos, CAST(count(*) OVER (PARTITION BY page_id // 5) AS BIGINT) AS total_found, trim(title) AS title, url, trim(body) AS snippet, 'res_' || substr(sha256(lower(url || '|' || trim(title))), 1, 12) AS result_id FROM (SELECT {_PAGE_FIELDS}) WHERE title <> '' AND body <> ''")
def search_markdown_parse(spark, sf):
    r = search.parse_results(_markdown(spark, sf), as_of())
    return r.select("batch_no", F.col("pos").cast("long").alias("pos"), F.col("total_found").cast("long").alias("total_found"), "title", "url", "snippet", "result_id")


#: The same rows by a table function that SQL calls.
@registered(SQL["search_markdown_parse"])
def search_markdown_sql(spark, sf):
    tablefunctions.register_parsers(spark)
    _markdown(spark, sf).createOrReplaceTempView("tidewire_responses")
    return spark.sql("""SELECT id AS batch_no, CAST(pos AS BIGINT) AS pos, CAST(total_found AS BIGINT) AS total_found, title, url, snippet, result_id
      FROM parse_results(TABLE(SELECT batch_no AS id, markdown FROM tidewire_responses))""")


@registered("SELECT l_orderkey AS batch_no, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS BIGINT) AS pos, 'part ' || l_partkey AS query_text, CAST(l_quantity AS BIGINT) AS total_found FROM lineitem")
def batch_split(spark, sf):
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    block = lambda x, k: F.concat(F.lit("\n## Query "), (k + 1).cast("string"), F.lit(": part "), x["l_partkey"].cast("string"), F.lit("\n\n## Search Results ("), x["l_quantity"].cast("long").cast("string"), F.lit(" results, 2ms)\n"))
    lists = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("l"))
    raw = lists.select(F.col("l_orderkey").alias("batch_no"), F.array_join(F.transform("l", block), "").alias("markdown"))
    parts = search.split_batches(raw)
    found = F.regexp_extract("markdown", r"\((\d+)\s+results", 1).cast("long")
    return parts.select("batch_no", F.col("pos").cast("long").alias("pos"), "query_text", found.alias("total_found"))


@registered("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 30 YEARS, '%Y-%m-%d') AS published FROM orders")
def publish_date(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 30 YEARS")).alias("d"))
    kind = F.col("o_orderkey") % 4
    url = F.when(kind == 0, F.concat(F.lit("https://x.com/"), F.date_format("d", "yyyy/MM/dd"), F.lit("/a"))).when(kind == 1, F.concat(F.lit("https://x.com/"), F.date_format("d", "yyyyMMdd"), F.lit("/"))).otherwise("https://x.com/a")
    words = F.when(kind == 2, F.concat(F.lit("Seen "), F.date_format("d", "MMM d, yyyy"))).when(kind == 3, F.date_format("d", "yyyy年M月d日")).otherwise("none")
    # a clock for each row puts every order inside the window
    found = dates.published_date(url, words, F.col("d") + F.expr("INTERVAL 20 DAYS"))
    named = dates.flexible_date(F.date_format("d", "MMM d, yyyy"))
    return o.select("o_orderkey", F.date_format(F.when(named.isNotNull(), found), "yyyy-MM-dd").alias("published"))


@registered("""WITH v AS (SELECT doc_id, text, [n_chars::VARCHAR || ' chars', 'none', '', 'about ' || (n_chars % 7)] AS vs FROM documents), x AS (SELECT doc_id, coalesce(text, '') AS text, unnest(vs) AS v FROM v),
c AS (SELECT doc_id, v, text, CASE WHEN regexp_matches(v, '[0-9]') THEN regexp_extract(v, '[0-9]+(?:[.,][0-9]+)*') ELSE trim(v) END AS core FROM x)
SELECT doc_id, CAST(count(*) FILTER (core <> '' AND contains(text, core)) AS BIGINT) AS n_kept, CAST(count(*) FILTER (NOT (core <> '' AND contains(text, core))) AS BIGINT) AS n_dropped FROM c GROUP BY doc_id""")
def key_data_grounding(spark, sf):
    d = read(spark, sf, "documents")
    entry = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))
    n = F.col("n_chars")
    kd = F.array(entry("a", F.concat(n.cast("string"), F.lit(" chars"))), entry("b", F.lit("none")), entry("c", F.lit("")), entry("d", F.concat(F.lit("about "), (n % 7).cast("string"))))
    rows = d.withColumn("kd", kd)
    return rows.select("doc_id", F.size(jsontext.grounded(F.col("kd"), F.col("text"))).cast("long").alias("n_kept"), F.size(jsontext.ungrounded(F.col("kd"), F.col("text"))).cast("long").alias("n_dropped"))


_LOST = "CASE WHEN regexp_matches(k.v, '[0-9]') THEN regexp_extract(k.v, '[0-9]+(?:[.,][0-9]+)*') ELSE trim(k.v) END"


@registered(f"""WITH v AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') || ' item' AS title, [{{'l': 'a', 'v': n_chars::VARCHAR || ' chars'}}, {{'l': 'b', 'v': 'none'}}, {{'l': 'c', 'v': ''}}, {{'l': 'd', 'v': 'about ' || (n_chars % 7)}}] AS kd FROM documents),
c AS (SELECT *, list_filter(kd, lambda k: NOT ({_LOST} <> '' AND contains(text, {_LOST}))) AS lost FROM v)
SELECT doc_id AS seq, CASE WHEN len(lost) > 0 THEN 'key_data 无来源剔除 [' || substr(title, 1, 25) || ']: [' || chr(39) || array_to_string(list_transform(lost, lambda k: k.l || '=' || k.v), chr(39) || ', ' || chr(39)) || chr(39) || ']' END AS flag, CAST(len(kd) - len(lost) AS BIGINT) AS n_kept FROM c""")
def quality_flags(spark, sf):
    d = read(spark, sf, "documents")
    entry = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))
    n = F.col("n_chars")
    kd = F.array(entry("a", F.concat(n.cast("string"), F.lit(" chars"))), entry("b", F.lit("none")), entry("c", F.lit("")), entry("d", F.concat(F.lit("about "), (n % 7).cast("string"))))
    analyses = d.select(F.col("doc_id").alias("seq"), F.concat(F.coalesce("source", F.lit("")), F.lit(" item")).alias("title"), kd.alias("key_data"))
    out = report.ground_analyses(analyses, d.select(F.col("doc_id").alias("seq"), F.col("text").alias("source_text")))
    return out.select("seq", "flag", F.size("key_data").cast("long").alias("n_kept"))


@registered("SELECT event_id, props AS json, json_extract_string(props, '$.k') AS k FROM events")
def llm_json_extract(spark, sf):
    e = read(spark, sf, "events").select("event_id", "props")
    kind = F.col("event_id") % 3
    wrapped = F.when(kind == 0, F.concat(F.lit("Here:\n```json\n"), F.col("props"), F.lit("\n```\nDone"))).when(kind == 1, F.concat(F.lit("Sure! "), F.col("props"), F.lit(" end"))).otherwise(F.col("props"))
    found = jsontext.extract_json(wrapped)
    return e.select("event_id", found.alias("json"), F.get_json_object(found, "$.k").alias("k"))


def _analyses(spark, sf):
    """Orders as analyses; the score follows from the key."""
    o = read(spark, sf, "orders")
    c = F.element_at(F.array(*[F.lit(x) for x in (*QUERY_CATEGORIES, "sports")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("evt_"), F.col("o_orderkey").cast("string")).alias("event_id"), F.lit(True).alias("is_valid"), c.alias("category"),
                    ((F.col("o_orderkey") * 37) % 101).cast("double").alias("importance_score"), F.col("o_orderpriority").alias("title"))


_ANALYSES = f"""a AS (SELECT o_orderkey AS seq, {[*QUERY_CATEGORIES, "sports"]}[o_orderkey % 6 + 1] AS category, CAST((o_orderkey * 37) % 101 AS DOUBLE) AS score, o_orderpriority AS title FROM orders),
c AS (SELECT category, max(score) AS ms, arg_min(seq, (-score, seq)) AS fs FROM a GROUP BY category), o AS (SELECT a.*, ms, fs FROM a JOIN c USING (category)),
t7 AS (SELECT *, row_number() OVER (ORDER BY score DESC, ms DESC, fs, seq) AS rank FROM o WHERE score >= 70 QUALIFY rank <= 7), top AS (SELECT * FROM t7 WHERE (SELECT count(*) FROM t7 WHERE score >= 80) < 3 OR score >= 80),
s AS (SELECT seq, category AS section_id, row_number() OVER (PARTITION BY category ORDER BY score DESC, seq) AS rank, title FROM a WHERE category <> 'sports' AND seq NOT IN (SELECT seq FROM top) QUALIFY rank <= 8)"""


#: Row by row, with the number of items that each company has.
@registered("""WITH RECURSIVE n AS (SELECT s_suppkey AS seq, CAST((s_suppkey * 37) % 101 AS DOUBLE) AS score, list_distinct([s_nationkey, (s_suppkey * 7) % 11 + 100, (s_suppkey * 5) % 17 + 200]) AS names FROM supplier),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, seq) AS k FROM n),
scan(k, seq, kept, used) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), false, CAST([] AS BIGINT[])
  UNION ALL
  SELECT o.k, o.seq, len(list_filter(o.names, lambda c: len(list_filter(used, lambda u: u = c)) >= 3)) = 0,
    CASE WHEN len(list_filter(o.names, lambda c: len(list_filter(used, lambda u: u = c)) >= 3)) = 0 THEN list_concat(used, list_transform(o.names, lambda c: CAST(c AS BIGINT))) ELSE used END
  FROM scan JOIN o ON o.k = scan.k + 1)
SELECT seq FROM scan WHERE kept""")
def limited_companies(spark, sf):
    key = F.col("s_suppkey").cast("long")
    names = F.array(*[x.cast("string") for x in (F.col("s_nationkey").cast("long"), key * 7 % 11 + 100, key * 5 % 17 + 200)])
    items = read(spark, sf, "supplier").select(key.alias("seq"), ((key * 37) % 101).cast("double").alias("importance_score"), names.alias("companies_mentioned"))
    return extras.limited_companies(items).select("seq")


@registered(f"WITH {_ANALYSES} SELECT seq, category, score AS importance_score, rank FROM top")
def report_top_news(spark, sf):
    return report.top_news(_analyses(spark, sf)).select("seq", "category", "importance_score", F.col("rank").cast("long").alias("rank"))


@registered(f"WITH {_ANALYSES} SELECT seq, 'top_news' AS section_id, rank, 'item_' || lpad(rank::VARCHAR, 3, '0') AS item_id FROM top UNION ALL SELECT seq, section_id, rank, 'item_' || lpad(rank::VARCHAR, 3, '0') FROM s")
def report_sections(spark, sf):
    a = durable(_analyses(spark, sf))
    items = report.section_items(a, durable(report.top_news(a)))
    return items.select("seq", "section_id", F.col("rank").cast("long").alias("rank"), urls.item_id(F.col("rank")).alias("item_id"))


@registered(f"WITH {_ANALYSES}, i AS (SELECT 'top_news' AS section_id, title FROM top UNION ALL SELECT section_id, title FROM s) SELECT section_id, count(*) AS n_items, CAST(sum(length(title)) AS BIGINT) AS n_chars FROM i GROUP BY section_id")
def report_totals(spark, sf):
    a = durable(_analyses(spark, sf))
    items = report.section_items(a, durable(report.top_news(a)))
    return items.groupBy("section_id").agg(F.count("*").alias("n_items"), F.sum(F.length("title")).cast("long").alias("n_chars"))


@registered(f"""WITH o AS (SELECT o_orderkey AS seq, o_orderpriority AS title, CAST((o_orderkey * 37) % 101 AS DOUBLE) AS score, o_orderkey % 4 <> 0 AS has_text, o_orderkey % 3 = 0 AS corrected, o_orderkey % 2 = 0 AS claimed FROM orders),
d AS (SELECT *, score >= {params.RECHECK_SCORE} AND has_text AS due FROM o)
SELECT seq, CASE WHEN due AND corrected THEN 'better' ELSE 'plain' END AS details,
  array_to_string(list_concat(CASE WHEN due AND corrected THEN ['复核修订 details [' || substr(title, 1, 25) || ']'] ELSE [] END, CASE WHEN due AND claimed THEN ['无依据表述 [' || substr(title, 1, 25) || ']: claim ' || seq] ELSE [] END), '|') AS flags FROM d""")
def rechecks(spark, sf):
    key = F.col("seq")
    a = _analyses(spark, sf).withColumns({"details": F.lit("plain"), "source_text": F.when(key % 4 != 0, F.lit("text")).otherwise("")})
    checks = a.select("seq", F.when(key % 3 == 0, F.lit("better")).otherwise("").alias("corrected_details"), F.when(key % 2 == 0, F.array(F.concat(F.lit("claim "), key.cast("string")))).alias("unsupported_claims"))
    return report.apply_checks(a, checks).select("seq", "details", F.array_join("check_flags", "|").alias("flags"))


@registered(f"""WITH {_ANALYSES}, i AS (SELECT 'top_news' AS section_id, title FROM top UNION ALL SELECT section_id, title FROM s), n AS (SELECT section_id, count(*) AS n FROM i GROUP BY section_id)
SELECT 'daily_20240110' AS report_id, '2024-01-10' AS report_date, '2024-01-09 16:00:00' AS window_start, CAST(count(*) AS BIGINT) AS total_items, CAST(sum(length(title)) AS BIGINT) AS total_word_count, repeat('s', {params.SUMMARY_CHARS}) AS editor_summary,
  (SELECT string_agg(x || ':' || coalesce(n, 0), '|' ORDER BY k) FROM (SELECT unnest({[x for x, _ in params.SECTIONS]}) AS x, unnest(range({len(params.SECTIONS)})) AS k) LEFT JOIN n ON n.section_id = x) AS sections FROM i""")
def report_document(spark, sf):
    text = lambda name, kind="string": F.lit(None).cast(kind).alias(name)
    a = durable(_analyses(spark, sf).select("*", text("lead"), text("details"), text("summary"), text("analysis"), text("key_data", "array<struct<label:string,value:string>>")))
    items = report.section_items(a, durable(report.top_news(a)))
    none = a.select("seq", F.lit(None).cast("array<struct<name:string,url:string,is_official:boolean>>").alias("sources"))
    r = report.daily_report(report.report_items(items, none), dates.report_date(as_of()), as_of(), F.lit("s" * 400))
    parts = F.array_join(F.transform("sections", lambda x: F.concat(x["section_id"], F.lit(":"), x["item_count"].cast("string"))), "|")
    return r.select(
        "report_id", "report_date", F.date_format("time_window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), F.col("total_items").cast("long").alias("total_items"),
        F.col("total_word_count").cast("long").alias("total_word_count"), "editor_summary", parts.alias("sections"),
    )


@registered(f"WITH {_ANALYSES} SELECT seq, category FROM a WHERE seq NOT IN (SELECT seq FROM top) AND seq NOT IN (SELECT seq FROM s)")
def analyses_left_out(spark, sf):
    a = durable(_analyses(spark, sf))
    return report.left_out(a, report.section_items(a, durable(report.top_news(a)))).select("seq", "category")


def _domain_events(spark, sf):
    """Pages of a category and a hundred as one event."""
    a = articles(spark, sf).withColumn("group", F.floor(F.col("seq") / 10).cast("long"))
    groups = a.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("seq", "article_id"))).alias("m"), F.sort_array(F.collect_set("source_domain")).alias("source_domains"))
    names = F.when(F.col("group") % 2 == 0, F.array(F.lit("First name"), F.lit("Second name")))
    events = groups.select(F.col("group").alias("seq"), F.transform("m", lambda x: F.concat(F.lit("p"), x["seq"].cast("string"))).alias("article_ids"), "source_domains", names.alias("source_names"))
    return events, a.withColumn("article_id", F.concat(F.lit("p"), F.col("seq").cast("string")))


@registered(f"""WITH {ARTICLES}, f AS (SELECT seq // 10 AS g, source_domain, min(seq) AS s, arg_min(url, seq) AS url FROM articles GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s) AS i FROM f QUALIFY i <= 5)
SELECT g AS seq, string_agg(CASE WHEN g % 2 = 0 AND i = 1 THEN 'First name' WHEN g % 2 = 0 AND i = 2 THEN 'Second name' ELSE source_domain END || ' ' || url || ' ' || CAST(contains(source_domain, 'gov') OR contains(source_domain, 'arxiv.org') AS VARCHAR), '|' ORDER BY i) AS sources FROM k GROUP BY g""")
def source_list(spark, sf):
    events, members = _domain_events(spark, sf)
    out = report.sources(events.drop("source_names"), members, events.select("seq", "source_names"))
    return out.select("seq", F.array_join(F.transform("sources", lambda s: F.concat_ws(" ", s["name"], s["url"], s["is_official"].cast("string"))), "|").alias("sources"))


@registered(f"""WITH {ARTICLES}, m AS (SELECT seq // 10 AS g, row_number() OVER (PARTITION BY seq // 10 ORDER BY seq) AS i, snippet FROM articles QUALIFY i <= {params.CONTEXT_ARTICLES}) SELECT g AS seq, string_agg(snippet, chr(10) ORDER BY i) AS source_text FROM m GROUP BY g""")
def grounding_text(spark, sf):
    return report.source_texts(*_domain_events(spark, sf))


@registered("SELECT l_returnflag AS batch_id, count(*) AS total_queries, count(*) FILTER (l_linenumber <> 7) AS success_queries, count(*) FILTER (l_linenumber = 7) AS failed_queries, count(*) AS total_results, count(DISTINCT l_partkey) AS unique_results FROM lineitem GROUP BY l_returnflag")
def batch_stats(spark, sf):
    li = read(spark, sf, "lineitem")
    responses = li.select(F.col("l_returnflag").alias("batch_id"), F.when(F.col("l_linenumber") == 7, "late").alias("error"))
    return search.batch_stats(responses, li.select(F.col("l_returnflag").alias("batch_id"), F.col("l_partkey").alias("result_id")))


@registered("""WITH q AS (SELECT p_brand AS query, arg_max(p_type, p_partkey) AS category, arg_max(p_name, p_partkey) AS batch FROM part GROUP BY p_brand)
SELECT s_suppkey AS seq, o AS query_origin, q.category, q.batch AS search_batch, coalesce(q.query, o) AS search_query FROM (SELECT s_suppkey, 'Brand#' || (s_suppkey % 60) AS o FROM supplier) LEFT JOIN q ON q.query = o""")
def result_query_join(spark, sf):
    queries = read(spark, sf, "part").select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("query"), F.col("p_type").alias("category"), F.col("p_name").alias("batch_id"))
    results = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("seq"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 60).cast("string")).alias("query_origin"))
    return search.with_queries(results, queries)


@registered(f"""WITH {ARTICLES}, m AS (SELECT seq // 10 AS g, row_number() OVER (PARTITION BY seq // 10 ORDER BY seq) AS i, seq, source_domain, url FROM articles QUALIFY i <= 2), t AS (SELECT m.*, substr(trim(text), 1, {params.FULLTEXT_CHARS}) AS ft FROM m JOIN documents ON doc_id = seq)
SELECT g AS seq, string_agg(source_domain || ' ' || ft, '|' ORDER BY i) AS texts FROM t WHERE ft <> '' GROUP BY g""")
def full_texts(spark, sf):
    events, members = _domain_events(spark, sf)
    texts = members.select("seq", F.concat(F.col("url"), F.lit("#"), F.col("seq").cast("string")).alias("url")).join(read(spark, sf, "documents").select(F.col("doc_id").alias("seq"), "text"), "seq").select("url", "text")
    unique = members.withColumn("url", F.concat(F.col("url"), F.lit("#"), F.col("seq").cast("string")))
    out = report.full_texts(events, unique, texts)
    return out.select("seq", F.array_join(F.transform("fulltexts", lambda x: F.concat_ws(" ", x["domain"], x["fulltext"])), "|").alias("texts"))


@registered("SELECT o_orderkey AS seq, CAST((o_orderkey * 37) % 101 AS DOUBLE) AS importance_score FROM orders WHERE o_orderkey % 5 <> 0")
def valid_analyses(spark, sf):
    a = _analyses(spark, sf).withColumn("is_valid", F.when(F.col("seq") % 5 == 0, False).when(F.col("seq") % 5 == 1, True))
    return filters.valid_analyses(a).select("seq", "importance_score")


@registered(f"""WITH {ARTICLES}, m AS (SELECT seq // 10 AS g, row_number() OVER (PARTITION BY seq // 10 ORDER BY seq) AS i, * FROM articles QUALIFY i <= 6)
SELECT g AS seq, '## 事件：e' || g || chr(10) || '涉及公司：未知' || chr(10) || '来源：3 篇 / ' || (SELECT count(DISTINCT source_domain) FROM articles a WHERE a.seq // 10 = g) || ' 个域名' || chr(10) || '类型：None' || chr(10) || chr(10) || '### 相关文章：' || chr(10)
  || string_agg('--- ' || i || '. [' || source_domain || '] ---' || chr(10) || '标题: ' || title || chr(10) || 'URL: ' || url || chr(10) || '摘要: ' || substr(snippet, 1, {params.CONTEXT_SNIPPET_CHARS}) || chr(10), chr(10) ORDER BY i) AS context FROM m GROUP BY g""")
def event_context(spark, sf):
    events, members = _domain_events(spark, sf)
    e = events.select("seq", "article_ids", "source_domains", F.concat(F.lit("e"), F.col("seq").cast("string")).alias("canonical_title"), F.lit(3).alias("article_count"),
                      F.lit(None).cast("string").alias("event_type_guess"), F.array().cast("array<string>").alias("companies_mentioned"))
    return report.event_contexts(e, members)


@registered("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 8 HOURS, '%Y-%m-%d') AS report_date, strftime(date_trunc('day', o_orderdate + INTERVAL 8 HOURS) - INTERVAL 8 HOURS, '%Y-%m-%d %H:%M:%S') AS day_start, 'daily_' || strftime(o_orderdate + INTERVAL 8 HOURS, '%Y%m%d') AS report_id FROM orders")
def report_clock(spark, sf):
    day = dates.report_date(F.col("o_orderdate").cast("timestamp"))
    return read(spark, sf, "orders").select("o_orderkey", F.date_format(day, "yyyy-MM-dd").alias("report_date"), F.date_format(dates.report_day_start(day), "yyyy-MM-dd HH:mm:ss").alias("day_start"), urls.report_id(day).alias("report_id"))


@registered(f"""WITH {ARTICLES}, r AS (SELECT * FROM articles WHERE published_at IS NULL OR published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOURS), id AS (SELECT *, 'art_' || substr(sha256({NORMALIZED}), 1, 12) AS article_id FROM (SELECT *, url AS u, published_at IS NULL AS late FROM r))
SELECT article_id, arg_min(title, (late, seq)) AS title, arg_min(source_domain, (late, seq)) AS source_domain, count(*) AS result_count FROM id GROUP BY article_id""")
def collected_articles(spark, sf):
    """The flagship: pages to recent articles, one for each URL."""
    a = dedup.dedup_by_url(filters.undated_last(filters.recent(articles(spark, sf), as_of())))
    return a.select("article_id", "title", "source_domain", F.col("result_count").cast("long").alias("result_count"))
