"""Counts, guards, ledgers, quarantine, publication and commands: what a run keeps of itself."""

import json
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidewire.operators import backfill, extras, filters, history
from tidewire.plans import daily
from tidewire.settings import Settings
from tidewire.sources import files, models, search
from tidewire.types import ARTICLE

from test_operators import article, table
from test_sources import AS_OF, rows


def counting_send(folder):
    """A model that leaves a file for each call, so that calls of all tasks can be counted; some answers are no JSON at first."""
    import uuid
    from pathlib import Path

    def send(system, user):
        mark = uuid.uuid4().hex
        tried = len(list(Path(folder).glob(f"{hash(user) & 0xFFFF:x}-*")))
        answer = "nonsense" if "0" in user and tried == 0 else '{"importance_score": 90, "title": "T", "category": "policy", "details": "d", "corrected_details": "c"}'
        if "never" in user:
            answer = "nonsense"
        (Path(folder) / f"{hash(user) & 0xFFFF:x}-{mark}").write_text(json.dumps([len(system) + len(user), len(answer)]))
        return answer

    return send


def test_counts_of_model_calls(spark, tmp_path):
    """Calls, retries and characters over several tasks, failed events included, equal those that the model itself saw."""
    contexts = spark.createDataFrame([(k, f"e{k}", f"context {k}" + " never" * (k == 7)) for k in range(40)], "seq bigint, event_id string, context string").repartition(5)
    run = daily.RunReport("test")
    out = models.analyse(contexts, counting_send(tmp_path), "prompt", watch=run.watch("analyse"))
    run.take("none")
    assert out.count() == 39
    run.take("analyse")
    seen = [json.loads(p.read_text()) for p in tmp_path.iterdir()]
    counts = run.row(spark).first()["counts"]
    expected = {"asked": 40, "answered": 39, "calls": len(seen), "retries": len(seen) - 40, "prompt_chars": sum(a for a, _ in seen), "completion_chars": sum(b for _, b in seen)}
    assert counts == {f"analyse_{k}": v for k, v in expected.items()} and len(seen) > 45


def test_counts_of_search_calls(spark, tmp_path):
    """Every batch is asked for as often as the counts say, and not again when its rows are used twice."""
    import uuid
    from pathlib import Path

    folder = str(tmp_path)

    def service(asked):
        (Path(folder) / uuid.uuid4().hex).write_text("x")
        if any(q == "boom" for q, _ in asked):
            raise RuntimeError("down")
        return "".join(f"\n## Query {k}: {q}\n\n## Search Results (1 results, 1ms)\n\n### 1. About {q}\n- **URL**: https://s.com/{q}\n- text\n" for k, (q, _) in enumerate(asked, 1))

    queries = spark.createDataFrame([(k, "boom" if k == 6 else f"q{k}", 5, "policy", "b") for k in range(12)], "seq bigint, query string, max_results int, category string, batch_id string")
    counts = {}
    responses, results = search.search(queries, service, AS_OF, pause=0, counts=counts)
    assert results.count() == 7 and responses.count() == 12 and responses.where("error IS NULL").count() == 7
    assert (counts["batches"], counts["failed"], counts["calls"], counts["retries"], counts["total"], counts["good"]) == (3, 1, 4, 1, 12, 7)
    assert len(list(tmp_path.iterdir())) == 4
    filters.check_searches(counts)
    with pytest.raises(RuntimeError, match="all searches"):
        filters.check_searches({"total": 3, "good": 0})
    filters.check_searches({"total": 0, "good": 0})


def jobs(spark, action):
    """Spark jobs that ``action`` runs."""
    import uuid

    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        action()
    finally:
        spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_the_guard_costs_no_job(spark):
    """A run with its guard has the jobs of one without; the guard that counted first had one more."""
    arts = table(spark, [article(k, f"title {k}") for k in range(8)])
    # plans that adapt have jobs that come and go
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    with_guard = jobs(spark, lambda: daily.fresh_events(arts, AS_OF, guard=filters.enough, found={}))
    without = jobs(spark, lambda: daily.fresh_events(arts, AS_OF))
    counted = jobs(spark, lambda: (filters.enough(arts.limit(5).count()), daily.fresh_events(arts, AS_OF)))
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert with_guard == without < counted
    run = daily.RunReport("test")
    daily.brief(arts, AS_OF, run=run)
    counts = run.row(spark).first()["counts"]
    assert counts["articles"] == 8 and 1 <= counts["cluster_largest_group"] <= 8
    with pytest.raises(RuntimeError, match="too few"):
        daily.brief(arts.limit(2), AS_OF, run=run)
    assert run.flags == ["too few articles"]


def test_records_that_do_not_fit(spark, tmp_path):
    good = rows(3)
    bad = [good[0] | {"result_count": "many"}, 7, good[1] | {"title": " "}, None, good[2] | {"url": None, "title": None}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps([good[0], bad[0], good[1], *bad[1:], good[2] | {"more": {"x": 1}}]))
    (tmp_path / "in" / "b.json").write_text("[{")
    (tmp_path / "in" / "c.json").write_text("[]")
    arts, rejected = files.scan_articles(spark, str(tmp_path / "in"))
    assert [r["article_id"] for r in arts.orderBy("seq").collect()] == ["a0", "a1", "a2"] and arts.columns == ARTICLE.names
    assert arts.first()["fetched_at"] is not None
    reasons = sorted((r["reason"], r["pos"]) for r in rejected.collect() if r["pos"] is not None)
    assert reasons == [("no object", 3), ("no object", 5), ("value of another type", 1), ("without title", 4), ("without title, url", 6)]
    root = str(tmp_path / "q")
    counts = files.quarantine(rejected, root, "2026-08-20")
    assert counts == {"records": 6, "incomplete": 2, "no_JSON_array": 1, "no_object": 2, "value_of_another_type": 1}
    assert spark.read.parquet(root).where("reason = 'no JSON array'").first()["record"] == "[{"
    plain = files.read_articles(spark, str(tmp_path / "in" / "c.json"))
    assert plain.count() == 0


def test_a_backfill_goes_on(spark, tmp_path):
    """A fetch that fails at its third category is completed later; no query is asked for twice."""
    arts = table(spark, [article(k, f"title {k} {'x' * k}", category="other") for k in range(3)])
    asked, down = [], [True]

    def fetch(queries):
        found = [(r["seq"], r["query"], r["category"]) for r in queries.collect()]
        if found and len({c for *_, c in asked}) == 2 and down[0]:
            raise OSError("down")
        asked.extend(found)
        return spark.createDataFrame([(s, q, f"About {q} {s * 7919}", f"https://n.com/{s}", "n.com", "snippet") for s, q, _ in found], "seq bigint, query_origin string, title string, url string, source_domain string, snippet string")

    ledger = str(tmp_path / "ledger")
    with pytest.raises(OSError, match="down"):
        backfill.backfill(arts, fetch, AS_OF, ledger=ledger)
    half = len(asked)
    down[0] = False
    out = backfill.backfill(arts, fetch, AS_OF, ledger=ledger)
    whole = {(r["seq"], r["query"]) for r in backfill.backfill_queries(backfill.deficits(arts)).collect()}
    assert 0 < half < len(asked) and len(asked) == len(whole) == len({(s, q) for s, q, _ in asked})
    plain = backfill.backfill(arts, lambda q: fetch(q), AS_OF)
    assert {r["url"] for r in out.collect()} == {r["url"] for r in plain.collect()}
    # results of a fetch that was never listed are not read
    results = f"{ledger}/results"
    spark.read.parquet(results).withColumn("fetch", F.lit("broken")).write.mode("append").parquet(results)
    before = len(asked)
    assert backfill.backfill(arts, fetch, AS_OF, ledger=ledger).count() == out.count() and len(asked) == before


def test_a_report_is_published_at_once(spark, tmp_path):
    path = str(tmp_path / "report")
    files.write_report(spark.createDataFrame([("old", 1)], "id string, n int"), path)
    assert spark.read.json(path).first()["id"] == "old"
    broken = spark.range(1).select(F.raise_error(F.lit("no")).cast("string").alias("id"))
    with pytest.raises(Exception, match="no"):
        files.write_report(broken, path)
    with pytest.raises(RuntimeError, match="whole"):
        files.write_report(spark.createDataFrame([], "id string"), path)
    assert spark.read.json(path).first()["id"] == "old"
    files.write_report(spark.createDataFrame([("new", 2)], "id string, n int"), path)
    assert spark.read.json(path).first()["id"] == "new" and [p.name for p in tmp_path.iterdir()] == ["report"]


def test_history_as_an_index(spark, tmp_path):
    """Days are appended, old ones are not read, nothing of the index is exchanged, and hits are those of the whole history."""
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    title = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))
    name, where = "title_index_test", str(tmp_path / "index")
    history.open_index(spark, name, where)
    all_rows = []
    for day in (14, 17, 18, 19, 20):
        made = [(f"f{k % 2}", k, title()) for k in range(15)]
        all_rows += [(f"2026-08-{day}", *r) for r in made]
        day_rows = spark.createDataFrame(made, "file string, pos bigint, canonical_title string")
        history.index_titles(day_rows.withColumn("report_date", F.lit(f"2026-08-{day}").cast("date")), name)
    before = spark.createDataFrame(all_rows, "report_date string, file string, pos bigint, canonical_title string").withColumn("report_date", F.to_date("report_date"))
    events = spark.createDataFrame([(k, title()) for k in range(40)], "seq bigint, canonical_title string")
    today = F.lit("2026-08-20").cast("date")
    expected = history.first_hits(events, history.recent_titles(before, AS_OF, today))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = history.indexed_hits(events, name, AS_OF, today)
        plan = got._jdf.queryExecution().executedPlan().toString()
        found = sorted(map(tuple, got.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert found == sorted(map(tuple, expected.collect())) and len(found) > 5
    lines = plan.splitlines()
    scan = next(k for k, x in enumerate(lines) if "FileScan parquet" in x)
    depth = lines[scan].index("FileScan")
    above = []
    for x in reversed(lines[:scan]):
        at = len(x) - len(x.lstrip(" :+-"))
        if at < depth:
            above.append(x.strip(" :+-"))
            depth = at
    join = next(k for k, x in enumerate(above) if "SortMergeJoin" in x)
    assert not any("Exchange" in x for x in above[:join]) and "Bucketed: true" in lines[scan] and "PartitionFilters: [isnotnull" in lines[scan]
    spark.sql(f"DROP TABLE {name}")
    history.open_index(spark, name, where)
    assert spark.table(name).count() > 0
    spark.sql(f"DROP TABLE {name}")


def test_index_deals_titles_by_their_rare_bigrams(spark, tmp_path):
    """Bigrams that few titles have stand first, so that titles do not meet by those that all have; later days keep the order."""
    name, where = "titles_by_rarity", str(tmp_path / "index")
    history.open_index(spark, name, where)
    words = [f"{chr(0x4E00 + 3 * k)}{chr(0x4E01 + 3 * k)}{chr(0x4E02 + 3 * k)}" for k in range(40)]
    for day, some in ((18, words[:20]), (19, words[20:])):
        titles = spark.createDataFrame([("f", k, f"thecommonwords{w}") for k, w in enumerate(some)], "file string, pos bigint, canonical_title string")
        history.index_titles(titles.withColumn("report_date", F.lit(f"2026-08-{day}").cast("date")), name)
    prefixes = {r["key"]: set(r["g"]) for r in spark.table(name).groupBy("key").agg(F.collect_set("gram").alias("g")).collect()}
    assert len(prefixes) == 40 and all({f"s{w[0]}", w[:2], w[1:]} <= prefixes[f"thecommonwords{w}"] for w in words)
    assert spark.table(f"{name}_order").where("gram = 'th'").first()["f"] == 20
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"DROP TABLE {name}_order")


def test_companies_have_room_in_order(spark):
    """Greedy choice equals a plain loop, ties and items without companies included."""
    rng = random.Random(8)
    items = [(k, float(rng.randint(0, 9)), rng.sample("ABCDEFG", rng.randint(0, 3)) if k % 11 else None) for k in range(120)]
    df = spark.createDataFrame(items, "seq bigint, importance_score double, companies_mentioned array<string>")
    used, kept = {}, []
    for seq, _, names in sorted(items, key=lambda r: (-r[1], r[0])):
        if all(used.get(c, 0) < 3 for c in names or []):
            kept.append(seq)
            for c in names or []:
                used[c] = used.get(c, 0) + 1
    assert sorted(r["seq"] for r in extras.limited_companies(df).collect()) == sorted(kept)
    assert extras.limited_companies(df.limit(0)).count() == 0


def test_chat_service():
    sent = []

    def post(request, timeout):
        sent.append((request.full_url, dict(request.header_items()), json.loads(request.data), timeout))
        return json.dumps({"choices": [{"message": {"content": "hello"}}]}).encode()

    send = models.chat_service("http://m/v1/", "small", "k", 9, post=post)
    assert send("", "hi") == "hello" and sent[0][0] == "http://m/v1/chat/completions" and sent[0][3] == 9
    assert sent[0][1]["Authorization"] == "Bearer k" and sent[0][2]["messages"] == [{"role": "user", "content": "hi"}]


def test_settings():
    s = Settings.from_environment({"TIDEWIRE_MODEL": " m ", "TIDEWIRE_ZONE": "Europe/Paris", "TIDEWIRE_TIMEOUT": "5", "TIDEWIRE_SEARCH_KEY": ""})
    assert (s.model, s.zone, s.timeout, s.search_key) == ("m", "Europe/Paris", 5.0, None)
    assert Settings.from_environment({}) == Settings()
    with pytest.raises(Exception, match="No time zone"):
        Settings.from_environment({"TIDEWIRE_ZONE": "Nowhere/None"})


def test_a_whole_run(spark, tmp_path, capsys):
    """Strategy to page: search, collection, backfill, events, analyses, report, history."""
    from tidewire.__main__ import main

    config = tmp_path / "s.yaml"
    config.write_text("search_strategy:\n  batches:\n  - {batch_id: policy, queries: [{query: one}, {query: two}, {query: three}, {query: four}, {query: five}, {query: six}]}\n")

    def service(asked):
        block = "\n## Query {k}: {q}\n\n## Search Results (1 results, 1ms)\n\n### 1. {t}\n- **URL**: https://s{h}.com/2026/08/19/{h}\n- words of {q}\n"
        return "".join(block.format(k=k, q=q, h=(h := sum(map(ord, q)) * 7919 % 9973), t=f"{chr(0x4E00 + h)}{chr(0x5E00 + h)} {q[::-1]}") for k, (q, _) in enumerate(asked, 1))

    def send(system, user):
        return '{"importance_score": 88, "title": "<Title>", "category": "policy", "details": "d", "key_data": []}'

    common = ["--as-of", "2026-08-20 00:00:00"]
    report, hist = str(tmp_path / "report"), str(tmp_path / "events")
    args = ["run", str(config), *common, "--report", report, "--history", hist, "--ledger", str(tmp_path / "ledger")]
    assert main(args, settings=Settings(zone="UTC"), service=service, send=send) == 0
    said = capsys.readouterr().out
    assert "analyse_calls" in said and "search_calls -> 2" in said and "backfill_calls" in said
    found = spark.read.json(f"{report}/report_date=2026-08-20").first()
    assert found["total_items"] > 0 and (tmp_path / "report" / "report_2026-08-20.html").exists()
    assert files.read_event_table(spark, hist).count() > 0
    out = str(tmp_path / "articles")
    assert main(["collect", str(config), *common, "--out", out], settings=Settings(), service=service) == 0 and spark.read.json(out).count() > 6
    assert main(["collect", str(config), *common, "--out", out], settings=Settings()) == 1
    assert "TIDEWIRE_SEARCH_URL" in capsys.readouterr().err
    assert isinstance(daily.RunReport("x").watch("y"), Observation)


def test_table_functions(spark):
    """SQL table functions give the rows of the operators, for odd responses too."""
    from tidewire.operators import search as operators
    from tidewire.sources import tablefunctions

    item = "\n### {k}. {t}\n- **URL**: {u}\n- {b}\n"
    texts = [
        "## Search Results (2 results, 3ms)\n" + item.format(k=1, t=" A title\u3000", u="https://www.e.com:80/x", b="A title – 🚨 now REGISTER NOW. rest\nmore") + item.format(k=2, t="B", u="no-url", b="Posted by x, 2026 - body\u00a0"),
        "\n## Query 1: one\n\n" + item.format(k=1, t="T", u="http://a.b/c", b="FLASH SALE today register now") + "\n## Query 2:  two \n", "## Query 1: lone\nbody", "lead\n## Query 1: a\nx\n## Query 2: b", "", None,
        item.format(k=9, t="É\x85", u="HTTPS://E.com/É?q", b="line one\r\nline two\x0b"), "### 1. broken\n- **URL**: \n- x", "(12345678901 results)" + item.format(k=1, t="t", u="u", b="(7 results"),
    ]
    spark.createDataFrame(list(enumerate(texts)), "id bigint, markdown string").repartition(3).createOrReplaceTempView("responses")
    tablefunctions.register_parsers(spark)
    columns = ["id", "pos", "total_found", "title", "url", "snippet", "source_domain", "result_id"]
    table_ = spark.table("responses").where("id <> 8")
    want = operators.parse_results(table_, AS_OF).select(columns)
    got = spark.sql("SELECT * FROM parse_results(TABLE(SELECT id, markdown FROM responses WHERE id <> 8))").select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 4
    want = operators.split_batches(table_).select("id", "pos", "query_text", "markdown")
    got = spark.sql("SELECT * FROM split_batches(TABLE(SELECT id, markdown FROM responses WHERE id <> 8))")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

    def send(system, user):
        if "bad" in user:
            raise OSError("down")
        return '{"importance_score": 7, "title": "' + user + '", "key_data": [{"label": "n", "value": 1}]}'

    tablefunctions.register_model(spark, send, retries=1)
    spark.createDataFrame([(1, "e1", "one"), (2, "e2", "bad")], "seq bigint, event_id string, context string").createOrReplaceTempView("contexts")
    rows_ = spark.sql("SELECT seq, title, key_data[0].value AS v FROM analyse(TABLE(contexts))").collect()
    assert [tuple(r) for r in rows_] == [(1, "one", "1")]
    asked = spark.sql("SELECT * FROM ask(TABLE(SELECT seq AS id, context FROM contexts))").collect()
    assert sorted((r["id"], r["answer"] is None, r["calls"]) for r in asked) == [(1, False, 1), (2, True, 2)]


def test_a_second_service(spark):
    sent = []

    def send(request, timeout):
        sent.append(json.loads(request.data))
        return json.dumps({"results": [{"title": "t", "url": "https://www.s.com/x", "content": "c", "published_date": "2026-08-19", "score": 0.5}, {"url": "u", "domain": "d.com"}]}).encode()

    service = search.QueryService("http://s", "k", time_range="day", send=send)
    first, second = service("q", 3)
    assert first == {"title": "t", "url": "https://www.s.com/x", "snippet": "c", "published": "2026-08-19", "score": 0.5, "domain": None} and second["domain"] == "d.com"
    assert (sent[0]["query"], sent[0]["max_results"], sent[0]["time_range"]) == ("q", 3, "day") and search.QueryService("http://s", None)("q", 3) == []
    rows_ = spark.createDataFrame([(0, "q0", 10, "a")], "seq bigint, query string, max_results int, category string")
    got = search.supplement(rows_, lambda q, n: [{"title": "T", "url": "https://x.com/1", "domain": "named.com"}, {"title": "U", "url": "https://x.com/2"}], 1).collect()
    assert sorted(r["source_domain"] for r in got) == ["named.com", "x.com"]


def test_topics_and_single_sources(spark):
    from tidewire.functions import scoring

    df = spark.createDataFrame([(["Made up", " GPU", "AI-Chip", "gpu", "", None, "other", "eu", "us", "ipo"],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(scoring.topic_labels(F.col("t"))).collect()] == [["gpu", "ai_chip", "eu", "us", "ipo"], []]
    arts = table(spark, [article(0, "Raises 7.5 billion", source_domain="a.com"), article(1, "It raises 7.5 billion", source_domain="b.com"), article(2, "It raises 7.5 billion", source_domain="c.com"),
                         article(3, "17.5 and 30", source_domain="d.com"), article(4, "30 people", source_domain="d.com")])
    events = spark.createDataFrame([(0, [f"a{k}" for k in range(5)])], "seq bigint, article_ids array<string>")
    made = spark.createDataFrame([(0, [("raised", "$7.5 billion"), ("staff", "30"), ("other", "75"), ("none", "many")])], "seq bigint, key_data array<struct<label:string,value:string>>")
    got = {r["label"]: (r["n_domains"], r["single_source"]) for r in extras.number_support(made, events, arts).collect()}
    assert got == {"raised": (2, False), "staff": (1, True), "other": (0, True)}
