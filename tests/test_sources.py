"""Sources, sinks, whole runs, streams and the registry."""

import json
import urllib.error
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewire import queries
from tidewire.plans import daily
from tidewire.sources import files, search
from tidewire.types import ARTICLE

AS_OF = F.lit("2026-08-20 00:00:00").cast("timestamp")


SUBJECTS = "quantum harvest|violet bridge|northern kelp|glass violin|muddy orchard|copper lantern".split("|")


def rows(n):
    base = dict.fromkeys(ARTICLE.names)
    return [
        base | {"article_id": f"a{k}", "title": SUBJECTS[k // 2 % 6] + "!" * (k % 2), "url": f"https://e{k % 3}.com/{k}", "source_domain": f"e{k % 3}.com", "content": "", "snippet": f"snippet {k}",
                "source_reliability": "low", "result_count": 1, "category": "policy", "fetched_at": "2026-08-19T00:00:00Z"} for k in range(n)
    ]


def test_article_file(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps(rows(5)))
    df = files.read_articles(spark, str(path))
    assert [r["article_id"] for r in df.orderBy("seq").collect()] == [f"a{k}" for k in range(5)]
    files.write_articles(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 5


def test_history_round_trip(spark, tmp_path):
    root = str(tmp_path / "events")
    df = spark.createDataFrame([(0, "one"), (1, "two")], "seq bigint, canonical_title string")
    files.write_events(df, root, "2026-08-18")
    files.write_events(df.limit(1), root, "2026-08-19")
    got = sorted((str(r["report_date"]), r["canonical_title"]) for r in files.read_event_table(spark, root).collect())
    assert got == [("2026-08-18", "one"), ("2026-08-18", "two"), ("2026-08-19", "one")]
    day = tmp_path / "json" / "2026-08-17"
    day.mkdir(parents=True)
    (tmp_path / "json" / "junk").mkdir()
    (day / "e.json").write_text(json.dumps([{"canonical_title": "a"}, {"canonical_title": ""}]))
    (tmp_path / "json" / "junk" / "e.json").write_text(json.dumps([{"canonical_title": "b"}]))
    assert [(str(r["report_date"]), r["canonical_title"]) for r in files.read_history(spark, str(tmp_path / "json")).collect()] == [("2026-08-17", "a")]


def test_rpc_retries_and_errors():
    calls, naps = [], []

    def send(request, timeout):
        calls.append(json.loads(request.data))
        if len(calls) < 3:
            raise urllib.error.HTTPError("u", 503, "busy", None, None)
        return json.dumps({"result": {"content": [{"text": "ok"}]}}).encode()

    service = search.RpcService("http://x", "k", send=send, sleep=naps.append)
    assert service([("q", 3)]) == "ok" and naps == [1.0, 2.0]
    assert calls[0]["params"]["arguments"] == {"queries": [{"query": "q", "max_results": 3}]}
    bad = search.RpcService("http://x", send=lambda r, t: json.dumps({"error": "no"}).encode())
    with pytest.raises(search.RpcError):
        bad([("q", 1)])


def test_search(spark):
    def fake_service(asked):
        if any(q == "boom" for q, _ in asked):
            raise RuntimeError("down")
        return "".join(f"\n## Query {k}: {q}\n\n## Search Results (1 results, 1ms)\n\n### 1. About {q}\n- **URL**: https://s.com/{q}\n- text on 2026-08-19\n" for k, (q, _) in enumerate(asked, 1))

    queries_ = spark.createDataFrame([(k, "boom" if k == 6 else f"q{k}", 5, "policy", "b") for k in range(8)], "seq bigint, query string, max_results int, category string, batch_id string")
    responses, results = search.search(queries_, fake_service, AS_OF, pause=0)
    assert {r["seq"]: r["error"] for r in responses.collect()} == {k: ("down" if k >= 5 else None) for k in range(8)}
    got = daily.collect(results, queries_, AS_OF, threshold=0.99).collect()
    assert sorted(r["search_query"] for r in got) == [f"q{k}" for k in range(5)]
    assert {r["category"] for r in got} == {"policy"} and got[0]["published_at"] == datetime(2026, 8, 19)


def test_table_source(spark):
    search.register_table_source(spark, "pairs", lambda options: [(int(options["n"]), "x")], "k int, v string")
    assert [tuple(r) for r in spark.read.format("pairs").option("n", 3).load().collect()] == [(3, "x")]


def test_brief(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps(rows(12)))
    arts = files.read_articles(spark, str(path))

    def analyse(contexts):
        score = F.lit(90.0) - F.col("seq")
        kd = F.array(F.struct(F.lit("k").alias("label"), F.lit("999").alias("value")))
        return contexts.select("seq", "event_id", F.lit(True).alias("is_valid"), F.lit("policy").alias("category"), score.alias("importance_score"), F.concat(F.lit("<T"), F.col("seq").cast("string"), F.lit(">")).alias("title"),
                               F.lit("lead").alias("lead"), F.lit("d").alias("details"), F.lit("").alias("summary"), F.lit(None).cast("string").alias("analysis"), kd.alias("key_data"), F.lit(None).cast("array<string>").alias("source_names"))

    def verify(due):
        return due.select("seq", F.lit("checked").alias("corrected_details"), F.lit(None).cast("array<string>").alias("unsupported_claims"))

    run = daily.RunReport("test")
    out = daily.brief(arts, AS_OF, analyse=analyse, verify=verify, summarise=lambda titles: " / ".join(titles), run=run)
    row = out["report"].first()
    assert row["total_items"] == out["items"].count() > 0 and "<T0>" in row["editor_summary"]
    assert any("999" in f for f in row["quality_flags"])
    page = files.render_html(out["report"])
    assert "&lt;T0&gt;" in page and "checked" in page
    saved = files.save_html(page, str(tmp_path), row["report_date"])
    assert files.versioned_path(str(tmp_path), row["report_date"], ".html").endswith("_v2.html") and saved.endswith(".html")
    assert run.row(spark).first()["success"] and {"cluster", "select", "analyse", "report"} <= set(run.stages)
    with pytest.raises(RuntimeError, match="too few"):
        daily.brief(arts.limit(2), AS_OF)


def test_streams(spark, tmp_path):
    from tidewire import streaming

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps(r | {"article_id": "same" if k < 3 else f"a{k}"}) for k, r in enumerate(rows(5))))
    first = streaming.first_sightings(streaming.article_stream(spark, str(folder)))
    q = first.writeStream.format("memory").queryName("first").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("first").count() == 3
    hist, sink = str(tmp_path / "h"), str(tmp_path / "s")
    spark.createDataFrame([(datetime(2026, 8, 19).date(), "f", 0, "seen story")], "report_date date, file string, pos int, canonical_title string").write.parquet(hist)
    src = str(tmp_path / "ev")
    spark.createDataFrame([(0, "seen story"), (1, "another one")], "seq bigint, canonical_title string").write.json(src)
    stream = spark.readStream.schema("seq bigint, canonical_title string").json(src)
    q = streaming.suppress_seen(stream, hist, sink, str(tmp_path / "c2"))
    q.processAllAvailable()
    q.stop()
    assert [r["seq"] for r in spark.read.parquet(sink).collect()] == [1]


def test_schemas_and_prompts(tmp_path):
    assert set(files.export_schemas()) >= {"NewsEvent", "ReportItem"}
    assert files.load_prompt(str(tmp_path / "none")) == ""


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_agrees(spark, sf, name):
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents pages").split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf).toPandas()
    want = con.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.replace({"None": "nan", "NaT": "nan"}).equals(b.replace({"None": "nan", "NaT": "nan"}))


def test_models(spark):
    from tidewire.sources import models

    assert models.json_object('{"a": 1} and {"b": 2') == {"a": 1} and models.json_object('x ```json\n{"a": [1,],}\n``` y') == {"a": [1]}
    with pytest.raises(ValueError, match="no JSON"):
        models.json_object("nothing")
    answers = iter(["bad", '{"x": 1}'])
    model = models.ChatModel(lambda s, u: next(answers))
    assert model.json("", "") == {"x": 1} and model.stats == {"calls": 2, "retries": 1, "prompt_chars": 0, "completion_chars": 11}

    def send(system, user):
        if "two" in user:
            raise OSError("down")
        return '{"importance_score": "91", "title": "T", "category": "policy", "key_data": [{"label": "n", "value": 7}, 3], "corrected_details": "c"}'

    contexts = spark.createDataFrame([(1, "e1", "one"), (2, "e2", "two")], "seq bigint, event_id string, context string")
    (row,) = models.analyse(contexts, send).collect()
    assert (row["event_id"], row["importance_score"], row["is_valid"], [tuple(k) for k in row["key_data"]]) == ("e1", 91.0, True, [("n", "7")])
    due = spark.createDataFrame([(1, "t", "d", "s"), (2, "two", "d", None)], "seq bigint, title string, details string, source_text string")
    assert [(r["seq"], r["corrected_details"]) for r in models.verify(due, send).collect()] == [(1, "c")]

    def extract(url):
        return {"u1": "text"}[url]

    assert {tuple(r) for r in models.fetch_texts(spark.createDataFrame([("u1",), ("u2",), ("u1",)], "url string"), extract).collect()} == {("u1", "text"), ("u2", "")}


def test_supplement(spark):
    rows = spark.createDataFrame([(k, f"q{k}", 10, c) for k, c in enumerate("aab")], "seq bigint, query string, max_results int, category string")

    def fetch(query, n):
        if query == "q2":
            raise OSError("down")
        return [{"title": f"{query} {n}", "url": "https://www.s.com/x", "published": "Aug 19, 2026"}]

    got = search.supplement(rows, fetch, 2).collect()
    assert [(r["query_origin"], r["title"], r["source_domain"], str(r["published_at"])) for r in got] == [("q0", "q0 7", "s.com", "2026-08-19 00:00:00")]


def test_commands(spark, tmp_path, capsys):
    from tidewire.__main__ import main

    config = tmp_path / "s.yaml"
    config.write_text("search_strategy:\n  batches:\n  - {batch_id: l, queries: [{query: one}, {query: two}]}\n")
    assert main(["info", str(config)]) == 0 and main(["queries", str(config), "--batch", "none"]) == 1
    path = tmp_path / "a.json"
    path.write_text(json.dumps(rows(12)))
    history = str(tmp_path / "events")
    assert main(["brief", "--from-file", str(path), "--history", history, "--as-of", "2026-08-20 00:00:00"]) == 0
    assert files.read_event_table(spark, history).count() > 0
    path.write_text(json.dumps(rows(2)))
    assert main(["brief", "--from-file", str(path)]) == 1
