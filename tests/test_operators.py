"""Operators against hand-made cases and independent plain-Python models."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewire import params
from tidewire.operators import backfill, cluster, dedup, filters, history, querygen, report, search, select, similarity
from tidewire.operators.graph import components, durable
from tidewire.operators.similarity import distinct_sets, similar_sets
from tidewire.types import ANALYSIS, ARTICLE, EVENT, HISTORY

AS_OF = F.lit("2026-08-20 00:00:00").cast("timestamp")
GRADES = ("unknown", "low", "medium", "high")


def article(seq, title="t", url=None, snippet="", reliability="unknown", **more):
    row = dict.fromkeys(ARTICLE.names) | {
        "seq": seq, "article_id": f"a{seq}", "title": title, "url": url or f"https://e.com/{seq}", "source_domain": "e.com", "content": "", "snippet": snippet,
        "source_reliability": reliability, "result_count": 1,
    } | more
    return tuple(row[n] for n in ARTICLE.names)


def table(spark, rows):
    return spark.createDataFrame(rows, ARTICLE)


def key(title):
    return re.sub(r"[^\w]", "", (title or "").lower())


def grams(title, blank):
    k = key(title)
    return {k[i : i + 2] for i in range(len(k) - 1)} if len(k) >= 2 else ({k} if k or blank else set())


def alike(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def model_title_dedup(rows, t):
    """Meetings of every living pair in order."""
    dead = set()
    g = [grams(r[1], True) for r in rows]
    for i in range(len(rows)):
        if i in dead:
            continue
        for j in range(i + 1, len(rows)):
            if j in dead or alike(g[i], g[j]) < t:
                continue
            wi, wj = GRADES.index(rows[i][3]), GRADES.index(rows[j][3])
            if wi > wj or wi == wj and len(rows[i][2]) >= len(rows[j][2]):
                dead.add(j)
            else:
                dead.add(i)
                break
    return {rows[k][0] for k in range(len(rows)) if k not in dead}


def random_titles(rng, n):
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    out = []
    for _ in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(0, 5))]
        if t and rng.random() < 0.3:
            t[rng.randrange(len(t))] += rng.choice("xyz")
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_title_dedup_matches_the_model(spark, seed):
    rng = random.Random(seed)
    rows = [(k, t, "s" * rng.randint(0, 3), rng.choice(GRADES)) for k, t in enumerate(random_titles(rng, 60))]
    df = table(spark, [article(s, t, snippet=x, reliability=g) for s, t, x, g in rows])
    assert {r["seq"] for r in dedup.dedup_by_title(df, 0.7).collect()} == model_title_dedup(rows, 0.7)


def test_title_dedup_in_pieces(spark):
    """Components in pieces of a few rows, by rounds, give what the model gives."""
    rng = random.Random(9)
    rows = [(k, t, "s" * rng.randint(0, 3), rng.choice(GRADES)) for k, t in enumerate(random_titles(rng, 90))]
    df = table(spark, [article(s, t, snippet=x, reliability=g) for s, t, x, g in rows])
    assert {r["seq"] for r in dedup.dedup_by_title(df, 0.7, piece=20).collect()} == model_title_dedup(rows, 0.7)


def test_title_dedup_of_a_chain(spark):
    """Ten thousand titles each alike to the next only: every other one survives. Copies of one title never form a group."""
    n = 10_000
    codes = [chr(0x4E00 + k) for k in range(n + 12)]
    links = spark.range(n - 1).selectExpr("lpad(id, 5, '0') AS a", "lpad(id + 1, 5, '0') AS b")
    rows = spark.range(n).selectExpr("'chain' AS label", "lpad(id, 5, '0') AS key", "id AS seq", "1 AS weight", "1 AS length")
    assert sorted(r["kept"] for r in dedup._settled(rows, links, 4000).collect()) == list(range(0, n, 2))
    titles = ["".join(codes[k : k + 10]) for k in range(60)]
    df = table(spark, [article(k, t, reliability="low") for k, t in enumerate(titles)])
    assert sorted(r["seq"] for r in dedup.dedup_by_title(df, 0.79).collect()) == list(range(0, 60, 2))
    copies = table(spark, [article(k, "One title", snippet="s" * (k == 1500)) for k in range(3000)])
    assert [r["seq"] for r in dedup.dedup_by_title(copies, 0.9).collect()] == [1500]


@pytest.mark.parametrize(("grades", "expected"), [(("medium", "low", "high"), {2}), (("medium", "high", "low"), {1, 2})])
def test_scan_is_sequential(grades, expected):
    rows = [(k, k, GRADES.index(g), 0) for k, g in enumerate(grades)]
    assert dedup.scan_titles(rows, {0: [1, 2], 1: [0], 2: [0]}) == expected


def test_title_dedup_fixtures(spark):
    same = "OpenAI releases GPT-6 model"
    df = table(spark, [article(0, same, reliability="low"), article(1, same, reliability="high"), article(2, "Anthropic raises funding"), article(3, "!!"), article(4, "??")])
    assert {r["seq"] for r in dedup.dedup_by_title(df, 0.9).collect()} == {1, 2, 3}
    assert dedup.dedup_by_title(df.limit(0)).count() == 0


def test_url_dedup(spark):
    df = table(spark, [article(0, snippet="short", article_id="x", search_query="", content="c0"), article(1, snippet="much longer", article_id="x", search_query="q", content=""), article(2, snippet="much longes", article_id="x", result_count=5), article(3)])
    rows = {r["article_id"]: r for r in dedup.dedup_by_url(df).collect()}
    x = rows["x"]
    assert (x["seq"], x["snippet"], x["result_count"], x["search_query"], x["content"]) == (0, "much longer", 3, "q", "c0")
    assert len(rows) == 2


@pytest.mark.parametrize("t", [0.35, 0.6, 0.9])
def test_similarity_join_misses_nothing(spark, t):
    rng = random.Random(int(t * 100))
    titles = sorted({key(x) for x in random_titles(rng, 80)})
    df = spark.createDataFrame([(k, sorted(grams(k, False))) for k in titles], "id string, grams array<string>")
    found = {(r["a"], r["b"]) for r in similar_sets(df, None, t).collect()}
    assert found == {(a, b) for a in titles for b in titles if a < b and alike(grams(a, False), grams(b, False)) >= t}
    half = df.where(F.length("id") % 2 == 0)
    assert {(r["a"], r["b"]) for r in similar_sets(half, df, t).collect()} == {(a, b) for a in titles for b in titles if len(a) % 2 == 0 and alike(grams(a, False), grams(b, False)) >= t}


def joins_by_rows(df) -> list[str]:
    """The joins of a plan other than those with a table of a proven size."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "BroadcastHashJoin" not in x]


@pytest.mark.parametrize("block", [7, 1000])
def test_sets_that_meet_are_no_rows_of_a_join(spark, monkeypatch, block):
    """Elements of many sets are dealt in pairs of blocks; pairs are told once, and no join makes rows of those that are not alike."""
    monkeypatch.setattr(similarity, "BLOCK", block)
    rng = random.Random(block)
    sets = {f"s{k}": sorted(rng.sample("abcdefghijkl", rng.randint(1, 9))) for k in range(90)}
    df = spark.createDataFrame(list(sets.items()), "id string, grams array<string>")
    found = similar_sets(df, None, 0.6)
    assert not joins_by_rows(found)
    assert sorted((r["a"], r["b"]) for r in found.collect()) == sorted((a, b) for a in sets for b in sets if a < b and alike(set(sets[a]), set(sets[b])) >= 0.6)


def crowded_titles(rng, n):
    """Titles of few different bigrams, as many are."""
    return [" ".join(rng.choice(("ab", "ba", "aab", "bba", "abc", "cab", "c")) for _ in range(rng.randint(2, 6))) for _ in range(n)]


def seen_before(spark, rng):
    """Events, earlier titles and, for each event, the first of the earlier ones that is like it."""
    new, old = crowded_titles(rng, 50), crowded_titles(rng, 50)
    events = spark.createDataFrame(list(enumerate(new)), "seq bigint, canonical_title string")
    before = spark.createDataFrame([("f", k, t, k % 3 + 1) for k, t in enumerate(old)], "file string, pos bigint, canonical_title string, d int").withColumn("report_date", F.date_add(F.lit("2026-08-01").cast("date"), F.col("d"))).drop("d")
    places = sorted(range(50), key=lambda k: (k % 3, k))
    first = {k: next((old[o] for o in places if alike(grams(key(t), False), grams(key(old[o]), False)) >= 0.7), None) for k, t in enumerate(new)}
    return events, before, first


def test_first_hits_by_blocks(spark, monkeypatch):
    """Both sides of a bigram in blocks of five titles: each event has its first hit, and once."""
    monkeypatch.setattr(similarity, "BLOCK", 5)
    events, before, first = seen_before(spark, random.Random(21))
    hits = history.first_hits(events, before).collect()
    assert sorted((r["seq"], r["hit_title"]) for r in hits) == sorted((k, t) for k, t in first.items() if t is not None)


def test_fresh_events_by_blocks(spark, monkeypatch):
    """Fresh are those without a like title in any block."""
    monkeypatch.setattr(similarity, "BLOCK", 5)
    events, before, first = seen_before(spark, random.Random(22))
    fresh, seen = history.split_seen(events, before)
    assert {r["seq"] for r in fresh.collect()} == {k for k, t in first.items() if t is None} and seen.count() == sum(t is not None for t in first.values())


def test_title_pairs_make_no_rows_of_what_only_meets(spark, sf):
    from tidewire import queries

    pairs = queries.title_pairs(spark, sf)
    assert not joins_by_rows(pairs) and "MapInArrow" in pairs._jdf.queryExecution().executedPlan().toString()


def test_title_dedup_by_blocks(spark, monkeypatch):
    """Sequential elimination over pairs that were found in blocks of five titles equals the plain loop."""
    monkeypatch.setattr(similarity, "BLOCK", 5)
    titles = crowded_titles(random.Random(23), 120)
    rows = [(k, t, "x" * (k % 3), GRADES[k % 4]) for k, t in enumerate(titles)]
    df = table(spark, [article(k, t, snippet=x, reliability=g) for k, t, x, g in rows])
    assert {r["seq"] for r in dedup.dedup_by_title(df, 0.85).collect()} == model_title_dedup(rows, 0.85)


def shuffled_rows(spark, run) -> int:
    """Rows that all stages of ``run`` write to shuffles."""
    jvm, store = spark._jvm, spark._jsc.sc().statusStore()

    def total():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (stages.apply(k) for k in range(stages.size()))}

    before = total()
    run()
    return sum(n for k, n in total().items() if k not in before)


def unlike_titles(rng, n, letters="abcd"):
    """Titles of very few different bigrams: nearly all meet, few are alike."""
    return ["".join(rng.choices(letters, k=24)) for _ in range(n)]


#: Rows in shuffles for each title; the pairs of so many titles that meet are more by far.
EACH, MANY = 60, 1200


def test_first_hits_shuffle_no_pairs_that_only_meet(spark):
    titles = unlike_titles(random.Random(31), MANY)
    df = spark.createDataFrame(list(enumerate(titles)), "seq bigint, canonical_title string")
    old = df.where("seq % 2 = 1").select(F.lit("2026-08-01").cast("date").alias("report_date"), F.lit("f").alias("file"), F.col("seq").alias("pos"), "canonical_title")
    first = {k: next((o for o in range(1, MANY, 2) if alike(grams(titles[k], False), grams(titles[o], False)) >= 0.7), None) for k in range(0, MANY, 2)}
    found = []
    assert shuffled_rows(spark, lambda: found.extend(history.first_hits(df.where("seq % 2 = 0"), old).collect())) < EACH * MANY
    assert {r["seq"]: r["hit_title"] for r in found} == {k: titles[o] for k, o in first.items() if o is not None}


def test_fresh_events_shuffle_no_pairs_that_only_meet(spark):
    titles = unlike_titles(random.Random(32), MANY)
    df = spark.createDataFrame(list(enumerate(titles)), "seq bigint, canonical_title string")
    old = df.where("seq % 2 = 1").select(F.lit("2026-08-01").cast("date").alias("report_date"), F.lit("f").alias("file"), F.col("seq").alias("pos"), "canonical_title")
    seen = {k for k in range(0, MANY, 2) if any(alike(grams(titles[k], False), grams(titles[o], False)) >= 0.7 for o in range(1, MANY, 2))}
    found = []
    assert shuffled_rows(spark, lambda: found.extend(history.split_seen(df.where("seq % 2 = 0"), old)[0].collect())) < EACH * MANY
    assert {r["seq"] for r in found} == {*range(0, MANY, 2)} - seen


def test_title_dedup_shuffles_no_pairs_that_only_meet(spark):
    rows = [(k, t, "x" * (k % 3), GRADES[k % 4]) for k, t in enumerate(unlike_titles(random.Random(33), MANY, "abcde"))]
    df = table(spark, [article(k, t, snippet=x, reliability=g) for k, t, x, g in rows])
    found = []
    assert shuffled_rows(spark, lambda: found.extend(dedup.dedup_by_title(df, 0.85).collect())) < EACH * MANY
    assert {r["seq"] for r in found} == model_title_dedup(rows, 0.85)


def test_large_group_is_found_without_pairs(spark, monkeypatch):
    """Where all titles end in one group no pair of titles is a link, and what is left out of it still finds its group."""
    kinds = []
    monkeypatch.setattr(cluster, "durable", lambda df: kinds.append((df.columns, kept := durable(df))) or kept)
    crowd = {f"t{k}": sorted(grams(key(t), False)) for k, t in enumerate(crowded_titles(random.Random(24), 150))}
    apart = {"x1": ["xy", "yz", "zx"], "x2": ["xy", "yz", "zw"], "x3": ["qq"]}
    df = spark.createDataFrame([("day", k, g, False) for k, g in (crowd | apart).items()], "bucket string, id string, grams array<string>, named boolean")
    groups = {r["id"]: r["group"] for r in cluster.closed_groups(df, 0.6).collect()}
    of_crowd = {groups[k] for k in crowd}
    assert len(of_crowd) == 1 and groups["x1"] == groups["x2"] and len({groups["x3"], groups["x1"], *of_crowd}) == 3
    assert all(kept.count() <= 2 for columns, kept in kinds if columns == ["a", "b"])


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(30)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    named = spark.createDataFrame([(f"n{a:03}", f"n{b:03}") for a, b in edges], "a string, b string")
    assert {(r["node"], r["label"]) for r in components(named).collect()} == {(f"n{x:03}", f"n{find(x):03}") for x in linked}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def model_clusters(rows, t):
    clusters, out = [], []
    for g, names in rows:
        best, top = None, 0.0
        for c in clusters if g else []:
            s = alike(g, c[0])
            limit = max(0.35, t - 0.15) if names & c[1] else t
            if s > top and s >= limit:
                best, top = c, s
        if best is None:
            best = [set(), set(), len(clusters)]
            clusters.append(best)
        best[0] |= g
        best[1] |= names
        out.append(best[2])
    return out


@pytest.mark.parametrize("seed", range(20))
def test_leader_scan_matches_the_model(seed):
    rng = random.Random(seed)
    rows = [(grams(t, False), {rng.choice("AB")} if rng.random() < 0.4 else set()) for t in random_titles(rng, 50)]
    assert cluster.scan_leaders([(sorted(g), sorted(n)) for g, n in rows], 0.6) == model_clusters(rows, 0.6)


@pytest.mark.parametrize("seed", range(3))
def test_groups_give_the_single_scan(spark, seed):
    """Clusters of groups scanned apart are those of one scan over all rows."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "OpenAI", "Nvidia", "xyz", "uvw"]
    titles = [" ".join(rng.choice(words) + rng.choice(["", "", str(rng.randint(0, 9))]) for _ in range(rng.randint(0, 5))) for _ in range(120)]
    df = table(spark, [article(k, t) for k, t in enumerate(titles)])
    found, counted = {}, []
    got = {r["seq"]: r["cluster"] for r in cluster.assign_clusters(df, 0.6, guard=counted.append, found=found).collect()}
    names = [[v for k, v in params.COMPANIES if k in t.lower()] for t in titles]
    whole = cluster.scan_leaders([(sorted(grams(t, False)), n) for t, n in zip(titles, names, strict=True)], 0.6)
    first = {}
    assert got == {k: first.setdefault(c, k) for k, c in enumerate(whole)}
    assert counted == [120] and 1 < found["largest_group"] < 120


@pytest.mark.parametrize(
    ("titles", "n"),
    [
        (("OpenAI releases GPT-6 model", "OpenAI releases GPT-6 model today", "Anthropic announces new funding round"), 2),
        (("NVIDIA 发布新一代 AI 芯片", "NVIDIA 推出新一代 AI 芯片产品"), 1),
        (("某公司发布新一代 AI 芯片", "另一家推出新一代 AI 芯片产品"), 2),
        (("!!", "??"), 2),
    ],
)
def test_clusters(spark, titles, n):
    events = cluster.cluster_articles(table(spark, [article(k, t) for k, t in enumerate(titles)]), 0.6, as_of=AS_OF).collect()
    assert len(events) == n and sum(e["article_count"] for e in events) == len(titles)


def test_event_roll_up(spark):
    rows = [article(0, "GPT launch news", source_domain="b.com", reliability="low"), article(1, "GPT launch news!!", source_domain="a.com", reliability="high", snippet="by OpenAI"), article(2, "GPT launch news", source_domain="a.com", reliability="high")]
    (e,) = cluster.cluster_articles(table(spark, rows), as_of=AS_OF).collect()
    assert e["article_ids"] == ["a1", "a2", "a0"] and e["canonical_title"] == "GPT launch news!!"
    assert e["source_domains"] == ["a.com", "b.com"] and e["companies_mentioned"] == ["OpenAI"]
    assert (e["event_type_guess"], e["cluster_score"], e["seq"]) == ("model_release", 1.0, 0)


def events(spark, rows):
    base = dict.fromkeys(EVENT.names)
    return spark.createDataFrame([tuple((base | {"seq": k} | r)[n] for n in EVENT.names) for k, r in enumerate(rows)], EVENT)


def test_history(spark):
    from datetime import date

    h = [(date(2026, 8, d), "f", 0, t) for d, t in ((19, "OpenAI 发布 GPT-6 模型"), (18, "two"), (17, "three days ago"), (20, "今日事件"), (21, "future"))]
    old = history.recent_titles(spark.createDataFrame(h, HISTORY), F.lit("2026-08-20 09:00:00").cast("timestamp"), F.lit("2026-08-20").cast("date"))
    assert sorted(r["canonical_title"] for r in old.collect()) == ["OpenAI 发布 GPT-6 模型", "future", "two"]
    new = events(spark, [{"event_id": "e1", "canonical_title": "OpenAI 发布 GPT-6 模型"}, {"event_id": "e2", "canonical_title": "Anthropic 融资"}, {"event_id": "e3", "canonical_title": "…"}])
    fresh, seen = history.split_seen(new, old)
    assert sorted(r["event_id"] for r in fresh.collect()) == ["e2", "e3"]
    assert [(r["event_id"], r["sim"]) for r in seen.collect()] == [("e1", 1.0)]


@pytest.mark.parametrize(("total", "expected"), [(6, ["m1", "f1", "p1", "r1", "i1", "m2"]), (5, ["m1", "f1", "p1", "r1", "i1"]), (8, None), (1, ["m1"])])
def test_balanced(spark, total, expected):
    names = [("m1", "model_tech", 5), ("m2", "model_tech", 3), ("m3", "model_tech", 2), ("f1", "funding", 4), ("f2", "funding", 1), ("p1", "policy", 2), ("r1", "research", 2), ("i1", "industry", 6)]
    df = events(spark, [{"event_id": i, "article_count": n, "source_domains": ["x"]} for i, _, n in names])
    df = df.join(spark.createDataFrame([(i, c) for i, c, _ in names], "event_id string, category string"), "event_id")
    got = [r["event_id"] for r in select.balanced(df, total).orderBy("rank").collect()]
    assert got == expected if expected else sorted(got) == sorted(i for i, *_ in names)


def test_recency(spark):
    from datetime import datetime, timedelta

    now = datetime(2026, 8, 20)
    df = table(spark, [article(0), article(1, published_at=now - timedelta(hours=48)), article(2, published_at=now - timedelta(hours=49))])
    kept = filters.undated_last(filters.recent(df, AS_OF)).orderBy("seq").collect()
    assert [r["article_id"] for r in kept] == ["a1", "a0"]


def test_search_parsing(spark):
    md = "## Search Results (3 results, 297ms)\n\n### 1. OpenAI releases GPT-6\n- **URL**: https://openai.com/blog/gpt-6\n- OpenAI announced GPT-6 on Aug 19, 2026 with new reasoning capabilities.\n\n### 2. 智谱发布新一代模型\n- **URL**: https://36kr.com/p/12345\n- 智谱于2026年8月18日发布新一代模型，主打推理。\n\n### 3. No date article\n- **URL**: https://example.com/a/b\n- Some content without any date mention.\n"
    df = spark.createDataFrame([(1, md), (2, "## Search Results (0 results, 10ms)\n")], "id int, markdown string")
    rows = search.parse_results(df, AS_OF).orderBy("pos").collect()
    assert [(r["total_found"], r["title"], r["source_domain"], r["published_at"] and r["published_at"].day) for r in rows] == [
        (3, "OpenAI releases GPT-6", "openai.com", 19), (3, "智谱发布新一代模型", "36kr.com", 18), (3, "No date article", "example.com", None),
    ]
    assert "reasoning" in rows[0]["snippet"]


def test_batches_match_by_position(spark):
    md = "\n## Query 1: one\n\n## Search Results (1 results, 1ms)\n\n### 1. T\n- **URL**: https://x.com\n- s\n\n## Query 2: two\nrest"
    lead = md[1:]
    blocks = search.split_batches(spark.createDataFrame([(0, md), (1, lead)], "batch_no bigint, markdown string"))
    got = {(r["batch_no"], r["pos"]): r["query_text"] for r in blocks.collect()}
    assert got == {(0, 0): "one", (0, 1): "two", (1, 0): "## Query 1: one", (1, 1): "two"}
    queries = spark.createDataFrame([(k, f"q{k}") for k in range(3)], "seq bigint, query string")
    rows = search.match_batches(queries, blocks.where("batch_no = 0")).orderBy("seq").collect()
    assert [r["error"] for r in rows] == [None, None, "No result in batch response"]


def test_query_generation(spark):
    config = {"batches": [
        {"batch_id": "m", "strategy": "cartesian", "max_results": 8, "companies": [{"name": "A", "aliases": ["a1", "a2"]}, {"name": "B"}], "event_types": [{"keyword": "x"}, {"keyword": "y", "category": "policy"}]},
        {"batch_id": "l", "queries": [{"query": "q1"}, {"query": "q2", "category": "funding"}]}, {"batch_id": "off", "enabled": False, "queries": [{"query": "no"}]},
    ]}
    from tidewire.sources.strategy import strategy

    s = strategy(spark, config)
    rows = querygen.generate(s.batches, s.companies, s.events, s.queries).orderBy("batch_pos", "pos").collect()
    assert [(r["query"], r["category"], r["max_results"]) for r in rows] == [("a1 x", "m", 8), ("a1 y", "policy", 8), ("B x", "m", 8), ("B y", "policy", 8), ("q1", "l", 10), ("q2", "funding", 10)]
    summary = {r["batch_id"]: r["n_queries"] for r in querygen.batch_summary(querygen.generate(s.batches, s.companies, s.events, s.queries, max_per_batch=1)).collect()}
    assert summary == {"m": 1, "l": 1}
    with pytest.raises(Exception, match="invalid query"):
        querygen.checked(spark.createDataFrame([("q" * 501, 3)], "query string, max_results int")).collect()


def test_pick_balanced(spark):
    df = spark.createDataFrame([(k, c) for k, c in enumerate("aabbbc")], "seq bigint, category string")
    assert [r["seq"] for r in querygen.pick_balanced(df, 4).collect()] == [0, 1, 2, 3]


def analyses(spark, rows):
    base = dict.fromkeys(ANALYSIS.names)
    return spark.createDataFrame([tuple((base | {"seq": k, "event_id": f"e{k}", "title": f"t{k}"} | r)[n] for n in ANALYSIS.names) for k, r in enumerate(rows)], ANALYSIS)


def test_report(spark):
    scores = [95.0, 90.0, 82.0] + [60.0] * 10 + [50.0, 40.0]
    cats = ["policy", "funding", None] + ["research"] * 10 + ["sports", "policy"]
    a = analyses(spark, [{"importance_score": s, "category": c, "summary": "sum", "analysis": "an"} for s, c in zip(scores, cats, strict=True)])
    top = report.top_news(a)
    assert [r["seq"] for r in top.orderBy("rank").collect()] == [0, 1, 2]
    items = report.section_items(a, top)
    lists = report.report_items(items, spark.createDataFrame([], "seq bigint, sources array<struct<name:string,url:string,is_official:boolean>>"))
    row = report.daily_report(lists, F.lit("2026-08-20"), AS_OF, F.lit("s" * 400)).first()
    assert row["report_id"] == "daily_20260820" and len(row["editor_summary"]) == 300
    assert [s["item_count"] for s in row["sections"]] == [3, 0, 0, 1, 8, 0] and row["total_items"] == 12
    assert row["total_word_count"] == sum(len(f"t{k}") + 5 for k in [0, 1, 2, 14, *range(3, 11)])
    assert row["sections"][4]["items"][0]["item_id"] == "item_001"
    assert sorted(r["seq"] for r in report.left_out(a, items).collect()) == [11, 12, 13]


def test_top_news_falls_back(spark):
    a = analyses(spark, [{"importance_score": s} for s in (85.0, 81.0, 75.0, 70.0, 69.0)])
    assert report.top_news(a).count() == 4
    many = analyses(spark, [{"importance_score": 90.0} for _ in range(9)])
    assert report.top_news(many).count() == 7


def test_sources(spark):
    arts = table(spark, [article(k, source_domain=d, article_id=f"a{k}", source_name=n) for k, (d, n) in enumerate([("x.com", "X"), ("x.com", None), ("y.gov", None)])])
    ev = events(spark, [{"event_id": "e", "article_ids": ["a0", "gone", "a1", "a2"], "source_domains": ["x.com", "z.com"]}])
    (row,) = report.sources(ev, arts, spark.createDataFrame([(0, ["N"])], "seq bigint, source_names array<string>")).collect()
    assert [(s["name"], s["url"], s["is_official"]) for s in row["sources"]] == [("N", "https://e.com/0", False), ("y.gov", "https://e.com/2", True), ("z.com", "https://z.com", False)]


def test_grounded_analyses_and_checks(spark):
    a = analyses(spark, [{"importance_score": 90.0, "details": "d", "key_data": [("n", "7"), ("m", "8")]}])
    texts = spark.createDataFrame([(0, "seven 7")], "seq bigint, source_text string")
    g = report.ground_analyses(a, texts)
    assert g.first()["flag"] == "key_data 无来源剔除 [t0]: ['m=8']"
    checks = spark.createDataFrame([(0, "better", ["c"])], "seq bigint, corrected_details string, unsupported_claims array<string>")
    row = report.apply_checks(g, checks).first()
    assert row["details"] == "better" and row["check_flags"] == ["复核修订 details [t0]", "无依据表述 [t0]: c"]


def test_backfill(spark):
    from datetime import datetime

    arts = table(spark, [article(k, f"title {k} {'x' * k}", category="funding") for k in range(6)])
    lacking = {r["category"]: r["n"] for r in backfill.deficits(arts).collect()}
    assert lacking == {c: 0 for c in params.BACKFILL_QUERIES if c != "funding"}

    def fetch(queries):
        rows = queries.where("category = 'policy'").limit(1)
        return rows.select("seq", F.col("query").alias("query_origin"), F.lit("Fresh policy news").alias("title"), F.lit("https://p.com/1").alias("url"), F.lit("p.com").alias("source_domain"), F.lit("s").alias("snippet"), F.lit(datetime(2026, 8, 19)).alias("published_at"))

    out = backfill.backfill(arts, fetch, AS_OF).orderBy("seq").collect()
    assert out[-1]["category"] == "policy" and out[-1]["search_batch"] == "backfill_policy" and out[-1]["seq"] > 5


def test_distinct_sets(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    assert distinct_sets(df, F.col("k"), F.array("k")).count() == 2


def test_extras(spark):
    from tidewire.operators import extras

    items = spark.createDataFrame([(k, "policy" if k % 2 else "funding", float(k), ["A"] if k < 5 else ["A", "B"] if k < 7 else []) for k in range(20)], "seq bigint, section_id string, importance_score double, companies_mentioned array<string>")
    got = extras.limited_sections(items)
    assert sorted(r["seq"] for r in got.collect()) == [8, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19]
    assert sorted(r["seq"] for r in extras.limited_companies(items).collect()) == [4, 5, 6, *range(7, 20)]
    assert {r["section_id"]: r["n"] for r in extras.shortfalls(got).collect()} == {"top_news": 0, "model_tech": 0, "research": 0, "industry": 0}
