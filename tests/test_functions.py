"""Golden vectors of column functions, at a fixed clock."""

import pytest
from pyspark.sql import functions as F

from tidewire.functions import dates, jsontext, text, urls

AS_OF = F.lit("2026-08-20 00:00:00").cast("timestamp")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://E.com/path/?utm_source=x&id=1#frag", "https://e.com/path?id=1"),
        ("HTTPS://Www.E.com", "https://www.e.com/"),
        ("https://e.com/a//?&&b=2&UTM_x=1&ref=3", "https://e.com/a?b=2"),
        ("https://e.com/a/;p=1?x", "https://e.com/a;p=1?x"),
        ("https://e.com/a?ref_src=1", "https://e.com/a"),
    ],
)
def test_normalize_url(spark, url, expected):
    assert one(spark, urls.normalize_url(F.lit(url))) == expected


def test_canonical_url(spark):
    assert one(spark, urls.canonical_url(F.lit("HTTP://Me@Ex.com:80?q=A"))) == "http://Me@ex.com/?q=A"
    assert one(spark, urls.canonical_url(F.lit("https://ex.com:8443/A"))) == "https://ex.com:8443/A"


@pytest.mark.parametrize(("domain", "grade"), [("openai.com", "high"), ("www.sec.gov", "high"), ("reuters.com", "medium"), ("36kr.com", "low"), ("random-blog.io", "unknown"), ("blog.openai.com", "unknown")])
def test_reliability(spark, domain, grade):
    assert one(spark, urls.reliability(F.lit(domain))) == grade


def test_domain_keeps_port_and_drops_every_www(spark):
    assert one(spark, urls.source_domain(F.lit("https://www.awww.e.com:8/x"))) == "ae.com:8"


@pytest.mark.parametrize(("value", "expected"), [("中文内容测试", "zh"), ("english text here", "en"), ("", "unknown")])
def test_language(spark, value, expected):
    assert one(spark, text.language(F.lit(value))) == expected


@pytest.mark.parametrize(
    ("url", "body", "expected"),
    [
        ("https://axios.com/2026-08-17/x", "no date", "2026-08-17"),
        ("https://x.com/20260817/", "", "2026-08-17"),
        ("https://x.com", "back in 2023-01-01", None),
        ("https://x.com", "2026年3月的一些旧闻汇总", "2026-03-01"),
        ("https://x.com", "2026年8月最新", None),
        ("https://x.com", "on Aug 19, 2026 and 2026-08-01", "2026-08-19"),
        ("https://x.com", "智谱于2026年8月18日发布", "2026-08-18"),
        ("https://x.com", "in March 2026 and August 2026", "2026-03-01"),
        ("https://x.com", "2026-02-30", None),
    ],
)
def test_published_date(spark, url, body, expected):
    assert one(spark, F.date_format(dates.published_date(F.lit(url), F.lit(body), AS_OF), "yyyy-MM-dd")) == expected


@pytest.mark.parametrize(("value", "expected"), [("2026-08-19T08:00:00", "2026-08-19 08"), ("2026-08-19T08:00:00+02:00", "2026-08-19 06"), ("Aug 19, 2026", "2026-08-19 00"), (None, None), ("not a date", None)])
def test_flexible_date(spark, value, expected):
    assert one(spark, F.date_format(dates.flexible_date(F.lit(value).cast("string")), "yyyy-MM-dd HH")) == expected


def test_report_clock(spark):
    now = F.lit("2026-08-19 20:00:00").cast("timestamp")
    assert str(one(spark, dates.report_date(now))) == "2026-08-20"
    assert str(one(spark, dates.report_date(now, "America/New_York"))) == "2026-08-19"
    assert str(one(spark, dates.report_day_start(dates.report_date(now)))) == "2026-08-19 16:00:00"
    assert one(spark, text.chinese_date(F.lit("2026-08-05").cast("date"))) == "2026年8月5日"


def test_time_qualifier(spark):
    q = lambda s, c: one(spark, text.time_qualified(F.lit(s), F.lit(c).cast("string"), AS_OF))
    assert q("EU AI Act implementation", "policy") == "EU AI Act implementation 2026 update"
    assert q("EU AI Act implementation update", "policy") == "EU AI Act implementation update 2026"
    assert q("OpenAI", "funding") == "OpenAI August 2026 latest"
    assert q("chips", "industry") == "chips latest news 2026-08-20"
    assert q("renewal", None) == "renewal"
    assert q("融资", "funding") == "融资 2026年08月 最新"
    assert q("论文", "research") == "论文 最新"


def test_titles(spark):
    assert one(spark, text.title_key(F.lit("Ünï-code_ ①中!"))) == "ünïcode_①中" or one(spark, text.title_key(F.lit("a_b c!"))) == "a_bc"
    grams = lambda s, blank: one(spark, text.bigrams(F.lit(s), blank))
    assert (grams("", True), grams("", False), grams("a", True), grams("abab", True)) == ([""], [], ["a"], ["ab", "ba"])


def test_similarity_of_fixture_titles(spark):
    def sim(a, b):
        x, y = (text.bigrams(text.title_key(F.lit(t)), False) for t in (a, b))
        return round(one(spark, text.jaccard(x, y)), 4)

    assert sim("OpenAI releases GPT-6 model", "OpenAI releases GPT-6 model today") == 0.84
    assert sim("NVIDIA 发布新一代 AI 芯片", "NVIDIA 推出新一代 AI 芯片产品") == 0.5789
    assert sim("某公司发布新一代 AI 芯片", "另一家推出新一代 AI 芯片产品") == 0.3333


def test_mentions(spark):
    assert one(spark, text.companies(F.lit("Intelligence from OpenAI and Meta"))) == ["OpenAI", "Meta", "Intel"]
    assert one(spark, text.event_type(F.lit("A lawsuit"), F.lit(""))) == "regulation_update"
    assert one(spark, text.event_type(F.lit("x"), F.lit("y"))) is None


def test_clean_snippet(spark):
    clean = lambda s, t: one(spark, text.clean_snippet(F.lit(s), F.lit(t)))
    assert clean("Title – the rest", "Title") == "the rest"
    assert clean("a 🚨 buy REGISTER NOW. b flash sale x register now c", "T") == "a  b  c"
    assert clean("a work published by state-of-the-art labs", "T") == "of-the-art labs"


def test_json(spark):
    loose = lambda s: one(spark, jsontext.extract_json(F.lit(s)))
    strict = lambda s: one(spark, jsontext.extract_json_strict(F.lit(s)))
    assert loose('x ```JSON {"a": [1,],} ``` y') == '{"a": [1]}'
    assert loose('say {"a": 1} end') == '{"a": 1}'
    assert loose("nothing") is None
    assert strict('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert strict('```json\n{"a": 1,}\n``` {"b": 2}') is None


def test_grounding(spark):
    kd = F.array(F.struct(F.lit("融资额").alias("label"), F.lit("200亿美元").alias("value")), F.struct(F.lit("员工数").alias("label"), F.lit("35000人").alias("value")), F.struct(F.lit("x").alias("label"), F.lit("").alias("value")))
    body = F.lit("本轮融资 200亿美元，由某基金领投。")
    assert [r["label"] for r in one(spark, jsontext.grounded(kd, body))] == ["融资额"]
    assert one(spark, jsontext.ungrounded(kd, body)) == ["员工数=35000人", "x="]


def test_ids(spark):
    assert one(spark, urls.item_id(F.lit(7))) == "item_007"
    assert one(spark, urls.item_id(F.lit(1234))) == "item_1234"
    assert one(spark, urls.event_id(F.lit("A" * 60))) == one(spark, urls.event_id(F.lit("a" * 50)))


def test_scoring(spark):
    from tidewire.functions import scoring

    parts = {k: F.lit(90) for k, _ in scoring.WEIGHTS}
    assert one(spark, scoring.importance(parts)) == pytest.approx(90)
    assert one(spark, scoring.importance({"global_impact": F.lit(100)})) == pytest.approx(30)
    assert [one(spark, scoring.grade(F.lit(s))) for s in (95, 94.9, 85, 80, 10)] == ["S", "A+", "A", "B+", "C"]


def test_json_objects_agree_with_the_model_reader(spark):
    """The column function and the model reader find the same object, or none."""
    import json

    from tidewire.sources.models import json_object

    answers = [
        '{"a": 1}', 'Sure: {"a": "}{ \\" {"} and then {b}', '{"a": {"b": [1, 2,],},} tail }', '```JSON\n{"a": 2}\n``` and {"c": 3}', "no object", "{broken", '{"a": 1} {"b": 2}', "", "} {", '```json\nnothing\n``` {"a": 1}',
        '{"a": "\\\\"} {', '{"é😀": "x"} }',
    ]
    df = spark.createDataFrame([(k, a) for k, a in enumerate(answers)], "k int, t string")
    got = {r["k"]: r["j"] for r in df.select("k", jsontext.extract_json(F.col("t")).alias("j")).collect()}
    for k, a in enumerate(answers):
        try:
            want = json_object(a)
        except ValueError:
            want = None
        assert (None if got[k] is None else json.loads(__import__("re").sub(r",(\s*[}\]])", r"\1", got[k]))) == want, a



def test_shared_folder(spark):
    from tidewire.operators import graph

    class Session:
        conf = {"spark.sql.warehouse.dir": "hdfs://w"}
        sparkContext = type("C", (), {"master": "yarn", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        graph.shared_folder(Session)
    Session.conf["spark.checkpoint.dir"] = "hdfs://c"
    assert graph.shared_folder(Session) == "hdfs://c"
