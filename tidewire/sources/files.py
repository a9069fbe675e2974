"""Article files, history, and what a run writes."""

from __future__ import annotations

import html
import json
import uuid
from pathlib import Path
from string import Template

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import durable
from ..types import ARTICLE, EXPORTED


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of articles as rows in order; seq is the place in the array if the file has none."""
    raw = spark.read.schema(ARTICLE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return raw.withColumn("seq", F.coalesce("seq", F.monotonically_increasing_id()))


#: What an article cannot do without.
REQUIRED = ("title", "url")


def scan_articles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(articles, rejected): the elements of JSON arrays that fit the schema, and (file, pos, reason, record) of the others.

    An element is judged by itself, so a bad one does not end the run: it may be no object, hold a value of another type, or
    lack a title or URL. A file that is no JSON array is one rejected record. The table is written once and both are read from it.
    """
    whole = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    parts = whole.select("file", "value", F.from_json("value", "array<string>").alias("parts"))
    rows = parts.select("file", "value", F.posexplode_outer("parts").alias("pos", "record"))
    bad = "_bad"
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ARTICLE) + f", {bad} string"
    read = rows.withColumn("a", F.from_json("record", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}))
    missing = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(F.col(f"a.{c}"), F.lit(""))) == "", F.lit(c)) for c in REQUIRED]))
    reason = (
        F.when(F.col("pos").isNull() & F.from_json("value", "array<string>").isNull(), "no JSON array").when(F.col("pos").isNull(), "empty array")
        .when(F.col("record").isNull() | ~F.startswith(F.ltrim("record"), F.lit("{")), "no object").when(F.col(f"a.{bad}").isNotNull(), "value of another type")
        .when(F.size(missing) > 0, F.concat(F.lit("without "), F.array_join(missing, ", ")))
    )
    judged = durable(read.withColumn("reason", reason).where(F.coalesce("reason", F.lit("")) != "empty array").select("file", "pos", "reason", F.coalesce("record", "value").alias("record"), "a", F.monotonically_increasing_id().alias("number")))
    good = judged.where("reason IS NULL").select("number", "a.*").drop(bad).withColumn("seq", F.coalesce("seq", "number")).drop("number")
    return good, judged.where("reason IS NOT NULL").select("file", "pos", "reason", "record")


def quarantine(rejected: DataFrame, root: str, day: str) -> dict[str, int]:
    """Append rejected records under root/report_date=…; returns how many there are for each reason."""
    written = Observation()
    reasons = ("no JSON array", "no object", "value of another type")
    counts = [F.count_if(F.col("reason") == r).alias(r.replace(" ", "_")) for r in reasons]
    marked = rejected.observe(written, F.count(F.lit(1)).alias("records"), F.count_if(F.startswith("reason", F.lit("without "))).alias("incomplete"), *counts)
    marked.withColumn("report_date", F.lit(day).cast("date")).write.partitionBy("report_date").mode("append").parquet(root)
    return written.get


def write_articles(articles: DataFrame, root: str) -> None:
    """Under root/report_date=…, in order of seq within files; days written again are replaced."""
    day = articles if "report_date" in articles.columns else articles.withColumn("report_date", F.to_date("fetched_at"))
    _by_day(day.sortWithinPartitions("seq")).mode("overwrite").json(root)


def _by_day(df: DataFrame):
    return df.write.partitionBy("report_date").option("partitionOverwriteMode", "dynamic")


def write_events(events: DataFrame, root: str, report_date: str) -> None:
    """Append a day's fresh events; they are the next days' history."""
    events.withColumn("report_date", F.lit(report_date).cast("date")).write.partitionBy("report_date").mode("append").parquet(root)


def read_history(spark: SparkSession, root: str, schema: str = "canonical_title string") -> DataFrame:
    """(report_date, file, pos, canonical_title) of dated folders of event files; unreadable files are skipped.

    Folders are named report_date=YYYY-MM-DD (Parquet tables) or YYYY-MM-DD (JSON arrays).
    """
    table = root.rstrip("/") + "/*"
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", True).json(table)
    path = F.col("_metadata.file_path")
    day = F.to_date(F.nullif(F.regexp_extract(path, r"/(?:report_date=)?(\d{4}-\d{2}-\d{2})/[^/]*$", 1), F.lit("")))
    rows = raw.select(day.alias("report_date"), path.alias("file"), F.monotonically_increasing_id().alias("pos"), "canonical_title")
    return rows.where("report_date IS NOT NULL AND coalesce(canonical_title, '') <> ''")


def read_event_table(spark: SparkSession, root: str) -> DataFrame:
    """History from the table that ``write_events`` appends to."""
    raw = spark.read.parquet(root)
    return raw.select(F.to_date("report_date").alias("report_date"), F.col("_metadata.file_path").alias("file"), F.col("seq").alias("pos"), "canonical_title")


def write_report(report: DataFrame, path: str) -> None:
    """The report as JSON in the folder ``path``, published at once: an older one stays whole until the new one is.

    It is written beside, read again and counted; then the older one is moved away, the new one takes its place, and the older
    one goes. If the last move fails the older one moves back.
    """
    spark = report.sparkSession
    mark = uuid.uuid4().hex
    new, old = f"{path.rstrip('/')}.new-{mark}", f"{path.rstrip('/')}.old-{mark}"
    place = spark._jvm.org.apache.hadoop.fs.Path
    system = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    written = Observation()
    try:
        report.observe(written, F.count(F.lit(1)).alias("n")).coalesce(1).write.json(new)
        n = written.get["n"]
        if not n or spark.read.schema(report.schema).json(new).count() != n:
            raise RuntimeError(f"the report was not written whole: {path}")
        before = system.exists(place(path))
        if before and not system.rename(place(path), place(old)):
            raise RuntimeError(f"the older report cannot be moved: {path}")
        if not system.rename(place(new), place(path)):
            if before:
                system.rename(place(old), place(path))
            raise RuntimeError(f"the report cannot be moved into place: {path}")
        if before:
            system.delete(place(old), True)
    finally:
        if system.exists(place(new)):
            system.delete(place(new), True)


_PAGE = Template("""<!DOCTYPE html>
<html lang="zh-CN"><head><meta charset="UTF-8"><title>$title · $date</title><style>$style</style></head>
<body data-watermark="$mark"><header><h1>$title</h1><p>$date_cn</p>$summary</header>
<nav><ul>$contents</ul></nav>
$sections
</body></html>
""")
_ORDINALS = "一二三四五六"


def render_html(report: DataFrame, title: str = "AI 日报", mark: str = "", style: str = "") -> str:
    """One report row as a page: contents, then sections with their items and sources; all texts are escaped.

    Sections keep their ordinal when empty ones before them are left out.
    """
    row = json.loads(report.select(F.to_json(F.struct("*")).alias("j")).first()["j"])
    e = lambda x: html.escape(str(x if x is not None else ""))
    contents, parts = [], []
    for k, s in enumerate(row["sections"]):
        if not s["item_count"]:
            continue
        n = _ORDINALS[k] if k < len(_ORDINALS) else str(k + 1)
        contents.append(f'<li><a href="#section-{e(s["section_id"])}">{n} {e(s["section_name"])} {s["item_count"]} 条</a></li>')
        items = []
        for i in s["items"]:
            links = "".join(f"<li>[{j}] {e(x['name'])} {e(x['url'])}</li>" for j, x in enumerate(i["sources"], 1))
            extra = f"<p>{e(i['analysis'])}</p>" if i.get("analysis") else ""
            listed = f"<ul>{links}</ul>" if links else ""
            items.append(f'<article id="item-{e(i["item_id"])}"><h3>{i["rank"]}. {e(i["title"])}</h3><p>{e(i["details"])}</p>{extra}{listed}</article>')
        parts.append(f'<section id="section-{e(s["section_id"])}"><h2>{n} {e(s["section_name"])}</h2>{"".join(items)}</section>')
    y, m, d = map(int, row["report_date"].split("-"))
    summary = f"<p>{e(row['editor_summary'])}</p>" if row.get("editor_summary") else ""
    return _PAGE.substitute(
        title=e(title), date=e(row["report_date"]), style=style, mark=e(f"{mark} {row['report_date'].replace('-', '.')}".strip()), date_cn=f"{y}年{m}月{d}日",
        summary=summary, contents="".join(contents), sections="".join(parts),
    )


def save_html(page: str, folder: str, report_date: str) -> str:
    path = Path(folder) / f"report_{report_date}.html"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(page, encoding="utf-8")
    return str(path)


def versioned_path(folder: str, report_date: str, suffix: str = ".pdf") -> str:
    """A name that is not taken: report_DATE, then report_DATE_v2 and on."""
    path, n = Path(folder) / f"report_{report_date}{suffix}", 1
    while path.exists():
        n += 1
        path = Path(folder) / f"report_{report_date}_v{n}{suffix}"
    return str(path)


def render_pdf(page: str, folder: str, report_date: str, browser=None) -> str:
    """Print a page with ``browser(page, path, margins in mm)``; no browser comes with this engine."""
    if browser is None:
        raise RuntimeError("printing needs a browser function")
    path = versioned_path(folder, report_date)
    browser(page, path, {"top": 20, "bottom": 22, "left": 18, "right": 18})
    return path


def export_schemas() -> dict[str, dict]:
    return {k: v.jsonValue() for k, v in EXPORTED.items()}


def load_prompt(path: str) -> str:
    """A prompt's text; a missing file is empty."""
    p = Path(path)
    return p.read_text(encoding="utf-8") if p.exists() else ""
