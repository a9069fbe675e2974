"""Suppression of events that earlier days already covered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params
from ..functions.text import bigrams, jaccard, title_key
from .graph import durable
from .similarity import WORDS, distinct_sets, signature, similar_sets


def recent_titles(history: DataFrame, as_of: Column, exclude: Column, days: int = params.HISTORY_DAYS) -> DataFrame:
    """Titles of days whose midnight is within ``days`` times 24 hours of as_of (later days included), but not ``exclude``."""
    cutoff = as_of - F.make_dt_interval(F.lit(days))
    midnight = F.col("report_date").cast("timestamp")
    return history.where((midnight >= cutoff) & (F.col("report_date") != exclude) & (F.coalesce("canonical_title", F.lit("")) != ""))


def first_hits(events: DataFrame, history: DataFrame, threshold: float = params.HISTORY_THRESHOLD) -> DataFrame:
    """(seq, hit_date, hit_title, sim) of events whose title is like an earlier one: the first in order of date, file and place."""
    key = title_key(F.col("canonical_title"))
    new = events.select("seq", key.alias("key"))
    old = history.select(key.alias("key"), F.struct("report_date", "file", "pos", "canonical_title").alias("place")).groupBy("key").agg(F.min("place").alias("place"))
    a = durable(distinct_sets(new, F.col("key"), bigrams(F.col("key"), False)))
    b = durable(distinct_sets(old, F.col("key"), bigrams(F.col("key"), False)))
    met = similar_sets(a, b, threshold).join(old.withColumnRenamed("key", "b"), "b")
    best = met.groupBy("a").agg(F.min(F.struct("place", "sim")).alias("hit"))
    return new.join(best, F.col("key") == F.col("a")).select(
        "seq", F.col("hit.place.report_date").alias("hit_date"), F.col("hit.place.canonical_title").alias("hit_title"), F.col("hit.sim").alias("sim")
    )


#: Buckets of the kept index, and bigrams whose order it keeps.
BUCKETS, ORDERED = 16, 65_536
INDEX = "gram string, key string, n int, at int, grams array<string>, w0 bigint, w1 bigint, w2 bigint, w3 bigint, canonical_title string, file string, pos bigint, report_date date"


def _prefix(rows: DataFrame, threshold: float, order: DataFrame) -> DataFrame:
    """A row for each of the first n - ceil(t n) + 1 bigrams of rows with ``grams``, rare ones first, at its place, with the signature of all.

    Any order that both sides share will do for the join. It is the one that was kept when the index began, by the counts of its first
    titles, so what was indexed stays right; bigrams that it does not know come first, by hash.
    """
    own = [c for c in rows.columns if c != "grams"]
    each = rows.where(F.size("grams") > 0).select(*own, F.explode("grams").alias("gram")).join(F.broadcast(order), "gram", "left")
    place = F.struct(F.coalesce("f", F.lit(0)).alias("f"), F.xxhash64("gram").alias("h"), "gram")
    ranked = each.groupBy(*own).agg(F.transform(F.sort_array(F.collect_list(place)), lambda o: o["gram"]).alias("grams"))
    n = F.size("grams")
    keep = n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1
    return ranked.select("*", n.alias("n"), *signature(F.col("grams"))).select("*", F.posexplode(F.slice("grams", F.lit(1), keep)).alias("at", "gram"))


def open_index(spark: SparkSession, table: str, location: str | None = None, buckets: int = BUCKETS) -> None:
    """Make the index ``table`` known to the session, new or from its files: partitioned by day, bucketed by bigram.

    ``table``_order, beside it, has the order of its bigrams and belongs to it.
    """
    for name, columns, how in ((table, INDEX, f"PARTITIONED BY (report_date) CLUSTERED BY (gram) INTO {buckets} BUCKETS"), (f"{table}_order", "gram string, f bigint", "")):
        place = name.replace(table, location, 1) if location else None
        if place:
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
        where = f" LOCATION '{place}'" if place else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet {how}{where}")
    spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")


def index_titles(titles: DataFrame, table: str, threshold: float = params.HISTORY_THRESHOLD, buckets: int = BUCKETS) -> None:
    """Append (report_date, file, pos, canonical_title) rows to the index; of equal titles of a day the first place stays."""
    spark = titles.sparkSession
    key = title_key(F.col("canonical_title"))
    place = F.struct("file", "pos", "canonical_title")
    day = titles.where(F.coalesce("canonical_title", F.lit("")) != "").groupBy("report_date", key.alias("key")).agg(F.min(place).alias("place"))
    day = day.withColumn("grams", bigrams(F.col("key"), False))
    if spark.table(table).isEmpty() and spark.table(f"{table}_order").isEmpty():
        counts = day.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("f"))
        counts.orderBy(F.desc("f"), "gram").limit(ORDERED).write.mode("append").format("parquet").saveAsTable(f"{table}_order")
    rows = _prefix(day, threshold, spark.table(f"{table}_order"))
    names = [c.split()[0] for c in INDEX.split(", ")]
    named = rows.select("*", "place.canonical_title", "place.file", F.col("place.pos").cast("bigint").alias("pos")).select(*names)
    # dealt as the table is, so that a day has one file a bucket
    named.repartition(buckets, "gram").sortWithinPartitions("gram").write.mode("append").format("parquet").partitionBy("report_date").bucketBy(buckets, "gram").saveAsTable(table)


def indexed_hits(events: DataFrame, table: str, as_of: Column, exclude: Column, threshold: float = params.HISTORY_THRESHOLD, days: int = params.HISTORY_DAYS) -> DataFrame:
    """As ``first_hits``, from the index: only the new events are dealt, and days outside of the window are not read.

    Titles that meet at a bigram are held against bounds of their similarity before their bigrams are compared.
    """
    spark = events.sparkSession
    key = title_key(F.col("canonical_title"))
    new = durable(events.select("seq", key.alias("own"), bigrams(key, False).alias("own_grams")))
    titles = new.groupBy("own").agg(F.first("own_grams").alias("grams")).withColumnRenamed("own", "key")
    asked = _prefix(titles, threshold, durable(spark.table(f"{table}_order")))
    asked = asked.select("gram", *[F.col(c).alias(f"own_{c}") for c in ("key", "grams", "n", "at", "w0", "w1", "w2", "w3")])
    old = recent_titles(spark.table(table), as_of, exclude, days)
    t, total = F.lit(threshold), F.col("own_n") + F.col("n")
    fits = (F.col("own_n") >= F.col("n") * t - 1e-9) & (F.col("n") >= F.col("own_n") * t - 1e-9)
    # at their first common bigram so many are still to come; sets of that similarity differ in no more bits
    fits &= F.least(F.col("own_n") - F.col("own_at"), F.col("n") - F.col("at")) >= total * (t / (1 + t)) - 1e-6
    fits &= sum(F.bit_count(F.col(f"own_w{w}").bitwiseXOR(F.col(f"w{w}"))) for w in range(WORDS)) <= total * ((1 - t) / (1 + t)) + 1e-6
    met = asked.join(old, "gram").where(fits).withColumn("sim", jaccard(F.col("own_grams"), F.col("grams"))).where(F.col("sim") >= t)
    # a title has one place a day, and later places lose; of one similarity each place has, any bigram that found it will do
    best = met.groupBy(F.col("own_key").alias("hit_key")).agg(F.min(F.struct("report_date", "file", "pos", "canonical_title", "sim")).alias("hit"))
    return new.join(best, F.col("own") == F.col("hit_key")).select("seq", F.col("hit.report_date").alias("hit_date"), F.col("hit.canonical_title").alias("hit_title"), F.col("hit.sim").alias("sim"))


def split_seen(events: DataFrame, history: DataFrame, threshold: float = params.HISTORY_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Fresh events, and seen ones with their first hit."""
    hits = first_hits(events, history, threshold)
    fresh = events.join(hits.select("seq"), "seq", "left_anti")
    return fresh, events.join(hits, "seq")
