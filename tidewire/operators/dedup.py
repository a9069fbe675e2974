"""Exact dedup by URL and sequential dedup by title."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions.text import bigrams, title_key
from ..functions.urls import reliability_weight
from .graph import components, durable
from .similarity import distinct_sets, similar_sets


def dedup_by_url(articles: DataFrame) -> DataFrame:
    """One row for each article_id: the first by seq, with the longest snippet of its copies.

    The content comes with that snippet unless it is empty, then from the longest snippet before it that has
    one. result_count grows by one for each copy; search_query is the first that is not empty. Aggregates
    merge partially before the shuffle, so a heavily repeated article does not load one task.
    """
    rest = [c for c in articles.columns if c not in ("article_id", "snippet", "content", "result_count", "search_query")]
    length = F.length(F.coalesce("snippet", F.lit("")))
    rank = F.struct(length, -F.col("seq"))
    has_content = F.coalesce("content", F.lit("")) != ""
    best = articles.groupBy("article_id").agg(
        F.min_by(F.struct(*rest), "seq").alias("first"),
        F.min_by("result_count", "seq").alias("n0"),
        F.count("*").alias("n"),
        F.max_by("snippet", rank).alias("snippet"),
        F.max_by("content", rank).alias("content0"),
        F.max_by("content", F.when(has_content, rank)).alias("content1"),
        F.min_by("search_query", F.when(F.coalesce("search_query", F.lit("")) != "", F.col("seq"))).alias("search_query"),
        F.min_by("search_query", "seq").alias("query0"),
    )
    kind = articles.schema["result_count"].dataType
    fields = {c: F.col(f"first.{c}") for c in rest} | {
        "article_id": F.col("article_id"),
        "snippet": F.col("snippet"),
        "content": F.coalesce(F.when(F.coalesce("content0", F.lit("")) != "", F.col("content0")), "content1", "content0"),
        "result_count": (F.col("n0") + F.col("n") - 1).cast(kind),
        "search_query": F.coalesce("search_query", "query0"),
    }
    return best.select(*[fields[c].alias(c) for c in articles.columns])


Row = tuple[int, int, int, int]


class Survivors:
    """Rows (seq, class, weight, length) that arrive in order of seq, and those that survive so far: one of a class at most.

    Each living row meets the later living rows of its own and its linked classes in order: the heavier survives; of
    equals the longer, of those the earlier. A row that dies meets nobody any more. So an arriving row meets the survivors
    in order of seq, until one of them kills it.
    """

    def __init__(self, neighbours: dict, alive: dict | None = None):
        self.neighbours, self.alive = neighbours, alive or {}

    def meet(self, row: Row) -> list[int]:
        """The seqs that die when ``row`` arrives, its own included."""
        seq, own, *rank = row
        dead = []
        rivals = [(self.alive[c], c) for c in (own, *self.neighbours.get(own, ())) if c in self.alive]
        for (other, *held), c in sorted(rivals):
            if held >= rank:
                return [*dead, seq]
            del self.alive[c]
            dead.append(other)
        self.alive[own] = (seq, *rank)
        return dead


def scan_titles(rows: list[Row], neighbours: dict[int, list[int]]) -> set[int]:
    """Survivors among rows sorted by seq."""
    scan = Survivors(neighbours)
    for r in rows:
        scan.meet(r)
    return {seq for seq, *_ in scan.alive.values()}


#: Rows of a component that one task decides, about.
PIECE = 50_000


def _decide(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The rows that die when a piece (left) arrives; right has the links (key, other) of its titles and earlier survivors (key, seq, weight, length)."""
    linked, held = right[right["other"].notna()], right[right["other"].isna()]
    neighbours: dict[str, list[str]] = {}
    for a, b in zip(linked["key"], linked["other"], strict=True):
        neighbours.setdefault(a, []).append(b)
    alive = {k: (int(q), int(w), int(n)) for k, q, w, n in zip(held["key"], held["seq"], held["weight"], held["length"], strict=True)}
    scan, dead = Survivors(neighbours, alive), []
    left = left.sort_values("own_seq")
    for row in zip(*(left[f"own_{c}"].tolist() for c in ("seq", "key", "weight", "length")), strict=True):
        dead += scan.meet(row)
    return pd.DataFrame({"dead": dead}, dtype="int64")


def dedup_by_title(articles: DataFrame, threshold: float = params.TITLE_THRESHOLD, piece: int = PIECE) -> DataFrame:
    """Sequential elimination of similar titles in the order of seq.

    Removals only travel along similar pairs, so connected components of the graph of distinct titles are independent. Where
    all titles of a component are alike (copies of one title always are), the first of the greatest rank survives: an
    aggregate, however many rows there are. The others are cut into pieces of some ``piece`` rows by quantiles of seq, and
    decided in rounds: a round takes the next piece of every component, with the survivors so far of the titles that it or
    its neighbours have, which are one row a title at most. So no task holds a component, and most data take one round. Only ids
    and ranks reach Python. Titles without letters or digits are alike. Losers leave no trace in the winner's counts.
    """
    key = title_key(F.col("title"))
    rows = durable(
        articles.select("seq", key.alias("key"), reliability_weight(F.col("source_reliability")).alias("weight"), F.length(F.coalesce("snippet", F.lit(""))).alias("length"))
    )
    titles = durable(distinct_sets(rows, F.col("key"), bigrams(F.col("key"), True)))
    pairs = durable(similar_sets(titles, None, threshold).select("a", "b"))
    labels = durable(components(pairs))
    # titles of a component, and whether each is linked to each
    links = pairs.join(labels, F.col("a") == F.col("node")).groupBy("label").agg(F.count("*").alias("links"))
    sizes = labels.groupBy("label").agg(F.count("*").alias("titles")).join(links, "label")
    loose = sizes.where(F.col("links") * 2 < F.col("titles") * (F.col("titles") - 1)).select(F.col("label").alias("loose"))
    named = rows.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    marked = durable(named.join(loose, F.col("label") == F.col("loose"), "left").withColumn("loose", F.col("loose").isNotNull()))
    best = marked.where("NOT loose").groupBy("label").agg(F.max(F.struct("weight", "length", (-F.col("seq")).alias("back"))).alias("best"))
    kept = best.select((-F.col("best.back")).alias("kept"))
    rest = marked.where("loose").select("label", "key", "seq", "weight", "length")
    return articles.join(kept.union(_settled(rest, pairs, piece)), F.col("seq") == F.col("kept"), "left_semi")


def _settled(rows: DataFrame, pairs: DataFrame, piece: int) -> DataFrame:
    """The survivors (kept) of components whose titles are not all alike."""
    count = rows.groupBy("label").agg(F.count("*").alias("n"))
    most = count.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    if not most:
        return rows.select(F.col("seq").alias("kept"))
    # where pieces of a component begin; of a small one there are none
    steps = F.array(*[F.lit(k * piece / most) for k in range(1, -(-most // piece))]) if most > piece else None
    if steps is None:
        cut = rows.withColumn("piece", F.lit(0))
    else:
        bounds = rows.groupBy("label").agg(F.percentile_approx("seq", steps, 10_000).alias("bounds"), F.count("*").alias("n"))
        bounds = bounds.where(F.col("n") > piece).select("label", "bounds")
        cut = rows.join(bounds, "label", "left").withColumn("piece", F.coalesce(F.size(F.filter("bounds", lambda b: b < F.col("seq"))), F.lit(0))).drop("bounds")
        cut = durable(cut)
    both = pairs.select(F.col("a").alias("key"), F.col("b").alias("other")).union(pairs.select(F.col("b").alias("key"), F.col("a").alias("other")))
    dead = None
    for k in range(-(-most // piece) if most > piece else 1):
        now = cut.where(F.col("piece") == k).drop("piece")
        keys = now.select("label", "key").distinct()
        near = keys.join(both, "key")
        right = near.select("label", "key", "other", *[F.lit(None).cast("bigint").alias(c) for c in ("seq", "weight", "length")])
        if k:
            asked = near.select("label", F.col("other").alias("key")).union(keys).distinct()
            alive = cut.where(F.col("piece") < k).drop("piece").join(dead, F.col("seq") == F.col("dead"), "left_anti").join(asked, ["label", "key"], "left_semi")
            right = right.union(alive.select("label", "key", F.lit(None).cast("string").alias("other"), "seq", F.col("weight").cast("bigint").alias("weight"), F.col("length").cast("bigint").alias("length")))
        # columns of their own, since both sides come from one table
        left = now.select(*[F.col(c).alias(f"own_{c}") for c in ("label", "key", "seq", "weight", "length")])
        found = durable(left.groupBy("own_label").cogroup(right.groupBy("label")).applyInPandas(_decide, "dead bigint"))
        dead = found if dead is None else durable(dead.union(found))
    return rows.join(dead, F.col("seq") == F.col("dead"), "left_anti").select(F.col("seq").alias("kept"))
