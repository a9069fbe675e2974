"""Events: leader clustering of titles and the roll-up of clusters."""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .. import params
from ..functions.text import bigrams, companies, event_type, jaccard, title_key
from ..functions.urls import event_id, reliability_weight
from .graph import components, durable
from .similarity import distinct_sets, similar_sets


class Leaders:
    """Clusters of rows that arrive in order.

    A row joins the cluster whose united bigrams are most alike, the earliest of equals, among those that reach
    the cluster's threshold, which is lower if they share a company. Rows without bigrams stay alone. An index
    from bigrams to clusters finds the clusters with a common bigram; no other can be alike. No row is kept.
    """

    def __init__(self, threshold: float):
        self.threshold, self.relaxed = threshold, relaxed_threshold(threshold)
        self.grams: list[set[str]] = []
        self.sizes = np.zeros(64, np.int64)
        self.index: dict[str, array] = {}
        self.companies: dict[str, array] = {}

    def _clusters(self, index: dict[str, array], keys) -> np.ndarray:
        """How many of the keys each cluster has."""
        held = [np.frombuffer(index[k], np.int32) for k in keys if k in index]
        return np.bincount(np.concatenate(held), minlength=len(self.grams)) if held else np.zeros(len(self.grams), np.int64)

    def add(self, grams: list[str], names: list[str]) -> int:
        """The number of the row's cluster, a new one if none is alike."""
        own, names_set, n = set(grams), set(names), len(self.grams)
        best = -1
        if own and n:
            shared = self._clusters(self.index, own)
            sims = shared / (len(own) + self.sizes[:n] - shared)
            least = np.where(self._clusters(self.companies, names_set) > 0, self.relaxed, self.threshold) if names_set else self.threshold
            sims[(sims < least) | (shared == 0)] = 0
            # the first of equals
            best = int(np.argmax(sims))
            best = best if sims[best] > 0 else -1
        if best < 0:
            best = n
            self.grams.append(set())
            if n == len(self.sizes):
                self.sizes = np.concatenate([self.sizes, np.zeros(n, np.int64)])
        for g in own - self.grams[best]:
            self.index.setdefault(g, array("i")).append(best)
        self.grams[best] |= own
        self.sizes[best] = len(self.grams[best])
        for name in names_set:
            self.companies.setdefault(name, array("i")).append(best)
        return best


def relaxed_threshold(threshold: float) -> float:
    return max(params.COMPANY_FLOOR, threshold - params.COMPANY_RELAXATION)


def scan_leaders(rows: list[tuple[list[str], list[str]]], threshold: float) -> list[int]:
    """Cluster numbers for rows of (bigrams, companies) in order."""
    leaders = Leaders(threshold)
    return [leaders.add(*r) for r in rows]


#: Rare bigrams that a title and a group have in common before all are counted.
SHARED = 4


def closed_groups(titles: DataFrame, threshold: float, max_rounds: int = 60) -> DataFrame:
    """(id, group) for (bucket, id, grams, named) rows: groups such that no title can join a cluster of another group.

    A title of n bigrams joins a cluster only if the cluster holds ceil(t n) of them, t being the threshold that it may count
    on. So it joins none of a group whose titles together hold fewer. Groups start as single titles; a title and a group
    that holds enough of its bigrams become one, until no such pair is left.

    Of many titles nearly all end in one group for each bucket, and to find that from pairs would make a row of nearly each pair. So the group
    of the title with the most frequent bigrams is found first, from its bigrams alone: it takes in all titles of which it holds
    enough, and their bigrams, until it takes no more. What is left goes by pairs: candidates share ``SHARED`` of the title's
    n - ceil(t n) + ``SHARED`` rarest bigrams (a group lacks n - ceil(t n) at most), and are counted in full. Bigrams of a group are
    listed once, however many titles have them.
    """
    t = F.when(F.col("named"), F.lit(relaxed_threshold(threshold))).otherwise(F.lit(threshold))
    need = F.greatest(F.ceil(F.size("grams") * t - F.lit(1e-9)).cast("int"), F.lit(1))
    each = titles.where(F.size("grams") > 0).select("id", "bucket", F.size("grams").alias("n"), need.alias("need"), F.explode("grams").alias("gram"))
    frequency = each.groupBy("bucket", "gram").agg(F.count("*").alias("f"))
    ranked = each.join(frequency, ["bucket", "gram"]).groupBy("id", "bucket", "n", "need").agg(F.sort_array(F.collect_list(F.struct("f", "gram"))).alias("order"), F.sum("f").alias("weight"))
    # numbers stand for ids, which are long, once the checkpoint has fixed them
    sets = durable(ranked.select("id", F.monotonically_increasing_id().alias("no"), "bucket", "n", "need", "weight", F.transform("order", lambda o: o["gram"]).alias("order")))
    grams = sets.select("no", "bucket", "need", F.explode("order").alias("gram"))
    least = F.least(F.col("need"), F.lit(SHARED))
    rare = sets.select("no", "bucket", "need", F.explode(F.slice("order", F.lit(1), F.col("n") - F.col("need") + least)).alias("gram"))
    groups = durable(_first_groups(sets, grams, max_rounds))
    for _ in range(max_rounds):
        held = grams.select("no", "bucket", "gram").join(groups, "no").select("bucket", "gram", F.col("group").alias("other")).distinct()
        met = rare.join(groups, "no").join(held, ["bucket", "gram"]).where(F.col("other") != F.col("group"))
        met = met.groupBy("no", "bucket", "group", "need", "other").agg(F.count("*").alias("shared")).where(F.col("shared") >= least).drop("shared")
        full = met.join(grams.select("no", "gram"), "no").join(held, ["bucket", "gram", "other"])
        sure = full.groupBy("no", "group", "need", "other").agg(F.count("*").alias("have")).where(F.col("have") >= F.col("need"))
        found = Observation()
        links = durable(sure.select(F.col("group").alias("a"), F.col("other").alias("b")).distinct().observe(found, F.count(F.lit(1)).alias("n")))
        if not found.get["n"]:
            return groups.join(sets.select("no", "id"), "no").select("id", F.col("group").cast("string").alias("group"))
        # each group goes with the least that it is linked to, and then with what that goes with
        low = links.union(links.select("b", "a")).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("old"), F.least("a", "m").alias("m"))
        onward = low.select(F.col("old").alias("m"), F.col("m").alias("mm"))
        names = low.join(onward, "m", "left").select("old", F.coalesce("mm", "m").alias("new"))
        groups = durable(groups.join(names, F.col("group") == F.col("old"), "left").select("no", F.coalesce("new", "group").alias("group")))
    raise RuntimeError("groups did not settle")


def _first_groups(sets: DataFrame, grams: DataFrame, max_rounds: int) -> DataFrame:
    """(no, group): one group for each bucket that is closed against titles it could take in; other titles are groups of their own."""
    seeds = sets.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("no")).alias("back"))).alias("seed")).select(F.col("bucket").alias("of"), (-F.col("seed.back")).alias("seed"))
    inside = sets.join(seeds, F.col("no") == F.col("seed")).select("no")
    count = 0
    for _ in range(max_rounds):
        core = grams.join(inside, "no", "left_semi").select("bucket", "gram").distinct()
        more = grams.join(core, ["bucket", "gram"]).groupBy("no", "need").agg(F.count("*").alias("have")).where(F.col("have") >= F.col("need"))
        found = Observation()
        inside = durable(more.select("no").observe(found, F.count(F.lit(1)).alias("n")))
        if found.get["n"] == count:
            break
        count = found.get["n"]
    marked = sets.join(inside.select(F.col("no").alias("in")), F.col("no") == F.col("in"), "left").join(seeds, F.col("bucket") == F.col("of"))
    return marked.select("no", F.when(F.col("in").isNotNull(), F.col("seed")).otherwise(F.col("no")).alias("group"))


def _scan(threshold: float):
    """Clusters of sorted rows, group by group; a task holds the clusters of one group."""

    def run(batches):
        group = leaders = None
        place, first = 0, {}
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                out, places = [], []
                keys = zip(*(part.column(c).to_pylist() for c in ("bucket", "group", "seq", "grams", "names")), strict=True)
                for bucket, name, seq, grams, names in keys:
                    if (bucket, name) != group:
                        group, leaders, place, first = (bucket, name), Leaders(threshold), 0, {}
                    place += 1
                    out.append(first.setdefault(leaders.add(grams, names), seq))
                    places.append(place)
                yield pa.record_batch([part.column("seq"), part.column("bucket"), pa.array(out, pa.int64()), pa.array(places, pa.int64())], names=["seq", "bucket", "cluster", "place"])

    return run


def assign_clusters(articles: DataFrame, threshold: float = params.CLUSTER_THRESHOLD, by: str | None = None, dictionary=params.COMPANIES,
                    guard: Callable[[int], None] | None = None, found: dict[str, int] | None = None) -> DataFrame:
    """(seq, bucket, cluster) for every article; a cluster of a ``by`` is named by the seq of its first article.

    The scan is sequential by definition, but titles of different closed groups never meet, so groups are scanned apart, each in
    the order of seq and without being held. Only seq, bigrams and companies of titles reach Python. ``guard`` is called
    with the number of articles as soon as the first step has counted them; ``found`` gets the size of the largest group.
    """
    day = F.col(by).cast("string") if by else F.lit("")
    title = F.coalesce("title", F.lit(""))
    key = title_key(F.col("title"))
    counted = Observation()
    slim = articles.select("seq", F.coalesce(day, F.lit("")).alias("bucket"), key.alias("key"), companies(title, dictionary).alias("names"))
    slim = durable(slim.withColumn("id", F.concat("bucket", F.lit("\n"), "key")).observe(counted, F.count(F.lit(1)).alias("n")))
    if guard:
        guard(counted.get["n"])
    grams = bigrams(F.col("key"), False)
    titles = slim.groupBy("id").agg(F.min("bucket").alias("bucket"), F.min("key").alias("key"), F.max(F.size("names") > 0).alias("named"))
    groups = closed_groups(titles.select("id", "bucket", grams.alias("grams"), "named"), threshold)
    # titles without a letter or digit have no bigrams and are alone
    named = slim.join(groups, "id", "left").withColumn("group", F.coalesce("group", F.col("seq").cast("string"))).select("bucket", "group", "seq", grams.alias("grams"), "names")
    largest = Observation()
    order = named.repartition("bucket", "group").sortWithinPartitions("bucket", "group", "seq")
    scanned = order.mapInArrow(_scan(threshold), "seq bigint, bucket string, cluster bigint, place bigint")
    out = durable(scanned.observe(largest, F.coalesce(F.max("place"), F.lit(0)).alias("n")))
    if found is not None:
        found["largest_group"] = largest.get["n"]
    return out.drop("place")


def pair_score(sets: Column) -> Column:
    """Mean Jaccard similarity of all pairs of an array of bigram sets; 1 for a single one."""
    n = F.size(sets)
    index = F.sequence(F.lit(1), n)
    sims = F.flatten(F.transform(index, lambda i: F.transform(F.filter(index, lambda j: j > i), lambda j: jaccard(F.element_at(sets, i), F.element_at(sets, j)))))
    return F.when(n < 2, F.lit(1.0)).otherwise(F.bround(F.aggregate(sims, F.lit(0.0), lambda a, x: a + x) / F.size(sims), 3))


def roll_up(articles: DataFrame, clusters: DataFrame, as_of: Column | None = None, dictionary=params.COMPANIES, rules=params.EVENT_RULES) -> DataFrame:
    """One event for each cluster: members by reliability, title length and order; the first gives title and type."""
    marks = clusters.select(F.col("seq").alias("__seq"), F.col("bucket").alias("__bucket"), F.col("cluster").alias("__cluster"))
    named = articles.join(marks, F.col("seq") == F.col("__seq")).withColumns({
        "__w": reliability_weight(F.col("source_reliability")),
        "__names": companies(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))), dictionary),
        "__grams": bigrams(title_key(F.col("title")), False),
    })
    # sets by domain and company are bounded by their number; members carry ids, and five of them bigrams
    member = F.struct((-F.col("__w")).alias("w"), (-F.length(F.coalesce("title", F.lit("")))).alias("l"), "seq", "article_id", "title", "snippet")
    base = named.groupBy("__bucket", "__cluster").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("__w")).alias("w"), (-F.length(F.coalesce("title", F.lit("")))).alias("l"), "seq", "article_id"))).alias("members"),
        F.min(member).alias("head"),
        F.count("*").cast("int").alias("article_count"),
        F.min("published_at").alias("earliest_published_at"),
        F.max("published_at").alias("latest_published_at"),
        F.sort_array(F.collect_set("source_domain")).alias("source_domains"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("__names")))).alias("companies_mentioned"),
        F.min("seq").alias("seq"),
    )
    of_cluster = Window.partitionBy("__bucket", "__cluster").orderBy(F.desc("__w"), F.desc(F.length(F.coalesce("title", F.lit("")))), "seq")
    five = named.select("__bucket", "__cluster", "__grams", F.row_number().over(of_cluster).alias("__n")).where("__n <= 5")
    five = five.groupBy("__bucket", "__cluster").agg(F.sort_array(F.collect_list(F.struct("__n", "__grams"))).alias("__five"))
    return base.join(five, ["__bucket", "__cluster"]).select(
        "seq", event_id(F.col("head.title")).alias("event_id"), F.col("head.title").alias("canonical_title"),
        F.transform("members", lambda m: m["article_id"]).alias("article_ids"), "article_count",
        event_type(F.coalesce("head.title", F.lit("")), F.coalesce("head.snippet", F.lit("")), rules).alias("event_type_guess"),
        "earliest_published_at", "latest_published_at", "source_domains", "companies_mentioned",
        pair_score(F.transform("__five", lambda m: m["__grams"])).alias("cluster_score"),
        (as_of if as_of is not None else F.current_timestamp()).alias("created_at"),
    )


def cluster_articles(articles: DataFrame, threshold: float = params.CLUSTER_THRESHOLD, by: str | None = None, as_of: Column | None = None,
                     dictionary=params.COMPANIES, rules=params.EVENT_RULES, guard: Callable[[int], None] | None = None, found: dict[str, int] | None = None) -> DataFrame:
    """Events of articles; see ``by_heat`` for their order."""
    return roll_up(articles, assign_clusters(articles, threshold, by, dictionary, guard, found), as_of, dictionary, rules)


def by_heat() -> list[Column]:
    """Order of events: articles, then domains, then appearance."""
    return [F.desc("article_count"), F.desc(F.size("source_domains")), F.col("seq")]


def cluster_components(articles: DataFrame, threshold: float = params.CLUSTER_THRESHOLD) -> DataFrame:
    """(seq, component): connected components of pairwise similar titles, named by their least seq.

    A scalable alternative that does not depend on order; it is not the leader clustering.
    """
    key = title_key(F.col("title"))
    rows = articles.select("seq", key.alias("key"))
    titles = durable(distinct_sets(rows, F.col("key"), bigrams(F.col("key"), False)))
    labels = components(similar_sets(titles, None, threshold).select("a", "b"))
    # titles without a letter or digit match nothing, not even each other
    own = F.when(F.col("key") == "", F.col("seq").cast("string"))
    named = rows.join(labels, F.col("key") == F.col("node"), "left").withColumn("group", F.concat(F.when(F.col("key") == "", "#").otherwise("="), F.coalesce(own, "label", "key")))
    least = named.groupBy("group").agg(F.min("seq").alias("component"))
    return named.join(least, "group").select("seq", "component")
