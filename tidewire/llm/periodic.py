"""Periodic run detection by suffix trees, after Stoye and Gusfield.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) of ``min_words`` words and of
``min_periods`` periods or more that no neighbouring word extends. Words are told apart by a dictionary of the words
themselves, not by hashes, and numbered from 0 within their text.

* A word can be in a run only if ``probe`` words in a row around it occur twice in the text, ``probe`` being what the shortest
  run repeats. Other words would only be leaves high up in the tree, so they are left out; the stretches of words that stay each
  get a suffix tree of their own, all stretches of a batch in one forest. Equal hashes only let more words stay.
* The forest is built from suffixes sorted by doubling, whose ranks of 1, 2, 4, ... words are kept: they give the lengths of
  common prefixes and from these the inner nodes, and later tell in a few steps how far two places agree.
* An inner node of depth d with leaves i and i + d in different children is a branching tandem repeat: two equal stretches of
  d words that the next word does not continue. To find them, only the leaves outside of a node's largest child are listed,
  each asking for i + d and i - d; a leaf is listed for at most log2(n) nodes. All leaves climb at once, a heavy path a step.
* A repeat is rotated to the left as far as words d apart agree, which gives the stretch of period d that ends where the
  repeat ends. Repeats of one stretch are merged, the smallest d being its period; the long ones are the runs.

The ``collapsed`` text keeps a run's first period: a word goes if any run contains it behind that run's first q words.

A task holds the words of a few megabytes of texts, or of one longer text, as integers.

Edge cases: a null or empty text has no words and no runs, and an empty collapsed text. Rows are handled one by one, so null ids,
ties and repeated rows need no care. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, byte_sizes, mixed, read

MIN_WORDS, MIN_PERIODS = 6, 4
#: Bytes of texts that are worked on at a time, and words that are joined at a time.
BATCH, BLOCK = 1 << 21, 1 << 16
SPACES = np.isin(np.arange(256), (0x20, *range(0x09, 0x0E)))


def words_of(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one buffer, first bytes and ends of all words, their numbers, and the first word of each text and the end."""
    joined = b" ".join(texts)
    raw = np.frombuffer(joined, np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~SPACES[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    plain = raw[inside[1:-1]]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(plain)])
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64) if len(starts) else np.zeros(0, np.int64)
    places = np.cumsum([0] + [len(t) + 1 for t in texts])
    return joined, starts, ends, codes, np.searchsorted(starts, places)


def stretches(codes: np.ndarray, text: np.ndarray, probe: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Firsts and ends of the stretches of at least ``least`` words, within a text, that sequences of ``probe`` words seen twice in it cover."""
    m = len(codes) - probe + 1
    none = np.zeros(0, np.int64)
    if m < 2:
        return none, none
    whole = text[:m] == text[probe - 1 :]
    total = text[:m].astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(probe):
            total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + m].astype(np.uint64))
    ordered = np.sort(total[whole])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return none, none
    at = np.minimum(np.searchsorted(twice, total), len(twice) - 1)
    at = np.flatnonzero((twice[at] == total) & whole)
    step = np.zeros(len(codes) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + probe, -1)
    covered = np.concatenate(([False], np.cumsum(step[:-1]) > 0, [False]))
    # a text's end ends a stretch too
    inner = np.flatnonzero(covered[1:-2] & covered[2:-1] & (text[1:] != text[:-1])) + 1
    edges = np.flatnonzero(covered[1:] != covered[:-1])
    first, end = np.sort(np.concatenate((edges[::2], inner))), np.sort(np.concatenate((edges[1::2], inner)))
    long = end - first >= least
    return first[long], end[long]


def sorted_suffixes(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffixes in order, and the ranks of the sequences of 1, 2, 4, ... words at each place, up to the one that tells all apart."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].reshape(-1).astype(np.int64)
    levels, width = [rank.astype(np.int32)], 1
    order = np.argsort(rank)
    while n and rank[order[-1]] + 1 < n:
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        levels.append(rank.astype(np.int32))
        width *= 2
    return order, levels


def agree(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words agree from places a and b on, or before them."""
    n = len(levels[0])
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = (a - out - (1 << k), b - out - (1 << k)) if back else (a + out, b + out)
        fits = (x >= 0) & (y >= 0) if back else (x < n) & (y < n)
        at = np.flatnonzero(fits)
        at = at[levels[k][x[at]] == levels[k][y[at]]]
        out[at] += 1 << k
    return out


def inner_nodes(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inner nodes of the suffix tree as depth, first leaf, last leaf and parent (the root is node 0), and each leaf's parent.

    Leaves are in the order of the suffixes; ``lcp`` has the common prefixes of neighbours.
    """
    depth, left, right, parent, leaf = [0], [0], [0], [0], []
    stack = [0]
    for k, now in enumerate(lcp.tolist()):
        top = deepest = stack[-1]
        first, last = k, -1
        while depth[top] > now:
            stack.pop()
            right[top] = k
            first, last, top = left[top], top, stack[-1]
            if depth[top] >= now:
                parent[last] = top
                last = -1
        if depth[top] < now:
            top = len(depth)
            depth.append(now)
            left.append(first)
            right.append(0)
            parent.append(0)
            if last >= 0:
                parent[last] = top
            stack.append(top)
        leaf.append(top if now > depth[deepest] else deepest)
    leaf.append(stack[-1])
    for below, top in zip(stack[:0:-1], stack[-2::-1], strict=True):
        parent[below] = top
    for node in stack:
        right[node] = len(lcp)
    return tuple(np.array(x, np.int64) for x in (depth, left, right, parent, leaf))


def branching_repeats(order: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(first word, half length) of all branching tandem repeats."""
    n = len(order)
    depth, left, right, parent, node = inner_nodes(agree(levels, order[:-1], order[1:]))
    # the largest inner child of each node is not listed; the nodes above it follow from the top of its path
    heavy = np.zeros(len(depth), bool)
    child = np.arange(1, len(depth))
    by = child[np.lexsort((right[child] - left[child], parent[child]))]
    heavy[by[np.append(parent[by][1:] != parent[by][:-1], True)] if len(by) else by] = True
    top = np.where(heavy, parent, np.arange(len(depth)))
    while not np.array_equal(top[top], top):
        top = top[top]
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    leaf = np.arange(n)
    low, high = leaf.copy(), leaf.copy()
    starts, halves = [], []
    while len(leaf):
        place, d = order[leaf], depth[node]
        for other, first in ((place + d, place), (place - d, place - d)):
            at = np.flatnonzero((d > 0) & (other >= 0) & (other < n))
            r = rank[other[at]]
            hit = at[(left[node[at]] <= r) & (r <= right[node[at]]) & ((r < low[at]) | (r > high[at]))]
            starts.append(first[hit])
            halves.append(d[hit])
        path = top[node]
        on = path > 0
        leaf, path = leaf[on], path[on]
        low, high, node = left[path], right[path], parent[path]
    return np.concatenate(starts), np.concatenate(halves)


def runs_of(codes: np.ndarray, text: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, smallest period) of all runs, in order; ``text`` has the number of each word's text."""
    # a run of period q repeats words for its length less q: of the shortest, so many in a row are seen twice
    shortest = max(min_words, min_periods)
    probe = max(1, min(max(min_words, min_periods * q) - q for q in range(1, shortest + 1)))
    first, end = stretches(codes, text, probe, shortest)
    if not len(first):
        return (np.zeros(0, np.int64),) * 3
    size = end - first
    number = np.repeat(np.arange(len(first)), size)
    places = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    # no word is in two stretches, so nothing agrees beyond a stretch's end
    order, levels = sorted_suffixes(number * (int(codes.max()) + 1) + codes[places])
    start, half = branching_repeats(order, levels)
    stop = start + 2 * half
    begin = start + half - agree(levels, start + half, stop, back=True)
    length = stop - begin
    keep = np.flatnonzero((length >= min_words) & (length >= min_periods * half))
    begin, stop, half = begin[keep], stop[keep], half[keep]
    by = np.lexsort((half, stop, begin))
    begin, stop, half = begin[by], stop[by], half[by]
    once = np.concatenate(([True], (begin[1:] != begin[:-1]) | (stop[1:] != stop[:-1]))) if len(begin) else np.zeros(0, bool)
    begin, stop, half = begin[once], stop[once], half[once]
    found = places[begin], places[stop - 1] + 1, half
    by = np.lexsort((found[2], found[0]))
    return tuple(x[by] for x in found)


def _joined(buffer: bytes, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> bytes:
    """Words joined by one space."""
    parts = []
    for k in range(0, len(keep), BLOCK):
        some = keep[k : k + BLOCK]
        parts.append(b" ".join([buffer[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]))
    return b" ".join(parts)


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _runs(min_words: int, min_periods: int):
    def run(batches):
        for batch in batches:
            column = batch.column("text").fill_null("").cast(pa.large_binary())
            for low, high in batches_of(byte_sizes(column), BATCH):
                buffer, starts, ends, codes, firsts = words_of(column.slice(low, high - low).to_pylist())
                number = np.diff(firsts)
                text = np.repeat(np.arange(len(number)), number)
                a, b, q = runs_of(codes, text, min_words, min_periods)
                gone = np.zeros(len(codes) + 1, np.int64)
                np.add.at(gone, a + q, 1)
                np.add.at(gone, b, -1)
                gone = np.cumsum(gone[:-1]) > 0
                out = [_joined(buffer, starts, ends, x + np.flatnonzero(~gone[x:y])) for x, y in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)]
                of = text[a]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(of, np.arange(len(number) + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (a - firsts[of], b - a, q)], names=["start", "length", "period"]),
                )
                yield pa.record_batch(
                    [batch.column("doc_id").slice(low, high - low), pa.array(number.astype(np.int64)), lists, pa.array(out, pa.large_binary()).cast(pa.large_string()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )
        pa.default_memory_pool().release_unused()

    return run


def find_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """doc_id, n_words, runs (structs of start, length and period, by start, then period) and collapsed text of every whole text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_runs(min_words, min_periods), f"doc_id {dict(rows.dtypes)['doc_id']}, n_words bigint, runs array<{RUN}>, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """One row per text: its number of runs, the longest of them, and digests of all runs and of the collapsed text."""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    best = found.withColumn("best", longest)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def repeating(docs: DataFrame) -> DataFrame:
    """doc_id and text: the texts, of which those whose id has a crc32 divisible by 10 become periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def bound(value: Column, then) -> Column:
        """``then`` of a value that is evaluated once."""
        return F.transform(F.array(value), then)[0]

    def changed(x: Column) -> Column:
        n, g = F.size(x), F.floor(h / 10)
        places = F.struct((g % n).cast("int").alias("a"), n.alias("n"), g.alias("g"))
        periods = lambda y: F.struct(y["a"].alias("a"), n.alias("n"), (1 + F.floor((n - y["a"]) / (3 + y["g"] % 8))).cast("int").alias("p"))
        word = lambda i, z: F.get(x, F.when(i < z["a"], i).otherwise(z["a"] + (i - z["a"]) % z["p"]))
        full = bound(places, lambda y: bound(periods(y), lambda z: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: word(i, z)), " ")))
        return F.when(n > 0, full).otherwise(F.lit(""))

    text = F.when((h % 10 == 0) & F.col("text").isNotNull(), bound(words, changed)).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_runs(repeating(read(spark, sf_dir, "documents"))))


#: DuckDB SQL of the query. A run of period q repeats five words or more at distance q, so pairs of equal five words, in rows without
#: a gap, give all stretches of period q; of those over the same words the least period counts.
OP11_SQL = f"""
WITH crcs AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) AS r(i))
), coded AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
    xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h FROM documents, crcs
), placed AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM coded),
sized AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM placed),
texts AS MATERIALIZED (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM sized
), word AS MATERIALIZED (SELECT r, n, unnest(w) AS x, unnest(range(n)) AS i FROM texts WHERE n > 0),
fives AS MATERIALIZED (
  SELECT r, n, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS five FROM word WINDOW o AS (PARTITION BY r ORDER BY i)
), pairs AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM fives AS x JOIN fives AS y ON x.r = y.r AND x.five = y.five AND y.i > x.i AND {MIN_PERIODS} * (y.i - x.i) <= x.n
), islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT r, q, min(i) AS s, max(i) + 5 + q AS e FROM islands GROUP BY r, q, island),
runs AS MATERIALIZED (SELECT r, s, e, min(q) AS q FROM stretches WHERE e - s >= greatest({MIN_WORDS}, {MIN_PERIODS} * q) GROUP BY r, s, e),
listed AS (SELECT r, count(*) AS n_runs, sha256(string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q)) AS runs_sha256 FROM runs GROUP BY r),
longest AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY e - s DESC, s, q) AS place FROM runs),
gone AS (SELECT DISTINCT r, unnest(range(s + q, e)) AS i FROM runs),
kept AS (SELECT word.r, sha256(string_agg(x, ' ' ORDER BY word.i)) AS collapsed_sha256 FROM word LEFT JOIN gone ON gone.r = word.r AND gone.i = word.i WHERE gone.i IS NULL GROUP BY word.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, e - s AS length, q AS period, 1000 * (e - s) // q AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256,
  coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
FROM texts AS t LEFT JOIN listed AS l ON l.r = t.r LEFT JOIN longest AS b ON b.r = t.r AND b.place = 1 LEFT JOIN kept AS k ON k.r = t.r
"""
