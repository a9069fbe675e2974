"""SimHash near-dedup with BK-trees.

Fingerprints are computed once per document and kept as (id, 64-bit fingerprint). Equal fingerprints
form one class, so exact copies never meet as pairs. Distinct fingerprints are dealt to shards: the 64
bits are cut into four blocks, and two fingerprints that differ in at most two bits agree in at least
two of them; each pair of blocks gives one shard key. Each shard is a BK-tree whose children are keyed
by the integer Hamming distance to their parent; a search follows only edges within the radius. A tree
lives in the task that holds its shard, together with the fingerprints that have to search it. It is
not broadcast to all executors, since the trees grow with the corpus (see the README).

A task builds and searches the trees of all its shards level by level with numpy, in bounded blocks, and
returns links that span what it found, at most one for each fingerprint in a shard. The
classes' components are then found by distributed star contraction.

Edge cases: a null or empty text, or one of white space, has fingerprint zero, which links like any
other. Fewer words than a shingle count as one shingle. A null id keeps its row; its component is the
smallest id reachable, null if there is none. Repeated rows are returned as often as they occur. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, durable, local_roots, read, spaced_words, texts

RADIUS = 2
SHINGLE = 3
#: Pairs of 16-bit blocks; four blocks for a radius of two leave two blocks equal.
BLOCK_PAIRS = list(combinations(range(4), 2))
#: (query, node) pairs expanded at once.
FRONTIER = 1_000_000


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of word shingles under XXH64 with seed 42."""
    from xxhash import xxh64_intdigest

    words = spaced_words(text)
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        return xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = (np.concatenate(([0], ends[:-1])))[: n - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64)
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        total += np.unpackbits(hashes[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def _fingerprint_batches(shingle: int):
    def run(batches):
        for batch in batches:
            values = np.array([simhash(x, shingle) for x in texts(batch)], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(values, pa.int64())], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row, fp being the fingerprint as a signed 64-bit integer."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return df.mapInArrow(_fingerprint_batches(shingle), f"doc_id {dict(df.dtypes)['doc_id']}, fp bigint")


class BKForest:
    """BK-trees over the distinct values of each shard; items must be sorted by shard."""

    def __init__(self, values: np.ndarray, shards: np.ndarray):
        self.values, n = values, len(values)
        first = np.concatenate(([True], shards[1:] != shards[:-1]))
        roots = np.flatnonzero(first)
        self.root = roots[np.cumsum(first) - 1]
        keys, children = [], []
        #: The parent of each value, -1 for roots.
        self.parent = np.full(n, -1)
        item = np.flatnonzero(~first)
        parent = self.root[item]
        while len(item):
            key = parent * 128 + np.bitwise_count(values[item] ^ values[parent]).astype(np.int64)
            order = np.lexsort((item, key))
            item, key = item[order], key[order]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            child = item[new]
            self.parent[child] = key[new] >> 7
            keys.append(key[new])
            children.append(child)
            parent, item = child[np.cumsum(new) - 1][~new], item[~new]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.child = np.concatenate(children)[order] if children else np.zeros(0, np.int64)
        self.n = n

    def links(self, radius: int, frontier: int = FRONTIER):
        """Blocks of (item, item) arrays within ``radius``, each pair once or twice."""
        stack = [(q, self.root[q]) for q in np.array_split(np.arange(self.n), max(1, -(-self.n // frontier)))]
        while stack:
            query, node = stack.pop()
            if len(query) > frontier:
                half = len(query) // 2
                stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            d = np.bitwise_count(self.values[query] ^ self.values[node]).astype(np.int64)
            hit = (d <= radius) & (query > node)
            if hit.any():
                yield query[hit], node[hit]
            low = np.searchsorted(self.key, node * 128 + np.maximum(d - radius, 0))
            width = np.searchsorted(self.key, node * 128 + np.minimum(d + radius, 64), "right") - low
            keep = width > 0
            query, low, width = query[keep], low[keep], width[keep]
            # a node of many children is expanded in parts, so no step exceeds the frontier by much
            part = np.cumsum(width) // frontier
            for p in np.unique(part):
                s = part == p
                w = width[s]
                at = np.repeat(low[s] - np.concatenate(([0], np.cumsum(w)[:-1])), w) + np.arange(w.sum())
                stack.append((np.repeat(query[s], w), self.child[at]))


def _link_shards(radius: int):
    def run(batches):
        keys, values = [], []
        for batch in batches:
            keys.append(batch.column("shard").to_numpy())
            values.append(batch.column("fp").to_numpy().view(np.uint64))
        if not keys:
            return
        key, value = np.concatenate(keys), np.concatenate(values)
        order = np.lexsort((value, key))
        key, value = key[order], value[order]
        same = np.concatenate(([False], key[1:] == key[:-1], [False]))
        many = same[1:] | same[:-1]
        key, value = key[many], value[many]
        if not len(key):
            return
        root = np.arange(len(key))
        for a, b in BKForest(value, key).links(radius):
            root = local_roots(len(key), np.concatenate((a, np.arange(len(key)))), np.concatenate((b, root)))
        linked = np.flatnonzero(root != np.arange(len(key)))
        for k in range(0, len(linked), 100_000):
            x = linked[k : k + 100_000]
            yield pa.record_batch(
                [pa.array(value[x].view(np.int64), pa.int64()), pa.array(value[root[x]].view(np.int64), pa.int64())], names=["a", "b"]
            )

    return run


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that span the graph of distinct ``fp`` values within ``radius`` bits (2 at most)."""
    if radius > 2:
        raise ValueError("four blocks cover a radius of two")
    block = [F.shiftrightunsigned("fp", 48 - 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    shard = F.array(*[F.lit(n << 32).bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j]) for n, (i, j) in enumerate(BLOCK_PAIRS)])
    dealt = distinct.select("fp", F.explode(shard).alias("shard")).repartition("shard")
    return dealt.mapInArrow(_link_shards(radius), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits) and component_id.

    component_id is the smallest id reachable over links of ``radius`` bits or fewer, itself included.
    See the module for edge cases.
    """
    prints = durable(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    classes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    labels = components(link_fingerprints(classes.select("fp"), radius))
    linked = labels.join(classes, F.col("node") == F.col("fp")).select("node", "label", "first_id")
    least = linked.groupBy("label").agg(F.min("first_id").alias("low"))
    low = linked.join(least, "label").select("node", "low")
    named = durable(classes.join(low, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("low", "first_id").alias("component_id")))
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
