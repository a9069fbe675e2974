"""Benchmark decontamination by Wu-Manber search over words.

Benchmark items become windows of ten consecutive words (an item of fewer words is one window). A
window is a pattern over the alphabet of words: a shift table on blocks of two words tells how far the
search may skip, the suffix block of a pattern selects the few windows that may end at a position, and
a direct comparison of the words confirms an occurrence.

The tables are broadcast. Their size follows the benchmark, not the corpus, and it is bounded: a
benchmark above ``block_chars`` characters is split into blocks by a hash of its rows, and the documents
pass one block's tables after the other. In between they are checkpointed and the block's tables are dropped, so that
no task and no executor holds more than one block.

Edge cases: a null or empty text has no words, so its counts are 0 and it is not contaminated. A null or
empty benchmark text has no window. A null item id marks words but is not listed as an item. Items or
documents that occur twice are handled row by row; an item id counts once per document. An empty
benchmark leaves every document clean; an empty corpus gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_words, durable, filter_by_text, read, texts

BLOCK_CHARS = 8_000_000


class WuManber:
    """Pattern tables for one pattern length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[str]]):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[list[bytes], list[str]]]] = {}
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                key = words[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.buckets.setdefault(words[length - self.block :], []).append((list(words), items))

    def search(self, words: list[bytes], spans: list[tuple[int, int]], items: set[str]) -> None:
        """Add the occurrences' word spans and item ids."""
        length, block, far, shift, buckets = self.length, self.block, self.far, self.shift, self.buckets
        end, n = length, len(words)
        while end <= n:
            key = tuple(words[end - block : end])
            skip = shift.get(key, far)
            if skip:
                end += skip
                continue
            found = False
            for pattern, owners in buckets.get(key, ()):
                if words[end - length : end] == pattern:
                    found = True
                    items.update(owners)
            if found:
                spans.append((end - length, end))
            end += 1


def tables(items: list[tuple[str | None, str | None]], window: int) -> list[WuManber]:
    """Search tables for (item id, text) rows, one for each window length that occurs."""
    by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for item, text in items:
        words = alnum_words((text or "").encode())
        if not words:
            continue
        m = min(window, len(words))
        for k in range(len(words) - m + 1):
            owners = by_length.setdefault(m, {}).setdefault(tuple(words[k : k + m]), [])
            if item is not None and item not in owners:
                owners.append(item)
    return [WuManber(m, p) for m, p in sorted(by_length.items())]


def covered(spans: list[tuple[int, int]]) -> int:
    """Words inside any span."""
    total = last = 0
    for a, b in sorted(spans):
        if b > last:
            total += b - max(a, last)
            last = b
    return total


def _search_block(shared, last: bool, carries: bool):
    """A pass over Arrow batches for one block of the benchmark."""

    def run(batches):
        searchers = shared.value
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_words", "n_hit", "n_items", "items_sha256", "items", "spans")}
            old_spans = batch.column("spans").to_pylist() if carries else [()] * batch.num_rows
            old_items = batch.column("items").to_pylist() if carries else [()] * batch.num_rows
            for text, s, i in zip(texts(batch), old_spans, old_items, strict=True):
                words = alnum_words(text)
                spans, items = list(zip(s[::2], s[1::2], strict=True)), set(i)
                for x in searchers:
                    x.search(words, spans, items)
                names = sorted(items)
                out["n_words"].append(len(words))
                out["n_hit"].append(covered(spans))
                out["n_items"].append(len(names))
                out["items_sha256"].append(hashlib.sha256(",".join(names).encode()).hexdigest())
                out["items"].append(names)
                out["spans"].append([x for span in sorted(set(spans)) for x in span])
            if last:
                yield pa.record_batch(
                    [batch.column("doc_id"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_hit"], pa.int64()),
                     pa.array(out["n_items"], pa.int64()), pa.array(out["items_sha256"], pa.string()),
                     pa.array([x > 0 for x in out["n_hit"]], pa.bool_()), pa.array(out["items"], pa.list_(pa.string())),
                     pa.array(out["spans"], pa.list_(pa.int64()))],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"],
                )
            else:
                yield pa.record_batch(
                    [batch.column("doc_id"), batch.column("text"), pa.array(out["items"], pa.list_(pa.string())),
                     pa.array(out["spans"], pa.list_(pa.int64()))],
                    names=["doc_id", "text", "items", "spans"],
                )

    return run


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, window: int, block_chars: int):
    """(broadcast search tables, is the last) for each block of about ``block_chars`` characters; one at least, made when it is due."""
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    chars = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(chars / block_chars))
    if n > 1:
        bench = durable(bench.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))))
    for k in range(n):
        part = bench.where(F.col("block") == k).select("item", "text") if n > 1 else bench
        yield benchmark.sparkSession.sparkContext.broadcast(tables([tuple(r) for r in part.collect()], window)), k == n - 1


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Occurrences of benchmark windows in every whole text.

    Returns one row per input row: doc_id, n_words, n_hit (words inside an occurrence), n_items,
    items_sha256 (of the sorted, comma-joined item ids), contaminated (n_hit > 0), items (the sorted ids)
    and spans (flat start, end word positions of the occurrences). See the module for edge cases.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    key, carries = dict(df.dtypes)["doc_id"], False
    for shared, last in _blocks(benchmark, item_col, item_text_col, window, block_chars):
        schema = (
            f"doc_id {key}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>, spans array<bigint>"
            if last
            else f"doc_id {key}, text string, items array<string>, spans array<bigint>"
        )
        df = df.mapInArrow(_search_block(shared, last, carries), schema)
        if not last:
            df, carries = durable(df), True
            shared.unpersist()
    return df


def uncontaminated(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = 10, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Rows of ``docs`` whose whole text holds no benchmark window, with all their columns."""

    def clean(shared):
        def predicate():
            searchers = shared.value

            def decide(texts_):
                out = []
                for text in texts_:
                    words, spans, items = alnum_words(text), [], set()
                    for x in searchers:
                        x.search(words, spans, items)
                    out.append(not spans)
                return out

            return decide

        return predicate

    for shared, last in _blocks(benchmark, item_col, item_text_col, window, block_chars):
        docs = filter_by_text(docs, text_col, clean(shared))
        if not last:
            docs = durable(docs)
            shared.unpersist()
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP1_SQL = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), pattern AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(ws)) AS m, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS p
  FROM item, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS t(i)
  WHERE len(ws) > 0
), doc AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), CAST([] AS VARCHAR[])) AS ws
  FROM documents
), place AS (
  SELECT rid, i, m, array_to_string(ws[i:i + m - 1], ' ') AS p
  FROM doc, (SELECT DISTINCT m FROM pattern), unnest(range(1, len(ws) - m + 2)) AS t(i)
), hit AS (
  SELECT DISTINCT rid, i, m, item FROM place JOIN pattern USING (m, p)
), words AS (
  SELECT rid, count(DISTINCT w) AS n_hit FROM hit, unnest(range(i, i + m)) AS t(w) GROUP BY rid
), items AS (
  SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
