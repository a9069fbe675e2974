"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct hashed words, word pairs and pairs with one word between them. The
learner keeps a rate for each coordinate and drives most weights to exactly zero, so what is broadcast for
scoring is a short list of (index, weight), bounded by the number of hash slots.

Training uses a bounded sample of the labelled rows: up to ``max_per_class`` rows of each label, those whose id (then
text) has the smallest hash, whole texts. They meet once in one task, which keeps their slots and goes over them in a fixed
order: in three passes over a full sample, in more over a smaller one, so that the learner takes about ``EXAMPLES`` steps (in
``MAX_PASSES`` at most). The intercept is shifted to the share of label 1 in all training labels. Scoring covers every row.

Edge cases: a null or empty text has no features and gets the intercept's score. A document whose training
labels disagree, or are null, is not learned from. With no labels of one kind every score is that of a
learner without data, 0.5. Repeated rows are scored as often as they occur; a null id is scored and counts
as not held out. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BYTES, crc_mod, hashed_words, read, texts

SLOTS_BITS = 20
MAX_PER_CLASS = 8000
#: Steps of a fit, and the least and most passes over the sample.
EXAMPLES, MIN_PASSES, MAX_PASSES = 48_000, 3, 20
ALPHA, BETA, L1, L2 = 1.0, 1.0, 12.0, 1.0


def slots(text: bytes, bits: int = SLOTS_BITS) -> np.ndarray:
    """Hash slots of all word 1-grams, 2-grams and 1-skip-2-grams, repeats included."""
    h, _, _ = hashed_words(text.translate(WORD_BYTES))
    a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    with np.errstate(over="ignore"):
        mixed = np.concatenate((h * a, (h[:-1] * a + h[1:]) * b, (h[:-2] * b + h[2:]) * c))
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


class FTRL:
    """FTRL-proximal for binary features; slot ``size`` is the unregularised intercept."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l2 = alpha, beta, l2
        self.size, self.l1 = size, l1

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == self.size, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, features: np.ndarray, label: int) -> None:
        """One step over distinct slots."""
        at = np.append(features, self.size)
        w = self.weights(at)
        g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum())))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights(np.arange(self.size + 1))
        at = np.flatnonzero(w)
        return at, w[at]


def labelled_sample(
    docs: DataFrame, labels: DataFrame, *, target: str, id_col: str, text_col: str, train: tuple[int, int], max_per_class: int
) -> tuple[DataFrame, dict[int, int]]:
    """(rank, label, text) of the bounded sample, and how many training documents each label has."""
    modulus, out = train
    marks = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(target).cast("int").alias("label"))
        .where((crc_mod(F.col("doc_id"), modulus) != out) & F.col("label").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("high"))
        .where("label = high")
        .select("doc_id", "label", F.xxhash64(F.col("doc_id").cast("string")).alias("rank"))
    )
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    kept = [marks.where(F.col("label") == k).orderBy("rank", "doc_id").limit(max_per_class) for k in (0, 1)]
    texts_ = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # two times max_per_class ids at most; an id may have many rows
    rows = texts_.join(F.broadcast(kept[0].union(kept[1])), "doc_id").select("rank", "label", "text", F.xxhash64("text").alias("th"))
    sample = rows.where("label = 0").orderBy("rank", "th").limit(max_per_class).union(rows.where("label = 1").orderBy("rank", "th").limit(max_per_class))
    return sample.select("rank", "label", "text"), {k: counts.get(k, 0) for k in (0, 1)}


def _train(bits: int):
    def run(batches):
        held, seen = [], [0, 0]
        for batch in batches:
            for text, label in zip(texts(batch), batch.column("label").to_pylist(), strict=True):
                held.append((np.unique(slots(text, bits)).astype(np.int32), label))
                seen[label] += 1
        if not min(seen):
            return
        model = FTRL(1 << bits)
        for _ in range(max(MIN_PASSES, min(MAX_PASSES, round(EXAMPLES / len(held))))):
            for at, label in held:
                model.learn(at, label)
        at, w = model.sparse()
        at, w = np.append(at, -1), np.append(w, math.log(seen[1] / seen[0]))
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(w)], names=["slot", "weight"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, target: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        train: tuple[int, int] = (3, 1), max_per_class: int = MAX_PER_CLASS, bits: int = SLOTS_BITS) -> dict:
    """Sparse weights learned from rows whose crc32(id) modulo train[0] is not train[1]."""
    sample, counts = labelled_sample(docs, labels, target=target, id_col=id_col, text_col=text_col, train=train, max_per_class=max_per_class)
    ordered = sample.repartition(1).sortWithinPartitions("rank", "label", "text").select("label", "text")
    found = ordered.mapInArrow(_train(bits), "slot bigint, weight double").toArrow()
    model = dict(zip(found["slot"].to_pylist(), found["weight"].to_pylist(), strict=True))
    odds = model.pop(-1, 0.0)
    intercept = model.pop(1 << bits, 0.0)
    if counts[0] and counts[1]:
        intercept += math.log(counts[1] / counts[0]) - odds
    return {"bits": bits, "intercept": intercept, "slots": np.array(list(model), np.int64), "weights": np.array(list(model.values()))}


def _score(shared, threshold: float):
    def run(batches):
        m = shared.value
        weights = np.zeros(1 << m["bits"])
        weights[m["slots"]] = m["weights"]
        used = weights != 0
        for batch in batches:
            score = np.empty(batch.num_rows)
            for k, text in enumerate(texts(batch)):
                at = slots(text, m["bits"])
                w = weights[np.unique(at[used[at]])].sum() + m["intercept"]
                score[k] = 1 / (1 + math.exp(-max(-35.0, min(35.0, w))))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"]
            )

    return run


def score(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted for every whole text."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return df.mapInArrow(_score(shared, threshold), f"doc_id {dict(df.dtypes)['doc_id']}, score double, predicted int")


def with_held_out(scored: DataFrame, modulus: int, rest: int) -> DataFrame:
    """The column held_out after doc_id; a null id counts as not held out."""
    held = F.coalesce(crc_mod(F.col("doc_id"), modulus) == rest, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), *[c for c in scored.columns if c != "doc_id"])


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return with_held_out(score(docs, fit(docs, read(spark, sf_dir, "labels"))), 3, 1)
