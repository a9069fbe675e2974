"""Quality classifier by compression with zstandard dictionaries.

One dictionary is built from texts labelled good, one from texts labelled bad. A text is cut into pieces of
``piece`` bytes (all of it), each is compressed with either dictionary, and the sizes are added up. The
difference of the two sums, normalised by their sum and by the text's length, is turned into a probability by a logistic
curve fitted on other labelled texts (Platt scaling). Nothing but that difference enters the score.

Fitting uses a bounded sample of the labelled rows: up to ``max_per_class`` rows of each label, those whose id (then
text) has the smallest hash, whole texts. Half of them feed the dictionaries (of their pieces the
``max_pieces`` of smallest hash for each label), half the curve. They stream through one task in a fixed
order; the result is two dictionaries of ``dictionary_bytes`` and three numbers.

Edge cases: a null or empty text has features of 0 and is scored as such. A document whose training
labels disagree, or are null, is not learned from. With too few labels of one kind every score is 0.5.
Repeated rows are scored as often as they occur; a null id is scored and counts as not held out. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filter_by_text, read, texts
from .toxicity import labelled_sample, with_held_out

PIECE = 256
DICTIONARY_BYTES = 65536
MAX_PER_CLASS = 3000
MAX_PIECES = 16384
LEVEL = 3


class Sizes:
    """Compressed sizes of whole texts under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes, piece: int):
        import zstandard as zs

        plain = dict(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.good = zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(good), **plain)
        self.bad = zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(bad), **plain)
        self.piece = piece

    def features(self, text: bytes) -> tuple[float, float]:
        """The difference bad - good, above 0 if the good dictionary fits better, over their sum and over the text's bytes."""
        g = b = 0
        for k in range(0, len(text), self.piece):
            x = text[k : k + self.piece]
            g += len(self.good.compress(x))
            b += len(self.bad.compress(x))
        return (b - g) / max(1, b + g), (b - g) / max(1, len(text))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients of a weighted logistic regression by Newton steps, intercept last."""
    a = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _train(counts: dict[int, int], piece: int, dictionary_bytes: int, max_pieces: int):
    def run(batches):
        import zstandard as zs

        heaps: tuple[list, list] = ([], [])
        sizes, x, y = None, [], []
        for batch in batches:
            for text, label, part in zip(texts(batch), batch.column("label").to_pylist(), batch.column("part").to_pylist(), strict=True):
                if part == 0:
                    for k in range(0, len(text), piece):
                        p = text[k : k + piece]
                        entry = (-zlib.crc32(p), p)
                        (heapq.heappush if len(heaps[label]) < max_pieces else heapq.heappushpop)(heaps[label], entry)
                    continue
                if sizes is None:
                    if min(map(len, heaps)) < 8:
                        return
                    # the trainer wants many samples for each byte it writes
                    built = []
                    for h in heaps:
                        pieces = [p for _, p in sorted(h)]
                        room = sum(map(len, pieces)) // 10
                        try:
                            built.append(zs.train_dictionary(max(1024, min(dictionary_bytes, room)), pieces).as_bytes())
                        except zs.ZstdError:
                            built.append(b"".join(pieces)[-dictionary_bytes:])
                    sizes = Sizes(*reversed(built), piece)
                x.append(sizes.features(text))
                y.append(label)
        if not x or len(set(y)) < 2:
            return
        x, y = np.array(x), np.array(y)
        mean, sd = x.mean(axis=0), x.std(axis=0)
        sd = np.where(sd > 0, sd, 1.0)
        share = np.array([counts[0] / (y == 0).sum(), counts[1] / (y == 1).sum()])
        w = logistic((x - mean) / sd, y, share[y] * len(y) / sum(counts.values()))
        yield pa.record_batch(
            [pa.array([built[1]], pa.binary()), pa.array([built[0]], pa.binary()), pa.array([(w[:-1] / sd).tolist()]), pa.array([w[-1] - float(w[:-1] @ (mean / sd))])],
            names=["good", "bad", "slopes", "intercept"],
        )

    return run


def fit(docs: DataFrame, labels: DataFrame, *, target: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        train: tuple[int, int] = (3, 1), max_per_class: int = MAX_PER_CLASS, piece: int = PIECE,
        dictionary_bytes: int = DICTIONARY_BYTES, max_pieces: int = MAX_PIECES) -> dict | None:
    """Dictionaries and curve learned from rows whose crc32(id) modulo train[0] is not train[1]; None without data."""
    sample, counts = labelled_sample(docs, labels, target=target, id_col=id_col, text_col=text_col, train=train, max_per_class=max_per_class)
    ordered = (
        sample.withColumn("part", F.pmod(F.shiftright("rank", 20), F.lit(2)))
        .repartition(1)
        .sortWithinPartitions("part", "rank", "label", "text")
        .select("label", "part", "text")
    )
    found = ordered.mapInArrow(_train(counts, piece, dictionary_bytes, max_pieces), "good binary, bad binary, slopes array<double>, intercept double").collect()
    return found[0].asDict() | {"piece": piece} if found else None


def _scorer(model: dict | None):
    """A function from texts to scores."""
    sizes = model and Sizes(bytes(model["good"]), bytes(model["bad"]), model["piece"])

    def scores(texts_: list[bytes]) -> np.ndarray:
        z = [np.dot(model["slopes"], sizes.features(x)) + model["intercept"] if model else 0.0 for x in texts_]
        return 1 / (1 + np.exp(-np.clip(np.array(z, float), -35, 35)))

    return scores


def _score(shared, threshold: float):
    def run(batches):
        scores = _scorer(shared.value)
        for batch in batches:
            score = scores(texts(batch))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())],
                names=["doc_id", "score", "predicted"],
            )

    return run


def score(docs: DataFrame, model: dict | None, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, score and predicted for every whole text."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return df.mapInArrow(_score(shared, threshold), f"doc_id {dict(df.dtypes)['doc_id']}, score double, predicted int")


def accepted(docs: DataFrame, model: dict | None, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose whole text scores ``threshold`` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predicate():
        scores = _scorer(shared.value)
        return lambda texts_: (scores(texts_) >= threshold).tolist()

    return filter_by_text(docs, text_col, predicate)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return with_held_out(score(docs, fit(docs, read(spark, sf_dir, "labels"))), 3, 1)
