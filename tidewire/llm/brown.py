"""Language-model scores from Brown's class-based bigrams.

Training counts every token of every training text. The ``vocabulary`` most frequent words that occur twice or more have
classes:

* Bigrams of the ``unit_words`` most frequent ones are counted over the whole training corpus, and exchange clustering
  moves each of them between classes while that raises the likelihood of the class bigrams.
* Every other word of the vocabulary then goes to the class that gains most from its neighbours' classes, counted over
  all its occurrences. This is done ``rounds`` times, with the classes of the round before, and class bigrams are counted anew
  after each round.

All rarer words are one class, whose unknown words have the share that words seen once have in it (Good and Turing). A
text's probability is the product of class transitions (Witten-Bell, backing off to class frequencies) and of
emissions, a word within its class. The base score treats all unknown words as one event.

Words are known by 64-bit hashes of their bytes (two of a billion words share one with a chance of one in 37), and
no step is taken word by word. What is broadcast or gathered on the driver is bounded by parameters: hash, count and class of
the vocabulary, the bigram matrix of ``unit_words`` and class bigrams. Counts of rarer words stay in a distributed table,
joined to the tokens of each text; one text's words meet again in an aggregate by row.

Edge cases: a null text counts as empty, and an empty one has one token, the end. A null id is scored and
learned from, and is not held out. Repeated rows are learned from and scored as often as they occur. With no
training rows nothing is known, N is 0 and base scores are 0. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED_BYTES, crc_mod, durable, hashed_words, mixed, read, texts

UNIT_WORDS = 1024
CLASSES = 64
VOCABULARY = 131_072
ROUNDS = 2
#: The end of a text as a token, which also stands before its first word; in place of a hash.
END = 0
#: Classes of the end and of rare words; no other word is in them.
END_CLASS, RARE_CLASS, FIXED = 0, 1, 2
#: Tokens that are worked on at once.
CHUNK = 1_000_000


class Lookup:
    """Places of 64-bit keys by open addressing; -1 for others."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.asarray(keys, np.int64)
        self.mask = (1 << max(4, (4 * len(keys)).bit_length())) - 1
        self.table = np.full(self.mask + 1, -1, np.int32)
        left, at = np.arange(len(keys)), self.keys & self.mask
        while len(left):
            free = np.flatnonzero(self.table[at] < 0)
            place, first = np.unique(at[free], return_index=True)
            self.table[place] = left[free[first]]
            left, at = (x[self.table[at] != left] for x in (left, at))
            at = (at + 1) & self.mask

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        if not len(self.keys):
            return out
        todo, at = np.arange(len(h)), h & self.mask
        while len(todo):
            found = self.table[at]
            hit = (found >= 0) & (self.keys[found] == h[todo])
            out[todo[hit]] = found[hit]
            on = (found >= 0) & ~hit
            todo, at = todo[on], (at[on] + 1) & self.mask
        return out


def tokens(text: bytes) -> np.ndarray:
    """Hashes of a text's words."""
    return hashed_words(text.translate(SPACED_BYTES))[0].view(np.int64)


def _chunks(batches):
    """(batch, first row, hashes of each of some texts) with about CHUNK tokens."""
    for batch in batches:
        held, size, first = [], 0, 0
        for k, text in enumerate(texts(batch)):
            held.append(tokens(text))
            size += len(held[-1]) + 1
            if size >= CHUNK or k == batch.num_rows - 1:
                yield batch, first, held
                held, size, first = [], 0, k + 1


def _flat(held: list[np.ndarray]) -> np.ndarray:
    """The end, then each text's words and the end."""
    end = np.array([END], np.int64)
    return np.concatenate([end, *(x for h in held for x in (h, end))])


def _count(batches):
    for _, _, held in _chunks(batches):
        h, n = np.unique(_flat(held)[1:], return_counts=True)
        yield pa.record_batch([pa.array(h), pa.array(n)], names=["h", "n"])


def _count_pairs(shared, kind: str):
    """(a, b, n): bigrams of units (words of own count, all others being one), or of classes."""

    def run(batches):
        m = shared.value
        find = Lookup(m["words"])
        # places in the vocabulary to numbers; the last is that of all other words
        number = np.append(m[kind], RARE_CLASS)
        size = int(number.max(initial=RARE_CLASS)) + 1
        total = np.zeros(size * size, np.int64)
        for _, _, held in _chunks(batches):
            flat = _flat(held)
            c = np.where(flat == END, END_CLASS, number[find(flat)])
            total += np.bincount(c[:-1] * size + c[1:], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array((at // size).astype(np.int32)), pa.array((at % size).astype(np.int32)), pa.array(total[at])], names=["a", "b", "n"])

    return run


def exchange(pairs: np.ndarray, classes: int, sweeps: int = 8, fixed: int = 1) -> np.ndarray:
    """Classes of units by exchange: the first ``fixed`` units keep classes of their own, others move to raise the class bigrams' likelihood."""
    n = len(pairs)
    classes = max(fixed + 1, min(classes, n))
    pairs = pairs.astype(float)
    order = np.argsort(-(pairs.sum(0) + pairs.sum(1)), kind="stable")
    order = order[order >= fixed]
    of = np.arange(n)
    of[order] = fixed + np.arange(len(order)) % (classes - fixed)
    hot = np.eye(classes)[of]
    right, left = pairs @ hot, pairs.T @ hot
    big = hot.T @ right

    def h(x):
        return x * np.log(np.maximum(x, 1e-300))

    diagonal = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not (pairs[w].any() or pairs[:, w].any()):
                continue
            a, own = of[w], pairs[w, w]
            r, q = right[w].copy(), left[w].copy()
            r[a] -= own
            q[a] -= own
            big[a] -= r
            big[:, a] -= q
            big[a, a] -= own
            hb = h(big)
            rows = h(big + r) - hb
            columns = h(big + q[:, None]) - hb
            rows[diagonal, diagonal] = 0
            columns[diagonal, diagonal] = 0
            both = big[diagonal, diagonal]
            nl, nr = big.sum(1), big.sum(0)
            gain = rows.sum(1) + columns.sum(0) + h(both + r + q + own) - h(both)
            gain -= h(nl + r.sum() + own) - h(nl) + h(nr + q.sum() + own) - h(nr)
            gain[:fixed] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            big[b] += r
            big[:, b] += q
            big[b, b] += own
            if b != a:
                moved += 1
                of[w] = b
                right[:, a] -= pairs[:, w]
                right[:, b] += pairs[:, w]
                left[:, a] -= pairs[w]
                left[:, b] += pairs[w]
        if moved <= n // 200:
            break
    return of


def _neighbours(shared):
    """(w, codes, counts): how often a vocabulary word that is no unit has each class to its left (code c) and right (code classes + c)."""

    def run(batches):
        m = shared.value
        find, size = Lookup(m["words"]), 2 * m["classes"]
        number = np.append(m["class"], RARE_CLASS)
        for _, _, held in _chunks(batches):
            flat = _flat(held)
            w = find(flat)
            c = np.where(flat == END, END_CLASS, number[w])
            at = np.flatnonzero(w >= m["own"])
            x = w[at].astype(np.int64) * size
            code, n = np.unique(np.concatenate((x + c[at - 1], x + size // 2 + c[at + 1])), return_counts=True)
            word = code // size
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else np.zeros(0, np.int64)
            ends = np.append(first, len(word)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in ((code % size).astype(np.int16), n.astype(np.int32))]
            yield pa.record_batch([pa.array(word[first].astype(np.int32)), *lists], names=["w", "codes", "counts"])

    return run


def _best_class(shared):
    """(w, c): the class of the greatest gain in the mutual information of neighbouring classes, to the first order."""

    def run(batches):
        gain, size = shared.value, 2 * len(shared.value[0])
        parts = []
        for batch in batches:
            lists = batch.column("codes")
            parts.append((np.repeat(batch.column("w").to_numpy(), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(), batch.column("counts").flatten().to_numpy()))
        if not parts:
            return
        w, code, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        words, place = np.unique(w, return_inverse=True)
        for k in range(0, len(words), 4096):  # a block of words at a time
            some = (place >= k) & (place < k + 4096)
            rows = min(4096, len(words) - k)
            seen = np.bincount((place[some] - k) * size + code[some], n[some], minlength=rows * size).reshape(rows, size)
            score = seen[:, : size // 2] @ gain[0] + seen[:, size // 2 :] @ gain[1]
            best = FIXED + score[:, FIXED:].argmax(axis=1)
            yield pa.record_batch([pa.array(words[k : k + rows]), pa.array(best.astype(np.int32))], names=["w", "c"])

    return run


def _information(big: np.ndarray) -> np.ndarray:
    """Pointwise mutual information of neighbouring classes, smoothed."""
    expected = np.outer(big.sum(1), big.sum(0)) / max(1.0, big.sum())
    return np.log((big + 0.5) / (expected + 0.5))


def _least_count(counts: DataFrame, wanted: int) -> int:
    """A count that at least ``wanted`` words reach, and few more, from a histogram of some hundred bins.

    Only words that reach it are sorted, so the sort does not grow with the number of partitions.
    """
    bins = counts.groupBy(F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int").alias("bin")).count().collect()
    total = 0
    for b, n in sorted(((r["bin"], r["count"]) for r in bins), reverse=True):
        total += n
        if total >= wanted:
            return math.floor(2 ** (b / 16) - 1e-9)
    return 0


def _pairs(learned: DataFrame, shared, kind: str, size: int) -> np.ndarray:
    found = learned.mapInArrow(_count_pairs(shared, kind), "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((size, size), np.int64)
    out[found["a"].to_numpy(), found["b"].to_numpy()] = found["n"].to_numpy()
    return out


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", train: tuple[int, int] = (7, 2),
        unit_words: int = UNIT_WORDS, classes: int = CLASSES, vocabulary: int = VOCABULARY, rounds: int = ROUNDS) -> dict:
    """A model learned from rows whose crc32(id) modulo train[0] is not train[1]."""
    share = docs.sparkSession.sparkContext.broadcast
    learned = docs.where(F.coalesce(crc_mod(F.col(id_col), train[0]) != train[1], F.lit(True))).select(F.col(text_col).cast("string").alias("text"))
    counts = durable(learned.mapInArrow(_count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")))
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # words seen once stand for the unknown ones and have no class of their own
    some = counts.where((F.col("h") != END) & (F.col("n") > 1))
    top = some.where(F.col("n") >= _least_count(some, vocabulary)).orderBy(F.desc("n"), "h").limit(vocabulary).toArrow()
    words, numbers = top["h"].to_numpy(), top["n"].to_numpy().astype(np.int64)
    end = counts.where(F.col("h") == END).select("n").first()
    ends = int(end["n"]) if end else 0
    own = min(max(0, unit_words - FIXED), len(words))
    unit = np.where(np.arange(len(words)) < own, np.arange(len(words)) + FIXED, RARE_CLASS)
    pairs = _pairs(learned, share({"words": words, "unit": unit}), "unit", own + FIXED)
    of = exchange(pairs, classes, fixed=FIXED)
    k = int(of.max(initial=RARE_CLASS)) + 1
    hot = np.eye(k)[of]
    big = hot.T @ pairs @ hot
    # other words stand in the class of rare words until they have one of their own
    klass = np.where(unit == RARE_CLASS, RARE_CLASS, of[unit] if len(of) else RARE_CLASS)
    for _ in range(rounds if own < len(words) and k > FIXED else 0):
        near = learned.mapInArrow(_neighbours(share({"words": words, "class": klass, "own": own, "classes": k})), "w int, codes array<smallint>, counts array<int>")
        gain = _information(big)
        best = near.repartition("w").mapInArrow(_best_class(share((gain, gain.T))), "w int, c int").toArrow()
        klass = klass.copy()
        klass[best["w"].to_numpy()] = best["c"].to_numpy()
        big = _pairs(learned, share({"words": words, "class": klass}), "class", k).astype(float)
    # the class of rare words holds the rest of the vocabulary's counts
    rare, rare_once = counts.where(F.col("h") != END).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") == 1)).first()
    rare -= int(numbers.sum())
    class_count = np.bincount(klass, numbers + 0.5, minlength=k) if len(words) else np.zeros(k)
    class_count[END_CLASS] += ends + 0.5
    class_count[RARE_CLASS] += rare + 0.5
    unknown = (rare_once + 0.5) / (rare + 1) if rare else 1.0
    share_of_rare = math.log10((rare + 0.5) / class_count[RARE_CLASS])
    out, kinds_after = big.sum(1), (big > 0).sum(1)
    keep = np.divide(out, out + kinds_after, out=np.zeros(k), where=out > 0)
    conditional = np.divide(big, out[:, None], out=np.zeros_like(big, float), where=out[:, None] > 0)
    with np.errstate(divide="ignore"):  # a class may have lost all its words
        transition = np.log10(keep[:, None] * conditional + (1 - keep)[:, None] * (class_count / class_count.sum()))
    return {
        "tokens": int(total), "vocabulary": int(kinds), "counts": counts, "words": words, "numbers": numbers, "ends": ends, "own": own, "class": klass,
        "transition": transition, "emission": np.log10((numbers + 0.5) / class_count[klass]) if len(words) else np.zeros(0),
        "known": share_of_rare + (math.log10((1 - unknown) / rare) if rare and unknown < 1 else 0.0), "unknown": share_of_rare + math.log10(unknown),
    }


def _score(shared):
    """For each row one summary, and its words that are not in the vocabulary, with their number."""

    def run(batches):
        m = shared.value
        find, all_ = Lookup(m["words"]), m["tokens"] + m["vocabulary"] + 1
        number = np.append(m["class"], RARE_CLASS)
        # values of words in the vocabulary, then of all others (0) and of the end
        emission = np.concatenate((m["emission"], [0.0, 0.0]))
        base = np.concatenate((np.log10((m["numbers"] + 1) / all_), [0.0, math.log10((m["ends"] + 1) / all_)]))
        known = np.concatenate((np.ones(len(m["words"]), np.int64), [0, int(m["ends"] > 0)]))
        names = ["rid", "doc_id", "h", "n", "tokens", "known", "base", "score"]
        for batch, first, held in _chunks(batches):
            rid, ids = batch.column("rid").to_numpy()[first : first + len(held)], batch.column("doc_id").slice(first, len(held))
            flat = _flat(held)
            w, end = find(flat), flat == END
            c = np.where(end, END_CLASS, number[w])
            at = np.where(end, len(m["words"]) + 1, np.where(w < 0, len(m["words"]), w))[1:]
            starts = np.cumsum([0] + [len(h) + 1 for h in held[:-1]])
            sums = [np.add.reduceat(v, starts) for v in (m["transition"][c[:-1], c[1:]] + emission[at], base[at], known[at])]
            # the summary's key is met by no word, and would add nothing if it were
            none = np.zeros(len(held), np.int64)
            size = np.array([len(h) + 1 for h in held], np.int64)
            yield pa.record_batch([pa.array(v) for v in (rid, ids, mixed(rid.astype(np.uint64)).view(np.int64), none, size, sums[2], sums[1], sums[0])], names=names)
            lone = np.flatnonzero((w[1:] < 0) & ~end[1:])
            if len(lone):
                row, h = np.repeat(np.arange(len(held)), size)[lone], flat[1:][lone]
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1]))))
                zero, nothing = np.zeros(len(new), np.int64), np.zeros(len(new))
                yield pa.record_batch(
                    [pa.array(rid[row[new]]), pa.nulls(len(new), ids.type), pa.array(h[new]), pa.array(np.diff(np.append(new, len(h)))), pa.array(zero), pa.array(zero), pa.array(nothing), pa.array(nothing)],
                    names=names,
                )

    return run


def score(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every whole text."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast({k: v for k, v in model.items() if k != "counts"})
    parts = rows.mapInArrow(_score(shared), f"rid bigint, doc_id {dict(rows.dtypes)['doc_id']}, h bigint, n bigint, tokens bigint, known bigint, base double, score double")
    total = float(model["tokens"] + model["vocabulary"] + 1)
    counts = model["counts"].withColumnsRenamed({"h": "counted", "n": "c"})
    met = parts.join(counts, F.col("h") == F.col("counted"), "left")
    is_known = F.col("c").isNotNull()
    rare = F.when(is_known, F.lit(float(model["known"])) + F.log10(F.col("c").cast("double"))).otherwise(F.lit(float(model["unknown"])))
    sums = met.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(is_known, F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(total))).alias("base_score"),
        F.sum(F.col("score") + F.col("n") * rare).alias("score"),
    )
    return sums.select(
        "doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_known").cast("long").alias("n_known"),
        F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score",
    )


def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False))
    return score(docs, fit(docs)).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
