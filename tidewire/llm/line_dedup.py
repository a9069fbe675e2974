"""Substring dedup by hashing lines and paragraphs that the content itself cuts.

A text's words are normalised (A-Z to a-z, digits, letters and all other characters of 0x80 and above; the rest
separates) and hashed. Two kinds of units are made of them: lines of ``min_line_words`` words or more, and
paragraphs. A paragraph starts at each word whose hash (with its successor's) is the least of some ``reach`` words in a
row (winnowing), so a passage has the same cuts wherever it stands, also inside longer lines or wrapped at other
places, and no two cuts are further apart than ``reach`` words. Digests (128 bits) are grouped over the whole corpus;
the occurrence of the least rank is kept. The rank is the id (null last), a hash of the text, then the place.

A repeated line goes as a whole. Paragraphs in a row that all occurred before are a run. A run grows by the words
beside it that equal those beside the first occurrence, compared as words, and goes if it then holds
``min_run_words`` words. A passage of that length has 2 * ``reach`` words in which its cuts may differ at most, so at
least ``min_run_words`` - 2 * ``reach`` of its words are in common paragraphs: shorter runs are left out early. The first
occurrence's words are compared up to its next cut and the words that decide it: were more words equal, the next
paragraph would be equal too. So growth has no bound. Removed spans are kept as offsets (code points) into the
original text.

Units are shuffled once. Each is compared with the first of its digest in a running window over sorted rows, which
holds one row at a time. Digests that a sample of the texts shows to be frequent are salted by document, and the
first of each salt meet in a small aggregate: the sample decides how work is dealt, never the result.

Edge cases: a null text is returned as null, an empty one as empty, with no units. Rows of one id are documents of
their own if their texts differ; rows equal in id and text are one document that is stored several times, and all of
them are returned with its result. Rows without an id take part like any other. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_BYTES, durable, hashed_words, mixed, read

MIN_LINE_WORDS = 5
MIN_RUN_WORDS = 10
#: What the registered query removes: repeated lines of 20 words and repeated passages of 50.
LONG_LINE, LONG_RUN = 20, 50
#: One text in so many is read for frequent units: those found so often there, and as many of them at most.
SAMPLE, FREQUENT, MOST_FREQUENT, SALTS = 64, 16, 4096, 64

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def reach_of(min_run_words: int) -> int:
    """Words in a row among which one is a cut."""
    return max(2, 2 * min_run_words // 5)


def digests(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each sequence of h[start:end]; sequences are in order and do not overlap.

    A word's part in the sum is mixed with its place, so sequences do not collide by the order of their words.
    """
    size = ends - starts
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    words = h[np.repeat(starts, size) + place]
    out = []
    with np.errstate(over="ignore"):
        for base in BASES:
            terms = mixed(words + (place + 1).astype(np.uint64) * np.uint64(base))
            out.append(np.add.reduceat(terms, np.cumsum(size) - size).view(np.int64))
            words = mixed(words)
    return out


class Cut:
    """One text's words, their places in it, and the starts of its paragraphs (``cuts``, ending with the number of words)."""

    def __init__(self, text: bytes, reach: int):
        self.text, self.plain, self.reach = text, text.translate(WORD_BYTES), reach
        self.h, self.starts, self.ends = hashed_words(self.plain)
        n = len(self.h)
        if n < reach:
            self.cuts = np.array([0, n] if n else [0])
            return
        value = mixed(self.h + np.uint64(BASES[0] & 0xFFFF) * np.append(self.h[1:], np.uint64(0)))
        least = np.lib.stride_tricks.sliding_window_view(value, reach).argmin(axis=1) + np.arange(n - reach + 1)
        marked = np.zeros(n + 1, bool)
        marked[least] = marked[0] = marked[n] = True
        self.cuts = np.flatnonzero(marked)

    def words(self, a: int, b: int) -> list[bytes]:
        """The words from a to b."""
        return self.plain[self.starts[a] : self.ends[min(b, len(self.ends)) - 1]].split() if a < min(b, len(self.ends)) else []

    def lines(self, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and end of each line of ``min_words`` words or more."""
        breaks = np.flatnonzero(np.frombuffer(self.text, np.uint8) == 10)
        ends = np.unique(np.append(np.searchsorted(self.starts, breaks), len(self.starts)))
        starts = np.concatenate(([0], ends[:-1]))
        long = ends - starts >= min_words
        return starts[long], ends[long]

    def before(self, k: int) -> bytes:
        """The words before paragraph k, to the cut before it and the words that decide that cut."""
        a = int(self.cuts[k])
        return b" ".join(self.words(max(0, int(self.cuts[max(0, k - 1)]) - self.reach - 1), a))

    def after(self, k: int) -> bytes:
        """The words behind paragraph k, likewise."""
        b = int(self.cuts[k + 1])
        return b" ".join(self.words(b, int(self.cuts[min(len(self.cuts) - 1, k + 2)]) + self.reach + 2))


def _units(min_line_words: int, reach: int):
    """A row for each unit; paragraph k is unit 2k, line k is unit 2k + 1."""

    def run(batches):
        for batch in batches:
            held: list[tuple] = []
            rows = 0
            for k, text in enumerate(batch.column("text").cast(pa.large_binary()).to_pylist()):
                if text:
                    cut = Cut(text, reach)
                    lines = cut.lines(min_line_words)
                    for kind, (a, b) in enumerate(((cut.cuts[:-1], cut.cuts[1:]), lines)):
                        if len(a):
                            d1, d2 = digests(cut.h, a, b)
                            # lines and paragraphs of the same words are not repeats of each other
                            held.append((d1, ~d2 if kind else d2, np.full(len(a), k), 2 * np.arange(len(a)) + kind, b - a))
                            rows += len(a)
                if held and (rows >= 100_000 or k == batch.num_rows - 1):
                    d1, d2, at, unit, words = (np.concatenate(x) for x in zip(*held, strict=True))
                    keys = [batch.column(c).take(pa.array(at)) for c in ("doc_id", "th")]
                    yield pa.record_batch([pa.array(d1), pa.array(d2), *keys, pa.array(unit.astype(np.int32)), pa.array(words.astype(np.int32))], names=["d1", "d2", "doc_id", "th", "unit", "words"])
                    held, rows = [], 0

    return run


def _runs(core: int):
    """Repeated units of a document as runs: from and to a unit, and the first occurrences of either end.

    A line is a run of its own. ``gone`` has structs of unit, words and first.
    """

    def run(batches):
        for batch in batches:
            out: list[list] = []
            for gone in batch.column("gone").to_pylist():
                runs: list = []
                gone.sort(key=lambda g: g["unit"])
                for g in gone:
                    u = g["unit"]
                    if u & 1:
                        continue
                    if runs and runs[-1]["to"] == u - 2:
                        runs[-1] |= {"to": u, "right": g["first"], "words": runs[-1]["words"] + g["words"]}
                    else:
                        runs.append({"from": u, "to": u, "words": g["words"], "left": g["first"], "right": g["first"]})
                runs = [r for r in runs if r["words"] >= core]
                runs += [{"from": g["unit"], "to": g["unit"], "words": g["words"], "left": None, "right": None} for g in gone if g["unit"] & 1]
                out.append(runs)
            yield pa.record_batch([batch.column("k"), batch.column("th"), pa.array(out, run_type(batch))], names=["k", "th", "runs"])

    def run_type(batch):
        first = batch.schema.field("gone").type.value_type.field("first").type
        return pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("words", pa.int32()), ("left", first), ("right", first)]))

    return run


def _contexts(reach: int):
    """The words before (side 0) and behind (side 1) the wanted units of a document."""

    def run(batches):
        for batch in batches:
            at, unit, side, words = [], [], [], []
            for k, (text, wanted) in enumerate(zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("wanted").to_pylist(), strict=True)):
                cut = Cut(text, reach)
                for w in wanted:
                    at.append(k)
                    unit.append(w["unit"])
                    side.append(w["side"])
                    words.append((cut.after if w["side"] else cut.before)(w["unit"] // 2))
            keys = [batch.column(c).take(pa.array(at, pa.int32())) for c in ("k", "th")]
            yield pa.record_batch([*keys, pa.array(unit, pa.int32()), pa.array(side, pa.int32()), pa.array(words, pa.binary())], names=["k", "th", "unit", "side", "beside"])

    return run


def _alike(x, y) -> int:
    """How many first elements are equal."""
    n = 0
    for a, b in zip(x, y, strict=False):
        if a != b:
            break
        n += 1
    return n


def removed_spans(cut: Cut, runs: list[dict], min_line_words: int, min_run_words: int) -> list[tuple[int, int]]:
    """Word spans to remove; runs have from, to and the words beside the first occurrences (before, after)."""
    lines = cut.lines(min_line_words) if any(r["from"] & 1 for r in runs) else None
    found = []
    for r in runs:
        if r["from"] & 1:
            found.append((int(lines[0][r["from"] // 2]), int(lines[1][r["from"] // 2])))
            continue
        a, b = int(cut.cuts[r["from"] // 2]), int(cut.cuts[r["to"] // 2 + 1])
        before, after = (r["before"] or b"").split(), (r["after"] or b"").split()
        a -= _alike(reversed(before), reversed(cut.words(max(0, a - len(before)), a)))
        b += _alike(after, cut.words(b, b + len(after)))
        if b - a >= min_run_words:
            found.append((a, b))
    spans: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return spans


def _remove(min_line_words: int, min_run_words: int, reach: int):
    def run(batches):
        for batch in batches:
            offsets, left = [], []
            for text, runs in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("runs").to_pylist(), strict=True):
                at: list[int] = []
                if text and runs:
                    cut = Cut(text, reach)
                    if spans := removed_spans(cut, runs, min_line_words, min_run_words):
                        starts, ends = cut.starts, cut.ends
                        points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
                        keep, last = [], 0
                        for a, b in spans:
                            s = int(starts[a])
                            # up to the next word, or to the end of the line
                            e = int(starts[b]) if b < len(starts) else len(text)
                            newline = text.find(b"\n", int(ends[b - 1]), e)
                            e = newline + 1 if newline >= 0 else e
                            at += [int(points[s]), int(points[e])]
                            keep.append(text[last:s])
                            last = e
                        text = b"".join([*keep, text[last:]])
                offsets.append(at)
                left.append(None if text is None else text.decode())
            sizes = [sum(x[1::2]) - sum(x[::2]) for x in offsets]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([len(x) // 2 for x in offsets], pa.int64()), pa.array(sizes, pa.int64()), pa.array(offsets, pa.list_(pa.int64())), pa.array(left, pa.string())],
                names=["doc_id", "n_removed", "n_removed_chars", "removed", "text"],
            )

    return run


def _repeats(rows: DataFrame, min_line_words: int, reach: int) -> DataFrame:
    """Units that are not the first of their digest: document (k, th), unit, words and the first's (fk, fth, funit)."""
    key = dict(rows.dtypes)["doc_id"]
    schema = f"d1 bigint, d2 bigint, doc_id {key}, th bigint, unit int, words int"
    some = rows.where(F.pmod(F.xxhash64("th"), F.lit(SAMPLE)) == 0).mapInArrow(_units(min_line_words, reach), schema)
    often = some.groupBy("d1", "d2").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "d1", "d2").limit(MOST_FREQUENT).collect()
    hot = rows.sparkSession.createDataFrame([(r["d1"], r["d2"]) for r in often], "h1 bigint, h2 bigint")
    units = rows.mapInArrow(_units(min_line_words, reach), schema)
    # MOST_FREQUENT rows at most
    salted = units.join(F.broadcast(hot), (F.col("d1") == F.col("h1")) & (F.col("d2") == F.col("h2")), "left")
    salt = F.when(F.col("h1").isNotNull(), F.pmod(F.xxhash64("doc_id", "th"), F.lit(SALTS)) + 1).otherwise(F.lit(0)).cast("int")
    order = Window.partitionBy("d1", "d2", "salt").orderBy(F.col("doc_id").asc_nulls_last(), "th", "unit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.first(F.struct("doc_id", "th", "unit")).over(order)
    met = salted.withColumn("salt", salt).withColumn("first", first).select("d1", "d2", "salt", "doc_id", "th", "unit", "words", "first")
    own = (F.col("first.unit") == F.col("unit")) & (F.col("first.th") == F.col("th")) & F.col("first.doc_id").eqNullSafe(F.col("doc_id"))
    met = durable(met.where((F.col("salt") > 0) | ~own))
    rank = F.struct(F.col("first.doc_id").isNull(), "first.doc_id", "first.th", "first.unit")
    least = met.where("salt > 0").groupBy("d1", "d2").agg(F.min(rank).alias("least"))
    # MOST_FREQUENT rows at most
    both = met.join(F.broadcast(least.withColumnsRenamed({"d1": "h1", "d2": "h2"})), (F.col("d1") == F.col("h1")) & (F.col("d2") == F.col("h2")), "left")
    of = lambda c: F.when(F.col("least").isNull(), F.col(f"first.{c}")).otherwise(F.col(f"least.{c}"))
    out = both.select(F.xxhash64("doc_id").alias("k"), "th", "unit", "words", F.xxhash64(of("doc_id")).alias("fk"), of("th").alias("fth"), of("unit").alias("funit"))
    return out.where((F.col("unit") != F.col("funit")) | (F.col("th") != F.col("fth")) | (F.col("k") != F.col("fk")))


def dedup_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_line_words: int = MIN_LINE_WORDS,
    min_run_words: int = MIN_RUN_WORDS,
) -> DataFrame:
    """One row per input row: doc_id, n_removed, n_removed_chars, removed and the remaining text.

    ``removed`` holds start and end offsets (code points, end exclusive) of the ``n_removed`` spans in the original
    text. See the module for the rules and edge cases.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("doc_id").alias("k"), F.xxhash64("text").alias("th"))
    reach = reach_of(min_run_words)
    first = "struct<k:bigint,th:bigint,unit:int>"
    # sets, since rows stored several times have their units several times
    place = F.struct(F.col("fk").alias("k"), F.col("fth").alias("th"), F.col("funit").alias("unit"))
    gone = _repeats(rows, min_line_words, reach).groupBy("k", "th").agg(F.collect_set(F.struct("unit", "words", place.alias("first"))).alias("gone"))
    schema = f"k bigint, th bigint, runs array<struct<from:int,to:int,words:int,left:{first},right:{first}>>"
    runs = durable(gone.mapInArrow(_runs(min_run_words - 2 * reach), schema).where(F.size("runs") > 0))

    run = runs.select(F.col("k").alias("tk"), F.col("th").alias("tth"), F.explode("runs").alias("run")).where("run.left IS NOT NULL")
    ends = run.select("tk", "tth", F.col("run.from").alias("from"), F.posexplode(F.array("run.left", "run.right")).alias("side", "first")).select("tk", "tth", "from", "side", "first.*")
    wanted = ends.groupBy(F.col("k").alias("wk"), F.col("th").alias("wth")).agg(F.collect_set(F.struct("unit", "side")).alias("wanted"))
    # doc_id is read so that this and the last join share one exchange of the texts
    sources = rows.join(wanted, (F.col("k") == F.col("wk")) & (F.col("th") == F.col("wth"))).select("doc_id", "k", "th", "text", "wanted")
    place = ["k", "th", "unit", "side"]
    beside = sources.mapInArrow(_contexts(reach), "k bigint, th bigint, unit int, side int, beside binary").groupBy(*place).agg(F.min("beside").alias("beside"))
    grown = ends.join(beside, place).groupBy("tk", "tth").agg(F.collect_set(F.struct("from", "side", "beside")).alias("ends"))
    beside_of = lambda r, side: F.try_element_at(F.filter("ends", lambda e: (e["from"] == r["from"]) & (e["side"] == side)), F.lit(1))["beside"]
    spans = F.transform("runs", lambda r: F.struct(r["from"].alias("from"), r["to"].alias("to"), beside_of(r, 0).alias("before"), beside_of(r, 1).alias("after")))
    full = runs.withColumnsRenamed({"k": "tk", "th": "tth"}).join(grown, ["tk", "tth"], "left").select("tk", "tth", spans.alias("runs"))
    work = rows.join(full, (F.col("k") == F.col("tk")) & (F.col("th") == F.col("tth")), "left").select("doc_id", "k", "th", "text", "runs")
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_removed bigint, n_removed_chars bigint, removed array<bigint>, text string"
    return work.mapInArrow(_remove(min_line_words, min_run_words, reach), schema)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents"), min_line_words=LONG_LINE, min_run_words=LONG_RUN)
