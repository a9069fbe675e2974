"""Exact set-similarity joins by prefix filtering.

A theta join of all pairs is avoided: of each set only the globally rarest n - ceil(t * n) + 1 elements are
dealt out (two sets of similarity t or more share one of them), and sets meet where they share one. Titles have few different bigrams,
so even rare ones are shared by many and the pairs that meet grow with the square of the rows: they never become rows of a
shuffle. The task that holds the sets of an element compares 256-bit signatures, whose distance bounds the similarity from
above, and verifies what is left on the whole sets. An element of very many sets is dealt to several tasks, by pairs of
blocks. Rows of equal sets are one row to the join, so copies do not multiply.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import durable

#: Sets that meet in one task, about (twice as many of two blocks); words of a signature; sets that are compared at once with all of a block.
BLOCK, WORDS, CHUNK = 32_768, 4, 64
#: Stands between the elements of a set that are sent as one string.
MARK = "\0"


def signature(grams: Column) -> list[Column]:
    """``WORDS`` integers with one bit set for each element."""
    bits = F.lit(64 * WORDS)

    def word(w: int) -> Column:
        bit = lambda g: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(g), F.lit(64)).cast("int"))
        own = lambda g: F.floor(F.pmod(F.xxhash64(g), bits) / 64) == w
        return F.aggregate(grams, F.lit(0).cast("long"), lambda s, g: F.when(own(g), s.bitwiseOR(bit(g))).otherwise(s))

    return [word(w).alias(f"w{w}") for w in range(WORDS)]


def close(own: np.ndarray, own_n: np.ndarray, other: np.ndarray, other_n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of all pairs that may have a similarity of ``threshold``; signatures are (WORDS, rows), rows in order of size.

    Sets of na and nb elements with s in common differ in na + nb - 2 s, their signatures in no more bits, and s must be
    t / (1 + t) (na + nb) at least.
    """
    ratio = (1 - threshold) / (1 + threshold)
    left, right = [], []
    for k in range(0, own.shape[1], CHUNK):
        x, n = own[:, k : k + CHUNK], own_n[k : k + CHUNK]
        first, end = np.searchsorted(other_n, n[0] * threshold - 1e-6), np.searchsorted(other_n, n[-1] / threshold + 1e-6, "right")
        if first >= end:
            continue
        # a distance of 256 becomes 0 here: a pair more to verify, none lost
        apart = np.zeros((x.shape[1], end - first), np.uint8)
        for w in range(WORDS):
            apart += np.bitwise_count(x[w][:, None] ^ other[w][None, first:end])
        most = np.minimum((n[-1] + other_n[first:end]) * ratio + 1e-6, 255).astype(np.uint8)
        a, b = np.nonzero(apart <= most)
        left.append(a + k)
        right.append(b + first)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _cells(batches):
    """Tables of the rows of one cell; batches are in order of cells."""
    held, last = [], None
    for batch in batches:
        columns = [batch.column(c) for c in ("gram", "i", "j")]
        codes = [columns[0].dictionary_encode().indices.to_numpy(zero_copy_only=False), *(c.to_numpy(zero_copy_only=False) for c in columns[1:])]
        cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in codes], axis=0)) + 1
        for first, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if first == end:
                continue
            cell = tuple(c[first].as_py() for c in columns)
            if held and cell != last:
                yield pa.Table.from_batches(held)
                held = []
            held, last = [*held, batch.slice(first, end - first)], cell
    if held:
        yield pa.Table.from_batches(held)


def _verified(threshold: float, schema: pa.Schema):
    """(a, b, sim) of the alike pairs of each cell, told where the first common element of their prefixes is the cell's."""

    def run(batches):
        for cell in _cells(batches):
            if cell.num_rows < 2:
                continue
            part, n = cell["part"].to_numpy(), cell["n"].to_numpy()
            words = np.stack([cell[f"w{w}"].to_numpy() for w in range(WORDS)]).view(np.uint64)
            own, other = np.flatnonzero(part != 1), np.flatnonzero(part != 0)
            gram, ids, joined, keep = cell["gram"][0].as_py(), cell["id"], cell["grams"], cell["keep"]
            sets: dict[int, tuple[list[str], set[str]]] = {}

            def of(k):
                if k not in sets:
                    order = joined[k].as_py().split(MARK)
                    sets[k] = order[: keep[k].as_py()], set(order)
                return sets[k]

            # slices, so that what may be alike is never held for a whole cell
            for k in range(0, len(own), 16 * CHUNK):
                some = own[k : k + 16 * CHUNK]
                found = []
                for a, b in zip(*(x.tolist() for x in close(words[:, some], n[some], words[:, other], n[other], threshold)), strict=True):
                    a, b = int(some[a]), int(other[b])
                    if part[a] == 2 and b <= a:
                        continue
                    (early, x), (late, y) = of(a), of(b)
                    common = len(x & y)
                    sim = common / (len(x) + len(y) - common)
                    if sim >= threshold and next(g for g in early if g in y and g in late) == gram:
                        found.append((ids[a].as_py(), ids[b].as_py(), sim))
                if found:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)

    return run


def similar_sets(left: DataFrame, right: DataFrame | None, threshold: float) -> DataFrame:
    """Pairs (a, b, sim) of (id, grams) rows with a Jaccard similarity of ``threshold`` or more.

    With ``right`` None pairs are within ``left`` and a < b. Empty sets match nothing. Ids must be unique, and elements hold no zero character.
    """
    sides = [left.select("id", "grams", F.lit(0).alias("side"))] + ([] if right is None else [right.select("id", "grams", F.lit(1).alias("side"))])
    both = sides[0] if right is None else sides[0].unionByName(sides[1])
    each = both.select("id", "side", F.explode("grams").alias("gram"))
    frequency = each.groupBy("gram").agg(F.count("*").alias("f"))
    ranked = each.join(frequency, "gram").groupBy("id", "side").agg(F.sort_array(F.collect_list(F.struct("f", "gram"))).alias("order"))
    n = F.size("order")
    keep = n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1
    grams = F.transform("order", lambda o: o["gram"])
    # what no other set has leads to nobody
    asked = F.transform(F.filter(F.slice("order", F.lit(1), keep), lambda o: o["f"] > 1), lambda o: o["gram"])
    sets = durable(ranked.select("id", "side", n.alias("n"), keep.alias("keep"), asked.alias("asked"), F.array_join(grams, MARK).alias("grams"), *signature(grams)))
    # blocks of the elements that one task would not hold
    most = sets.select("side", F.explode("asked").alias("gram")).groupBy("side", "gram").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK)
    blocks = most.groupBy("gram").agg(*[F.coalesce(F.max(F.when(F.col("side") == s, F.ceil(F.col("c") / BLOCK).cast("int"))), F.lit(1)).alias(f"k{s}") for s in (0, 1)])
    rows = sets.withColumn("gram", F.explode("asked")).drop("asked").join(F.broadcast(blocks), "gram", "left").withColumns({k: F.coalesce(k, F.lit(1)) for k in ("k0", "k1")})
    side, c = F.col("side"), F.col("cell")
    parts = F.when(side == 0, F.col("k0")).otherwise(F.col("k1"))
    across = F.col("k0") if right is None else F.when(side == 0, F.col("k1")).otherwise(F.col("k0"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("cell", F.explode(F.sequence(F.lit(0), across - 1)))
    if right is None:
        i, j = F.least("block", c), F.greatest("block", c)
        part = F.when(F.col("block") == c, 2).when(F.col("block") < c, 0).otherwise(1)
    else:
        i, j = F.when(side == 0, F.col("block")).otherwise(c), F.when(side == 0, c).otherwise(F.col("block"))
        part = side
    dealt = rows.select("gram", i.alias("i"), j.alias("j"), part.alias("part"), "n", "keep", "id", "grams", *[f"w{w}" for w in range(WORDS)])
    dealt = dealt.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j", "part", "n")
    kind = left.schema["id"].dataType
    schema = pa.schema([("a", _arrow(kind)), ("b", _arrow(kind)), ("sim", pa.float64())])
    found = dealt.mapInArrow(_verified(threshold, schema), f"a {kind.simpleString()}, b {kind.simpleString()}, sim double")
    return found if right is not None else found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def distinct_sets(rows: DataFrame, key: Column, grams: Column) -> DataFrame:
    """One (id, grams) row for each distinct key; the id is the key itself."""
    return rows.select(key.alias("id"), grams.alias("grams")).dropDuplicates(["id"])
