"""Embedding near-dedup by a subspace pigeonhole join.

Two unit vectors of cosine >= t lie within a squared distance of 2 - 2t. Vectors are rotated by a fixed
random orthogonal matrix and cut into low-dimensional blocks; each block gets a share of that squared
distance in proportion to its dimensions. At least one block of a linked pair must keep within its share,
so each block is range-joined alone, on the block's own coordinates:

* The vectors of a label are one unit of work for each block, up to ``tile`` of them. More are dealt by a grid over the block's
  first coordinates: a vector has one home cell and visits every cell that its range touches. The grid takes more
  coordinates as a label grows. A cell of many rows is cut into tiles of homes and visitors, so no key lands in one task.
* Within a unit, rows meet those of adjacent cells as wide as the range, and pairs are held against the block's
  budget. Only rows that keep it with some other row go on; few do.
* These rows fetch their whole vectors. Pairs within the budget, and no others, are verified by the exact cosine in
  double precision; a pair counts in the first block whose share it keeps, hence once.

Equal vectors of one label are one class with a count and never meet as pairs. Units return counts and spanning
links, not pairs.

Edge cases: rows whose id, label or vector is null, and vectors that are empty, zero or hold null or
non-finite components, link with nothing and are returned with n_links 0 and component_id = vec_id.
Vectors of different length never link. Each row counts as a vector of its own, so repeated rows link.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, durable, local_roots, read

THRESHOLD = 0.98
BLOCKS = 8
#: Homes or visitors in a unit of work at most.
TILE = 8192
#: Coordinates of the cells within a unit.
INNER = 3
SEED = 20240607
SLACK = 1e-9


def rotation(dim: int) -> np.ndarray:
    """The fixed random orthogonal matrix for vectors of ``dim`` components."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotated(x: np.ndarray) -> np.ndarray:
    """Rotated unit rows, by element-wise steps only: a row's result does not depend on its neighbours."""
    x, q = unit_rows(x), rotation(x.shape[1])
    y = np.zeros_like(x)
    for k in range(x.shape[1]):
        y += x[:, k : k + 1] * q[k]
    return y


def block_plan(dim: int, blocks: int, threshold: float) -> list[tuple[int, int, float]]:
    """(first dimension, end, budget of squared distance) of each block."""
    cuts = np.linspace(0, dim, min(blocks, dim) + 1).astype(int).tolist()
    total = 2 - 2 * threshold
    return [(a, b, total * (b - a) / dim + SLACK) for a, b in zip(cuts, cuts[1:], strict=False)]


def near_pairs(y: np.ndarray, budget: float, block: int = 1_000_000):
    """Unordered pairs (i, j) of rows within a squared distance of ``budget``, in blocks.

    Rows are put into cells as wide as the distance over their first coordinates and meet those of adjacent cells.
    """
    n, dims = y.shape
    if n < 2:
        return
    r = math.sqrt(budget)
    g = min(INNER, dims)
    cell = np.floor(y[:, :g] / r).astype(np.int64)
    cell -= cell.min(axis=0)
    span = cell.max(axis=0) + 3
    step = np.concatenate((np.cumprod(span[::-1])[::-1][1:], [1]))
    key = (cell + 1) @ step
    order = np.argsort(key, kind="stable")
    key, z = key[order], y[order]
    place = np.arange(n)
    for offset in np.ndindex(*(3,) * g):
        shift = int((np.array(offset) - 1) @ step)
        if shift < 0:
            continue  # each pair of cells once
        low = np.searchsorted(key, key + shift) if shift else place + 1
        width = np.searchsorted(key, key + shift, "right") - low
        at = np.flatnonzero(width > 0)
        part = np.cumsum(width[at]) // block
        for k in np.unique(part):
            x = at[part == k]
            w = width[x]
            j = np.repeat(low[x] - np.concatenate(([0], np.cumsum(w)[:-1])), w) + np.arange(w.sum())
            i = np.repeat(x, w)
            d = np.zeros(len(i))
            for c in range(dims):
                e = z[i, c] - z[j, c]
                d += e * e
                if c % 2 or c == dims - 1:
                    keep = d <= budget
                    i, j, d = i[keep], j[keep], d[keep]
            if len(i):
                yield order[i], order[j]


def _mixed(h: np.ndarray, v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ v.astype(np.int64).view(np.uint64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (z ^ (z >> np.uint64(31))).view(np.int64)


BOTH, HOME, VISITOR = 0, 1, 2


def _blocks(blocks: int, threshold: float):
    """(cid, cell, block, side, dim, y) for every block of every class; y holds the block's coordinates as 32-bit floats.

    A group of a grid of no coordinates is one cell for each block, where every class is home and visitor. Other classes have one home
    cell and visit every cell that their range touches.
    """

    def run(batches):
        for batch in batches:
            dims, grids = batch.column("dim").to_numpy(), batch.column("grid").to_numpy()
            groups, cids, vectors = batch.column("grp").to_numpy(), batch.column("cid").to_numpy(), batch.column("embedding")
            for dim, grid in np.unique(np.stack((dims, grids)), axis=1).T.tolist():
                at = np.flatnonzero((dims == dim) & (grids == grid))
                y = rotated(vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim))
                for k, (a, b, budget) in enumerate(block_plan(int(dim), blocks, threshold)):
                    base = _mixed(groups[at], np.full(len(at), k))
                    part = np.ascontiguousarray(y[:, a:b], np.float32)
                    if not grid:
                        yield rows(cids[at], base, k, BOTH, part, dim)
                        continue
                    g = min(grid, b - a)
                    r = math.sqrt(budget) + SLACK
                    low, high, own = (np.floor((y[:, a : a + g] + s) / (3 * r)).astype(np.int64) for s in (-r, r, 0.0))
                    yield rows(cids[at], cell_key(base, own), k, HOME, part, dim)
                    for offset in np.ndindex(*(2,) * g):
                        use = (low + np.array(offset) <= high).all(axis=1)
                        yield rows(cids[at][use], cell_key(base[use], (low + np.array(offset))[use]), k, VISITOR, part[use], dim)

    def cell_key(base, coordinates):
        for j in range(coordinates.shape[1]):
            base = _mixed(base, coordinates[:, j])
        return base

    def rows(cid, cell, block, side, y, dim):
        size = y.shape[1] * 4
        data = pa.Array.from_buffers(pa.binary(), len(y), [None, pa.py_buffer((np.arange(len(y) + 1) * size).astype(np.int32)), pa.py_buffer(y.tobytes())])
        return pa.record_batch(
            [pa.array(cid), pa.array(cell), *(pa.array(np.full(len(cid), v, np.int32)) for v in (block, side, dim)), data],
            names=["cid", "cell", "block", "side", "dim", "y"],
        )

    return run


def _each_unit(solve):
    """Apply ``solve`` to whole units of a partition that is sorted by unit."""

    def run(batches):
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("unit").to_numpy()
            cut = int(np.searchsorted(-(keys != keys[-1]).astype(int), 0))  # rows of the last unit stay
            if cut:
                yield from each(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks())
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from each(pa.Table.from_batches(held).combine_chunks())

    def each(table):
        keys = table.column("unit").to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        for s, e in zip(starts, [*starts[1:], len(keys)], strict=True):
            part = table.slice(s, e - s)
            kind = part.column("dim").to_numpy() * 1000 + part.column("block").to_numpy()
            # units whose keys collide are told apart
            for k in np.unique(kind):
                yield from solve(part if (kind == k).all() else part.filter(pa.array(kind == k)))

    return run


def _meeting(i: np.ndarray, j: np.ndarray, cid: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ordered pairs (visitor, home) of unordered ones."""
    i, j = np.concatenate((i, j)), np.concatenate((j, i))
    keep = (cid[i] != cid[j]) & (side[i] != HOME) & (side[j] != VISITOR)
    return i[keep], j[keep]


def _candidates(blocks: int, threshold: float):
    """The rows of a unit that keep the block's budget with another class: (cid, unit, block, side)."""

    def solve(table):
        y = np.frombuffer(b"".join(table.column("y").to_pylist()), np.float32).astype(float)
        y = y.reshape(table.num_rows, -1)
        block, dim = table.column("block")[0].as_py(), table.column("dim")[0].as_py()
        budget = block_plan(dim, blocks, threshold)[block][2]
        cid, side = table.column("cid").to_numpy(), table.column("side").to_numpy()
        wanted = np.zeros(len(cid), bool)
        for i, j in near_pairs(y, budget * (1 + 1e-5) + 1e-7):  # 32-bit coordinates
            i, j = _meeting(i, j, cid, side)
            wanted[i] = wanted[j] = True
        if wanted.any():
            yield table.select(["cid", "unit", "block", "side"]).filter(pa.array(wanted)).combine_chunks().to_batches()[0]

    return _each_unit(solve)


def _verify(blocks: int, threshold: float):
    """Exact links within each unit: rows (a, b, n), n being the vectors of b's classes that a links to.

    A row with b null carries a class's count; a row with n null carries a spanning link. Only pairs within the
    block's budget are compared, and a pair counts in the first block whose budget it keeps.
    """

    def solve(table):
        dim, block = table.column("dim")[0].as_py(), table.column("block")[0].as_py()
        x = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
        cid, cnt, side, group = (table.column(c).to_numpy() for c in ("cid", "cnt", "side", "grp"))
        plan, y = block_plan(dim, blocks, threshold), rotated(x)
        u = x / np.abs(x).max(axis=1, keepdims=True)
        norm = np.sqrt((u * u).sum(axis=1))
        counts = np.zeros(len(cid), np.int64)
        names, code = np.unique(cid, return_inverse=True)
        root = np.arange(len(names))
        a, b, budget = plan[block]
        for i, j in near_pairs(y[:, a:b], budget * (1 + 1e-6)):
            i, j = _meeting(i, j, cid, side)
            for k in range(0, len(i), 65536):
                p, q = i[k : k + 65536], j[k : k + 65536]
                near = ((u[p] * u[q]).sum(axis=1) / (norm[p] * norm[q]) >= threshold) & (group[p] == group[q])
                p, q = p[near], q[near]
                first = np.full(len(p), -1)
                for m, (s, e, most) in enumerate(plan):
                    d = np.zeros(len(p))
                    for c in range(s, e):
                        f = y[p, c] - y[q, c]
                        d += f * f
                    first[(first < 0) & (d <= most)] = m
                p, q = p[first == block], q[first == block]
                np.add.at(counts, p, cnt[q])
                root = local_roots(len(names), np.concatenate((code[p], np.arange(len(names)))), np.concatenate((code[q], root)))
        some, tied = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(names)))
        none = lambda x: pa.nulls(len(x), pa.int64())
        yield pa.record_batch([pa.array(names[tied]), pa.array(names[root[tied]]), none(tied)], names=["a", "b", "n"])
        yield pa.record_batch([pa.array(cid[some]), none(some), pa.array(counts[some])], names=["a", "b", "n"])

    return _each_unit(solve)


def _dealt(light: DataFrame, tile: int) -> DataFrame:
    """Rows of cells as rows of units; a cell of many rows is cut into tiles of homes and visitors."""
    cells = light.groupBy("cell").agg(F.count_if(F.col("side") == HOME).alias("h"), F.count_if(F.col("side") == VISITOR).alias("v")).where("h > 0 AND v > 1")
    tiles, chunks = F.ceil(F.col("h") / tile), F.ceil(F.col("v") / tile)
    rows = light.join(cells, "cell").select("cid", "cell", "block", "side", "y", "dim", tiles.alias("tiles"), chunks.alias("chunks"), F.xxhash64("cid", "cell").alias("salt"))
    of_home = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda c: F.pmod("salt", "tiles") * F.col("chunks") + c)
    of_visitor = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda t: t * F.col("chunks") + F.pmod("salt", "chunks"))
    part = F.explode(F.when(F.col("side") == HOME, of_home).otherwise(of_visitor))
    return rows.withColumn("part", part).select("cid", "block", "side", "y", "dim", F.xxhash64("cell", "part").alias("unit"))


def near_duplicate_vectors(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    blocks: int = BLOCKS,
    tile: int = TILE,
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id and kept.

    Vectors of one label link at a cosine of ``threshold`` or more. n_links counts the vectors linked
    directly, component_id is the smallest id reachable by links. See the module for edge cases.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False)
    )
    zero = F.lit(0).cast(vectors.schema[vector_col].dataType.elementType)
    rows = rows.withColumn("usable", usable).withColumn("embedding", F.transform("embedding", lambda x: x + zero))  # -0.0 is 0.0
    marks = {"h1": F.xxhash64("label", "embedding"), "h2": F.xxhash64(F.lit(1), "label", "embedding")}
    classes = durable(
        rows.where("usable")
        .groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("cnt"))
        .select("embedding", "rep", "cnt", F.size("embedding").alias("dim"), F.xxhash64(F.col("label").cast("string"), F.size("embedding")).alias("grp"), *[x.alias(k) for k, x in marks.items()])
    )
    # the order of a checkpoint's rows is fixed, and so are these numbers
    classes = classes.withColumn("cid", F.monotonically_increasing_id())
    most = F.col("members") / F.lit(float(tile))
    grids = classes.groupBy("grp").agg(F.count("*").alias("members")).select("grp", F.when(most <= 1, 0).otherwise(F.least(F.lit(6), F.ceil(F.log2(most)))).cast("int").alias("grid"))
    light = classes.join(grids, "grp").select("cid", "grp", "dim", "grid", "embedding")
    schema = "cid bigint, cell bigint, block int, side int, dim int, y binary"
    # 0: groups that are one cell for each block, 1: groups with a grid
    small, large = (light.where(F.col("grid") == 0 if not k else F.col("grid") > 0).mapInArrow(_blocks(blocks, threshold), schema) for k in (0, 1))
    columns = ["cid", "block", "side", "dim", "y", "unit"]
    units = small.withColumnRenamed("cell", "unit").select(*columns).union(_dealt(large, tile).select(*columns))
    near = units.repartition("unit").sortWithinPartitions("unit", "side", "cid").mapInArrow(_candidates(blocks, threshold), "cid bigint, unit bigint, block int, side int")
    work = near.join(classes.select("cid", "cnt", "dim", "grp", "embedding"), "cid").repartition("unit").sortWithinPartitions("unit", "side", "cid")
    found = durable(work.mapInArrow(_verify(blocks, threshold), "a bigint, b bigint, n bigint"))
    direct = found.where("n IS NOT NULL").groupBy("a").agg(F.sum("n").alias("n"))
    labels = components(found.where("n IS NULL").select("a", "b"))
    linked = labels.join(classes.select("cid", "rep"), F.col("node") == F.col("cid")).select("node", "label", "rep")
    low = linked.join(linked.groupBy("label").agg(F.min("rep").alias("low")), "label").select("node", "low")
    result = (
        classes.join(direct, F.col("cid") == F.col("a"), "left")
        .join(low, F.col("cid") == F.col("node"), "left")
        .select("h1", "h2", (F.col("cnt") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.least("rep", F.coalesce("low", "rep")).alias("component_id"))
    )
    named = rows.where("usable").select("vec_id", *[x.alias(k) for k, x in marks.items()]).join(durable(result), ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return named.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


OP2_SQL = r"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), ok AS (
  SELECT * FROM v
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), n AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM ok
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM n AS a JOIN n AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
)
, reach AS (
  WITH RECURSIVE r(a, b) AS (
    SELECT vec_id, vec_id FROM ok UNION SELECT r.a, link.b FROM r JOIN link ON r.b = link.a
  ) SELECT a, min(b) AS low FROM r GROUP BY a
)
SELECT v.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, coalesce(low, v.vec_id) AS component_id, coalesce(low, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) AS c ON c.a = v.vec_id LEFT JOIN reach ON reach.a = v.vec_id
"""
