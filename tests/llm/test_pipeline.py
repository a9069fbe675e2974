"""The pipeline against plain versions of its stages, and the registered queries."""

import importlib
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewire.llm import near_copies, queries, stages

from .test_operators import brute_hits, brute_secrets, low


def table(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.limit(3)).cache()  # some rows twice
    columns = docs.columns
    kept = stages.quality_stage(spark, docs, sf)
    assert kept.columns == columns and 0 < kept.count() <= docs.count()

    clean = stages.decontamination_stage(spark, docs, sf)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert table(clean.collect()) == table(r for r in docs.collect() if not brute_hits(r["text"], items, 10)[1])

    hidden = {r["doc_id"]: r for r in stages.secret_stage(spark, docs, sf).collect()}
    for r in docs.collect():
        if brute_secrets(r["text"])[4]:
            assert "[SECRET]" in hidden[r["doc_id"]]["text"]
        assert hidden[r["doc_id"]]["n_chars"] == len(hidden[r["doc_id"]]["text"])

    mixed = stages.mixing_stage(spark, docs, sf)
    assert mixed.columns == [*columns, "n_copies"] and mixed.where("n_copies < 1").count() == 0


def brute_groups(rows):
    """Groups of row numbers whose texts are linked by a similarity of 0.8 over five-word shingles."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    groups: list[list] = []
    for k, s in enumerate(sets):
        near = [g for g in groups if any(s == sets[j] or len(s & sets[j]) >= 0.8 * len(s | sets[j]) for j in g)]
        groups = [g for g in groups if g not in near] + [[k, *sum(near, [])]]
    return groups


def pipeline_near_stage():
    return dict(corpus_pipeline.STAGES)["near_duplicates"]


@pytest.mark.parametrize(("sample", "frequent"), [(64, 3), (1, 2)])
def test_near_copies(spark, monkeypatch, sample, frequent):
    monkeypatch.setattr(near_copies, "SAMPLE", sample)
    monkeypatch.setattr(near_copies, "FREQUENT", frequent)
    rng, rows = random.Random(4), []
    for _ in range(60):
        words = [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.choice([1, 4, 6, 30, 200]))]
        words[10:10] = ["a shared line of eight words or so"] * rng.randint(0, 1)
        for _ in range(rng.randint(1, 4)):
            rows.append((len(rows), " ".join(words)))
            words = words[:]
            for _ in range(rng.randint(0, 1 + len(words) // 40)):
                words[rng.randrange(len(words))] = "other"
    rows += [(900, None), (901, " "), (902, "A\tb  c"), (903, "a b C")]
    out = pipeline_near_stage()(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(rows[min(g)][0] for g in brute_groups(rows))


@pytest.mark.parametrize("radius", [0, 12, 64])
def test_chains_of_near_copies(spark, radius):
    """Each text is linked to the next alone, so most edges of the trees are no links and the second round finds the rest."""
    rng, rows = random.Random(14), []
    fresh = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    for _ in range(3):
        words = [fresh() for _ in range(64)]
        places = rng.sample(range(4, 60), 14)
        chain = []
        for k, p in enumerate(places):
            words = [*words[:p], f"new{k}", *words[p + 1 :]]
            chain.append(" ".join(words))
        rows += chain + [chain[3], chain[3].upper(), " ".join(words[:40]) + " gone"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("k1", "K2", "number", "__n")})
    out = near_copies.without_near_copies(df, radius=radius)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(rows[min(g)][0] for g in brute_groups(rows))


def test_folds_and_parities_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 5, 100, 2000):
        x = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        y = np.union1d(x[: 4 * n // 5], rng.integers(-(2**63), 2**63 - 1, n // 4))
        real = len(np.setxor1d(x, y))
        bits = int(np.bitwise_count((near_copies.folds(x) ^ near_copies.folds(y)).view(np.uint64)).sum())
        assert 0 <= bits <= real and near_copies.differ(near_copies.parity(x), near_copies.parity(y)) <= real
        assert (bits - real) % 2 == 0 and near_copies.folds(x[:0]).tolist() == [0] * 4


def test_bitmap(spark):
    rng = random.Random(2)
    ids = [rng.randrange(-(2**63), 2**63) for _ in range(500)]
    marks = near_copies.bitmap(spark.createDataFrame([(x,) for x in ids], "d long"), 20)
    at = {x & (2**20 - 1) for x in ids}
    assert {k for k in range(2**20) if marks[k >> 3] >> (k & 7) & 1} == at


def test_rows_of_one_id_and_of_none(spark):
    """Rows are grouped by their own texts, whatever their ids, and one row of each group stays."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a, "x"), (1, b, "x"), (2, b, "x"), (2, c, "x"), (2, c, "x"), (None, c, "x"), (None, "only here", "x"), (None, "only here", "y")]
    out = pipeline_near_stage()(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out) == [(0, "only here"), (1, a), (1, b), (2, c)]


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert 0 < out.count() < spark.read.parquet(f"{sf}/documents.parquet").count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "mixing"]


def test_empty_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_clashing_columns(spark, sf):
    """Columns that are named like helpers of the stages come out as they went in."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    names = "__id __n __k1 k1 number own row c_source c_lang __tokens __source __lang __topic __draw __rate __expected __copies __base __assign __random __spans fp d s label node th unit words".split()
    odd = docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names])
    for f in [f for _, f in corpus_pipeline.STAGES]:
        out = f(spark, odd, sf)
        assert out.columns[: len(odd.columns)] == odd.columns
        for r in out.collect():
            assert all(r[n] == f"{n}:{r['doc_id']}" for n in names)


def test_null_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(5)
    docs = docs.select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
    assert stages.mixing_stage(spark, docs, sf).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_agrees(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents embeddings benchmark labels conversations").split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_queries_run(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    assert {"pipeline", *queries.QUERIES} <= set(entry.queries()) and len([q for q in entry.queries() if q.startswith("op")]) == 13
    assert os.path.exists("corpus_pipeline.py") or corpus_pipeline.__file__
