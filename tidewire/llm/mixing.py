"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' token weights are raked in turn to the
target marginals of the three until a sweep changes no weight by more than ``tolerance``; weights start at
the observed tokens, so the mix keeps what the targets leave open. A document of a cell is then taken
``budget * weight / tokens of the cell`` times in expectation: the whole part always, the rest by a hash of its
id, which makes the expected tokens of every source, language and topic those of the targets.

Everything here is DataFrame expressions. Work on documents is one aggregate with partial sums and one join;
raking works on the table of cells. Up to ``small`` cells (a proven bound) are raked as arrays of one row, in one
expression, and broadcast; more are raked by aggregates and joins, with the same result.

A default target tempers the observed share: its square root, scaled to sum to one. The topic is the first of
``TOPICS`` with one of its words in the lower-cased text, else ``prose``.

Edge cases: null and empty sources and languages are one cell, ''. A null or empty text has no tokens; cells
without tokens get weight 0 and their documents are not taken. A null id draws by its text's hash. Repeated
rows are counted and drawn alike. Targets that name unseen values are scaled to the seen ones. An empty table
gives no rows. Other columns are ignored (the sampling form passes them on).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, read, whole_row

DIMENSIONS = ("source", "lang", "topic")
#: Topics in order of precedence and the words that show them.
TOPICS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("licences", ("license", "copyright", "all rights reserved")),
    ("tables", (" | ",)),
    ("contacts", ("@", "phone", "tel:")),
)
TEMPER = 0.5
BUDGET = 0.5
TOLERANCE = 1e-10
MAX_SWEEPS = 200
SMALL = 2_000


def topic(text: Column, topics=TOPICS) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("prose")
    for name, words in reversed(topics):
        found = F.lit(False)
        for w in words:
            found = found | F.contains(low, F.lit(w))
        out = F.when(found, F.lit(name)).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from the id's (or, without an id, the text's) MD5."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("long") / F.lit(float(16**12))


def _marks(docs: DataFrame, text: Column, source_col: str, lang_col: str) -> dict[str, Column]:
    return {
        "__source": F.coalesce(F.col(source_col).cast("string"), F.lit("")),
        "__lang": F.coalesce(F.col(lang_col).cast("string"), F.lit("")),
        "__topic": topic(text),
        "__tokens": tokens(text),
    }


def _let(value: Column, body) -> Column:
    """body(value), the value computed once."""
    return F.transform(F.array(value), body)[0]


def _raked_array(cells: DataFrame, targets: dict[str, dict[str, float]] | None, temper: float, tolerance: float, max_sweeps: int) -> DataFrame:
    """``cell_weights`` of up to SMALL cells: all sweeps are one expression over one row of arrays."""
    row = cells.agg(F.sort_array(F.collect_list(F.struct(*DIMENSIONS, "cell_tokens"))).alias("c")).where(F.size("c") > 0)
    n = F.size("c") - 1
    row = row.withColumns({"place": F.sequence(F.lit(0), n), "w0": F.transform("c", lambda x: F.coalesce(x["cell_tokens"].cast("double"), F.lit(0.0)))})
    def with_groups(row: DataFrame, k: str) -> DataFrame:
        """Names of a dimension's values, each cell's value and each value's cells by number, and the target shares."""
        row = row.withColumn(f"names_{k}", F.array_distinct(F.transform("c", lambda x: x[k])))
        row = row.withColumn(f"at_{k}", F.transform("c", lambda x: F.array_position(f"names_{k}", x[k]).cast("int") - 1))
        numbers = F.sequence(F.lit(0), F.size(f"names_{k}") - 1)
        row = row.withColumn(f"of_{k}", F.transform(numbers, lambda g: F.filter("place", lambda i: F.get(f"at_{k}", i) == g)))
        if targets and k in targets:
            given = F.create_map(*[F.lit(v) for pair in targets[k].items() for v in (str(pair[0]), float(pair[1]))])
            share = F.transform(f"names_{k}", lambda x: F.coalesce(F.try_element_at(given, x), F.lit(0.0)))
        else:
            share = F.transform(f"of_{k}", lambda g: F.pow(F.aggregate(g, F.lit(0.0), lambda acc, i: acc + F.get("w0", i)), F.lit(temper)))
        row = row.withColumn(f"s_{k}", share)
        total = F.aggregate(f"s_{k}", F.lit(0.0), lambda acc, x: acc + x)
        return row.withColumn(f"t_{k}", _let(total, lambda t: F.transform(f"s_{k}", lambda x: F.when(t > 0, x / t).otherwise(F.lit(0.0)))))

    for k in DIMENSIONS:
        row = with_groups(row, k)

    def rake(w: Column, k: str) -> Column:
        def scaled(sums: Column) -> Column:
            def one(i):
                g = F.get(f"at_{k}", i)
                s = F.get(sums, g)
                return F.coalesce(F.when(s > 0, F.get(w, i) * F.get(f"t_{k}", g) / s), F.lit(0.0))

            return F.transform("place", one)

        return _let(F.transform(f"of_{k}", lambda g: F.aggregate(g, F.lit(0.0), lambda acc, i: acc + F.get(w, i))), scaled)

    def sweep(old: Column) -> Column:
        source, lang, topics = DIMENSIONS
        new = _let(rake(old, source), lambda a: _let(rake(a, lang), lambda b: rake(b, topics)))
        change = lambda w: F.array_max(F.transform("place", lambda i: F.when(F.get(old, i) > 0, F.abs(F.get(w, i) / F.get(old, i) - 1)).otherwise(F.lit(0.0))))
        return _let(new, lambda w: F.struct(w.alias("w"), F.coalesce(change(w), F.lit(0.0)).alias("change")))

    start = F.struct(F.col("w0").alias("w"), F.lit(float("inf")).alias("change"))
    kind = "struct<w:array<double>,change:double>"
    done = F.aggregate(
        F.sequence(F.lit(1), F.lit(max_sweeps)), start.cast(kind), lambda acc, _: F.when(acc["change"] <= tolerance, acc).otherwise(sweep(acc["w"]).cast(kind))
    )
    row = row.withColumn("done", done)
    return row.select(F.explode(F.transform("place", lambda i: F.struct(F.get("c", i).alias("c"), F.get("done.w", i).alias("w")))).alias("x")).select("x.c.*", "x.w")


def _raked_table(cells: DataFrame, targets: dict[str, dict[str, float]] | None, temper: float, tolerance: float, max_sweeps: int) -> DataFrame:
    """``cell_weights`` of any number of cells: each rake is an aggregate and a join."""
    spark = cells.sparkSession
    base = cells
    for k in DIMENSIONS:
        seen = base.groupBy(k).agg(F.sum("cell_tokens").alias("t"))
        if targets and k in targets:
            given = spark.createDataFrame([(str(a), float(b)) for a, b in targets[k].items()], f"{k} string, t double")
            seen = seen.select(k).join(given, k, "left").na.fill(0.0, ["t"])
        else:
            seen = seen.select(k, F.pow(F.col("t").cast("double"), F.lit(temper)).alias("t"))
        total = seen.agg(F.sum("t")).first()[0] or 1.0
        cells = cells.join(seen.select(k, (F.col("t") / F.lit(float(total))).alias(f"t_{k}")), k)
    state = durable(cells.withColumn("w", F.col("cell_tokens").cast("double")))
    for _ in range(max_sweeps):
        state = state.withColumn("old", F.col("w"))
        for k in DIMENSIONS:
            sums = state.groupBy(k).agg(F.sum("w").alias("s"))
            state = state.join(sums, k).withColumn("w", F.when(F.col("s") > 0, F.col("w") * F.col(f"t_{k}") / F.col("s")).otherwise(F.lit(0.0))).drop("s")
        state = durable(state)
        change = state.agg(F.max(F.when(F.col("old") > 0, F.abs(F.col("w") / F.col("old") - 1)).otherwise(F.lit(0.0)))).first()[0]
        state = state.drop("old")
        if not change or change <= tolerance:
            break
    return state.select(*DIMENSIONS, "cell_tokens", "w")


def cell_weights(
    marked: DataFrame, *, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, tolerance: float = TOLERANCE,
    max_sweeps: int = MAX_SWEEPS, small: int = SMALL,
) -> tuple[DataFrame, bool]:
    """(source, lang, topic, cell_tokens, w) with w summing to 1, and whether the cells are few."""
    names = dict(zip(DIMENSIONS, ("__source", "__lang", "__topic"), strict=True))
    cells = durable(
        marked.groupBy(*[F.col(v).alias(k) for k, v in names.items()]).agg(F.sum("__tokens").alias("cell_tokens")).where("cell_tokens > 0")
    )
    few = cells.count() <= small
    raked = _raked_array if few else _raked_table
    return durable(raked(cells, targets, temper, tolerance, max_sweeps)), few


def _drawn(marked: DataFrame, cells: DataFrame, few: bool, budget: float, draw: Column) -> DataFrame:
    total = cells.agg(F.sum("cell_tokens")).first()[0] or 0
    # few cells are at most SMALL rows
    side = cells.select(*[F.col(k).alias(f"c_{k}") for k in DIMENSIONS], (F.col("w") * F.lit(float(budget * total)) / F.col("cell_tokens")).alias("__rate"))
    on = [F.col(f"__{k}") == F.col(f"c_{k}") for k in DIMENSIONS]
    joined = marked.join(F.broadcast(side) if few else side, on, "left")
    rate = F.coalesce("__rate", F.lit(0.0))
    whole = F.floor(rate)
    copies = (whole + (draw < rate - whole).cast("long")).cast("long")
    return joined.withColumns({"__expected": rate, "__copies": F.when(F.col("__tokens") > 0, copies).otherwise(F.lit(0)).cast("long")})


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, budget: float = BUDGET, seed: int = 0,
) -> DataFrame:
    """One row per input row: doc_id, source, lang, topic, n_tokens, expected (copies) and n_copies.

    ``budget`` is the expected number of tokens taken, as a share of all. See the module for edge cases.
    """
    text = F.col(text_col).cast("string")
    slim = durable(
        docs.select(F.col(id_col).alias("doc_id"), *[v.alias(k) for k, v in (_marks(docs, text, source_col, lang_col) | {"__draw": uniform(F.col(id_col), text, seed)}).items()])
    )
    cells, few = cell_weights(slim, targets=targets, temper=temper)
    out = _drawn(slim, cells, few, budget, F.col("__draw"))
    return out.select(
        "doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"),
        F.col("__tokens").alias("n_tokens"), F.round("__expected", 6).alias("expected"), F.col("__copies").alias("n_copies"),
    )


def sample(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, budget: float = BUDGET, seed: int = 0,
) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all columns and n_copies, how often each is taken (a column of that name is replaced)."""
    text = F.col(text_col).cast("string")
    # the columns of docs stand in one of their own, so that none is mistaken for a helper
    marks = _marks(docs, text, source_col, lang_col) | {"__draw": uniform(F.col(id_col), text, seed)}
    marked = docs.select(whole_row(docs), *[v.alias(k) for k, v in marks.items()])
    cells, few = cell_weights(marked.select("__source", "__lang", "__topic", "__tokens"), targets=targets, temper=temper)
    out = _drawn(marked, cells, few, budget, F.col("__draw"))
    return out.where("__copies > 0").select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() != "n_copies"], F.col("__copies").alias("n_copies"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def mixing_sql(sweeps: int = 60) -> str:
    """DuckDB SQL of ``mix`` with its default parameters; raking is unrolled."""
    cases = " ".join(
        f"WHEN {' OR '.join(f'''contains(lower(coalesce(text, '')), '{w}')''' for w in words)} THEN '{name}'" for name, words in TOPICS
    )
    ctes = [
        f"d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE {cases} ELSE 'prose' END AS topic, "
        r"CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens, "
        "CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) || ':0'), 1, 12)) AS BIGINT) / CAST(281474976710656 AS DOUBLE) AS draw FROM documents)",
        "c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens) AS ct FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    for k in DIMENSIONS:
        ctes.append(f"m_{k} AS MATERIALIZED (SELECT {k}, pow(CAST(sum(ct) AS DOUBLE), {TEMPER}) AS t FROM c GROUP BY {k})")
        ctes.append(f"t_{k} AS MATERIALIZED (SELECT {k}, t / (SELECT sum(t) FROM m_{k}) AS t_{k} FROM m_{k})")
    ctes.append("w0 AS MATERIALIZED (SELECT c.*, t_source, t_lang, t_topic, CAST(ct AS DOUBLE) AS w FROM c JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    n = 0
    for _ in range(sweeps):
        for k in DIMENSIONS:
            ctes.append(f"w{n + 1} AS MATERIALIZED (SELECT * REPLACE (w * t_{k} / sum(w) OVER (PARTITION BY {k}) AS w) FROM w{n})")
            n += 1
    return (
        "WITH " + ",\n".join(ctes) + f", r AS (SELECT source, lang, topic, w * {BUDGET} * (SELECT sum(ct) FROM c) / ct AS rate FROM w{n}) "
        "SELECT doc_id, source, lang, topic, n_tokens, round(coalesce(rate, 0), 6) AS expected, "
        "CAST(CASE WHEN n_tokens > 0 THEN floor(rate) + CAST(draw < rate - floor(rate) AS BIGINT) ELSE 0 END AS BIGINT) AS n_copies "
        "FROM d LEFT JOIN r USING (source, lang, topic)"
    )
