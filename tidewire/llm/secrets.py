"""Secret scans: fixed patterns, and strings that pass a battery of randomness tests.

Everything here is DataFrame expressions. Base spans come from three patterns (assignments to a secret's name,
access keys, long hex runs). The method adds strings of 20 characters or more that look random:

* the encoding is inferred (hexadecimal, base32, else base64), which fixes the alphabet of A characters;
* chi-squared of the character counts against a uniform alphabet, a runs test about the alphabet's middle and
  the lag-one serial correlation give three two-sided p-values, combined by Fisher's method; a string below
  ``min_random`` is not random;
* against the opposite error, each string has the probability that ordinary text of its length would come as
  close to uniform (a noncentral chi-squared, so long strings are judged more strictly). These p-values are
  controlled for false discoveries at ``fdr`` by Benjamini and Hochberg's rule over the whole corpus, within
  strata of encoding and length. The rule reads a histogram of at most a few hundred bins for each of twelve
  strata, so no row-level sort is needed.

Offsets are code points, ends are exclusive. Positions follow from the lengths of matches and of the text
between them.

Edge cases: a null text counts as empty and has no spans; rows are handled one by one, so repeated rows, null
ids and very long texts need no care. Without any candidate nothing is added. An empty table gives no rows.
Other columns are ignored (the redacting form passes them on).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, whole_row

#: The base patterns; fixed values.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Chance that two characters of ordinary strings in an encoding agree: digits in hexadecimal, letters of words elsewhere.
REPEAT = {"hex": 0.1, "base32": 0.065, "base64": 0.065}
MIN_RANDOM = 0.01
FDR = 0.001
BINS_PER_DECADE = 4
LAST_BIN = 120


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches, leftmost and without overlap."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    steps = F.zip_with(between, found, lambda a, b: F.struct(F.length(a).alias("gap"), b.alias("value")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    return F.aggregate(steps, zero, step)["out"]


def _kind(spans: Column, kind: str) -> Column:
    """Spans with their kind and its rank."""
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"))
    )


_NONE = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _when(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast(_NONE))


def base_spans(text: Column) -> dict[str, Column]:
    """The base spans of each kind."""
    low = F.lower(text)
    named = F.lit(False)
    for name in NAMES:
        named = named | F.contains(low, F.lit(name))
    assign = F.filter(_spans(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], "^" + ASSIGN + "$", 2)) >= 6)
    return {
        "assign": _when(named, _kind(assign, "assign")),
        "access": _when(F.contains(text, F.lit("AKIA")), _kind(_spans(text, ACCESS), "access")),
        "hex": _when(F.rlike(text, F.lit(HEX)), _kind(_spans(text, HEX), "hex")),
    }


def _two_sided(z: Column) -> Column:
    """Two-sided normal p-value by a logistic approximation of the normal curve."""
    a = F.abs(z)
    return F.greatest(2 / (1 + F.exp(F.least(1.5976 * a + 0.07056 * a * a * a, F.lit(600.0)))), F.lit(1e-250))


def _lower_tail(z: Column) -> Column:
    """Normal lower tail by the same approximation."""
    return 1 / (1 + F.exp(F.greatest(F.least(-1.5976 * z - 0.07056 * z * z * z, F.lit(575.0)), F.lit(-575.0))))


def battery(value: Column) -> Column:
    """struct<encoding, n, p_random, p_text> of a candidate string."""
    s = F.rtrim(value, F.lit("="))
    encoding = (
        F.when(F.rlike(s, F.lit("^([0-9a-f]+|[0-9A-F]+)$")), "hex").when(F.rlike(s, F.lit("^[A-Z2-7]+$")), "base32").otherwise("base64")
    )

    def pick(values: dict) -> Column:
        out = F.lit(values["base64"])
        for k in ("hex", "base32"):
            out = F.when(encoding == k, F.lit(values[k])).otherwise(out)
        return out

    size = pick({k: float(len(v)) for k, v in ALPHABETS.items()})
    alphabet, repeat = pick(ALPHABETS), pick(REPEAT)
    plain = F.translate(F.when(encoding == "hex", F.lower(s)).otherwise(s), "-_", "+/")
    head = F.struct(
        encoding.alias("encoding"), size.alias("size"), repeat.alias("repeat"), F.length(s).cast("double").alias("n"),
        F.transform(F.split(plain, ""), lambda c: F.instr(alphabet, c).cast("double") - 1).alias("codes"),
    )

    def judged(x: Column) -> Column:
        n, a, codes = x["n"], x["size"], x["codes"]
        squares = F.aggregate(F.array_distinct(codes), F.lit(0.0), lambda acc, c: acc + F.pow(F.size(F.filter(codes, lambda d: d == c)).cast("double"), F.lit(2.0)))
        chi, df = a / n * squares - n, a - 1
        z_chi = (F.cbrt(chi / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        upper = F.transform(codes, lambda c: (c >= a / 2).cast("double"))
        ones = F.aggregate(upper, F.lit(0.0), lambda acc, c: acc + c)
        pairs = F.zip_with(F.slice(upper, F.lit(1), F.size(upper) - 1), F.slice(upper, F.lit(2), F.size(upper) - 1), lambda p, q: F.abs(p - q))
        runs = 1 + F.aggregate(pairs, F.lit(0.0), lambda acc, c: acc + c)
        mean_runs = 2 * ones * (n - ones) / n + 1
        var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
        z_runs = F.when(var_runs > 0, (runs - mean_runs) / F.sqrt(var_runs)).otherwise(F.lit(10.0))
        mean = F.aggregate(codes, F.lit(0.0), lambda acc, c: acc + c) / n
        var = F.aggregate(codes, F.lit(0.0), lambda acc, c: acc + (c - mean) * (c - mean))
        lag = F.aggregate(
            F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda p, q: (p - mean) * (q - mean)),
            F.lit(0.0), lambda acc, c: acc + c,
        )
        z_serial = F.when(var > 0, (lag / var + 1 / n) * F.sqrt(n)).otherwise(F.lit(10.0))
        half = -(F.ln(_two_sided(z_chi)) + F.ln(_two_sided(z_runs)) + F.ln(_two_sided(z_serial)))
        p_random = F.exp(-half) * (1 + half + half * half / 2)
        shift = (a * x["repeat"] - 1) * (n - 1)
        p_text = _lower_tail((chi - df - shift) / F.sqrt(2 * (df + 2 * shift)))
        return F.struct(x["encoding"].alias("encoding"), n.alias("n"), p_random.alias("p_random"), p_text.alias("p_text"))

    return F.transform(F.array(head), judged)[0]


def _stratum(test: Column) -> Column:
    """Encoding and length class."""
    return F.concat_ws(":", test["encoding"], F.when(test["n"] < 32, "20").when(test["n"] < 64, "32").when(test["n"] < 128, "64").otherwise("128"))


def _bin(test: Column) -> Column:
    return F.least(F.floor(-F.log10(F.greatest(test["p_text"], F.lit(1e-300))) * BINS_PER_DECADE), F.lit(LAST_BIN)).cast("int")


def _tested(text: Column) -> Column:
    """array<struct<start, end, test>> of all candidates."""
    found = F.transform(_spans(text, CANDIDATE), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), battery(s["value"]).alias("test")))
    none = "array<struct<start:int,end:int,test:struct<encoding:string,n:double,p_random:double,p_text:double>>>"
    return F.when(F.rlike(text, F.lit(CANDIDATE)), found).otherwise(F.array().cast(none))


def thresholds(texts: DataFrame, text: Column, fdr: float, min_random: float) -> dict[str, int]:
    """For each stratum the least bin that Benjamini and Hochberg's rule accepts.

    Strings that fail the randomness tests are tested and not claimed: they count in the number of tests.
    """
    tests = texts.select(F.explode(_tested(text)).alias("c")).select(F.col("c.test").alias("test"))
    claimed = F.when(F.col("test.p_random") >= min_random, _bin(F.col("test"))).otherwise(F.lit(0))
    bins = tests.groupBy(_stratum(F.col("test")).alias("stratum"), claimed.alias("bin")).count().collect()
    out: dict[str, int] = {}
    for stratum in {r["stratum"] for r in bins}:
        own = sorted(((r["bin"], r["count"]) for r in bins if r["stratum"] == stratum), reverse=True)
        total, passed = sum(n for _, n in own), 0
        for b, n in own:
            passed += n
            if b > 0 and 10 ** (-b / BINS_PER_DECADE) <= fdr * passed / total:
                out[stratum] = b
    return out


def _random_spans(text: Column, accepted: dict[str, int], min_random: float) -> Column:
    limit = F.lit(LAST_BIN + 1)
    chosen = F.filter(
        _tested(text),
        lambda c: (c["test"]["p_random"] >= min_random) & (_bin(c["test"]) >= _limit(c["test"], accepted, limit)),
    )
    return _kind(chosen, "random")


def _limit(test: Column, accepted: dict[str, int], otherwise: Column) -> Column:
    out = otherwise
    for stratum, b in sorted(accepted.items()):
        out = F.when(_stratum(test) == stratum, F.lit(b)).otherwise(out)
    return out


def with_spans(docs: DataFrame, *, text_col: str = "text", fdr: float = FDR, min_random: float = MIN_RANDOM) -> DataFrame:
    """``docs`` with the columns __assign, __access, __hex and __random: arrays of spans.

    A random span that overlaps a base span is left out.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    accepted = thresholds(docs.select(F.col(text_col)), text, fdr, min_random)
    out = docs.withColumns({f"__{k}": v for k, v in base_spans(text).items()})
    base = F.concat("__assign", "__access", "__hex")
    found = _random_spans(text, accepted, min_random) if accepted else F.array().cast(_NONE)
    return out.withColumn("__base", base).withColumn(
        "__random", F.filter(found, lambda r: ~F.exists("__base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    )


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR, min_random: float = MIN_RANDOM) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans."""
    found = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), fdr=fdr, min_random=min_random)
    return found.select(
        "doc_id",
        *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_written(F.col("__base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.concat("__base", "__random")).alias("spans"),
    )


def redacted(docs: DataFrame, *, text_col: str = "text", fdr: float = FDR, min_random: float = MIN_RANDOM, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span in ``text_col`` replaced by ``mark``; overlapping spans share one mark."""
    # the columns of docs stand in one of their own, so that none is mistaken for a helper
    inner = docs.select(whole_row(docs), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = with_spans(inner, fdr=fdr, min_random=min_random)
    spans = F.array_sort(F.concat("__base", "__random"))
    text = F.col("text")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.when(fresh, F.lit(mark)).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), piece.alias("out"))

    def finish(acc):
        return F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))

    clean = F.when(F.size("__spans") > 0, F.aggregate("__spans", zero, step, finish)).otherwise(text)
    return found.withColumn("__spans", spans).select(*[clean.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read(spark, sf_dir, "documents"))
