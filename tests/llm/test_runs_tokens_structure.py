"""Periodic runs, token counts and structure repair against plain versions."""

import hashlib
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidewire.llm import brown, common, line_dedup, near_copies, periodic, structure, token_counts
from tidewire.llm.queries import QUERIES

SPACE = r"[\x20\x09-\x0D]"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def crc(text: str) -> int:
    return zlib.crc32(text.encode())


def parities(n, a, b):
    """Thue and Morse's order of a and b, and its complement: a polynomial modulo a power of two cannot tell them apart."""
    order = [k.bit_count() & 1 for k in range(n)]
    return [(a, b)[x] for x in order], [(b, a)[x] for x in order]


@pytest.mark.parametrize("n", [8, 64, 512, 1024, 4096])
def test_hashes_of_words_and_lines_without_a_pattern(spark, n):
    words = ["".join(x) for x in parities(n, "a", "b")]
    lines = [" ".join(x) for x in parities(n, "ux", "vy")]
    h = common.hashed_words(" ".join(words).encode())[0]
    assert h[0] != h[1]
    docs = spark.createDataFrame([(1, lines[0]), (2, lines[1]), (3, lines[0])], "doc_id bigint, text string")
    gone = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(docs, min_line_words=5, min_run_words=10 * n).collect()}
    assert gone == {1: 0, 2: 0, 3: 1}
    table = spark.createDataFrame([(k, w, "en", "s", n) for k, w in enumerate(words)], "doc_id bigint, text string, lang string, source string, n_chars int")
    assert near_copies.without_near_copies(table).count() == 2
    rows = [(k, words[0]) for k in range(3)] + [(k, words[1]) for k in range(3, 9)]
    corpus = spark.createDataFrame(rows, "doc_id bigint, text string")
    learned = [t for k, t in rows if crc(str(k)) % 7 != 2]
    total, kinds = 2 * len(learned), 1 + len(set(learned))
    more = spark.createDataFrame([(100, f"{words[0]} {words[1]}c")], corpus.schema)
    for r in brown.score(corpus.union(more), brown.fit(corpus)).collect():
        own = [words[0], words[1] + "c"] if r["doc_id"] == 100 else [dict(rows)[r["doc_id"]]]
        counts = [*(learned.count(w) for w in own), len(learned)]
        assert (r["n_known"], r["train_tokens"]) == (sum(c > 0 for c in counts), total)
        assert abs(r["base_score"] - sum(np.log10((c + 1) / (total + kinds + 1)) for c in counts)) < 1e-9


# ---- 11


def brute_runs(words, min_words=6, min_periods=4):
    n, out = len(words), {}
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_words, min_periods * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def brute_op11(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = crc(str(doc_id)) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    gone = {k for s, e, q in runs for k in range(s + q, e)}
    best = min(((s - e, s, q) for s, e, q in runs), default=None)
    digests = sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone))
    return (doc_id, len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4), *digests)


def test_runs_of_random_sequences():
    rnd = random.Random(3)
    for _ in range(400):
        docs = []
        for _ in range(rnd.randint(1, 4)):
            k = rnd.randint(1, 4)
            w = [rnd.randrange(k) for _ in range(rnd.randint(0, 40))]
            if w and rnd.random() < 0.6:
                u = w[: rnd.randint(1, 6)]
                w += u * rnd.randint(1, 9) + u[: rnd.randint(0, len(u))] + [rnd.randrange(k) for _ in range(rnd.randint(0, 8))]
            docs.append(w)
        codes = np.array([x for d in docs for x in d], np.int64)
        text = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        bounds = rnd.choice([(6, 4), (2, 2), (5, 3)])
        found = list(zip(*(x.tolist() for x in periodic.runs_of(codes, text, *bounds)), strict=True))
        at = 0
        for d in docs:
            assert [(s - at, e - at, q) for s, e, q in found if at <= s < at + len(d)] == brute_runs(d, *bounds)
            at += len(d)


def test_runs_of_regular_words():
    """Single letters, a square-free word and Fibonacci's, none of which takes long."""
    a, b = "0", "01"
    while len(b) < 30_000:
        a, b = b, b + a
    cubes = [int(x) for x in b[:30_000]]
    assert [x.tolist() for x in periodic.runs_of(np.zeros(30_000, np.int64), np.zeros(30_000, np.int64))] == [[0], [30_000], [1]]
    assert len(periodic.runs_of(np.array(cubes), np.zeros(30_000, np.int64))[0]) == 0
    assert len(periodic.runs_of(np.array(cubes), np.zeros(30_000, np.int64), 6, 3)[0]) > 1000


def test_runs_of_documents(spark, sf):
    odd = [(900, None), (901, ""), (902, " \t\x0b\n"), (903, "a " * 5000), (904, "x\x0by x\ty x y x y"), (905, "é é é é é é"), (None, "u v " * 9), (None, None), (903, "a " * 5000), (906, "a b c a b c a b c a b c d " * 3)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id bigint, text string"))
    found = periodic.digests(periodic.find_runs(periodic.repeating(docs)))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted((brute_op11(*r) for r in docs.collect()), key=repr)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert QUERIES["op11_periodic_runs"](spark, sf).count() == docs.count() - len(odd)
    assert periodic.find_runs(docs.limit(0)).count() == 0
    clash = spark.createDataFrame([Row(doc_id=1, text="a a a a a a", runs=7, collapsed="x", n_words=3)])
    assert periodic.find_runs(clash).collect()[0]["collapsed"] == "a"


# ---- 12


def whole(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    if not hasattr(whole, "model"):
        whole.model = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    return len(whole.model.encode(text, add_special_tokens=False).ids)


def test_token_counts_of_pieces():
    """Texts of characters that the pre-tokenizer treats in different ways; pieces never change a count."""
    import public_tokenizers

    count = token_counts.counter(str(public_tokenizers.path("byte_bpe_50k.json")), 64)
    rnd = random.Random(5)
    pool = ["a", "b1", "'s", "'ll", " ", "  ", "\n", "\t", " ", "　", "é", "你", "5", "<|endoftext|>", "!", "word", "\r", "٣", "́", "\u0085", " ", "ß", "한", "😀"]
    for _ in range(600):
        texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40))) for _ in range(5)]
        assert count([x.encode() for x in texts]).tolist() == [whole(x) for x in texts]


def test_tokenizers_that_must_not_cut():
    plain = {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "normalizer": None, "added_tokens": []}
    assert token_counts.may_be_cut(plain)
    assert not token_counts.may_be_cut(plain | {"normalizer": {"type": "Lowercase"}})
    assert not token_counts.may_be_cut(plain | {"added_tokens": [{"content": "<a b>"}]})
    assert not token_counts.may_be_cut(plain | {"added_tokens": [{"content": "<a>", "lstrip": True}]})
    assert not token_counts.may_be_cut({"pre_tokenizer": {"type": "Whitespace"}})


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_of_other_files(spark, sf, name):
    import public_tokenizers

    path = str(public_tokenizers.path(name))
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, tokenizer=name).collect()}
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        expected = {r["doc_id"]: len(model.encode(r["text"], add_special_tokens=False).ids) for r in docs.collect()}
    else:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        expected = {r["doc_id"]: len(model.encode(r["text"])) for r in docs.collect()}
    assert got == expected


def test_token_counts_of_documents(spark, sf):
    odd = [(900, None), (901, ""), (902, "x" * 300_000), (903, "word " * 60_000), (None, "a b"), (None, "a b"), (904, "<|endoftext|>")]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id bigint, text string"))
    got = token_counts.token_counts(docs.withColumn("n_tokens", F.lit("other")), batch_bytes=100_000)
    expected = [(r["doc_id"], len((r["text"] or "").encode()), n := whole(r["text"] or ""), n > 1024) for r in docs.collect()]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(expected, key=repr)
    assert QUERIES["op12_token_counts"](spark, sf).count() == docs.count() - len(odd)
    assert token_counts.token_counts(docs.limit(0)).count() == 0


# ---- 13

WAYS = [("K", 0), ("R", 2)]


def brute_repair(rows):
    """(cost, audit, repaired turns) by trying everything, the rest of the conversation first; rows have role, text and fault."""

    @cache
    def best(k, last):
        out = []
        behind = {"": [""], "s": ["ua"], "u": ["a"], "a": [""]}[last]
        if k == len(rows):
            return min((2 * len(x), "I" * len(x), tuple((n, "") for n in x)) for x in behind)
        role, text, fault = rows[k]
        cost, audit, rest = best(k + 1, last)
        out.append((cost + 3, "D" + audit, rest))
        if fault not in ("blank", "duplicate"):
            for letter, price in WAYS:
                for target in [role[:1]] if letter == "K" else ["u", "a"]:
                    for inserted in ("", "u", "a", "ua", "au"):
                        string = last + inserted + target
                        if re.fullmatch(r"s|(s?(ua)*u?)", ("" if last in ("", "s") else "ua"[: "ua".index(last)]) + string) and (target != "s" or string == "s") and target:
                            cost, audit, rest = best(k + 1, target)
                            price_all = price + 2 * len(inserted) + (fault == "truncated")
                            kept = (role if letter == "K" else {"u": "user", "a": "assistant"}[target], text)
                            out.append((cost + price_all, "I" * len(inserted) + letter + audit, (*((n, "") for n in inserted), kept, *rest)))
        return min(out)

    cost, audit, turns = best(0, "")
    names = {"u": "user", "a": "assistant"}
    return cost, audit, "\n".join(f"{names.get(r, r)}:{t}" for r, t in turns)


def brute_op13(rows, damage=True):
    convs: dict = {}
    for conv, turn, role, text in rows:
        held = convs.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        code = crc(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}") % 20 if damage else 9
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        held += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = []
    for conv, held in convs.items():
        tie = lambda r: hashlib.sha256(same_text(conv, r).encode()).digest()  # noqa: E731, B023
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), tie(r)))
        seen, marked = set(), []
        for _, role, text in held:
            body = re.sub(SPACE + r"+\Z", "", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for t, _, _ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = [sum(f == x for _, _, f in marked) for x in ("blank", "duplicate", "truncated")]
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        cost, audit, repaired = brute_repair(tuple(marked))
        out.append((conv, gaps, *counts, illegal, cost, audit, sha(repaired)))
    return sorted(out, key=repr)


def same_text(conv, r):
    named = "0" if conv is None else f"1{conv}"
    return f"{len(named)}:{named}{len(r[1].encode())}:{r[1]}{r[2]}"


def reports(df):
    return sorted((tuple(r) for r in df.select(structure.REPORT).collect()), key=repr)


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def random_turns(seed, n):
    rnd = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", None, "tool", "", "User"]
    texts = ["Yes.", "No", "Why?", " ", "", None, "é!\n", "a. b", "Stop!\x0b ", "x."]
    out = []
    for conv in range(n):
        conv = None if conv == 7 else conv
        for turn in range(rnd.randint(1, 7)):
            out.append((conv, None if rnd.random() < 0.05 else turn + rnd.choice([0, 0, 0, 1, 4]), rnd.choice(roles), rnd.choice(texts)))
    return out


def test_structure_of_random_turns(spark):
    rows = random_turns(1, 300)
    turns = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert reports(structure.structure_report(turns)) == brute_op13(rows, damage=False)
    hurt = structure.structure_report(structure.damaged(turns), there_col="there")
    assert reports(hurt) == brute_op13(rows)
    assert hurt.columns[:9] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_edits_of_random_turns(spark):
    rows = random_turns(2, 60)
    edits = structure.repair_structure(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "part", "place").collect()
    for conv, *_, cost, audit, digest in brute_op13(rows, damage=False):
        own = [e for e in edits if e["conv_id"] == conv]
        assert "".join(e["edit"] for e in own) == audit and sum(e["cost"] for e in own) == cost
        assert sha("\n".join(f"{e['role']}:{e['text']}" for e in own if e["edit"] != "D")) == digest


def test_a_conversation_over_many_partitions(spark):
    """One conversation holds nearly all rows, copies of one turn stand at borders, and pieces have several parts."""
    rnd = random.Random(4)
    rows = [(1, k, rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(["Yes.", "So", f"n {k}.", f"m {k}"])) for k in range(300)]
    rows += [(1, 150, "user", "Again.")] * 120 + [(0, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    old, structure.PART = structure.PART, 16
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = spark.createDataFrame(rows, SCHEMA)
        got = reports(structure.structure_report(turns))
    finally:
        structure.PART = old
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute_op13(rows, damage=False)


@pytest.mark.parametrize("pieces", [2, 3, 7])
def test_borders_wherever_they_fall(pieces):
    """The driver's chain gives what one stretch gives, wherever a conversation is cut."""
    rnd = random.Random(pieces)
    costs = structure.Costs(structure.COSTS)
    for _ in range(300):
        turns = [(rnd.choice("suat "), rnd.choice([0, 0, 0, 1, 3])) for _ in range(rnd.randint(pieces, 14))]
        same = [rnd.choice(b"xyz") if rnd.random() < 0.4 else 100 + k for k in range(len(turns))]
        faults = [structure.DUPLICATE if k and same[k] == same[k - 1] and f != structure.BLANK else f for k, (_, f) in enumerate(turns)]
        whole_turns = [(r, f) for (r, _), f in zip(turns, faults, strict=True)]
        expected, _ = structure.way(whole_turns, costs)
        cuts = [0, *sorted(rnd.sample(range(1, len(turns)), pieces - 1)), len(turns)]
        borders = []
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            low, rank = structure.table(whole_turns[a + 1 : b], costs)
            borders.append({"part": k, "last": 0, "conv_id": 5, "dropped": False, "initial": turns[a][0], "fault": turns[a][1], "first_same": same[a], "last_same": same[b - 1], "costs": low, "ranks": rank})
        plan = structure.chain(borders, costs)
        got = []
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            entry, leave, again, _ = plan[k, 0]
            assert again == (a > 0 and same[a] == same[a - 1])
            got += structure.way(whole_turns[a:b], costs, entry, leave)[0]
        assert got == expected


def test_structure_sql_of_random_turns():
    """The SQL against trying everything, with nulls, odd roles and repeated rows."""
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in random_turns(6, 200)}.values())
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(structure.structure_sql()).fetchall(), key=repr) == brute_op13(rows)


def test_structure_of_the_table(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_structure_repair"](spark, sf)
    assert reports(got) == brute_op13(rows)
    assert {x for r in got.collect() for x in r["audit"]} == set("KRDI")
    assert structure.structure_report(turns.limit(0)).count() == 0
    clash = spark.createDataFrame([Row(conv_id=1, turn=0, role="user", text="x" * 200_000 + ".", there=False, part="p", cost=3, same="s")])
    assert structure.structure_report(clash).collect()[0]["audit"] == "KI"
