"""Conversation structure repair: a dynamic program over retained subsequences of turns.

Turns are read in order: by turn (null first), then role, then the SHA-256 of role and text. A turn's first fault counts:
*blank* (no word characters), *duplicate* (role and text seen earlier in its conversation), *truncated* (its last such
character is no end of a sentence). Edits are Keep (K), Rerole to user or assistant (R), Delete (D, required for blank and
duplicate turns) and Insert of an empty user or assistant turn (I); a truncated turn that stays costs ``truncated`` more. The
roles' initials must then read ``(s?(ua)+)?``, at the least cost. Among the cheapest edits the audit, their letters in
order, is the least in ASCII. An empty role has no initial and cannot be kept.

* The program chooses which turns stay, kept or reroled. What lies between two of them is a gap, whose turns are deleted: prefix
  sums of deletions price it, so for each role of the last retained turn only the running minimum of cost less prefix sum is
  held. The pair of roles at a gap's ends says which turns are inserted; they stand behind the deleted ones, since D is less
  than I.
* Seen turn by turn, an audit is made of D, IK, IR, K and R, none of which begins another. So audits compare as their first
  different turn does, and four ranks, one for each role of the last retained turn, stand for all audits so far.

Costs and ranks of a stretch of turns, from each role before it to each role at its end, are a small table, and tables of
stretches that follow each other combine. So conversations are dealt to partitions by ranges of turns, and a conversation that
holds a large part of all rows spans many. Each partition returns the tables of its first and last conversation (two
rows a partition, whatever the data), the driver chains them, and a second pass repairs each partition by itself. Copies of one turn
may stand in several partitions: a border's first turn is judged by the driver, which knows the turn before it.

``repair_structure`` returns a row for each edit. ``structure_report`` folds the same edits in the task that makes them; only pieces
of conversations at a border travel on, in parts of ``PART`` turns, and are hashed one after the other as they come.

Edge cases: a null role or text counts as one space, so such a text is blank and such a role has to be changed. Rows
with a null conversation id form one conversation. Null turns come first and do not count for gaps. Repeated rows are turns of their
own, the later ones duplicates. Very long texts are held a partition's share at a time. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from itertools import chain as flat
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, read

COSTS = {"rerole": 2, "delete": 3, "insert": 2, "truncated": 1}
#: States: nothing retained yet, or the initial of the last retained turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Turns inserted between two retained ones, and behind the last one.
BETWEEN = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,), (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,), (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
BEHIND = ((), (USER, ASSISTANT), (ASSISTANT,), ())
#: Initials of turns in a row that are legal.
LEGAL = {"su", "ua", "au"}
#: The fault of a turn by number, and those that call for deletion.
FAULTS = (None, "blank", "duplicate", "truncated")
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
FAR = math.inf
#: Turns of a conversation at a border whose repaired texts are one row.
PART = 4096
#: Characters that are no word characters.
SPACES = " \t\n\x0b\f\r"
#: What a turn's edits are called in an audit, least first.
LETTERS = ("D", "IK", "IR", "K", "R")


class Costs:
    """What each edit of a turn costs, by the turn's role and fault."""

    def __init__(self, costs: dict[str, int]):
        self.costs = costs
        self.moves: dict[tuple[str, bool], list] = {}

    def of(self, initial: str, truncated: bool) -> list[tuple[int, int, int, int]]:
        """(state before, state after, cost beyond that of deletion, letters) of all ways to retain a turn."""
        key = (initial, truncated)
        if key not in self.moves:
            out = []
            for (p, q), between in BETWEEN.items():
                extra = self.costs["insert"] * len(between) + self.costs["truncated"] * truncated - self.costs["delete"]
                if STATES.get(initial) == q:
                    out.append((p, q, extra, 1 if between else 3))
                if q != SYSTEM:
                    out.append((p, q, extra + self.costs["rerole"], 2 if between else 4))
            self.moves[key] = out
        return self.moves[key]


class Gap:
    """Running minima (cost less prefix deletions) and ranks of audits by state."""

    __slots__ = ("low", "rank", "sum")

    def __init__(self, entry: int):
        self.low, self.rank, self.sum = [FAR] * 4, [0] * 4, 0
        self.low[entry] = 0

    def turn(self, initial: str, fault: int, costs: Costs) -> list[tuple[int, int]] | None:
        """Takes in a turn; returns (state before, letters) of each state, or None where all stay as they are."""
        self.sum += costs.costs["delete"]
        if fault in (BLANK, DUPLICATE):
            return None
        best = [(low, rank, 0, q) for q, (low, rank) in enumerate(zip(self.low, self.rank, strict=True))]
        for p, q, extra, letters in costs.of(initial, fault == TRUNCATED):
            if self.low[p] < FAR and (way := (self.low[p] + extra, self.rank[p], letters, p)) < best[q]:
                best[q] = way
        order = sorted((b[1], b[2], q) for q, b in enumerate(best) if b[0] < FAR)
        self.low = [b[0] for b in best]
        for place, (_, _, q) in enumerate(order):
            self.rank[q] = place
        return [(b[3], b[2]) for b in best]

    def end(self, costs: Costs) -> int:
        """The state in which the cheapest repair ends."""
        return min((low + costs.costs["insert"] * len(BEHIND[q]), rank, q) for q, (low, rank) in enumerate(zip(self.low, self.rank, strict=True)))[2]


def table(turns: list[tuple[str, int]], costs: Costs) -> tuple[list[int | None], list[int]]:
    """Costs (null: no way) and ranks from each state (row) to each state (column) of a stretch of (initial, fault)."""
    low, rank = [], []
    for p in range(4):
        gap = Gap(p)
        for initial, fault in turns:
            gap.turn(initial, fault, costs)
        low += [None if x == FAR else x + gap.sum for x in gap.low]
        rank += gap.rank
    return low, rank


def way(turns: list[tuple[str, int]], costs: Costs, entry: int = START, leave: int | None = None) -> tuple[list[tuple[int, int]], int]:
    """(state before, letters) of each turn on the cheapest way to the state ``leave``, or to the best end, and that state."""
    gap, trail = Gap(entry), []
    for initial, fault in turns:
        trail.append(gap.turn(initial, fault, costs))
    at = last = gap.end(costs) if leave is None else leave
    out = []
    for back in reversed(trail):
        before, letters = back[at] if back else (at, 0)
        out.append((before, letters))
        at = before
    return out[::-1], last


class Border:
    """A stretch at a partition's border, as the driver knows it: the first turn apart, the table of the others."""

    def __init__(self, row: dict):
        self.row = row
        self.first_duplicate = False

    def tables(self, costs: Costs):
        r = self.row
        fault = DUPLICATE if self.first_duplicate and r["fault"] != BLANK else r["fault"]
        yield from ([] if r["dropped"] else [table([(r["initial"], fault)], costs)])
        yield r["costs"], r["ranks"]


def chain(borders: list[dict], costs: Costs) -> dict[tuple[int, int], tuple[int, int | None, bool]]:
    """For each stretch of a conversation that spans partitions: the states before and behind it (none: its end) and whether its first turn repeats the one before."""
    out: dict = {}
    ordered = sorted(borders, key=lambda b: (b["part"], b["last"]))
    for _, group in groupby(ordered, key=lambda b: (b["conv_id"] is None, b["conv_id"])):
        pieces = [Border(b) for b in group]
        if len(pieces) < 2:
            continue
        same = None
        for piece in pieces:
            piece.first_duplicate = not piece.row["dropped"] and same == piece.row["first_same"]
            same = piece.row["last_same"] or same
        gap, trail = Gap(START), []
        for piece in pieces:
            back = list(range(4))
            for low, rank in piece.tables(costs):
                best = [min((gap.low[p] + low[4 * p + q], gap.rank[p], rank[4 * p + q], p) if low[4 * p + q] is not None else (FAR, 0, 0, p) for p in range(4)) for q in range(4)]
                order = sorted((b[1], b[2], q) for q, b in enumerate(best) if b[0] < FAR)
                gap.low = [b[0] for b in best]
                for place, (_, _, q) in enumerate(order):
                    gap.rank[q] = place
                back = [back[b[3]] for b in best]
            trail.append(back)
        at = gap.end(costs)
        for k in range(len(pieces) - 1, -1, -1):
            before = trail[k][at]
            r = pieces[k].row
            out[r["part"], r["last"]] = (before, at, pieces[k].first_duplicate, k == len(pieces) - 1)
            at = before
    return out


# ---- rows of a partition

COLUMNS = ["conv_id", "turn", "role", "text", "there", "fault", "same"]


class Stretch:
    """A conversation's turns in one partition, as slices of Arrow batches; ``faults`` come from the rows and what stands before them."""

    def __init__(self, conv, parts: list):
        self.conv, self.parts = conv, parts
        get = lambda c: list(flat.from_iterable(p.column(c).to_pylist() for p in parts))
        self.there, self.same = get("there"), get("same")
        self.roles, self.faults, before = get("role"), get("fault"), None
        for k, (there, same) in enumerate(zip(self.there, self.same, strict=True)):
            if there:
                if same == before and self.faults[k] != BLANK:
                    self.faults[k] = DUPLICATE
                before = same
        self.last_same = before

    def turns(self, start: int = 0) -> list[tuple[str, int]]:
        return [(r[:1], f) for r, f, there in zip(self.roles[start:], self.faults[start:], self.there[start:], strict=True) if there]


def _stretches(batches):
    """The conversations of a sorted partition."""
    held: list = []
    for batch in batches:
        ids = batch.column("conv_id")
        n = batch.num_rows
        if not n:
            continue
        values = ids.to_pylist()
        edges = [0, *(k for k in range(1, n) if values[k] != values[k - 1]), n]
        for a, b in zip(edges, edges[1:], strict=False):
            if held and held[0] != values[a]:
                yield Stretch(held[0], held[1:])
                held = []
            held = held or [values[a]]
            held.append(batch.slice(a, b - a))
    if held:
        yield Stretch(held[0], held[1:])


def _borders(costs: dict[str, int], key: pa.DataType):
    names = ["part", "last", "conv_id", "dropped", "initial", "fault", "first_same", "last_same", "costs", "ranks"]
    kinds = [pa.int32(), pa.int32(), key, pa.bool_(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def row(last: int, stretch: Stretch, known: Costs):
        # the first turn that is there is left to the driver
        first = next((k for k, there in enumerate(stretch.there) if there), None)
        low, rank = table([] if first is None else stretch.turns(first + 1), known)
        head = (True, "", 0, None) if first is None else (False, stretch.roles[first][:1], stretch.faults[first], stretch.same[first])
        return (stretch.parts[0].column("part")[0].as_py(), last, stretch.conv, *head, stretch.last_same, low, rank)

    def run(batches):
        known, first, final = Costs(costs), None, None
        for stretch in _stretches(batches):
            if first is None:
                first = row(0, stretch, known)
            else:
                final = stretch
        if first is not None:
            rows = [first] + ([row(1, final, known)] if final is not None else [])
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def _placed(batches, plan: dict):
    """(stretch, entry, exit, is the conversation's first and last piece, whether the first turn repeats the one before); a partition's last is known late."""
    pending, index = None, 0

    def judged(stretch: Stretch, border: int | None):
        part = stretch.parts[0].column("part")[0].as_py()
        entry, leave, again, ends = plan.get((part, border), (START, None, False, True)) if border is not None else (START, None, False, True)
        if again and (k := next((k for k, there in enumerate(stretch.there) if there), None)) is not None and stretch.faults[k] != BLANK:
            stretch.faults[k] = DUPLICATE
        return stretch, entry, leave, ends, border is not None and (part, border) in plan

    for stretch in _stretches(batches):
        if pending is not None:
            yield judged(pending, 0 if index == 0 else None)
            index += 1
        pending = stretch
    if pending is not None:
        yield judged(pending, 0 if index == 0 else 1)


def edits_of(stretch: Stretch, costs: Costs, entry: int, leave: int | None, ends: bool):
    """(letter, role after the edit, text, turn, source role, fault, cost) of a stretch's edits in order."""
    steps, last = way(stretch.turns(), costs, entry, leave)
    c, at = costs.costs, iter(steps)
    k = -1
    state = entry
    for part in stretch.parts:
        texts, turns = part.column("text").to_pylist(), part.column("turn").to_pylist()
        for text, turn in zip(texts, turns, strict=True):
            k += 1
            if not stretch.there[k]:
                continue
            state, letters = next(at)
            role, fault = stretch.roles[k], stretch.faults[k]
            name = LETTERS[letters]
            if name == "D":
                yield "D", None, text, turn, role, fault, c["delete"]
                continue
            target = STATES[role[:1]] if name[-1] == "K" else next(q for q in (USER, ASSISTANT) if ((state, q) in BETWEEN) and bool(BETWEEN[state, q]) == (len(name) > 1))
            for x in BETWEEN[state, target]:
                yield "I", NAMES[x], "", None, None, 0, c["insert"]
            extra = c["truncated"] * (fault == TRUNCATED)
            yield (("K", role, text, turn, role, fault, extra) if name[-1] == "K" else ("R", NAMES[target], text, turn, role, fault, c["rerole"] + extra))
    if ends:
        for x in BEHIND[last]:
            yield "I", NAMES[x], "", None, None, 0, c["insert"]


EDITS = ["conv_id", "part", "place", "edit", "role", "text", "turn", "source_role", "fault", "cost"]


def _edit_rows(costs: dict[str, int], shared, key: pa.DataType):
    kinds = [key, pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        known, out, place = Costs(costs), [], 0
        for stretch, entry, leave, ends, _ in _placed(batches, shared.value):
            part = stretch.parts[0].column("part")[0].as_py()
            for letter, role, text, turn, source, fault, cost in edits_of(stretch, known, entry, leave, ends):
                out.append((stretch.conv, part, place, letter, role, text, turn, source, FAULTS[fault], cost))
                place += 1
                if len(out) == 10_000:
                    yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=EDITS)
                    out = []
        if out:
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=EDITS)

    return run


# ---- reports

PIECE = ["conv_id", "part", "chunk", "blank", "duplicate", "truncated", "illegal", "cost", "first", "last", "least", "most", "distinct", "audit", "kept", "text", "digest"]


def _pieces(costs: dict[str, int], shared, key: pa.DataType):
    """A row for a conversation that no border cuts, with the digest of its repaired text; rows of PART turns with their texts for others."""
    kinds = [key, pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.string(), *[pa.int64()] * 3, pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        known, out, size = Costs(costs), [], 0

        def record():
            return pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=PIECE)

        for stretch, entry, leave, ends, cut in _placed(batches, shared.value):
            part = stretch.parts[0].column("part")[0].as_py()
            faults = [f for f, there in zip(stretch.faults, stretch.there, strict=True) if there]
            roles = [r[:1] for r, there in zip(stretch.roles, stretch.there, strict=True) if there]
            turns = list(flat.from_iterable(p.column("turn").to_pylist() for p in stretch.parts))
            turns = [t for t, there in zip(turns, stretch.there, strict=True) if there and t is not None]
            illegal = sum(a + b not in LEGAL for a, b in zip(roles, roles[1:], strict=False))
            head = [faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)] + [illegal]
            span = [roles[0] if roles else None, roles[-1] if roles else None, turns[0] if turns else None, turns[-1] if turns else None, len(set(turns))]
            letters, lines, cost, kept, chunk, hashed = [], [], 0, 0, 0, hashlib.sha256()
            for letter, role, text, _, _, _, price in edits_of(stretch, known, entry, leave, ends):
                letters.append(letter)
                cost += price
                if letter != "D":
                    line = f"{role}:{text}"
                    if cut:
                        lines.append(line)
                    else:
                        hashed.update((("\n" if kept else "") + line).encode())
                    kept += 1
                if cut and len(letters) == PART:
                    out.append((stretch.conv, part, chunk, *head, cost, *span, "".join(letters), len(lines), "\n".join(lines), None))
                    size += sum(map(len, lines))
                    # counts stand in the first row of a piece only
                    head, span, letters, lines, cost, chunk = [0] * 4, [None] * 4 + [0], [], [], 0, chunk + 1
            out.append((stretch.conv, part, chunk, *head, cost, *span, "".join(letters), len(lines) if cut else kept, "\n".join(lines) if cut else None, None if cut else hashed.hexdigest()))
            size += sum(map(len, lines))
            if len(out) >= 5000 or size > 1 << 22:
                yield record()
                out, size = [], 0
        if out:
            yield record()

    return run


REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


class _Total:
    """A conversation's report from its pieces in order; texts are hashed as they come."""

    def __init__(self, conv):
        self.conv, self.sums, self.audit, self.hash, self.digest, self.kept = conv, [0] * 5, [], hashlib.sha256(), None, 0
        self.last, self.least, self.most, self.distinct = None, None, None, 0

    def add(self, r: dict) -> None:
        for k, name in enumerate(("blank", "duplicate", "truncated", "illegal", "cost")):
            self.sums[k] += r[name]
        if r["first"] is not None:
            self.sums[3] += self.last is not None and self.last + r["first"] not in LEGAL
            self.last = r["last"]
        if r["least"] is not None:
            self.distinct += r["distinct"] - (self.most == r["least"])
            self.least, self.most = r["least"] if self.least is None else self.least, r["most"]
        self.audit.append(r["audit"])
        if r["digest"] is not None:
            self.digest = r["digest"]
        elif r["kept"]:
            self.hash.update((("\n" if self.kept else "") + r["text"]).encode())
        self.kept += r["kept"]

    def row(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return self.conv, gaps, *self.sums, "".join(self.audit), self.digest or self.hash.hexdigest()


def _reports(key: pa.DataType):
    kinds = [key, *[pa.int64()] * 6, pa.string(), pa.string()]

    def run(batches):
        total, out = None, []
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                for r in batch.slice(k, 64).to_pylist():
                    if total is None or total.conv != r["conv_id"]:
                        out += [total.row()] if total else []
                        total = _Total(r["conv_id"])
                    total.add(r)
            if len(out) > 1000:
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=REPORT)
                out = []
        if total:
            out.append(total.row())
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=REPORT)

    return run


# ---- tables


def _deal(turns: DataFrame, costs: dict[str, int]):
    """The turns (conv_id, turn, role, text, there) in order over partitions, with faults, and the plan for borders."""
    spark = turns.sparkSession
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(F.length(body) == 0, BLANK).when(F.col("late"), DUPLICATE).when(~F.substring(body, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    named = F.concat(F.when(F.col("conv_id").isNull(), "0").otherwise("1"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    sized = [x for c in (named, F.col("role")) for x in (F.octet_length(c).cast("string"), F.lit(":"), c)]
    same = F.unhex(F.sha2(F.concat(*sized, F.col("text")).cast("binary"), 256))
    rows = turns.withColumn("same", same)
    rank = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    # only words seen again need their first turn
    first = rows.where("there").groupBy(F.col("same").alias("seen")).agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    met = rows.join(first, F.col("same") == F.col("seen"), "left")
    late = F.coalesce(rank > F.col("first"), F.lit(False))
    order = ["conv_id", "turn", "role", "same"]
    marked = met.withColumn("late", late).select("conv_id", "turn", "role", "text", "there", F.when(F.col("there"), fault).otherwise(0).cast("int").alias("fault"), "same", F.monotonically_increasing_id().alias("any"))
    # copies of a turn are alike, so any number spreads them
    dealt = durable(marked.repartitionByRange(*order, "any").sortWithinPartitions(*order).drop("any")).withColumn("part", F.spark_partition_id())
    key = dealt.limit(0).toArrow().schema.field("conv_id").type
    name = dict(dealt.dtypes)["conv_id"]
    # two rows for each partition at most
    borders = dealt.mapInArrow(_borders(costs, key), f"part int, last int, conv_id {name}, dropped boolean, initial string, fault int, first_same binary, last_same binary, costs array<bigint>, ranks array<bigint>").collect()
    plan = chain([b.asDict() for b in borders], Costs(costs))
    return dealt, spark.sparkContext.broadcast(plan), key, name


def _plain(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    there = F.col("there") if "there" in turns.columns else F.lit(True)
    return turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), there.alias("there"))


def repair_structure(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", costs: dict[str, int] | None = None) -> DataFrame:
    """One row per edit of the cheapest repair: conv_id, part and place (its order), edit (K, R, D or I), role and text after it, turn, source_role, fault and cost."""
    costs = COSTS | (costs or {})
    dealt, shared, key, name = _deal(_plain(turns.drop("there"), id_col, turn_col, role_col, text_col), costs)
    return dealt.mapInArrow(_edit_rows(costs, shared, key), f"conv_id {name}, part int, place bigint, edit string, role string, text string, turn bigint, source_role string, fault string, cost bigint")


def structure_report(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", there_col: str | None = None, costs: dict[str, int] | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and the SHA-256 of its repaired turns.

    Rows whose ``there_col`` is false only keep their conversation in the result.
    """
    costs = COSTS | (costs or {})
    plain = _plain(turns.withColumn("there", F.col(there_col)) if there_col else turns.drop("there"), id_col, turn_col, role_col, text_col)
    dealt, shared, key, name = _deal(plain, costs)
    schema = f"conv_id {name}, part int, chunk int, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, first string, last string, least bigint, most bigint, distinct bigint, audit string, kept bigint, text string, digest string"
    pieces = dealt.mapInArrow(_pieces(costs, shared, key), schema)
    whole = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    return whole.mapInArrow(_reports(key), f"conv_id {name}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` with damage by crc32 of conv_id and turn: some rows dropped (there is false), blanked, cut, repeated or of role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    text = F.when(code == 1, F.lit("")).when(code == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    return turns.select(
        "conv_id", "turn", F.when(code == 4, F.lit("user")).otherwise(space("role")).alias("role"), text.alias("text"),
        (code != 0).alias("there"), F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_report(damaged(read(spark, sf_dir, "conversations")), there_col="there")


def structure_sql(costs: dict[str, int] | None = None) -> str:
    """DuckDB SQL of the query: crc32 byte by byte, then the program turn by turn with audits written out."""
    known = Costs(COSTS | (costs or {}))
    c = known.costs
    line = lambda q: f"chr(10) || '{NAMES[q]}:'"
    steps = []
    for initial in ("s", "u", "a", ""):
        for p, q, extra, letters in known.of(initial, False):
            name = LETTERS[letters]
            before = " || ".join(line(x) for x in BETWEEN[p, q]) or "''"
            role = "NULL" if name[-1] == "K" else f"'{NAMES[q]}'"
            steps.append(f"('{initial}', {p}, {q}, {extra + c['delete']}, '{name}', {before}, {role})")
    behind = ", ".join(f"({q}, {c['insert'] * len(x)}, '{'I' * len(x)}', {' || '.join(line(y) for y in x) or chr(39) * 2})" for q, x in enumerate(BEHIND))
    return f"""
WITH RECURSIVE crcs AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) AS r(i))
), named AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
coded AS MATERIALIZED (
  SELECT n.*, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(name) + 1), lambda k: ascii(substr(name, k, 1))::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 20 AS code FROM named AS n, crcs
), damaged AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
    unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged
), turns AS MATERIALIZED (
  SELECT conv_id, turn, role, text, k, substr(role, 1, 1) AS i, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
    WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before
  FROM placed
), steps(i, p, q, cost, letters, inserted, role) AS (VALUES {", ".join(steps)}),
way AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS k, {START} AS q, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS text FROM (SELECT DISTINCT conv_id FROM turns)
  UNION ALL
  SELECT conv_id, k, q, cost, audit, text FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) AS place FROM (
      SELECT w.conv_id, t.k, w.q, w.cost + {c["delete"]} AS cost, w.audit || 'D' AS audit, w.text
      FROM way AS w JOIN turns AS t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.k = w.k + 1
      UNION ALL
      SELECT w.conv_id, t.k, s.q, w.cost + s.cost + CASE WHEN t.fault = 'truncated' THEN {c["truncated"]} ELSE 0 END, w.audit || s.letters, w.text || s.inserted || chr(10) || coalesce(s.role, t.role) || ':' || t.text
      FROM way AS w JOIN turns AS t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.k = w.k + 1
        JOIN steps AS s ON s.i = CASE WHEN t.i IN ('s', 'u', 'a') THEN t.i ELSE '' END AND s.p = w.q WHERE t.fault NOT IN ('blank', 'duplicate'))
  ) WHERE place = 1
), behind(q, cost, letters, inserted) AS (VALUES {behind}),
best AS (
  SELECT w.conv_id, w.cost + b.cost AS cost, w.audit || b.letters AS audit, w.text || b.inserted AS text,
    row_number() OVER (PARTITION BY w.conv_id ORDER BY w.k DESC, w.cost + b.cost, w.audit || b.letters) AS place FROM way AS w JOIN behind AS b ON b.q = w.q
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(substr(b.text, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN counts AS c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best AS b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.place = 1
"""
