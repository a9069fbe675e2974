"""Chat formatting by minimum-cost role repair.

A conversation's turns must be read by an automaton of legal turns: an optional system message, then user and
assistant in turn. Each source turn may be appended under its own role, relabelled, merged into the message
before it, or preceded by inserted empty messages; each of these has a cost, and dynamic programming finds the
cheapest repair, among equals the one of fewest messages. The repaired messages are then rendered.

The cost of a stretch of turns from one automaton state to another is a small matrix, and stretches combine by
min-plus products. Costs and numbers of messages are exact integers without a bound. So conversations are dealt to partitions by ranges of (conversation, turn): a conversation
that holds a large part of all rows spans many partitions. Each partition returns the matrices of its first and
last conversation only (two rows a partition, whatever the data), the driver chains them to find the state at
each border, and a second pass repairs every partition by itself. A merged message may span partitions too, so
the repair has one row for each source turn or inserted message, with its piece of the rendering. ``render`` joins the
pieces in order of (position, step): a conversation of up to ``part`` turns is one row, a longer one has a row for
each ``part`` turns, whose texts joined in order are its rendering. So no task holds more than a part.

Edge cases: a null or unknown role can take any role at the cost of ``unknown``. A null text renders as empty.
Turns are ordered by turn (null first), role and the MD5 of the text; repeated rows are turns of their own. Rows
with a null conversation id form one conversation. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import deque
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, read

ROLES = ("system", "user", "assistant")
START = len(ROLES)
#: The legal turns: what may follow each role, and the start.
LEGAL = {"system": ("user",), "user": ("assistant",), "assistant": ("user",), None: ("system", "user")}
FINAL = ("user", "assistant")
#: A message under another role misleads most, an empty one less, and a merge keeps every word where it was said.
COSTS = {"relabel": 3, "merge": 1, "insert": 2, "unknown": 1}
#: Turns of a conversation in one row of rendered text.
PART = 4096
#: Costs are scaled by this, so that the number of messages (a bigint) decides among equal costs. Sums are Python's
#: integers and are never clipped.
UNIT = 1 << 64
#: The cost of a state that cannot be reached; above every integer.
FAR = math.inf


class Automaton:
    """Costs of each source role's step between states; a state is the role of the last message."""

    def __init__(self, costs: dict[str, int]):
        self.costs = costs
        self.paths: dict[tuple[int, int], list[int]] = {}
        follow = {(START if k is None else ROLES.index(k)): [ROLES.index(x) for x in v] for k, v in LEGAL.items()}
        for p in range(START + 1):
            queue, seen = deque([(p, [])]), set()
            while queue:
                at, path = queue.popleft()
                for q in follow[at]:
                    if q not in seen:
                        seen.add(q)
                        self.paths[p, q] = [*path, q]
                        queue.append((q, [*path, q]))
        self.steps = {r: self._step(r) for r in (*range(START), None)}

    def relabel(self, role: int | None, to: int) -> int:
        return 0 if role == to else self.costs["unknown"] if role is None else self.costs["relabel"]

    def _step(self, role: int | None) -> list[list[tuple[float, bool]]]:
        """[state before][state after] -> (scaled cost, is a merge)."""
        out = []
        for p in range(START + 1):
            row = []
            for q in range(START):
                best = (FAR, False)
                if (path := self.paths.get((p, q))) is not None:
                    cost = self.costs["insert"] * (len(path) - 1) + self.relabel(role, q)
                    best = (cost * UNIT + len(path), False)
                if p == q:
                    best = min(best, ((self.costs["merge"] + self.relabel(role, q)) * UNIT, True))
                row.append(best)
            row.append((FAR, False))
            out.append(row)
        return out

    def advance(self, costs: list[float], role: int | None) -> list[float]:
        step = self.steps[role]
        return [min(costs[p] + step[p][q][0] for p in range(START + 1)) for q in range(START + 1)]

    def matrix(self, roles: list[int | None]) -> list[float]:
        """Costs of the whole stretch from every state (row) to every state (column)."""
        out = []
        for p in range(START + 1):
            costs = [FAR] * (START + 1)
            costs[p] = 0
            for r in roles:
                costs = self.advance(costs, r)
            out += costs
        return out

    def repair(self, roles: list[int | None], entry: int, exits: list[int]) -> list[tuple[int, bool]]:
        """(state before, is a merge) of each turn, then the last state, on the cheapest way to one of ``exits``."""
        costs = [FAR] * (START + 1)
        costs[entry] = 0
        trail = [costs]
        for r in roles:
            trail.append(costs := self.advance(costs, r))
        q = min(exits, key=lambda x: (costs[x], x))
        out: list[tuple[int, bool]] = [(q, False)]
        for r, before in zip(reversed(roles), reversed(trail[:-1]), strict=True):
            step = self.steps[r]
            p = min(range(START + 1), key=lambda x: (before[x] + step[x][q][0], x))
            out.append((p, step[p][q][1]))
            q = p
        return out[::-1]


def _role(value: str | None) -> int | None:
    name = (value or "").strip().lower()
    return ROLES.index(name) if name in ROLES else None


def _conversations(batches):
    """(conversation id, its rows) of a sorted partition, rows as dicts."""
    rows = (r for batch in batches for r in batch.to_pylist())
    for conv, group in groupby(rows, key=lambda r: r["conv_id"]):
        yield conv, list(group)


def split(matrix: list[float]) -> tuple[list[int | None], list[int | None]]:
    """A matrix as two of plain integers: costs and numbers of messages, null where there is no way."""
    return [None if x == FAR else x // UNIT for x in matrix], [None if x == FAR else x % UNIT for x in matrix]


def joined(costs: list[int | None], messages: list[int | None]) -> list[float]:
    """The matrix that ``split`` took apart."""
    return [FAR if c is None else c * UNIT + m for c, m in zip(costs, messages, strict=True)]


def _borders(costs: dict[str, int], key: pa.DataType):
    """The stretches at a partition's two borders: (part, last, conv_id, rows, matrix)."""

    def run(batches):
        auto, first, last, part = Automaton(costs), None, None, None
        for conv, rows in _conversations(batches):
            part = rows[0]["part"]
            now = (conv, [_role(r["role"]) for r in rows])
            first, last = first or now, now
        if first:
            ends = [(0, first)] + ([(1, last)] if last is not first else [])
            yield pa.record_batch(
                [pa.array([part] * len(ends), pa.int32()), pa.array([k for k, _ in ends], pa.int32()), pa.array([x[0] for _, x in ends], key),
                 pa.array([len(x[1]) for _, x in ends], pa.int64()), *(pa.array(m, pa.list_(pa.int64())) for m in zip(*(split(auto.matrix(x[1])) for _, x in ends), strict=True))],
                names=["part", "last", "conv_id", "rows", "costs", "messages"],
            )

    return run


def chain(borders: list[dict], auto: Automaton) -> dict[tuple[int, int], tuple[int, int, bool, int, int]]:
    """For each stretch of a conversation that spans partitions: entry, exit, ends it, rows and messages before."""
    borders = sorted(borders, key=lambda b: (b["part"], b["last"]))
    out = {}
    final = [ROLES.index(x) for x in FINAL]
    n = START + 1
    for _, group in groupby(borders, key=lambda b: (b["conv_id"] is None, b["conv_id"])):
        pieces = list(group)
        if len(pieces) < 2:
            continue
        matrices = [joined(b["costs"], b["messages"]) for b in pieces]
        costs = [FAR] * n
        costs[START] = 0
        trail = [costs]
        for m in matrices:
            trail.append(costs := [min(costs[p] + m[p * n + q] for p in range(n)) for q in range(n)])
        q = min(final, key=lambda x: (costs[x], x))
        ways = []
        for m, before in zip(reversed(matrices), reversed(trail[:-1]), strict=True):
            p = min(range(n), key=lambda x: (before[x] + m[x * n + q], x))
            ways.append((p, q))
            q = p
        rows = messages = 0
        for k, (b, m, (p, q)) in enumerate(zip(pieces, matrices, reversed(ways), strict=True)):
            out[b["part"], b["last"]] = (p, q, k == len(pieces) - 1, rows, messages)
            rows += b["rows"]
            messages += m[p * n + q] % UNIT
    return out


NAMES = ["conv_id", "position", "step", "message", "role", "turn", "source_role", "action", "cost", "text", "rendered"]


def repaired(auto: Automaton, rows: list[dict], entry: int = START, exits: list[int] | None = None, ends: bool = True, position: int = 0, messages: int = 0):
    """The output rows of a stretch of turns as tuples in the order of NAMES[1:]."""
    roles = [_role(r["role"]) for r in rows]
    way = auto.repair(roles, entry, exits or [ROLES.index(x) for x in FINAL])
    states = [p for p, _ in way]
    for k, (r, role) in enumerate(zip(rows, roles, strict=True)):
        p, q, merge = states[k], states[k + 1], way[k][1]
        step, close = 0, "<|im_end|>\n" if ends and k == len(rows) - 1 else ""
        text = r["text"] or ""
        if merge:
            cost = auto.costs["merge"] + auto.relabel(role, q)
            yield position + k, 0, messages - 1, ROLES[q], r["turn"], r["role"], "merge", cost, r["text"], "\n" + text + close
            continue
        *inserted, own = auto.paths[p, q]
        for x in inserted:
            head = "<|im_end|>\n" if messages else ""
            yield position + k, step, messages, ROLES[x], None, None, "insert", auto.costs["insert"], "", f"{head}<|im_start|>{ROLES[x]}\n"
            step, messages = step + 1, messages + 1
        head = "<|im_end|>\n" if messages else ""
        cost = auto.relabel(role, own)
        action = "keep" if role == own else "relabel"
        yield position + k, step, messages, ROLES[own], r["turn"], r["role"], action, cost, r["text"], f"{head}<|im_start|>{ROLES[own]}\n{text}{close}"
        messages += 1


def _repair(costs: dict[str, int], shared, key: pa.DataType, turn: pa.DataType):
    def run(batches):
        auto, plan = Automaton(costs), shared.value
        kinds = [key, pa.int64(), pa.int32(), pa.int64(), pa.string(), turn, pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        out: list[tuple] = []

        def record():
            columns = zip(*out, strict=True)
            return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=NAMES)

        pending = None
        index = 0
        for conv, rows in _conversations(batches):
            if pending is not None:
                out += _one(auto, plan, *pending, 0 if index == 0 else None)
                index += 1
            pending = (conv, rows)
            if len(out) > 20_000:
                yield record()
                out = []
        if pending is not None:
            out += _one(auto, plan, *pending, 0 if index == 0 else 1)
        if out:
            yield record()

    return run


def _one(auto: Automaton, plan: dict, conv, rows: list[dict], border: int | None):
    """Repair one stretch; ``border`` is 0 for a partition's first, 1 for its last, None between."""
    way = plan.get((rows[0]["part"], border)) if border is not None else None
    if way is None:
        return [(conv, *x) for x in repaired(auto, rows)]
    entry, leave, ends, position, messages = way
    return [(conv, *x) for x in repaired(auto, rows, entry, [leave], ends, position, messages)]


def repair_conversations(
    turns: DataFrame,
    *,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    costs: dict[str, int] | None = None,
) -> DataFrame:
    """One row per source turn or inserted message of the cheapest repair.

    Columns: conv_id, position (of the source turn in its conversation), step, message (number in the repaired
    conversation), role, turn, source_role, action (keep, relabel, merge or insert), cost, text and rendered.
    See the module for order and edge cases.
    """
    costs = COSTS | (costs or {})
    rows = turns.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")
    )
    order = ["conv_id", "turn", "role", "tie"]
    dealt = durable(rows.withColumn("tie", F.md5(F.col("text").cast("binary"))).repartitionByRange(*order).sortWithinPartitions(*order)).drop("tie")
    dealt = dealt.withColumn("part", F.spark_partition_id())
    types, example = dict(rows.dtypes), rows.limit(0).toArrow().schema
    key, turn = example.field("conv_id").type, example.field("turn").type
    # two rows for each partition at most
    borders = dealt.mapInArrow(_borders(costs, key), f"part int, last int, conv_id {types['conv_id']}, rows bigint, costs array<bigint>, messages array<bigint>").collect()
    plan = chain([b.asDict() for b in borders], Automaton(costs))
    shared = turns.sparkSession.sparkContext.broadcast(plan)
    schema = (
        f"conv_id {types['conv_id']}, position bigint, step int, message bigint, role string, turn {types['turn']}, source_role string, action string, cost bigint, text string, rendered string"
    )
    return dealt.mapInArrow(_repair(costs, shared, key, turn), schema)


def render(repaired: DataFrame, *, part: int = PART) -> DataFrame:
    """One row for each ``part`` turns of a repaired conversation.

    Columns: conv_id, part (from 0), n_turns, n_messages (begun in this part), n_relabelled, n_merged, n_inserted, cost
    and text, the rendering.
    """
    count = lambda *actions: F.count_if(F.col("action").isin(*actions))
    pieces = F.array_sort(F.collect_list(F.struct("position", "step", "rendered")))
    return repaired.groupBy("conv_id", F.floor(F.col("position") / part).alias("part")).agg(
        count("keep", "relabel", "merge").alias("n_turns"), count("keep", "relabel", "insert").alias("n_messages"), count("relabel").alias("n_relabelled"),
        count("merge").alias("n_merged"), count("insert").alias("n_inserted"), F.sum("cost").alias("cost"), F.array_join(F.transform(pieces, lambda p: p["rendered"]), "").alias("text"),
    )


def op3_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(repair_conversations(read(spark, sf_dir, "conversations")))


def role_sql(costs: dict[str, int] | None = None) -> str:
    """DuckDB SQL of the query, for conversations of up to PART turns: the dynamic program goes turn by turn."""
    auto = Automaton(COSTS | (costs or {}))
    start, end = "<|im_start|>", "<|im_end|>"
    steps = []
    for r in (*range(START), None):
        for p in range(START + 1):
            for q in range(START):
                best, merge = auto.steps[r][p][q]
                if best == FAR:
                    continue
                path = auto.paths.get((p, q), [])
                opened = "\n" if merge else "".join(f"{end}\n" * (k > 0 or p != START) + f"{start}{ROLES[x]}\n" for k, x in enumerate(path))
                relabelled = int(not merge and path[-1] != r)
                steps.append(f"({-1 if r is None else r}, {p}, {q}, {best // UNIT}, {best % UNIT}, {int(merge)}, {relabelled}, {0 if merge else len(path) - 1}, '{opened}')")
    known = " ".join(f"WHEN '{x}' THEN {k}" for k, x in enumerate(ROLES))
    final = ", ".join(str(ROLES.index(x)) for x in FINAL)
    return f"""
WITH RECURSIVE turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS k,
         CASE lower(trim(role)) {known} ELSE -1 END AS r, coalesce(text, '') AS text
  FROM conversations
), steps(r, p, q, cost, messages, merged, relabelled, inserted, opened) AS (VALUES {", ".join(steps)}),
way AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS k, {START} AS q, CAST(0 AS BIGINT) AS cost, CAST(0 AS BIGINT) AS messages, CAST(0 AS BIGINT) AS relabelled,
         CAST(0 AS BIGINT) AS merged, CAST(0 AS BIGINT) AS inserted, '' AS text
  FROM (SELECT DISTINCT conv_id FROM turns)
  UNION ALL
  SELECT conv_id, k, q, cost, messages, relabelled, merged, inserted, text FROM (
    SELECT w.conv_id, t.k, s.q, w.cost + s.cost AS cost, w.messages + s.messages AS messages, w.relabelled + s.relabelled AS relabelled,
           w.merged + s.merged AS merged, w.inserted + s.inserted AS inserted, w.text || s.opened || t.text AS text,
           row_number() OVER (PARTITION BY w.conv_id, s.q ORDER BY w.cost + s.cost, w.messages + s.messages, s.p) AS place
    FROM way AS w JOIN turns AS t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.k = w.k + 1 JOIN steps AS s ON s.r = t.r AND s.p = w.q
  ) WHERE place = 1
), best AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k DESC, cost, messages, q) AS place FROM way WHERE q IN ({final})
)
SELECT conv_id, CAST(0 AS BIGINT) AS part, k AS n_turns, messages AS n_messages, relabelled AS n_relabelled, merged AS n_merged, inserted AS n_inserted, cost,
       text || '{end}' || chr(10) AS text
FROM best WHERE place = 1
"""
