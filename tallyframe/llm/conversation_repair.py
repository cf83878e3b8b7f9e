"""Cheapest repair of conversations by a Viterbi search that emits edits as its survivors coalesce.

A repaired conversation alternates user and assistant, ends with the assistant, and may open with a
system turn. Each row is kept, given another role, or deleted, and empty turns may be inserted; the
cheapest edits win, among those of one cost the list that is least in ASCII order.

Rows of a conversation are read once, in order of their turn. Between rows at most four survivors are
held, one for each state of the role pattern (nothing yet, after a system turn, after a user turn,
after an assistant turn), as tips of one backpointer tree. A node counts the nodes and tips
that lead to it and goes when none does. As soon as the root has a single branch, all survivors share
it: its edits are emitted and forgotten. A survivor that costs more than another one plus the price of
passing from that one's state to its own can't win any more and is dropped, so survivors coalesce
after a few rows and memory is bounded by the rows between, not by the conversation. Candidates of
equal cost are compared by their complete unresolved edits, from the root on; no list is a prefix of
another one there, as each ends with the edit of the same row.

Rows are dealt out by conversation and sorted by turn, with spilling; duplicates are found by a window
over digests of their contents. One conversation is read by one task, as the digest of its repaired text is one
running hash; that task holds a few rows of it at a time, and the edits where ``report`` is asked for them.

Defined results: null roles and texts are one space; rows of one turn are ordered by role and text;
null turns come first; a null ``conv_id`` is a conversation; exact copies of rows are duplicates; an
empty table gives an empty one; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyframe.llm.sql_parts import crc32, crc32_table

#: What edits cost.
RETURN_ROLE, DELETE, INSERT, LEAVE_TRUNCATED = 1, 2, 5, 5
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
SPACE = " \t\n\x0b\x0c\r"
#: From a state, the roles that may follow and the states they lead to; only a first row can be system.
FOLLOWS = {NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
NAMES = {"u": "user", "a": "assistant"}
#: What it costs at most to go on from the first state as if one were in the second.
PASS = {(ASSISTANT, NOTHING): DELETE, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): INSERT, (USER, ASSISTANT): INSERT, (USER, SYSTEM): INSERT, (USER, NOTHING): INSERT + DELETE}
LEGAL = {"su", "ua", "au"}
BATCH = 4096


def _steps() -> dict[str, list[tuple[int, int, str, str]]]:
    """By initial of a row's role: state before, state after, what is inserted first, the role it gets ("" where kept)."""
    found = {}
    for initial in ("s", "u", "a", ""):
        steps = []
        for state, ways in FOLLOWS.items():
            starts = [(state, "")] + [(to, role) for role, to in ways.items() if role in NAMES]
            for at, inserted in starts:
                for role, to in FOLLOWS[at].items():
                    if role == initial or role in NAMES:
                        steps.append((state, to, inserted, "" if role == initial else role))
        found[initial] = steps
    return found


STEPS = _steps()


@dataclass(slots=True)
class Node:
    """Edits of one row after those of ``parent``; ``refs`` counts the nodes and survivors that build on it."""

    parent: Node | None
    edits: list[tuple[str, str, str]] = field(default_factory=list)
    code: str = ""
    refs: int = 0


class Repair:
    """The search over one conversation; ``emit`` gets each edit once, in order, as soon as it is certain."""

    def __init__(self, emit):
        self.emit, self.root = emit, Node(None)
        self.tips: dict[int, tuple[int, Node]] = {NOTHING: (0, self.root)}
        self.root.refs = 1

    def _unresolved(self, node: Node) -> str:
        parts = []
        while node is not self.root:
            parts.append(node.code)
            node = node.parent
        return "".join(reversed(parts))

    def _before(self, node: Node, code: str, other: Node, other_code: str) -> bool:
        """Whether the first of two lists of edits of equal cost comes first."""
        if node is other:
            return code < other_code
        return self._unresolved(node) + code < self._unresolved(other) + other_code

    def _release(self, node: Node) -> None:
        while node is not None:
            node.refs -= 1
            if node.refs or node is self.root:
                return
            node = node.parent

    def row(self, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        best: dict[int, tuple[int, Node, str, str, str]] = {}

        def offer(to: int, cost: int, node: Node, inserted: str, edit: str, given: str) -> None:
            have = best.get(to)
            code = "I" + edit if inserted else edit
            if have is None or cost < have[0] or (cost == have[0] and self._before(node, code, have[1], "I" + have[3] if have[2] else have[3])):
                best[to] = (cost, node, inserted, edit, given)

        for state, (cost, node) in self.tips.items():
            offer(state, cost + DELETE, node, "", "D", role)
        if fault not in (BLANK, DUPLICATE):
            left = LEAVE_TRUNCATED if fault == TRUNCATED else 0
            for state, to, inserted, given in STEPS[initial if initial in STEPS else ""]:
                if state in self.tips:
                    cost, node = self.tips[state]
                    offer(to, cost + left + (INSERT if inserted else 0) + (RETURN_ROLE if given else 0), node, inserted, "R" if given else "K", NAMES[given] if given else role)
        for (strong, weak), price in PASS.items():
            if strong in best and weak in best and best[weak][0] > best[strong][0] + price:
                del best[weak]
        tips = {}
        for to, (cost, node, inserted, edit, given) in best.items():
            edits = [("I", NAMES[inserted], "")] if inserted else []
            tips[to] = (cost, Node(node, [*edits, (edit, given, text)], "I" + edit if inserted else edit, 1))
            node.refs += 1
        for _, node in self.tips.values():
            self._release(node)
        self.tips = tips
        self._settle()

    def _settle(self) -> None:
        """Emit what all survivors share."""
        if self.root.refs != 1:
            return
        path = [next(iter(self.tips.values()))[1]]
        while path[-1] is not self.root:
            path.append(path[-1].parent)
        at = len(path) - 1
        while at and path[at].refs == 1:
            at -= 1
            for edit in path[at].edits:
                self.emit(*edit)
        self.root = path[at]
        self.root.parent = None

    def close(self) -> int:
        """Emit the rest; the cost of all edits."""
        ends = [(cost, node, "") for state, (cost, node) in self.tips.items() if state in (NOTHING, ASSISTANT)]
        ends += [(cost + INSERT, node, "I") for state, (cost, node) in self.tips.items() if state == USER]
        won = ends[0]
        for end in ends[1:]:
            if end[0] < won[0] or (end[0] == won[0] and self._before(*end[1:], *won[1:])):
                won = end
        rest, node = [], won[1]
        while node is not self.root:
            rest.append(node.edits)
            node = node.parent
        for edits in reversed(rest):
            for edit in edits:
                self.emit(*edit)
        if won[2]:
            self.emit("I", NAMES["a"], "")
        return won[0]


def _prepared(conversations: DataFrame, gone: Column | None) -> DataFrame:
    """Rows by conversation and turn with their first fault; rows that are ``gone`` only say that their conversation exists."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.coalesce(gone, F.lit(False)).alias("gone") if gone is not None else F.lit(False).alias("gone"))
    rows = rows.withColumns({c: F.when(~F.col("gone"), F.col(c)) for c in ("turn", "role", "text")}).repartition("conv_id")
    said = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    again = F.row_number().over(Window.partitionBy("conv_id", "said").orderBy("turn")) > 1
    body = F.rtrim("text", F.lit(SPACE))
    fault = F.when(body == "", BLANK).when(F.col("again"), DUPLICATE).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    flagged = rows.withColumn("said", said).withColumn("again", again & ~F.col("gone"))
    return flagged.select("conv_id", "turn", "role", "text", "gone", fault.alias("fault")).sortWithinPartitions("conv_id", "turn", "role", "text")


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of sorted batches, each with whether it opens a conversation in front."""
    last, first = None, True
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            yield first or row[0] != last, *row
            last, first = row[0], False


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(column, type=f.type) for column, f in zip(zip(*rows, strict=True), schema, strict=True)]
    rows.clear()
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _mapped(prepared: DataFrame, run, columns: str) -> DataFrame:
    """``run(batches, schema)`` over sorted rows; it gives ``conv_id`` and ``columns``."""
    schema = T.StructType([prepared.schema["conv_id"], *T.StructType.fromDDL(columns).fields])
    arrow = to_arrow_schema(schema)
    return prepared.mapInArrow(lambda batches: run(batches, arrow), schema)


def repair(conversations: DataFrame) -> DataFrame:
    """``conv_id, at, edit, role, text``: every edit in order (K, R, D, I) with the turn it leaves, or deletes.

    Repaired conversations are the rows other than D, by ``at``. Rows leave the search as soon as they are certain.
    """

    def run(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        out, conv, count, size, search = [], None, 0, 0, None

        def emit(edit: str, role: str, text: str) -> None:
            nonlocal count, size
            out.append((conv, count, edit, role, text))
            count, size = count + 1, size + len(text)

        for opens, conv_id, _, role, text, _, fault in _rows(batches):
            if opens:
                if search is not None:
                    search.close()
                conv, count, search = conv_id, 0, Repair(emit)
            search.row(role, text, fault)
            if len(out) >= BATCH or size >= BATCH << 10:
                size = 0
                yield _batch(out, schema)
        if search is not None:
            search.close()
        if out:
            yield _batch(out, schema)

    return _mapped(_prepared(conversations, None), run, "at long, edit string, role string, text string")


def report(conversations: DataFrame, gone: Column | None = None) -> DataFrame:
    """One row for each conversation: what is wrong with it, what its repair costs, the edits, the digest of the repaired text.

    Rows for which ``gone`` holds count for nothing but their conversation's being there.
    """

    def run(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        out, now = [], None
        for opens, conv_id, turn, role, text, missing, fault in _rows(batches):
            if opens:
                if now is not None:
                    out.append(now.row())
                    if len(out) >= BATCH:
                        yield _batch(out, schema)
                now = Account(conv_id)
            if not missing:
                now.add(turn, role, text, fault)
        if now is not None:
            out.append(now.row())
        if out:
            yield _batch(out, schema)

    return _mapped(_prepared(conversations, gone), run, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


class Account:
    """Counts of one conversation beside its repair."""

    def __init__(self, conv_id):
        self.conv_id, self.faults, self.illegal, self.initial = conv_id, [0, 0, 0, 0], 0, None
        self.low = self.high = None
        self.turns, self.lines = 0, 0
        self.audit, self.digest, self.search = [], hashlib.sha256(), Repair(self._emit)

    def _emit(self, edit: str, role: str, text: str) -> None:
        self.audit.append(edit)
        if edit != "D":
            self.digest.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
            self.lines += 1

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None and turn != self.high:  # rows come in order of their turns
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.faults[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        self.search.row(role, text, fault)

    def row(self) -> tuple:
        cost = self.search.close()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, *self.faults[1:], self.illegal, cost, "".join(self.audit), self.digest.hexdigest())


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations with faults planted by a checksum of conversation and turn, and which rows were dropped.

    Of twenty remainders, 0 drops the row, 1 empties its text, 2 removes its marks of sentence ends,
    3 repeats it, and 4 makes it the user's. Nulls count as one space.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), kind.alias("damage"))
    damage = F.col("damage")
    text = F.when(damage == 1, "").when(damage == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(damage == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "damage", F.explode(F.array_repeat(F.lit(1), F.when(damage == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy"), damage == 0


def report_sql() -> str:
    """The report of damaged conversations in SQL: four states folded over each conversation's rows."""
    far, names = 1_000_000, {"s": "system", **NAMES}

    def step(state: int, op: str, inserted: str) -> str:
        held = f"s[{state + 1}]"
        cost = f"{held}.c + (CASE WHEN x.i = '{op}' THEN 0 ELSE {RETURN_ROLE if op in NAMES else far} END) + (CASE x.f WHEN {TRUNCATED} THEN {LEAVE_TRUNCATED} WHEN 0 THEN 0 ELSE {far} END)"
        code, line = f"CASE WHEN x.i = '{op}' THEN 'K' ELSE 'R' END", f"chr(10) || (CASE WHEN x.i = '{op}' THEN x.r ELSE '{names[op]}' END) || ':' || x.t"
        if inserted:
            cost, code, line = f"{cost} + {INSERT}", f"'I' || {code}", f"chr(10) || '{NAMES[inserted]}:' || {line}"
        return f"{{'c': {cost}, 'a': {held}.a || {code}, 'r': {held}.r || {line}}}"

    ways: dict[int, list[str]] = {state: [f"{{'c': s[{state + 1}].c + {DELETE}, 'a': s[{state + 1}].a || 'D', 'r': s[{state + 1}].r}}"] for state in FOLLOWS}
    for state, follows in FOLLOWS.items():
        for op, to in follows.items():
            ways[to].append(step(state, op, ""))
            if op in NAMES:
                for after, end in FOLLOWS[to].items():
                    ways[end].append(step(state, after, op))
    folded = ", ".join(f"list_min([{', '.join(ways[state])}])" for state in range(4))
    start = ", ".join(f"{{'c': {0 if state == NOTHING else far}::BIGINT, 'a': '', 'r': ''}}" for state in range(4))
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH crc AS (SELECT {crc32_table()} AS t),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')", "crc.t")} % 20 AS damage FROM conversations, crc),
spoiled AS (SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
  CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  damage = 0 AS gone, unnest(range(0, CASE damage WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM src),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, gone ORDER BY turn NULLS FIRST, role, text, copy) AS place,
  rtrim(text, {space}) AS body FROM spoiled),
marked AS (SELECT *, CASE WHEN body = '' THEN {BLANK}
  WHEN row_number() OVER (PARTITION BY conv_id, gone, role, text ORDER BY place) > 1 THEN {DUPLICATE}
  WHEN right(body, 1) NOT IN ('.', '!', '?') THEN {TRUNCATED} ELSE 0 END AS fault,
  left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id, gone ORDER BY place) AS earlier FROM placed),
told AS (SELECT conv_id, coalesce(max(turn) FILTER (NOT gone) - min(turn) FILTER (NOT gone) + 1 - count(DISTINCT turn) FILTER (NOT gone), 0) AS gaps,
  count(*) FILTER (NOT gone AND fault = {BLANK}) AS blank, count(*) FILTER (NOT gone AND fault = {DUPLICATE}) AS duplicate,
  count(*) FILTER (NOT gone AND fault = {TRUNCATED}) AS truncated,
  count(*) FILTER (NOT gone AND earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal,
  coalesce(list({{'i': initial, 'f': fault, 'r': role, 't': text}} ORDER BY place) FILTER (NOT gone), []) AS rows FROM marked GROUP BY conv_id),
folded AS (SELECT * EXCLUDE (rows), list_reduce(rows, lambda s, x: [{folded}], [{start}]) AS s FROM told),
ended AS (SELECT * EXCLUDE (s), list_min([s[{NOTHING + 1}], s[{ASSISTANT + 1}], {{'c': s[{USER + 1}].c + {INSERT}, 'a': s[{USER + 1}].a || 'I', 'r': s[{USER + 1}].r || chr(10) || 'assistant:'}}]) AS e FROM folded)
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, e.c AS cost, e.a AS audit, sha256(substr(e.r, 2)) AS repaired_sha256 FROM ended"""
