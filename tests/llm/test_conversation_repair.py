import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, fault int, gone string, said int"


def fault_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        out.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Every list of edits, by trying them all: at most one insertion before each row and at the end."""
    best = None
    for start in (None, *range(len(rows) + 1)):  # insertions are few in short conversations
        for second in [None] if start is None else [None, *range(start + 1, len(rows) + 1)]:
            inserts = {start, second} - {None}
            for roles in itertools.product("ua", repeat=len(inserts)):
                given = dict(zip(sorted(inserts), roles, strict=True))
                for edits in itertools.product("DKua", repeat=len(rows)):
                    cost, audit, initials, lines, fine = 0, "", "", [], True
                    for k, row in enumerate([*rows, None]):
                        if k in given:
                            cost, audit, initials = cost + 5, audit + "I", initials + given[k]
                            lines.append(cr.NAMES[given[k]] + ":")
                        if row is None:
                            continue
                        e = edits[k]
                        if e == "D":
                            cost, audit = cost + 2, audit + "D"
                            continue
                        if faults[k] in (1, 2):
                            fine = False
                            break
                        cost += (e != "K") + 5 * (faults[k] == 3)
                        audit += "K" if e == "K" else "R"
                        initials += row[1][:1] if e == "K" else e
                        if len(initials) < len(lines) + 1:
                            fine = False
                            break
                        lines.append((row[1] if e == "K" else cr.NAMES[e]) + ":" + row[2])
                    if fine and re.fullmatch(r"(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
                        best = (cost, audit, lines)
    return best


def searched(rows, faults):
    edits = []
    search = cr.Repair(lambda *e: edits.append(e))
    for (_, role, text), fault in zip(rows, faults, strict=True):
        search.row(role, text, fault)
    cost = search.close()
    return cost, "".join(e for e, *_ in edits), [f"{role}:{text}" for e, role, text in edits if e != "D"]


def test_search_equals_trying_everything():
    rng = random.Random(8)
    for _ in range(100):
        rows = [(k, rng.choice(("system", "user", "user", "assistant", "assistant", "tool", "")), rng.choice(("a.", "b!", "c", "d?", "", "e. \n", "f. x"))) for k in range(rng.randint(0, 5))]
        faults = fault_of(rows)
        assert searched(rows, faults) == cheapest(rows, faults), rows


def test_memory_is_bounded_by_unresolved_rows():
    rng = random.Random(1)
    count, widest = 0, 0

    def emit(*_):
        nonlocal count
        count += 1

    search = cr.Repair(emit)
    for k in range(20_000):
        search.row(rng.choice(("user", "assistant", "system")), "x", rng.choice((0, 0, 0, 1, 2, 3)))
        widest = max(widest, k + 1 - count)
    search.close()
    assert count >= 20_000 and widest < 200


def conversations():
    rng = random.Random(5)
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(0, 7)):
            role = rng.choice(("system", "user", "assistant", "user", "assistant", "tool"))
            rows.append((conv, rng.choice((turn, turn, turn * 2)), role, rng.choice(("Yes.", "No!", "what", " ", "so? \t", "ok."))))
    for turn in range(400):
        rows.append((900, turn, "user" if turn % 2 == 0 else "assistant", f"line {turn}" + ("." if turn % 7 else "")))
    rows += [(901, None, None, None), (901, None, "user", "Hi."), (901, 3, "assistant", None), (None, 1, "user", "Null."), (None, None, "assistant", "Id."), (902, 2, "user", "é. ü" * 9000), (902, 2, "user", "é. ü" * 9000), (903, 5, "", "Nobody.")]
    return rows


def plain_report(rows):
    """The same from the words of the contract, with lists and a table of costs."""
    groups = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        kept = groups.setdefault(conv, [])
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, kept in groups.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults = fault_of(kept)
        turns = [t for t, *_ in kept if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(kept)]
        table = {"": (0, "", [])}  # by what was said last: nothing, system, user, assistant
        for (_, role, text), fault in zip(kept, faults, strict=True):
            new = {}

            def offer(state, value, new=new):
                if state not in new or value[:2] < new[state][:2]:
                    new[state] = value

            for state, (cost, audit, lines) in table.items():
                offer(state, (cost + 2, audit + "D", lines))
                if fault in (1, 2):
                    continue
                nexts = {"": "su", "s": "u", "u": "a", "a": "u"}
                for first in ("", "u", "a"):
                    if first and first not in nexts[state]:
                        continue
                    for op in nexts[first or state]:
                        if role[:1] == op:
                            step, code, line = 0, "K", f"{role}:{text}"
                        elif op != "s":
                            step, code, line = 1, "R", f"{cr.NAMES[op]}:{text}"
                        else:
                            continue
                        more = [f"{cr.NAMES[first]}:"] if first else []
                        offer(op, (cost + step + 5 * (fault == 3) + 5 * bool(first), audit + ("I" if first else "") + code, [*lines, *more, line]))
            table = new
        ends = [table[s] for s in ("", "a") if s in table] + [(c + 5, a + "I", [*x, "assistant:"]) for s, (c, a, x) in table.items() if s == "u"]
        cost, audit, lines = min(ends, key=lambda e: e[:2])
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(1), faults.count(2), faults.count(3), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, 1, "clash", 2) for r in conversations()], SCHEMA).repartition(3)


def test_report_equals_a_plain_one_and_its_sql(table):
    rows, gone = cr.damaged(table)
    got = cr.report(rows, gone).collect()
    want = plain_report(conversations())
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    frame = table.toPandas()[["conv_id", "turn", "role", "text"]].astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", frame)
    assert {r[0]: r[1:] for r in con.execute(cr.report_sql()).fetchall()} == want


def test_repaired_rows_give_the_reports_digest(table):
    rows, gone = cr.damaged(table)
    left = rows.where(~gone)
    edits = {}
    for r in cr.repair(left).orderBy("conv_id", "at").collect():
        edits.setdefault(r["conv_id"], []).append(r)
    for r in cr.report(left).collect():
        own = edits[r["conv_id"]]
        assert "".join(e["edit"] for e in own) == r["audit"] and [e["at"] for e in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(f"{e['role']}:{e['text']}" for e in own if e["edit"] != "D").encode()).hexdigest() == r["repaired_sha256"]


def test_an_empty_table_and_all_rows_dropped(table):
    assert cr.report(table.limit(0)).count() == 0 and cr.repair(table.limit(0)).count() == 0
    r = cr.report(table.where("conv_id = 900"), F.lit(True)).collect()
    assert [tuple(x) for x in r] == [(900, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
