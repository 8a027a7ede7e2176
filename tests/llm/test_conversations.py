"""Conversation repair against a plain recurrence over (cost, audit), worked out from the rows again."""

import hashlib
import random
import re
from zlib import crc32

import pytest

from citegrain.llm import conversations, queries

FAULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damage(rows):
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else x
        h = crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if h == 0:
            continue
        row = (conv, turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
        yield from [row] * (2 if h == 3 else 1)


def solve(rows):
    """rows: (turn, role, text) in order. The fields of a conversation."""
    seen, marks = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        marks.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    n, due = len(rows), {0: "u", 1: "u", 2: "a", 3: "u"}
    after = {"u": 2, "a": 3}
    far = (10**9, "")
    best = [[far] * 4 for _ in range(n + 1)]
    for i in range(n, -1, -1):
        if i == n:
            best[i][0] = best[i][3] = (0, "")
        options = [[] for _ in range(4)]
        if i < n:
            role, mark = rows[i][1], marks[i]
            late = mark == "truncated"
            for q in range(4):
                go = lambda to, cost, edit: options[q].append((cost + best[i + 1][to][0], edit + best[i + 1][to][1]))
                go(q, 3, "D")
                if mark not in ("blank", "duplicate"):
                    go(after[due[q]], 2 + late, "R")
                    if role[:1] == "s" and q == 0:
                        go(1, late, "K")
                    elif role[:1] == due[q]:
                        go(after[due[q]], late, "K")
            for q in range(4):
                best[i][q] = min(options[q])
        for _ in range(4):  # insertions lead from a state to another of the same place
            for q in range(4):
                to = best[i][after[due[q]]]
                best[i][q] = min(best[i][q], (2 + to[0], "I" + to[1]))
    cost, audit = best[0][0]
    out, i, q = [], 0, 0
    for e in audit:
        if e in "KR" and e == "K":
            out.append(f"{rows[i][1]}:{rows[i][2]}")
            q = {"s": 1, "u": 2, "a": 3}[rows[i][1][0]]
        elif e in "RI":
            role = {"u": "user", "a": "assistant"}[due[q]]
            out.append(f"{role}:{rows[i][2] if e == 'R' else ''}")
            q = after[due[q]]
        i += e != "I"
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *[marks.count(x) for x in FAULT[1:4]], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def ordered(spark, rows):
    """Rows of a conversation by turn; those of one turn in the order that the operator states."""
    df = conversations.keyed(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {}
    for r in df.orderBy("conv_id", "turn", "h", "g").collect():
        out.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    return out


def rows_of(df):
    rows = df.collect()
    got = {r.conv_id: (*[r[c] for c in FAULT], r.audit, r.repaired_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


def test_query_is_the_recurrence(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    left = ordered(spark, list(damage(rows)))
    got = rows_of(queries.op13_conversations(spark, sf))
    assert got == {c: solve(left.get(c, [])) for c in {r[0] for r in rows}}


@pytest.fixture(scope="module")
def wild():
    """Conversations of all lengths and roles, with ties, repeated rows, nulls and gaps."""
    rng = random.Random(5)
    rows = []
    for conv in [None, *range(60)]:
        size = 400 if conv == 7 else rng.choice([0, 1, 2, 3, 5, 9, 14])
        for _ in range(size):
            turn = rng.choice([None, *range(2 * size)])
            row = (conv, turn, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice(["Yes.", "No?", "an end without", "", None, " \t", "Go on! ", "x" * 50, f"Text {rng.randrange(99)}.", f"cut {rng.randrange(99)}"]))
            rows += [row] * rng.choice([1, 1, 1, 2])
    return rows + [(99, 3, "user", "again and")] * 300


@pytest.mark.parametrize("size", [1, 2, 7, 10_000])
def test_slices_make_no_difference(spark, wild, size):
    df = spark.createDataFrame(wild, "conv_id long, turn long, role string, text string")
    assert rows_of(conversations.report(df, size=size)) == {c: solve(x) for c, x in ordered(spark, wild).items()}


def test_damage(spark, wild):
    df = spark.createDataFrame(wild, "conv_id long, turn long, role string, text string").withColumn("h", __import__("pyspark").sql.functions.lit("own"))
    key = lambda x: tuple((y is not None, y) for y in x)
    assert sorted(map(tuple, conversations.damaged(df).collect()), key=key) == sorted(damage(wild), key=key)
    left = ordered(spark, list(damage(wild)))
    assert rows_of(conversations.report(conversations.damaged(df), df)) == {c: solve(left.get(c, [])) for c in {r[0] for r in wild}}


def test_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.report(none).collect() == []
    one = spark.createDataFrame([(4, 1, "user", " ")], none.schema)
    assert rows_of(conversations.report(one)) == {4: (0, 1, 0, 0, 0, 3, "D", hashlib.sha256(b"").hexdigest())}
    assert rows_of(conversations.report(none, one)) == {4: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
