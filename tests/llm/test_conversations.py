"""Repair of conversations against trying all edits turn by turn."""

import hashlib
import random
import re
import zlib

import pytest

from panelspark.llm import conversations as C
from panelspark.llm import queries
from tests.llm.helpers import FOLDER

TURNS = "conv_id long, turn long, role string, text string, segment string, piece string, figures string, conv string"
LEGAL = re.compile("(s?(ua)+)?")
NO_SPACE = re.compile(r"[^\x20\x09-\x0D]")


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def cheapest(turns):
    """(cost, letters, lines) by carrying the best edit of every state forward."""
    best = {"": (0, "", ())}

    def put(into, state, value):
        if state not in into or value[:2] < into[state][:2]:
            into[state] = value

    def insertions(states):
        for _ in range(3):
            for s, (c, a, t) in list(states.items()):
                nxt = "a" if s == "u" else "u"
                put(states, nxt, (c + 5, a + "I", (*t, ("user:" if nxt == "u" else "assistant:"))))

    for role, text, fault in turns:
        insertions(best)
        after = {}
        for s, (c, a, t) in best.items():
            put(after, s, (c + 2, a + "D", t))
            if fault in ("blank", "duplicate"):
                continue
            extra, nxt, i = 5 * (fault == "truncated"), "a" if s == "u" else "u", role[:1]
            if (i in ("u", "a") and i == nxt) or (i == "s" and s == ""):
                put(after, i, (c + extra, a + "K", (*t, f"{role}:{text}")))
            put(after, nxt, (c + 1 + extra, a + "R", (*t, ("user:" if nxt == "u" else "assistant:") + text)))
        best = after
    insertions(best)
    return min(best[s] for s in ("", "a") if s in best)


def brute(rows):
    damaged, out = hurt(rows), []
    for conv in {r[0] for r in rows}:
        mine = [r for r in damaged if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        seen, turns = set(), []
        for _, _, role, text in mine:
            last = NO_SPACE.findall(text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None
            seen.add((role, text))
            turns.append((role, text, fault))
        numbers = [r[1] for r in mine if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        count = [sum(t[2] == f for t in turns) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = cheapest(turns)
        assert LEGAL.fullmatch("".join(line[0] for line in lines))
        out.append((conv, gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], TURNS)
    got = C.repair_damaged(df)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def talk(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        turn = 0
        for k in range(rng.randrange(longest)):
            turn += rng.choice([0, 1, 1, 1, 1, 2])
            role = rng.choice(["user", "assistant", "assistant" if k % 2 else "user", "system", "tool", "User", "assistant" if k % 2 else "user"])
            rows.append((conv, turn, role, rng.choice(["Yes.", "No", "Why?", " \t", f"Line {k}.\nMore", f"Own {conv} {k}!"])))
    rng.shuffle(rows)
    return rows


def test_random_conversations(spark):
    rows = talk(1, 150, 14)
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("piece", [1, 3, 7])
def test_pieces_of_long_conversations(spark, monkeypatch, piece):
    """Conversations cut into many pieces, and by the borders of partitions as well."""
    monkeypatch.setattr(C, "LEAST_PIECE", piece)
    monkeypatch.setattr(C.math, "isqrt", lambda n: piece)
    rows = talk(2, 3, 400) + talk(3, 40, 12)
    assert found(spark, rows) == brute(rows)


def test_one_conversation_holds_most_rows(spark):
    rng = random.Random(4)
    rows = [(7, k, rng.choice(["user", "assistant"]), f"Turn {k % 900}" + rng.choice([".", ""])) for k in range(3000)] + talk(5, 30, 10)
    assert found(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (None, None, "assistant", "Hello."), (1, 1, "", "No role."), (1, 2, "user", "Q?"), (1, 3, "assistant", "A.")]
    rows += [(2, 5, "user", "Same."), (2, 5, "user", "Same."), (2, 5, "user", "Same."), (2, 9, "assistant", "x" * 200_000 + ".  "), (3, 1, "system", "S."), (4, -3, "user", ""), (5, 1, "umbrella", "Ü?")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_conversation_without_rows_left(spark):
    lost = next(k for k in range(10_000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = found(spark, [(lost, 0, "user", "Gone.")])
    assert got == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_query_on_given_table(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()]
    got = sorted((tuple(r) for r in queries.QUERIES["op12_conversations"](spark, FOLDER).collect()), key=str)
    assert got == brute(rows)
