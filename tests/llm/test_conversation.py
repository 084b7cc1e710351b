"""Conversation repair against a plain search over all edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from chromaforge.llm import conversation as cv
from chromaforge.llm.queries import op12_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, conv string, copies long"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (conv, turn, "user" if kind == 4 else role, text)
        out += [row] * {0: 0, 3: 2}.get(kind, 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_repair(rows, bad):
    """Cheapest (cost, audit, repaired) by dynamic programming over roles written so far, all ties kept."""
    names = {"u": "user", "a": "assistant"}
    states = {"": {(0, "", ())}}  # keyed by what matters: "" nothing, else the last initial

    def insert(states):
        for _ in range(2):
            for state, ways in list(states.items()):
                nxt = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
                for cost, audit, done in list(ways):
                    states.setdefault(nxt, set()).add((cost + 2, audit + "I", (*done, f"{names[nxt]}:")))
        return prune(states)

    def prune(states):
        return {s: {min(ways)} for s, ways in states.items()}

    for (_, _, role, text), fault in zip(rows, bad, strict=True):
        states, after = insert(states), {}
        for state, ways in states.items():
            for cost, audit, done in ways:
                after.setdefault(state, set()).add((cost + 3, audit + "D", done))
                if fault in ("blank", "duplicate"):
                    continue
                cut = fault == "truncated"
                nxt = {"": "us", "s": "u", "u": "a", "a": "u"}[state]
                if role[:1] and role[:1] in nxt:
                    after.setdefault(role[0], set()).add((cost + cut, audit + "K", (*done, f"{role}:{text}")))
                after.setdefault(nxt[0], set()).add((cost + 2 + cut, audit + "R", (*done, f"{names[nxt[0]]}:{text}")))
        states = prune(after)
    states = insert(states)
    return min(w for s in ("", "a") for w in states.get(s, ()))


def plain(rows):
    out = []
    hurt = plain_damage(rows)
    for conv in dict.fromkeys(r[0] for r in rows):
        turns = sorted((r for r in hurt if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        bad = faults(turns)
        cost, audit, done = plain_repair(turns, bad)
        numbers = [r[1] for r in turns if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        digest = hashlib.sha256("\n".join(done).encode()).hexdigest()
        out.append((conv, gaps, bad.count("blank"), bad.count("duplicate"), bad.count("truncated"), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def table():
    r = random.Random(4)
    roles = ["user", "assistant", "system", "tool", "", None, "sage"]
    rows = [(1, 0, None, None), (2, None, "user", "a."), (2, None, "user", "a."), (2, None, "assistant", "b."), (3, 5, "user", "\t\n")]
    rows += [(None, t, "user", f"text {t % 2}.") for t in range(6)]
    rows += [(4, 5, "user", "same?")] * 40 + [(4, 6, "assistant", "cut")] * 3
    rows += [(i, t, r.choice(roles[:2] * 4 + roles), r.choice(["Yes.", "No", "", "Well? ", "é!", f"t{t}."])) for i in range(10, 90) for t in range(r.randint(1, 9))]
    rows += [(99, t, ("user", "assistant")[t % 2] if r.random() < 0.8 else "system", f"turn {t // 2}." if r.random() < 0.9 else "end") for t in range(150)]
    # ids of which no row is left
    rows += [(i, 0, "user", "gone.") for i in range(1000, 1200) if zlib.crc32(f"{i}:0".encode()) % 20 == 0]
    return rows


def rows_of(df, name="conv"):
    columns = [name, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(x) for x in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize(("most", "size"), [(cv.ROWS, cv.BYTES), (7, cv.BYTES), (1, cv.BYTES), (cv.ROWS, 10)])
def test_whole_and_in_blocks_as_the_plain_search(spark, most, size):
    rows = [(*x, "x", 7) for x in table()]
    prepared = cv.damage(cv.prepare(spark.createDataFrame(rows, SCHEMA)))
    got = rows_of(cv.digests(prepared, most, size))
    assert got == plain(table())
    assert any(x[7] == "" for x in got) and any(x[7].count("I") > 1 for x in got)


def test_query(spark, tmp_path):
    spark.createDataFrame([(*x, "x", 7) for x in table()], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows_of(op12_conversation_repair(spark, str(tmp_path)), "conv_id") == plain(table())


@pytest.mark.parametrize("most", [cv.ROWS, 5])
def test_repaired_turns_follow_the_grammar(spark, most):
    prepared = cv.prepare(spark.createDataFrame([(*x, "x", 7) for x in table()], SCHEMA))
    got = {}
    for x in sorted(cv.repair(prepared, most).collect(), key=lambda x: (x.part, x.place)):
        got.setdefault(x.conv, []).append(x)
    assert len(got) > 60
    for turns in got.values():
        assert re.fullmatch("s?(ua)+", "".join(x.role[0] for x in turns))
        assert all(x.text == "" and x.role in ("user", "assistant") for x in turns if x.edit == "I")


def test_search_is_the_least_of_all_edit_sequences():
    r = random.Random(9)
    for _ in range(300):
        turns = [cv.Turn(r.choice(["user", "assistant", "system", "x"]), "t", r.choice(["", "", "blank", "truncated"]), 1) for _ in range(r.randint(0, 5))]
        rows = [(0, 0, t.role, t.text) for t in turns]
        cost, audit, done = plain_repair(rows, [t.fault for t in turns])
        ((found, letters),) = cv.search(turns).values()
        assert (found, letters) == (cost, audit)
        assert tuple(f"{role}:{text}" for role, text, _ in cv.apply(turns, letters)) == done


def test_empty_table(spark):
    empty = cv.prepare(spark.createDataFrame([], SCHEMA))
    assert cv.digests(cv.damage(empty)).count() == 0 and cv.repair(empty).count() == 0
