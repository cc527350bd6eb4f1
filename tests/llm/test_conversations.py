"""Repaired conversations against all sequences of edits, and against strings of edits in place of ranks."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from barloom.llm import conversations
from pyspark.sql import functions as F

COST = {"K": 0, "R": 3, "D": 4, "I": 3}


def in_order(rows):
    return sorted(((c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def outcome(rows, faults, audit):
    """Cost and repaired (role, text) of an audit, or None where it isn't allowed."""
    kept = sum(c != "D" for c in audit)
    roles = [*(["system"] if kept % 2 else []), *["user", "assistant"] * (kept // 2)]
    at, cost, out = iter(zip(rows, faults, strict=True)), 0, []
    if kept == 1:
        return None
    for c in audit:
        cost += COST[c]
        if c == "I":
            role, text = roles[len(out)], ""
            if role == "system":
                return None
        else:
            (_, _, role, text), fault = next(at)
            if c == "D":
                continue
            if fault in ("blank", "duplicate"):
                return None
            cost += 3 * (fault == "truncated")
            want = roles[len(out)]
            if (c == "R" and want == "system") or (c == "K" and role[:1] != want[0]):
                return None
            role = role if c == "K" else want
        out.append((role, text))
    return cost, out


def exhaustive(rows):
    """The cheapest, then least, of all audits with at most two inserts in a row."""
    rows = in_order(rows)
    faults = faults_of(rows)
    best = None
    for runs in itertools.product(("", "I", "II"), repeat=len(rows) + 1):
        for edits in itertools.product("DKR", repeat=len(rows)):
            audit = "".join(r + e for r, e in zip(runs, [*edits, ""], strict=True))
            got = outcome(rows, faults, audit)
            if got is not None and (best is None or (got[0], audit) < best[:2]):
                best = (got[0], audit, got[1])
    return best


def by_strings(rows):
    """As exhaustive(), with the best string of edits for each state and turn."""
    rows = in_order(rows)
    steps = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def after_inserts(states):
        for _ in range(2):
            for state, (cost, audit) in list(states.items()):
                for letter in steps[state]:
                    if letter != "s":
                        states[letter] = min(states.get(letter, (10**9, "")), (cost + 3, audit + "I"))
        return states

    states = {"": (0, "")}
    for (_, _, role, _), fault in zip(rows, faults_of(rows), strict=True):
        now = {}
        for state, (cost, audit) in after_inserts(states).items():
            ways = [(state, cost + 4, audit + "D")]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                ways += [(x, cost + 3 + more, audit + "R") for x in steps[state] if x != "s"] + [(x, cost + more, audit + "K") for x in steps[state] if x == role[:1]]
            for x, c, a in ways:
                now[x] = min(now.get(x, (10**9, "")), (c, a))
        states = now
    cost, audit = min(v for k, v in after_inserts(states).items() if k in ("", "a"))
    return cost, audit, outcome(rows, faults_of(rows), audit)[1]


def expected(rows, ids, solve):
    out = {}
    for i in ids:
        own = in_order([r for r in rows if r[0] == i])
        faults, turns = faults_of(own), [r[1] for r in own if r[1] is not None]
        cost, audit, repaired = solve(own)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[i] = (i, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "agent", "su"]
TEXTS = ["Yes.", "No!", "Why?", "cut off", "Yes.", "", " \t", None, "é. \n", "then .", "😀"]


def some(seed, ids, longest, roles=ROLES, texts=TEXTS):
    draw, rows = random.Random(seed), []
    for i in range(ids):
        for k in range(draw.randrange(longest + 1)):
            rows.append((i if i else None, draw.choice([k, k, k, k + 3, None]), draw.choice(roles), draw.choice(texts) if draw.random() < 0.5 else f"{k}. Well, {draw.random()}."))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"place": F.lit("x"), "n": F.lit(1), "digest": F.lit(None).cast("string")}).repartition(3)


def told(spark, rows, **how):
    turns = frame(spark, rows)
    return {r["conv_id"]: tuple(r) for r in conversations.summary(conversations.repair(turns, **how), turns).collect()}


def test_repairs_equal_all_sequences(spark):
    rows = some(1, 60, 4)
    assert told(spark, rows) == expected(rows, {r[0] for r in rows}, exhaustive)


def test_repairs_equal_strings(spark):
    rows = some(2, 120, 12) + some(3, 3, 60, roles=["user", "assistant", "system"])
    assert told(spark, rows) == expected(rows, {r[0] for r in rows}, by_strings)


@pytest.mark.parametrize("long_turns", [0, 7])
def test_stretches_give_the_same(spark, long_turns):
    rows = some(4, 12, 40) + [(5, 7, "user", "again."), (5, 7, "user", "again."), (5, 7, "assistant", "other."), (5, 7, "user", "more.")]
    assert told(spark, rows, long_turns=long_turns) == expected(rows, {r[0] for r in rows}, by_strings)
    one = frame(spark, rows)
    short, long = ([tuple(r) for r in conversations.repair(one, **how).orderBy("conv_id", "place").collect()] for how in ({}, {"long_turns": 0}))
    assert short == long


def test_damage_and_query_rows(spark):
    rows = [(c if c else None, t if t else None, ["user", "assistant", None][t % 3], f"Turn {t}. Is it? Yes!" if t % 5 else None) for c in range(30) for t in range(8)]
    made = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        made += [(c, t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(str, map(tuple, conversations.damaged(turns).collect()))) == sorted(map(str, made))
    ids = spark.createDataFrame([(k,) for k in [*range(30), 77]], "conv_id long")
    out = {r["conv_id"]: tuple(r) for r in conversations.summary(conversations.repair(conversations.damaged(turns)), turns.select("conv_id").unionByName(ids)).collect()}
    assert out == expected(made, {None, *range(30), 77}, by_strings)
    assert out[77] == (77, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_empty_and_one_long_text(spark):
    none = frame(spark, [(1, 0, "user", "x.")]).limit(0)
    assert conversations.repair(none).count() == 0 and conversations.damaged(none).count() == 0
    long = "word " * 2_000_000 + "."
    rows = [(1, 0, "user", long), (1, 1, "assistant", long)]
    assert told(spark, rows) == expected(rows, {1}, by_strings)


def test_layers_stay_few():
    draw = random.Random(8)
    kinds = [conversations.Kind(i, t, b) for i in "suax" for t in (False, True) for b in (False, True)]
    way, seen = conversations.Passage(conversations.starting(conversations.NOTHING)), set()
    for _ in range(20_000):
        way.add(draw.choice(kinds))
        seen.add(way.layer)
    assert len(seen) < 200
