"""Turn repair against all repairs of small conversations, and against a linear search of states for long ones."""

import random
import re
from itertools import product

from cairn.llm import turn_repair
from cairn.llm.common import stage

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
TEXTS = ["Done.", "Really?", "no end", "", " \t", "Same."]


def every_repair(turns, most=5):
    """(cost, audit) of all repairs by up to ``most`` insertions between turns; texts and roles are followed apart."""
    kinds = turn_repair.faults(turns)
    found = []

    def walk(i, cost, audit, letters, left):
        if left:
            for x in "ua":
                walk(i, cost + 2, audit + "I", letters + x, left - 1)
        if i == len(turns):
            if GRAMMAR.match(letters):
                found.append((cost, audit, letters))
            return
        more = kinds[i] == "truncated"
        walk(i + 1, cost + 3, audit + "D", letters, left)
        if kinds[i] not in ("blank", "duplicate"):
            walk(i + 1, cost + more, audit + "K", letters + turn_repair.initial_of(turns[i][0]), left)
            for x in "ua":
                walk(i + 1, cost + 2 + more, audit + "R", letters + x, left)

    walk(0, 0, "", "", most)
    return min(found)[:2]


def test_small_conversations_by_all_repairs():
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "admin"]
    for n in range(5):
        for _ in range(25):
            turns = [(rng.choice(roles), rng.choice(TEXTS) + rng.choice(["", "x."])) for _ in range(n)]
            done = turn_repair.repair([(i, *t) for i, t in enumerate(turns)])
            assert done[5:7] == every_repair(turns, 4), turns
            assert GRAMMAR.match("".join(turn_repair.initial_of(r) for r, _ in done[-1]))
    for roles in product(["user", "assistant", "system"], repeat=3):
        turns = [(r, f"{i}.") for i, r in enumerate(roles)]
        assert turn_repair.repair([(None, *t) for t in turns])[5:7] == every_repair(turns, 4), turns


def by_states(turns):
    """Least (cost, audit) by states of the grammar, turn by turn."""
    states = {"": (0, "")}

    def grown(now):
        for _ in range(2):
            for last, (cost, audit) in list(now.items()):
                key = "a" if last == "u" else "u"
                now[key] = min(now.get(key, (1 << 30, "")), (cost + 2, audit + "I"))
        return now

    states = grown(states)
    for (role, _), kind in zip(turns, turn_repair.faults(turns)):
        new, more = {}, kind == "truncated"

        def put(key, value):
            new[key] = min(new.get(key, (1 << 30, "")), value)

        for last, (cost, audit) in states.items():
            put(last, (cost + 3, audit + "D"))
            if kind not in ("blank", "duplicate"):
                wanted = "a" if last == "u" else "u"
                put(wanted, (cost + 2 + more, audit + "R"))
                if role[:1] == wanted or (role[:1] == "s" and not last):
                    put(role[:1], (cost + more, audit + "K"))
        states = grown(new)
    return min(states[x] for x in ("", "a") if x in states)


def test_long_conversations_by_states():
    rng = random.Random(8)
    for n, steady in ((40, 0.8), (200, 0.9), (1500, 0.97), (300, 0.3)):
        turns = [("system", "Begin.")]
        for i in range(n):
            role = ("user", "assistant")[i % 2] if rng.random() < steady else rng.choice(["user", "assistant", "system", "tool"])
            turns.append((role, f"{i}" + rng.choice([".", "!", "", "?"])) if rng.random() < 0.95 else ("user", ""))
        cost, audit, _ = turn_repair.cheapest("".join(turn_repair.initial_of(r) for r, _ in turns), turn_repair.faults(turns))
        assert (cost, audit) == by_states(turns)


def test_edges(spark):
    rows = [(None, None, None, None), (1, 2, "assistant", "b."), (1, 1, "user", "a."), (1, 1, "user", "a."), (2, None, "user", "x"), (2, 5, "assistant", "y."), (2, 9, "user", "z."), (3, 0, "user", "long " * 200_000 + "."), (4, 0, "s", "only.")]
    table = stage(spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, cost string").repartition(4))
    got = {r.conv_id: r for r in turn_repair.repaired(table).collect()}
    turns = lambda c: [(t.role, t.text) for t in got[c].turns]
    assert (got[None].blank, got[None].cost, got[None].audit, turns(None)) == (1, 3, "D", [])
    assert (got[1].duplicate, got[1].illegal, got[1].audit, turns(1)) == (1, 1, "KDK", [("user", "a."), ("assistant", "b.")])
    assert (got[2].gaps, got[2].truncated, got[2].cost, got[2].audit) == (3, 1, 3, "KKKI") and turns(2)[-1] == ("assistant", "")
    assert got[3].audit == "KI" and len(turns(3)[0][1]) == 1_000_001 and (got[4].audit, got[4].cost) == ("D", 3)
    assert turn_repair.repaired(table.limit(0)).count() == 0


def test_damage(spark):
    import zlib

    rows = [(c, t, None if c == 7 else "assistant", "One. Two!") for c in range(40) for t in range(6)] + [(5, None, "user", None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in rows:
        fault, role, text = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20, role or " ", text or " "
        text = {0: "", 1: "", 2: text.replace(".", "").replace("!", "")}.get(fault, text)
        want += [(c, t, "user" if fault == 4 else role, text, fault == 0)] * (2 if fault == 3 else 1)
    assert sorted(map(str, map(tuple, turn_repair.damaged(table).collect()))) == sorted(map(str, want))
    whole = turn_repair.repaired(turn_repair.damaged(table))
    assert {r.conv_id for r in whole.collect()} == set(range(40))
