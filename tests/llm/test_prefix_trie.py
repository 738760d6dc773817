"""The burst trie against a trie of tuples."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from cairn.llm import prefix_trie
from cairn.llm.common import stage

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    """Nodes of rebuilt conversations, as sorted tuples."""
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, digest(role or "", text or "")[:32], len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        made = own.get(first, [])[:h] + turns[h:]
        for d in range(len(made) + 1):
            members[tuple(made[:d])].append((c, d == len(made)))
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    out = []
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        leaves = sum(sums[k][0] for k in children[node]) or 1
        saved = sum(sums[k][1] for k in children[node]) + ((len(members[node]) - 1) * node[-1][1] if node else 0)
        sums[node] = leaves, saved
        ends = ",".join(str(c) for c in sorted(c for c, last in members[node] if last))
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        out.append((min(c for c, _ in members[node]), len(node), parent, len(members[node]), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def made(spark, rows, **limits):
    table = stage(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3))
    return sorted(repr(tuple(r)) for r in prefix_trie.conversation_trie(table, **limits).collect())


def families(seed):
    """Conversations that share long beginnings, end inside one another, repeat wholly, and stand alone."""
    rng, rows = random.Random(seed), []
    for c in range(-30, 170):
        kind = rng.random()
        if kind < 0.4:
            turns = [("user", "hello there"), ("assistant", "the same long  answer\tevery time")] * 3 + [(rng.choice(["user", "u"]), rng.choice("abcde")) for _ in range(rng.randrange(4))]
            turns = turns[: rng.randrange(len(turns) + 1)] or [(None, None)]
        elif kind < 0.6:
            turns = [("system", "one"), ("user", "two words"), ("assistant", "three")]
        else:
            turns = [(rng.choice(["user", "assistant", None]), rng.choice([None, "", "a b", f"{rng.random()} x"])) for _ in range(rng.randrange(1, 6))]
        rows += [(c * rng.choice([1, 1, 7]), None if rng.random() < 0.05 else i, *t) for i, t in enumerate(turns)]
    return rows + [(None, 0, "user", "of no conversation"), (3, 1, "user", "twice"), (3, 1, "user", "twice")]


@pytest.mark.parametrize("limits", [{}, {"most_sequences": 3}, {"most_sequences": 1, "most_bytes": 1}])
def test_nodes_by_brute_force(spark, limits):
    rows = families(len(limits))
    assert made(spark, rows, **limits) == brute(rows)


def test_chains_copies_and_a_long_conversation(spark):
    """A chain of conversations that end one after another, copies that hold a third of all, and one of 3000 turns."""
    rows = [(c, i, "user", f"t{i}") for c in range(0, 24) for i in range(c + 1)]
    rows += [(100 + c, i, "user", "copy " * 3) for c in range(120) for i in range(4)]
    rows += [(7_000_000_000, i, "assistant", f"{i % 11}") for i in range(3000)] + [(4096 * 5 + c, 0, "user", "blocks") for c in range(3)]
    assert made(spark, rows, most_sequences=2) == brute(rows)


def test_few_rows(spark):
    assert made(spark, []) == []
    for rows in ([(5, 0, "user", "only")], [(20, 0, "user", "a"), (21, 0, "user", "b")], [(None, 0, "user", "x"), (40, None, None, None)]):
        assert made(spark, rows) == brute(rows)
