import random
import re

import numpy as np
import pytest

from cairn.llm import near_join as nj
from cairn.llm.common import stage
from cairn.llm.components import components


def shingles(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset()


def brute(texts):
    sets = [shingles(t) for t in texts]
    links = [[j for j in range(len(sets)) if j != i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(sets))]
    root = list(range(len(sets)))
    for _ in sets:
        for i in range(len(sets)):
            root[i] = min([root[i], *(root[j] for j in links[i])])
    return [len(x) for x in links], root


def edited(text, r, n):
    w = text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("leaf", [1000, 12])
def test_matches_brute_force(spark, words, monkeypatch, leaf):
    monkeypatch.setattr(nj, "LEAF", leaf)
    r = random.Random(5)
    texts = [None, "", "...", "one two", "One TWO!", "one two three", "a b c d e", "a b c d e f"]
    for k in range(12):
        base = words(120 + 30 * k, k, 3000)
        texts += [base, base.upper(), *(edited(base, r, r.randrange(1, 6)) for _ in range(6))]
    base = words(150, 99, 3000)
    texts += [edited(base, r, 1) for _ in range(60)] + [words(200, 1000 + i, 3000) for i in range(40)] + [base] * 30
    docs = stage(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, id int").repartition(3))
    n_links, root = brute(texts)
    got = {x.doc_id: x for x in nj.classed(docs).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i].class_id, got[i].n_links, got[i].n_class) == (root[i], n_links[i], root.count(root[i])), i
    assert nj.surplus(docs).count() == len(texts) - len(set(root))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (200, 201)] + [(500, 500 + i) for i in range(1, 30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[95] == 90 and got[201] == 200
    assert all(got[500 + i] == 500 for i in range(30))


def test_empty_and_null_ids(spark):
    docs = stage(spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, None)], "doc_id long, text string"))
    assert sorted((r.n_links, r.n_class) for r in nj.classed(docs).collect()) == [(0, 1), (1, 2), (1, 2)]
    assert nj.classed(stage(docs.limit(0))).count() == 0


def held_to_brute(spark, texts):
    docs = stage(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    n_links, root = brute(texts)
    got = {x.doc_id: x for x in nj.classed(docs).collect()}
    assert [(got[i].class_id, got[i].n_links, got[i].n_class) for i in range(len(texts))] == [(root[i], n_links[i], root.count(root[i])) for i in range(len(texts))]


def test_crowded_leaves_are_finished_whatever_the_rounds(spark, words, monkeypatch):
    """Pages of one template, unlike each other but for pairs of near copies."""
    monkeypatch.setattr(nj, "LEAF", 8)
    monkeypatch.setattr(nj, "ROUNDS", 1)
    monkeypatch.setattr(nj, "DEPTH", 0)
    monkeypatch.setattr(nj, "RUNS", 3)
    r, template, texts = random.Random(3), words(160, 1, 5000), []
    for k in range(25):
        page = template + " " + words(75, 100 + k, 5000)
        texts += [page, edited(page, r, 2)]
    held_to_brute(spark, texts)


def test_a_bridge_between_clusters_is_found():
    """Two sets that heads of their own take, alike only to each other."""
    j = np.arange(nj.COORDINATES, dtype=np.uint16)
    k, h = j.copy(), j.copy()
    k[:18] += 1000
    h[88:] += 2000
    g = k.copy()
    g[88:] += 3000
    tokens, label = np.array([h, g, j, k]), np.arange(4)
    alike = (tokens[:, None] == tokens[None]).mean(axis=2) >= nj.LOOKS_ALIKE
    assert alike[2, 3] and alike[0, 2] and alike[1, 3] and not alike[0, 1] and not alike[0, 3] and not alike[1, 2]
    a, b = nj.linked(label, tokens, np.zeros(4, int), False)
    assert {frozenset(x) for x in zip(a, b)} == {frozenset((0, 2)), frozenset((1, 3)), frozenset((2, 3))}
    a, b = nj.linked(label, tokens, np.array([0, 1, 0, 1]), True)
    assert frozenset((2, 3)) in {frozenset(x) for x in zip(a, b)}


def test_recall_among_look_alikes(spark, words):
    """Pairs at 0.8 and little more, each side among variants that look alike and aren't linked: all links are counted."""
    r, texts = random.Random(9), []
    for k in range(12):
        base = words(300, 2000 + k, 50_000)
        near = base.split(" ")
        for at in range(6):
            near[50 * at + 7] = f"n{k}x{at}"
        for side in (base, " ".join(near)):
            texts.append(side)
            for v in range(9):
                own = side.split(" ")
                for at in r.sample(range(0, 300, 6), 10):
                    own[at] = f"v{r.randrange(10**9)}"
                texts.append(" ".join(own))
    order = list(range(len(texts)))
    r.shuffle(order)
    texts = [texts[i] for i in order]
    n_links, root = brute(texts)
    docs = stage(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    got = {x.doc_id: x for x in nj.classed(docs).collect()}
    found, all_ = sum(x.n_links for x in got.values()), sum(n_links)
    assert all_ > 20 and found >= 0.99 * all_, (found, all_)


def test_runs_follow_from_the_recall():
    assert nj.runs_for(0.9997) == nj.RUNS == 8 and nj.runs_for(0.9) == 3
