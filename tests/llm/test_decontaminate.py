import hashlib
import re

import pytest

from cairn.llm import decontaminate as dc
from cairn.llm.common import stage


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    own = words_of(text)
    hit, found = set(), set()
    for item, t in items:
        w = words_of(t)
        n = min(10, len(w))
        windows = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
        for i in range(len(own) - n + 1 if n else 0):
            if tuple(own[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item) if item is not None else "")
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_words", [2_000_000, 40])
def test_matches_brute_force(spark, words, block_words):
    items = [(i, words(9 + i, i, 60)) for i in range(25)] + [(100, "Three small words"), (101, None), (102, "... !"), (3, words(20, 77, 60)), (None, "null id item " * 5), (104, "É0 über a a a a a a a a a a a")]
    texts = [None, "", "!!", "three small", "x THREE-small/words y", "null id item " * 9, "a " * 30, "É0 über a a a a a a a a", "É0 ÜBER" + " a" * 12]
    texts += [words(300, 500 + i, 60) + " " + (items[i % 25][1] or "").upper() + " " + words(50, 900 + i, 60) for i in range(60)]
    texts += [words(8, 3, 60), items[4][1] + "\n" + items[5][1], "pre" + items[6][1]]
    docs = stage(spark.createDataFrame([(i % 65, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = dc.contamination(docs, bench, block_words=block_words)
    got = dict()
    for r in dc.report(docs, bench).collect() if block_words > 40 else found.select("doc_id", "n_words", dc.hit_words(dc.F.col("hits")).alias("n_hit"), dc.F.size(dc.F.array_distinct("items")).alias("n_items")).collect():
        got.setdefault(r[0], []).append(tuple(r)[1:])
    want = dict()
    for i, t in enumerate(texts):
        want.setdefault(i % 65, []).append(brute(t, items)[: len(got[0][0])])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert sum(v[0][1] > 0 for v in want.values()) > 40


def test_longest_matches(spark, words):
    item = words(40, 1)
    text = words(20, 2) + " " + " ".join(item.split()[5:30]) + " " + words(20, 3)
    docs = stage(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    (r,) = dc.contamination(docs, spark.createDataFrame([("q", item)], "item_id string, text string")).collect()
    assert [tuple(m) for m in r.matches] == [("q", 5, 20, 25)]
    assert [tuple(h) for h in r.hits] == [(20, 45)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:4] for r in dc.report(docs, none).collect()] == [(2, 0, 0)]
    assert dc.report(docs.limit(0), none).count() == 0


def test_one_block_at_a_time(spark, words, monkeypatch):
    """Five blocks: windows of one are held while its pass runs, and the findings are those of one block."""
    import weakref

    held, most = weakref.WeakSet(), []

    class Watched(dc.TestWindows):
        def __init__(self, *a):
            super().__init__(*a)
            held.add(self)
            most.append(len(held))

    items = [(i, words(12 + i % 9, i, 60)) for i in range(120)]
    docs = stage(spark.createDataFrame([(i, words(60, 900 + i, 60) + " " + items[i][1] + " " + items[-i][1]) for i in range(120)], "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    shown = lambda f: sorted((r.doc_id, r.n_words, tuple(sorted(set(r["items"]))), r.n_hit) for r in f.select("doc_id", "n_words", "items", dc.hit_words(dc.F.col("hits")).alias("n_hit")).collect())
    whole = shown(dc.contamination(docs, bench))
    monkeypatch.setattr(dc, "TestWindows", Watched)
    size = sum(len(t) for _, t in items)
    assert shown(dc.contamination(docs, bench, block_words=-(-size // 4 // 5) + 1)) == whole
    assert len(most) == 5 and max(most) == 1


def test_long_texts_and_words_built_against_polynomials(spark, words):
    turn = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = turn.translate(str.maketrans("ab", "ba"))
    item = " ".join([turn, *words(9, 5).split()])
    long = words(400_000, 6) + " " + item + " " + words(10, 7)
    texts = [long, item.replace(turn, other), item, "x" * 3_000_000]
    docs = stage(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in dc.report(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {0: (400_020, 10, True), 1: (10, 0, False), 2: (10, 10, True), 3: (1, 0, False)}
