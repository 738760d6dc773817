import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import language, neighbours
from cairn.llm.common import stage
from cairn.llm.stages import held_out

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identified(docs, held_out(3, 1)(F.col("doc_id"))).join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    test = [r for r in got if r.held_out]
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got} == {True}
    assert sum(r.lang_pred == r.lang for r in test) / len(test) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !", None), (4, "the cat", "en"), (4, "the cat", "en"), (None, "le chat", "fr")]
    docs = stage(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = language.identified(docs, F.lit(False)).collect()
    assert sorted(r.lang_pred for r in got) == ["en", "en", "fr", "und", "und", "und"]
    assert language.identified(docs.limit(0), F.lit(False)).count() == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    voters = neighbours.fitted(docs, labels, held_out(5, 0))
    got = neighbours.scored(docs, voters, held_out(5, 0)).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    kept = neighbours.accepted(docs, voters)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


@pytest.mark.parametrize("labelled", [[], [(4, 1, 0), (None, 1, 0), (99, 0, 0), (2, None, 0)]])
def test_quality_edges(spark, labelled):
    docs = stage(spark.createDataFrame([(1, None), (2, ""), (4, "some words here"), (4, "some words here")], "doc_id long, text string"))
    labels = spark.createDataFrame(labelled, "doc_id long, quality int, toxic int")
    voters = neighbours.fitted(docs, labels, held_out(5, 0))
    assert neighbours.scored(docs, voters, held_out(5, 0)).count() == 4
    assert neighbours.scored(docs.limit(0), voters, held_out(5, 0)).count() == 0


def test_quality_sample_is_bounded_for_each_label(spark):
    """A labelled doc_id repeated in documents or labels takes one place of its own label only."""
    rows = [(1, "junk # junk")] * 40 + [(2, "fine words"), (3, "more fine words"), (5, "other junk #")]
    docs = stage(spark.createDataFrame(rows, "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 0)] + [(2, 1)] * 10 + [(3, 1)] * 10 + [(5, 0)], "doc_id long, quality int")
    none = lambda doc_id: F.lit(False)
    assert sorted(neighbours.fitted(docs, labels, none, 2).labels.tolist()) == [0, 0, 1, 1]


def grams_of(text):
    """Letters alone, and runs of two and three around which white space and signs are one edge."""
    out, padded = [], "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    padded = " " + " ".join(padded.split()) + " "
    out += [c for c in padded if c != " "]
    out += [padded[i : i + 2] for i in range(len(padded) - 1) if padded[i : i + 2] != "  "]
    out += [padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != " "]
    return Counter(out)


def gram_key(g):
    return tuple([0] * (3 - len(g)) + [1 if c == " " else ord(c) for c in g])


def top_of(counts, top):
    order = sorted(counts, key=lambda g: (-counts[g], gram_key(g)))[:top]
    return {g: k for k, g in enumerate(order)}


def test_language_matches_brute_force(spark, words):
    r = np.random.default_rng(3)
    alphabets = {"aa": "abcdé", "bb": "abxyz", "cc": "щшъab"}
    make = lambda letters, n: " ".join("".join(r.choice(list(letters), r.integers(1, 7))) for _ in range(n))
    rows = [(i, make(a, int(r.integers(1, 60))) + "." * (i % 3), lang, 7, "x") for i, (lang, a) in enumerate(list(alphabets.items()) * 20)]
    rows += [(200, make("abcdé", 30_000), "aa", 7, "x"), (201, make("abcxy", 40), None, 7, "x"), (None, make("abxyz", 9), "bb", 7, "x"), (3, rows[3][1], rows[3][2], 7, "x"), (202, "12 ! 3", "cc", 7, "x")]
    docs = stage(spark.createDataFrame(rows, "doc_id long, text string, lang string, gram int, rank string"))
    got = language.identified(docs, F.col("doc_id") % 4 == 1).collect()
    counts = defaultdict(Counter)
    for doc_id, text, lang, *_ in rows:
        if lang and (doc_id is None or doc_id % 4 != 1):
            counts[lang] += grams_of(text)
    profiles = {lang: top_of(c, language.TOP) for lang, c in sorted(counts.items())}
    want = Counter()
    for doc_id, text, *_ in rows:
        own = top_of(grams_of(text), language.TOP)
        far = {lang: sum(abs(k - p[g]) if g in p else language.TOP for g, k in own.items()) for lang, p in profiles.items()}
        best = min(far, key=far.get) if own else "und"
        want[doc_id, doc_id is not None and doc_id % 4 == 1, best, round(1 - far[best] / (language.TOP * len(own)), 9) if own else 0.0] += 1
    assert Counter((x.doc_id, x.held_out, x.lang_pred, round(x.score, 9)) for x in got) == want


def test_votes_match_brute_force(spark, words):
    """Scores from the definition: projected cosines with all voters, the nearest of them weighted by similarity."""
    texts = [words(5 + 3 * i % 70, i) for i in range(60)] + [words(20, i).upper() + " # $" for i in range(40)] + [None, "", words(20_000, 5)] + [words(9, 3)] * 3
    rows = [(None if i == 51 else i, t, "x", 4) for i, t in enumerate(texts)]
    docs = stage(spark.createDataFrame(rows, "doc_id long, text string, quality string, weights int"))
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(0, 100, 2)], "doc_id long, quality int")
    voters = neighbours.fitted(docs, labels, lambda c: c % 3 == 0, 12)
    assert Counter(voters.labels.tolist()) == {0.0: 12, 1.0: 12}
    got = neighbours.scored(docs, voters, lambda c: c % 3 == 0).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for x in got:
        by_id[x.doc_id].append(x)
    for doc_id, t, *_ in rows:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        v = neighbours.term_weights(raw, np.array([0, len(raw)]))[0] @ voters.space
        near = voters.vectors @ (v / max(np.linalg.norm(v), 1e-9))
        top = sorted(range(len(near)), key=lambda k: -near[k])[: neighbours.NEAREST]
        vote = [max(float(near[k]), 0.0) ** neighbours.SHARPNESS for k in top]
        want = sum(x * voters.labels[k] for x, k in zip(vote, top)) / sum(vote) if sum(vote) and (t or "").split() else voters.mean
        assert any(math.isclose(x.score, want, abs_tol=1e-4) for x in by_id[doc_id])
        assert all(x.predicted == int(x.score >= 0.3) and x.held_out == (doc_id is not None and doc_id % 3 == 0) for x in by_id[doc_id])


def test_blocks_of_rows_do_not_change_scores(spark, words, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    docs = stage(docs)
    voters = neighbours.fitted(docs, spark.read.parquet(f"{SF}/labels.parquet"), held_out(5, 0))
    one = {r.doc_id: r.score for r in neighbours.scored(docs, voters, held_out(5, 0)).collect()}
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 7)
    two = {r.doc_id: r.score for r in neighbours.scored(docs, voters, held_out(5, 0)).collect()}
    assert one.keys() == two.keys() and all(math.isclose(one[k], two[k], abs_tol=1e-5) for k in one)
