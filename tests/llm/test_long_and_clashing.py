"""Very long texts and columns with the operators' own names."""

import zlib

import numpy as np
from pyspark.sql import functions as F
from test_quality_rules import brute

from cairn.llm import language, neighbours, quality_rules, sharding
from cairn.llm.common import PRIME, PrimeHash, SpanHash, WordHash, residues, running, stage, times

CLASHES = "held_out int, lang_pred string, score string, predicted string, row_id string, gram int, group string, n int, label string, weights int, vectors string, shard string, size string, kept string"


def table(spark, texts):
    rows = [(i, t, "en" if i % 2 else "fr", *["0" if "string" in c else 0 for c in CLASHES.split(", ")]) for i, t in enumerate(texts)]
    return stage(spark.createDataFrame(rows, f"doc_id long, text string, lang string, {CLASHES}"))


def test_operators_with_clashing_columns_and_texts_of_megabytes(spark, words):
    long = words(500_000, 1) + " é漢 " + words(50, 2)
    texts = [long, "le chat " * 50, long, "the cat sat " * 300_000, "x" * 2_000_000, None, "", "le chien dort " * 30, "the dog sleeps " * 30]
    docs = table(spark, texts)
    plain = docs.select("doc_id", "text", "lang")
    by_id = lambda rows: sorted(map(tuple, rows.collect()), key=str)
    none = lambda c: F.lit(False)
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int")
    identified = by_id(language.identified(docs, F.lit(False)))
    assert identified == by_id(language.identified(plain, F.lit(False))) and len(identified) == 9
    voters = neighbours.fitted(docs, labels, none)
    scores = by_id(neighbours.scored(docs, voters, none))
    assert scores == by_id(neighbours.scored(plain, voters, none)) and len(scores) == 9
    judged = {r.doc_id: r for r in quality_rules.judged(docs, labels).collect()}
    assert {i: tuple(judged[i])[1:7] for i in range(9) if i != 4} == {i: brute(texts[i]) for i in range(9) if i != 4}
    sizes = {r.doc_id: (r["size"], r.text_crc32) for r in sharding.sharded(docs, 3).collect()}
    assert sizes == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)}


def test_grams_of_more_letters_and_groups_than_a_number_holds(monkeypatch):
    texts = ["".join(chr(0x4E00 + (7 * i * k) % 900) for k in range(40)) + " ab ab" for i in range(60)]
    groups = np.arange(60) % 25
    one = language.gram_counts(texts, groups)
    monkeypatch.setattr(language, "KEY_BITS", 10)
    assert all((a == b).all() for a, b in zip(one, language.gram_counts(texts, groups)))


def test_fingerprints():
    r = np.random.default_rng(1)
    a, b = (r.integers(0, PRIME, 500, dtype=np.uint64) for _ in range(2))
    assert times(a, b).tolist() == [int(x) * int(y) % PRIME for x, y in zip(a, b)]
    assert residues(12345, 70).tolist() == [pow(12345, i, PRIME) for i in range(70)]
    assert running(np.arange(10, dtype=np.uint64)).tolist() == [0, *np.cumsum(np.arange(10)).tolist()]
    data = r.integers(0, 256, 20_000).astype(np.uint8)
    twice = np.concatenate((data, data))
    start = r.integers(0, 15_000, 300)
    end = start + r.integers(0, 5000, 300)
    for kind in (SpanHash, PrimeHash, WordHash):
        spans = kind(twice)
        assert (spans.of(start, end) == spans.of(start + 20_000, end + 20_000)).all()
        assert len(np.unique(spans.of(start, end))) == len({data[s:e].tobytes() for s, e in zip(start, end)})
    # Thue-Morse texts and their complements agree modulo 2**64, whatever the base.
    turn = np.array([bin(i).count("1") % 2 for i in range(4096)], np.uint8)
    both, ends = np.concatenate((turn, 1 - turn)), (np.array([0, 4096]), np.array([4096, 8192]))
    assert len(set(SpanHash(both).of(*ends).tolist())) == 1 and len(set(WordHash(both).of(*ends).tolist())) == 2
