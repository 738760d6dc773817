import random
from collections import Counter

import pytest

from cairn.llm import suffix_dedup as sd


def brute(texts):
    """Per text: (bytes, removed, spans, rest)."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + sd.LENGTH] for x in raw for i in range(len(x) - sd.LENGTH + 1))
    out = []
    for x in raw:
        spans = sd.merged_spans([(i, i + sd.LENGTH) for i in range(len(x) - sd.LENGTH + 1) if seen[x[i : i + sd.LENGTH]] > 1])
        rest, at = b"", 0
        for a, b in spans:
            rest, at = rest + x[at:a], b
        rest += x[at:]
        out.append((len(x), len(x) - len(rest), len(spans), rest))
    return out


def corpus(words):
    long, passage = words(400, 1), words(60, 2)
    texts = [None, "", "short", "short", long, long, "é" * 150, "a" * 900, "ab" * 400, "xa" * 90 + "ab" * 120]
    for i in range(40):
        own = words(80, 100 + i)
        texts.append(own[:137] + passage + own[137:] if i % 2 else own + passage[:230 + i])
        near = long.split(" ")
        near[7 * i % 400] = f"new{i}"
        near[(31 * i + 200) % 400] = f"other{i}"
        texts.append(" ".join(near))
    texts += [words(3000, 7) + passage, words(3000, 7)[500:900] + "é", long + long]
    return texts


def run(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "keep", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, seed string, row_id int").repartition(3)
    docs = sd.stage(docs)
    return docs, sd.deduplicated(docs).collect()


@pytest.mark.parametrize("range_, run_, most", [(60_000, 50_000, 4096), (40, 30, 4096), (3, 11, 4096), (40, 30, 2), (3, 11, 3)])
def test_matches_brute_force(spark, words, monkeypatch, range_, run_, most):
    """One range; ranges of whole seeds; ranges that cut through seeds; both also in two levels."""
    for name, value in (("RANGE", range_), ("RUN", run_), ("SAMPLED", 1), ("MOST_RANGES", most)):
        monkeypatch.setattr(sd, name, value)
    texts = corpus(words)
    docs, got = run(spark, texts)
    want = brute(texts)
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id], r.doc_id
    assert sum(r.n_removed for r in got) > 20_000
    ways = Counter(r.way for r in sd.removed_spans(sd.numbered(docs)).collect())
    assert ways["merge"] > 10 and (ways["seam"] > 0) == (range_ == 3)


def test_most_spans_come_from_the_merge(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ways = Counter(r.way for r in sd.removed_spans(sd.numbered(docs)).select("way").collect())
    assert ways["merge"] > 0.5 * sum(ways.values()) and not ways["seam"]


def test_two_levels_part_a_range(monkeypatch):
    monkeypatch.setattr(sd, "RANGE", 10)
    r = random.Random(2)
    entries = sorted(bytes(r.randrange(256) for _ in range(50)) for _ in range(100))
    known, sizes, tails = sd.front_coded(entries)
    import pyarrow as pa

    (cuts,) = sd.own_separators(pa.table([pa.array([4] * 100, pa.int32()), pa.array(entries), pa.array([100] * 100)], ["range", "head", "n"])).column("cuts").to_pylist()
    assert len(cuts) == 9
    meta = b"".join((i).to_bytes(8, "little") * 3 for i in range(100))
    row = pa.RecordBatch.from_pylist([{"range": 4, "sub": 0, "below": b"b", "above": b"a", "shared": known.tobytes(), "sizes": sizes.tobytes(), "tails": tails, "meta": meta, "cuts": cuts}])
    (out,) = (b.to_pylist() for b in sd.cut_again([row]))
    import numpy as np

    assert [x for part in out for x in sd.decoded(*(np.frombuffer(part[c], np.uint16) for c in ("shared", "sizes")), part["tails"])] == entries
    assert b"".join(p["meta"] for p in out) == meta and [p["sub"] for p in out] == list(range(10))
    assert [(p["below"], p["above"]) for p in out] == list(zip([b"b", *cuts], [*cuts, b"a"]))


def test_separators_keep_seeds_whole_while_they_can():
    r = random.Random(4)
    heads = [bytes([r.randrange(3)]) * sd.SEED + bytes(r.randrange(256) for _ in range(40)) for _ in range(300)]
    assert sd.separators(heads, 1) == sd.separators([], 5) == []
    few, many = sd.separators(heads, 3), sd.separators(heads, 30)
    assert {len(x) for x in few} == {sd.SEED} and len(many) == 29
    for cuts in (few, many):
        assert cuts == sorted(set(cuts))


def test_long_rows_come_in_pieces(spark, words, monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 3000)
    texts = [words(4000, 5), words(4000, 5)[3000:9000], words(500, 6)]
    _, got = run(spark, texts)
    want = brute(texts)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]


def test_empty_table_and_repeated_ids(spark, words):
    _, got = run(spark, [])
    assert got == []
    text = words(100, 3)
    _, got = run(spark, [text, text, None], ids=[1, 1, None])
    assert sorted(r.n_removed for r in got) == [0, len(text), len(text)]


def test_loser_tree_orders_and_knows_prefixes():
    data = [b"banana", b"band", b"ban", b"", b"apple", b"banana", b"bandana", b"z"]
    runs, shared = [], []
    for part in (data[:3], data[3:5], data[5:]):
        part = sorted(part)
        known, sizes, tails = sd.front_coded(part)
        assert sd.decoded(known, sizes, tails) == part
        runs.append(part)
        shared.append(known.tolist())
    order, prefixes = sd.merged(runs, shared)
    out = [runs[r][i] for r, i in order]
    assert out == sorted(data)
    assert prefixes[1:] == [sd.common_prefix(a, b, 0) for a, b in zip(out, out[1:])]
