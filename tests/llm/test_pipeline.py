"""Each stage against plain brute force on what the one before kept, and the whole run."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cairn.llm import neighbours, stages
from cairn.llm import suffix_dedup as sd
from cairn.llm.common import stage

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text):
    w = lowered(text)
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset()


def near(rows):
    """The first row of each class, rows in order."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 5 * len(a & b) >= 4 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    return [r for i, r in enumerate(rows) if root[i] == i]


def cut(rows):
    raw = [(r[1] or "").encode() for r in rows]
    seen = Counter(x[i : i + 200] for x in raw for i in range(len(x) - 199))
    out = []
    for r, x in zip(rows, raw):
        gone = sd.merged_spans([(i, i + 200) for i in range(len(x) - 199) if seen[x[i : i + 200]] > 1])
        if not gone:
            out.append(r)
            continue
        at, rest = 0, b""
        for a, b in gone:
            rest, at = rest + x[at:a], b
        text = (rest + x[at:]).decode("utf-8", "ignore")
        if text.strip():
            out.append((r[0], text, len(text), *r[3:]))
    return out


def clean(rows, items):
    windows = set()
    for t in items:
        w = lowered(t)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes = {len(x) for x in windows}
    hit = lambda w: any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    return [r for r in rows if not hit(lowered(r[1]))]


@pytest.fixture
def tables(spark, words, tmp_path):
    """Documents with clashing columns, nulls, repeated rows and ids, copies, shared passages and benchmark windows."""
    passage, item = words(60, 901, 5000), words(14, 902, 5000)
    texts = [None, "", "  ", "éa " * 3, words(30, 1)]
    for k in range(12):
        base = words(70 + k, 100 + k, 5000)
        texts += [base, base.upper(), base + " tail end"] if k % 2 else [base, base]
    texts += [words(90, 300 + k, 5000) + " " + passage + "é" * (k % 3) + " " + words(40, 400 + k, 5000) for k in range(8)] + [passage]
    texts += [words(50, 500, 5000) + " " + item + " " + words(20, 501, 5000), item[: len(item) // 2], words(3000, 7, 5000)]
    rows = [(None if i == 6 else i - (i == 9), t, None if t is None else len(t), "x", i % 4, i) for i, t in enumerate(texts)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long, seed string, row_id int, place long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "zz zz zz")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(5, 30)] + [(None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()], [item, None, "", "zz zz zz"]


def rows_of(frame):
    return [tuple(r) for r in frame.collect()]


def same(got, want):
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_stages_and_run_match_brute_force(spark, tables):
    folder, rows, items = tables
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_strings", "decontaminate", "pack"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    voters = neighbours.fitted(docs, spark.read.parquet(f"{folder}/labels.parquet"), stages.held_out(5, 0))
    assert set(voters.labels.tolist()) == {1.0}
    same(rows_of(stages.quality(spark, docs, folder)), rows)
    want = near(rows)
    got = stage(stages.near_duplicates(spark, docs, folder))
    assert got.columns == docs.columns and len(want) < len(rows)
    same(rows_of(got), want)
    # One partition, so that what follows sees the rows in one order.
    docs, want_cut = stage(got.coalesce(1)), cut(want)
    got = stage(stages.repeated_strings(spark, docs, folder))
    assert got.columns == docs.columns and len(want_cut) < len(want)
    same(rows_of(got), want_cut)
    docs, want_clean = got, clean(want_cut, items)
    got = stage(stages.clean_of_benchmark(spark, docs, folder))
    assert got.columns == docs.columns and len(want_clean) == len(want_cut) - 1
    same(rows_of(got), want_clean)
    tool = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {(r[0], i): [*tool.encode(r[1] or "", add_special_tokens=False).ids, 2] for i, r in enumerate(want_clean)}
    for packed in (stages.packed(spark, got, folder), corpus_pipeline.run(spark, folder)):
        by_window, pieces = defaultdict(list), Counter()
        for r in packed.collect():
            by_window[r.sequence_id].append((r.offset, r.length))
            pieces[r.doc_id, r.doc_tokens] += r.length
        for window in by_window.values():
            at = 0
            for offset, length in sorted(window):
                assert offset == at
                at += length
            assert at <= 4096
        lengths = Counter()
        for (doc_id, _), x in ids.items():
            lengths[doc_id, len(x)] += len(x)
        assert pieces == lengths
    whole = [r for r in stages.packed(spark, got, folder).collect() if r.start == 0 and r.length == r.doc_tokens]
    assert len(whole) > 10
    crcs = {zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids.values()}
    assert all(r.ids_crc32 in crcs for r in whole)


def test_quality_stage_rejects_what_labels_reject(spark, words, tmp_path):
    good, bad = [words(60, i) for i in range(40)], [("## $$ " + words(6, i).upper() + " !! ") * 9 for i in range(40)]
    docs = stage(spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(good + bad)], "doc_id long, text string, n_chars long"))
    spark.createDataFrame([(i, int(i < 40)) for i in range(80) if i % 2], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.doc_id for r in stages.quality(spark, docs, str(tmp_path)).collect()} == set(range(40))


def test_empty_table(spark, tables):
    folder = tables[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, folder))
        assert docs.count() == 0
        assert name == "pack" or len(docs.columns) == 6


def test_task_code_needs_no_package_on_executors(spark):
    """What is broadcast is plain arrays."""
    import pickle

    voters = neighbours.Voters(np.eye(4, neighbours.TERMS), np.array([0, 1, 0, 1]))
    shared = neighbours.broadcast_arrays(spark, voters)
    assert b"cairn" not in pickle.dumps(shared.value)
