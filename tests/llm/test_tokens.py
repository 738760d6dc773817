import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairn.llm import packing, wavelet
from cairn.llm.common import stage
from cairn.llm.tokens import ChunkEncoder

PATH = P.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
CHUNKED = ChunkEncoder(PATH)


def want_ids(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [2]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list(" \n\t'’sStT́İΣ09.,!éß"))), max_size=60), max_size=4))
def test_chunks_give_the_ids_of_whole_texts(texts):
    ids, offsets = CHUNKED.encode(texts)
    assert len(offsets) == len(texts) + 1
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == want_ids(t)


def test_every_character_before_a_stop():
    """What a letter becomes when normalised decides whether the stop after it is a word of its own."""
    texts = [f"x{chr(c)}{stop}" for c in range(0x110000) if not 0xD800 <= c < 0xE000 for stop in (". y", ",")]
    for at in range(0, len(texts), 200_000):
        part = texts[at : at + 200_000]
        ids, offsets = CHUNKED.encode(part)
        ids, offsets = ids.tolist(), offsets.tolist()
        wrong = [t for t, a, b, want in zip(part, offsets, offsets[1:], WHOLE.encode_batch_fast(part, add_special_tokens=False)) if ids[a : b - 1] != want.ids]
        assert wrong == []


def test_every_stop_after_a_letter():
    stops = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    texts = [f"{x}{a}{b}{end}" for x in ("ab", "É", "x<|endoftext", "don't", "4") for a in stops for b in ["", *stops] for end in ("", " y", "\nz", "\u0338", "9")]
    ids, offsets = CHUNKED.encode(texts)
    ids, offsets = ids.tolist(), offsets.tolist()
    for t, a, b in zip(texts, offsets, offsets[1:]):
        assert ids[a:b] == want_ids(t), t


def test_random_texts_with_a_fixed_seed():
    r = random.Random(17)
    letters = "aZéİIıſßΣς\u0301\u0307\u200d\u00a0\u0958\u1e9e'sst .,*!#\n\t-09<|>"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(30))) for _ in range(20_000)]
    ids, offsets = CHUNKED.encode(texts)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == want_ids(t)


def test_special_strings_and_long_chunks():
    texts = ["a <|endoftext|> b", "x<|startoftext|>y", "z" * 5000, "", "I'm DON'T 12345", "z" * 5000]
    ids, offsets = CHUNKED.encode(texts)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == want_ids(t)


def test_a_full_cache_forgets_without_harm(words, monkeypatch):
    from cairn.llm import tokens

    monkeypatch.setattr(tokens, "CACHED_CHUNKS", 300)
    small = ChunkEncoder(PATH)
    for k in range(30):
        texts = [words(60, 7 * k + i, 90 + 40 * k) + " École. the end" for i in range(4)]
        ids, offsets = small.encode(texts)
        assert [ids[offsets[i] : offsets[i + 1]].tolist() for i in range(4)] == [want_ids(t) for t in texts]


def test_slices_of_a_column(words):
    texts = [None, *(words(40, i) + " ÉCOLE é. ñ, " for i in range(50)), "", None, "Ende."]
    column = pa.array(texts, pa.string())
    for a, b in ((0, 54), (7, 30), (50, 54), (54, 54)):
        ids, offsets = CHUNKED.encode(column.slice(a, b - a))
        assert [ids[offsets[i] : offsets[i + 1]].tolist() for i in range(b - a)] == [want_ids(t) for t in texts[a:b]]


def corpus(spark, words):
    texts = [None, "", "one", words(9000, 1), words(6000, 2)] + [words(5 + 37 * i % 900, i) for i in range(150)]
    rows = [(None if i == 7 else i % 140, t, 5) for i, t in enumerate(texts)]
    return texts, rows, stage(spark.createDataFrame(rows, "doc_id long, text string, sequence_id int").repartition(3))


def test_packing_is_exact_and_tight(spark, words):
    texts, rows, docs = corpus(spark, words)
    got = packing.packed(docs, PATH, with_ids=True).collect()
    fills, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) > 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        fills[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id, r.doc_tokens].append((r.start, r.ids))
    for pieces in fills.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    full = sum(sum(n for _, n in p) == 4096 for p in fills.values())
    assert len(fills) - full <= 3
    want = defaultdict(list)
    for doc_id, t, _ in rows:
        ids = want_ids(t)
        want[doc_id, len(ids)].append(ids)
    assert set(want) == set(by_doc)
    for key, pieces in by_doc.items():
        assert sorted(i for _, p in pieces for i in p) == sorted(i for x in want[key] for i in x)
        if len(want[key]) == 1:
            assert [i for _, p in sorted(pieces) for i in p] == want[key][0]


def test_levels_minimise_the_sum_of_squares():
    r = np.random.default_rng(1)
    levels = packing.Levels(50)
    for _ in range(2000):
        n = int(r.integers(1, 50))
        chosen = levels.choose(n)
        change = {}
        for h in [0, *np.flatnonzero(levels.n[1:50]) + 1]:
            if h + n <= 50:
                now = levels.n.copy()
                now[h] -= h > 0
                now[h + n] += h + n < 50
                change[int(h)] = int((now[1:50] ** 2).sum())
        assert change[chosen] == min(change.values())
        levels.put((0, 0, np.zeros(n), n), chosen)
        levels.taken()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.packed(docs, PATH).count() == 0


@pytest.mark.parametrize("n", [0, 1, 511, 512, 5000])
def test_wavelet_matrix(n):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(0, 999).astype(np.uint16)
    m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.of(ids, 10).to_bytes())
    assert m.all().tolist() == ids.tolist()
    for i in range(0, n, 97):
        assert m.access(i) == ids[i]
    for token in {1, 2, 7, 999}:
        places = np.flatnonzero(ids == token)
        assert m.count(token) == len(places)
        assert m.rank(token, n // 2) == (places < n // 2).sum()
        for j in range(0, len(places), 50):
            assert m.select(token, j) == places[j]
        with pytest.raises(IndexError):
            m.select(token, len(places))


def test_shards_round_trip(spark, words, tmp_path):
    texts, rows, docs = corpus(spark, words)
    wavelet.write_shards(docs, str(tmp_path / "shards"), PATH, shard_bytes=20_000, part_bytes=90_000)
    files = spark.read.parquet(str(tmp_path / "shards"))
    assert files.count() > files.select("part").distinct().count() > 3
    got = sorted(map(tuple, wavelet.read_documents(spark, str(tmp_path / "shards")).collect()), key=lambda x: x[1])
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    ids = [x[0] for x in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    want = [(r[0], len(want_ids(r[1])), zlib.crc32(np.array(want_ids(r[1]), "<u4").tobytes())) for r in rows]
    assert sorted(map(str, want)) == sorted(str((a, n, crc)) for a, _, n, crc in got)
    empty = spark.createDataFrame([], "doc_id long, text string")
    wavelet.write_shards(empty, str(tmp_path / "none"), PATH)
    assert wavelet.read_documents(spark, str(tmp_path / "none")).count() == 0


def test_a_doc_id_with_most_rows_is_parted(spark, words, tmp_path):
    docs = stage(spark.createDataFrame([(5, words(60, 1), 1)] * 600 + [(i, words(40, i), 1) for i in range(300)], "doc_id long, text string, part int"))
    wavelet.write_shards(docs, str(tmp_path / "shards"), PATH, shard_bytes=10_000, part_bytes=20_000)
    files = spark.read.parquet(str(tmp_path / "shards"))
    of_one = {r.part for r in files.collect() if 5 in r.doc_ids}
    assert len(of_one) > 3
    assert wavelet.read_documents(spark, str(tmp_path / "shards")).count() == 900


def test_ids_that_do_not_fit_are_refused():
    assert wavelet.id_bits(PATH) == 16
    task = wavelet.shard_files(PATH, 8, 2, 1000)

    class Context:
        partitionId = staticmethod(lambda: 0)

    wavelet.TaskContext, kept = type("T", (), {"get": staticmethod(lambda: Context)}), wavelet.TaskContext
    try:
        with pytest.raises(ValueError):
            list(task([pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words"])], ["doc_id", "text"])]))
    finally:
        wavelet.TaskContext = kept
