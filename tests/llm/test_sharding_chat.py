import hashlib
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.llm import chat, sharding
from cairn.llm.common import stage

PATH = P.path("byte_bpe_50k.json")


def test_loads_are_bounded_and_slots_gapless(spark, words):
    texts = [None, "", "é"] + [words(3 + 13 * i % 400, i) for i in range(3000)]
    docs = spark.createDataFrame([(None if i == 9 else i - i % 2, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, shard int")
    got = sharding.sharded(docs).collect()
    assert len(got) == len(texts)
    load, slots = [0] * 8, [[] for _ in range(8)]
    for r in got:
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert sorted((r.text_crc32, r["size"]) for r in got) == sorted((zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for t in texts)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(load) <= sum(load) / 8 * 1.01 and min(load) >= sum(load) / 8 * 0.97
    assert sharding.sharded(docs.limit(0)).count() == 0


def walked(rows, shards, slack):
    """Brute force: (doc_id, crc, size, shard, slot) of rows (doc_id, text), arc by arc around the ring."""
    points = sorted((int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big"), s) for s in range(shards) for v in range(128))
    arcs = defaultdict(list)
    for doc_id, text in rows:
        data = (text or "").encode()
        row, at = (doc_id, zlib.crc32(data), len(data) + 1), 42
        for value in row:
            at = at if value is None else xxhash.xxh64_intdigest(struct.pack("<q", value), at)
        arcs[at >> 48].append((at, row))
    weight = {a: sum(r[2] for _, r in own) for a, own in arcs.items()}
    most = -(-sum(weight.values()) * (1 + slack) // shards)
    load, owner = [0] * shards, {}
    for a in sorted(arcs, key=lambda a: (-weight[a], a)):
        clockwise = [s for p, s in points if p >= a << 48] + [s for _, s in points]
        owner[a] = next((s for s in clockwise if load[s] + weight[a] <= most), None)
        if owner[a] is None:
            owner[a] = min(range(shards), key=lambda s: (load[s], s))
        load[owner[a]] += weight[a]
    out, slots = [], [0] * shards
    for a in sorted(arcs):
        for _, row in sorted(arcs[a], key=lambda x: x[0] if x[0] < 1 << 63 else x[0] - (1 << 64)):
            out.append((*row, owner[a], slots[owner[a]]))
            slots[owner[a]] += 1
    return out


def test_shards_and_slots_by_brute_force(spark, words):
    texts = [None, "", "é" * 40] + [words(3 + 13 * i % 50, i) for i in range(2500)]
    rows = [(None if i % 400 == 9 else i, t) for i, t in enumerate(texts)] + [(2, "é" * 40), (70, texts[70]), (70, texts[70])]
    got = sharding.sharded(stage(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, slot string").repartition(5))).collect()
    have = sorted((str(r.doc_id), r.text_crc32, r["size"], r.shard, r.slot) for r in got)
    assert have == sorted((str(d), *rest) for d, *rest in walked(rows, 8, sharding.SLACK))


def test_loads_are_bounded_when_a_third_has_one_doc_id(spark, words):
    rows = [(7, words(40, 1))] * 1500 + [(None, words(20 + i % 40, i)) for i in range(1500)] + [(100 + i, words(20 + i % 40, 5000 + i)) for i in range(1500)]
    got = sharding.sharded(stage(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    load, slots = [0] * 8, [[] for _ in range(8)]
    for r in got:
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(load) <= sum(load) / 8 * 1.01


def test_one_more_shard_moves_little():
    weights = np.random.default_rng(0).integers(1, 1000, sharding.CELLS)
    a, b = sharding.assigned(weights, 8, 0.1), sharding.assigned(weights, 9, 0.1)
    moved = weights[a != b].sum() / weights.sum()
    assert moved < 0.35
    plain = [s for _, s in sharding.ring(8)]
    assert {*plain} == set(range(8))


def test_an_arc_larger_than_any_room():
    weights = np.zeros(sharding.CELLS, np.int64)
    weights[:3] = (1000, 10, 10)
    big, *small = sharding.assigned(weights, 8)[:3].tolist()
    assert big not in small


TEXTS = st.text(alphabet=st.one_of(st.sampled_from(list("ab <[\\\n]/|>éß漢😀")), st.characters(exclude_categories=["Cs"])), max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<x\n]", ""]), TEXTS), max_size=6))
def test_turns_and_loss_come_back(turns):
    tool = test_turns_and_loss_come_back.__dict__.setdefault("tool", chat.encoder(PATH))
    text, spans = chat.rendered(turns)
    assert chat.parsed(text) == turns
    code = tool.encode(text, add_special_tokens=False)
    starts, ends = chat.token_spans(np.array([e for _, e in code.offsets], np.int64))
    # No token reaches over the edge of an assistant text.
    assert not any(s < edge < e for s, e in zip(starts, ends) for span in spans for edge in span)
    mask = chat.loss_mask(starts, ends, spans)
    whole, learned = chat.said(tool, np.array(code.ids, np.int64), mask)
    assert whole == text and learned == "".join(t for r, t in turns if r == "assistant")
    # A mask that is wider or narrower by a token says something else.
    for k in np.flatnonzero(np.diff(mask))[:4].tolist():
        for place in (k, k + 1):
            other = mask.copy()
            other[place] = ~other[place]
            assert chat.said(tool, np.array(code.ids, np.int64), other)[1] != learned


def test_conversations(spark):
    long = "Über 漢字 <|end|> [x] \\ " * 30_000
    rows = [(1, 0, "user", "hi", 1), (1, 2, "assistant", "</s>[INST] ok [/INST]", 1), (1, 1, None, None, 1), (1, 2, "assistant", "</s>[INST] ok [/INST]", 1), (None, 0, "assistant", None, 1), (2, 0, "assistant", long, 1), (2, 1, "assistant", "\n", 1)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int").repartition(3)
    made = stage(chat.formatted(table, PATH))
    got = {r.conv_id: r for r in chat.digests(made, PATH).collect()}
    two = "</s>[INST] ok [/INST]"
    assert got[1].n_turns == 4 and got[1].loss_chars == 2 * len(two)
    assert got[1].loss_sha256 == hashlib.sha256((two * 2).encode()).hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(f"user\nhi\n\n\nassistant\n{two}\nassistant\n{two}\n".encode()).hexdigest()
    assert (got[None].n_turns, got[None].loss_chars) == (1, 0)
    assert got[2].loss_sha256 == hashlib.sha256((long + "\n").encode()).hexdigest()
    wrong = made.withColumn("loss", F.transform("loss", lambda x: ~x))
    assert not {r.loss_sha256 for r in chat.digests(wrong, PATH).collect()} & {r.loss_sha256 for r in got.values()}
    assert chat.digests(chat.formatted(table.limit(0), PATH), PATH).count() == 0
