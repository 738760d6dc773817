"""Whole-text encoding with the ``tokenizers`` library, word by word.

A tokenizer that drops white space gives a text the ids of its space-separated
chunks one after another, so each different chunk is encoded once a worker and
texts become array look-ups. Arrow splits the texts and finds the different
chunks of a block; new chunks are encoded many to a call. Between them stands
one of the tokenizer's special tokens, whose id tells them apart again. Most
are letters only and so one word: where the tokenizer marks the last token of
a word, these stand between spaces and pass by its normaliser and patterns.
"""

import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ENCODERS, row_blocks, utf8_of

END = 2
#: Stops after a letter are a word of their own to the tokenizer, so they may stand apart. Other letters than these
#: can end in a mark once normalised (U+0130 in lower case), which the tokenizer joins with the stop; an apostrophe
#: may begin a word, and what special tokens are written with stays where it is.
WORD_STOP = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-/:;=?@\[-`{}~]+)([ \n]|\z)"
#: Such letters alone are one word, and normalisation does no more than lower them.
ONE_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: What every special token of the tokenizer begins with.
CONTROL = "<|"
JOINED = 32
BLOCK_BYTES = 4 << 20
CACHED_CHARS = 32_000_000
CACHED_CHUNKS = 600_000


def groups(items: list, n: int) -> list[list]:
    return [items[k : k + n] for k in range(0, len(items), n)]


class ChunkEncoder:
    """Encodes texts with a tokenizer that lower-cases and drops white space between words."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and t.content.startswith(CONTROL)}
        self.between, self.between_id = min(special.items())
        self.words = self.last = None
        made = json.loads(self.tokenizer.to_str())
        suffix, (split, *after) = made["model"].get("end_of_word_suffix"), (made["pre_tokenizer"] or {}).get("pretokenizers", [None])
        if suffix and split and split["type"] == "Split" and [x["type"] for x in after] == ["ByteLevel"] and '"Lowercase"' in json.dumps(made["normalizer"]):
            self.words = Tokenizer.from_str(json.dumps(made | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *after]}}))
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.reset()

    def reset(self):
        self.index: dict = {}
        self.parts: list = []
        self.chars = 0
        self.flat = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def learn(self, chunks: list[str]):
        kinds = [0 if self.words and ONE_WORD(c) else 2 if CONTROL in c else 1 for c in chunks]  # 2 could hold the token that stands between
        words, plain, rest = ([c for c, k in zip(chunks, kinds) if k == n] for n in range(3))
        self.index.update(zip(chain(words, plain, rest), range(len(self.index), len(self.index) + len(chunks))))
        self.chars += sum(map(len, chunks))
        for group in groups(words, 64 * JOINED):
            ids = self.ids_of([" ".join(g).lower() for g in groups(group, JOINED)], self.words)[0]
            self.parts.append((ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1)))
        for group in groups(plain, 64 * JOINED):
            ids = self.ids_of([self.between.join([*g, ""]) for g in groups(group, JOINED)], self.tokenizer)[0]
            self.parts.append((ids[ids != self.between_id], np.diff(np.flatnonzero(ids == self.between_id), prepend=-1) - 1))
        if rest:
            self.parts.append(self.ids_of(rest, self.tokenizer))

    def ids_of(self, texts: list[str], tokenizer) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(size.sum())), size

    def gather(self):
        """Arrays of what was learned, with the newest parts behind."""
        size = np.concatenate([x[1] for x in self.parts])
        self.flat = np.concatenate([self.flat, *(x[0] for x in self.parts)])
        self.size = np.concatenate((self.size, size))
        self.start = np.cumsum(self.size) - self.size
        self.parts = []

    def encode(self, texts, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, ``end`` after each text (list or Arrow column; null: empty), and the offsets of the texts."""
        if len(self.index) > CACHED_CHUNKS or self.chars > CACHED_CHARS:
            self.reset()
        data, begins = utf8_of(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
        texts = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(begins), pa.py_buffer(data))  # begins at 0, as a slice doesn't
        texts = pc.if_else(pc.match_substring(texts, CONTROL), texts, pc.ascii_lower(texts))
        split = pc.split_pattern(pc.replace_substring(pc.replace_substring_regex(texts, WORD_STOP, r"\1 \2\3"), "\n", " "), " ")
        sizes = pc.list_value_length(split).to_numpy()
        chunks = split.flatten().dictionary_encode()
        own = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.index.get, own))
        new = [c for c, k in zip(own, known) if k is None]
        if new:
            self.learn(new)
            self.gather()
            known = list(map(self.index.__getitem__, own))
        at = np.array(known, np.int64)[chunks.indices.to_numpy()]
        size = self.size[at]
        first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        lengths = np.add.reduceat(size, first) if len(texts) else np.zeros(0, np.int64)
        total = int(size.sum())
        ids = self.flat[np.arange(total, dtype=np.int32) + np.repeat((self.start[at] - (np.cumsum(size) - size)).astype(np.int32), size)]
        offsets = np.concatenate(([0], np.cumsum(lengths + 1)))
        out = np.full(int(offsets[-1]), end, np.int32)
        body = np.ones(len(out), bool)
        body[offsets[1:] - 1] = False
        out[body] = ids
        return out, offsets


def encoder(path: str) -> ChunkEncoder:
    """The worker process's encoder: what one task learned serves the next."""
    import sys
    import types

    # Functions come to a worker anew with each task, so what stays is kept in a module of its own there.
    held = sys.modules.setdefault(ENCODERS, types.ModuleType(ENCODERS)).__dict__
    if path not in held:
        held[path] = ChunkEncoder(path)
    return held[path]


def column_blocks(column, limit: int = BLOCK_BYTES):
    """Slices of an Arrow column of texts, of about ``limit`` bytes each."""
    for a, b in row_blocks(utf8_of(column)[1], limit):
        yield column.slice(a, b - a)


def text_blocks(column, limit: int = 1 << 20):
    """Lists of texts (null: empty) of an Arrow column, about ``limit`` characters each."""
    out, size = [], 0
    for x in column:
        t = x.as_py() or ""
        out.append(t)
        size += len(t)
        if size >= limit:
            yield out
            out, size = [], 0
    if out:
        yield out
