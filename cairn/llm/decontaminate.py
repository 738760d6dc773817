"""Benchmark decontamination with suffix arrays of the training words.

Each task turns a block of documents into a shard: word ids, and a suffix
array of the positions whose first words also begin some benchmark window
(other suffixes can't match). Every benchmark suffix is binary-searched in the
shard; the ranges found are all verbatim occurrences of its window of
``WINDOW`` words (an item with fewer words is one window). Windows that follow
one another on the same diagonal give the longest verbatim match and its place.

The benchmark is cut into blocks of about ``BLOCK_WORDS`` words by hash of the
item, one pass over the documents a block. The windows of a block are built
once, on the driver, and broadcast as plain arrays (100 bytes a window); with
several blocks, each pass is written before the next block is collected, so
only one is held at a time, and the findings meet in one shuffle. A single item
must fit a block's memory.

Words: A-Z lower-cased, then runs of 0-9, a-z and non-ASCII characters,
compared by 64-bit fingerprints modulo a prime of 61 bits: two different words
agree with a chance of about their length in 2**61, and a clean document would
be hit only if all words of a window did. Null and wordless texts have no words
and are clean; items that are null or wordless match nothing; repeated rows are
judged alike; items that share an item_id count once; a null item_id counts as
"".
"""


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, lower_ascii, numbered, released, row_blocks, stage, utf8_of, word_bytes, words_in

WINDOW = 10
BLOCK_WORDS = 1_000_000
FOUND = "row_id long, doc_id long, n_words long, hits array<struct<start:long,stop:long>>, items array<string>, matches array<struct<item_id:string,item_word:long,doc_word:long,n_words:long>>"


def word_hashes(data: np.ndarray, offsets: np.ndarray):
    """Fingerprints of the words of a block and the row each lies in."""
    data = lower_ascii()[data]
    start, end, row = words_in(data, offsets, word_bytes())
    return WordHash(data).of(start, end), row


class TestWindows:
    """The benchmark's windows: vocabulary, items' word ids and windows as sortable keys."""

    __test__ = False

    FIELDS = ("window", "vocabulary", "names", "item", "at", "size", "low", "high", "lead", "starts")

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.window = window
        texts = [(str(i) if i is not None else "", t) for i, t in items if t]
        self.names = [i for i, _ in texts]
        data, offsets = utf8_of(pa.array([t for _, t in texts], pa.string()))
        parts = [(*word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), a) for a, b in row_blocks(offsets)]
        hashes = np.concatenate([h for h, _, _ in parts] or [np.zeros(0, np.uint64)])
        row = np.concatenate([r + a for _, r, a in parts] or [np.zeros(0, np.int64)])
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        counts = np.bincount(row, minlength=len(texts)).astype(np.int64)
        sizes = np.minimum(window, counts)
        windows = np.where(counts > 0, counts - sizes + 1, 0)
        self.item = np.repeat(np.arange(len(texts)), windows)
        self.at = np.arange(len(self.item)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.size = sizes[self.item]
        first = (np.cumsum(counts) - counts)[self.item] + self.at
        codes = np.concatenate((ids + 3, np.zeros(window, np.int64))).astype(np.uint32)
        grid = codes[first[:, None] + np.arange(window)[None, :]]
        past = np.arange(window)[None, :] >= self.size[:, None]
        grid[past] = 0
        self.low = sort_keys(grid)
        self.lead = max(1, min(3, int(self.size.min(initial=window))))
        self.starts = np.unique(self.codes(grid[:, : self.lead].astype(np.int64) - 3))
        grid[past] = 0xFFFFFFFF
        self.high = sort_keys(grid)

    def arrays(self) -> list:
        return [getattr(self, f) for f in self.FIELDS]

    @classmethod
    def of(cls, arrays: list) -> "TestWindows":
        out = cls.__new__(cls)
        for field, value in zip(cls.FIELDS, arrays):
            setattr(out, field, value)
        return out

    def codes(self, grid: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grid), np.int64)
        for c in range(grid.shape[1]):
            out = out * (len(self.vocabulary) + 1) + grid[:, c]
        return out


def sort_keys(grid: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort like the rows."""
    return np.ascontiguousarray(grid.astype(">u4")).view(f"S{4 * grid.shape[1]}").ravel()


def occurrences(test: TestWindows, hashes: np.ndarray, row: np.ndarray):
    """(document word, benchmark window) of every occurrence in a shard."""
    none = np.zeros(0, np.int64)
    n = len(hashes)
    if not n or not len(test.item):
        return none, none
    ids = np.searchsorted(test.vocabulary, hashes)
    ids[ids == len(test.vocabulary)] = 0
    ids = np.where(test.vocabulary[ids] == hashes, ids, -1)
    lead = test.lead
    if n < lead:
        return none, none
    whole = (row[lead - 1 :] == row[: n - lead + 1])
    for k in range(lead):
        whole &= ids[k : n - lead + 1 + k] >= 0
    at = np.flatnonzero(whole)
    codes = test.codes(np.stack([ids[at + k] for k in range(lead)], axis=1)) if len(at) else none
    at = at[np.isin(codes, test.starts)]
    if not len(at):
        return none, none
    place = at[:, None] + np.arange(test.window)[None, :]
    inside = place < n
    place = np.minimum(place, n - 1)
    grid = np.where(inside & (row[place] == row[at][:, None]), ids[place] + 3, 1)
    keys = sort_keys(grid)
    order = np.argsort(keys, kind="stable")
    array, keys = at[order], keys[order]
    low, high = np.searchsorted(keys, test.low, "left"), np.searchsorted(keys, test.high, "right")
    many = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(many)), many)
    inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return array[low[which] + inner], which


def longest(test: TestWindows, word: np.ndarray, which: np.ndarray, row: np.ndarray):
    """(row, item, word in the item, word in the text, words) of each maximal verbatim match."""
    item, at = test.item[which], test.at[which]
    order = np.lexsort((word, word - at, item, row[word]))
    word, item, at, size = word[order], item[order], at[order], test.size[which][order]
    own = row[word]
    new = np.ones(len(word), bool)
    new[1:] = (np.diff(own) != 0) | (np.diff(item) != 0) | (np.diff(word - at) != 0) | (np.diff(word) != 1)
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(word)])) - 1
    return own[first], item[first], at[first], word[first], word[last] + size[last] - word[first]


def finder(windows):
    def run(batches):
        test = TestWindows.of(windows.value)
        for batch in released(batches):
            data, offsets = utf8_of(batch.column("text"))
            for a, b in row_blocks(offsets):
                hashes, row = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                counts = np.bincount(row, minlength=b - a)
                first = np.cumsum(counts) - counts
                word, which = occurrences(test, hashes, row)
                hits, names, matches = ([[] for _ in range(b - a)] for _ in range(3))
                if len(word):
                    edge = np.zeros(len(hashes) + 1, np.int64)
                    np.add.at(edge, word, 1)
                    np.add.at(edge, word + test.size[which], -1)
                    hit = np.cumsum(edge[:-1]) > 0
                    cut = hit.copy()
                    cut[1:] &= ~hit[:-1] | (row[1:] != row[:-1])
                    stop = hit.copy()
                    stop[:-1] &= ~hit[1:] | (row[1:] != row[:-1])
                    for s, e in zip(np.flatnonzero(cut).tolist(), (np.flatnonzero(stop) + 1).tolist()):
                        r = row[s]
                        hits[r].append({"start": s - int(first[r]), "stop": e - int(first[r])})
                    for r, k in np.unique(np.stack((row[word], test.item[which]), axis=1), axis=0).tolist():
                        names[r].append(test.names[k])
                    for r, k, j, w, size in zip(*(x.tolist() for x in longest(test, word, which, row))):
                        matches[r].append({"item_id": test.names[k], "item_word": j, "doc_word": w - int(first[r]), "n_words": size})
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row_id").slice(a, b - a),
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(counts.astype(np.int64)),
                        pa.array(hits, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                        pa.array([sorted(set(x)) for x in names], pa.list_(pa.string())),
                        pa.array(matches, pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())]))),
                    ],
                    ["row_id", "doc_id", "n_words", "hits", "items", "matches"],
                )

    return run


def benchmark_blocks(benchmark: DataFrame, block_words: int):
    """How many blocks the benchmark has, and the blocks, collected one at a time: lists of (item_id, text)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // (4 * block_words)))

    def blocks():
        for k in range(n):
            block = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
            yield [(r.item_id, r.text) for r in block.collect()]

    return n, blocks()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs``: row_id, doc_id, n_words, ``hits`` (word spans in windows), ``items``, longest ``matches``."""
    rows = numbered(docs)
    send = docs.sparkSession.sparkContext.broadcast
    n, blocks = benchmark_blocks(benchmark, block_words)
    if n == 1:
        return rows.mapInArrow(finder(send(TestWindows(next(blocks), window).arrays())), FOUND)
    found = None
    for items in blocks:
        sent = send(TestWindows(items, window).arrays())
        one = rows.mapInArrow(finder(sent), FOUND)
        # The first pass has all rows; of the others only findings matter.
        one = stage(one if found is None else one.filter("size(items) > 0"))
        sent.destroy()
        found = one if found is None else found.unionByName(one)
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("hits", "items", "matches")]
    return found.groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *lists)


def hit_words(hits) -> F.Column:
    """Words in a list of spans, which may overlap if they come from several passes."""
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("seen"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x["stop"] - F.greatest(x["start"], s["seen"]))).alias("n"), F.greatest(s["seen"], x["stop"]).alias("seen"))
    return F.aggregate(F.array_sort(hits), state, step, lambda s: s["n"])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs, benchmark)
    items = F.array_sort(F.array_distinct("items"))
    n_hit = hit_words(F.col("hits"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
