"""Sum-of-squares online packing of token documents into fixed windows.

Each document goes to the fill level h that makes the sum of N(h)^2 least,
N(h) being the number of open windows filled to h, kept in an array of levels.
Whole windows are cut off long documents first. When a task ends, or holds
more than ``OPEN`` open windows, the emptiest are cut up to close the fullest,
so a task leaves one partly filled window at most. Tasks pack their own rows:
no shuffle, and padding stays below one window a task.

Null texts count as empty (they still carry the end id); repeated rows and
null doc_ids are packed like any other; an empty table gives no rows.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released
from .tokens import END, column_blocks, encoder

WINDOW = 4096
OPEN = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Levels:
    """Open windows by fill level; a window is a list of (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int = WINDOW):
        self.size = size
        self.n = np.zeros(size + 1, np.int64)
        self.open: list[list] = [[] for _ in range(size + 1)]
        self.count = 0
        self.closed: list = []

    def choose(self, length: int) -> int:
        """The level to put ``length`` ids at; 0 opens a window. Ties go to the fullest."""
        most = self.size - length
        levels = np.flatnonzero(self.n[1 : most + 1]) + 1
        fresh = 2 * self.n[length] + 1 if length < self.size else 0
        if not len(levels):
            return 0
        after = levels + length
        change = np.where(after == self.size, 1 - 2 * self.n[levels], 2 * (self.n[after] - self.n[levels]) + 2)
        best = len(levels) - 1 - int(np.argmin(change[::-1]))
        return int(levels[best]) if change[best] <= fresh else 0

    def put(self, piece: tuple, level: int):
        window = []
        if level:
            window = self.open[level].pop()
            self.n[level] -= 1
            self.count -= 1
        window.append(piece)
        self.keep(window, level + len(piece[2]))

    def keep(self, window: list, fill: int):
        if fill == self.size:
            self.closed.append(window)
        else:
            self.open[fill].append(window)
            self.n[fill] += 1
            self.count += 1

    def add(self, doc_id, ids: np.ndarray):
        n, at = len(ids), 0
        while n - at >= self.size:
            self.closed.append([(doc_id, at, ids[at : at + self.size], n)])
            at += self.size
        if at < n:
            self.put((doc_id, at, ids[at:], n), self.choose(n - at))
        if self.count > OPEN:
            self.settle()

    def settle(self):
        """Close windows from the fullest on with what the emptiest hold; one at most stays open."""
        windows = [(h, w) for h in range(self.size) for w in self.open[h]]
        self.open = [[] for _ in range(self.size + 1)]
        self.n[:] = 0
        self.count = 0
        low, high = 0, len(windows) - 1
        spare: list = []
        while True:
            if not spare:
                if low > high:
                    break
                if low == high:
                    self.keep(windows[low][1], windows[low][0])
                    break
                spare = windows[low][1]
                low += 1
            fill, window = windows[high]
            while spare and fill < self.size:
                doc_id, start, ids, n = spare.pop()
                room = self.size - fill
                window.append((doc_id, start, ids[:room], n))
                fill += min(room, len(ids))
                if len(ids) > room:
                    spare.append((doc_id, start + room, ids[room:], n))
            windows[high] = (fill, window)
            if fill == self.size:
                self.closed.append(window)
                high -= 1
                if low > high and spare:
                    self.keep(spare, sum(len(x[2]) for x in spare))
                    break

    def taken(self) -> list:
        out, self.closed = self.closed, []
        return out

    def rest(self) -> list:
        self.settle()
        return self.taken() + [w for level in self.open for w in level]


def packer(tokenizer: str, window: int = WINDOW, end: int = END, with_ids: bool = False):
    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids

    def rows(windows: list, sequence: int):
        out = []
        for w in windows:
            at = 0
            for doc_id, start, ids, n in w:
                out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, sequence, at) + ((ids.tolist(),) if with_ids else ()))
                at += len(ids)
            sequence += 1
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names), sequence

    def run(batches):
        words, levels = encoder(tokenizer), Levels(window)
        sequence = TaskContext.get().partitionId() << 36
        for batch in released(batches, encoders=True):
            at = 0
            for texts in column_blocks(batch.column("text")):
                ids, offsets = words.encode(texts, end)
                for i, doc_id in enumerate(batch.column("doc_id").slice(at, len(texts)).to_pylist()):
                    levels.add(doc_id, ids[offsets[i] : offsets[i + 1]].astype(np.uint32))
                at += len(texts)
                if done := levels.taken():
                    out, sequence = rows(done, sequence)
                    yield out
        if done := levels.rest():
            yield rows(done, sequence)[0]

    return run


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document, with the window (``sequence_id``) and the place in it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(packer(tokenizer, window, end, with_ids), PIECES + ", ids array<int>" * with_ids)
