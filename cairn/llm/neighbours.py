"""Quality by nearest-neighbour voting in a latent-semantic space.

Texts become hashed term weights (words, byte trigrams and marks of how words
look: capitals, symbols, repetition). A truncated singular value decomposition
of a bounded labelled sample (``PER_LABEL`` texts of each label, chosen by
hash of doc_id) gives the space; the sample's vectors and the projection are
broadcast, a few MB whatever the input. Every text is then projected, its
cosines with all labelled vectors are computed in blocks, and its ``NEAREST``
vote with weight by similarity. Of a repeated labelled doc_id the least text
is in the sample, once; no text but the sample's is shuffled.

Null and empty texts score the sample's mean label; labels that are null or
of unknown documents teach nothing; with no labels all score 0.5; a doc_id that
both labels name has a place in each; repeated rows score alike and repeated
labels count once; a null doc_id is never held out and teaches nothing; a very
long text is one row of term weights like any other; other columns pass by; an
empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, released, row_blocks, utf8_of, words_in

PER_LABEL = 1500
NEAREST = 15
RANK = 48
WORD_TERMS, GRAM_TERMS, MARKS = 2048, 1024, 16
TERMS = WORD_TERMS + GRAM_TERMS + MARKS
ACCEPT = 0.3
SHARPNESS = 4
#: A block of texts has so many bytes and rows at most (one row: more bytes).
BLOCK_BYTES, BLOCK_ROWS = 1 << 18, 250
COLUMNS = "doc_id long, held_out boolean, score double, predicted int"


def byte_table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


def term_weights(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[row, term] weights of a block, each row of length 1 (0 if it has no word)."""
    rows = len(offsets) - 1
    start, end, row = words_in(data, offsets, ~byte_table(b" \t\n\x0b\x0c\r"))
    size = (end - start).astype(np.int64)
    hashes = WordHash(data).of(start, end)

    def among(table):
        sums = np.concatenate(([0], np.cumsum(table[data])))
        return sums[end] - sums[start]

    upper, lower = among(byte_table(bytes(range(65, 91)))), among(byte_table(bytes(range(97, 123))))
    symbols, digits = among(byte_table(b"#*$%&|<>!{}[]=_~^\\")), among(byte_table(b"0123456789"))
    same = np.zeros(len(row), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    marks = [(upper > 1) & (lower == 0), symbols > 0, symbols == size, same, digits > 0, size > 14, size < 2, upper == 1]
    words = np.bincount(row * WORD_TERMS + (hashes % np.uint64(WORD_TERMS)).astype(np.int64), minlength=rows * WORD_TERMS).reshape(rows, -1)
    out = np.zeros((rows, TERMS), np.float32)
    total = np.maximum(np.bincount(row, minlength=rows), 1)[:, None]
    out[:, :WORD_TERMS] = np.sqrt(words / total)
    if len(data) > 2:
        wide = data.astype(np.int64)
        grams = (wide[:-2] * 961 + wide[1:-1] * 31 + wide[2:]) * 40503 % 65521 % GRAM_TERMS
        where = np.repeat(np.arange(rows), np.diff(offsets))[: len(grams)]
        inside = np.arange(len(grams)) + 3 <= offsets[1:][where]  # a gram belongs to one text
        counts = np.bincount(where[inside] * GRAM_TERMS + grams[inside], minlength=rows * GRAM_TERMS).reshape(rows, -1)
        out[:, WORD_TERMS : WORD_TERMS + GRAM_TERMS] = 0.5 * np.sqrt(counts / np.maximum(counts.sum(axis=1), 1)[:, None])
    for k, mark in enumerate(marks):
        out[:, WORD_TERMS + GRAM_TERMS + k] = np.sqrt(np.bincount(row[mark], minlength=rows) / total[:, 0])
    distinct = (words > 0).sum(axis=1) / total[:, 0]
    out[:, WORD_TERMS + GRAM_TERMS + len(marks)] = np.sqrt(np.maximum(0, 1 - distinct))
    out[np.bincount(row, minlength=rows) == 0] = 0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def sample_rows(batches):
    for batch in released(batches):
        data, offsets = utf8_of(batch.column("text"))
        for a, b in row_blocks(offsets, BLOCK_BYTES, BLOCK_ROWS):
            weights = term_weights(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([batch.column("quality").slice(a, b - a), pa.array([w.astype(np.float16).tobytes() for w in weights], pa.binary())], ["quality", "weights"])


def space_of(weights: np.ndarray, rank: int = RANK, rounds: int = 6) -> np.ndarray:
    """The first right singular vectors as columns, by subspace iteration from a fixed start."""
    rank = min(rank, *weights.shape)
    basis = np.random.default_rng(7).standard_normal((weights.shape[1], rank))
    for _ in range(rounds):
        basis = np.linalg.qr(weights.T @ (weights @ basis))[0]
    return basis.astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Voters:
    """Labelled vectors, their labels and the projection to their space."""

    def __init__(self, weights: np.ndarray | None = None, labels: np.ndarray | None = None, arrays: tuple | None = None):
        if arrays is not None:
            self.labels, self.mean, self.space, self.vectors = arrays
            return
        self.labels = labels.astype(np.float32)
        self.mean = float(labels.mean()) if len(labels) else 0.5
        self.space = space_of(weights) if len(labels) else np.zeros((TERMS, 1), np.float32)
        self.vectors = unit(weights.astype(np.float32) @ self.space)

    def scores(self, weights: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(weights), self.mean)
        near = unit(weights @ self.space) @ self.vectors.T
        k = min(nearest, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype(np.float64) ** SHARPNESS
        total = vote.sum(axis=1)
        score = np.where(total > 0, (vote * self.labels[top]).sum(axis=1) / np.maximum(total, 1e-30), self.mean)
        score[~weights.any(axis=1)] = self.mean
        return np.clip(score, 0, 1)


def fitted(docs: DataFrame, labels: DataFrame, held_out, per_label: int = PER_LABEL) -> Voters:
    """Voters from at most ``per_label`` labelled texts of each label that aren't held out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    rows = rows.filter("doc_id is not null and quality in (0, 1)").filter(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))).distinct()
    chosen = None
    for label in (0, 1):
        one = rows.filter(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        chosen = one if chosen is None else chosen.unionByName(one)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one_each = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    sample = one_each.select("quality", "text").mapInArrow(sample_rows, "quality int, weights binary").collect()  # per_label rows a label at most
    sample.sort(key=lambda r: (r.quality, bytes(r.weights)))
    weights = np.array([np.frombuffer(r.weights, np.float16) for r in sample], np.float32).reshape(-1, TERMS)
    return Voters(weights, np.array([r.quality for r in sample]))


def block_scores(voters: Voters, column):
    data, offsets = utf8_of(column)
    for a, b in row_blocks(offsets, BLOCK_BYTES, BLOCK_ROWS):
        yield a, b, voters.scores(term_weights(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))


def broadcast_arrays(spark, voters: Voters):
    """A broadcast of plain arrays, which executors without this package can read."""
    return spark.sparkContext.broadcast((voters.labels, voters.mean, voters.space, voters.vectors))


def scored(docs: DataFrame, voters: Voters, held_out) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    shared = broadcast_arrays(docs.sparkSession, voters)

    def run(batches):
        known = Voters(arrays=shared.value)
        for batch in released(batches):
            for a, b, score in block_scores(known, batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), pa.array(score), pa.array(score >= ACCEPT).cast(pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, COLUMNS)


def accepted(docs: DataFrame, voters: Voters) -> DataFrame:
    """The rows of ``docs`` scored ``ACCEPT`` or more, with all their columns."""
    shared = broadcast_arrays(docs.sparkSession, voters)

    def run(batches):
        known = Voters(arrays=shared.value)
        for batch in released(batches):
            keep = [score >= ACCEPT for _, _, score in block_scores(known, batch.column("text").cast(pa.string()))]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
