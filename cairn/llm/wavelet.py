"""Token shards as wavelet matrices: succinct bit planes with rank and select.

A shard file holds the end-marked ids of documents next to each other in the
order of doc_ids, as one bit plane for each bit of an id, most significant
first; each plane is followed by the stable partition of the sequence by that
bit. Packed bits and a count of ones for each 512 bits give access, rank and
select without unpacking the file. Files are Parquet with one shard each
(``payload`` is the wavelet file), so any store that Spark writes to will do
and a lost task leaves no half file.

One range exchange on (doc_id, hash of the text, place in the table) parts the
rows, so a doc_id with a third of all rows is parted too. A task encodes its
sorted rows one block after another and closes a shard at ``SHARD_BYTES`` of
text; its memory follows the shard, not the part. A shard knows how many ids of
its part come before it, so readers need one number a part to place it.

Null texts count as empty; null doc_ids come first; equal doc_ids follow the
hash of their texts; a text of over SHARD_BYTES has a shard of its own (its
wavelet file must stay below Parquet's 2 GB a value); other columns are
ignored; an empty table gives no files and no rows.
"""

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts_for
from .tokens import BLOCK_BYTES, END, column_blocks, encoder

MAGIC = b"CWM1"
STEP = 512
SHARD_BYTES = 16 << 20
PART_BYTES = 48 << 20


class WaveletMatrix:
    """A sequence of ids below 2**bits."""

    def __init__(self, n: int, bits: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.bits, self.zeros, self.planes, self.ranks = n, bits, zeros, planes, ranks

    @classmethod
    def of(cls, ids: np.ndarray, bits: int) -> "WaveletMatrix":
        zeros, planes, ranks = [], [], []
        now, spare = ids, np.empty_like(ids)
        for b in range(bits - 1, -1, -1):
            one = now & ids.dtype.type(1 << b) != 0
            packed = np.packbits(one, bitorder="little")
            words = np.zeros(-(-len(ids) // STEP) * STEP // 8, np.uint8)
            words[: len(packed)] = packed
            counts = np.bitwise_count(words.view(np.uint64)).reshape(-1, STEP // 64).sum(axis=1, dtype=np.uint32)
            ranks.append(np.concatenate(([0], np.cumsum(counts))).astype(np.uint32))
            planes.append(packed)
            zeros.append(len(ids) - int(counts.sum()))
            if b and len(ids):
                np.compress(~one, now, out=spare[: zeros[-1]])
                np.compress(one, now, out=spare[zeros[-1] :])
                now, spare = spare, np.empty_like(ids) if now is ids else now
        return cls(len(ids), bits, zeros, planes, ranks)

    def to_bytes(self) -> bytes:
        head = MAGIC + struct.pack("<QI", self.n, self.bits) + np.array(self.zeros, "<u8").tobytes()
        return head + b"".join(p.tobytes() + r.astype("<u4").tobytes() for p, r in zip(self.planes, self.ranks))

    @classmethod
    def from_bytes(cls, raw: bytes) -> "WaveletMatrix":
        if raw[:4] != MAGIC:
            raise ValueError("not a wavelet file")
        n, bits = struct.unpack_from("<QI", raw, 4)
        at = 16
        zeros = np.frombuffer(raw, "<u8", bits, at).tolist()
        at += 8 * bits
        size, steps = (n + 7) // 8, (n + STEP - 1) // STEP + 1
        planes, ranks = [], []
        for _ in range(bits):
            planes.append(np.frombuffer(raw, np.uint8, size, at))
            ranks.append(np.frombuffer(raw, "<u4", steps, at + size))
            at += size + 4 * steps
        return cls(n, bits, zeros, planes, ranks)

    def ones(self, plane: int, i: int) -> int:
        """Ones before position i of a plane."""
        step = i // STEP
        part = np.unpackbits(self.planes[plane][step * STEP // 8 : (i + 7) // 8], bitorder="little")
        return int(self.ranks[plane][step]) + int(part[: i - step * STEP].sum())

    def access(self, i: int) -> int:
        value = 0
        for p in range(self.bits):
            bit = self.planes[p][i >> 3] >> (i & 7) & 1
            value = value << 1 | int(bit)
            i = self.zeros[p] + self.ones(p, i) if bit else i - self.ones(p, i)
        return value

    def range_of(self, token: int, end: int) -> tuple[int, int]:
        """Where the first ``end`` places' occurrences of ``token`` lie below the last plane."""
        low, high = 0, end
        for p in range(self.bits):
            a, b = self.ones(p, low), self.ones(p, high)
            low, high = (self.zeros[p] + a, self.zeros[p] + b) if token >> (self.bits - 1 - p) & 1 else (low - a, high - b)
        return low, high

    def rank(self, token: int, end: int) -> int:
        """Occurrences of ``token`` before position ``end``."""
        low, high = self.range_of(token, end)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def place(self, plane: int, nth: int, bit: int) -> int:
        """Position of the nth (from 0) ``bit`` of a plane."""
        ranks = self.ranks[plane].astype(np.int64)
        if not bit:
            ranks = np.minimum(np.arange(len(ranks)) * STEP, self.n) - ranks
        step = int(np.searchsorted(ranks, nth, "right")) - 1
        part = np.unpackbits(self.planes[plane][step * STEP // 8 : (step + 1) * STEP // 8], bitorder="little")[: self.n - step * STEP]
        return step * STEP + int(np.flatnonzero(part == bit)[nth - ranks[step]])

    def select(self, token: int, nth: int) -> int:
        """Position of the nth (from 0) occurrence of ``token``."""
        low, high = self.range_of(token, self.n)
        if not 0 <= nth < high - low:
            raise IndexError(nth)
        at = low + nth
        for p in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - p) & 1
            at = self.place(p, at - self.zeros[p] if bit else at, bit)
        return at

    def all(self) -> np.ndarray:
        """The whole sequence, by undoing the partitions from the last plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for p in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[p], bitorder="little")[: self.n].astype(bool)
            up = np.empty_like(now)
            up[~one] = now[: self.zeros[p]]
            up[one] = now[self.zeros[p] :] | kind(1 << (self.bits - 1 - p))
            now = up
        return now


FILE = "part int, part_start long, n_tokens long, doc_ids array<long>, sizes array<long>, payload binary"


def shard_files(tokenizer: str, bits: int, end: int, shard_bytes: int):
    """Task: rows in order to one wavelet file for each ``shard_bytes`` of text."""
    kind = np.uint16 if bits <= 16 else np.uint32

    def run(batches):
        words, part = encoder(tokenizer), TaskContext.get().partitionId()
        own, sizes, held, size, at = [], [], [], 0, 0

        def closed():
            ids = np.concatenate(held)
            row = [part], [at], [len(ids)], [pa.concat_arrays(own)], [np.concatenate(sizes)], [WaveletMatrix.of(ids, bits).to_bytes()]
            types = pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], [x.split()[0] for x in FILE.split(", ")]), len(ids)

        for batch in batches:
            first = 0
            for texts in column_blocks(batch.column("text"), min(BLOCK_BYTES, shard_bytes)):
                if size >= shard_bytes:
                    file, n = closed()
                    yield file
                    own, sizes, held, size, at = [], [], [], 0, at + n
                ids, offsets = words.encode(texts, end)
                if len(ids) and int(ids.max()) >> bits:
                    raise ValueError(f"an id of this tokenizer needs more than {bits} bits")
                own.append(batch.column("doc_id").slice(first, len(texts)))
                sizes.append(np.diff(offsets))
                held.append(ids.astype(kind))
                size += texts.nbytes
                first += len(texts)
        if held:
            yield closed()[0]

    return run


def id_bits(tokenizer: str) -> int:
    """Bits of the largest id of a tokenizer file."""
    from tokenizers import Tokenizer

    return max(1, max(Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()).bit_length())


def write_shards(docs: DataFrame, path: str, tokenizer: str, end: int = END, shard_bytes: int = SHARD_BYTES, part_bytes: int = PART_BYTES) -> None:
    """Encode ``docs`` and write wavelet files of about ``shard_bytes`` of text in doc_id order under ``path``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    keys = ["doc_id", "_hash", "_place"]
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_place"))
    ordered = keyed.repartitionByRange(parts_for(total, part_bytes, 1), *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    files = ordered.mapInArrow(shard_files(tokenizer, max(id_bits(tokenizer), end.bit_length()), end, shard_bytes), FILE)
    files.write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(path)


def read_rows(bases: dict):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # one file's ids at a time, its payload as it lies in the batch
                part, start, own, sizes, payload = (batch.column(c)[i] for c in ("part", "part_start", "doc_ids", "sizes", "payload"))
                ids = WaveletMatrix.from_bytes(memoryview(payload.as_buffer())).all().astype("<u4")
                sizes = sizes.values.to_numpy()
                ends = np.cumsum(sizes)
                starts = ends - sizes
                crc = [zlib.crc32(ids[a:b].data) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([own.values, *(pa.array(x, pa.int64()) for x in (starts + bases[part.as_py()] + start.as_py(), sizes, crc))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files."""
    files = spark.read.schema(FILE).parquet(path)
    bases, at = {}, 0
    for r in sorted(files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):  # one number a part
        bases[r.part] = at
        at += r.n
    return files.select("part", "part_start", "doc_ids", "sizes", "payload").mapInArrow(read_rows(bases), "doc_id long, start long, n_tokens long, ids_crc32 long")
