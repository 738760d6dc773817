"""Shared helpers: staged tables, Arrow text as bytes, vectorised hashing.

Task code works on blocks of a quarter of a megabyte of UTF-8, so memory follows
the block (or the longest single text), beside the Arrow batch itself.
"""

import ctypes
import sys
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 18
#: Where a worker keeps what tasks of one stage share.
ENCODERS = "cairn_worker_encoders"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where Spark itself is one local process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    A lost executor costs a re-read, not a recomputation of what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cairn-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> DataFrame:
    """(row_id, doc_id, text): row_id tells repeated and null doc_ids apart.

    ``docs`` must give the same rows in the same partitions each time it is
    evaluated, as a table read does.
    """
    return docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )


def filtered_rows(docs: DataFrame, row_ids: DataFrame, how: str) -> DataFrame:
    """``docs`` whose row_id is (``left_semi``) or isn't (``left_anti``) listed."""
    packed = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    return packed.join(row_ids.select("row_id"), "row_id", how).select("row.*")


def trim():
    """Give back the free memory that Arrow and the C library keep."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def released(batches, encoders: bool = False):
    """The batches of a task; free memory goes back before and after them, as workers outlive tasks and stages.

    Tokenizers that earlier stages left in the worker go too, but for tasks
    that use ``encoders``.
    """
    if not encoders:
        sys.modules.pop(ENCODERS, None)
    trim()
    yield from batches
    trim()


def parts_for(rows: int, per_part: int, least: int = 8) -> int:
    return max(least, -(-rows // per_part))


def utf8_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_string() if not pa.types.is_binary(column.type) else pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES, rows: int = 1 << 30):
    """Row ranges (a, b) of about ``limit`` bytes and at most ``rows``; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n, a + rows)
        yield a, b
        a = b


_POWERS: dict = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK_BYTES + 4096), np.uint64(base))
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


#: Modulo this prime no text is built against a polynomial whatever its base, as a Thue-Morse text is modulo 2**64.
PRIME = (1 << 61) - 1
_P, _LOW, _31, _30, _61 = np.uint64(PRIME), np.uint64((1 << 31) - 1), np.uint64(31), np.uint64(30), np.uint64(61)


def residue(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**64 modulo the prime."""
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b) -> np.ndarray:
    """Products of residues modulo the prime, from halves of 30 and 31 bits."""
    ah, al, bh, bl = a >> _31, a & _LOW, b >> _31, b & _LOW
    mid = ah * bl + al * bh
    return residue(((ah * bh) << np.uint64(1)) + (mid >> _30) + ((mid & np.uint64((1 << 30) - 1)) << _31) + al * bl)


_RESIDUES: dict = {}


def residues(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo the prime."""
    have = _RESIDUES.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 4096)
        have = np.ones(size, np.uint64)
        k = 1
        while k < size:
            more = min(k, size - k)
            have[k : k + more] = times(have[:more], np.uint64(pow(base, k, PRIME)))
            k += more
        _RESIDUES[base] = have
    return have[:n]


def running(x: np.ndarray) -> np.ndarray:
    """Sums of the numbers before each place (below 2**39 each), modulo the prime from time to time."""
    out = np.zeros(len(x) + 1, np.uint64)
    step = 1 << 24
    for a in range(0, len(x), step):
        b = min(a + step, len(x))
        np.cumsum(x[a:b], out=out[a + 1 : b + 1])
        if a:
            out[a + 1 : b + 1] += residue(out[a : a + 1])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class SpanHash:
    """Polynomial fingerprints modulo 2**64 of byte spans of one block; only for spans far below 1024 bytes, where Thue-Morse texts begin to agree."""

    def __init__(self, data: np.ndarray, base: int = 0x9E3779B97F4A7C15):
        n = len(data)
        self.inverse = powers(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, n), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


class PrimeHash:
    """Polynomial fingerprints, modulo a prime of 61 bits, of any byte spans of one block.

    Two different spans agree with a chance of about their length in 2**61.
    """

    def __init__(self, data: np.ndarray, base: int = 0x1E3779B97F4A7C15):
        n = len(data)
        base %= PRIME
        self.inverse = residues(pow(base, -1, PRIME), n + 1)
        power, codes = residues(base, n), data.astype(np.uint64) + np.uint64(1)
        self.low, self.high = running(codes * (power & _LOW)), running(codes * (power >> _31))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        low, high = (residue(residue(x[end]) + (_P - residue(x[start]))) for x in (self.low, self.high))
        value = residue(low + times(high, np.uint64(1 << 31)))
        return mix(times(value, self.inverse[start]) + ((end - start).astype(np.uint64) << _61))


#: Spans of up to so many bytes are told apart modulo 2**64 (a Thue-Morse text of 32 bytes leaves 44 bits), longer ones modulo the prime.
SHORT_SPAN = 32


class WordHash:
    """Fingerprints of any byte spans of one block: cheap for short ones, modulo the prime for the few long ones."""

    def __init__(self, data: np.ndarray):
        self.data, self.short = data, SpanHash(data)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = self.short.of(start, end)
        long = np.flatnonzero(end - start > SHORT_SPAN)
        if len(long):
            out[long] = PrimeHash(self.data).of(start[long], end[long])
        return out


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def word_bytes() -> np.ndarray:
    """Bytes of words after lower-casing: 0-9, a-z and all of a non-ASCII character."""
    table = np.zeros(256, bool)
    table[48:58] = table[97:123] = table[128:] = True
    return table


def words_in(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Start and end bytes of the words of a block, and the row each lies in."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = is_word[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64), pa.int64())
