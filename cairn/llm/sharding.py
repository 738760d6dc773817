"""Consistent-hash ring with virtual nodes and bounded loads.

Rows hash (by doc_id, text checksum and size) onto a ring of ``CELLS`` equal arcs; each shard owns
``VIRTUAL`` points of it. An arc belongs to the first point clockwise whose
shard still has room, a shard holding at most (1 + ``SLACK``) of the mean
bytes; if none has room (one text larger than what is left anywhere) it goes
to the emptiest. The heaviest arcs choose first. Loads are so bounded (law
``bytes``), and only arcs that overflow leave their own shard.

One aggregation gives the weight of each arc (``CELLS`` numbers whatever the
input, so the assignment is made on the driver and broadcast); rows carry no
text through the one shuffle, which numbers the rows inside each arc.

An arc heavier than ``HEAVY`` of a shard's mean (equal rows, mostly) is split:
its rows hash again with their place in the table and go to arcs all round
the ring, so only a single row can be too large for a shard's room.

Null texts have size 1; repeated rows get slots of their own; an empty table
gives no rows; other columns are ignored.
"""

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

CELL_BITS = 16
CELLS = 1 << CELL_BITS
VIRTUAL = 128
SLACK = 0.002
HEAVY = 1 / 64


def ring(shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes in ring order; positions are below 2**64."""
    points = [(int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big"), s) for s in range(shards) for v in range(virtual)]
    return sorted(points)


def assigned(weights: np.ndarray, shards: int, slack: float = SLACK, virtual: int = VIRTUAL) -> np.ndarray:
    """Shard of each arc under bounded loads."""
    points = ring(shards, virtual)
    owner = [s for _, s in points]
    width = 1 << (64 - CELL_BITS)
    first = np.searchsorted(np.array([p for p, _ in points], np.uint64), np.arange(len(weights), dtype=np.uint64) * np.uint64(width), "left")
    room = [int(-(-int(weights.sum()) * (1 + slack) // shards))] * shards
    out = np.zeros(len(weights), np.int64)
    for cell in np.lexsort((np.arange(len(weights)), -weights)).tolist():
        weight = int(weights[cell])
        at, tried, chosen = int(first[cell]), set(), -1
        while len(tried) < shards:
            s = owner[at % len(owner)]
            if s not in tried:
                if room[s] >= weight:
                    chosen = s
                    break
                tried.add(s)
            at += 1
        if chosen < 0:
            chosen = max(range(shards), key=lambda s: (room[s], -s))
        room[chosen] -= weight
        out[cell] = chosen
    return out


def arc_loads(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows of each arc."""
    weights, counts = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64)
    for r in rows.groupBy("cell").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect():  # CELLS rows at most
        weights[r.cell], counts[r.cell] = r["size"], r.n
    return weights, counts


def sharded(docs: DataFrame, shards: int = 8, slack: float = SLACK) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless in each shard) of every row of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("at", F.xxhash64("doc_id", "text_crc32", "size")).withColumn("place", F.monotonically_increasing_id())
    rows = stage(rows)  # places must not change between the weights and the slots
    arc = lambda at: F.shiftrightunsigned(at, 64 - CELL_BITS).cast("int")
    rows = rows.withColumn("cell", arc(F.col("at")))
    weights, counts = arc_loads(rows)
    heavy = np.flatnonzero(weights > HEAVY * weights.sum() / shards).tolist()  # shards / HEAVY at most
    if heavy:
        rows = rows.withColumn("cell", F.when(F.col("cell").isin(heavy), arc(F.xxhash64("at", "place"))).otherwise(F.col("cell")))
        weights, counts = arc_loads(rows)
    shard = assigned(weights, shards, slack)
    base = np.zeros(CELLS, np.int64)
    for s in range(shards):
        own = np.flatnonzero(shard == s)
        base[own] = np.cumsum(counts[own]) - counts[own]
    used = np.flatnonzero(counts)
    cells = spark.createDataFrame([(int(c), int(shard[c]), int(base[c])) for c in used], "cell int, shard int, base long")
    order = Window.partitionBy("cell").orderBy("at", "doc_id", "text_crc32", "size")
    placed = rows.withColumn("nth", F.row_number().over(order)).join(F.broadcast(cells), "cell")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("nth") - 1).alias("slot"))
