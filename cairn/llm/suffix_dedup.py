"""Exact removal of repeated byte strings with a distributed sparse suffix array.

A byte goes if a ``LENGTH``-byte string that covers it also starts anywhere
else in the corpus. Sorting every suffix of 100 TB would move hundreds of
times the input, so the array is sparse: of each LENGTH-byte window only the
suffix at its *anchor* (the position of its least hashed ``SEED``-byte string)
is kept. Equal windows have their anchors at equal offsets, so no repeat is
lost, and one suffix stands for about 85 windows. Windows in a row with one
anchor form a *stretch*.

1. Count anchor seeds; only stretches whose seed occurs twice go on.
2. Equal stretches (fingerprints of 128 bits) share one entry of the array,
   folded inside each block of texts first, then over all blocks: a passage
   that everybody quotes is one row a block, not one a document. What a block
   holds twice is removed there and then.
3. All entries are merge-sorted by what follows the anchor, then by what
   precedes it, nearest byte first. Tasks sort and front-code runs and cut them
   at separators drawn from a sample; each range combines its runs with a loser
   tree that carries the longest common prefix with the last output and
   compares bytes only beyond it. The common prefixes (to the right) and
   refined classes of left contexts then tell which windows occur twice, byte
   for byte; an entry folded from several stretches has all its windows twice.
4. A separator is cut back to ``SEED`` bytes unless one seed fills more than a
   range. Only then can equal windows lie on both sides of it; these windows,
   a prefix of the separator each, are settled by digest, with map-side
   aggregation.

All ways are exact and complete. Nulls count as empty texts; texts under
LENGTH bytes keep all; a very long text is read in overlapping pieces of
``PIECE`` bytes; repeated rows are further places, so copies of LENGTH bytes and more
are removed in each; an empty table gives no rows. Other columns of the input
are ignored. Ranges are ``RANGE`` entries each. Separators travel with tasks, so
if there would be more than ``MOST_RANGES`` ranges, runs are cut into so many
first, and each of these is cut again at separators of its own, which meet its
runs in a join.
"""

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, SpanHash, as_long, numbered, parts_for, released, row_blocks, stage, utf8_of

LENGTH = 200
SEED = 32
#: Entries in a range, in a sorted run and, at most, in the sample that separators come from.
RANGE = 20_000
RUN = 20_000
SAMPLE = 50_000
#: One stretch in so many carries its suffix as a candidate for the sample.
SAMPLED = 256
MOST_RANGES = 1 << 12
FOLDED_BYTES = 16 << 20
POSITION = np.uint64((1 << 20) - 1)
PIECE = BLOCK_BYTES - 4096


def stretches(data: np.ndarray, offsets: np.ndarray):
    """(first window, number of windows, anchor, seed hash, hash, hash) of a block under 2**20 bytes."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint64)
    spans = SpanHash(data)
    at = np.arange(n - SEED + 1)
    seeds = spans.of(at, at + SEED)
    key = (seeds & ~POSITION) | at.astype(np.uint64)
    wide = LENGTH - SEED + 1
    padded = np.full(-(-len(key) // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    grid = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - LENGTH + 1
    least = np.minimum(back[:windows], ahead[wide - 1 : wide - 1 + windows])
    end_of_row = np.repeat(offsets[1:], np.diff(offsets))[:windows]
    valid = np.flatnonzero(at[:windows] + LENGTH <= end_of_row)
    if not len(valid):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint64)
    anchor = (least[valid] & POSITION).astype(np.int64)
    cut = np.flatnonzero((np.diff(valid) != 1) | (np.diff(anchor) != 0)) + 1
    first = np.concatenate(([0], cut))
    count = np.diff(np.concatenate((first, [len(valid)])))
    start, anchor = valid[first], anchor[first]
    end = start + count - 1 + LENGTH
    other = SpanHash(data, 0xD6E8FEB86659FD93)
    return start, count, anchor, seeds[anchor], spans.of(start, end), other.of(start, end)


def pieces_of(data: np.ndarray, offsets: np.ndarray):
    """(row, byte where it begins in the row, bytes, offsets): blocks; a long row comes in overlapping pieces."""
    for a, b in row_blocks(offsets, PIECE):
        size = int(offsets[b] - offsets[a])
        if size <= PIECE:
            yield a, 0, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            continue
        for at in range(0, size, PIECE - LENGTH + 1):
            part = data[offsets[a] + at : min(offsets[a] + at + PIECE, offsets[b])]
            if len(part) >= LENGTH or not at:
                yield a, at, part, np.array([0, len(part)])


def seed_counts(batches):
    for batch in released(batches):
        data, offsets = utf8_of(batch.column("text"))
        for _, _, part, rows in pieces_of(data, offsets):
            seed, n = np.unique(stretches(part, rows)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([as_long(seed), pa.array(n, pa.int64())], ["seed", "n"])


def reach(count, left):
    """Bytes from the anchor on that a stretch's windows cover; the last of them begins behind or at it at most."""
    return LENGTH - (left - count + 1)


MARKS = "row_id long, place long, seed long, mark_a long, mark_b long, n long, head binary, stop long"


def folded(held: list) -> pa.RecordBatch:
    """One row for each different stretch of a block (its first place, how often), and spans of what the block holds twice."""
    row_id, place, seed, a, b = (np.concatenate(x) for x in list(zip(*held))[:5])
    heads: dict = {}
    for x in held:
        heads.update(x[5])
    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate((first, [len(order)])))
    lead = order[first]
    twin = np.zeros(len(order), bool)
    twin[order] = np.repeat(n > 1, n)
    at = np.flatnonzero(twin)
    start, stop = place[at] >> 20, (place[at] >> 20) + ((place[at] >> 10) & 1023) + (LENGTH - 1)
    cut = np.ones(len(at), bool)
    cut[1:] = (np.diff(row_id[at]) != 0) | (start[1:] > stop[:-1])
    begin = np.flatnonzero(cut)
    end = np.maximum.reduceat(stop, begin) if len(at) else stop
    none = [None] * len(begin)
    kinds = [row_id[lead], place[lead], seed[lead].view(np.int64), a[lead].view(np.int64), b[lead].view(np.int64), n]
    spans = [row_id[at[begin]], start[begin] << 20, seed[at[begin]].view(np.int64)]
    columns = [pa.array(np.concatenate((x, y)), pa.int64()) for x, y in zip(kinds[:3], spans)]
    columns += [pa.concat_arrays([pa.array(x, pa.int64()), pa.array(none, pa.int64())]) for x in kinds[3:]]
    columns.append(pa.array([heads.get(k) for k in zip(kinds[0].tolist(), kinds[1].tolist())] + none, pa.binary()))
    columns.append(pa.concat_arrays([pa.nulls(len(lead), pa.int64()), pa.array(end, pa.int64())]))
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in MARKS.split(", ")])


def mark_rows(batches):
    for batch in released(batches):
        ids = batch.column("row_id").to_numpy(zero_copy_only=False)
        data, offsets = utf8_of(batch.column("text"))
        held, size = [], 0
        for first, at, part, rows in pieces_of(data, offsets):
            start, count, anchor, seed, a, b = stretches(part, rows)
            row = np.searchsorted(rows, start, "right") - 1
            place = ((start - rows[row] + at) << 20) | (count << 10) | (anchor - start)
            own = ids[first + row]
            heads = {}
            for k in np.flatnonzero(a % np.uint64(SAMPLED) == 0).tolist():
                s, left = int(anchor[k]), int(anchor[k] - start[k])
                heads[int(own[k]), int(place[k])] = part[s : s + reach(int(count[k]), left)].tobytes() + part[start[k] : s].tobytes()[::-1]
            held.append((own, place, seed, a, b, heads))
            size += len(part)
            if size >= FOLDED_BYTES:
                yield folded(held)
                held, size = [], 0
        if held:
            yield folded(held)


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix; the first ``known`` bytes are not looked at."""
    x, y = a[known:], b[known:]
    n = min(len(x), len(y))
    x, y = x[:n], y[:n]
    if x == y:
        return known + n
    differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return known + n - (differ.bit_length() + 7) // 8


def front_coded(suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Shared-prefix lengths, tail lengths and tails of a sorted run."""
    shared, tails, last = [], [], b""
    for x in suffixes:
        known = common_prefix(last, x, 0)
        shared.append(known)
        tails.append(x[known:])
        last = x
    return np.array(shared, np.uint16), np.array([len(x) for x in tails], np.uint16), b"".join(tails)


def decoded(shared, sizes, tails: bytes) -> list[bytes]:
    out, last, at = [], b"", 0
    for known, size in zip(shared.tolist(), sizes.tolist()):
        last = last[:known] + tails[at : at + size]
        at += size
        out.append(last)
    return out


def merged(runs: list[list[bytes]], shared: list[list[int]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Loser-tree merge of sorted runs: (run, place) in order and each one's prefix shared with the one before.

    A contender carries what it shares with the last output, so the one that
    shares more is smaller without looking at bytes; equal ones are compared
    beyond that prefix only.
    """
    k = 1
    while k < len(runs):
        k *= 2
    runs = runs + [[] for _ in range(k - len(runs))]
    at = [0] * k
    known = [0] * k
    losers = [-1] * k

    def beats(a: int, b: int) -> bool:
        if at[a] >= len(runs[a]):
            return False
        if at[b] >= len(runs[b]):
            return True
        if known[a] != known[b]:
            return known[a] > known[b]
        x, y = runs[a][at[a]], runs[b][at[b]]
        same = common_prefix(x, y, known[a])
        won = x[same : same + 1] < y[same : same + 1] if x != y else a < b
        known[b if won else a] = same
        return won

    nodes = {k + i: i for i in range(k)}
    for node in range(k - 1, 0, -1):
        a, b = nodes[2 * node], nodes[2 * node + 1]
        won = beats(a, b)
        nodes[node], losers[node] = (a, b) if won else (b, a)
    top = nodes[1]
    order, prefixes = [], []
    while at[top] < len(runs[top]):
        order.append((top, at[top]))
        prefixes.append(known[top])
        at[top] += 1
        if at[top] < len(runs[top]):
            known[top] = shared[top][at[top]]
        now, node = top, (k + top) // 2
        while node:
            if not beats(now, losers[node]):
                now, losers[node] = losers[node], now
            node //= 2
        top = now
    return order, prefixes


def repeated_windows(prefixes, entries: list[bytes], count, left, several) -> np.ndarray:
    """Boolean [entry, bytes before the anchor]: that window occurs in another stretch.

    ``prefixes`` are what each of the sorted ``entries`` shares with the one
    before. Windows that reach ``b`` bytes back agree if the suffixes share
    LENGTH - b bytes (one run in the order) and the b bytes before agree
    (classes refined byte by byte). Entries that share less than a seed with
    their neighbours are left out of all that.
    """
    n, wide = len(prefixes), LENGTH - SEED + 1
    out = np.zeros((n, wide), bool)
    near = np.zeros(n + 1, bool)
    near[:n] = prefixes >= SEED
    live = np.flatnonzero(near[:n] | near[1:])
    table = np.zeros((n, wide), np.uint8)
    for i in live.tolist():
        x = entries[i][reach(int(count[i]), int(left[i])) :]
        table[i, : len(x)] = np.frombuffer(x, np.uint8)
    kind = np.zeros(len(live), np.int64)
    for back in range(int(left[live].max(initial=-1)) + 1):
        keep = left[live] >= back
        live, kind = live[keep], kind[keep]
        if back:
            kind = np.unique(kind * 256 + table[live, back - 1], return_inverse=True)[1]
        run = np.cumsum(prefixes < LENGTH - back)[live]
        active = back > left[live] - count[live]
        both = run[active] * (n + 1) + kind[active]
        _, which, times = np.unique(both, return_inverse=True, return_counts=True)
        out[live[active], back] = times[which] > 1
    back = np.arange(wide)[None, :]
    return out | (several[:, None] & (back <= left[:, None]) & (back > (left - count)[:, None]))


def separators(heads: list[bytes], ranges: int) -> list[bytes]:
    """Shortest strings of ``SEED`` bytes or more that part sorted entries like the sample into equal ranges."""
    heads, out = sorted(heads), []
    for i in range(1, ranges):
        x = heads[i * len(heads) // ranges] if heads else b""
        known = common_prefix(out[-1], x, 0) if out else 0
        if len(x) > known and (not out or x > out[-1]):
            out.append(x[: max(SEED, known + 1)])
    return out


RUNS = "range int, sub int, below binary, above binary, shared binary, sizes binary, tails binary, meta binary"
RUN_TYPES = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
FOUND = "mark_a long, mark_b long, start long, stop long, digest binary, n long"


def parted(cuts: list[bytes], below: bytes, above: bytes, entries: list[bytes]):
    """Parts of sorted entries: (range, its separators below and above, first, end)."""
    at = [bisect_right(cuts, x) for x in entries]
    first = np.flatnonzero(np.diff(at, prepend=-1)).tolist()
    for s, e in zip(first, [*first[1:], len(entries)]):
        yield at[s], cuts[at[s] - 1] if at[s] else below, cuts[at[s]] if at[s] < len(cuts) else above, s, e


def run_batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), RUN_TYPES)], [x.split()[0] for x in RUNS.split(", ")])


def sorted_runs(cuts: list[bytes]):
    """Task: cut the wanted entries out of the texts; sorted front-coded runs, parted by range."""

    def rows(found: list):
        found.sort(key=lambda x: x[0])
        for at, below, above, s, e in parted(cuts, b"", b"", [x[0] for x in found]):
            shared, sizes, tails = front_coded([x[0] for x in found[s:e]])
            yield [at, 0, below, above, shared.tobytes(), sizes.tobytes(), tails, np.array([x[1:] for x in found[s:e]], np.int64).tobytes()]

    def run(batches):
        found: list = []
        for batch in released(batches):
            data, offsets = utf8_of(batch.column("text"))
            wanted = batch.column("wanted")
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(wanted).to_numpy(zero_copy_only=False))
            wanted = wanted.flatten()
            place, a, b, several = (wanted.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            count, left = (place >> 10) & 1023, place & 1023
            start = offsets[row] + (place >> 20)
            anchor = start + left
            stop = anchor + reach(count, left)
            shape = several.astype(np.int64) << 20 | count << 10 | left
            for s, m, e, *meta in zip(start.tolist(), anchor.tolist(), stop.tolist(), a.tolist(), b.tolist(), shape.tolist()):
                found.append((data[m:e].tobytes() + data[s:m].tobytes()[::-1], *meta))
                if len(found) >= RUN:
                    yield run_batch(list(rows(found)))
                    found = []
        if found:
            yield run_batch(list(rows(found)))

    return run


def ranged_heads(cuts: list[bytes]):
    """Task: candidates for the sample with the range that they lie in."""

    def run(batches):
        for batch in released(batches):
            heads = batch.column("head")
            yield pa.RecordBatch.from_arrays([pa.array([bisect_right(cuts, x.as_py()) for x in heads], pa.int32()), heads], ["range", "head"])

    return run


def own_separators(table: pa.Table) -> pa.Table:
    """Separators of one range, from its sample and its number of entries."""
    cuts = separators(table.column("head").to_pylist(), parts_for(table.column("n")[0].as_py(), RANGE, 1))
    return pa.table([table.column("range").slice(0, 1), pa.array([cuts], pa.list_(pa.binary()))], ["range", "cuts"])


def cut_again(batches):
    """Task: runs of a range parted by the range's own separators (``cuts``; none: as they are)."""
    for batch in released(batches):
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            known = np.frombuffer(row["shared"], np.uint16)
            entries = decoded(known, np.frombuffer(row["sizes"], np.uint16), row["tails"])
            meta, out = np.frombuffer(row["meta"], np.int64).reshape(-1, 3), []
            for at, below, above, s, e in parted(row["cuts"] or [], row["below"], row["above"], entries):
                shared, sizes, tails = front_coded(entries[s:e])
                out.append([row["range"], at, below, above, shared.tobytes(), sizes.tobytes(), tails, meta[s:e].tobytes()])
            yield run_batch(out)


def finer(runs: DataFrame, heads: DataFrame, cuts: list[bytes]) -> DataFrame:
    """``runs`` of ranges cut again, so that each part has about ``RANGE`` entries; ``heads`` is the sample."""
    runs = stage(runs)
    sizes = runs.groupBy("range").agg((F.sum(F.octet_length("shared")) / 2).cast("long").alias("n"))
    sample = heads.mapInArrow(ranged_heads(cuts), "range int, head binary").join(sizes, "range")
    own = sample.groupBy("range").applyInArrow(own_separators, "range int, cuts array<binary>")
    return runs.join(stage(own), "range", "left").mapInArrow(cut_again, RUNS)


def crossing(entries: list[bytes], below: bytes, above: bytes) -> np.ndarray:
    """How many bytes each sorted entry may share with entries beyond a separator; 0 for less than a seed."""
    out = np.zeros(len(entries), np.int64)
    for cut, order in ((below, range(len(entries))), (above, range(len(entries) - 1, -1, -1))):
        for i in order if len(cut) > SEED else ():
            shared = min(common_prefix(cut, entries[i], 0), len(cut) - 1)
            if shared < SEED:
                break
            out[i] = max(out[i], shared)
    return out


def merge_range(table: pa.Table) -> pa.Table:
    """Combine the runs of a range; stretches' spans of repeated windows, and digests of windows that may occur beyond it."""
    runs, shared, metas = [], [], []
    for row in table.to_pylist():
        known = np.frombuffer(row["shared"], np.uint16)
        runs.append(decoded(known, np.frombuffer(row["sizes"], np.uint16), row["tails"]))
        shared.append(known.tolist())
        metas.append(np.frombuffer(row["meta"], np.int64).reshape(-1, 3))
    order, prefixes = merged(runs, shared)
    entries = [runs[r][i] for r, i in order]
    begin = np.cumsum([0, *map(len, runs)])
    meta = np.concatenate(metas)[[begin[r] + i for r, i in order]]
    mark_a, mark_b, shape = meta.T
    several, count, left = shape >> 20 == 1, (shape >> 10) & 1023, shape & 1023
    hit = repeated_windows(np.array(prefixes, np.int64), entries, count, left, several)
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    entry, low = np.nonzero(edge == 1)
    high = np.nonzero(edge == -1)[1] - 1
    found = [mark_a[entry], mark_b[entry], left[entry] - high, left[entry] - low + LENGTH]
    beyond = crossing(entries, *(table.column(c)[0].as_py() for c in ("below", "above")))
    windows = []
    for i in np.flatnonzero(beyond).tolist():
        follow = reach(int(count[i]), int(left[i]))
        for back in range(max(LENGTH - int(beyond[i]), int(left[i] - count[i]) + 1), int(left[i]) + 1):
            text = entries[i][follow : follow + back][::-1] + entries[i][: LENGTH - back]
            windows.append((int(mark_a[i]), int(mark_b[i]), int(left[i]) - back, int(left[i]) - back + LENGTH, hashlib.blake2b(text, digest_size=16).digest(), 1 + int(several[i])))
    columns = list(zip(*windows)) or [[]] * 6
    settled = [pa.array(x, pa.int64()) for x in found] + [pa.nulls(len(entry), pa.binary()), pa.nulls(len(entry), pa.int64())]
    open_ = [pa.array(x, pa.binary() if k == 4 else pa.int64()) for k, x in enumerate(columns)]
    return pa.table([pa.concat_arrays(x) for x in zip(settled, open_)], [x.split()[0] for x in FOUND.split(", ")])


def removed_spans(rows: DataFrame) -> DataFrame:
    """(row_id, start, stop, way) of repeated strings of ``rows`` (row_id, text); spans may overlap."""
    texts = rows.select("row_id", "text")
    twice = texts.select("text").mapInArrow(seed_counts, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).filter("n > 1").select("seed")
    found = stage(texts.mapInArrow(mark_rows, MARKS).join(twice, "seed", "left_semi"))
    start = F.shiftright("place", 20)
    in_block = found.filter("stop is not null").select("row_id", start.alias("start"), "stop", F.lit("block").alias("way"))
    found = found.filter("stop is null").select("row_id", "place", "mark_a", "mark_b", "n", "head")
    mark = ["mark_a", "mark_b"]
    entries = stage(found.groupBy(*mark).agg(F.sum("n").alias("n"), F.min(F.struct("row_id", "place")).alias("one"), F.max("head").alias("head")))
    total = entries.count()
    every = parts_for(total, RANGE, 1)
    ranges = min(MOST_RANGES, every)

    def sample(share: int) -> DataFrame:
        """About ``SAMPLE`` candidates of each ``share``-th part of the entries."""
        sparse = max(1, total // share // SAMPLED // SAMPLE)
        return entries.filter("head is not null").filter(F.pmod(F.xxhash64(*mark), F.lit(sparse)) == 0).select("head")

    heads = sample(1).collect() if ranges > 1 else []
    cuts = separators([bytes(r.head) for r in heads], ranges)
    want = F.struct(F.col("one.place").alias("place"), *mark, (F.col("n") > 1).cast("long").alias("several"))
    wanted = entries.groupBy(F.col("one.row_id").alias("row_id")).agg(F.collect_list(want).alias("wanted"))
    runs = texts.join(wanted, "row_id").select("text", "wanted").mapInArrow(sorted_runs(cuts), RUNS)
    if every > ranges:
        runs = finer(runs, sample(ranges), cuts)
    # A range is a task, but for very many.
    merged_ = stage(runs.repartition(max(len(cuts) + 1, min(every, 1 << 16)), "range", "sub").groupBy("range", "sub").applyInArrow(merge_range, FOUND))
    windows = merged_.filter("digest is not null")
    again = windows.groupBy("digest").agg(F.sum("n").alias("n")).filter("n > 1").select("digest")
    seam = windows.join(again, "digest", "left_semi").select(*mark, "start", "stop", F.lit("seam").alias("way"))
    repeated = merged_.filter("digest is null").select(*mark, "start", "stop", F.lit("merge").alias("way")).unionByName(seam)
    placed = found.select("row_id", "place", *mark).join(repeated, mark).select("row_id", (start + F.col("start")).alias("start"), (start + F.col("stop")).alias("stop"), "way")
    return in_block.unionByName(placed)


def merged_spans(spans: list) -> list[tuple[int, int]]:
    """Sorted union of (start, stop) pairs; touching spans become one."""
    out: list = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def keep_rest(batches):
    names = ["row_id", "doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    for batch in released(batches):
        data, offsets = utf8_of(batch.column("text"))
        for a, b in row_blocks(offsets, 32 * BLOCK_BYTES):
            spans_of = batch.column("spans").slice(a, b - a).to_pylist()
            size, removed, n, kept = [], [], [], []
            for i, spans in zip(range(a, b), spans_of):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                gone = merged_spans([(x["start"], x["stop"]) for x in spans or []])
                at, rest = 0, []
                for s, e in gone:
                    rest.append(text[at:s])
                    at = e
                rest.append(text[at:])
                kept.append(b"".join(rest))
                size.append(len(text))
                removed.append(len(text) - len(kept[-1]))
                n.append(len(gone))
            yield pa.RecordBatch.from_arrays([batch.column("row_id").slice(a, b - a), batch.column("doc_id").slice(a, b - a), *(pa.array(x, pa.int64()) for x in (size, removed, n)), pa.array(kept, pa.binary())], names)


def deduplicated(docs: DataFrame) -> DataFrame:
    """(row_id, doc_id, n_bytes, n_removed, n_spans, kept binary) for every row of ``docs``."""
    rows = numbered(docs)
    spans = removed_spans(rows).groupBy("row_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return rows.join(spans, "row_id", "left").select("row_id", "doc_id", "text", "spans").mapInArrow(keep_rest, "row_id long, doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
