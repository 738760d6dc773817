"""Set-similarity join on word shingles by chosen paths.

Documents with equal shingle sets are one set with a multiplicity. Every set
is mapped to ``COORDINATES`` minhash tokens. In each run a path tree splits the
sets: a node draws one or two of its coordinates (1 / 0.8 on average), and a set
goes to the child of its own token there; after ``DEPTH`` levels two sets of
similarity 0.8 share a leaf with probability ``MEET``. Runs repeat until pairs at
0.8 have met in one with probability ``RECALL`` (more alike ones: more). Pairs
that met are compared on their tokens, where two sets of 0.8 fall below
``LOOKS_ALIKE`` in about 1 of 10,000 cases; then they are only found together
if other links put them into one class.

The first ``FIRST_RUNS`` runs only connect what is easily found: in each leaf
the first set not yet taken takes what looks similar enough, a leaf over
``LEAF`` sets is dealt over blocks, and for ``ROUNDS`` rounds what stays
untaken goes on (split on one more token while that is still too much).
Nothing that they leave apart is lost: all runs are then gone through again,
and in every leaf that still holds several classes each two sets of different
classes are compared on tokens, in pairs of blocks of ``LEAF`` sets if the
leaf is larger (work by the square of what isn't connected yet, over tasks).
The links only tell which sets to bring together: inside their connected
classes all sets are compared exactly, in pairs of blocks of bounded size, and
classes and link counts come from those comparisons alone.

Words are runs of 0-9, a-z and non-ASCII characters after lower-casing A-Z;
a text of fewer than ``WORDS`` words has one shingle of all; null and wordless
texts are classes of their own without links, as are all others that nothing
resembles; repeated rows link like other copies; an empty table gives no rows.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, as_long, lower_ascii, mix, numbered, parts_for, released, row_blocks, stage, utf8_of, word_bytes, words_in
from .components import components

WORDS = 5
ALIKE = (4, 5)
COORDINATES = 128
MEET = 0.64
RECALL = 0.9997
FIRST_RUNS = 2
DEPTH = 3
LOOKS_ALIKE = 0.66
LEAF = 1000
BLOCK_SHINGLES = 1_000_000
ROUNDS = 8
SETS = "row_id long, doc_id long, set_a long, set_b long, n_shingles long, tokens binary"


def runs_for(recall: float) -> int:
    """Runs after which two sets of similarity 0.8 have met with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - MEET))


RUNS = runs_for(RECALL)


def shingle_sets(data: np.ndarray, offsets: np.ndarray):
    """(row, shingle hash) of a block's shingle sets, sorted and unique."""
    data = lower_ascii()[data]
    start, end, row = words_in(data, offsets, word_bytes())
    hashes = WordHash(data).of(start, end)
    n = len(row)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    count = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    length = np.minimum(WORDS, count)[row]
    begins = np.arange(n) + length <= first[row] + count[row]
    at = np.flatnonzero(begins)
    shingle = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        use = k < length[at]
        shingle[use] = mix(shingle[use] * np.uint64(0x9E3779B97F4A7C15) + hashes[at[use] + k])
    row = row[at]
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    return row[new], shingle[new]


def minhashes(shingle: np.ndarray, first: np.ndarray, rows: int) -> np.ndarray:
    """[row, coordinate] tokens of 16 bits of non-empty sets that begin at ``first``."""
    out = np.zeros((rows, COORDINATES), np.uint16)
    low = (shingle >> np.uint64(32)).astype(np.uint32)
    draws = np.random.default_rng(11).integers(0, 1 << 32, (COORDINATES, 2), dtype=np.uint32)
    for k, (a, b) in enumerate(draws.tolist()):
        x = low * np.uint32(a | 1)
        x ^= x >> np.uint32(15)
        x *= np.uint32(b | 1)
        least = np.minimum.reduceat(x, first)
        least ^= least >> np.uint32(16)
        out[:, k] = (least * np.uint32(0x45D9F3B) >> np.uint32(16)).astype(np.uint16)
    return out


def set_rows(batches):
    names = [x.split()[0] for x in SETS.split(", ")]
    for batch in released(batches):
        data, offsets = utf8_of(batch.column("text"))
        for a, b in row_blocks(offsets):
            row, shingle = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            size = np.bincount(row, minlength=b - a)
            full = np.flatnonzero(size)
            first = (np.cumsum(size) - size)[full]
            set_a, set_b = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
            tokens = [None] * (b - a)
            if len(full):
                set_a[full] = np.add.reduceat(mix(shingle), first)
                set_b[full] = np.add.reduceat(mix(shingle ^ np.uint64(0xA5A5A5A55A5A5A5A)), first)
                for i, x in zip(full.tolist(), minhashes(shingle, first, len(full))):
                    tokens[i] = x.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("row_id").slice(a, b - a), batch.column("doc_id").slice(a, b - a), as_long(set_a), as_long(set_b), pa.array(size, pa.int64()), pa.array(tokens, pa.binary())], names)


def children(node: np.ndarray, row: np.ndarray, tokens: np.ndarray):
    """One level down: each node draws a coordinate, and a second one in a quarter of cases."""
    draw = mix(node ^ np.uint64(0x5851F42D4C957F2D))
    out_node, out_row = [], []
    for k, chosen in enumerate((np.ones(len(node), bool), (draw >> np.uint64(40)) % np.uint64(4) == 0)):
        at = ((draw >> np.uint64(8 * k)) % np.uint64(COORDINATES)).astype(np.int64)
        token = tokens[row, at].astype(np.uint64)
        down = mix(node + (at.astype(np.uint64) << np.uint64(20)) + token * np.uint64(0xD6E8FEB86659FD93))
        out_node.append(down[chosen])
        out_row.append(row[chosen])
    return np.concatenate(out_node), np.concatenate(out_row)


def token_table(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COORDINATES)


def leaf_rows(runs: range):
    """Task: the leaves of each set in these runs."""

    def run_all(batches):
        for batch in released(batches):
            ids, label = batch.column("id").to_numpy(), batch.column("label").to_numpy()
            tokens = token_table(batch.column("tokens"))
            for run in runs:
                node, row = np.full(len(ids), mix(np.array([run + 1], np.uint64))[0]), np.arange(len(ids))
                for _ in range(DEPTH):
                    node, row = children(node, row, tokens)
                yield pa.RecordBatch.from_arrays([as_long(node), pa.array(ids[row]), pa.array(label[row])], ["leaf", "id", "label"])

    return run_all


def split_again(batches):
    for batch in released(batches):
        ids, label = batch.column("id").to_numpy(), batch.column("label").to_numpy()
        node = batch.column("leaf").to_numpy().view(np.uint64)
        node, row = children(node, np.arange(len(ids)), token_table(batch.column("tokens")))
        yield pa.RecordBatch.from_arrays([as_long(node), pa.array(ids[row]), pa.array(label[row])], ["leaf", "id", "label"])


def taken(label: np.ndarray, tokens: np.ndarray) -> tuple[list, list, list]:
    """Links (a, b) between different labels of one block, and the places of sets that took others or stayed alone."""
    free = np.ones(len(label), bool)
    a, b, heads = [], [], []
    for i in range(len(label)):
        if free[i]:
            free[i] = False
            heads.append(i)
            like = (tokens == tokens[i]).mean(axis=1) >= LOOKS_ALIKE
            free[like] = False
            other = np.unique(label[like & (label != label[i])])
            a += [int(label[i])] * len(other)
            b += other.tolist()
    return a, b, heads


def brute_force(batches):
    """Rows sorted by leaf and block: links of labels, and heads of leaves in several blocks (b is null)."""

    def done(table: pa.Table):
        leaf, block = table.column("leaf").to_numpy(), table.column("block").to_numpy()
        ids, label, several = table.column("id").to_numpy(), table.column("label").to_numpy(), table.column("blocks").to_numpy() > 1
        tokens = token_table(table.column("tokens").combine_chunks())
        cut = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(block) != 0)) + 1
        out = [], [], [], []
        for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(ids)]):
            a, b, heads = taken(label[s:e], tokens[s:e])
            rows = [(a, b, [None] * len(a), [None] * len(a))]
            if several[s]:
                rows.append((label[s:e][heads].tolist(), [None] * len(heads), [int(leaf[s])] * len(heads), ids[s:e][heads].tolist()))
            for columns in rows:
                for have, new in zip(out, columns):
                    have += new
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b", "leaf", "id"])

    held = None
    for batch in released(batches):
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        leaf, block = held.column("leaf").to_numpy(), held.column("block").to_numpy()
        last = np.flatnonzero((leaf != leaf[-1]) | (block != block[-1]))
        if len(last) and held.num_rows > 2 * LEAF:
            yield done(held.slice(0, int(last[-1]) + 1))
            held = held.slice(int(last[-1]) + 1)
    if held is not None and held.num_rows:
        yield done(held)


def candidate_links(sets: DataFrame, runs: range) -> DataFrame:
    """(a, b) pairs of labels whose sets (id, label, tokens) met in a leaf of these runs and look alike.

    A leaf of one label has nothing to add and isn't shuffled on; a pair of
    labels comes at most once a head, leaf and block.
    """
    leaves = sets.mapInArrow(leaf_rows(runs), "leaf long, id long, label long")
    links = None
    for _ in range(ROUNDS):
        sizes = leaves.groupBy("leaf").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
        rows = leaves.select("leaf", "id").join(sizes.filter("low < high").select("leaf", "n"), "leaf").join(sets, "id")
        blocks = F.ceil(F.col("n") / LEAF).cast("int")
        rows = rows.withColumn("blocks", blocks).withColumn("turn", F.xxhash64("id")).withColumn("block", F.pmod("turn", "blocks").cast("int"))
        rows = rows.repartition("leaf", "block").sortWithinPartitions("leaf", "block", "turn").select("leaf", "block", "blocks", "id", "label", "tokens")
        met = stage(rows.mapInArrow(brute_force, "a long, b long, leaf long, id long"))
        found = met.filter("b is not null").select("a", "b")
        links = found if links is None else links.unionByName(found)
        heads = met.filter("b is null").select("leaf", "id", F.col("a").alias("label"))
        if heads.isEmpty():
            break
        size = heads.groupBy("leaf").agg(F.count("*").alias("n"))
        small = heads.join(size.filter(F.col("n") <= LEAF).select("leaf"), "leaf", "left_semi")
        large = heads.join(size.filter(F.col("n") > LEAF).select("leaf"), "leaf", "left_semi").join(sets.select("id", "tokens"), "id")
        leaves = stage(small.select("leaf", "id", "label").unionByName(large.select("leaf", "id", "label", "tokens").mapInArrow(split_again, "leaf long, id long, label long")))
    return links


def linked(label: np.ndarray, tokens: np.ndarray, side: np.ndarray, across: bool) -> tuple[list, list]:
    """Links that connect all labels with sets that look alike, over all pairs (of one block, or ``across`` two sides)."""
    a, b = [], []
    known = np.unique(label, return_inverse=True)[1]
    for i in np.flatnonzero(side == 0).tolist() if across else range(len(label)):
        other = np.flatnonzero((known != known[i]) & (side == 1)) if across else i + 1 + np.flatnonzero(known[i + 1 :] != known[i])
        if not len(other):
            continue
        like = other[(tokens[other] == tokens[i]).mean(axis=1) >= LOOKS_ALIKE]
        for j in like.tolist():
            if known[j] != known[i]:
                a.append(int(label[i]))
                b.append(int(label[j]))
                known[known == known[j]] = known[i]
    return a, b


def compare_pairs(batches):
    """Rows sorted by leaf and pair: links of labels."""

    def done(table: pa.Table):
        keys = [table.column(c).to_numpy() for c in ("leaf", "g1", "b1", "g2", "b2")]
        label, side = table.column("label").to_numpy(), table.column("side").to_numpy()
        across = (keys[1] != keys[3]) | (keys[2] != keys[4])
        tokens = token_table(table.column("tokens").combine_chunks())
        cut = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
        out = [], []
        for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(label)]):
            a, b = linked(label[s:e], tokens[s:e], side[s:e], bool(across[s]))
            out[0].extend(a)
            out[1].extend(b)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])

    held = None
    for batch in released(batches):
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = [held.column(c).to_numpy() for c in ("leaf", "g1", "b1", "g2", "b2")]
        last = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
        if len(last) and held.num_rows > 2 * LEAF:
            yield done(held.slice(0, int(last[-1]) + 1))
            held = held.slice(int(last[-1]) + 1)
    if held is not None and held.num_rows:
        yield done(held)


def remaining_links(sets: DataFrame, runs: range) -> DataFrame:
    """(a, b) pairs of labels whose sets (id, label, tokens) share a leaf of these runs and look alike, whatever the leaf's size.

    In a leaf over ``LEAF`` sets a label with more than that has blocks of its
    own, which aren't compared with each other; other labels share blocks.
    """
    leaves = sets.mapInArrow(leaf_rows(runs), "leaf long, id long, label long").distinct()
    sizes = leaves.groupBy("leaf").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    rows = stage(leaves.join(sizes.select("leaf", "n"), "leaf"))
    pair = ["leaf", "g1", "b1", "g2", "b2"]
    zero = [F.lit(0).cast("long").alias("g1"), F.lit(0).alias("b1"), F.lit(0).cast("long").alias("g2"), F.lit(0).alias("b2"), F.lit(0).alias("side")]
    todo = rows.filter(F.col("n") <= LEAF).select("leaf", "id", "label", *zero)
    crowded = rows.filter(F.col("n") > LEAF)
    if not crowded.isEmpty():
        large = crowded.groupBy("leaf", "label").agg(F.count("*").alias("own")).filter(F.col("own") > LEAF).select("leaf", "label", F.col("label").alias("large"))
        grouped = crowded.join(large, ["leaf", "label"], "left").select("leaf", "id", "label", F.coalesce("large", F.lit(-1)).alias("g"))
        count = grouped.groupBy("leaf", "g").agg(F.ceil(F.count("*") / LEAF).cast("int").alias("blocks"))
        placed = stage(grouped.join(count, ["leaf", "g"]).select("leaf", "id", "label", "g", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("b")))
        blocks = placed.select("leaf", "g", "b").distinct()
        one, two = (blocks.select("leaf", F.col("g").alias(f"g{k}"), F.col("b").alias(f"b{k}")) for k in (1, 2))
        pairs = stage(one.join(two, "leaf").filter("(g1 < g2) or (g1 = g2 and g1 = -1 and b1 <= b2)"))
        for side, k in ((0, 1), (1, 2)):
            at = pairs.select(*pair, F.col(f"g{k}").alias("g"), F.col(f"b{k}").alias("b"))
            at = at if side == 0 else at.filter("g1 <> g2 or b1 <> b2")
            todo = todo.unionByName(placed.join(at, ["leaf", "g", "b"]).select("leaf", "id", "label", *pair[1:], F.lit(side).alias("side")))
    todo = todo.join(sets.select("id", "tokens"), "id").repartition(*pair).sortWithinPartitions(*pair, "side", "id")
    return stage(todo.select(*pair, "side", "label", "tokens").mapInArrow(compare_pairs, "a long, b long"))


def coarse_classes(sets: DataFrame) -> DataFrame:
    """(node, root) of every set (id, tokens) that anything looks like.

    The first runs connect most of each class. Then all runs bring together
    what isn't connected yet, so a group of copies isn't linked anew in every run.
    """
    known = components(candidate_links(sets.withColumn("label", F.col("id")), range(FIRST_RUNS)))
    joined = sets.join(known.select(F.col("node").alias("id"), "root"), "id", "left")
    labelled = stage(joined.select("id", "tokens", "root", F.coalesce("root", "id").alias("label")))
    late = components(remaining_links(labelled.select("id", "label", "tokens"), range(RUNS)))
    late = late.select(F.col("node").alias("label"), F.col("root").alias("late"))
    found = labelled.select("id", "root", "label").join(late, "label", "left").select(F.col("id").alias("node"), F.coalesce("late", "root").alias("root"))
    return stage(found.filter("root is not null"))


def compared(table: pa.Table) -> pa.Table:
    """Exact links of one pair of blocks: per set its number of linked documents and the least set it hangs with."""
    data, offsets = utf8_of(table.column("text"))
    ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
    block = table.column("block").to_numpy()
    pair = table.column("pair").to_pylist()[0]
    row, shingle = [], []
    for a, b in row_blocks(offsets):
        r, s = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        row.append(r + a)
        shingle.append(s)
    row = np.concatenate(row)
    words, at = np.unique(np.concatenate(shingle), return_inverse=True)
    size = np.bincount(row, minlength=len(ids))
    ends = np.cumsum(size)
    right = np.flatnonzero(block == pair[1])
    take = np.concatenate([np.zeros(0, np.int64), *(np.arange(ends[k] - size[k], ends[k]) for k in right.tolist())])
    theirs, where = at[take], np.cumsum(size[right]) - size[right]
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    mark = np.zeros(len(words), bool)
    for i in np.flatnonzero(block == pair[0]).tolist() if len(right) else ():
        own = at[ends[i] - size[i] : ends[i]]
        mark[own] = True
        shared = np.add.reduceat(mark[theirs], where, dtype=np.int64)
        mark[own] = False
        like = right[ALIKE[1] * shared >= ALIKE[0] * (size[i] + size[right] - shared)]
        like = like[like > i] if pair[0] == pair[1] else like
        links[i] += copies[like].sum()
        links[like] += copies[i]
        for k in like.tolist():
            x, y = top(i), top(k)
            if x != y:
                x, y = (x, y) if ids[x] < ids[y] else (y, x)
                root[y] = x
    tops = [int(ids[top(i)]) for i in range(len(ids))]
    return pa.table({"id": pa.array(ids), "links": pa.array(links), "root": pa.array(tops, pa.int64()), "several": table.column("several")})


def near_sets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with their set's key, and per set: key, least row, copies, class root (a row_id) and linked documents."""
    all_rows = stage(rows.mapInArrow(set_rows, SETS))
    key = ["set_a", "set_b", "n_shingles"]
    sets = all_rows.filter("n_shingles > 0").groupBy(*key).agg(F.min("row_id").alias("id"), F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.first("tokens").alias("tokens"))
    sets = stage(sets)
    coarse = coarse_classes(sets.select("id", "tokens"))
    known = coarse.join(sets.select(F.col("id").alias("node"), "copies", "n_shingles"), "node")
    bulk = known.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("n") / LEAF), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    members = known.join(bulk.select("root", blocks.alias("blocks")), "root")
    members = stage(members.select(F.col("node").alias("row_id"), F.col("root").alias("coarse"), "copies", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    texts = members.join(rows.select("row_id", "text"), "row_id").select("*", other)
    pair = F.array(F.least("block", "other"), F.greatest("block", "other")).alias("pair")
    pairs = texts.select("coarse", pair, "block", F.col("row_id").alias("id"), "copies", (F.col("blocks") > 1).alias("several"), "text")
    verdicts = stage(in_groups(pairs))
    exact = components(verdicts.filter("several").select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("id"), F.col("root").alias("whole"))
    classes = verdicts.groupBy("id").agg(F.sum("links").alias("links"), F.min("root").alias("root")).join(exact, "id", "left")
    classes = classes.select("id", "links", F.coalesce("whole", "root").alias("root"))
    done = sets.drop("tokens").join(classes, "id", "left").select(*key, "id", "copies", "least", F.coalesce("root", "id").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return all_rows, stage(done)


def in_groups(pairs: DataFrame) -> DataFrame:
    """``compared`` on each (coarse class, pair of blocks): small groups come many to a batch."""

    def run(batches):
        held = None
        for batch in released(batches):
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            held = held.combine_chunks()
            keys = list(zip(held.column("coarse").to_pylist(), map(tuple, held.column("pair").to_pylist())))
            start = 0
            for i in range(1, len(keys)):
                if keys[i] != keys[start]:
                    yield from compared(held.slice(start, i - start).combine_chunks()).to_batches()
                    start = i
            held = held.slice(start)
        if held is not None and held.num_rows:
            yield from compared(held.combine_chunks()).to_batches()

    sorted_ = pairs.repartition("coarse", "pair").sortWithinPartitions("coarse", "pair", "id")
    return sorted_.mapInArrow(run, "id long, links long, root long, several boolean")


def classed(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links, n_class) per row: the least doc_id of its class, its links, the class's documents."""
    all_rows, sets = near_sets(numbered(docs))
    bulk = sets.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("n_class"))
    sets = sets.join(bulk, "root").select("set_a", "set_b", "n_shingles", "class_id", "n_links", "n_class")
    found = all_rows.drop("tokens").join(sets, ["set_a", "set_b", "n_shingles"], "left")
    return found.select("doc_id", F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_class", F.lit(1)).alias("n_class"))


def surplus(docs: DataFrame) -> DataFrame:
    """row_id of every row of ``docs`` that isn't the first of its class."""
    all_rows, sets = near_sets(numbered(docs))
    joined = all_rows.select("row_id", "set_a", "set_b", "n_shingles").join(sets, ["set_a", "set_b", "n_shingles"])
    return joined.filter("row_id <> root").select("row_id")
