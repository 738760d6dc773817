"""Prefix trie of conversations, built as a burst trie.

A turn is a token of 20 bytes (half of a SHA-256 of role and text, and its
words), so a conversation is one short binary and byte order is the order of
the trie. Distinct sequences lie in containers, one below each trie head and
next turn. A container with more sequences or turns than it may hold bursts: a
new head takes what all its sequences share (their least and greatest tell
it), and they are dealt out again by the turn that follows, whatever the number
of copies or the length of what is shared. The other containers are sorted and
swept into nodes, each by one task at a time; heads get their figures from what
lies below them, by sums that are partial before any shuffle.

Turns are ordered by (turn, digest of role and text), null turns first; null
roles and texts count as empty; a turn that stands in two equal rows is two
turns; rows without a conv_id belong to no conversation; an empty table gives
no nodes; other columns are ignored. A conversation's tokens (20 bytes a turn,
not its texts) must fit a row; a node's SHA-256 over its ends is fed in order
by one task, from joined blocks of conv_ids.
"""

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts_for, stage

TOKEN = 20
#: What a container may hold: sequences, and bytes of tokens.
SEQUENCES, CONTAINER_BYTES = 256, 1 << 24
#: Ends are joined in blocks of 2**12 conv_ids.
BLOCK_BITS = 12
WORD = r"[^ \t-\r]+"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def tokens(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids): each conversation's turns in order, as joined tokens."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)
    token = F.unhex(F.concat(digest, F.lpad(F.hex(F.regexp_count(text, F.lit(WORD))), 8, "0")))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), token.alias("token")).alias("t")).filter("conv_id is not null")
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.hex(t["token"]))
    return turns.groupBy("conv_id").agg(F.unhex(F.array_join(ordered, "")).alias("ids"))


def rebuilt(convs: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Each conversation with its first h turns replaced by those of the first of its ``group``; h is by checksum, below ``most``."""
    c = F.col("conv_id")
    first = c - c % group
    heads = convs.filter(c % group == 0).select(c.alias("first"), F.substring("ids", 1, TOKEN * (most - 1)).alias("head"))
    h = (F.crc32(c.cast("string")) % most).cast("int")
    own = F.expr(f"substring(ids, h * {TOKEN} + 1)")
    rows = convs.select("conv_id", "ids", first.alias("first"), h.alias("h")).join(heads, "first", "left")
    taken = F.coalesce(F.expr(f"substring(head, 1, h * {TOKEN})"), F.lit(b""))
    return rows.select("conv_id", F.concat(taken, own).alias("ids"))


def sequences(convs: DataFrame) -> DataFrame:
    """(ids, n, conv_id, ends_sha256) of each distinct sequence: how many conversations it is, the least, and the digest of all."""
    block = F.shiftright("conv_id", BLOCK_BITS)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    blocks = convs.groupBy("ids", block.alias("block")).agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), joined.alias("joined"))
    return blocks.repartition("ids").sortWithinPartitions("ids", "block").mapInArrow(digested, "ids binary, n long, conv_id long, ends_sha256 string")


def rows_of(batches, *names):
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield from zip(*(batch.column(n).slice(at, 1024).to_pylist() for n in names))


def batched(rows, schema: pa.Schema, size: int = 4096):
    """Record batches of tuples."""
    out = []
    for row in rows:
        out.append(row)
        if len(out) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def digested(batches):
    """Task: the blocks of each sequence, one after another, as one digest."""

    def found():
        for ids, blocks in groupby(rows_of(batches, "ids", "n", "conv_id", "joined"), key=lambda r: r[0]):
            sha, total, least = hashlib.sha256(), 0, None
            for _, n, conv_id, joined in blocks:
                sha.update((("," if total else "") + joined).encode())
                total, least = total + n, conv_id if least is None else least
            yield ids, total, least, sha.hexdigest()

    kinds = [("ids", pa.binary()), ("n", pa.int64()), ("conv_id", pa.int64()), ("ends_sha256", pa.string())]
    return batched(found(), pa.schema(kinds))


def prefix(turns: Column | int) -> Column:
    """The digest that names a node: of the first ``turns`` tokens of ``ids``."""
    return F.unhex(F.md5(F.substring(F.col("ids"), F.lit(1), F.lit(turns) * TOKEN if isinstance(turns, int) else turns * TOKEN)))


def shared_turns(a: str, b: str) -> Column:
    """Tokens that two binaries share at their start."""
    n = f"cast(least(length({a}), length({b})) / {TOKEN} as int)"
    same = f"transform(sequence(1, greatest({n}, 1)), i -> substring({a}, i * {TOKEN} - {TOKEN - 1}, {TOKEN}) = substring({b}, i * {TOKEN} - {TOKEN - 1}, {TOKEN}))"
    return F.expr(f"CASE WHEN {n} = 0 THEN 0 WHEN array_position({same}, false) = 0 THEN {n} ELSE cast(array_position({same}, false) as int) - 1 END")


def burst(seqs: DataFrame, most_sequences: int, most_bytes: int) -> tuple[DataFrame, list[DataFrame]]:
    """Settled containers' sequences (with ``container`` and ``at``, the turns of its top node), and the heads of each round.

    A head (key, up, at, upto, chain, own) spans the nodes of depths at..upto
    that all its sequences pass; ``key`` names the lowest, ``up`` the node
    above the highest, ``chain`` has their tokens and ``own`` the sequence that
    ends at the lowest.
    """
    root = seqs.filter("length(ids) = 0").select(F.struct("n", "conv_id", "ends_sha256").alias("own"))
    rest = seqs.filter("length(ids) > 0").withColumn("at", F.lit(1)).withColumn("container", prefix(1))
    heads, settled = [root], None
    while True:
        size = rest.groupBy("container", "at").agg(F.count("*").alias("seqs"), F.sum(F.length("ids") - (F.col("at") - 1) * TOKEN).alias("bytes"), F.min("ids").alias("ids"), F.max("ids").alias("high"))
        large = size.filter((F.col("seqs") > 1) & ((F.col("seqs") > most_sequences) | (F.col("bytes") > most_bytes)))
        large = large.withColumn("upto", shared_turns("ids", "high"))
        large = stage(large.select("container", "at", "upto", prefix(F.col("at") - 1).alias("up"), prefix(F.col("upto")).alias("key"), F.expr(f"substring(ids, (at - 1) * {TOKEN} + 1, (upto - at + 1) * {TOKEN})").alias("chain")))
        if large.isEmpty():
            return (rest if settled is None else settled.unionByName(rest)), heads
        dealt = stage(rest.join(large.select("container", "upto"), "container", "left"))
        ends = dealt.filter(f"length(ids) = upto * {TOKEN}").select("container", F.struct("n", "conv_id", "ends_sha256").alias("own"))
        heads.append(stage(large.join(ends, "container", "left").select("key", "up", "at", "upto", "chain", "own")))
        kept = dealt.filter("upto is null").drop("upto")
        settled = kept if settled is None else settled.unionByName(kept)
        rest = dealt.filter(f"length(ids) > upto * {TOKEN}").withColumn("at", F.col("upto") + 1).drop("upto").withColumn("container", prefix(F.col("at")))


NODE = "conv_id long, depth long, parent_conv_id long, up binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NODE_SCHEMA = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[k]) for n, k in (x.split() for x in NODE.split(", "))])


def shared(a: bytes, b: bytes) -> int:
    """Tokens that two sequences share at their start."""
    low, high = 0, min(len(a), len(b)) // TOKEN
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * TOKEN] == b[: mid * TOKEN] else (low, mid - 1)
    return low


class Open:
    """A node on the path that is being swept."""

    __slots__ = ("conv_id", "depth", "parent", "n", "children", "leaves", "saved", "ends")

    def __init__(self, depth, parent):
        self.conv_id, self.depth, self.parent, self.ends = None, depth, parent, NO_ENDS
        self.n = self.children = self.leaves = self.saved = 0

    def add(self, conv_id, n):
        self.conv_id, self.n = conv_id if self.conv_id is None else min(self.conv_id, conv_id), self.n + n


def nodes_of(container) -> list[Open]:
    """The nodes of one container: its sorted sequences (ids, n, conv_id, ends, at)."""
    made, path, last = [], [], b""

    def close(node, ids):
        if not node.children:
            node.leaves = 1
        node.saved += (node.n - 1) * int.from_bytes(ids[node.depth * TOKEN - 4 : node.depth * TOKEN], "big")
        if node.parent is not None:
            up = node.parent
            up.add(node.conv_id, node.n)
            up.children, up.leaves, up.saved = up.children + 1, up.leaves + node.leaves, up.saved + node.saved

    for ids, n, conv_id, ends, at in container:
        keep = shared(last, ids)
        while path and path[-1].depth > keep:
            close(path.pop(), last)
        for depth in range(max(at, keep + 1), len(ids) // TOKEN + 1):
            path.append(Open(depth, path[-1] if path else None))
            made.append(path[-1])
        path[-1].add(conv_id, n)
        path[-1].ends, last = ends, ids
    while path:
        close(path.pop(), last)
    return made


def swept(batches):
    """Task: nodes of the containers whose sorted sequences stand one after another."""

    def found():
        rows = rows_of(batches, "container", "ids", "n", "conv_id", "ends_sha256", "at", "up")
        for _, group in groupby(rows, key=lambda r: r[0]):
            up = None

            def own():
                nonlocal up
                for _, *row, up in group:
                    yield row

            for x in nodes_of(own()):
                above = x.parent
                yield x.conv_id, x.depth, above and above.conv_id, None if above else up, x.n, x.children, x.leaves, x.saved, x.ends

    return batched(found(), NODE_SCHEMA)


def head_nodes(heads: DataFrame, tops: DataFrame) -> DataFrame:
    """All nodes of heads, from the nodes right below them."""
    below = tops.groupBy(F.col("up").alias("key")).agg(
        F.sum("n_convs").alias("n"), F.min("conv_id").alias("least"), F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )
    n = F.col("n") + F.coalesce("own.n", F.lit(0))
    rows = heads.join(below, "key").select("key", "up", "at", "upto", "chain", "children", "leaves", "saved", n.alias("n"), F.least("least", "own.conv_id").alias("conv_id"), F.coalesce("own.ends_sha256", F.lit(NO_ENDS)).alias("ends"))
    # Below a node of the chain lie the texts of the chain from there on and all that lies below the chain.
    words = F.expr(f"transform(sequence(upto, at, -1), d -> conv(hex(substring(chain, (d - at) * {TOKEN} + {TOKEN - 3}, 4)), 16, 10))")
    rows = rows.select("*", F.posexplode(words).alias("back", "words"))
    over = F.expr("sum(words) over (partition by key order by back)").cast("long")
    lowest, highest = F.col("back") == 0, F.col("back") == F.col("upto") - F.col("at")
    return rows.select(
        "conv_id", (F.col("upto") - F.col("back")).cast("long").alias("depth"), F.when(~highest, F.col("conv_id")).alias("parent_conv_id"), F.when(highest, F.col("up")).alias("up"), F.col("n").alias("n_convs"),
        F.when(lowest, F.col("children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") + (F.col("n") - 1) * over).alias("saved_tokens"),
        F.when(lowest, F.col("ends")).otherwise(NO_ENDS).alias("ends_sha256"), F.when(lowest, F.col("key")).alias("key"),
    )


def trie(convs: DataFrame, most_sequences: int = SEQUENCES, most_bytes: int = CONTAINER_BYTES) -> DataFrame:
    """The nodes of ``convs`` (conv_id, ids), the root included."""
    seqs = stage(sequences(convs))
    settled, (root, *heads) = burst(seqs, most_sequences, most_bytes)
    parts = parts_for(seqs.count(), 4 * SEQUENCES)
    rows = settled.withColumn("up", prefix(F.col("at") - 1)).repartition(parts, "container").sortWithinPartitions("container", "ids")
    nodes = stage(rows.mapInArrow(swept, NODE))
    tops = nodes.filter("up is not null").select("up", "conv_id", "n_convs", "n_leaves", "saved_tokens")
    known = []
    for level in reversed(heads):
        made = stage(head_nodes(level, tops))
        known.append(made)
        tops = tops.unionByName(made.filter("up is not null").select(*tops.columns))
    top = F.lit(hashlib.md5(b"").digest())
    first = root.select(top.alias("up"), F.col("own.conv_id").alias("conv_id"), F.col("own.n").alias("n_convs"), F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.col("own.ends_sha256").alias("ends"), F.lit(0).alias("child"))
    both = tops.filter(F.col("up") == top).withColumn("ends", F.lit(None).cast("string")).withColumn("child", F.lit(1)).unionByName(first)
    whole = both.agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.coalesce(F.max("ends"), F.lit(NO_ENDS)).alias("ends_sha256"))
    none = F.lit(None).cast("long")
    above = stage(whole.filter("conv_id is not null").select("conv_id", F.lit(0).cast("long").alias("depth"), none.alias("parent_conv_id"), F.lit(None).cast("binary").alias("up"), "n_convs", "n_children", F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"), "saved_tokens", "ends_sha256", top.alias("key")))
    for made in known:
        above = above.unionByName(made)
    # A top node's parent is a head's lowest node; all others know theirs.
    lowest = above.filter("key is not null").select(F.col("key").alias("up"), F.col("conv_id").alias("above"))
    every = nodes.unionByName(above.drop("key"))
    linked = every.filter("up is not null").join(lowest, "up").withColumn("parent_conv_id", F.col("above")).drop("above")
    columns = [x.split()[0] for x in NODE.split(", ") if not x.startswith("up ")]
    return every.filter("up is null").select(*columns).unionByName(linked.select(*columns))


def conversation_trie(conversations: DataFrame, most_sequences: int = SEQUENCES, most_bytes: int = CONTAINER_BYTES) -> DataFrame:
    """The nodes of rebuilt ``conversations`` (conv_id, turn, role, text): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return trie(rebuilt(stage(tokens(conversations))), most_sequences, most_bytes)
