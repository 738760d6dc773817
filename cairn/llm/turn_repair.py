"""Repair of conversations by alignment to the grammar ``(s?(ua)+)?`` of role initials.

Each conversation's turns are aligned (Wagner-Fischer) to the alternating
strings ``uaua...`` and ``suaua...``. Every feasible length is a prefix of one
of the two, so one matrix each holds all of them: its last row has the cost of
each length. Ukkonen's band keeps the diagonals that the incumbent's cost (of a
plain left-to-right repair) can pay for. Of the lengths that cost least, each
is traced back to its least audit, and the least of those stays. Memory is
turns times band for one conversation at a time.

Turns are ordered by (turn, role, text), null turns first; null roles and texts
are one space; equal rows stay next to each other (the second is a duplicate);
a null conv_id is a conversation; a conversation of lost rows only comes back
empty; an empty table gives no rows; other columns are ignored. A conversation
must fit one task, its repaired turns one row.
"""

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, UNENDED = 3, 2, 2, 1
NAMES = {"u": "user", "a": "assistant"}
NEVER = np.int32(1 << 29)
TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns array<struct<role:string,text:string>>"
FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, lost) as a faulty store would give them back, by checksum of ``conv_id:turn``."""
    c, t = (F.col(x).cast("long") for x in ("conv_id", "turn"))
    key = F.concat_ws(":", *[F.coalesce(x.cast("string"), F.lit(" ")) for x in (c, t)])
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("role", "text"))
    fault = F.col("fault")
    rows = conversations.select(c.alias("conv_id"), t.alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fault"))
    rows = rows.withColumn("text", F.when(fault.isin(0, 1), "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(fault == 4, "user").otherwise(F.col("role")))
    return rows.select("conv_id", "turn", "role", "text", (fault == 0).alias("lost"), F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))).alias("_")).drop("_")


def faults(turns: list[tuple[str, str]]) -> list[str]:
    """The first fault of each turn, or an empty text."""
    seen, out = set(), []
    for turn in turns:
        shown = turn[1].rstrip(SPACE)
        out.append("blank" if not shown else "duplicate" if turn in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add(turn)
    return out


def plain_cost(initials: str, kinds: list[str]) -> int:
    """Cost of repairing from left to right; no best repair costs more."""
    best = DELETE * len(kinds)
    for with_s in (False, True):
        cost, letter, pairs = 0, "s" if with_s else "u", 0
        for initial, kind in zip(initials, kinds):
            unended = UNENDED * (kind == "truncated")
            if kind in ("blank", "duplicate") or letter == "s" != initial:
                cost += DELETE
            elif initial == letter or initial not in NAMES:
                cost += unended + REROLE * (initial != letter)
                letter, pairs = {"s": "u", "u": "a", "a": "u"}[letter], pairs + (letter == "a")
            else:
                cost, pairs = cost + unended + INSERT, pairs + (initial == "a")
        if letter != "s":
            best = min(best, cost + INSERT * (letter == "a" or 2 * (with_s and not pairs)))
    return best


class Matrix:
    """Costs of aligning the first i turns to the first j letters of one string, for j - i in a band."""

    def __init__(self, initials: str, kinds: list[str], with_s: bool, limit: int):
        self.n, self.with_s, self.limit = len(kinds), with_s, limit
        self.low, self.high = -(limit // DELETE), limit // INSERT
        width = self.high - self.low + 1
        self.prices = [self.price(c, k) for c, k in zip(initials, kinds)]
        self.cost = np.full((self.n + 1, width), NEVER, np.int32)
        steps = INSERT * np.arange(width, dtype=np.int32)
        if with_s:
            self.cost[0, -self.low] = 0
        else:
            self.cost[0, -self.low :] = steps[: self.high + 1]
        for i, price in enumerate(self.prices, 1):
            row, last = self.cost[i], self.cost[i - 1]
            j = i + self.low
            by_letter = np.empty(width, np.int32)
            odd = j % 2  # the first cell of an odd column
            user_first = odd == (not with_s)
            by_letter[0::2], by_letter[1::2] = (price["u"], price["a"]) if user_first else (price["a"], price["u"])
            if with_s and 0 <= 1 - j < width:
                by_letter[1 - j] = price["s"]
            np.minimum(last + by_letter, NEVER, out=row)
            row[:-1] = np.minimum(row[:-1], last[1:] + DELETE)
            if -j >= 0:
                row[: -j + 1] = NEVER
                if -j < width:
                    row[-j] = DELETE * i
            first = max(0, -j + with_s)
            row[first:] = np.minimum(np.minimum.accumulate(row[first:] - steps[first:]) + steps[first:], NEVER)

    @staticmethod
    def price(initial: str, kind: str) -> dict[str, int]:
        """Of a turn that stays, by the letter it comes to stand for."""
        if kind in ("blank", "duplicate"):
            return dict.fromkeys("sua", NEVER)
        more = UNENDED * (kind == "truncated")
        return {x: more if x == initial else REROLE + more if x in NAMES else NEVER for x in "sua"}

    def letter(self, j: int) -> str:
        return "s" if self.with_s and j == 1 else "ua"[(j + self.with_s + 1) % 2]

    def at(self, i: int, j: int) -> int:
        k = j - i - self.low
        return int(self.cost[i, k]) if 0 <= k < self.cost.shape[1] and j >= 0 else int(NEVER)

    def lengths(self) -> dict[int, int]:
        """Cost of each length that the grammar allows."""
        least = 3 if self.with_s else 0
        return {j: self.at(self.n, j) for j in range(max(0, self.n + self.low), self.n + self.high + 1) if j >= least and j % 2 == self.with_s}

    def moves(self, i: int, j: int):
        """(edit, i, j before it) of the edits that lead to a cell at its cost."""
        cost = self.at(i, j)
        if i and self.at(i - 1, j) + DELETE == cost:
            yield "D", i - 1, j
        if j and self.letter(j) != "s" and self.at(i, j - 1) + INSERT == cost:
            yield "I", i, j - 1
        if i and j and self.at(i - 1, j - 1) + self.prices[i - 1][self.letter(j)] == cost:
            keeps = self.prices[i - 1][self.letter(j)] < REROLE
            yield "K" if keeps else "R", i - 1, j - 1

    def audit(self, length: int) -> str:
        """The least audit of an alignment to this length that costs least."""
        after: dict[tuple[int, int], dict[str, tuple[int, int]]] = {(self.n, length): {}}
        todo = [(self.n, length)]
        while todo:
            cell = todo.pop()
            for edit, *before in self.moves(*cell):
                before = tuple(before)
                if before not in after:
                    after[before] = {}
                    todo.append(before)
                after[before][edit] = cell
        out, cell = [], (0, 0)
        while cell != (self.n, length):
            edit = min(after[cell])
            out.append(edit)
            cell = after[cell][edit]
        return "".join(out)


def cheapest(initials: str, kinds: list[str]) -> tuple[int, str, bool]:
    """Cost and audit of the best repair, and whether its first letter is s."""
    limit = plain_cost(initials, kinds)
    tried = [Matrix(initials, kinds, with_s, limit) for with_s in (False, True) if not with_s or "s" in initials]
    found = [(cost, length, m) for m in tried for length, cost in m.lengths().items() if cost < NEVER]
    least = min(cost for cost, *_ in found)
    audit, with_s = min((m.audit(length), m.with_s) for cost, length, m in found if cost == least)
    return least, audit, with_s


def applied(turns: list[tuple[str, str]], audit: str, with_s: bool) -> list[tuple[str, str]]:
    """The turns that the edits of an audit leave."""
    out, rest = [], iter(turns)
    for edit in audit:
        turn = None if edit == "I" else next(rest)
        name = NAMES["ua"[(len(out) + with_s) % 2]]
        if edit != "D":
            out.append(turn if edit == "K" else (name, turn[1] if turn else ""))
    return out


def initial_of(role: str) -> str:
    """A role's initial; a space where it has none, which no letter equals."""
    return role[:1] or " "


def repair(turns: list[tuple[int | None, str, str]]) -> tuple:
    """Figures, audit and repaired turns of one conversation's ordered rows (turn, role, text)."""
    places = {t for t, *_ in turns if t is not None}
    said = [(role, text) for _, role, text in turns]
    kinds = faults(said)
    initials = "".join(initial_of(role) for role, _ in said)
    legal = ("su", "ua", "au")
    illegal = sum(initials[i : i + 2] not in legal for i in range(len(initials) - 1))
    cost, audit, with_s = cheapest(initials, kinds) if turns else (0, "", False)
    gaps = max(places) - min(places) + 1 - len(places) if places else 0
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, applied(said, audit, with_s))


def rows_of(batches):
    names = ("conv_id", "turn", "role", "text", "lost")
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            yield from zip(*(batch.column(n).slice(at, 64).to_pylist() for n in names))


def repair_task(batches):
    kinds = [pa.int64()] * 7 + [pa.string(), TURNS]
    names = ["conv_id", *FIGURES, "audit", "turns"]

    def record(done):
        columns = list(zip(*done))
        columns[-1] = [[{"role": r, "text": t} for r, t in turns] for turns in columns[-1]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    done, size = [], 0
    for conv_id, rows in groupby(rows_of(batches), key=lambda r: r[0]):
        done.append((conv_id, *repair([(turn, role, text) for _, turn, role, text, lost in rows if not lost])))
        size += sum(len(text) for _, text in done[-1][-1])
        if len(done) >= 512 or size >= 1 << 20:
            yield record(done)
            done, size = [], 0
    if done:
        yield record(done)


def repaired(rows: DataFrame) -> DataFrame:
    """One row a conversation of ``rows`` (conv_id, turn, role, text; ``lost``, if there, marks rows of which only the conversation is known)."""
    lost = F.coalesce("lost", F.lit(False)) if "lost" in rows.columns else F.lit(False)
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit(" ")).alias(x) for x in ("role", "text"))
    given = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text, lost.alias("lost"))
    return given.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(repair_task, REPAIRED)


def lines(turns: str) -> F.Column:
    """Repaired turns as text, one ``role:text`` each."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
