"""Language identification by rank-order n-gram profiles.

A profile lists a language's ``TOP`` most frequent character n-grams (1 to 3
letters, word edges marked) by rank. A text's own most frequent n-grams are
compared with each profile: a gram counts the difference of its two ranks, or
``TOP`` if the profile lacks it; the least sum wins, ties go to the first
language in order. Profiles count every training text; the counts are summed
in the tasks, so only distinct (language, gram) pairs are shuffled.

Null texts and texts without a letter are ``und`` with score 0; an empty
table gives no rows, and with no training text all are ``und``; rows with a
null lang teach nothing; repeated rows count each time when learning; a null
doc_id is never held out; a very long text is profiled whole, its grams counted
in one array; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import text_blocks

TOP = 400
#: Bits of a number that holds a group and a gram.
KEY_BITS = 63
UNKNOWN = "und"


def gram_counts(texts: list[str], groups: np.ndarray):
    """(group, gram, count) sorted by group and gram; grams are three 21-bit characters, short ones led by zeros."""
    none = np.zeros(0, np.int64)
    lowered = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return none, none, none
    sizes = np.array([len(t) for t in lowered])
    first = np.zeros(len(points), bool)
    first[np.cumsum(sizes) - sizes] = True
    used = np.flatnonzero(np.bincount(points))
    letters = np.array([p for p in used.tolist() if chr(p).isalpha()], np.int64)
    digit = np.zeros(int(used[-1]) + 1, np.int64)
    digit[:] = 1
    digit[letters] = np.arange(len(letters)) + 2
    values = np.concatenate(([0, 1], letters))
    symbol = digit[points]
    group = np.repeat(groups.astype(np.int64), sizes)
    keep = symbol > 1
    keep[1:] |= symbol[:-1] > 1
    keep |= first
    symbol, group = symbol[keep], group[keep]
    bits = int(len(letters) + 2).bit_length()
    a, b, c = symbol[:-2], symbol[1:-1], symbol[2:]
    one, two, three = symbol > 1, (symbol[:-1] > 1) | (symbol[1:] > 1), b > 1
    codes = np.concatenate((symbol[one], ((symbol[:-1] << bits) | symbol[1:])[two], ((a << 2 * bits) | (b << bits) | c)[three]))
    owner = np.concatenate((group[one], group[:-1][two], group[:-2][three]))
    if not len(codes):
        return none, none, none
    if int(owner.max()).bit_length() + 3 * bits <= KEY_BITS:
        keys = np.sort((owner << 3 * bits) | codes)
        owner, codes = keys >> 3 * bits, keys & ((1 << 3 * bits) - 1)
    else:  # so many different letters and groups that both don't fit one number
        order = np.lexsort((codes, owner))
        owner, codes = owner[order], codes[order]
    new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (codes[1:] != codes[:-1]))))
    count = np.diff(np.concatenate((new, [len(codes)])))
    owner, part = owner[new], codes[new]
    mask = (1 << bits) - 1
    gram = (values[part >> 2 * bits] << 42) | (values[(part >> bits) & mask] << 21) | values[part & mask]
    return owner, gram, count


def ranked(group: np.ndarray, gram: np.ndarray, count: np.ndarray, top: int):
    """The ``top`` most frequent grams of each group with their ranks; ties by gram."""
    most = int(count.max(initial=0))
    room = most.bit_length()
    if int(group.max(initial=0)).bit_length() + room + 32 <= 63:
        order = np.argsort((group << room + 32 | (most - count) << 32) | np.arange(len(group)))
    else:
        order = np.lexsort((gram, -count, group))
    group, gram = group[order], gram[order]
    first = np.searchsorted(group, group, "left")
    rank = np.arange(len(group)) - first
    keep = rank < top
    return group[keep], gram[keep], rank[keep]


def counter(batches):
    for batch in batches:
        at = 0
        for texts in text_blocks(batch.column("text")):
            langs = batch.column("lang").slice(at, len(texts)).to_pylist()
            at += len(texts)
            names = sorted(set(langs))
            group, gram, count = gram_counts(texts, np.array([names.index(x) for x in langs]))
            yield pa.RecordBatch.from_arrays([pa.array([names[g] for g in group.tolist()], pa.string()), pa.array(gram, pa.int64()), pa.array(count, pa.int64())], ["lang", "gram", "n"])


def profiles(training: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, gram, rank) of the ``top`` grams of each language of ``training`` (text, lang)."""
    rows = training.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    counts = rows.mapInArrow(counter, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    return counts.withColumn("rank", rank).filter(F.col("rank") < top).select("lang", "gram", "rank")


def predictor(langs: list[str], grams: np.ndarray, ranks: np.ndarray, top: int):
    """Task: out-of-place distance of each text to each profile; ``ranks`` is [gram, language]."""

    def run(batches):
        for batch in batches:
            at = 0
            for texts in text_blocks(batch.column("text")):
                best = np.full(len(texts), -1)
                score = np.zeros(len(texts))
                group, gram, rank = ranked(*gram_counts(texts, np.arange(len(texts))), top)
                if len(group) and len(langs):
                    place = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
                    theirs = np.where((grams[place] == gram)[:, None], ranks[place], top)
                    apart = np.where(theirs == top, top, np.abs(theirs - rank[:, None]))
                    first = np.flatnonzero(np.concatenate(([True], np.diff(group) != 0)))
                    total = np.add.reduceat(apart, first, axis=0)
                    size = np.diff(np.concatenate((first, [len(group)])))
                    best[group[first]] = np.argmin(total, axis=1)
                    score[group[first]] = 1 - total.min(axis=1) / (top * size)
                names = [langs[k] if k >= 0 else UNKNOWN for k in best.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), batch.column("held_out").slice(at, len(texts)), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])
                at += len(texts)

    return run


def predicted(docs: DataFrame, learned: DataFrame, top: int = TOP) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of ``docs`` (doc_id, text, held_out)."""
    found = learned.collect()  # top rows a language
    langs = sorted({r.lang for r in found})
    grams = np.unique(np.array([r.gram for r in found], np.int64))
    ranks = np.full((len(grams), len(langs)), top)
    for r in found:
        ranks[np.searchsorted(grams, r.gram), langs.index(r.lang)] = r["rank"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(predictor(langs, grams, ranks, top), "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, is_held_out: F.Column) -> DataFrame:
    """Learn from the rows with a lang that aren't held out, predict all."""
    rows = docs.select("doc_id", "text", "lang", F.coalesce(is_held_out, F.lit(False)).alias("held_out"))
    return predicted(rows, profiles(rows.filter(~F.col("held_out"))))
