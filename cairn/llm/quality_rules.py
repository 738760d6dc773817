"""Quality rules and an n-gram log-likelihood ratio, in DataFrame functions only.

Words and word pairs are hashed to ``BUCKETS``. Their counts over all
documents (raw) and over trusted ones (target) make two smoothed multinomials;
a document's score is the mean of log(target / raw) over its n-grams, so it
doesn't depend on length, and the document is kept if the score is
``THRESHOLD`` or more and the base rules hold. Counts are summed in the tasks
(``BUCKETS`` rows a task are shuffled, no text), and the table of ratios has
``BUCKETS`` numbers whatever the input.

Trusted documents are those labelled 1; their ids are broadcast, at most
``TRUSTED`` of them by hash order. Null texts and texts without words have no
words, score 0 and fail the base rules; with no trusted document all ratios
are 0; repeated rows are judged alike (and count each time); null doc_ids are
judged but never trusted; a very long text is judged whole, in one row's arrays
of 64-bit hashes (windows of five words are told apart by such a hash); other
columns are ignored; an empty table gives no rows.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 10_000
TRUSTED = 20_000
UNIFORM = 0.1
THRESHOLD = -0.05
LEAST_WORDS = 10
MOST_REPEATED = 20
#: Fixed sets: what separates words, and what counts as a symbol.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def hashed_words(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), its spaces, and the 64-bit hashes of its words and word pairs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    plain = F.col("text")
    for c in SPACES[1:]:
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    rows = rows.withColumn("parts", F.split(plain, " "))
    rows = rows.select("doc_id", "text", (F.size("parts") - 1).alias("spaces"), F.transform(F.array_remove("parts", ""), lambda w: F.xxhash64(w)).alias("words"))
    return rows.withColumn("pairs", F.transform(first("words", 1), lambda w, i: F.xxhash64(w, F.get("words", i + 1))))


def first(column: str, less: int) -> Column:
    """All but the last ``less`` of an array."""
    return F.slice(column, 1, F.greatest(F.size(column) - less, F.lit(0)))


def bucket(hash_: Column) -> Column:
    return F.pmod(hash_, F.lit(BUCKETS)).cast("int")


def sorted_places(spans: str) -> Column:
    """(hash, place) of an array in the order of the hashes, so that equal ones are neighbours."""
    return F.sort_array(F.transform(spans, lambda h, i: F.struct(h.alias("hash"), i.alias("place"))))


def log_ratios(docs: DataFrame, labels: DataFrame, most: int = TRUSTED) -> list[float]:
    """log(target / raw) of each bucket, each multinomial mixed with ``UNIFORM`` parts of the uniform one."""
    trusted = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    trusted = trusted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn("trusted", F.lit(1))
    rows = hashed_words(docs).join(F.broadcast(trusted), "doc_id", "left").select("words", "pairs", F.coalesce("trusted", F.lit(0)).alias("trusted"))
    grams = rows.select("trusted", F.explode(F.concat("words", "pairs")).alias("hash")).select("trusted", bucket(F.col("hash")).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("target")).collect()  # BUCKETS rows at most
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in counts:
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not sum(target):
        return [0.0] * BUCKETS
    sum_raw, sum_target = sum(raw), sum(target)
    part = lambda n, total: n / total + UNIFORM / BUCKETS
    return [math.log(part(t, sum_target) / part(r, sum_raw)) for t, r in zip(target, raw)]


def ruled(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """Base figures, score and verdict of every row of ``docs``."""
    words = F.col("words")
    n = F.size(words)
    spans = F.transform(first("pairs", 3), lambda p, i: F.xxhash64(p, F.get("pairs", i + 2), F.get("words", i + 4)))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    rows = hashed_words(docs).select(
        "doc_id",
        "words",
        "pairs",
        F.when(F.col("text").rlike(f"[{SYMBOLS}]"), F.length("text") - F.length(without(F.col("text"), SYMBOLS))).otherwise(F.lit(0)).cast("long").alias("n_symbols"),
        (F.length("text") - F.col("spaces")).cast("long").alias("word_chars"),
        lines.alias("lines"),
        spans.alias("spans"),
    )
    rows = rows.select(
        "doc_id",
        "words",
        "pairs",
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "spans",
        F.when(F.size(F.array_distinct("spans")) < F.size("spans"), sorted_places("spans")).alias("placed"),
    )
    same = lambda x, y: F.coalesce(x["hash"] == y["hash"], F.lit(False))
    again = F.transform("placed", lambda x, j: F.when(same(x, F.get("placed", j - 1)) | same(x, F.get("placed", j + 1)), x["place"]))
    rows = rows.withColumn("again", F.sort_array(F.filter(again, lambda i: i.isNotNull())))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, i: F.struct((a["n"] + i + 5 - F.greatest(i, a["end"])).alias("n"), (i + 5).alias("end"))
    repeated = F.coalesce(F.aggregate("again", start, step, lambda a: a["n"]), F.lit(0)).cast("long")
    table = F.lit(ratios)
    total = F.aggregate("pairs", F.aggregate("words", F.lit(0.0), lambda a, w: a + F.get(table, bucket(w))), lambda a, p: a + F.get(table, bucket(p)))
    score = F.when(n > 0, total / (2 * n - 1)).otherwise(F.lit(0.0))
    rows = rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"), score.alias("score"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("score") >= THRESHOLD)).alias("kept"), "score")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return ruled(docs, log_ratios(docs, labels))
