import math
import re
from collections import Counter

from cairn.llm import quality_rules as qr
from cairn.llm.common import stage


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    spans = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if spans[tuple(words[i : i + 5])] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def test_matches_brute_force(spark, words):
    texts = [None, "", " \n\t", "one", "a b\x0bc\x0cd\re", "  lead and trail  ", "é ü x # *$ | <>&%\n\n\nsame\nsame\n same\nsame", "a a a a a a a a a a a a", "l1 l1\nl1 l1\r\n"]
    texts += [words(20 + 7 * i, i) for i in range(30)] + [words(50, 5) + " x " + words(50, 5), words(30, 6) + " " + " ".join(words(30, 6).split()[3:11]) + "\n" + words(100, 8), words(5000, 9, 30)]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(12, texts[12], 0)]
    docs = stage(spark.createDataFrame(rows, "doc_id long, text string, words int"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10, 40)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    ratios = qr.log_ratios(docs, labels)
    got = qr.ruled(docs, ratios).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:7] == brute(texts[r.doc_id]), r.doc_id
        assert r.kept == (not r.base_failed and r.score >= qr.THRESHOLD)
    assert any(r.kept for r in got)


def test_ratios_tell_target_from_raw(spark, words):
    good, bad = [words(80, i, 50) for i in range(30)], [words(80, i, 50).upper() for i in range(30)]
    docs = stage(spark.createDataFrame(list(enumerate(good + bad)), "doc_id int, text string"))
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id int, quality int")
    score = {r.doc_id: r.score for r in qr.judged(docs, labels).collect()}
    assert min(score[i] for i in range(30)) > max(score[i] for i in range(30, 60))
    assert all(math.isfinite(x) for x in score.values())


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in qr.judged(docs, labels).collect()] == [0.0]
    assert qr.judged(docs.limit(0), labels).count() == 0
