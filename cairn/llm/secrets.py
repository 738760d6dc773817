"""Secrets in texts: base patterns, and literals that reach sensitive names by assignment.

The lexer reads each place where a name meets ``=``, ``:``, ``:=`` or ``=>``
(source code, shell, JSON, YAML, INI, properties, XML elements and key-value
attributes), with quotes, brackets and type annotations around the name. The
value is a chain of string literals, bare words and names joined by ``+``,
``.``, ``..``, ``&`` or by standing together; names and ``${name}`` give what
was last assigned to them in the text, so a constant is followed through any
number of names. A literal counts when the name it comes to is sensitive and it
looks made up rather than written: then each piece it was put together from is
a span.

A null text is empty; an empty text has no spans; rows with equal texts or
doc_ids are rows of their own; an empty table gives no rows; other columns are
ignored. Texts are read whole, one at a time, in time linear in their length. A
value of under 8 or over 4096 characters is no credential: it isn't scored, and
of long ones nothing is handed on to other names.
"""

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released

#: Fixed kinds in the order in which they are listed, and their patterns.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

LONGEST = 4096
THRESHOLD = 0.5
NAME = r"[A-Za-z_$][\w$.-]*+"
#: A name, what may close it, an annotated type, and the sign of an assignment.
SITE = re.compile(rf"""(?<![\w$.-])({NAME})["']?\]?[ \t]*+(?::[ \t]*+[A-Za-z_&*][\w.<>\[\]?|&]*+[ \t]*+(?==(?!=)))?(?::=|=>|=(?![=~>])|:(?![:=/]))""")
ELEMENT = re.compile(rf"<({NAME})>([^<>]*+)</")
PAIR = re.compile(rf"""(?:key|name)\s*+=\s*+["']({NAME})["']\s++value\s*+=\s*+(["'])""", re.I)
STRING = re.compile(r"""[rbufRBUF@$]{0,2}(?:\"\"\"(.*?)\"\"\"|'''(.*?)'''|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`((?:[^`\\]|\\.)*+)`)""", re.S)
REFERENCE = re.compile(r"\$\{?([A-Za-z_]\w*+)\}?|%([A-Za-z_]\w*+)%")
BARE = re.compile(r"""[^\s,;#"'`()\[\]{}<>=&:]++=*+""")
JOIN = re.compile(r"""[ \t]*+(?:\+|\.\.|(?<=[ \t])&(?=[ \t])|\.(?=[ \t]*+["'])|\\\n)[ \t]*+\n?[ \t]*+|[ \t]*+(?=["'])""")
INSIDE = re.compile(r"\$?\{([A-Za-z_]\w*+)\}|\$([A-Za-z_]\w*+)")
CALL = re.compile(r"[ \t]*+[(\[]")

#: Fixed words: a name with one of the first is sensitive, with one of the second rather, unless one of the third says that it isn't the thing itself.
STRONG = {"password", "passwd", "pwd", "passphrase", "passcode", "secret", "token", "apikey", "credential", "credentials"}
WEAK = {"key", "auth", "authorization", "bearer", "signature", "salt", "pass", "cookie", "session", "jwt", "pat"}
COMPOUND = {("api", "key"), ("access", "key"), ("private", "key"), ("secret", "key"), ("signing", "key"), ("encryption", "key"), ("account", "key"), ("master", "key"), ("shared", "key"), ("auth", "key")}
OTHERWISE = {"count", "length", "len", "max", "min", "limit", "type", "file", "path", "url", "uri", "id", "name", "field", "label", "size", "regex", "pattern", "policy", "expiry", "expires", "hint", "public", "ttl", "header", "prefix"}
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
PLACEHOLDER = re.compile(r"(?i)(?:x+|\*+|\.+|-+|change.?me.*|.*example.*|your.*|my.*|.*placeholder.*|none|null|nil|true|false|undefined|todo|tbd|dummy.*|test.*|sample.*|(?:pass(?:word|wd)|secret|token)\d*)\Z")
CLASSES = [re.compile(x) for x in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]


def sensitivity(name: str) -> float:
    """How much a name speaks of a credential, from 0 to 1."""
    words = [w.lower() for w in WORDS.findall(name)]
    pairs = set(zip(words, words[1:]))
    score = 1.0 if STRONG & {*words, *("".join(p) for p in pairs)} or COMPOUND & pairs else 0.6 if WEAK & {*words} else 0.0
    return score * (0.2 if OTHERWISE & {*words} else 1.0)


def strength(value: str) -> float:
    """How much a literal looks like a credential, from 0 to 1."""
    if not LEAST_VALUE <= len(value) <= LONGEST or PLACEHOLDER.match(value):
        return 0.0
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    kinds = sum(bool(c.search(value)) for c in CLASSES)
    score = min(1.0, entropy / 3.2) * min(1.0, 0.25 + 0.25 * kinds)
    if kinds < 2:
        score *= 0.5 if len(value) < 20 or entropy < 3 else 1.0
    if re.search(r"\s", value) or "://" in value or value.count("/") > 2 and not CLASSES[2].search(value):
        score *= 0.3
    return score


def piece(text: str, start: int, end: int, known: dict) -> list[tuple[int, int]]:
    """Spans of a literal, the constants that it names inside put in their places."""
    out, at = [], start
    for m in INSIDE.finditer(text, start, end):
        spans = known.get(m[1] or m[2])
        if spans:
            out += [(at, m.start()), *spans]
            at = m.end()
    return [s for s in [*out, (at, end)] if s[0] < s[1]]


def value_at(text: str, at: int, known: dict) -> list[tuple[int, int]] | None:
    """Spans that the expression at a place is made of; None if it isn't constant."""
    out, first = [], True
    while True:
        if m := STRING.match(text, at):
            k = next(k for k in range(1, 6) if m.start(k) >= 0)
            out += piece(text, m.start(k), m.end(k), known)
        elif m := REFERENCE.match(text, at):
            spans = known.get(m[1] or m[2])
            if spans is None:
                return None
            out += spans
        elif m := BARE.match(text, at):
            if CALL.match(text, m.end()):
                return None
            spans = known.get(m[0])
            if spans is None and not first:
                return None
            out += [m.span()] if spans is None else spans
        else:
            return out if not first else None
        first = False
        follow = JOIN.match(text, m.end())
        if sum(b - a for a, b in out) > LONGEST:
            return None
        if not follow or (m.re is BARE and follow[0].strip() == ""):
            return out
        at = follow.end()


def assignments(text: str):
    """(name, spans of its value) of each assignment of constants, in order."""
    known: dict[str, list] = {}
    found = [(m.end(), 0, m) for m in SITE.finditer(text)]
    if "<" in text:
        found += [(m.start(), 1, m) for m in ELEMENT.finditer(text)] + [(m.end(2), 2, m) for m in PAIR.finditer(text)]
        found.sort(key=lambda x: x[:2])
    for at, kind, m in found:
        name = m[1]
        if kind == 1:
            spans = piece(text, *m.span(2), known)
        elif kind == 2:
            spans = value_at(text, m.start(2), known)
        else:
            while at < len(text) and text[at] in " \t":
                at += 1
            spans = value_at(text, at, known)
        short = name.rpartition(".")[2]
        if spans is None:
            known.pop(name, None)
            known.pop(short, None)
            continue
        known[name] = known[short] = spans
        yield name, spans


def literal_spans(text: str) -> dict[tuple[int, int], float]:
    """Spans of literals that reach sensitive names, with their scores."""
    out: dict[tuple[int, int], float] = {}
    for name, spans in assignments(text):
        meaning = sensitivity(name)
        if meaning >= THRESHOLD:
            score = meaning * strength("".join(text[a:b] for a, b in spans))
            if score >= THRESHOLD:
                for span in spans:
                    out[span] = max(score, out.get(span, 0.0))
    return out


def secrets_of(text: str) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end, score) by start, then kind as listed."""
    found = [(*s, 1.0) for s in base_spans(text)]
    if "=" in text or ":" in text or "<" in text:
        found += [("literal", *span, score) for span, score in literal_spans(text).items()]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
FOUND = "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>"


def scan(batches):
    for batch in batches:
        ids, texts, done = batch.column("doc_id"), batch.column("text"), 0
        out: list = []
        for i in range(batch.num_rows):
            spans = secrets_of(texts[i].as_py() or "")
            out.append([dict(zip(("kind", "start", "end", "score"), s)) for s in spans])
            if len(out) == 1024 or len(spans) > 100_000 or i == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([ids.slice(done, len(out)), pa.array(out, pa.list_(SPAN))], ["doc_id", "spans"])
                done, out = i + 1, []


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row of ``docs`` (doc_id, text); offsets are code points, ends exclusive."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: released(scan(batches)), FOUND)


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
