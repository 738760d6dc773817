r"""Chat formatting with loss masks aligned by token offsets.

A conversation is rendered whole, encoded once, and each token span is set
against the sorted spans of assistant texts by binary search. Three marks stand
for the beginning of a turn, of its text, and its end. They are added to the
loaded tokenizer as tokens of their own (after its vocabulary; nothing is
trained), so no token reaches over the edge of a text: the tokens under the
mask are the assistant texts exactly, and everything is read back from ids and
mask alone. Marks begin with "<"; inside roles and texts "<", "[" and the
backslash are escaped, so no text can open or close a turn, and parsing gives
every turn back.

Turns are ordered by (turn, role, text), nulls first; null roles and texts
count as empty; repeated rows are turns of their own; a null conv_id is a
conversation; an empty table gives no rows; other columns are ignored. A
conversation is one row however long its texts are (it must fit one).
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, TEXT, CLOSE = MARKS = "<|turn|>", "<|text|>", "<|end|>"
AFTER = "\n"
LEARNED = "assistant"
#: Conversations are encoded in groups of so many characters (one conversation: more).
GROUP_CHARS = 1 << 19
#: Fixed escapes.
ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
PLAIN = {v[1]: k for k, v in ESCAPES.items()}


def encoder(path: str):
    """The tokenizer of a file, with the marks as tokens of their own."""
    from tokenizers import AddedToken, Tokenizer

    tool = Tokenizer.from_file(path)
    tool.add_tokens([AddedToken(m, normalized=False) for m in MARKS])
    # Special tokens of the file are ordinary text in a text.
    tool.encode_special_tokens = True
    return tool


def escaped(text: str) -> str:
    for plain, code in ESCAPES.items():
        text = text.replace(plain, code)
    return text


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: PLAIN.get(m[1], m[0]), text)


def rendered(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escaped(role)}{TEXT}", escaped(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE + AFTER]
        at += len(head) + len(body) + len(CLOSE + AFTER)
    return "".join(parts), spans


def parsed(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out = []
    for part in formatted.split(OPEN)[1:]:
        role, _, body = part.partition(TEXT)
        out.append((unescaped(role), unescaped(body[: -len(CLOSE + AFTER)])))
    return out


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tokens that overlap a span; spans are sorted and disjoint, and no token reaches over the edge of one."""
    spans = [s for s in spans if s[0] < s[1]]
    if not spans:
        return np.zeros(len(ends), bool)
    low, high = np.array(spans).T
    at = np.searchsorted(high, starts, "right")
    return (at < len(high)) & (low[np.minimum(at, len(low) - 1)] < ends)


def token_spans(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans from where tokens end; one that ends in the same character as the last shares it."""
    ends = np.maximum.accumulate(ends) if len(ends) else ends
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    return np.where(starts == ends, np.maximum(ends - 1, 0), starts), ends


FORMATTED = "conv_id long, n_turns long, formatted string, ids array<int>, ends array<int>, loss array<boolean>"


def by_size(made: list) -> list[list]:
    """Rendered conversations in groups of about ``GROUP_CHARS`` characters."""
    out, size = [[]], 0
    for one in made:
        if size >= GROUP_CHARS:
            out.append([])
            size = 0
        out[-1].append(one)
        size += len(one[0])
    return out


def lists_of(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays])))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat).cast(kind))


def arrays_of(column: pa.Array) -> list[np.ndarray]:
    """The rows of an Arrow list column as views of one array."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def formatter(tokenizer: str):
    def run(batches):
        tool = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                turns = [[(x["role"] or "", x["text"] or "") for x in conv] for conv in part.column("turns").to_pylist()]
                for group in by_size([(*rendered(t), conv_id, len(t)) for conv_id, t in zip(part.column("conv_id").to_pylist(), turns)]):
                    codes = tool.encode_batch([f for f, *_ in group], add_special_tokens=False)
                    ends = [np.fromiter((e for _, e in c.offsets), np.int64, len(c)) for c in codes]
                    masks = [loss_mask(*token_spans(e), s) for e, (_, s, *_) in zip(ends, group)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([i for *_, i, _ in group], pa.int64()),
                            pa.array([n for *_, n in group], pa.int64()),
                            pa.array([f for f, *_ in group], pa.string()),
                            lists_of([np.array(c.ids, np.int32) for c in codes], pa.int32()),
                            lists_of(ends, pa.int32()),
                            lists_of(masks, pa.bool_()),
                        ],
                        [x.split()[0] for x in FORMATTED.split(", ")],
                    )

    return run


def formatted(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """One row a conversation: the text, its ids, where tokens end, and the loss mask."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turns"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turns")).alias("turns"))
    return whole.mapInArrow(formatter(tokenizer), FORMATTED)


def said(tool, ids: np.ndarray, loss: np.ndarray) -> tuple[str, str]:
    """What ids say, and what those under the mask say."""
    whole, learned = tool.decode_batch([ids.tolist(), ids[loss].tolist()], skip_special_tokens=False)
    return whole, unescaped(learned)


def reader(tokenizer: str):
    def run(batches):
        tool = encoder(tokenizer)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            out = []
            ids, losses = arrays_of(batch.column("ids")), arrays_of(batch.column("loss"))
            for conv_id, own, loss in zip(batch.column("conv_id").to_pylist(), ids, losses):
                text, learned = said(tool, own, loss)
                turns = parsed(text)
                out.append((conv_id, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), len(text)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return run


def digests(made: DataFrame, tokenizer: str) -> DataFrame:
    """What the ids and masks of formatted conversations give back; the formatted text is not looked at."""
    return made.select("conv_id", "ids", "loss").mapInArrow(reader(tokenizer), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
