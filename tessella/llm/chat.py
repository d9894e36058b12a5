"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole, with control strings around every turn and
control strings inside texts escaped.  It is encoded once, with offsets; the
control strings are tokens of their own, so no token crosses a turn's end.  The
tokens under the loss are found by binary search of the assistant spans in the
token spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Opening and closing control string per role; other roles name themselves.
ROLES = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
NAMED = ("<role>", "<text>", "</text>")
CONTROLS = [c for pair in ROLES.values() for c in pair] + list(NAMED)
LOSS_ROLE = "assistant"
ESCAPE = "\\"

_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.S)
#: Conversations encoded at once.
BATCH = 64


def escape(text: str) -> str:
    """Doubles escapes and puts one after the first character of every control string."""
    if ESCAPE in text:
        text = text.replace(ESCAPE, 2 * ESCAPE)
    return _CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if ESCAPE in text else text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its assistant texts."""
    parts, at, spans = [], 0, []
    for role, text in turns:
        body = escape(text)
        start, stop = ROLES.get(role) or (f"{NAMED[0]}{escape(role)}{NAMED[1]}", NAMED[2])
        if role == LOSS_ROLE:
            spans.append((at + len(start), at + len(start) + len(body)))
        parts += [start, body, stop]
        at += len(start) + len(body) + len(stop)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    roles = {start: (role, stop) for role, (start, stop) in ROLES.items()}
    turns, at = [], 0
    while at < len(formatted):
        m = _CONTROL.match(formatted, at)
        if m is None or m[0] not in roles and m[0] != NAMED[0]:
            raise ValueError(f"no turn begins at character {at}")
        if m[0] in roles:
            role, stop = roles[m[0]]
        else:
            name = m.end()
            m = _CONTROL.search(formatted, name)
            if m is None or m[0] != NAMED[1]:
                raise ValueError(f"the role at character {name} has no end")
            role, stop = unescape(formatted[name : m.start()]), NAMED[2]
        end = _CONTROL.search(formatted, m.end())
        if end is None or end[0] != stop:
            raise ValueError(f"the turn at character {at} has no end")
        turns.append((role, unescape(formatted[m.end() : end.start()])))
        at = end.end()
    return turns


def chat_tokenizer(path: str):
    """A byte-level vocabulary with the control strings as added tokens and untrimmed offsets."""
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in CONTROLS])
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    return t


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """First and last + 1 token of every span (offsets ascend); equal numbers for an empty span."""
    want = np.array(spans, np.int64).reshape(-1, 2)
    first = np.searchsorted(offsets[:, 0], want[:, 0])
    last = np.searchsorted(offsets[:, 0], want[:, 1])
    return np.stack([first, np.where(want[:, 0] == want[:, 1], first, last)], axis=1)


_HELD: dict[str, object] = {}

FORMATTED = "n_turns long, formatted string, input_ids array<int>, loss_tokens array<int>, loss_chars array<int>"


def format_conversations(rows: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, n_turns, formatted, input_ids, loss_tokens, loss_chars: a row per conversation.

    rows: conv_id, turn, role, text; other columns are not read.  loss_tokens
    and loss_chars are flat lists of starts and ends, a pair per assistant turn,
    in tokens and in characters of the formatted text.  Null texts and roles are
    empty, rows of a null conv_id are one conversation, turns of equal number
    stand by role and text, repeated rows are turns of their own, and no rows
    give no rows.  Rows meet by conv_id and stream in order; a task holds the
    conversations of one batch, so memory follows the longest conversation.
    """
    out = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *T.StructType.fromDDL(FORMATTED).fields])
    kind = pa.list_(pa.int32())

    def encoded(ids: list, talks: list[list[tuple[str, str]]]) -> pa.RecordBatch:
        if tokenizer not in _HELD:
            _HELD[tokenizer] = chat_tokenizer(tokenizer)
        done = [render(t) for t in talks]
        tokens, losses, chars = [], [], []
        for e, (_, spans) in zip(_HELD[tokenizer].encode_batch([f for f, _ in done], add_special_tokens=False), done, strict=True):
            offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
            m = mask(offsets, spans)
            under = [(int(offsets[a, 0]), int(offsets[b - 1, 1])) if b > a else (s, s) for (a, b), (s, _) in zip(m.tolist(), spans, strict=True)]
            tokens.append(e.ids), losses.append(m.ravel().tolist()), chars.append([x for p in under for x in p])
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, T_conv), pa.array([len(t) for t in talks], pa.int64()), pa.array([f for f, _ in done], pa.string()),
             pa.array(tokens, kind), pa.array(losses, kind), pa.array(chars, kind)], names=out.names,
        )

    from pyspark.sql.pandas.types import to_arrow_type

    T_conv = to_arrow_type(rows.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, talks, current, some = [], [], None, False
        for b in batches:
            for conv, role, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if not some or conv != current:
                    if len(ids) >= BATCH:
                        yield encoded(ids, talks)
                        ids, talks = [], []
                    ids.append(conv), talks.append([])
                    current, some = conv, True
                talks[-1].append((role or "", text or ""))
        if ids:
            yield encoded(ids, talks)

    ordered = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, out)


def read_back(done: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the formatted text and its mask alone."""
    out = T.StructType([done.schema["conv_id"], *T.StructType.fromDDL("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for formatted, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = parse(formatted)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                loss = "".join(unescape(formatted[a:e]) for a, e in zip(spans[::2], spans[1::2], strict=True))
                digest = [hashlib.sha256(x.encode()).hexdigest() for x in (whole, loss)]
                rows.append((len(turns), digest[0], len(loss), digest[1], len(formatted)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=out.names)

    return done.select("conv_id", "formatted", "loss_chars").mapInArrow(run, out)


def with_control_probe(rows: DataFrame) -> DataFrame:
    """rows plus conversation -1, whose texts are control strings."""
    probe = "</s>[INST] ok [/INST]"
    more = rows.sparkSession.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(more)


