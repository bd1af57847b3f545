"""Chat formatting by schema fingerprints.

Records reach this operator as JSON in any of several layouts (a prompt with
its response, an instruction with input and output, a list of messages, a
list of from/value pairs, a table row for each turn). The nested field paths
of a record that occur in any known layout are hashed; the fingerprint
selects a declarative mapping, and the mapping gives the record's turns. New
layouts are new entries of ``LAYOUTS``, not code.

Turns are rendered with a template whose control strings mark turns; control
strings inside texts are broken up reversibly. Rendering is done row by row
before anything is grouped. A conversation is then put in order by one
shuffle and written in pieces of at most ``PIECE_CHARS`` (or one turn), so
the largest conversation never is one cell or one list in memory; the spans
under the loss mask are kept with each piece. ``read_back`` parses the
formatted pieces again and folds them piece by piece.

Defined cases: null roles and texts are empty; a role is kept as it is
written, and only ``assistant`` is under the loss mask; equal turn numbers
order by role and text, a null turn comes first; repeated rows are repeated
turns; rows of a null conversation id form one conversation; a record of
unknown layout or broken JSON has no turns and is given by ``unmatched``;
other columns are ignored; empty tables give no conversation.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
PIECE_CHARS = 1 << 20
# Strings that chat templates use as marks; none may occur in a formatted text by itself.
CONTROL = (START, END, "<|im_sep|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
           "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>", "<|begin_of_text|>")
_BREAK = re.compile(r"\\|" + "|".join(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in CONTROL))
_UNBREAK = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(START) + r"((?:[^\\\n]|\\[\s\S])*)\n")


@dataclass(frozen=True)
class Layout:
    """``turns``: (role, path of the text) of a record, or, with ``each``, of
    every item of that list: (path of the role or a fixed role, path of the text)."""

    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...]
    each: str = ""
    roles: tuple[tuple[str, str], ...] = ()  # other names of roles


_SHARE = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))
LAYOUTS = [
    Layout(("role", "text"), (("=role", "text"),)),
    Layout(("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Layout(("prompt", "completion"), (("user", "prompt"), ("assistant", "completion"))),
    Layout(("system", "prompt", "response"), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout(("question", "answer"), (("user", "question"), ("assistant", "answer"))),
    Layout(("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Layout(("instruction", "input", "output"), (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout(("messages[].role", "messages[].content"), (("=role", "content"),), "messages"),
    Layout(("conversations[].from", "conversations[].value"), (("=from", "value"),), "conversations", _SHARE),
    Layout(("data.messages[].role", "data.messages[].content"), (("=role", "content"),), "data.messages"),
]


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


BY_PRINT = {fingerprint(x.paths): x for x in LAYOUTS}
KNOWN_PATHS = frozenset(p for x in LAYOUTS for p in x.paths)


def field_paths(value, at: str = "") -> set[str]:
    """Paths of all leaves; lists add ``[]``."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in field_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, at + "[]")}
    return {at}


def _get(value, path: str):
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical_turns(record: str | None) -> tuple[str | None, list[tuple[str, str]]]:
    """(fingerprint if known, turns as (role, text))."""
    try:
        value = json.loads(record) if record else None
    except ValueError:
        value = None
    if not isinstance(value, dict):
        return None, []
    mark = fingerprint(field_paths(value) & KNOWN_PATHS)
    layout = BY_PRINT.get(mark)
    if layout is None:
        return None, []
    names, out = dict(layout.roles), []
    for item in (_get(value, layout.each) if layout.each else [value]):
        for role, path in layout.turns:
            role = _text(_get(item, role[1:])) if role[0] == "=" else role
            out.append((names.get(role, role), _text(_get(item, path))))
    return mark, out


def escape(text: str) -> str:
    return _BREAK.sub(lambda m: m.group() + "\\", text) if "\\" in text or "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _UNBREAK.sub(r"\1", text) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start and end of the text under the loss mask in it)."""
    head = f"{START}{escape(role).replace(chr(10), chr(92) + chr(10))}\n"
    body = escape(text)
    loss = (len(head), len(head) + len(body)) if role == LOSS_ROLE else (0, 0)
    return f"{head}{body}{END}\n", *loss


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text, as they were before rendering."""
    out = []
    for part in formatted.split(END + "\n")[:-1]:
        head = _TURN.match(part)
        out.append((unescape(head.group(1)), unescape(part[head.end():])))
    return out


_RENDERED = "conv_id long, turn long, at int, formatted string, loss_start int, loss_end int, layout string, role string, text string"
_RENDERED_SCHEMA = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("at", pa.int32()), ("formatted", pa.string()),
                              ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("layout", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _render(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            rows = []
            part = batch.slice(lo, 1024)
            for conv, turn, record in zip(*(part.column(c).to_pylist() for c in ("conv_id", "turn", "record"))):
                mark, turns = canonical_turns(record)
                if mark is None:
                    rows.append((conv, turn, None, None, None, None, None, None, record))
                for at, (role, text) in enumerate(turns):
                    rows.append((conv, turn, at, *render(role, text), mark, role, text))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RENDERED_SCHEMA)], schema=_RENDERED_SCHEMA)


def rendered(records: DataFrame) -> DataFrame:
    """One row for each turn of (conv_id, turn, record), record being JSON."""
    return (records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("record").cast("string").alias("record"))
            .mapInArrow(_render, _RENDERED))


def unmatched(records: DataFrame) -> DataFrame:
    """(conv_id, turn, record) of the records that have no known layout."""
    return rendered(records).filter("layout is null").select("conv_id", "turn", F.col("text").alias("record"))


_PIECES = "conv_id long, piece int, formatted string, loss array<struct<start:int,end:int>>"
_LOSS_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_PIECE_SCHEMA = pa.schema([("conv_id", pa.int64()), ("piece", pa.int32()), ("formatted", pa.string()), ("loss", _LOSS_TYPE)])


def _join_pieces(batches):
    """Rows come sorted by conversation and turn."""
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECE_SCHEMA)], schema=_PIECE_SCHEMA)

    now, number, parts, loss, size, out, held = (), 0, [], [], 0, [], 0
    for rows in batches:
        for conv, text, a, b in zip(*(rows.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
            if parts and ((conv,) != now or size + len(text) > PIECE_CHARS):
                out.append((now[0], number, "".join(parts), loss))
                held += size
                number, parts, loss, size = number + 1, [], [], 0
                if held > PIECE_CHARS:
                    yield batch(out)
                    out, held = [], 0
            if (conv,) != now:
                now, number = (conv,), 0
            if b > a or a:
                loss.append({"start": size + a, "end": size + b})
            parts.append(text)
            size += len(text)
    if parts:
        out.append((now[0], number, "".join(parts), loss))
    if out:
        yield batch(out)


def format_chats(records: DataFrame) -> DataFrame:
    """(conv_id, piece, formatted, loss): the formatted conversation in pieces,
    with the spans of code points under the loss mask in each."""
    order = ["conv_id", "turn", "at", "role", "text"]
    return (rendered(records).filter("layout is not null").repartition("conv_id").sortWithinPartitions(*order)
            .select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(_join_pieces, _PIECES))


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_READ_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                          ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read_back(batches):
    """Pieces come in order, a conversation's one after the other."""
    state, now = None, ()

    def row():
        n, turns, chars, loss, total = state
        return now[0], n, turns.hexdigest(), chars, loss.hexdigest(), total

    for batch in batches:
        out = []
        for conv, formatted, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
            if (conv,) != now:
                if state:
                    out.append(row())
                now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            for span in loss:
                text = unescape(formatted[span["start"]:span["end"]])
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(formatted)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _READ_SCHEMA)], schema=_READ_SCHEMA)
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row(), _READ_SCHEMA)], schema=_READ_SCHEMA)


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation, parsed from its formatted pieces: counts and digests
    of all turns and of the text under the loss mask."""
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_read_back, _READ)


def turn_records(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, record) of a table with one row for each turn."""
    return turns.select("conv_id", "turn", F.to_json(F.struct(F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")),
                                                     {"ignoreNullFields": "false"}).alias("record"))
