"""Chat formatting by columnar byte assembly, and reading it back.

A conversation becomes ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn, in order of turn (then role and text; nulls
first). Control strings inside texts and roles are escaped: a backslash goes behind their first character, one more than
there were; removing one backslash gives the text back. A role's line feeds and backslashes are written ``\\n``, ``\\\\``.
Texts of ``LOSS_ROLES`` are under the loss mask, given as byte spans of the formatted text.

A batch of turns is laid out with numpy: lengths of the five segments of each turn, their running sums as offsets, and
the scatter index of every content byte; headers and contents are copied once into one preallocated Arrow buffer.

Turns come sorted to a task by conversation, and rows of the result are handed out as they fill: a conversation longer
than ``PIECE_BYTES`` goes on in a further piece, so no conversation has to fit in memory. Reading back streams too. The
digests of one conversation are sequential by definition, so the reader keeps its turns in one task, one turn at a time.

Null texts and roles are empty. A null conv_id is one conversation, a null turn comes first; repeated rows are turns of
their own. An empty table gives an empty result. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings that never stand in a formatted text but as written by the template; each begins with < or [.
CONTROLS = (START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
LOSS_ROLES = ("assistant",)
PIECE_BYTES, STEP_BYTES = 4_000_000, 8_000_000


def _patterns():
    out = []
    for first in "<[":
        rest = "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True) if c[0] == first)
        out.append((first, rest))
    return out


_RESTS = _patterns()
_UNESCAPE = [re.compile(rf"({re.escape(first)})\\(\\*(?:{rest}))") for first, rest in _RESTS]


def escaped(texts: pa.Array) -> pa.Array:
    for first, rest in _RESTS:
        texts = pc.replace_substring_regex(texts, rf"({re.escape(first)})(\\*(?:{rest}))", r"\1\\\2")
    return texts


def unescaped(text: str) -> str:
    for pattern in _UNESCAPE:
        text = pattern.sub(r"\1\2", text)
    return text


def _role_out(roles: pa.Array) -> pa.Array:
    return escaped(pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data buffer, starts and lengths in bytes of a string array."""
    strings = strings.cast(pa.large_string())
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int64)[strings.offset:strings.offset + len(strings) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, at[:-1], np.diff(at)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns laid out, the start of each turn (and the end of the last), and the (start, end) of each text."""
    header, between, footer = START.encode(), b"\n", (END + "\n").encode()
    role_raw, role_at, role_len = _bytes_of(_role_out(roles))
    text_raw, text_at, text_len = _bytes_of(escaped(texts))
    n = len(roles)
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 1], lengths[:, 2], lengths[:, 3], lengths[:, 4] = len(header), role_len, len(between), text_len, len(footer)
    offsets = np.zeros(n * 5 + 1, np.int64)
    np.cumsum(lengths.ravel(), out=offsets[1:])
    starts = offsets[:-1].reshape(n, 5)
    buffer = np.empty(int(offsets[-1]), np.uint8)
    for column, fixed in ((0, header), (2, between), (4, footer)):
        piece = np.frombuffer(fixed, np.uint8)
        buffer[starts[:, column, None] + np.arange(len(piece))] = piece
    for column, raw, at, size in ((1, role_raw, role_at, role_len), (3, text_raw, text_at, text_len)):
        total = int(size.sum())
        if total:
            run = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
            buffer[np.repeat(starts[:, column], size) + run] = raw[np.repeat(at, size) + run]
    return buffer, np.r_[starts[:, 0], offsets[-1]], np.stack([starts[:, 3], starts[:, 3] + text_len], axis=1)


FORMATTED_DDL = "conv_id long, piece int, formatted string, loss_starts array<long>, loss_ends array<long>, n_turns long"
FORMATTED = pa.schema([("conv_id", pa.int64()), ("piece", pa.int32()), ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int64())),
                       ("loss_ends", pa.list_(pa.int64())), ("n_turns", pa.int64())])


def _format(batches):
    """Turns come sorted by conversation; a piece stays open until its conversation ends or it is full."""
    conv, piece, held, starts, ends, turns, size = None, 0, [], [], [], 0, 0
    opened = False

    def row():
        text = b"".join(held).decode("utf-8")
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((conv, piece, text, starts, ends, turns), FORMATTED)], schema=FORMATTED)

    for batch in batches:
        roles, texts = pc.fill_null(batch.column("role"), ""), pc.fill_null(batch.column("text"), "")
        ids = batch.column("conv_id").to_pylist()
        step = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // STEP_BYTES
        cuts = np.flatnonzero(np.r_[True, step[1:] != step[:-1]]) if len(step) else []
        for a, b in zip(cuts, [*cuts[1:], len(ids)]):
            buffer, at, text_at = assemble(roles.slice(a, b - a), texts.slice(a, b - a))
            loss = pc.is_in(roles.slice(a, b - a), pa.array(LOSS_ROLES)).to_numpy(zero_copy_only=False)
            data = buffer.tobytes()
            for k in range(b - a):
                if not opened or ids[a + k] != conv:
                    if opened:
                        yield row()
                    conv, piece, held, starts, ends, turns, size, opened = ids[a + k], 0, [], [], [], 0, 0, True
                elif size >= PIECE_BYTES:
                    yield row()
                    piece, held, starts, ends, turns, size = piece + 1, [], [], [], 0, 0
                if loss[k]:
                    starts.append(int(text_at[k, 0] - at[k]) + size)
                    ends.append(int(text_at[k, 1] - at[k]) + size)
                held.append(data[at[k]:at[k + 1]])
                size += int(at[k + 1] - at[k])
                turns += 1
    if opened:
        yield row()


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, piece, formatted, loss_starts, loss_ends (bytes of formatted), n_turns: one row for each piece."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select(
        "conv_id", "role", "text").mapInArrow(_format, FORMATTED_DDL)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted piece."""
    out = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition("\n")
        out.append((_role_in(role), unescaped(rest[:rest.rindex(END)])))
    return out


DIGEST_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read(batches):
    conv, opened = None, False

    def row():
        values = (conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, DIGEST)], schema=DIGEST)

    for batch in batches:
        for i, formatted, starts, ends in zip(batch.column("conv_id").to_pylist(), batch.column("formatted"), batch.column("loss_starts"), batch.column("loss_ends")):
            if not opened or i != conv:
                if opened:
                    yield row()
                conv, opened, n, loss_chars, chars = i, True, 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            text = formatted.as_py()
            chars += len(text)
            for role, content in turns_of(text):
                n += 1
                turns.update(f"{role}\n{content}\n".encode())
            raw = text.encode()
            for a, b in zip(starts.as_py(), ends.as_py()):
                content = unescaped(raw[a:b].decode())
                loss_chars += len(content)
                loss.update(content.encode())
    if opened:
        yield row()


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what can be read back from its formatted pieces."""
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "piece").select(
        "conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(_read, DIGEST_DDL)
