"""Chat formatting by columnar byte assembly, and its reader.

A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``; a conversation is its turns in
order.  Inside roles and texts a backslash stands before every backslash and before the
bar of every ``<|``, so no control string of the template can occur there; in roles a
line feed becomes backslash, ``n``.  Both are undone exactly by the reader.

A turn is formatted by itself, so the turns of a conversation of any length are spread
over all tasks.  Inside a task a whole Arrow batch is assembled at once: segment lengths,
cumulative offsets and scatter indices are computed in numpy and headers, contents and
escapes are copied into one buffer, which becomes the Arrow column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.llm.kernels import pieces
from ticketlake.llm.spark import bounded_batches

START, MIDDLE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
SLASH, BAR, LESS, FEED, LETTER_N = 92, 124, 60, 10, 110


def flatten(values: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values, their offsets); null is empty."""
    raw = [(v or "").encode("utf-8", "surrogatepass") for v in values]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), offsets


def escape(data: np.ndarray, offsets: np.ndarray, line_feeds: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Escaped bytes and offsets, all values at once."""
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    after_less = np.zeros(n, bool)
    after_less[1:] = data[:-1] == LESS
    extra = (data == SLASH) | ((data == BAR) & after_less & ~first[:n])
    feeds = (data == FEED) if line_feeds else np.zeros(n, bool)
    extra |= feeds
    shift = np.cumsum(extra)  # inclusive: the backslash stands before the byte itself
    out = np.full(n + int(shift[-1]) if n else 0, SLASH, np.uint8)
    out[np.arange(n) + shift] = np.where(feeds, LETTER_N, data)
    return out, offsets + np.concatenate(([0], shift))[offsets]


def unescape(data: np.ndarray, offsets: np.ndarray, line_feeds: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of :func:`escape`: in a run of backslashes every other one goes."""
    n = len(data)
    slash = data == SLASH
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    begin = slash & (first[:n] | ~np.concatenate(([False], slash[:-1])))
    at = np.arange(n)
    run = np.maximum.accumulate(np.where(begin, at, 0))
    gone = slash & ((at - run) % 2 == 0)
    out = data.copy()
    if line_feeds:
        escaped = np.concatenate(([False], gone[:-1])) & (data == LETTER_N)
        out[escaped] = FEED
    keep = ~gone
    return out[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]


def assemble(roles: list[str | None], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, turn offsets, start and end of each text in its turn)."""
    role, role_at = escape(*flatten(roles), line_feeds=True)
    text, text_at = escape(*flatten(texts))
    role_len, text_len = np.diff(role_at), np.diff(text_at)
    size = len(START) + role_len + len(MIDDLE) + text_len + len(END)
    turn_at = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(int(turn_at[-1]), np.uint8)
    begin = turn_at[:-1]
    place = begin
    for part in (START, None, MIDDLE, "text", END):
        if isinstance(part, bytes):
            for k, byte in enumerate(part):
                out[place + k] = byte
            place = place + len(part)
        else:
            data, at, length = (role, role_at, role_len) if part is None else (text, text_at, text_len)
            out[np.arange(len(data)) + np.repeat(place - at[:-1], length)] = data
            place = place + length
    text_begin = len(START) + role_len + len(MIDDLE)
    return out, turn_at, text_begin, text_begin + text_len


def format_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """One row per turn: conv, turn, formatted, text_begin, text_end (byte offsets of the
    escaped text in it) and loss (whether the text is under the loss mask: assistant turns).

    The formatted conversation is the turns' ``formatted`` in order of turn; equal turn
    numbers are ordered by ``formatted``, null turns come first.  Null roles and texts are
    empty.  Repeated rows are formatted repeatedly; null conversation ids form one
    conversation.  Other columns are ignored, an empty table gives an empty one."""
    bounded_batches(conversations.sparkSession)
    plain = conversations.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(_format, "conv long, turn long, formatted string, text_begin long, text_end long, loss boolean")


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        roles = batch.column(2).to_pylist()
        out, turn_at, a, b = assemble(roles, batch.column(3).to_pylist())
        text = pa.StringArray.from_buffers(len(batch), pa.py_buffer(turn_at.astype(np.int32)), pa.py_buffer(out))
        yield pa.RecordBatch.from_pydict({
            "conv": batch.column(0), "turn": batch.column(1), "formatted": text,
            "text_begin": pa.array(a, pa.int64()), "text_end": pa.array(b, pa.int64()),
            "loss": pa.array([r == "assistant" for r in roles])})


def read_back(buffer: bytes) -> tuple[list[bytes], list[bytes]]:
    """(roles, texts) of a formatted conversation, parsed from its bytes alone."""
    roles, texts = [], []
    data = np.frombuffer(buffer, np.uint8)
    turns = buffer.split(END)
    at, spans = 0, []
    for t in turns[:-1]:
        if not t.startswith(START):
            raise ValueError("not a formatted conversation")
        middle = t.index(MIDDLE)
        spans.append((at + len(START), at + middle, at + middle + 1, at + len(t)))
        at += len(t) + len(END)
    if turns[-1]:
        raise ValueError("not a formatted conversation")
    for which, (lo, hi) in enumerate(((0, 1), (2, 3))):
        cut = np.array([(s[lo], s[hi]) for s in spans], np.int64).reshape(-1, 2)
        size = cut[:, 1] - cut[:, 0]
        offsets = np.concatenate(([0], np.cumsum(size)))
        index = np.arange(offsets[-1]) + np.repeat(cut[:, 0] - offsets[:-1], size)
        plain, at_ = unescape(data[index], offsets, line_feeds=which == 0)
        raw, ends = plain.tobytes(), at_.tolist()
        (roles if which == 0 else texts).extend(raw[x:y] for x, y in zip(ends, ends[1:]))
    return roles, texts


class _Digest:
    """Running digests of one conversation, fed piece by piece."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss_chars, self.formatted_chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, formatted: list[str], begin: list[int], end: list[int], loss: list[bool]) -> None:
        raw = "".join(formatted)
        self.formatted_chars += len(raw)
        data = raw.encode("utf-8", "surrogatepass")
        roles, texts = read_back(data)
        self.turns += len(roles)
        self.all.update(b"".join([r + b"\n" + t + b"\n" for r, t in zip(roles, texts)]))
        at, spans = 0, []
        for f, a, b, own in zip(formatted, begin, end, loss):  # the mask's bytes, from the offsets
            if own:
                spans.append((at + a, at + b))
            at += len(f.encode("utf-8", "surrogatepass"))
        if spans:
            cut = np.array(spans, np.int64)
            offsets = np.concatenate(([0], np.cumsum(cut[:, 1] - cut[:, 0])))
            masked = np.concatenate([np.frombuffer(data, np.uint8)[a:b] for a, b in spans])
            plain = unescape(masked, offsets)[0].tobytes()
            self.loss_chars += len(plain.decode("utf-8", "surrogatepass"))
            self.loss.update(plain)

    def row(self) -> tuple:
        return (self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars)


_ROW = pa.schema([("conv", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                  ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream of formatted turns sorted by conversation -> one row per conversation; only
    the running digests are held, never a conversation."""
    now: _Digest | None = None
    for batch in pieces(batches, "formatted"):
        conv = batch.column(0).to_pylist()
        cols = [batch.column(i).to_pylist() for i in range(1, 5)]
        done, lo = [], 0
        while lo < len(conv):
            hi = lo
            while hi < len(conv) and conv[hi] == conv[lo]:
                hi += 1
            if now is None or now.conv != conv[lo]:
                if now is not None:
                    done.append(now.row())
                now = _Digest(conv[lo])
            now.feed(*(c[lo:hi] for c in cols))
            lo = hi
        if done:
            yield _rows(done)
    if now is not None:
        yield _rows([now.row()])


def _rows(done: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _ROW)], schema=_ROW)


def conversation_digests(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, read back from the formatted turns: n_turns, turns_sha256 (role,
    line feed, text, line feed per turn), loss_chars, loss_sha256 (texts under the mask),
    formatted_chars.  A SHA-256 of a conversation is one sequence by definition; the
    stream is sorted with spilling, and what is kept per conversation is the digest."""
    ordered = (turns.repartition("conv").sortWithinPartitions("conv", "turn", "formatted")
               .select("conv", "formatted", "text_begin", "text_end", "loss"))
    schema = "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.mapInArrow(_fold, schema).withColumnRenamed("conv", conv_col)
