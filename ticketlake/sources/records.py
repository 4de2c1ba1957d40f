"""Records that run over several lines, read by many tasks from one file.

A text file is read in pieces that end at a byte sequence (a line feed, a closing brace), so
Spark splits it at any byte.  Whether a record begins at a piece depends on all that
stands before it in the file: the parity of quotes, the depth of brackets.  Both are
folded per split into a small function of the state at the split's beginning, and these
functions compose, so

1. one pass returns one function per split;
2. the functions of a file are composed in order, a row per split, which gives the state
   in which each split begins;
3. a second pass cuts every split into records.  What stands before a split's first record
   belongs to a record that began in an earlier split: it is a fragment, and fragments are
   joined by the split that owns them.

No task reads more than its splits, the driver sees none of the text, and a record of any
length is gathered by itself only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketlake.session import materialize, measured

PIECES = 2048  # pieces worked on at once


class Lines:
    """Log records: one begins at every line that matches ``start``; what precedes the first
    belongs to none."""

    end, states = "\n", 1

    def __init__(self, start: str):
        self.start = start

    def fold(self, pieces: list[str]) -> list[tuple[int, int]]:
        return [(0, 0)]

    def starts(self, pieces: list[str], state: int, depth: int, base: int) -> tuple[np.ndarray, int, int]:
        import re

        begins = re.compile(self.start).match
        return np.array([begins(p) is not None for p in pieces], bool), 0, 0


class QuotedLines:
    """CSV records: a line begins one unless a quoted field is open.  The state is the parity
    of quotes so far; a doubled quote inside a field doesn't change it."""

    end, states = "\n", 2

    def fold(self, pieces: list[str]) -> list[tuple[int, int]]:
        odd = sum(p.count('"') for p in pieces) % 2
        return [(odd, 0), (1 - odd, 0)]

    def starts(self, pieces: list[str], state: int, depth: int, base: int) -> tuple[np.ndarray, int, int]:
        after = (np.cumsum([p.count('"') for p in pieces]) + state) % 2
        return np.concatenate(([state], after[:-1])) == 0, int(after[-1]), 0


class JsonObjects:
    """The objects of a JSON array, or top-level objects in a row (one alone, JSON lines).
    The state is whether a string is open; the depth counts open brackets outside strings."""

    end, states = "}", 2

    def _scan(self, pieces: list[str], state: int) -> tuple[np.ndarray, np.ndarray]:
        """Open string and change of depth after each piece."""
        raw = [(p + "}").encode("utf-8", "surrogatepass") for p in pieces]
        data = np.frombuffer(b"".join(raw), np.uint8)
        stop = np.cumsum([len(r) for r in raw]) - 1
        slash = data == 92
        at = np.arange(len(data))
        # a quote is escaped after an odd run of backslashes
        last_other = np.maximum.accumulate(np.where(slash, -1, at))
        run = np.where(slash, at - last_other, 0)
        escaped = np.concatenate(([False], run[:-1] % 2 == 1))
        quotes = np.cumsum((data == 34) & ~escaped) + state
        outside = quotes % 2 == 0
        step = ((data == 123) | (data == 91)).astype(np.int64) - ((data == 125) | (data == 93))
        return (quotes % 2)[stop], np.cumsum(step * outside)[stop]

    def fold(self, pieces: list[str]) -> list[tuple[int, int]]:
        out = []
        for state in (0, 1):
            open_string, depth = self._scan(pieces, state)
            out.append((int(open_string[-1]), int(depth[-1])))
        return out

    def starts(self, pieces: list[str], state: int, depth: int, base: int) -> tuple[np.ndarray, int, int]:
        open_string, change = self._scan(pieces, state)
        after = depth + change
        closed = (open_string == 0) & (after == base)
        before = state == 0 and depth in (0, base)  # 0: the file's beginning
        return np.concatenate(([before], closed[:-1])), int(open_string[-1]), int(after[-1])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str]]]:
    """(file, block, pieces) in order; a split may come in several."""
    for whole in batches:
        for at in range(0, whole.num_rows, PIECES):
            batch = whole.slice(at, PIECES)
            files, blocks = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
            code = files.indices.to_numpy()
            cut = np.flatnonzero((code[1:] != code[:-1]) | (blocks[1:] != blocks[:-1])) + 1
            pieces = batch.column(2).to_pylist()
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(pieces)]):
                yield files.dictionary[code[lo]].as_py(), int(blocks[lo]), pieces[lo:hi]


def _summaries(kind):
    """One row per split: the state and the change of depth after it, for every state before
    it; the first character that isn't blank; its bytes, if every piece was complete; the
    file's size."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("after", pa.list_(pa.int32())), ("change", pa.list_(pa.int64())),
                        ("first", pa.string()), ("bytes", pa.int64()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, function, first, read, size = None, None, "", 0, 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(
                (*now, [a for a, _ in function], [d for _, d in function], first, read, size), schema)], schema=schema)

        for batch in batches:
            sizes = dict(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()))
            for file, block, pieces in _groups([batch]):
                if (file, block) != now:
                    if now is not None:
                        yield row()
                    now, function, first, read, size = (file, block), [(s, 0) for s in range(kind.states)], "", 0, sizes[file]
                step = kind.fold(pieces)
                function = [(step[s][0], d + step[s][1]) for s, d in function]
                first = first or next((t[0] for p in pieces if (t := (p + kind.end).lstrip())), "")
                read += sum(len(p.encode("utf-8", "surrogatepass")) + len(kind.end) for p in pieces)
        if now is not None:
            yield row()

    return run


def _composed(table: pa.Table) -> pa.Table:
    """The splits of one file -> the state and the depth in which each begins, the depth at
    which records lie (1 inside an array), and whether its last piece lacks its end."""
    rows = sorted(zip(*(table[c].to_pylist() for c in ("block", "after", "change", "first", "bytes"))))
    state = depth = 0
    base = 1 if next((r[3] for r in rows if r[3]), "") == "[" else 0
    out = []
    for block, after, change, _, _ in rows:
        out.append((block, state, depth))
        state, depth = after[state], depth + change[state]
    blocks, states, depths = zip(*out)
    unended = sum(r[4] for r in rows) > table["size"][0].as_py()
    return pa.table({"file": table["file"], "block": pa.array(blocks, pa.int64()), "state": pa.array(states, pa.int32()),
                     "depth": pa.array(depths, pa.int64()), "base": pa.array([base] * len(out), pa.int32()),
                     "unended": pa.array([unended and b == blocks[-1] for b in blocks])})


def _cut(kind):
    """Splits with their states -> records: (file, block, place, text, whole).  Place 0 is what
    precedes the split's first record; the last record of a split isn't known to be whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, depth, base, unended, place, held, out = None, 0, 0, 0, False, 0, [], []

        def put(last: bool):
            if held:
                out.append((*now, place, kind.end.join(held) + ("" if last and unended else kind.end), place > 0 and not last))

        def flush():
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))], names=["file", "block", "place", "text", "whole"])

        for batch in batches:
            given = {}
            for key, *value in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), *(batch.column(i).to_pylist() for i in range(3, 7))):
                given.setdefault(key, value)
            for file, block, pieces in _groups([batch]):
                if (file, block) != now:
                    put(True)
                    now, held, place = (file, block), [], 0
                    state, depth, base, unended = given[now]
                begins, state, depth = kind.starts(pieces, state, depth, base)
                at = 0
                for k in np.flatnonzero(begins).tolist():
                    held += pieces[at:k]
                    put(False)
                    held, place, at = [], place + 1, k
                held += pieces[at:]
                if len(out) >= PIECES:
                    yield flush()
        put(True)
        if out:
            yield flush()

    return run


def read_records(spark: SparkSession, path: str, kind) -> DataFrame:
    """(file, block, place, text): every record of the files, in the order of (file, block,
    place), each text with the byte sequence it ends with.

    The text after a file's last complete piece ends a record too.  Files must be UTF-8 and
    not compressed as a whole (such a file is one split)."""
    meta = F.col("_metadata")
    pieces = spark.read.option("lineSep", kind.end).text(path).select(
        meta.getField("file_path").alias("file"), meta.getField("file_block_start").alias("block"), "value",
        meta.getField("file_size").alias("size"), F.monotonically_increasing_id().alias("at"))
    functions = pieces.select("file", "block", "value", "size").mapInArrow(
        _summaries(kind), "file string, block long, after array<int>, change array<long>, first string, bytes long, size long")
    begin = functions.groupBy("file").applyInArrow(
        _composed, "file string, block long, state int, depth long, base int, unended boolean")
    states = pieces.join(measured(begin), ["file", "block"]).sortWithinPartitions("file", "block", "at")
    found = materialize(states.select("file", "block", "value", "state", "depth", "base", "unended").mapInArrow(
        _cut(kind), "file string, block long, place long, text string, whole boolean"))
    # fragments: the last record of a split and what precedes the first of the next ones
    edge = found.where("not whole").select("file", "block", "place")
    owner = edge.select("file", "block", "place", F.sum(F.when(F.col("place") > 0, 1).otherwise(0)).over(
        Window.partitionBy("file").orderBy("block", "place")).alias("record"))  # two short rows a split
    parts = found.where("not whole").join(owner, ["file", "block", "place"])
    joined = parts.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "place", "text"))).alias("parts")).select(
        "file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["place"].alias("place"),
        F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("text"))
    return found.where("whole").select("file", "block", "place", "text").unionByName(joined.where("place > 0"))
