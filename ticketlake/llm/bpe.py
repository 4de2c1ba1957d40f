"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Pre-tokenisation runs without a regular expression.  The split pattern is a small
automaton over code-point classes; each symbol is a function on its states, and the
functions that symbols compose to form a finite monoid (a few dozen elements).  A whole
batch of texts is therefore one associative scan over monoid elements, done in two
vectorised levels: inside blocks, then over block totals.  The state before each code
point tells whether a piece starts there.  A reset element stands before every text.

Pieces are byte slices, mapped through a bounded cache whose misses run the pair merges;
ids come out as little-endian unsigned 32-bit integers.  Decoding gathers token bytes by
their offsets in one vocabulary buffer.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.llm.kernels import pieces
from ticketlake.llm.spark import bounded_batches

# Classes of code points; the first four go into the table below.
LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
# Symbols the automaton reads: SHORT / LONG are apostrophes before a one- / two-letter
# contraction, IN_GAP is white space before more white space or the end, BLANK_END a blank
# before anything else, GAP_END other white space before anything else.
SHORT, LONG, IN_GAP, BLANK_END, GAP_END, RESET = 4, 5, 3, 6, 7, 8
N_SYMBOLS = 9
# States: nothing open; inside letters, numbers, others, white space; a blank that the next
# piece takes along; one or two letters of a contraction still to come.
FRESH, IN_L, IN_N, IN_O, IN_W, JOIN, ONE, TWO = range(8)
CACHE = 1 << 18
_ONE, _TWO = b"stmd", (b"re", b"ve", b"ll")


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a piece starts at this symbol)."""
    if symbol == RESET:
        return FRESH, False
    if symbol == LETTER and state in (ONE, TWO):
        return (FRESH if state == ONE else ONE), False
    if symbol in (SHORT, LONG) and state not in (IN_O, JOIN):
        return (ONE if symbol == SHORT else TWO), True
    if symbol in (LETTER, NUMBER, OTHER, SHORT, LONG):
        inside = {LETTER: IN_L, NUMBER: IN_N}.get(symbol, IN_O)
        return inside, state not in (inside, JOIN)
    if symbol == IN_GAP:
        return IN_W, state != IN_W
    return (JOIN if symbol == BLANK_END else FRESH), True


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(compose[a, b] = first a then b, apply[a, state], starts[state, symbol])."""
    elements = [tuple(_step(q, s)[0] for q in range(8)) for s in range(N_SYMBOLS)]
    index = {}
    for f in elements:
        index.setdefault(f, len(index))
    work = list(index)
    for f in work:  # close under appending a symbol
        for g in elements:
            h = tuple(g[q] for q in f)
            if h not in index:
                index[h] = len(index)
                work.append(h)
    every = list(index)
    compose = np.array([[index[tuple(g[q] for q in f)] for g in every] for f in every], np.uint16)
    symbol = np.array([index[f] for f in elements], np.uint16)
    starts = np.array([[_step(q, s)[1] for s in range(N_SYMBOLS)] for q in range(8)])
    return compose, symbol, (np.array(every, np.uint8), starts)


def _scan(element: np.ndarray, compose: np.ndarray, identity: int, width: int = 64) -> np.ndarray:
    """Exclusive scan: the composition of everything before each position."""
    n = len(element)
    rows = -(-n // width)
    grid = np.full(rows * width, identity, np.uint16)
    grid[:n] = element
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    size = compose.shape[1]
    flat = compose.ravel()
    total = grid[0]
    for k in range(1, width):
        total = flat[total.astype(np.intp) * size + grid[k]]
    hop = 1
    while hop < rows:  # inclusive scan over block totals
        total = np.concatenate((total[:hop], flat[total[:-hop].astype(np.intp) * size + total[hop:]]))
        hop *= 2
    before = np.empty_like(grid)
    before[0] = np.concatenate(([np.uint16(identity)], total[:-1]))
    for k in range(1, width):
        before[k] = flat[before[k - 1].astype(np.intp) * size + grid[k - 1]]
    return before.T.reshape(-1)[:n]


class _Cache(dict):
    """piece -> its ids as bytes; misses run the merges, a full cache starts anew."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            out = whole.to_bytes(4, "little")
        else:
            out = b"".join([ranks[p].to_bytes(4, "little") for p in merge(piece, ranks)])
        if len(self) >= CACHE:
            self.clear()
        if len(piece) <= 64:
            self[piece] = out
        return out


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Merge the adjacent pair of lowest rank, the leftmost of equal ones, until none is
    left.  Long pieces use a heap over a linked list, so a piece of m bytes takes
    m log m steps; short ones scan."""
    if len(piece) > 128:
        return _merge_long(piece, ranks)
    parts = [piece[i:i + 1] for i in range(len(piece))]
    pairs = [ranks.get(piece[i:i + 2], 1 << 30) for i in range(len(piece) - 1)]
    while pairs:
        best = min(pairs)
        if best == 1 << 30:
            break
        i = pairs.index(best)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
    return parts


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    import heapq

    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here; 0 once swallowed
    back = list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != to or mid == to:
            continue
        end[i], end[mid] = to, 0
        if to < n:
            back[to] = i
            if (r := ranks.get(piece[i:end[to]])) is not None:
                heapq.heappush(heap, (r, i, end[to]))
        if (p := back[i]) >= 0 and (r := ranks.get(piece[p:to])) is not None:
            heapq.heappush(heap, (r, p, to))
    return [piece[i:e] for i, e in enumerate(end) if e]


def class_table() -> np.ndarray:
    """The class of every code point, as the reference library tells them apart: which are
    letters and which numbers depends on its version of Unicode, not on the interpreter's.
    It is asked once per worker, with all code points in blocks."""
    import tiktoken

    table = np.full(0x110000, OTHER, np.uint8)
    single = {bytes([b]): b for b in range(256)}
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = tiktoken.Encoding(f"class {kind}", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        for lo in range(0, 0x110000, 0x1000):
            block = "".join(map(chr, range(lo, lo + 0x1000))) if not 0xD000 <= lo < 0xE000 else "".join(map(chr, range(lo, min(lo + 0x1000, 0xD800))))
            if block:  # surrogates are no characters
                table[[ord(c) for c in found.decode(found.encode_ordinary(block))]] = kind
    return table


class Codec:
    """Encoder and decoder for one rank file (lines: base64 token, blank, rank)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.cache = _Cache(self.ranks)
        compose, symbol, (self.apply, self.starts) = _monoid()
        # an identity element pads the scan's blocks
        k = len(compose)
        self.compose = np.zeros((k + 1, k + 1), np.uint16)
        self.compose[:k, :k] = compose
        self.compose[k, :], self.compose[:, k] = np.arange(k + 1), np.arange(k + 1)
        self.apply = np.vstack((self.apply, np.arange(8, dtype=np.uint8)))
        self.symbol, self.identity = symbol, k
        self.table = class_table()
        by_id = sorted(self.ranks.items(), key=lambda x: x[1])
        if [r for _, r in by_id] != list(range(len(by_id))):
            raise ValueError("ranks are not 0, 1, 2, ...")
        self.token_bytes = np.frombuffer(b"".join(t for t, _ in by_id), np.uint8)
        self.token_at = np.concatenate(([0], np.cumsum([len(t) for t, _ in by_id])))

    def split(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(UTF-8 of all texts, byte offsets of the pieces and the end, first piece per text)."""
        flat = "".join(texts)
        data = flat.encode("utf-8")
        n = len(flat)
        per_text = np.array([len(t) for t in texts], np.int64)
        text_at = np.concatenate(([0], np.cumsum(per_text)))
        if not n:
            return data, np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
        points = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
        kind = self.table[points]
        last = np.zeros(n + 1, bool)  # whether a text ends before this place
        last[text_at[1:]] = True
        ends = last[1:]
        symbol = kind.copy()
        gap = kind == SPACE
        open_end = gap & ~ends  # white space with something of the same text behind it
        before_text = np.zeros(n, bool)
        before_text[:-1] = open_end[:-1] & (kind[1:] != SPACE)
        symbol[before_text] = np.where(points[before_text] == 32, BLANK_END, GAP_END)
        quote = np.flatnonzero(points == 39)
        if len(quote):
            left = text_at[np.searchsorted(text_at, quote, "right")] - quote - 1  # code points behind it
            padded = np.concatenate((points, [0, 0]))
            one, two = padded[quote + 1], padded[quote + 2]
            short = (left >= 1) & np.isin(one, list(_ONE))
            long = np.zeros(len(quote), bool)
            for a, b in _TWO:
                long |= (left >= 2) & (one == a) & (two == b)
            symbol[quote[short]] = SHORT
            symbol[quote[long]] = LONG
        element = self.symbol[symbol]
        state = self._states(element, text_at, per_text)
        start = self.starts[state, symbol]
        widths = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        byte_at = np.concatenate(([0], np.cumsum(widths)))
        begin = np.flatnonzero(start)
        return data, np.append(byte_at[begin], byte_at[-1]), np.searchsorted(begin, text_at)

    def _states(self, element, text_at, per_text) -> np.ndarray:
        """State before each code point; a reset precedes every text."""
        n, texts = len(element), len(per_text)
        place = np.arange(n) + np.repeat(np.arange(1, texts + 1), per_text)
        tape = np.full(n + texts, self.symbol[RESET], np.uint16)
        tape[place] = element
        before = _scan(tape, self.compose, self.identity)
        return self.apply[before[place], FRESH]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        data, offsets, first = self.split(texts)
        cut, cache = offsets.tolist(), self.cache
        found = [cache[data[a:b]] for a, b in zip(cut, cut[1:])]
        bounds = first.tolist()
        return [b"".join(found[a:b]) for a, b in zip(bounds, bounds[1:])]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each id sequence."""
        flat = np.frombuffer(b"".join(ids), np.uint32)
        begin, size = self.token_at[flat], np.diff(self.token_at)[flat]
        out_at = np.concatenate(([0], np.cumsum(size)))
        source = np.arange(out_at[-1]) + np.repeat(begin - out_at[:-1], size)
        data = self.token_bytes[source].tobytes()
        ends = out_at[np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids])))].tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:])]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a rank file, built once per Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in pieces(batches, "text"):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = tool.encode(texts)
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0), "ids": pa.array(ids, pa.binary()), "decoded": pa.array(tool.decode(ids), pa.binary())})

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, ids (binary, 4 bytes a token, little-endian), decoded (binary,
    the ids decoded again).

    ``path`` is a rank file that every executor can read (part of an installed package,
    or shipped with the job).  A null or empty text has no tokens.  Nothing else is read,
    no row is dropped, repeated rows give repeated results; no special token is made."""
    bounded_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return (plain.mapInArrow(_round_trip(path), "id long, ids binary, decoded binary")
            .withColumnRenamed("id", id_col))


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of an encoded table."""
    return encoded.select(
        id_col, F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
