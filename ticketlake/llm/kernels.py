"""Numpy kernels over batches of texts, shared by the operators of this package.

Text is handled as one flat buffer per batch; documents are segments of it.  Spans are
hashed in O(1) from prefix sums: with ``P[i] = sum_{k<i} T[b_k] * B**k (mod 2**64)`` the
span ``[s, e)`` hashes to ``(P[e] - P[s]) * B**-s``, the same value wherever the span
stands; :func:`mix` then spreads the bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64); ``salt`` selects a function."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, 1 << 16, 2 * _powers["n"])
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size + 1, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


class SpanHasher:
    """Hashes of arbitrary spans of a symbol array (bytes or code points)."""

    def __init__(self, symbols: np.ndarray):
        up, self.down = _power_tables(len(symbols))
        if symbols.dtype == np.uint8:
            spread = mix(np.arange(256, dtype=np.uint64))[symbols]
        else:
            spread = mix(symbols.astype(np.uint64))
        self.prefix = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(spread * up[: len(symbols)], dtype=np.uint64, out=self.prefix[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.down[start])


class Words:
    """Words of a batch of texts: split at white space, in lower case unless told otherwise.

    ``start`` / ``end`` are byte offsets into ``buf`` (one blank between words, a line
    feed between documents), ``first[d] : first[d + 1]`` are the words of document d."""

    def __init__(self, texts: list[str | None], lower: bool = True):
        flat = "\n".join([" ".join((t or "").split()) for t in texts])
        if lower:
            flat = flat.lower()
        self.buf = np.frombuffer(flat.encode("utf-8", "surrogatepass"), np.uint8)
        gap = np.ones(len(self.buf) + 2, bool)
        gap[1:-1] = (self.buf == 32) | (self.buf == 10)
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        breaks = np.flatnonzero(self.buf == 10)
        self.first = np.concatenate(([0], np.searchsorted(self.start, breaks), [len(self.start)]))[: len(texts) + 1]
        if not texts:
            self.first = np.zeros(1, np.int64)
        self.hasher = SpanHasher(self.buf)

    def hashes(self) -> np.ndarray:
        return self.hasher.spans(self.start, self.end)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, offsets per document) of the n-word shingles; a document of 1 to
        n-1 words has one shingle, all its words; one without words has none."""
        count = np.diff(self.first)
        per_doc = np.where(count >= n, count - n + 1, np.minimum(count, 1))
        offsets = np.concatenate(([0], np.cumsum(per_doc)))
        total = int(offsets[-1])
        doc = np.repeat(np.arange(len(count)), per_doc)
        lead = self.first[:-1][doc] + (np.arange(total) - offsets[:-1][doc])
        last = lead + np.minimum(n, count[doc]) - 1
        return self.hasher.spans(self.start[lead], self.end[last]), offsets


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def pieces(batches: Iterable[pa.RecordBatch], text: str, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that none holds more than about ``limit`` bytes of text (one
    row at least), which bounds the numpy temporaries whatever the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        size = np.cumsum(np.nan_to_num(col.nbytes and pa_lengths(col)))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def pa_lengths(col: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
