"""Shared parts of the two text classifiers: the labelled sample and hashed n-gram ids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlake.llm.kernels import Words, mix


def held_out(doc_id: Column) -> Column:
    """Fold 0 of five by the CRC-32 of the id as text; a row without id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str,
                    max_rows: int, max_chars: int) -> tuple[list[str], np.ndarray, float]:
    """(texts, labels, prior of label 1) of a bounded sample of the rows to learn from.

    Rows are labelled 0 or 1 and not held out.  Up to ``max_rows / 2`` rows of each label
    are drawn in the order of a hash of the id, whole texts, as long as the total stays
    under ``max_chars``; with fewer rows all are used.  The prior counts all rows."""
    name = F.col(id_col)
    own = labels.select(name.cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and id is not null")
    own = own.groupBy("id").agg(F.max("y").alias("y")).where(~held_out(F.col("id")))
    text = docs.select(name.cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    counts = {r["y"]: r["c"] for r in own.groupBy("y").agg(F.count("*").alias("c")).collect()}
    half = max_rows // 2
    picked = [own.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(half) for y in (0, 1)]
    picked = picked[0].union(picked[1])
    size = text.select("id", F.length("text").alias("n"))
    sized = sorted(
        picked.join(size, "id").groupBy("id").agg(F.max("y").alias("y"), F.max("n").alias("n"), F.xxhash64("id").alias("h")).collect(),
        key=lambda r: (r["h"], r["id"]))
    room, ids = {0: max_chars // 2, 1: max_chars // 2}, []
    for r in sized:
        if (r["n"] or 0) <= room[r["y"]]:
            room[r["y"]] -= r["n"] or 0
            ids.append((r["id"], r["y"]))
    if not ids:
        return [], np.zeros(0, np.int64), 0.5
    chosen = docs.sparkSession.createDataFrame(ids, "id long, y int")
    rows = sorted(text.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("text").alias("text"), F.max("y").alias("y")).collect(), key=lambda r: r["id"])
    total = sum(counts.values())
    return [r["text"] or "" for r in rows], np.array([r["y"] for r in rows]), counts.get(1, 0) / total if total else 0.5


def char_ngrams(words: Words, length: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids, offsets per document) of the byte n-grams of each normalised text; an
    n-gram may hold blanks but never spans two documents."""
    buf = words.buf
    breaks = np.flatnonzero(buf == 10)
    edge = np.concatenate(([-1], breaks, [len(buf)]))[: len(words.first)]
    if len(edge) < 2:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    count = np.maximum(np.diff(edge) - 1 - length + 1, 0)
    offsets = np.concatenate(([0], np.cumsum(count)))
    begin = np.arange(offsets[-1]) + np.repeat(edge[:-1] + 1 - offsets[:-1], count)
    return _bucket(words.hasher.spans(begin, begin + length), length, bits), offsets


def word_ids(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids, offsets per document) of the words; a word that repeats the one
    before it has the bucket of repetition, whatever the word."""
    h = words.hashes()
    ids = _bucket(h, 0, bits)
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    first = words.first[:-1]
    again[first[first < len(h)]] = False
    ids[again] = 0
    return ids, words.first


def _bucket(h: np.ndarray, salt: int, bits: int) -> np.ndarray:
    return (mix(h, 31 + salt) >> np.uint64(64 - bits)).astype(np.int32)


class Distinct:
    """The distinct ids of one document after the other, without sorting: each id is
    stamped with its place, and a place counts if the stamp is still its own."""

    def __init__(self, bits: int):
        self.stamp = np.zeros(1 << bits, np.int32)
        self.place = np.arange(1 << 16, dtype=np.int32)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) > len(self.place):
            self.place = np.arange(2 * len(ids), dtype=np.int32)
        place = self.place[:len(ids)]
        self.stamp[ids] = place
        return ids[self.stamp[ids] == place]
