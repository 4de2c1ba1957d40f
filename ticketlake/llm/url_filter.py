"""URL filter: rules looked up in a memory-mapped sorted array of 64-bit digests.

A rule is a host, a slash and the start of a path (``example.net/en/``); it fits its host
and all subdomains when the url's path starts with the rule's.  Rules are kept as a
sorted array of xxhash64 keys with the rule strings beside it.  A url probes one key per
host suffix and per length that occurs among the rules' paths, all urls of a batch in one
binary search; a hit counts only if the stored string is equal, so collisions are
harmless.  The longest fitting rule decides, of equally long ones that with the longer
host; without a rule the default verdict holds.

The index is built from a bounded rule list (``MAX_INDEX_BYTES``, checked), sent to the
executors once and mapped from a local file there.  A longer list is cut into several
such indexes, probed one after the other, and the best rule over all of them wins.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.llm.spark import bounded_batches

MAX_INDEX_BYTES = 64 << 20


def build_index(rules: Iterable[tuple[str, str]]) -> bytes:
    """Index of (rule, verdict) pairs.  Layout, as 64-bit words: number of rules, number
    of path lengths, the path lengths, sorted keys, string offsets (one more than rules);
    then one byte per verdict (1: block) and the rule strings.  Of a rule named twice a
    block wins.  Rules are host/path: a rule without a slash gets one, hosts are
    lower-cased."""
    verdict: dict[str, bool] = {}
    for rule, what in rules:
        if not rule:
            continue
        host, slash, path = rule.partition("/")
        rule = _lower(host) + "/" + path
        verdict[rule] = verdict.get(rule, False) or what == "block"
    found = sorted((xxhash.xxh64_intdigest(r.encode()), r) for r in verdict)
    texts = [r.encode() for _, r in found]
    lengths = sorted({len(r.encode()) - r.encode().index(b"/") for r in verdict})
    words = [len(found), len(lengths), *lengths, *(k for k, _ in found), *np.cumsum([0, *map(len, texts)]).tolist()]
    return np.array(words, np.uint64).tobytes() + bytes(verdict[r] for _, r in found) + b"".join(texts)


def _lower(host: str) -> str:
    """A-Z only."""
    return host.translate({c: c + 32 for c in range(65, 91)})


def parse(url: str | None) -> tuple[str, str]:
    """(host, path) of a url; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, path = _lower(rest[:cut]), rest[cut:]
    if path[:1] != "/":
        return host, ""
    end = min((i for c in "?#" if (i := path.find(c)) >= 0), default=len(path))
    return host, path[:end]


class Index:
    """A built index, mapped from a file."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        rules, kinds = (int(x) for x in data[:16].view(np.uint64))
        at = 16
        self.lengths = data[at:at + 8 * kinds].view(np.uint64).astype(np.int64).tolist()
        at += 8 * kinds
        self.keys = data[at:at + 8 * rules].view(np.uint64)
        at += 8 * rules
        self.offsets = data[at:at + 8 * (rules + 1)].view(np.uint64)
        at += 8 * (rules + 1)
        self.block, self.strings = data[at:at + rules], data[at + rules:]

    def best(self, parsed: list[tuple[str, str]]) -> tuple[list[str | None], list[str | None]]:
        """(rule, verdict) per url, both None where no rule fits."""
        rule: list[str | None] = [None] * len(parsed)
        verdict: list[str | None] = [None] * len(parsed)
        if not len(self.keys):
            return rule, verdict
        owner, candidate = [], []
        for i, (host, path) in enumerate(parsed):
            if not host or not path:
                continue
            tail = path.encode()
            suffix = host
            while True:
                head = suffix.encode()
                for n in self.lengths:
                    if n <= len(tail):
                        owner.append(i)
                        candidate.append(head + tail[:n])
                _, dot, suffix = suffix.partition(".")
                if not dot:
                    break
        keys = np.fromiter(map(xxhash.xxh64_intdigest, candidate), np.uint64, len(candidate))
        low = np.searchsorted(self.keys, keys)
        size = np.array([len(c) for c in candidate], np.int64)
        rank: dict[int, tuple[int, int]] = {}
        for c in np.flatnonzero(self.keys[np.minimum(low, len(self.keys) - 1)] == keys).tolist():
            at = int(low[c])
            while at < len(self.keys) and self.keys[at] == keys[c]:  # equal digests stand side by side
                stored = self.strings[int(self.offsets[at]):int(self.offsets[at + 1])].tobytes()
                if stored == candidate[c]:
                    i, score = owner[c], (int(size[c]), stored.index(b"/"))
                    if i not in rank or score > rank[i]:
                        rank[i] = score
                        rule[i], verdict[i] = stored.decode(), "block" if self.block[at] else "allow"
                at += 1
        return rule, verdict


_open: dict[str, Index] = {}


def _mapped(data: bytes) -> Index:
    """The index as a file of this executor's temp folder, mapped once per worker."""
    name = f"url-index-{xxhash.xxh64_hexdigest(data)}-{len(data)}"
    if name not in _open:
        path = os.path.join(tempfile.gettempdir(), name)
        if not os.path.exists(path):
            fd, part = tempfile.mkstemp(dir=tempfile.gettempdir())
            with os.fdopen(fd, "wb") as f:
                f.write(data)
            os.replace(part, path)
        _open[name] = Index(path)
    return _open[name]


def _judge(indexes, default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [parse(u) for u in batch.column(1).to_pylist()]
            rule: list[str | None] = [None] * len(parsed)
            verdict: list[str | None] = [None] * len(parsed)
            for data in indexes.value:
                for i, (r, v) in enumerate(zip(*_mapped(data).best(parsed))):
                    if r is not None and (rule[i] is None or (len(r.encode()), r.index("/")) > (len(rule[i].encode()), rule[i].index("/"))):
                        rule[i], verdict[i] = r, v
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0), "host": pa.array([h for h, _ in parsed], pa.string()),
                "path": pa.array([p for _, p in parsed], pa.string()), "rule": pa.array(rule, pa.string()),
                "verdict": pa.array([v or default for v in verdict], pa.string())})

    return run


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """One row per row: id, host, path, rule (null if none fits), verdict.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    path: from there up to ``?``, ``#`` or the end.  Null, empty and scheme-less urls have
    empty host and path and fit no rule; a url without path fits none either, as every
    rule's path starts with a slash.  ``rules`` are (rule, "block" or "allow") pairs; an
    empty list gives the default everywhere.  Other columns are ignored."""
    spark: SparkSession = pages.sparkSession
    bounded_batches(spark)
    indexes, part, size = [], [], 0
    for pair in rules:
        part.append(pair)
        size += len(pair[0] or "") * 4 + 32
        if size > MAX_INDEX_BYTES:
            indexes.append(build_index(part))
            part, size = [], 0
    indexes.append(build_index(part))
    plain = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"))
    return (plain.mapInArrow(_judge(spark.sparkContext.broadcast(indexes), default),
                             "id long, host string, path string, rule string, verdict string")
            .withColumnRenamed("id", id_col))
