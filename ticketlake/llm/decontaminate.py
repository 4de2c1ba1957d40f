"""Benchmark decontamination: a BM25 index of the test items, queried by every passage.

The items are the indexed side.  A posting holds an item's BM25 share for a term, its BM25
weight divided by the item's score against itself, so a score of 1 means that the passage
has all the item's terms and one threshold fits short and long items.  Postings are laid
out in blocks of BLOCK consecutive items with the block's largest share (block-max WAND
with blocks aligned to item numbers).

Every text is cut into overlapping passages of twice the longest item, half a passage
apart, so that any occurrence of an item lies inside one passage.  A whole Arrow batch of
passages runs at once: the block maxima of a passage's terms are summed per block, blocks
whose bound stays under the threshold are skipped, and only the postings of the remaining
blocks are scored exactly.  All items at or above the threshold are retrieved, none is
ranked away.  Retrieved items are verified on word n-grams: the share of the question's
5-grams and of the answer's 2-grams that the passage has must reach their limits.

The index is broadcast; its size is checked, and more items than fit are indexed in
several parts.  Document frequencies, item count, mean length and longest item are those of
all items in every part, so scores and passages don't depend on the number of parts.  Each
part is a pass of its own over the texts, stored before the next one; its broadcast is
freed then.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.llm.kernels import Words, as_long, pieces
from ticketlake.llm.spark import bounded_batches, fresh
from ticketlake.session import materialize

K1, B = 1.2, 0.75
BLOCK = 8
MAX_PART_CHARS = 16_000_000
DENSE = 4_000_000  # passage x block bounds held at once
THRESHOLD, QUESTION_SHARE, ANSWER_SHARE = 0.4, 0.5, 0.5
QUESTION_GRAM, ANSWER_GRAM = 5, 2
HITS = "__hits"  # the added column


class Whole(NamedTuple):
    """Statistics over all items of a benchmark: number of items with words, their mean and
    largest number of words; ``df`` of the sorted word hashes ``terms`` of one part."""

    items: int
    mean: float
    longest: int
    terms: np.ndarray
    df: np.ndarray


class Index:
    """Block-max index of (question, answer) items; ``terms`` are sorted word hashes.

    ``whole`` are the statistics of all items, if these are one part of them."""

    def __init__(self, items: list[tuple[int | None, str, str]], whole: Whole | None = None):
        texts = [f"{q} {a}" for _, q, a in items]
        words = Words(texts)
        hashes, first = words.hashes(), words.first
        length = np.diff(first)
        keep = np.flatnonzero(length > 0)
        self.ids = [items[k][0] for k in keep]
        n = len(keep)
        self.longest = whole.longest if whole else int(length.max(initial=1))
        item = np.repeat(np.searchsorted(keep, np.arange(len(items))), length)
        self.terms, term = np.unique(hashes, return_inverse=True)
        pair, tf = np.unique(term.astype(np.int64) * max(n, 1) + item, return_counts=True)
        p_term, p_item = pair // max(n, 1), pair % max(n, 1)
        df = np.bincount(p_term, minlength=len(self.terms))
        size = length[keep]
        total, mean = n, size.mean() if n else 1
        if whole:
            total, mean = whole.items, whole.mean
            df = whole.df[np.searchsorted(whole.terms, self.terms)] if n else df
        idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * size / max(mean, 1))
        weight = idf[p_term] * tf * (K1 + 1) / (tf + norm[p_item])
        self.share = weight / np.bincount(p_item, weight, n)[p_item] if n else weight
        self.item = p_item
        # blocks of a term's postings: entry e covers postings[post[e]:post[e + 1]]
        block = p_item // BLOCK
        head = np.flatnonzero(np.concatenate(([True], (p_term[1:] != p_term[:-1]) | (block[1:] != block[:-1])))) if len(pair) else np.zeros(0, np.int64)
        self.post = np.append(head, len(pair))
        self.entry_block = block[head]
        self.entry_max = np.maximum.reduceat(self.share, head) if len(head) else np.zeros(0)
        self.entry_at = np.searchsorted(p_term[head], np.arange(len(self.terms) + 1))
        self.blocks = -(-n // BLOCK)
        self.slots = np.zeros(1 << 20, bool)
        self.slots[(self.terms >> np.uint64(44)).astype(np.int64)] = True
        self.question = [_grams([items[k][1]], QUESTION_GRAM) for k in keep]
        self.answer = [_grams([items[k][2]], ANSWER_GRAM) for k in keep]

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 if no item has it."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.terms):
            some = np.flatnonzero(self.slots[(hashes >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.terms, hashes[some]), len(self.terms) - 1)
            hit = self.terms[at] == hashes[some]
            out[some[hit]] = at[hit]
        return out

    def retrieve(self, passage: np.ndarray, term: np.ndarray, passages: int, threshold: float):
        """(passage, item, score) of all scores >= threshold; ``passage`` / ``term`` are
        the distinct pairs, sorted by passage."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        step = max(1, DENSE // max(1, self.blocks))
        for low in range(0, passages, step):
            a, b = np.searchsorted(passage, (low, low + step))
            if a == b:
                continue
            p, t = passage[a:b] - low, term[a:b]
            entry, owner = _expand(self.entry_at[t], self.entry_at[t + 1])
            cell = p[owner] * self.blocks + self.entry_block[entry]
            bound = np.bincount(cell, self.entry_max[entry], min(step, passages - low) * self.blocks)
            alive = bound >= threshold - 1e-9
            left = np.flatnonzero(alive[cell])
            if not len(left):
                continue
            post, who = _expand(self.post[entry[left]], self.post[entry[left] + 1])
            key = p[owner[left]][who] * len(self.ids) + self.item[post]
            pair, inverse = np.unique(key, return_inverse=True)
            score = np.bincount(inverse, self.share[post])
            good = score >= threshold - 1e-9
            found.append((pair[good] // len(self.ids) + low, pair[good] % len(self.ids), score[good]))
        return tuple(np.concatenate(x) for x in zip(*found))


def _expand(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges [begin, end) and the range each comes from."""
    size = end - begin
    at = np.concatenate(([0], np.cumsum(size)))
    return np.arange(at[-1]) + np.repeat(begin - at[:-1], size), np.repeat(np.arange(len(size)), size)


def _grams(texts: list[str], n: int) -> np.ndarray:
    return np.unique(Words(texts).shingles(n)[0])


def _overlap(wanted: np.ndarray, words: Words, lo: int, hi: int, n: int) -> float:
    """Share of the n-grams in ``wanted`` that the words lo..hi have; 1 if there are none.
    An item part shorter than n words is one shorter gram and is looked for as such."""
    if not len(wanted):
        return 1.0
    best = 0
    for size in range(n, 0, -1):
        if hi - lo >= size:
            have = words.hasher.spans(words.start[lo:hi - size + 1], words.end[lo + size - 1:hi])
            best = max(best, int(np.isin(wanted, have).sum()))
            if best or len(wanted) > 1:
                break
    return best / len(wanted)


def split_item(text: str) -> tuple[str, str]:
    """(question, answer) of an item without parts: the answer is the last quarter of its
    words, one at least."""
    words = text.split()
    cut = len(words) - max(1, len(words) // 4)
    return " ".join(words[:cut]), " ".join(words[cut:])


def search(index: Index, texts: list[str | None], threshold: float, question_share: float, answer_share: float):
    """Per text: list of (item id, score, question share, answer share) of verified items."""
    words = Words(texts)
    out: list[dict] = [{} for _ in texts]
    if not index.ids:
        return out
    half = index.longest
    count = np.diff(words.first)
    per_doc = np.where(count > 0, np.maximum(1, -(-(count - half) // half)), 0)
    base = np.concatenate(([0], np.cumsum(per_doc)))
    passages = int(base[-1])
    doc = np.repeat(np.arange(len(texts)), per_doc)
    begin = words.first[:-1][doc] + (np.arange(passages) - base[:-1][doc]) * half
    end = np.minimum(begin + 2 * half, words.first[1:][doc])
    term = index.lookup(words.hashes())
    place = np.flatnonzero(term >= 0)
    if not len(place):
        return out
    owner = np.searchsorted(words.first, place, "right") - 1
    chunk = (place - words.first[owner]) // half  # a word lies in this passage and in the one before
    keys = []
    for back in (0, 1):
        k = chunk - back
        ok = (k >= 0) & (k < per_doc[owner])
        keys.append((base[:-1][owner[ok]] + k[ok]) * len(index.terms) + term[place[ok]])
    key = np.unique(np.concatenate(keys))
    found = index.retrieve(key // len(index.terms), key % len(index.terms), passages, threshold)
    for p, i, score in zip(*(x.tolist() for x in found)):
        lo, hi = int(begin[p]), int(end[p])
        q = _overlap(index.question[i], words, lo, hi, QUESTION_GRAM)
        if q < question_share:
            continue
        a = _overlap(index.answer[i], words, lo, hi, ANSWER_GRAM)
        if a >= answer_share:
            mine = out[doc[p]]
            mine[index.ids[i]] = max(mine.get(index.ids[i], (0.0, 0.0, 0.0)), (round(score, 6), q, a))
    return out


def _word_rows(parts: bool):
    """Arrow pass: (q, a, part) -> one row (part, term, n) per distinct word of an item, and
    one with a null term and the item's number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, a, part = (batch.column(k).to_pylist() for k in range(3))
            words = Words([f"{x} {y}" if parts else " ".join(split_item(x)) for x, y in zip(q, a)])
            hashes, size = as_long(words.hashes()), np.diff(words.first)
            own = [np.unique(hashes[words.first[k]:words.first[k + 1]]) for k in range(len(q))]
            some = [k for k in range(len(q)) if size[k]]
            count = [len(own[k]) for k in range(len(q))]
            term = pa.concat_arrays([pa.array(np.concatenate(own) if own else [], pa.int64()), pa.nulls(len(some), pa.int64())])
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([*np.repeat(part, count).tolist(), *(part[k] for k in some)], pa.int64()), "term": term,
                "n": pa.array([*[1] * int(sum(count)), *(int(size[k]) for k in some)], pa.int64())})

    return run


def indexes(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """The index of all items, or one after the other those of its parts, each of about
    MAX_PART_CHARS // 2 characters.  Columns ``question`` and ``answer`` are used where both
    exist, otherwise :func:`split_item` cuts the text."""
    parts = {"question", "answer"} <= set(benchmark.columns)
    item = F.col(id_col).cast("long").alias("id")
    if parts:
        plain = benchmark.select(item, F.col("question").cast("string").alias("q"), F.col("answer").cast("string").alias("a"))
    else:
        plain = benchmark.select(item, F.col(text_col).cast("string").alias("q"), F.lit("").alias("a"))
    plain = plain.select("id", F.coalesce("q", F.lit("")).alias("q"), F.coalesce("a", F.lit("")).alias("a"))
    chars = plain.agg(F.sum(F.length("q") + F.length("a"))).first()[0] or 0
    n = 1 + int(chars // (MAX_PART_CHARS // 2))

    def items(rows):
        found = [(r["id"], r["q"], r["a"]) if parts else (r["id"], *split_item(r["q"])) for r in rows]
        return sorted(found, key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2]))

    if n == 1:
        yield Index(items(plain.collect()))
        return
    dealt = plain.withColumn("part", F.pmod(F.xxhash64("id", "q", "a"), F.lit(n)))
    words = materialize(dealt.select("q", "a", "part").mapInArrow(_word_rows(parts), "part long, term long, n long"))
    count, total, longest = words.where("term is null").agg(F.count("*"), F.sum("n"), F.max("n")).first()
    terms = words.where("term is not null")
    df = terms.groupBy("term").agg(F.sum("n").alias("df"))
    df = materialize(terms.select("part", "term").distinct().join(df, "term"))
    for k in range(n):
        rows = df.where(F.col("part") == k).select("term", "df").toArrow()
        term = rows["term"].to_numpy().view(np.uint64)
        order = np.argsort(term)
        yield Index(items(dealt.where(F.col("part") == k).collect()), Whole(
            count, (total or 0) / max(count, 1), longest or 1, term[order], rows["df"].to_numpy()[order]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text: str = "text", threshold: float = THRESHOLD, question_share: float = QUESTION_SHARE,
               answer_share: float = ANSWER_SHARE, hits_col: str = HITS) -> DataFrame:
    """One row per row of ``docs``: all its columns plus ``hits_col``, array<struct<item,
    score, question, answer>> of the verified items, by item.  A column of that name is
    replaced.

    Null and empty texts have no hits; items without words match nothing; an item without
    id is reported with a null id.  Repeated rows are searched alike; items that repeat an
    id give one hit, the best.  An empty benchmark gives empty lists."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(hits_col)
    hit = pa.struct([("item", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())])
    sc = docs.sparkSession.sparkContext
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    fields += f", `{hits_col}` array<struct<item: bigint, score: double, question: double, answer: double>>"

    def search_with(index, later: bool):
        """Pass of one part; a later one adds to the hits of those before."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, text_col):
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                found = search(index.value, texts, threshold, question_share, answer_share)
                columns, names = list(batch.columns), list(batch.schema.names)
                if later:
                    names.pop()
                    for mine, before in zip(found, columns.pop().to_pylist()):
                        for x in before:
                            what = (x["score"], x["question"], x["answer"])
                            mine[x["item"]] = max(mine.get(x["item"], what), what)
                rows = [[(i, *v) for i, v in sorted(h.items(), key=lambda x: (x[0] is None, x[0] or 0))] for h in found]
                rows = [[dict(zip(("item", "score", "question", "answer"), r)) for r in row] for row in rows]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, pa.list_(hit))], names=[*names, hits_col])

        return run

    out, last = docs, None
    for index in indexes(benchmark, item_col, item_text):
        if last is not None:  # the pass before is stored, so that its index can go
            out = materialize(out)
            last.destroy()
        here = sc.broadcast(index)
        out = out.mapInArrow(search_with(here, last is not None), fields)
        last = here
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold a verified test item."""
    hits = fresh(HITS, docs.columns)
    return find_leaks(docs, benchmark, hits_col=hits, **options).where(F.size(hits) == 0).drop(hits)
