"""Quality rules with risk-controlled thresholds.

Fixed base rules fail a document outright.  Beyond them a document is measured by five
ratios, each with a ladder of cutoffs from lenient to strict that is fixed beforehand.
Which rungs are used is decided per stratum (language) from labelled documents that pass
the base rules, in two parts that share no document:

1. The proposing part gives each rule its target rung: the strictest one that rejects at
   most ``alpha / rules`` of the good documents, and of the bad ones at least LIFT times the
   share.  A rule without such a rung isn't used in the stratum.
2. All rules are tightened together, rung by rung, up to their targets: step ``t`` of
   ``STEPS`` uses a rule's rung ``target - (STEPS - t)``.  The certifying part counts the good
   documents that a step rejects by any rule.  A step is certified if the exact binomial
   tail P(Bin(n, alpha) <= rejected) is at most ``delta`` divided by the number of strata,
   which is the one-sided Clopper-Pearson bound lying under alpha.  Steps are tested in
   order and the testing ends at the first that isn't certified, so the sequence itself
   costs no correction; the strata are corrected for by Bonferroni.

So with probability ``1 - delta`` the verdict rejects at most a share ``alpha`` of the good
documents in every stratum at once.  A stratum with too few labels to show that keeps
everything: that is the guarantee, not a default.

The ratios come from one numpy pass over flat text buffers.  Labelled documents are
counted in cells (stratum, part, label, first violated rung of each rule); a stratum's
cells are bounded by the ladders, whatever the number of documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlake.llm.kernels import SpanHasher, mix, pieces
from ticketlake.llm.spark import bounded_batches
from ticketlake.session import materialize, measured

SYMBOLS = b"#*$%&|<>"
WINDOW = 8  # words
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30  # base rules
STEPS = 8
#: rule -> (numerator, denominator, whether more is worse, ladder in hundredths, lenient first)
RULES = {
    "symbols": ("n_symbols", "n_words", True, (200, 100, 50, 30, 20, 10, 5, 2)),
    "dup_lines": ("n_dup_lines", "n_lines", True, (90, 80, 70, 60, 50, 40, 30, 20)),
    "repeats": ("n_repeat_words", "n_words", True, (28, 25, 20, 18, 15, 12, 10, 5)),
    "short_words": ("word_chars", "n_words", False, (150, 200, 250, 275, 300, 325, 350, 375)),
    "long_words": ("word_chars", "n_words", True, (2000, 1600, 1300, 1100, 1000, 900, 800, 700)),
}
ALPHA, DELTA, LIFT = 0.05, 0.05, 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _again(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which of the hashes occurred before in the same owner; owners ascend."""
    order = np.lexsort((h, owner))  # stable: equal ones stay in order
    same = np.zeros(len(h), bool)
    same[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    return same


def measure(texts: list[str | None]) -> np.ndarray:
    """One row per text: the MEASURES.  Null is empty."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    edge = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw]))).astype(np.int64)
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)  # every text ends with a line feed
    blank = (buf == 32) | ((buf >= 9) & (buf <= 13))

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[edge])

    start = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    end = np.flatnonzero(blank & np.concatenate(([False], ~blank[:-1])))
    first = np.searchsorted(start, edge)
    n_words = np.diff(first)
    word_chars = per_text(~blank & ((buf & 0xC0) != 0x80))
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    hasher = SpanHasher(buf)

    # lines with a word; a text's last line ends at the line feed added to it
    feed = np.flatnonzero(buf == 10)
    begin = np.concatenate(([0], feed[:-1] + 1))
    worded = np.searchsorted(start, feed) > np.searchsorted(start, begin)
    begin, stop = begin[worded], feed[worded]
    of = np.searchsorted(edge, begin, "right") - 1
    dup = _again(hasher.spans(begin, stop), of)

    # windows of words; the words of every window that the text has twice are marked
    word_of = np.repeat(np.arange(len(texts)), n_words)
    lead = np.arange(max(len(start) - WINDOW + 1, 0))
    lead = lead[word_of[lead] == word_of[lead + WINDOW - 1]]
    h = SpanHasher(hasher.spans(start, end)).spans(lead, lead + WINDOW)
    owner = word_of[lead]
    _, which, times = np.unique(mix(h) ^ mix(owner.astype(np.uint64), 3), return_inverse=True, return_counts=True)
    twice = lead[times[which] > 1]
    cover = np.zeros(len(start) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    repeated = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))[first]
    return np.stack([
        n_words, word_chars, per_text(symbol[buf]), np.bincount(of[dup], minlength=len(texts)),
        np.diff(repeated), np.bincount(of, minlength=len(texts))], 1).astype(np.int64)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        found = measure(batch.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(found[:, k]) for k in range(len(MEASURES)))],
            names=["id", "stratum", *MEASURES])


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly up to rounding; 1 where k is not under the mean, for
    there it exceeds any level in use."""
    if n <= 0 or k >= n * p:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    term = total = math.exp(log)
    for i in range(k, 0, -1):  # the terms fall off below the mean
        term *= i / (n - i + 1) * (1 - p) / p
        total += term
        if term < total * 1e-17:
            break
    return total


def violated(rule: str) -> Column:
    """The first rung of the ladder (from 1) that a document violates; STEPS + 1: none.  A
    ratio without denominator violates none."""
    over, under, more, ladder = RULES[rule]
    a, b = F.col(over) * 100, F.col(under)
    return F.lit(STEPS + 1) - sum(F.when((b > 0) & ((a > cut * b) if more else (a < cut * b)), 1).otherwise(0) for cut in ladder)


def choose(cells: Sequence[tuple], strata: int, alpha: float, delta: float) -> tuple[list[int], int, int]:
    """(rung of each rule, 0 for none; good documents that certified; of them rejected) of
    one stratum, from its cells (certifying part, label, count, first violated rungs...)."""
    table = np.array(cells, np.int64).reshape(-1, 3 + len(RULES))
    part, good, count, rungs = table[:, 0] == 1, table[:, 1] == 1, table[:, 2], table[:, 3:]
    n_good, n_bad = count[~part & good].sum(), count[~part & ~good].sum()
    target = np.zeros(len(RULES), np.int64)
    if n_good and n_bad:
        for r in range(len(RULES)):
            for g in range(1, STEPS + 1):
                lost = count[~part & good & (rungs[:, r] <= g)].sum()
                hit = count[~part & ~good & (rungs[:, r] <= g)].sum()
                if lost * len(RULES) <= alpha * n_good and hit and hit * n_good >= LIFT * lost * n_bad:
                    target[r] = g
    sure = count[part & good]
    n = int(sure.sum())
    used = target > 0
    if not used.any() or not n:
        return [0] * len(RULES), n, 0
    step = (rungs[part & good][:, used] - target[used] + STEPS).min(1)  # the first step that rejects
    best, rejected = 0, 0
    for t in range(1, STEPS + 1):
        k = int(sure[step <= t].sum())
        if binomial_tail(k, n, alpha) > delta / strata:
            break
        best, rejected = t, k
    rung = np.where(used & (best > 0), np.maximum(target - (STEPS - best), 0), 0)
    return rung.tolist(), n, rejected


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """id, stratum and the MEASURES of every row of ``docs``, whole texts."""
    bounded_batches(docs.sparkSession)
    stratum = F.col(stratum_col).cast("string") if stratum_col else F.lit("")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), stratum.alias("stratum"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(_measure, "id long, stratum string, " + ", ".join(f"{m} long" for m in MEASURES))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def thresholds(measured_docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
               alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, rungs array<int> (one per rule, 0: not used), n_certifying, n_rejected: the
    cutoffs of every stratum that has a label.

    Labels other than 0 and 1 and null ids count for nothing; of several labels of an id
    the largest counts, and rows that repeat an id count each.  Folds by the CRC-32 of the
    id as text: remainders 1 and 2 of five propose, 3 and 4 certify, 0 is left out, so that
    the outcome can be measured on it."""
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and id is not null")
    own = own.groupBy("id").agg(F.max("y").alias("y"))
    fold = F.crc32(F.col("id").cast("string").cast("binary")) % 5
    names = [f"v_{r}" for r in RULES]
    cells = materialize(
        measured_docs.where(~base_failed()).join(own, "id").withColumn("fold", fold).where("fold <> 0")
        .select("stratum", F.when(F.col("fold") >= 3, 1).otherwise(0).alias("certify"), "y", *(violated(r).alias(v) for r, v in zip(RULES, names)))
        .groupBy("stratum", "certify", "y", *names).agg(F.count("*").alias("n")))
    strata = max(cells.select("stratum").distinct().count(), 1)

    def per_stratum(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table[c].to_pylist() for c in ["certify", "y", "n", *names])))
        rungs, n, k = choose(rows, strata, alpha, delta)
        return pa.table({"stratum": table["stratum"].slice(0, 1), "rungs": pa.array([rungs], pa.list_(pa.int32())),
                         "n_certifying": pa.array([n], pa.int64()), "n_rejected": pa.array([k], pa.int64())})

    return cells.groupBy("stratum").applyInArrow(per_stratum, "stratum string, rungs array<int>, n_certifying long, n_rejected long")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang",
          label_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per row of ``docs``: id, the MEASURES, base_failed, rejected_by (names of the
    rules whose certified cutoff the document violates) and kept.

    A null or empty text has no words and fails the base rules.  A null stratum is a
    stratum; one without labels keeps whatever passes the base rules.  A null id has no
    label but is judged.  Other columns are ignored; empty tables give empty results, and
    without labels only the base rules hold."""
    found = materialize(measures(docs, id_col, text_col, stratum_col))
    cut = thresholds(found, labels, id_col, label_col, alpha, delta).select(F.col("stratum").alias("of"), "rungs")
    joined = found.join(measured(cut), F.col("stratum").eqNullSafe(F.col("of")), "left")
    failing = [F.when(violated(r) <= F.get(F.col("rungs"), F.lit(k)), F.lit(r)) for k, r in enumerate(RULES)]
    out = joined.select(F.col("id").alias(id_col), *MEASURES, base_failed().alias("base_failed"),
                        F.array_compact(F.array(*failing)).alias("rejected_by"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
