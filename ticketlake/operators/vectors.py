"""Vector operators (F6, F9, J7, J8, A15, A16, A19, ML9 neighbours).

Element-wise work (cosine of a joined pair, L2 normalisation, means) is native
higher-order-function or ``posexplode`` + aggregate code.  All-pairs work (nearest
vector, exact silhouette, SMOTE neighbours) uses one block-grid operator:

    left rows  -> block  pmod(xxhash64(id), L), replicated to the R right blocks
    right rows -> block  pmod(xxhash64(id), R), replicated to the L left blocks
    cogroup on (left block, right block) -> applyInPandas: numpy on one cell

A side has _GRID blocks as soon as it is large, so a vector is shuffled a fixed number of
times; only a block over BLOCK_BYTES of vectors is cut further, so memory per task is
bounded whatever the table size (``block_rows`` sets the rows of a block instead).  A cell
goes through its pairs in pieces that fit a core's cache and emits one small partial per
left row (best match, or per-cluster distance sums); the partials are merged by an ordinary
aggregate.  No pair is ever emitted as a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlake.functions.scalar import COSINE_EPS, cosine, l2_normalise  # noqa: F401  (re-export)
from ticketlake.operators.evaluation import first_k_per_class
from ticketlake.operators.retrieval import NO_MATCH_ANSWER, NO_MATCH_SCORE  # noqa: F401
from ticketlake.session import materialize

DEFAULT_BLOCK_ROWS = 2048  # a table of few such blocks is cut into them
_GRID = 8                  # blocks of a side, unless they would be larger than
BLOCK_BYTES = 32 << 20     # this many bytes of vectors in double precision
_CELLS_PER_TASK = 32
_CHUNK, _WIDTH = 128, 512  # rows of the left and the right cell handled per numpy step (bounds the temporary arrays)


def _n_blocks(df: DataFrame, vec: str, block_rows: int | None) -> int:
    n, dim = df.agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
    if block_rows is not None:
        return max(1, math.ceil(n / block_rows))
    return max(1, min(_GRID, math.ceil(n / DEFAULT_BLOCK_ROWS)), math.ceil(n * 8 * max(dim or 1, 1) / BLOCK_BYTES))


def block_grid(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_vec: str, right_vec: str, fn, schema: str,
               *, block_rows: int | None = None) -> DataFrame:
    """Pair every left block with every right block and run ``fn(left_pdf, right_pdf)``
    on each cell (cogrouped pandas frames).  Block counts come from the row counts and the
    length of the vectors."""
    nl = _n_blocks(left, left_vec, block_rows)
    nr = _n_blocks(right, right_vec, block_rows)
    lb = F.pmod(F.xxhash64(F.col(left_id)), F.lit(nl)).cast("int")
    rb = F.pmod(F.xxhash64(F.col(right_id)), F.lit(nr)).cast("int")
    L = left.select("*", lb.alias("_lb"), F.explode(F.sequence(F.lit(0), F.lit(nr - 1))).alias("_rb"))
    R = right.select("*", rb.alias("_rb"), F.explode(F.sequence(F.lit(0), F.lit(nl - 1))).alias("_lb"))
    # Cells are CPU-bound numpy work: an explicit partition count (not coalesced by
    # AQE) keeps them spread over all cores / executors, co-partitioned on both sides.
    # It grows with the cells: one task works through about _CELLS_PER_TASK of them.
    cells = nl * nr
    p = max(min(cells, 2 * left.sparkSession.sparkContext.defaultParallelism), math.ceil(cells / _CELLS_PER_TASK))
    L = L.repartition(p, "_lb", "_rb")
    R = R.repartition(p, "_lb", "_rb")
    return L.groupBy("_lb", "_rb").cogroup(R.groupBy("_lb", "_rb")).applyInPandas(fn, schema=schema)


def _distances(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Euclidean distances of all rows of a to all rows of b by |a|^2 + |b|^2 - 2ab, in pieces
    (first row of a, first row of b, distances), a's rows ascending, for each b's: the only
    temporaries have one entry per pair of a piece, whatever the dimension.  Both are shifted
    to the mean of b first, which keeps the cancellation small."""
    mean = b.mean(axis=0)
    a, b = a - mean, b - mean
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    cross, out = np.empty((2, min(_CHUNK, len(a)), min(_WIDTH, len(b))))  # used again by every piece
    for s in range(0, len(a), _CHUNK):
        twice = 2.0 * a[s:s + _CHUNK]
        for t in range(0, len(b), _WIDTH):
            near = b[t:t + _WIDTH]
            g, d = cross[:len(twice), :len(near)], out[:len(twice), :len(near)]
            np.matmul(twice, near.T, out=g)
            np.add(aa[s:s + _CHUNK, None], bb[None, t:t + _WIDTH], out=d)
            d -= g
            np.maximum(d, 0.0, out=d)
            yield s, t, np.sqrt(d, out=d)


def _k_least(row: np.ndarray, dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k least entries in the order of (distance, id)."""
    order = np.lexsort((ids, dist, row))
    sorted_rows = row[order]
    first = np.searchsorted(sorted_rows, sorted_rows, side="left")
    return order[np.arange(len(order)) - first < k]


def _matrix(series: pd.Series) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.vstack([np.asarray(v, dtype=np.float64) for v in series])


# ======================================================================================
# Nearest vector
# ======================================================================================

def nearest(queries: DataFrame, kb: DataFrame, *, qid: str = "qid", kid: str = "kid", vec: str = "embedding",
            exclude_self: bool = False, block_rows: int | None = None) -> DataFrame:
    """For every query vector the KB entry of highest cosine (dot / (|a||b| + 1e-8));
    ties go to the lowest KB id (T13: first of equal scores).  ``exclude_self`` skips
    the KB row with the same id (nearest *other* vector of one table).  Queries with
    no KB row or without a vector get (null, -1.0).  Returns (qid, best_id, score)."""
    asked = queries.select(F.col(qid).alias("_q"), F.col(vec).alias("_qv"))
    q = asked.filter(F.col("_qv").isNotNull())
    k = kb.select(F.col(kid).alias("_k"), F.col(vec).alias("_kv")).filter(F.col("_kv").isNotNull())

    def cell(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if len(lp) == 0 or len(rp) == 0:
            return pd.DataFrame({"_q": pd.Series([], dtype="int64"), "best_id": pd.Series([], dtype="int64"),
                                 "score": pd.Series([], dtype="float64")})
        rp = rp.sort_values("_k", kind="stable")
        A, B = _matrix(lp["_qv"]), _matrix(rp["_kv"])
        na, nb = np.linalg.norm(A, axis=1), np.linalg.norm(B, axis=1)
        kids = rp["_k"].to_numpy()
        best_i = np.full(len(A), kids[0], dtype=np.int64)
        best_s = np.full(len(A), -np.inf)
        qids = lp["_q"].to_numpy()
        for s in range(0, len(A), _CHUNK):
            for t in range(0, len(B), _WIDTH):
                sc = (A[s:s + _CHUNK] @ B[t:t + _WIDTH].T) / (na[s:s + _CHUNK, None] * nb[None, t:t + _WIDTH] + COSINE_EPS)
                if exclude_self:
                    sc[qids[s:s + _CHUNK, None] == kids[None, t:t + _WIDTH]] = -np.inf
                j = np.argmax(sc, axis=1)  # first maximum = lowest id (sorted)
                top = sc[np.arange(len(j)), j]
                better = np.flatnonzero((top > best_s[s:s + _CHUNK]) | np.isnan(top))
                best_i[s + better] = kids[t + j[better]]
                best_s[s + better] = top[better]
        out = pd.DataFrame({"_q": qids, "best_id": best_i, "score": best_s})
        return out[np.isfinite(out["score"])]

    parts = block_grid(q, k, "_q", "_k", "_qv", "_kv", cell, "_q long, best_id long, score double", block_rows=block_rows)
    best = parts.groupBy("_q").agg(F.min_by(F.struct("best_id", "score"),
                                            F.struct((-F.col("score")).alias("s"), F.col("best_id"))).alias("m"))
    out = asked.select("_q").join(best, "_q", "left")
    return out.select(F.col("_q").alias(qid), F.col("m.best_id").alias("best_id"),
                      F.coalesce(F.col("m.score"), F.lit(NO_MATCH_SCORE)).alias("score"))


def pair_cosine(a: DataFrame, b: DataFrame, key: str, vec_a: str, vec_b: str) -> DataFrame:
    """Cosine of the two vectors of each key (an equi join, then native code)."""
    j = a.select(key, F.col(vec_a).alias("_a")).join(b.select(key, F.col(vec_b).alias("_b")), key)
    return j.select(key, cosine("_a", "_b").alias("cosine"))


def long_form(df: DataFrame, id_cols: list[str], vec: str, value: str = "x") -> DataFrame:
    """(ids..., pos, x) rows of a vector column, x as double (posexplode)."""
    return df.select(*id_cols, F.posexplode(vec).alias("pos", value)).withColumn(value, F.col(value).cast("double"))


def centroids(df: DataFrame, group: str, vec: str, out: str, mask: str | None = None) -> DataFrame:
    """(group, ``out``): the mean vector of each group as an array.  ``Summarizer`` keeps one
    running vector per group and task, so a row is never blown up to one row per dimension.

    With ``mask`` (a weight, null as 0) the mean is the weighted one; a group whose weights
    are all 0 has the zero vector."""
    rows = df.filter(F.col(vec).isNotNull())
    if mask is None:
        mean = Summarizer.mean(array_to_vector(F.col(vec)))
        return rows.groupBy(group).agg(mean.alias("_m")).select(group, vector_to_array("_m").alias(out))
    w = F.coalesce(F.col(mask).cast("double"), F.lit(0.0))
    mean = Summarizer.mean(array_to_vector(F.col(vec)), w)
    some = rows.filter(w > 0).groupBy(group).agg(mean.alias("_m")).select(
        F.col(group).alias("_g"), vector_to_array("_m").alias("_a"))
    every = rows.groupBy(group).agg(F.max(F.size(vec)).alias("_d"))
    return every.join(some, F.col(group).eqNullSafe(F.col("_g")), "left").select(
        group, F.coalesce("_a", F.expr("array_repeat(0.0D, _d)")).alias(out))


def mean_vector(df: DataFrame, group: str, vec: str, mask: str | None = None) -> DataFrame:
    """Mean vector per group in long form (group, pos, mean), weighted by ``mask`` if
    one is given (mean pooling of token vectors)."""
    return centroids(df, group, vec, "_m", mask).select(group, F.posexplode("_m").alias("pos", "mean"))


# ======================================================================================
# Cluster scores
# ======================================================================================

def silhouette(df: DataFrame, id_col: str, label_col: str, vec: str, *,
               block_rows: int | None = None, sample_size: int | None = None, seed: int = 42) -> DataFrame:
    """Exact mean silhouette with Euclidean distance (T18), one row
    (silhouette, n_points, n_clusters).  Singleton clusters score 0; NaN when the
    number of clusters is not in [2, n-1].  Pairwise distances are summed per
    (point, other cluster) inside grid cells and merged by an aggregate.

    With ``sample_size`` about that many points, drawn in proportion from every cluster (two
    at least, by a hash of id and ``seed``), are scored against all points: work grows with
    n, not with its square.  The row then also has ``standard_error`` (of the stratified
    mean, 0 when every point was drawn) and ``n_scored``."""
    pts = df.select(F.col(id_col).alias("_i"), F.col(label_col).alias("_c"), F.col(vec).alias("_v")) \
        .filter(F.col("_v").isNotNull())
    if sample_size is None:
        per_point, n = _silhouette_points(pts, pts, block_rows), _cluster_sizes(pts)
        mean_s = per_point.agg(F.avg("s").alias("silhouette"))
        return n.join(mean_s, how="left").select(_if_defined("silhouette"), "n_points", "n_clusters")
    total = pts.count()
    share = min(1.0, sample_size / max(total, 1))
    drawn = materialize(first_k_per_class(pts, "_i", F.col("_c"), lambda c: F.least(c, F.greatest(F.ceil(c * share), F.lit(2))), seed)
                        .where("_in").drop("_in"))
    scored = _silhouette_points(drawn, pts, block_rows)
    sizes = pts.groupBy("_c").agg(F.count(F.lit(1)).alias("_nc"))
    strata = scored.groupBy("_c").agg(F.count(F.lit(1)).alias("_m"), F.avg("s").alias("_mean"), F.var_samp("s").alias("_var")).join(sizes, "_c")
    weight = F.col("_nc") / F.lit(float(max(total, 1)))
    mean = strata.agg(
        F.sum(weight * F.col("_mean")).alias("silhouette"), F.sum("_m").alias("n_scored"),
        F.sqrt(F.sum(weight * weight * F.coalesce("_var", F.lit(0.0)) / F.col("_m") * (1 - F.col("_m") / F.col("_nc")))).alias("standard_error"))
    return _cluster_sizes(pts).join(mean, how="left").select(
        _if_defined("silhouette"), "n_points", "n_clusters", _if_defined("standard_error"), F.coalesce("n_scored", F.lit(0)).alias("n_scored"))


def _cluster_sizes(pts: DataFrame) -> DataFrame:
    return pts.agg(F.count(F.lit(1)).alias("n_points"), F.count_distinct("_c").alias("n_clusters"))


def _if_defined(name: str) -> Column:
    return F.when((F.col("n_clusters") >= 2) & (F.col("n_clusters") <= F.col("n_points") - 1), F.col(name)).otherwise(F.lit(float("nan"))).alias(name)


def _silhouette_points(scored: DataFrame, pts: DataFrame, block_rows: int | None) -> DataFrame:
    """(_i, _c, s): the silhouette of every point of ``scored`` among all of ``pts``."""
    def cell(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"_i": pd.Series([], dtype="int64"), "_c": pd.Series([], dtype="int64"),
                              "_oc": pd.Series([], dtype="int64"), "dsum": pd.Series([], dtype="float64"),
                              "cnt": pd.Series([], dtype="int64")})
        if len(lp) == 0 or len(rp) == 0:
            return empty
        A, B = _matrix(lp["_v"]), _matrix(rp["_rv"])
        labels = rp["_rc"].to_numpy()
        uniq = np.unique(labels)
        onehot = (labels[:, None] == uniq[None, :]).astype(np.float64)
        cnt = onehot.sum(axis=0).astype(np.int64)
        sums = np.zeros((len(A), len(uniq)))
        for s, t, d in _distances(A, B):
            sums[s:s + _CHUNK] += d @ onehot[t:t + _WIDTH]
        n = len(A)
        return pd.DataFrame({
            "_i": np.repeat(lp["_i"].to_numpy(), len(uniq)),
            "_c": np.repeat(lp["_c"].to_numpy(), len(uniq)),
            "_oc": np.tile(uniq, n),
            "dsum": sums.reshape(-1),
            "cnt": np.tile(cnt, n),
        })

    right = pts.select(F.col("_i").alias("_ri"), F.col("_c").alias("_rc"), F.col("_v").alias("_rv"))
    parts = block_grid(scored, right, "_i", "_ri", "_v", "_rv", cell, "_i long, _c long, _oc long, dsum double, cnt long",
                       block_rows=block_rows)
    per = parts.groupBy("_i", "_c", "_oc").agg(F.sum("dsum").alias("dsum"), F.sum("cnt").alias("cnt"))
    own = per.filter(F.col("_c") == F.col("_oc"))
    a = own.select("_i", "_c", F.col("cnt").alias("n_own"),
                   F.when(F.col("cnt") > 1, F.col("dsum") / (F.col("cnt") - 1)).alias("a"))
    b = per.filter(F.col("_c") != F.col("_oc")).groupBy("_i").agg(F.min(F.col("dsum") / F.col("cnt")).alias("b"))
    return a.join(b, "_i", "left").select(
        "_i", "_c", F.when((F.col("n_own") <= 1) | F.col("b").isNull(), F.lit(0.0))
        .otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
        .alias("s"))


def davies_bouldin(df: DataFrame, id_col: str, label_col: str, vec: str) -> DataFrame:
    """Davies-Bouldin index, one row (davies_bouldin, n_clusters).

    Centroids are k rows (k = number of clusters), written once; each point's distance to
    its own is computed on the arrays of an equi join on the label; centroid distances by a
    self join of the k x d values on ``pos``.  0 when all spreads or all centroid distances
    are 0; NaN with fewer than 2 clusters."""
    cent = materialize(centroids(df, label_col, vec, "_c"))
    off = F.zip_with(F.col(vec), F.col("_c"), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    d = df.filter(F.col(vec).isNotNull()).join(cent, label_col).select(
        label_col, F.sqrt(F.aggregate(off, F.lit(0.0), lambda acc, x: acc + x)).alias("_d"))
    spread = d.groupBy(label_col).agg(F.avg("_d").alias("s"))
    flat = cent.select(label_col, F.posexplode("_c").alias("pos", "_cx"))
    ci = flat.select(F.col(label_col).alias("i"), "pos", F.col("_cx").alias("ci"))
    cj = flat.select(F.col(label_col).alias("j"), "pos", F.col("_cx").alias("cj"))
    m = (ci.join(cj, "pos").filter(F.col("i") != F.col("j"))
         .groupBy("i", "j").agg(F.sqrt(F.sum((F.col("ci") - F.col("cj")) ** 2)).alias("m")))
    si = spread.select(F.col(label_col).alias("i"), F.col("s").alias("si"))
    sj = spread.select(F.col(label_col).alias("j"), F.col("s").alias("sj"))
    r = m.join(si, "i").join(sj, "j").select(
        "i", F.when(F.col("m") == 0, F.lit(0.0)).otherwise((F.col("si") + F.col("sj")) / F.col("m")).alias("r"))
    per_i = r.groupBy("i").agg(F.max("r").alias("d_i"))
    k = spread.agg(F.count(F.lit(1)).alias("n_clusters"), F.max("s").alias("max_s"))
    mm = m.agg(F.max("m").alias("max_m"))
    db = per_i.agg(F.avg("d_i").alias("db"))
    return k.join(mm, how="left").join(db, how="left").select(
        F.when(F.col("n_clusters") < 2, F.lit(float("nan")))
        .when((F.col("max_s") == 0) | (F.col("max_m") == 0), F.lit(0.0))
        .otherwise(F.col("db")).alias("davies_bouldin"), "n_clusters")


def knn_same_class(df: DataFrame, id_col: str, label_col: str, vec: str, k: int, *,
                   block_rows: int | None = None) -> DataFrame:
    """ML9 helper: the k nearest other points of the same class (Euclidean), as rows
    (id, nb_rank, nb_id).  Per cell each point keeps its k best; the merge keeps the k
    best of those partials (a window bounded to k rows per point)."""
    pts = df.select(F.col(id_col).alias("_i"), F.col(label_col).alias("_c"), F.col(vec).alias("_v"))

    def cell(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(lp) and len(rp):
            for c, lg in lp.groupby("_c"):
                rg = rp[rp["_rc"] == c].sort_values("_ri", kind="stable")
                if len(rg) == 0:
                    continue
                A, B = _matrix(lg["_v"]), _matrix(rg["_rv"])
                ids = rg["_ri"].to_numpy()
                li = lg["_i"].to_numpy()
                held = []  # (left row, right row, distance) of a left chunk's best per piece
                for s, t, d in _distances(A, B):
                    d[li[s:s + _CHUNK, None] == ids[None, t:t + _WIDTH]] = np.inf
                    bound = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                    i, j = np.nonzero((d <= bound[:, None]) & np.isfinite(d))
                    best = _k_least(i, d[i, j], j, k)
                    held.append((i[best] + s, j[best] + t, d[i, j][best]))
                    if t + _WIDTH >= len(B):
                        i, j, dist = (np.concatenate(x) for x in zip(*held))
                        best = _k_least(i, dist, j, k)
                        rows.append(pd.DataFrame({"_i": li[i[best]], "nb_id": ids[j[best]], "dist": dist[best]}))
                        held = []
        return pd.concat(rows) if rows else pd.DataFrame({"_i": [], "nb_id": [], "dist": []}).astype(
            {"_i": "int64", "nb_id": "int64", "dist": "float64"})

    right = pts.select(F.col("_i").alias("_ri"), F.col("_c").alias("_rc"), F.col("_v").alias("_rv"))
    parts = block_grid(pts, right, "_i", "_ri", "_v", "_rv", cell, "_i long, nb_id long, dist double", block_rows=block_rows)
    w = Window.partitionBy("_i").orderBy("dist", "nb_id")
    return (parts.withColumn("nb_rank", F.row_number().over(w)).filter(F.col("nb_rank") <= k)
            .select(F.col("_i").alias(id_col), "nb_rank", "nb_id", "dist"))
