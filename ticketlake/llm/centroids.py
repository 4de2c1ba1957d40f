"""Centroid clustering of integer vectors by a bisector tournament.

Vectors and centroids are integers, so every step is exact and the outcome depends
neither on the order of rows nor on the number of tasks.  Centroid a is at least as near to x as b
(a < b) iff ``2 (b - a) . x <= |b|**2 - |a|**2``: a linear test whose normal and threshold are
computed once for every pair of centroids.  A vector's champion meets the k-1 later
centroids in turn; the sign of one test eliminates the loser, and zero favours the
champion, which has the smaller number.  Only the last champion's distance is computed.

A round is one scan of the vectors: tasks return sums per cluster, dimension and limb, a
number of rows that depends on k and the dimension alone, and Spark adds them up.
Integers are split into limbs of LIMB bits, so no sum overflows; where int64 can't hold a
test exactly, Python integers take its place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.session import materialize

LIMB = 30
LONG = 1 << 63
BATCH = 4096  # vectors worked on at once


def safe(dim: int) -> int:
    """Components below it keep tests, squares and their sums over ``dim`` dimensions in
    int64: 2 * 2x * x * dim < 2**63."""
    return 1 << (60 - dim.bit_length()) // 2


def quantise(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles, exactly; ``scale`` is a power of two."""
    whole = np.floor(values * scale)  # scaling by a power of two doesn't round
    if np.abs(whole).max(initial=0) < safe(values.shape[1]):
        return whole.astype(np.int64)
    if np.isfinite(whole).all():
        return np.array([[int(x) for x in row] for row in whole.tolist()], object).reshape(values.shape)
    return np.array([[int(x) * scale if abs(x) > 2.0 ** 60 else int(np.floor(x * scale)) for x in row] for row in values.tolist()],
                    object).reshape(values.shape)


class Bisectors:
    """Normals and thresholds of all pairs of centroids."""

    def __init__(self, centroids: list[list[int]]):
        wide = max((abs(v) for c in centroids for v in c), default=0) >= safe(len(centroids[0]))
        self.centroids = np.array(centroids, object if wide else np.int64).reshape(len(centroids), -1)
        c = self.centroids
        self.normal = 2 * (c[None, :, :] - c[:, None, :])  # [a, b]
        square = (c * c).sum(1)
        self.threshold = square[None, :] - square[:, None]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of every row."""
        c, normal, threshold = self.centroids, self.normal, self.threshold
        if x.dtype == object or c.dtype == object:
            x, c, normal, threshold = (v.astype(object) for v in (x, c, normal, threshold))
        champion = np.zeros(len(x), np.int64)
        for j in range(1, len(c)):
            side = (x * normal[champion, j]).sum(1) - threshold[champion, j]
            champion[(side > 0).astype(bool)] = j
        apart = x - c[champion]
        return champion, (apart * apart).sum(1)


def limbs(value: int) -> list[int]:
    """Base 2**LIMB digits, least first; all but the last are not negative."""
    out = []
    while not -(1 << 62) <= value < 1 << 62:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def _vectors(batches: Iterator[pa.RecordBatch], dim: int, scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, integer vectors) of the rows whose vector has ``dim`` finite components."""
    import pyarrow.compute as pc

    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dim), False))
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # null: NaN
            fine = np.isfinite(x).all(1)
            if fine.any():
                yield batch.column(0).filter(pa.array(fine)), quantise(x[fine], scale)


def _initial(dim: int, scale: int, k: int, seed: str):
    """The k first vectors of a task in the order of the seeded digest of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[str, list[int]]] = []
        for ids, x in _vectors(batches, dim, scale):
            keys = [None if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() for i in ids.to_pylist()]
            best += [(key, [str(v) for v in x[r]]) for r, key in enumerate(keys)
                     if key is not None and (len(best) < k or key <= best[-1][0])]
            best = sorted(best)[:k]
        yield pa.RecordBatch.from_pydict({
            "key": pa.array([b[0] for b in best], pa.string()), "v": pa.array([b[1] for b in best], pa.list_(pa.string()))})

    return run


def _sums(bisectors: Bisectors, dim: int, scale: int):
    """Per task and cluster: sums of the components, as (cluster, dim, limb, value, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(bisectors.centroids)
        total, count = np.zeros((k, dim), object), np.zeros(k, np.int64)
        for _, x in _vectors(batches, dim, scale):
            cluster, _ = bisectors.nearest(x)
            for c in np.unique(cluster).tolist():
                total[c] += x[cluster == c].sum(0).astype(object)
            count += np.bincount(cluster, minlength=k)
        rows = [(c, d, e, v, int(count[c]) if d == 0 and e == 0 else 0)
                for c in np.flatnonzero(count).tolist() for d in range(dim) for e, v in enumerate(limbs(int(total[c, d])))]
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))],
                                         names=["cluster", "d", "e", "value", "n"])

    return run


def _assigned(bisectors: Bisectors, dim: int, scale: int):
    """id, cluster, distance, and the distance's limbs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _vectors(batches, dim, scale):
            cluster, far = bisectors.nearest(x)
            far = far.tolist()
            yield pa.RecordBatch.from_pydict({
                "id": ids, "cluster": pa.array(cluster.astype(np.int32)),
                "distance": pa.array([v if v < LONG else None for v in far], pa.int64()),
                "limbs": pa.array([limbs(v) for v in far], pa.list_(pa.int64()))})

    return run


def _add_up(sums: DataFrame, *keys: str) -> DataFrame:
    return sums.groupBy(*keys).agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"), F.sum("n").alias("n"))


def _cluster_table(spark, rows, schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))  # one row per cluster


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, k: int = 16,
                    rounds: int = 3, scale: int = 64, seed: str = "1") -> DataFrame:
    """One row per kept vector: id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256.

    Kept are vectors of ``dim`` components, none null or non-finite; each becomes
    floor(scale * x).  The first centroids are the kept vectors with the smallest SHA-256 of
    ``seed:id``; equal ids are ordered by their vectors as text, a vector without id is clustered but
    never a first centroid.  With fewer than k vectors there are as many centroids (without
    any id none, and no rows).  Equal centroids are legal: the smaller number wins.  A
    distance or inertia that a long can't hold is null; it takes part in the sums all the
    same.  Repeated rows count each, other columns are ignored, an empty table gives an
    empty one."""
    spark = vectors.sparkSession
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    picked = plain.mapInArrow(_initial(dim, scale, k, seed), "key string, v array<string>")
    # at most k rows of a task, k in all
    firsts = picked.orderBy("key", "v").limit(k).collect()
    out = "id long, cluster int, distance long, limbs array<long>"
    if not firsts:
        none = plain.where("false").select(F.col("id").alias(id_col))
        return none.selectExpr(f"`{id_col}`", "cast(null as int) cluster", "cast(null as long) distance",
                               "cast(null as long) cluster_inertia", "cast(null as long) inertia", "cast(null as string) centroid_sha256")
    centroids = [[int(x) for x in r["v"]] for r in firsts]
    for _ in range(rounds):
        sums = _add_up(plain.mapInArrow(_sums(Bisectors(centroids), dim, scale), "cluster int, d int, e int, value long, n long"), "cluster", "d", "e")
        total, count = {}, {}
        for r in sums.collect():  # clusters x dimensions x limbs
            total[r["cluster"], r["d"]] = total.get((r["cluster"], r["d"]), 0) + (int(r["value"]) << (LIMB * r["e"]))
            if r["n"]:
                count[r["cluster"]] = r["n"]
        for c, n in count.items():
            centroids[c] = [total[c, d] // n for d in range(dim)]
    done = materialize(plain.mapInArrow(_assigned(Bisectors(centroids), dim, scale), out))
    parts = _add_up(done.select("cluster", F.posexplode("limbs").alias("e", "value")).withColumn("n", F.lit(0)), "cluster", "e")
    inertia = dict.fromkeys(range(len(centroids)), 0)
    for r in parts.collect():  # clusters x limbs
        inertia[r["cluster"]] += int(r["value"]) << (LIMB * r["e"])
    fit = lambda v: v if v < LONG else None
    per = _cluster_table(spark, [
        (c, fit(inertia[c]), fit(sum(inertia.values())), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest())
        for c, v in enumerate(centroids)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(per, "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
