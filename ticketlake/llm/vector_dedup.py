"""Embedding near-dedup: an exact metric range join.

Cosine >= t of unit vectors is Euclidean distance <= r = sqrt(2 - 2t).  Pivots are leaders
of a bounded sample, more than 2r apart, so that a tight cluster has one at most.  A
vector's home is its nearest pivot's cell, divided into rings of width r around the pivot.
By the triangle inequality a neighbour y at home in cell j keeps

    d(x, p_j) - r  <=  d(y, p_j)  <=  min(d(x, p_j), d(x, p_home)) + r,

so x visits only those rings of cell j, and no ring if the bounds cross.

In the order of cell and ring the vectors are cut into groups of one size, whatever rings
these hold.  A vector visits each later group that has a part of a ring it visits, once, so
each pair meets once, and a vector without near pivots is sent once a group, not once a
ring.  A group against a slice of its visitors is a unit of bounded size; its blocks are
taken with a single-precision matrix product whose borderline entries are recomputed in
double precision.  A unit returns partial link counts and spanning forests of its links,
never its pairs.  Units are taken in passes: what a pass shuffles is bounded by the table
itself and goes before the next one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.llm.graph import components
from ticketlake.llm.kernels import mix
from ticketlake.session import materialize

SAMPLE = 4096  # vectors the pivots are chosen from
HOME, VISITORS = 2048, 4096  # vectors of a unit that are compared at once
GROUPS = 16  # at least so many groups, unless they would have less than HOME vectors,
GROUP_BYTES = 8 << 20  # and more when a group would have more bytes
PASS = 1.5, 1 << 18  # rows of a pass: this multiple of all vectors, or so many
MAX_PIVOTS = 512
MARGIN = 1e-4  # single-precision entries this near the threshold are recomputed


def _matrix(col: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for what links with nothing."""
    out: list[np.ndarray | None] = []
    for v in col.to_pylist():
        if v is None or any(x is None for x in v):
            out.append(None)
            continue
        x = np.array(v, np.float64)
        top = np.abs(x).max(initial=0.0)
        if not top or not np.isfinite(top):
            out.append(None)
            continue
        x /= top  # so that squares neither overflow nor vanish
        out.append(x / np.sqrt(x @ x))
    return out


def choose_pivots(sample: list[np.ndarray], radius: float, wanted: int) -> dict[int, np.ndarray]:
    """Per dimension a matrix of at most ``wanted`` leaders more than 2 * radius apart."""
    out: dict[int, list[np.ndarray]] = {}
    for x in sample:
        own = out.setdefault(len(x), [])
        if len(own) < wanted and (not own or (2 - 2 * (np.array(own) @ x)).min() > 4 * radius * radius):
            own.append(x)
    return {d: np.array(v) for d, v in out.items()}


def _reach(x: np.ndarray, pivots: dict[int, np.ndarray]) -> np.ndarray:
    """Distances of unit vectors to the pivots of their length."""
    p = pivots.get(x.shape[1], np.zeros((1, x.shape[1])))  # a dimension the sample missed: one cell
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * (x @ p.T)))


def _stored(v: list[float]) -> bytes:
    """A vector as given, in single precision where that says the same."""
    x = np.array(v, np.float64)
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return (short if (short == x).all() else x).tobytes()


def _units(col: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of what ``_stored`` gave, the same as those of ``_matrix``."""
    x = np.empty((len(col), dim))
    size = pc.binary_length(col).to_numpy(zero_copy_only=False)
    for kind in (np.dtype(np.float32), np.dtype(np.float64)):
        pick = size == dim * kind.itemsize
        if pick.any():
            x[pick] = np.frombuffer(b"".join(col.filter(pa.array(pick)).to_pylist()), kind).reshape(-1, dim)
    x /= np.abs(x).max(1, initial=0.0)[:, None]
    return x / np.sqrt(np.array([v @ v for v in x]))[:, None]


def _assign(pivots: dict[int, np.ndarray], radius: float):
    """(id, name, embedding) -> id, name, vector, dim, home cell and ring; these are null for
    what links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, given = _matrix(batch.column(2)), batch.column(2).to_pylist()
            stored: list[bytes | None] = [None] * len(vectors)
            place = np.zeros((3, len(vectors)), np.int32)
            good = np.array([v is not None for v in vectors], bool)
            for dim in sorted({len(v) for v in vectors if v is not None}):
                own = [i for i, v in enumerate(vectors) if v is not None and len(v) == dim]
                dist = _reach(np.array([vectors[i] for i in own]), pivots)
                home = dist.argmin(1)
                place[0, own], place[1, own], place[2, own] = dim, home, np.floor(dist[np.arange(len(own)), home] / radius)
                for i in own:
                    stored[i] = _stored(given[i])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(stored, pa.binary()), *(pa.array(x, pa.int32(), mask=~good) for x in place)],
                names=["id", "name", "x", "dim", "cell", "ring"])

    return run


class _Layout:
    """The groups of the vectors of one length: ``rings`` holds (cell, ring, vectors)."""

    def __init__(self, dim: int, rings: list[tuple[int, int, int]], total: int):
        self.dim = dim
        self.cell, self.ring, self.n = np.array(sorted(rings), np.int64).T
        self.before = np.cumsum(self.n) - self.n
        self.size = max(HOME, min(GROUP_BYTES // (8 * dim), -(-total // GROUPS)))
        self.groups = -(-int(self.n.sum()) // self.size)
        self.step = int(self.ring.max()) + 1

    def group(self, ids: np.ndarray, cell: np.ndarray, ring: np.ndarray) -> np.ndarray:
        """The group of vectors; those of one ring are dealt over its part of the order."""
        at = np.searchsorted(self.cell * self.step + self.ring, cell.astype(np.int64) * self.step + ring)
        return (self.before[at] + (mix(ids.astype(np.uint64)) % self.n[at].astype(np.uint64)).astype(np.int64)) // self.size

    def visited(self, x: np.ndarray, cell: np.ndarray, own: np.ndarray, wanted: np.ndarray, pivots: dict[int, np.ndarray], radius: float) -> np.ndarray:
        """Per vector and group of ``wanted``: whether it visits the group."""
        slack = 1e-6
        dist = _reach(x, pivots)
        near = dist[np.arange(len(x)), cell]
        low = np.floor((dist - radius) / radius - slack)
        high = np.floor((np.minimum(dist, near[:, None]) + radius) / radius + slack)
        out = np.zeros((len(x), self.groups), bool)
        ask = np.zeros(self.groups + 1, np.int64)
        ask[1:] = np.cumsum(wanted)
        first, last = self.before // self.size, (self.before + self.n - 1) // self.size
        for r in np.flatnonzero(ask[last + 1] > ask[first]):
            j, k = self.cell[r], self.ring[r]
            out[(low[:, j] <= k) & (k <= high[:, j]) & (cell <= j), first[r]:last[r] + 1] = True
        return out & wanted & (np.arange(self.groups) > own[:, None])


def _parts(batch: pa.RecordBatch, layouts: dict[int, _Layout]):
    """(layout, rows, ids, unit vectors, cells, groups) of a batch's vectors of each length."""
    dims = batch.column(3).to_numpy(zero_copy_only=False)
    for dim, layout in layouts.items():
        rows = np.flatnonzero(dims == dim)
        if len(rows):
            part = batch.take(pa.array(rows))
            ids, cell, ring = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 4, 5))
            yield layout, part, ids, _units(part.column(2), dim), cell, layout.group(ids, cell, ring)


def _count(layouts: dict[int, _Layout], pivots: dict[int, np.ndarray], radius: float):
    """Vectors -> (dim, group, visitors) of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for layout, _, _, x, cell, own in _parts(batch, layouts):
                n = layout.visited(x, cell, own, np.ones(layout.groups, bool), pivots, radius).sum(0)
                g = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({
                    "dim": pa.array(np.full(len(g), layout.dim), pa.int32()), "g": pa.array(g, pa.int32()), "visitors": pa.array(n[g], pa.int64())})

    return run


def _send(layouts: dict[int, _Layout], pivots: dict[int, np.ndarray], radius: float, slices: dict[tuple[int, int], int], units: list[tuple[int, int, int]]):
    """Vectors -> the rows (dim, g, s, id, x, home, once) of a pass's units (dim, group, slice)."""
    chosen = {key: np.zeros(n, bool) for key, n in slices.items()}
    for dim, g, s in units:
        chosen[dim, g][s] = True
    chosen = {key: c for key, c in chosen.items() if c.any()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for layout, part, ids, x, cell, own in _parts(batch, layouts):
                here = [g for g in range(layout.groups) if (layout.dim, g) in chosen]
                wanted = np.isin(np.arange(layout.groups), here)
                if not len(here):
                    continue
                visited = layout.visited(x, cell, own, wanted, pivots, radius)
                dealt = mix(ids.astype(np.uint64), 1)
                for g in here:
                    c = chosen[layout.dim, g]
                    of = (dealt % np.uint64(len(c))).astype(np.int64)
                    come, at_home = np.flatnonzero(visited[:, g] & c[of]), np.flatnonzero(own == g)
                    s = np.flatnonzero(c)
                    rows = np.concatenate((come, np.repeat(at_home, len(s))))
                    s = np.concatenate((of[come], np.tile(s, len(at_home))))
                    home = np.arange(len(rows)) >= len(come)
                    if len(rows):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(rows), layout.dim), pa.int32()), pa.array(np.full(len(rows), g), pa.int32()), pa.array(s, pa.int32()),
                             part.column(0).take(pa.array(rows)), part.column(2).take(pa.array(rows)), pa.array(home), pa.array(home & (s == 0))],
                            names=["dim", "g", "s", "id", "x", "home", "once"])

    return run


def _links(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    dot = a.astype(np.float32) @ b.astype(np.float32).T
    link = dot >= threshold + MARGIN
    i, j = np.nonzero((dot >= threshold - MARGIN) & ~link)
    for at in range(0, len(i), 1 << 16):
        s = slice(at, at + (1 << 16))
        link[i[s], j[s]] = np.einsum("ij,ij->i", a[i[s]], b[j[s]]) >= threshold
    return link


def _forest(left: np.ndarray, right: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that link and, for each, the smallest row it reaches; ``left`` and ``right``
    are the rows of the matrix's sides."""
    rows, at = np.unique(np.concatenate((left, right)), return_inverse=True)
    i, j = at[:len(left)], at[len(left):]
    label, big = np.arange(len(rows)), len(rows)
    while True:
        new = label.copy()
        new[i] = np.minimum(new[i], np.where(link, new[j][None, :], big).min(1))
        new[j] = np.minimum(new[j], np.where(link, new[i][:, None], big).min(0))
        new = new[new]
        if (new == label).all():
            break
        label = new
    some = np.zeros(len(rows), bool)
    some[i[link.any(1)]] = True
    some[j[link.any(0)]] = True
    return rows[some], rows[label[some]]


def _join_unit(threshold: float):
    """A group of home vectors against a slice of visitors and, once, against itself, block by block."""

    def run(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        home = table["home"].to_numpy(zero_copy_only=False)
        x = _units(table["x"].combine_chunks(), table["dim"][0].as_py())
        h, v = np.flatnonzero(home), np.flatnonzero(~home)
        once = bool(table["once"].to_numpy(zero_copy_only=False)[h[0]]) if len(h) else False
        links = np.zeros(len(ids), np.int64)
        node, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(h), HOME):
            left = h[a:a + HOME]
            parts = [v[b:b + VISITORS] for b in range(0, len(v), VISITORS)]
            if once:
                parts += [h[b:b + HOME] for b in range(a, len(h), HOME)]
            for right in parts:
                link = _links(x[left], x[right], threshold)
                own = left[0] == right[0]
                if own:
                    np.fill_diagonal(link, False)
                if link.any():
                    links[left] += link.sum(1)
                    if not own:
                        links[right] += link.sum(0)
                    for whole, found in zip((node, to), _forest(left, right, link)):
                        whole.append(found)
        node, to = np.concatenate(node), np.concatenate(to)
        _, first = np.unique(node, return_index=True)
        count = np.zeros(len(node), np.int64)  # a vector's links are told once
        count[first] = links[node[first]]
        return pa.table({"node": pa.array(ids[node]), "links": pa.array(count), "to": pa.array(ids[to])})

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    ``n_links`` counts the other vectors with cosine >= threshold (0 < threshold < 1),
    ``component_id`` is the smallest id reachable over links, ``kept`` whether that is the
    vector's own.  Null, empty and zero vectors and those with a null, NaN or infinite
    component link with nothing, nor do vectors of different lengths.  Every row is a
    vector: rows that repeat an id are vectors of that name, which link like others.  A row
    without id links too, but names no component; one of only such rows is null.  Other
    columns, labels among them, are ignored."""
    spark = vectors.sparkSession
    radius = math.sqrt(2 - 2 * threshold)
    plain = vectors.select(F.col(id_col).cast("long").alias("name"), F.col(vector_col).cast("array<double>").alias("v"))
    numbered = plain.withColumn("id", F.monotonically_increasing_id())  # a row is a vector, whatever its name
    total = numbered.count()
    sample = numbered.where("size(v) > 0").orderBy(F.xxhash64("name", "id"), "id").limit(SAMPLE).select("v").toArrow()
    usable = [x for x in _matrix(sample["v"].combine_chunks()) if x is not None] if sample.num_rows else []
    pivots = choose_pivots(usable, radius, min(MAX_PIVOTS, max(1, math.ceil(total / HOME))))

    one = materialize(numbered.select("id", "name", "v").mapInArrow(
        _assign(pivots, radius), "id long, name long, x binary, dim int, cell int, ring int"))
    placed = one.where("x is not null")
    rings: dict[int, list] = {}  # at most MAX_PIVOTS cells of a few rings for each vector length
    for dim, *ring in placed.groupBy("dim", "cell", "ring").count().collect():
        rings.setdefault(dim, []).append(ring)
    layouts = {dim: _Layout(dim, own, total) for dim, own in rings.items()}
    visitors = {(r.dim, r.g): r.n for r in placed.mapInArrow(_count(layouts, pivots, radius), "dim int, g int, visitors long")
                .groupBy("dim", "g").agg(F.sum("visitors").alias("n")).collect()}
    slices = {(dim, g): max(1, math.ceil(visitors.get((dim, g), 0) / y.size)) for dim, y in layouts.items() for g in range(y.groups)}
    passes, rows, most = [[]], 0, max(int(PASS[0] * total), PASS[1])
    for (dim, g), n in slices.items():
        for s in range(n):
            size = layouts[dim].size + visitors.get((dim, g), 0) // n
            if passes[-1] and rows + size > most:
                passes.append([])
                rows = 0
            passes[-1].append((dim, g, s))
            rows += size
    found = None
    for units in passes:
        # units are work: an explicit number of partitions, which isn't coalesced
        part = materialize(
            placed.mapInArrow(_send(layouts, pivots, radius, slices, units), "dim int, g int, s int, id long, x binary, home boolean, once boolean")
            .repartition(max(1, 2 * len(units)), "dim", "g", "s").groupBy("dim", "g", "s")
            .applyInArrow(_join_unit(threshold), "node long, links long, to long"))
        found = part if found is None else found.unionByName(part)

    degree = found.groupBy(F.col("node").alias("id")).agg(F.sum("links").alias("links"))
    root = components(found, "node", "to").select(F.col("node").alias("id"), "root")
    linked = materialize(one.select("id", "name").join(degree, "id", "left").join(root, "id", "left"))
    least = linked.where("root is not null").groupBy("root").agg(F.min("name").alias("least"))
    return linked.join(least, "root", "left").select(
        F.col("name").alias(id_col), F.coalesce("links", F.lit(0)).alias("n_links"),
        F.when(F.col("root").isNull(), F.col("name")).otherwise(F.col("least")).alias("component_id")).withColumn(
        "kept", F.col(id_col).eqNullSafe(F.col("component_id")))
