"""Conversation prefix trie over minimal-perfect-hash node tables.

A node is a distinct sequence of first turns.  Its key is a 128-bit digest: the sum of the
turns' hashes, each mixed with its position, so the digests of all prefixes of a
conversation are running sums.  Nothing walks the trie from the driver:

1. Turns are sorted by conversation and order into ranges that are written once.  A task
   streams a range; what runs over from the ranges before is the last conversation of
   each, two rows a range.  So a conversation with a third of all turns fills many ranges.
   This is done once for the turns' numbers, and once for the digests of the rebuilt
   conversations.
2. Each range is a shard.  It enumerates its distinct digests, builds a minimal perfect
   hash over them, and scatters counts into flat arrays by slot; every slot keeps its
   digest, by which a lookup is verified.  Shards' counts are added up per digest.  The
   smallest member of a node owns it; so each node is owned in one shard.
3. The shards' tables are built again, and now a node's own values (whether it has no
   children, its tokens) are scattered into its owner's shard and accumulated from slot
   to parent slot in order of falling depth.  Sums of shards are added up per digest; what
   reaches the top of a conversation that begins in an earlier range goes on there.

A node's members that differ in turns would need equal digests: the smallest and largest
of a further hash of the last turn and of the parent's digest are compared in every node,
and the job fails if they differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlake.llm.kernels import as_long, mix
from ticketlake.llm.spark import bounded_batches
from ticketlake.session import materialize

FAMILY, HEADS = 5, 9  # conversations share a base by conv_id - conv_id % FAMILY; a head has up to HEADS - 1 turns
SHARD_ROWS = 250_000  # rows of a range, about
ENDS_CHARS = 1 << 20  # characters of a piece of a node's list of members
GAMMA = 2.0  # bits per key that is still unplaced, at each level of the perfect hash


class PerfectHash:
    """A minimal perfect hash of distinct 128-bit keys, with a verified lookup.

    Level by level the unplaced keys are hashed into GAMMA bits each; a key alone on its
    bit is placed there.  A key's slot is the number of placed bits before its own.  The
    flat arrays ``hi`` and ``lo`` hold every slot's key."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        self.n, self.levels = len(hi), []
        left, base = np.arange(self.n), 0
        slot = np.zeros(self.n, np.int64)
        while len(left):
            size = max(int(GAMMA * len(left)), 2)
            at = self._place(hi[left], lo[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            rank = np.cumsum(alone) - 1 + base
            ok = alone[at]
            slot[left[ok]] = rank[at[ok]]
            self.levels.append((alone, rank))
            base += int(alone.sum())
            left = left[~ok]
        self.hi, self.lo = np.empty(self.n, np.uint64), np.empty(self.n, np.uint64)
        self.hi[slot], self.lo[slot] = hi, lo

    @staticmethod
    def _place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(hi ^ mix(lo, 2 * level + 1), 2 * level) % np.uint64(size)).astype(np.int64)

    def __call__(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Slots of the keys; -1 for a key that isn't in the table."""
        out = np.full(len(hi), -1, np.int64)
        left = np.arange(len(hi))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._place(hi[left], lo[left], level, len(alone))
            ok = alone[at]
            out[left[ok]] = rank[at[ok]]
            left = left[~ok]
        known = np.flatnonzero(out >= 0)
        wrong = known[(self.hi[out[known]] != hi[known]) | (self.lo[out[known]] != lo[known])]
        out[wrong] = -1
        return out


class Running:
    """What conversations carry into each range: (turns, digest lanes) before it, and for
    each range whether its last conversation goes on."""

    def __init__(self, edges: list):
        # edges: range, first conv, last conv, turns and lanes of the last conv in the range
        self.before: dict[int, tuple] = {}
        self.goes_on: dict[int, bool] = {}
        conv, carry, last = None, (0, 0, 0), None
        for e in sorted(edges, key=lambda e: e["shard"]):
            if last is not None:
                self.goes_on[last] = e["first"] == conv
            same = e["first"] == conv
            if same:
                self.before[e["shard"]] = carry
            alone = same and e["first"] == e["last"]
            own = (e["n"], e["a"], e["b"])
            carry = tuple((x + y) % (1 << 64) for x, y in zip(carry, own)) if alone else own
            conv, last = e["last"], e["shard"]


def _salted(h: np.ndarray, place: np.ndarray, salt: int) -> np.ndarray:
    return mix(h ^ mix(place.astype(np.uint64), salt), salt + 1)


def _rows(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All rows of a range: fixed-width columns of one shard, whose size Spark's ranges bound."""
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def _col(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy(zero_copy_only=False)


def _unsigned(table: pa.Table, name: str) -> np.ndarray:
    return np.ascontiguousarray(_col(table, name)).view(np.uint64)


def _starts(conv: np.ndarray) -> np.ndarray:
    return np.concatenate(([True], conv[1:] != conv[:-1]))


def _within(conv: np.ndarray) -> np.ndarray:
    """Place from 0 of every row among the rows of its conversation in the range."""
    at = np.arange(len(conv))
    return at - np.maximum.accumulate(np.where(_starts(conv), at, 0))


def _count_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last conversation of a range, and the rows of the last one in it."""
    table = _rows(batches)
    if table is not None:
        conv = _col(table, "conv")
        yield _edge(int(_col(table, "shard")[0]), conv, int(_within(conv)[-1]) + 1, 0, 0)


def _edge(shard: int, conv: np.ndarray, n: int, a: int, b: int) -> pa.RecordBatch:
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return pa.RecordBatch.from_pydict({
        "shard": pa.array([shard], pa.int32()), "first": pa.array([int(conv[0])], pa.int64()), "last": pa.array([int(conv[-1])], pa.int64()),
        "n": pa.array([n], pa.int64()), "a": pa.array([signed(a)], pa.int64()), "b": pa.array([signed(b)], pa.int64())})


_EDGE = "shard int, first long, last long, n long, a long, b long"


def _number(carried: Running):
    """Adds ``idx``, a row's place from 1 in its conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, seen, shard = None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(batch.schema.get_field_index("conv")).to_numpy()
            if shard is None:
                shard = int(batch.column(batch.schema.get_field_index("shard"))[0].as_py())
                conv, seen = own[0], carried.before.get(shard, (0,))[0]
            idx = _within(own) + 1
            head = own == own[0]  # rows of the first conversation come first
            if own[0] == conv:
                idx[: int(head.sum())] += seen
            conv, seen = own[-1], int(idx[-1])
            yield batch.append_column("idx", pa.array(idx, pa.int64()))

    return run


def _shards(df: DataFrame, *order: str | Column) -> DataFrame:
    """Sorted over the whole table and written once, with the range's number as ``shard``."""
    ranges = max(-(-df.count() // SHARD_ROWS), df.sparkSession.sparkContext.defaultParallelism)
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return materialize(dealt.withColumn("shard", F.spark_partition_id()))


def _lane_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Like :func:`_count_edges`, for rows whose lanes are salted by their depth."""
    table = _rows(batches)
    if table is not None:
        conv = _col(table, "conv")
        mine = conv == conv[-1]
        lanes = [_salted(_unsigned(table, h)[mine], _col(table, "depth")[mine], s) * (_col(table, "depth")[mine] > 0).astype(np.uint64)
                 for h, s in (("t1", 11), ("t2", 23))]
        yield _edge(int(_col(table, "shard")[0]), conv, int(mine.sum()), *(int(x.sum(dtype=np.uint64)) for x in lanes))


def _paths(table: pa.Table, carried: Running) -> dict[str, np.ndarray]:
    """Per row of a shard: digest lanes (a, b), the parent's (pa, pb), and whether it is its
    conversation's last row."""
    conv, depth = _col(table, "conv"), _col(table, "depth")
    shard, begin = int(_col(table, "shard")[0]), np.flatnonzero(_starts(conv))
    out = {"conv": conv, "depth": depth}
    before = carried.before.get(shard, (0, 0, 0))[1:]
    for lane, (h, salt) in enumerate((("t1", 11), ("t2", 23))):
        own = _salted(_unsigned(table, h), depth, salt) * (depth > 0).astype(np.uint64)
        total = np.cumsum(own, dtype=np.uint64)
        base = np.repeat(total[begin] - own[begin], np.diff(np.concatenate((begin, [len(conv)]))))
        total = total - base
        total[conv == conv[0]] += np.uint64(before[lane] % (1 << 64))
        out["ab"[lane]], out["p" + "ab"[lane]] = total, total - own
    last = np.concatenate((conv[1:] != conv[:-1], [True]))
    last[-1] = not carried.goes_on.get(shard, False)
    out["last"] = last
    return out


def _table_of(path: dict[str, np.ndarray]) -> tuple[PerfectHash, np.ndarray]:
    """(perfect hash of the shard's distinct digests, slot of every row)."""
    order = np.lexsort((path["b"], path["a"]))
    a, b = path["a"][order], path["b"][order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    nodes = PerfectHash(a[new], b[new])
    slot = nodes(path["a"], path["b"])
    if (slot < 0).any():
        raise AssertionError("a digest of the shard isn't in its table")
    return nodes, slot


def _counted(carried: Running):
    """Shard -> one row per distinct prefix in it: members, smallest member, ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _rows(batches)
        if table is None:
            return
        path = _paths(table, carried)
        nodes, slot = _table_of(path)
        members, ends = np.zeros(nodes.n, np.int64), np.zeros(nodes.n, np.int64)
        np.add.at(members, slot, 1)
        np.add.at(ends, slot, path["last"])
        one = np.zeros(nodes.n, np.int64)
        one[slot[::-1]] = np.arange(len(slot))[::-1]  # first row of the node: smallest conversation
        check = _unsigned(table, "check")
        least, most = np.full(nodes.n, ~np.uint64(0)), np.zeros(nodes.n, np.uint64)
        value = check ^ mix(path["pa"], 5) ^ mix(path["pb"], 7)
        np.minimum.at(least, slot, value)
        np.maximum.at(most, slot, value)
        if (least != most).any():
            raise ValueError("two different prefixes share a digest")
        yield pa.RecordBatch.from_pydict({
            "a": pa.array(as_long(nodes.hi)), "b": pa.array(as_long(nodes.lo)), "pa": pa.array(as_long(path["pa"][one])),
            "pb": pa.array(as_long(path["pb"][one])), "depth": pa.array(path["depth"][one]), "bytes": table["bytes"].combine_chunks().take(pa.array(one)),
            "check": pa.array(as_long(least)), "members": pa.array(members), "ends": pa.array(ends), "conv": pa.array(path["conv"][one]),
            "shard": pa.array(np.full(nodes.n, _col(table, "shard")[0], np.int32))})

    return run


def _enders(carried: Running):
    """Shard -> (a, b, conv) of the last row of every conversation that ends in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _rows(batches)
        if table is not None:
            path = _paths(table, carried)
            last = path["last"]
            yield pa.RecordBatch.from_pydict({"a": pa.array(as_long(path["a"][last])), "b": pa.array(as_long(path["b"][last])),
                                              "conv": pa.array(path["conv"][last])})

    return run


def _accumulate(carried: Running):
    """A shard's rows and the nodes owned in it -> (a, b, saved, leaves) of its slots, and
    one row (shard, saved, leaves) of what goes on in the range before."""

    def run(table: pa.Table) -> pa.Table:
        own = _col(table, "owned")
        nodes_owned, rows = table.filter(pa.array(own)), table.filter(pa.array(~own)).sort_by([("conv", "ascending"), ("depth", "ascending")])
        path = _paths(rows, carried)
        nodes, slot = _table_of(path)
        one = np.zeros(nodes.n, np.int64)
        one[slot] = np.arange(len(slot))
        depth = path["depth"][one]
        parent = nodes(path["pa"][one], path["pb"][one])
        parent[depth == 0] = -1
        saved, leaves = np.zeros(nodes.n, np.int64), np.zeros(nodes.n, np.int64)
        at = nodes(_unsigned(nodes_owned, "a"), _unsigned(nodes_owned, "b"))
        if (at < 0).any():
            raise AssertionError("a node isn't in its owner's shard")
        np.add.at(saved, at, _col(nodes_owned, "saved"))
        np.add.at(leaves, at, _col(nodes_owned, "leaf"))
        order = np.argsort(depth, kind="stable")
        cut = np.flatnonzero(np.diff(depth[order])) + 1
        up_saved = up_leaves = 0
        for level in np.split(order, cut)[::-1]:
            inner = level[parent[level] >= 0]
            np.add.at(saved, parent[inner], saved[inner])
            np.add.at(leaves, parent[inner], leaves[inner])
            top = level[(parent[level] < 0) & (depth[level] > 0)]
            up_saved, up_leaves = up_saved + int(saved[top].sum()), up_leaves + int(leaves[top].sum())
        some = np.flatnonzero((saved > 0) | (leaves > 0))
        up = [1] if up_saved or up_leaves else []
        return pa.table({
            "a": pa.array([*as_long(nodes.hi[some]).tolist(), *[None for _ in up]], pa.int64()),
            "b": pa.array([*as_long(nodes.lo[some]).tolist(), *[None for _ in up]], pa.int64()),
            "shard": pa.array([None] * len(some) + [int(_col(rows, "shard")[0]) for _ in up], pa.int32()),
            "saved": pa.array([*saved[some].tolist(), *[up_saved for _ in up]], pa.int64()),
            "leaves": pa.array([*leaves[some].tolist(), *[up_leaves for _ in up]], pa.int64())})

    return run


def _carries(edges: list, ups: list) -> list[tuple[int, int, int, int]]:
    """(shard, conversation, saved, leaves): what the end of a range takes over from the
    ranges after it, through ranges that hold one conversation only."""
    up = {r["shard"]: (r["saved"], r["leaves"]) for r in ups}
    out, saved, leaves = [], 0, 0
    edges = sorted(edges, key=lambda e: e["shard"])
    for e, before in zip(edges[::-1], [*edges[-2::-1], None]):
        alone = before is not None and e["first"] == e["last"] == before["last"]
        mine = up.get(e["shard"], (0, 0))
        saved, leaves = mine[0] + (saved if alone else 0), mine[1] + (leaves if alone else 0)
        if before is not None and (saved or leaves):
            out.append((before["shard"], before["last"], saved, leaves))
    return out


def _on_the_way(carried: Running, taken: dict[int, tuple[int, int, int]]):
    """Shard -> (a, b, saved, leaves) for the rows of the conversation that takes something
    over from the ranges after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _rows(batches)
        if table is None or int(_col(table, "shard")[0]) not in taken:
            return
        conv, saved, leaves = taken[int(_col(table, "shard")[0])]
        path = _paths(table, carried)
        mine = path["conv"] == conv
        n = int(mine.sum())
        yield pa.RecordBatch.from_pydict({
            "a": pa.array(as_long(path["a"][mine])), "b": pa.array(as_long(path["b"][mine])),
            "saved": pa.array(np.full(n, saved)), "leaves": pa.array(np.full(n, leaves))})

    return run


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, b, conv) -> pieces (a, b, first, ids) of comma-joined ids."""
    now, ids, size = None, [], 0

    def piece():
        return (*now, ids[0], ",".join(map(str, ids)))

    for batch in batches:
        done = []
        for a, b, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if now != (a, b) or size > ENDS_CHARS:
                if ids:
                    done.append(piece())
                now, ids, size = (a, b), [], 0
            ids.append(conv)
            size += len(str(conv)) + 1
        if done:
            yield _piece_rows(done)
    if ids:
        yield _piece_rows([piece()])


def _piece_rows(done: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=["a", "b", "first", "ids"])


def _digest_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (a, b, first) -> (a, b, sha): running digests, a piece at a time."""
    now, sha = None, None
    for batch in batches:
        done = []
        for a, b, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if now != (a, b):
                if now is not None:
                    done.append((*now, sha.hexdigest()))
                now, sha = (a, b), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["a", "b", "sha"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, sha.hexdigest())], names=["a", "b", "sha"])


def rebuilt(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, part, idx, t1, t2, check, bytes: the turns of every rebuilt conversation in the
    order of (part, idx), after one row of part -1 that stands for the root.

    The first h turns come from conversation ``conv - conv % 5`` (SQL remainder), h being the
    CRC-32 of the id's decimals modulo 9; then follow the own turns after the first h."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_col, role_col))
    plain = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit(7), role, text).alias("t2"), F.xxhash64(F.lit(13), text, role).alias("check"),
        F.octet_length(text).cast("long").alias("bytes"))
    sorted_turns = _shards(plain, "conv", F.col("turn").asc_nulls_first(), "t1", "t2")
    edges = sorted_turns.select("conv", "shard").mapInArrow(_count_edges, _EDGE).collect()  # a row per range
    numbered = sorted_turns.drop("turn").mapInArrow(_number(Running(edges)), "conv long, t1 long, t2 long, check long, bytes long, shard int, idx long")
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    base = F.col("conv") - F.col("conv") % FAMILY
    values = ["idx", "t1", "t2", "check", "bytes"]
    own = numbered.where((F.col("conv") == base) | (F.col("idx") > head)).select("conv", F.lit(1).alias("part"), *values)
    convs = sorted_turns.groupBy("conv").count().select("conv", base.alias("base"), head.alias("h"))
    heads = numbered.where((F.col("conv") == base) & (F.col("idx") < HEADS)).withColumnRenamed("conv", "base")  # at most 8 a base
    taken = convs.where("conv <> base and h > 0").join(heads, "base").where("idx <= h").select("conv", F.lit(0).alias("part"), *values)
    zero = F.lit(0).cast("long")
    root = convs.select("conv", F.lit(-1).alias("part"), *(zero.alias(v) for v in values))
    return own.unionByName(taken).unionByName(root)


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation's turns are ordered by turn, null first; turns of equal number by a hash of
    role and text, so repeated rows are repeated turns.  Null roles and texts are empty.  Rows
    without a conversation id belong to none.  A conversation whose rebuilt form has no
    turns is a member of the root only.  Other columns are ignored; an empty table has no
    nodes, not even a root."""
    bounded_batches(turns.sparkSession)
    spark = turns.sparkSession
    placed = _shards(rebuilt(turns, conv_col, turn_col, role_col, text_col), "conv", "part", "idx")
    count = Running(placed.select("conv", "shard").mapInArrow(_count_edges, _EDGE).collect())
    rows = "conv long, t1 long, t2 long, check long, bytes long, shard int, depth long"
    path = placed.select("conv", "t1", "t2", "check", "bytes", "shard").mapInArrow(_number(count), rows.replace("depth", "idx"))
    path = path.select("conv", "t1", "t2", "check", "bytes", "shard", (F.col("idx") - 1).alias("depth"))
    edges = path.mapInArrow(_lane_edges, _EDGE).collect()
    carried = Running(edges)

    counted = path.mapInArrow(_counted(carried), "a long, b long, pa long, pb long, depth long, bytes long, check long, members long, ends long, conv long, shard int")
    same = ["pa", "pb", "depth", "bytes", "check"]
    nodes = materialize(
        counted.groupBy("a", "b").agg(
            *(F.min(c).alias(c) for c in same), F.min(F.struct("conv", "shard")).alias("owner"), F.sum("members").alias("members"),
            F.sum("ends").alias("ends"), *(F.max(c).alias(f"max_{c}") for c in same))
        .withColumn("ok", F.when(F.expr(" and ".join(f"{c} = max_{c}" for c in same)), True).otherwise(
            F.raise_error(F.lit("two different prefixes share a digest")).cast("boolean")))
        .where("ok").select("a", "b", *same, "owner.conv", "owner.shard", "members", "ends"))

    own = nodes.select("shard", F.lit(True).alias("owned"), "conv", "depth", F.lit(None).cast("long").alias("t1"), F.lit(None).cast("long").alias("t2"),
                       "a", "b", ((F.col("members") - 1) * F.col("bytes")).alias("saved"), (F.col("members") == F.col("ends")).cast("long").alias("leaf"))
    no = F.lit(None).cast("long")
    way = path.select("shard", F.lit(False).alias("owned"), "conv", "depth", "t1", "t2", no.alias("a"), no.alias("b"), no.alias("saved"), no.alias("leaf"))
    summed = materialize(own.unionByName(way).groupBy("shard").applyInArrow(_accumulate(carried), "a long, b long, shard int, saved long, leaves long"))
    taken = {s: (c, v, n) for s, c, v, n in _carries(edges, summed.where("shard is not null").collect())}  # a row per range
    sums = summed.where("shard is null").select("a", "b", "saved", "leaves")
    if taken:
        sums = sums.unionByName(path.mapInArrow(_on_the_way(carried, taken), "a long, b long, saved long, leaves long"))

    ends = path.mapInArrow(_enders(carried), "a long, b long, conv long")
    pieces = ends.orderBy("a", "b", "conv").mapInArrow(_joined_ids, "a long, b long, first long, ids string")
    digests = pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first").select("a", "b", "ids").mapInArrow(_digest_ids, "a long, b long, sha string")

    def only(df: DataFrame, **given: str) -> DataFrame:
        types = {"conv": "long", "depth": "long", "pa": "long", "pb": "long", "members": "long", "saved": "long", "leaves": "long", "children": "long", "sha": "string"}
        return df.select("a", "b", *(F.expr(f"cast({given.get(c, 'null')} as {t})").alias(c) for c, t in types.items()))

    children = nodes.where("depth > 0").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
    parts = only(nodes, conv="conv", depth="depth", pa="pa", pb="pb", members="members").unionByName(
        only(sums, saved="saved", leaves="leaves")).unionByName(only(children, children="1")).unionByName(only(digests, sha="sha"))
    whole = materialize(parts.groupBy("a", "b").agg(
        *(F.max(c).alias(c) for c in ("conv", "depth", "pa", "pb", "members", "sha")),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("saved", "leaves", "children"))))

    # the parent's smallest member; the root's children, however many, know it already
    root = nodes.where("depth = 0").select("conv").first()
    above = whole.where("children > 0 and depth > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("parent"))
    top = whole.where("depth <= 1").withColumn("parent", F.when(F.col("depth") == 1, F.lit(root["conv"] if root else None)).cast("long"))
    return whole.where("depth > 1").join(above, ["pa", "pb"]).unionByName(top).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("members").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
