"""What steps leave on disk, and the packed rows that keep it small."""

import glob
import os
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ticketlake.llm import line_dedup, vector_dedup
from ticketlake.session import CLEANUP, materialize, release


def shuffled(spark):
    """The shuffle files that the session has on disk."""
    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for d in root.localDirs() for f in glob.glob(f"{d.getPath()}/*/shuffle_*.data")}


def test_a_written_result_leaves_no_shuffle(spark):
    before = shuffled(spark)
    rows = spark.range(20_000).repartition(7, "id").withColumn("k", F.col("id") % 3)
    out = materialize(rows)
    assert not shuffled(spark) - before
    assert spark.conf.get(CLEANUP, "false") == "false"
    assert out.count() == rows.count() == 20_000  # the plan itself can run again
    where = out._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(where)
    release(out)
    assert not os.path.exists(where)


def test_anchors_come_back_as_they_were_dealt():
    rng = np.random.default_rng(3)
    key = rng.integers(0, 1 << 59, 5000, dtype=np.uint64)
    key[1000:3000] = key[:2000]  # several of one key
    size = rng.integers(150, 1 << 18, 5000)
    size[::3] %= 1 << 16
    at = size << 32 | rng.integers(0, 1 << 18, 5000) % (size + 1)
    line = rng.integers(-(1 << 63), 1 << 63, 5000)
    batch = line_dedup._dealt(key, at, line)
    assert batch.num_rows <= 2 << line_dedup.BUCKET_BITS
    back = line_dedup._gathered(batch)
    assert sorted(zip(*(x.tolist() for x in back))) == sorted(zip(key.astype(np.int64).tolist(), at.tolist(), line.tolist()))


def test_a_bucket_of_many_rows_is_passed_on_in_parts():
    """Keys with many lines over several batches: the same memberships and pairs as at once."""
    rng = np.random.default_rng(4)
    n = 4000
    key = np.concatenate((np.full(n, 5), np.full(n, 5 << 48 | 9), rng.integers(0, 1 << 59, n))).astype(np.uint64)
    key[:2 * n] |= np.uint64(7 << 48)
    key[-200:-100] = key[-100:]  # pairs
    at = np.full(3 * n, 300 << 32 | 17)
    line = np.arange(3 * n) * 11
    order = np.argsort(key >> np.uint64(48), kind="stable")
    parts = [line_dedup._dealt(*(x[order[i:i + 500]] for x in (key, at, line))) for i in range(0, 3 * n, 500)]

    def found(held):
        out = pa.Table.from_batches(line_dedup._match_anchors(2, 64, 1000, held)(iter(parts))).to_pylist()
        return {(r["a"], r["key"]) for r in out if r["b"] is None}, {(r["a"], r["b"]) for r in out if r["b"] is not None}

    members, pairs = found(600)
    assert (members, pairs) == found(1 << 20)
    assert len(members) == 2 * n and len(pairs) >= 100


def test_vectors_without_structure_leave_little_on_disk(spark, monkeypatch):
    """Nearly all of these visit nearly all others; no pass holds more than the table's bounds."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(1500, 32)))], "vec_id long, embedding array<double>")
    monkeypatch.setattr(vector_dedup, "HOME", 64)
    monkeypatch.setattr(vector_dedup, "PASS", (2, 1))
    sent = []

    def sending(*args):
        sent.append(args[4])
        return vector_dedup_send(*args)

    vector_dedup_send = vector_dedup._send
    monkeypatch.setattr(vector_dedup, "_send", sending)
    before = shuffled(spark)
    out = vector_dedup.near_vectors(df)
    assert sum(map(os.path.getsize, shuffled(spark) - before)) < 1500 * 32 * 8 / 4  # counts by ring and group
    assert out.where("n_links = 0 and kept").count() == 1500
    assert len(sent) > 4 and len({u for units in sent for u in units}) == sum(map(len, sent))


def test_each_near_pair_meets_in_one_unit():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 8))
    x[200:] = x[:200] + rng.normal(size=(200, 8)) * 0.1
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    radius = np.sqrt(2 - 2 * 0.9)
    pivots = vector_dedup.choose_pivots(list(unit[:100]), radius, 9)
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(range(400)), pa.array(x.tolist())], names=["id", "name", "v"])
    placed = next(vector_dedup._assign(pivots, radius)(iter([batch])))
    rings = Counter(zip(placed["cell"].to_pylist(), placed["ring"].to_pylist()))
    layout = vector_dedup._Layout(8, [(*k, n) for k, n in rings.items()], 400)
    layout.size, layout.groups = 37, -(-400 // 37)
    count = pa.Table.from_batches(vector_dedup._count({8: layout}, pivots, radius)(iter([placed])))
    visitors = dict(zip(count["g"].to_pylist(), count["visitors"].to_pylist()))
    slices = {(8, g): 1 + visitors.get(g, 0) // 50 for g in range(layout.groups)}
    units = [(*key, s) for key, n in slices.items() for s in range(n)]
    met = Counter()
    for part in (units[::2], units[1::2]):
        rows = pa.Table.from_batches(vector_dedup._send({8: layout}, pivots, radius, slices, part)(iter([placed]))).to_pylist()
        for u in part:
            own = [r for r in rows if (r["dim"], r["g"], r["s"]) == u]
            home = [r["id"] for r in own if r["home"]]
            met.update(frozenset((a, r["id"])) for r in own if not r["home"] for a in home)
            if any(r["once"] for r in own):
                met.update(frozenset((a, b)) for a in home for b in home if a < b)
    near = {frozenset((i, j)) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.9)) if i < j}
    assert len(near) >= 150 and near <= set(met) and max(met.values()) == 1
