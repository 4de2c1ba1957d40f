"""Streams over several micro-batches: messages sent again, answers on a stream of their
own, state that ends, sketches."""

import math
import os
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlake.operators import kpi
from ticketlake.operators import vectors as vx
from ticketlake.streaming import live

TURNS = "conv_id long, turn long, msg string"


def store(spark, path, keep=None, message_col="turn"):
    def merge(rows, batch_id):
        live.merge_turns(spark.createDataFrame(rows, TURNS), batch_id, path, message_col, keep)

    def table():
        return {r.session_id: (r.n_turns, r.first_turn, r.last_turn) for r in live.read_sessions(spark, path).collect()}

    return merge, table


def test_a_message_sent_again_counts_once(spark, tmp_path):
    merge, table = store(spark, str(tmp_path / "sessions"))
    merge([(1, 0, "a"), (1, 1, "b"), (1, 1, "b"), (2, 0, "c")], 0)
    assert table() == {1: (2, 0, 1), 2: (1, 0, 0)}
    merge([(1, 1, "b"), (1, 2, "d"), (2, 0, "c")], 1)  # two of three were there before
    assert table() == {1: (3, 0, 2), 2: (1, 0, 0)}
    merge([(1, 1, "b"), (1, 2, "d"), (2, 0, "c")], 1)  # the batch is replayed
    assert table() == {1: (3, 0, 2), 2: (1, 0, 0)}
    merge([(1, 0, "a"), (2, 0, "c")], 5)  # nothing new
    merge([(3, None, None), (None, 1, "x")], 6)
    merge([(3, None, None)], 7)  # without an id every message counts
    assert table() == {1: (3, 0, 2), 2: (1, 0, 0), 3: (2, None, None)}


def test_message_ids_of_their_own_and_their_expiry(spark, tmp_path):
    path = str(tmp_path / "sessions")
    merge, table = store(spark, path, keep=2, message_col="msg")
    merge([(1, 0, "a"), (1, 5, "a"), (1, 1, "b")], 0)
    assert table() == {1: (2, 0, 1)}  # one message under two turn numbers
    merge([(1, 2, "c")], 1)
    merge([(1, 0, "a")], 2)
    assert table() == {1: (3, 0, 2)}
    merge([(1, 3, "d")], 3)
    merge([(1, 0, "a")], 4)  # two batches further back than the ledger reaches
    assert table() == {1: (5, 0, 3)}
    assert {v for v, _ in live._versions(spark, live._ledger_dir(path))} == {2, 3, 4}


def test_live_sessions_over_repeated_files(spark, tmp_path):
    """The same turns in two files, a file a batch, and a job started again."""
    rows = [(c, t, f"{c}-{t}") for c in range(5) for t in range(c + 1)]
    for name, part in (("conversations0", rows), ("conversations1", rows[3:] + [(9, 0, "9-0")]), ("conversations2", rows)):
        spark.createDataFrame(part, "conv_id long, turn long, text string").coalesce(1).write.parquet(str(tmp_path / "in" / f"{name}.parquet"))
    source = spark.read.parquet(str(tmp_path / "in" / "conversations0.parquet")).schema
    path = str(tmp_path / "sessions")
    for _ in range(2):
        stream = spark.readStream.schema(source).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "conversations*.parquet"))
        stream.writeStream.foreachBatch(lambda b, i: live.merge_turns(b, i, path)).option("checkpointLocation", str(tmp_path / "ck")).trigger(
            availableNow=True).start().awaitTermination()
    got = {r.session_id: (r.n_turns, r.last_turn) for r in live.read_sessions(spark, path).collect()}
    assert got == {**{c: (c + 1, c) for c in range(5)}, 9: (1, 0)}


def stamped(spark, rows, schema, *times):
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({t: F.col(t).cast("timestamp_ntz") for t in times})


def stream_of(spark, folder, frames):
    for i, df in enumerate(frames):
        df.coalesce(1).write.parquet(os.path.join(folder, f"part{i:03d}.parquet"))
    schema = spark.read.parquet(os.path.join(folder, "part000.parquet")).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(folder, "part*.parquet"))


def test_answers_of_another_stream(spark, tmp_path):
    """Answered, answered late, never answered and still open questions; the rows equal the
    batch join of what has closed."""
    questions = [[(1, "2024-01-01 10:00:00", "a"), (2, "2024-01-01 10:00:10", "b")], [(3, "2024-01-01 11:00:00", "a")], [(4, "2024-01-01 18:00:00", "zz")]]
    answers = [[(1, "2024-01-01 10:00:05")], [(2, "2024-01-01 10:30:00"), (77, "2024-01-01 10:31:00")], [(5, "2024-01-01 18:00:01")]]
    q = stream_of(spark, str(tmp_path / "q"), [stamped(spark, r, "message_id long, user_time string, intent string", "user_time") for r in questions])
    a = stream_of(spark, str(tmp_path / "a"), [stamped(spark, r, "message_id long, bot_time string", "bot_time") for r in answers])
    kb = spark.createDataFrame([("a", "about a"), ("b", "about b")], "intent string, answer string")
    out = live._run_to_files(live.answered_questions(q, a, kb, wait="10 minutes", delay="1 hour"), spark, "test_answers")
    got = {r.message_id: (str(r.bot_time), r.answer, r.status) for r in out.collect()}
    assert got == {1: ("2024-01-01 10:00:05", "about a", "answered"), 2: ("None", None, "still looking"), 3: ("None", None, "still looking")}


def test_duplicate_state_ends(spark, tmp_path):
    """A key is dropped while the watermark hasn't passed it; then its state goes."""
    days = [[(d * 10 + k, f"2024-01-{d:02d} 10:00:00", k % 3) for k in range(6)] for d in range(1, 9)]
    frames = [stamped(spark, r, "event_id long, ts string, user_id long", "ts") for r in days]
    kept = live.dedup_within(stream_of(spark, str(tmp_path / "in"), frames), ["user_id"], delay="1 day")
    query = (kept.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    rows = spark.read.parquet(str(tmp_path / "out")).groupBy("user_id").count().collect()
    assert {r.user_id for r in rows} == {0, 1, 2} and all(1 < r["count"] < 8 for r in rows)  # again once the delay is over
    assert max(states) <= 3 and states[-1] <= 3  # three keys at any time, whatever the number of days


def test_user_sketches_merge(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, f"2024-01-{1 + k % 5:02d} 10:00:00", rng.randrange(6000)) for k in range(20000)]
    df = stamped(spark, rows, "event_id long, ts string, user_id long", "ts").withColumn("value", F.lit(1.0))
    s = live._run_to_files(live.kpi_sketch_stream(stream_of(spark, str(tmp_path / "in"), [df])), spark, "test_sketch")
    closed = {d for d in range(1, 5)}  # the fifth day is open
    exact = len({u for _, t, u in rows if int(t[8:10]) in closed})
    whole = live.user_range(s).first()
    assert s.count() == 4 and whole.total_responses == 16000 and abs(whole.unique_users - exact) < 0.05 * exact
    assert s.select(F.max(F.octet_length("users"))).first()[0] < 8192  # a state of fixed size


@pytest.mark.parametrize("law", ["normal", "ties", "heavy"])
def test_quantile_sketches_have_their_rank_error(spark, law):
    rng = np.random.default_rng(2)
    values = {"normal": rng.normal(size=30000), "ties": rng.integers(0, 5, 30000).astype(float), "heavy": rng.pareto(0.5, 30000)}[law]
    rows = [(int(k % 7), float(v)) for k, v in enumerate(values)] + [(0, None), (1, float("nan"))]
    df = spark.createDataFrame(rows, "day int, v double")
    sketches = kpi.quantile_sketches(df, "v", ["day"])
    q = kpi.sketched_quantiles(sketches, [], [0.1, 0.5, 0.9]).first()
    assert q.n == 30000
    for p, got in zip((0.1, 0.5, 0.9), (q.q0, q.q1, q.q2)):  # the rank asked for lies between the ranks of the value
        assert (values < got).mean() - 0.02 <= p <= (values <= got).mean() + 0.02


def test_sampled_silhouette_states_its_error(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(c), (rng.normal(size=3) + 2 * c).tolist()) for i, c in enumerate(rng.choice(4, 400, p=[0.6, 0.25, 0.1, 0.05]))]
    rows += [(1000, 9, [50.0, 0.0, 0.0]), (1001, 1, None)]
    df = spark.createDataFrame(rows, "id long, c long, v array<double>")
    exact = vx.silhouette(df, "id", "c", "v").first()
    inside, errors = 0, []
    for seed in range(6):
        r = vx.silhouette(df, "id", "c", "v", sample_size=80, seed=seed).first()
        assert (r.n_points, r.n_clusters) == (401, 5) and 80 <= r.n_scored < 100
        inside += abs(r.silhouette - exact.silhouette) <= 2 * r.standard_error
        errors.append(r.silhouette - exact.silhouette)
    assert inside >= 4 and abs(statistics.mean(errors)) < 0.05
    whole = vx.silhouette(df, "id", "c", "v", sample_size=10**6).first()
    assert whole.silhouette == pytest.approx(exact.silhouette) and whole.standard_error == 0 and whole.n_scored == 401


def test_event_table_is_appended_once_and_compacted(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = lambda b: [(b * 10 + k, f"d{k % 3}") for k in range(6)]
    append = lambda b: live.append_events(spark.createDataFrame(rows(b), "event_id long, day string").repartition(4), b, path)
    held = lambda: sorted((r.event_id, r.day) for r in live.read_events(spark, path).collect())
    files = lambda: len(list((tmp_path / "table").rglob("part-*.parquet")))
    assert live.read_events(spark, path) is None and not live.compact_events(spark, path)
    for b in (0, 1, 1, 2):  # batch 1 is replayed
        append(b)
    wanted = sorted(x for b in range(3) for x in rows(b))
    many = files()
    assert held() == wanted
    assert live.compact_events(spark, path) and held() == wanted and files() < many / 2
    append(2)  # replayed after the compaction
    append(3)
    append(4)
    wanted = sorted(x for b in range(5) for x in rows(b))
    assert held() == wanted
    assert live.compact_events(spark, path) and held() == wanted and len(live._segments(spark, path)) == 2
    assert live.compact_events(spark, path, all_segments=True) and held() == wanted and len(live._segments(spark, path)) == 1
    os.makedirs(tmp_path / "table" / "segments" / "segment=0000000000-0000000009")  # a write that was not committed
    assert held() == wanted


def test_vectors_are_shuffled_a_fixed_number_of_times(spark):
    """A table ten times as large has no more blocks until a block has BLOCK_BYTES."""
    small, large = (spark.range(n).select(F.array(F.lit(1.0), F.lit(2.0)).alias("v")) for n in (40_000, 400_000))
    assert vx._n_blocks(small, "v", None) == vx._n_blocks(large, "v", None) == vx._GRID
    wide = spark.range(40_000).select(F.array_repeat(F.lit(1.0), 2000).alias("v"))
    assert vx._n_blocks(wide, "v", None) == math.ceil(40_000 * 2000 * 8 / vx.BLOCK_BYTES)


def test_neighbours_over_several_pieces_of_a_cell(spark):
    """Copies and equal distances over the pieces of one cell: the smallest ids win."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(900, 3)), np.tile(rng.normal(size=(1, 3)), (400, 1))]).round(1)
    rows = [(i, i % 2, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, c long, v array<double>")
    got = {(r["id"], r["nb_rank"]): r["dist"] for r in vx.knn_same_class(df, "id", "c", "v", 4).collect()}
    assert len(got) == 4 * len(rows)
    for i in range(0, 1300, 37):
        same = [j for j in range(1300) if j % 2 == i % 2 and j != i]
        want = np.sort(np.linalg.norm(x[same] - x[i], axis=1))[:4]
        assert np.allclose([got[i, k] for k in (1, 2, 3, 4)], want, atol=1e-6)
    best = {r["qid"]: (r["best_id"], r["score"]) for r in vx.nearest(
        df.select(F.col("id").alias("qid"), F.col("v").alias("embedding")), df.select(F.col("id").alias("kid"), F.col("v").alias("embedding")), exclude_self=True).collect()}
    for i in (900, 901, 1299):
        assert best[i][0] == (901 if i == 900 else 900) and best[i][1] == pytest.approx(1.0)
