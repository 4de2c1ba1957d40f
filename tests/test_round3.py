"""Edge cases of nested updates, numbering, masked means, evaluation with an encoder and
answers on a stream."""

import random

import pytest
from pyspark.sql import functions as F

from ticketlake.operators import chat, ml, prep, vectors as vx
from ticketlake.streaming import live


def test_nested_updates(spark):
    sessions = spark.createDataFrame(
        [("a", [("x", 1), ("y", 2)]), ("b", []), ("c", None), ("d", [("z", 3)])],
        "session_id string, messages array<struct<content: string, n: int>>")
    updates = spark.createDataFrame(
        [("a", 1, "p"), ("a", 1, "q"), ("a", 0, "r"), ("a", 2, "far"), ("a", -1, "low"), ("a", None, "none"),
         ("b", 0, "empty"), ("c", 0, "null"), ("gone", 0, "who"), ("d", 0, None)],
        "session_id string, index long, value string")
    out, rejects = chat.update_nested_messages(sessions, updates, "content")
    got = {r.session_id: r.messages and [tuple(m) for m in r.messages] for r in out.collect()}
    assert got == {"a": [("r", 1), ("q", 2)], "b": [], "c": None, "d": [(None, 3)]}
    assert sorted((r.value, r.reject_reason) for r in rejects.collect()) == [
        ("empty", "message not found"), ("far", "message not found"), ("low", "message not found"),
        ("none", "message not found"), ("null", "message not found"), ("who", "session not found")]


@pytest.mark.parametrize("n", [0, 1, 7, 100])
def test_progress(spark, n):
    df = spark.createDataFrame([((i * 37) % 101,) for i in range(n)], "k long").repartition(5)
    got = sorted((r.k, r.idx, r.progress) for r in chat.numbered_with_progress(df, ["k"]).collect())
    assert got == [(k, i, int(i / n * 100)) for i, k in enumerate(sorted((i * 37) % 101 for i in range(n)), start=1)]


def test_masked_mean(spark):
    df = spark.createDataFrame(
        [("a", [1.0, 2.0], 1.0), ("a", [3.0, 6.0], 3.0), ("a", [9.0, 9.0], None), ("b", [5.0, 5.0], 0.0), ("c", None, 1.0),
         (None, [4.0, 8.0], 2.0)], "g string, v array<double>, w double")
    got = {(r.g, r.pos): r["mean"] for r in vx.mean_vector(df, "g", "v", mask="w").collect()}
    assert got == {("a", 0): 2.5, ("a", 1): 5.0, ("b", 0): 0.0, ("b", 1): 0.0, (None, 0): 4.0, (None, 1): 8.0}
    plain = {(r.g, r.pos): r["mean"] for r in vx.mean_vector(df, "g", "v").collect()}
    assert plain[("b", 0)] == 5.0 and plain[("a", 1)] == pytest.approx(17 / 3)


def test_numeric_means_leave_other_columns_out(spark):
    df = spark.createDataFrame([("x", 1, True, "9"), ("x", 2, False, "9"), ("y", None, None, "9")], "g string, n int, f boolean, s string")
    out = prep.numeric_means(df, "g")
    assert out.columns == ["g", "mean_n", "mean_f"]
    assert {r.g: (r.mean_n, r.mean_f) for r in out.collect()} == {"x": (1.5, 0.5), "y": (None, None)}


def test_evaluation_drops_unknown_labels_and_takes_a_classifier(spark):
    words = {"up": "good fine nice", "down": "bad poor sad"}
    rows = [(i, words[("up", "down")[i % 2]], ("up ", "down")[i % 2]) for i in range(40)]
    rows += [(100, "good", "\tUnknown "), (101, "bad", ""), (102, "bad", None)]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    encoder = ml.hashing_encoder(dim=64).fit(df)
    for estimator in (None, lambda n: ml.linear_ovr()):
        r = ml.evaluate_classification(df, "id", "label", encoder=encoder.transform, estimator=estimator).first()
        assert r.accuracy == r.f1_score == r.macro_f1 == 1.0
        assert r.embedding_train_time_sec > 0 and r.embedding_test_time_sec > 0


def test_answers_go_on_after_a_restart(spark, tmp_path):
    source, base = tmp_path / "in", str(tmp_path / "base")

    def arrive(ids):
        spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.mode("append").parquet(str(source))

    def run():
        stream = spark.readStream.schema("id long").parquet(str(source))
        return live.live_answers(spark, stream, lambda df: df.select("id", (F.col("id") * 2).alias("twice")), base)

    arrive([1, 2])
    assert sorted(tuple(r) for r in run().collect()) == [(1, 2), (2, 4)]
    arrive([3])
    assert sorted(tuple(r) for r in run().collect()) == [(1, 2), (2, 4), (3, 6)]
    assert run().count() == 3


def test_one_user_over_many_ranges(spark):
    """Numbering and consecutive repeats of a user that fills several sorted ranges, with
    null users, null times and null texts."""
    rng = random.Random(5)
    rows = [(k, rng.choice([1, 1, 1, 1, 2, None]), rng.choice([None, *range(300)]), rng.choice(["a", "b", None])) for k in range(2000)]
    df = spark.createDataFrame(rows, "k int, u int, t int, x string")
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        assert chat.sorted_ranges(df, "u", "t", "k").filter("u = 1").select("_range").distinct().count() > 2
        numbered = {r.k: r.idx for r in chat.numbered_newest_first(df, "u", "t", "k").collect()}
        left = {r.k for r in live.drop_consecutive_repeats(df, "u", "x", ["t", "k"]).collect()}
    finally:
        spark.conf.set(conf, before)
    for u in (1, 2, None):
        own = [r for r in rows if r[1] == u]
        newest = sorted(own, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        assert [numbered[r[0]] for r in newest] == list(range(1, len(own) + 1))
        oldest = sorted(own, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        wanted = {b[0] for a, b in zip([(None,) * 4, *oldest], oldest) if a[3] is None or (b[3] is not None and a[3] != b[3])}
        assert left & {r[0] for r in own} == wanted
