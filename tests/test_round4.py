"""Findings of the third review: what is shuffled, written and read by one task."""

import json
import random
import re

from pyspark.sql import functions as F

from ticketlake.operators import kpi
from ticketlake.operators import retrieval as rt
from ticketlake.operators import text as tx
from ticketlake.plans.q_io import _json_array


def test_terms_are_shuffled_as_texts_only(spark):
    rows = [(1, "one two two"), (1, "two three"), (2, None), (3, "one"), (None, "one one")]
    df = spark.createDataFrame(rows, "id long, text string")
    terms = tx.doc_terms(df, "id", "text")
    got = {(r["id"], r["term"]): r["tf"] for r in terms.collect()}
    assert got == {(1, "one"): 1, (1, "two"): 3, (1, "three"): 1, (3, "one"): 1, (None, "one"): 2}
    plan = terms.groupBy("id").agg(F.sum("tf"))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1


def test_every_task_writes_an_array(spark, tmp_path):
    path = str(tmp_path / "arrays")
    df = spark.range(40, numPartitions=4).where("id >= 10").select(F.to_json(F.struct(F.col("id").alias("doc_id"))).alias("value"))
    df.mapInArrow(_json_array, "value string").write.text(path)
    arrays = [json.loads(p.read_text()) for p in (tmp_path / "arrays").glob("part-*") if p.read_text()]
    assert len(arrays) == 3
    assert sorted(o["doc_id"] for a in arrays for o in a[1:]) == list(range(10, 40))


def test_first_rows_are_cut_down_before_texts_meet(spark):
    rows = [(None, "a"), (5, "b"), (1, "c"), (3, "d"), (3, "e"), (4, "f"), (None, "g")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    assert sorted(r["text"] for r in kpi.up_to_nth(df, "id", 4).collect()) == ["a", "c", "d", "e", "g"]
    assert sorted(r["text"] for r in kpi.up_to_nth(df, "id", 2).collect()) == ["a", "g"]
    assert kpi.up_to_nth(df, "id", 100).count() == 7
    assert kpi.up_to_nth(df.limit(0), "id", 3).count() == 0


def test_anchors_of_common_words_meet_few_rows(spark):
    """A hundred rows have the words, one has them in a row; every row was verified before."""
    rows = [(i, f"the {'abc'[i % 3]}x of y{i} the and so") for i in range(100)] + [(100, "so the cat of thee and")]
    kb = spark.createDataFrame(rows, "seq long, t string")
    placed = rt._placed_words(kb, "seq", ["t"])
    anchors = spark.createDataFrame([("he cat of th", "cat", "he", "of"), ("cat of th", "of", "cat", "th"), ("o the", "the", "o", "")],
                                    "needle string, token string, before string, after string")
    got = {(r["needle"], r["seq"]) for r in rt._holding(placed, "seq", anchors).collect()}
    assert got == {("he cat of th", 100), ("cat of th", 100), ("o the", 100)}


def test_containing_equals_brute_force(spark):
    rnd = random.Random(7)
    words = ["a", "of", "the", "thé", "cat", "catalog", "of.", "\U0001f600x", "hethe", "tt"]
    blanks = [" ", "  ", "\n", "\t "]
    texts = ["".join(rnd.choice(words) + rnd.choice(blanks) for _ in range(rnd.randrange(1, 12))) for _ in range(120)]
    titles = [" ".join(rnd.choice(words) for _ in range(3)) for _ in texts]
    cut = [rnd.choice(texts + titles) for _ in range(250)]
    asked = [t[(a := rnd.randrange(len(t))):a + rnd.randrange(1, 25)] for t in cut] + [" the of", "zz zz", "of the zz", " ", "he of a", "\nof "]
    kb = spark.createDataFrame(list(enumerate(zip(titles, texts))), "seq long, f struct<u: string, v: string>").select("seq", "f.*")
    q = spark.createDataFrame(list(enumerate(asked)), "qid long, t string")
    blank = " \t\n\x0b\x0c\r"
    for strip in (True, False):
        got = {r["qid"]: r["seq"] for r in rt.first_containing(q, "qid", "t", kb, "seq", ["u", "v"], min_len=2, strip_needle=strip).collect()}
        want = {}
        for i, t in enumerate(asked):
            needle = t.strip(blank) if strip else t
            hits = [k for k in range(len(texts)) if needle in titles[k] or needle in texts[k]]
            if len(t.strip(blank)) >= 2 and hits:
                want[i] = hits[0]
        assert got == want
