"""Operator tests on inline fixtures: the semantic traps of SURVEY §1.4 and brute-force
oracles for the joins that have no SQL form."""

import difflib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlake.functions.scalar import rating_to_sentiment, session_id, export_time
from ticketlake.functions.similarity import ratio_above
from ticketlake.operators import chat, evaluation as ev, kpi, prep, retrieval as rt, vectors as vx


# ---------------------------------------------------------------------------- scalars

def test_rating_to_sentiment_traps(spark):
    """T1 (NaN -> neutral, not positive), T3 (bad text -> null, no exception)."""
    rows = [("1",), ("2",), ("2.5",), ("4",), ("5",), (None,), ("NaN",), ("abc",), (" 3 ",)]
    df = spark.createDataFrame(rows, "r string")
    got = [r[0] for r in df.select(rating_to_sentiment("r")).collect()]
    assert got == ["negative", "negative", "neutral", "positive", "positive", "neutral", "neutral", None,
                   "neutral"]


def test_session_id_format(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05", "k")], "t string, k string")
    sid = df.select(session_id(F.col("t").cast("timestamp_ntz"), "k")).first()[0]
    assert sid.startswith("20240102030405-") and len(sid) == 23


def test_export_time_unknown(spark):
    df = spark.createDataFrame([(None,)], "t timestamp_ntz")
    assert df.select(export_time("t")).first()[0] == "unknown"


# ---------------------------------------------------------------------------- prep

def test_detect_schema_two_way_partial():
    """T23: 'Ticket' matches 'ticket description' partially; exact synonyms win first."""
    m = prep.detect_schema(["Ticket", "ticket  priority", "CSAT score"])
    assert m["description"] == "Ticket"
    assert m["priority"] == "ticket  priority"
    assert m["satisfaction"] == "CSAT score"
    assert prep.detect_schema([""])["description"] == ""  # empty name matches everything


def test_label_filter(spark):
    """T22: '', ' ', 'unknown', 'UNKNOWN ' dropped; 'High' kept."""
    df = spark.createDataFrame([("",), (" ",), ("unknown",), ("UNKNOWN ",), ("High",), (None,)], "l string")
    assert [r[0] for r in prep.label_filter(df, "l").collect()] == ["High"]


def test_from_raw_and_hygiene(spark):
    """P3 + P5 + W3: 9-char text dropped, 10-char kept, first duplicate kept, null text
    dropped, Critical -> High."""
    rows = [(1, "short txt", "Critical", 5.0), (2, "long enough", "Critical", 1.0),
            (3, "long enough", "Low", 3.0), (4, None, "Low", 3.0)]
    df = spark.createDataFrame(rows, "`Ticket ID` int, `Ticket Description` string, "
                                     "`Ticket Priority` string, `Customer Satisfaction Rating` double")
    t = prep.normalise_labels(prep.from_raw(df))
    out = prep.basic_hygiene(t, "description", 10, True, order=["ticket_id"]).collect()
    assert [(r.ticket_id, r.priority, r.sentiment) for r in out] == [(2, "High", "negative")]


def test_union_ragged_coercion(spark):
    a = spark.createDataFrame([("1", "x")], "id string, only_a string")
    b = spark.createDataFrame([("oops", "2024-01-01 00:00:00", "bad-ts")], "score string, timestamp string, t2 string")
    u = prep.union_ragged([a, b], numeric_cols=["score"], time_cols=["timestamp", "t2"])
    rows = {tuple(r) for r in u.select("id", "only_a", "score", "t2").collect()}
    assert rows == {("1", "x", None, None), (None, None, None, None)}


# ---------------------------------------------------------------------------- KPIs

def test_kpi_null_semantics(spark):
    """T4 (null tag counted), T6 (null flag = 0), T7 (null user counts once)."""
    rows = [(None, None, True, None, None, 1.0, None), ("a", "x", None, True, None, 3.0, None),
            ("a", "y", False, False, True, None, "boom")]
    df = spark.createDataFrame(rows, "user_id string, intent_tag string, thumbs_up boolean, thumbs_down boolean, "
                                     "is_fallback boolean, response_time double, error_type string")
    r = kpi.conversation_kpis(df).first()
    assert r.total_responses == 3 and r.unique_users == 2
    assert r.thumbs_up == 1 and r.thumbs_down == 1 and r.fallback_count == 1 and r.error_count == 1
    assert r.satisfaction == 0.0 and math.isclose(r.avg_response_time, 2.0)
    assert kpi.conversation_kpis(df, count_null_tag=False).first().total_responses == 2


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(x),) for x in range(11)], "v double")
    h = {r.bin: r.n for r in kpi.histogram(df, "v", 5).collect()}
    assert h == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}


# ---------------------------------------------------------------------------- conversations

def test_session_topic_tie_first_met(spark):
    """Two tags tied -> the tag met first; no tags -> first three words."""
    rows = [(1, 0, "b", "q"), (1, 1, "a", "q"), (1, 2, "a", "q"), (1, 3, "b", "q"),
            (2, 0, None, "  Hello   big  World again"), (2, 1, "", "x")]
    df = spark.createDataFrame(rows, "session_id int, msg_pos int, intent_tag string, question string")
    got = {r.session_id: r.topic for r in chat.session_topic(df).collect()}
    assert got == {1: "b", 2: "hello, big, world"}


def test_apply_changes_update_then_delete(spark):
    t = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "k int, v double")
    ch = spark.createDataFrame([(1, 1, "update", 11.0), (1, 2, "delete", None), (2, 1, "update", 21.0),
                                (9, 1, "update", 99.0)], "k int, seq int, op string, v double")
    got = sorted(tuple(r) for r in chat.apply_changes(t, ch, "k", "seq", ["v"]).collect())
    assert got == [(2, 21.0), (3, 30.0)]


# ---------------------------------------------------------------------------- retrieval

def _brute_first_contains(qs, kb, min_len=2, strip=True):
    out = {}
    for qid, text in qs:
        s = text.strip(" \t\n\x0b\x0c\r")
        if len(s) < min_len:
            continue
        needle = (s if strip else text).lower()
        hits = [seq for seq, t in kb if needle in t.lower()]
        if hits:
            out[qid] = min(hits)
    return out


def test_substring_join_lossless(spark):
    """§4.2.1: the token / gram pre-join loses no match (random texts, short and long
    needles, regex characters, case)."""
    rnd = random.Random(7)
    words = ["ab", "abc", "b", "cab", "x.y", "a*b", "Zq", "qq", "abca", "c"]
    kb = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 12)))) for i in range(300)]
    qs = []
    for i in range(200):
        seq, t = rnd.choice(kb)
        a = rnd.randint(0, max(0, len(t) - 1))
        b = rnd.randint(a, len(t))
        qs.append((i, t[a:b].upper() if i % 3 == 0 else t[a:b]))
    qs += [(1000, "a"), (1001, "  ab  "), (1002, "nothing here at all")]
    qdf = spark.createDataFrame(qs, "qid int, text string")
    kdf = spark.createDataFrame(kb, "seq int, question string")
    got = {r.qid: r.seq for r in rt.first_containing(qdf, "qid", "text", kdf, "seq", ["question"]).collect()}
    assert got == _brute_first_contains(qs, kb)


def test_similarity_join_equals_difflib(spark):
    """§4.2.2 / T10: bucketed join + bounds + UDF equals brute-force difflib, strict >,
    KB text first; includes 200+ character strings (autojunk) and empties."""
    rnd = random.Random(3)
    alpha = "abcde "
    kb = [(i, "".join(rnd.choice(alpha) for _ in range(rnd.choice([0, 3, 8, 20, 40, 220])))) for i in range(120)]
    qs = [(i, (t[:-1] + "x") if i % 2 else t) for i, (_, t) in enumerate(rnd.sample(kb, 40))]
    qs.append((999, ""))
    t = 0.75
    qdf = spark.createDataFrame(qs, "qid int, text string")
    kdf = spark.createDataFrame(kb, "seq int, question string")
    got = {r.qid: r.seq for r in rt.first_similar(qdf, "qid", "text", kdf, ["seq"], "question", t).collect()}
    want = {}
    for qid, q in qs:
        b = q.strip(" \t\n\x0b\x0c\r").lower()
        hits = [seq for seq, a in kb if difflib.SequenceMatcher(None, a.lower(), b).ratio() > t]
        if hits:
            want[qid] = min(hits)
    assert got == want


def test_ratio_bound_exact():
    for a, b in [("abc", "abd"), ("", ""), ("a" * 250, "a" * 249 + "b"), ("xyz", "")]:
        r = difflib.SequenceMatcher(None, a, b).ratio()
        assert (ratio_above(a, b, 0.8) > 0.8) == (r > 0.8)


def test_intent_stage_first_pattern_and_response(spark):
    """First passing pattern in (intent, pattern) order; an intent with no
    responses gives no answer."""
    pats = spark.createDataFrame([(0, "greet", 0, "hello there"), (0, "greet", 1, "hello ther"),
                                  (1, "bye", 0, "hello there"), (2, "empty", 0, "good night")],
                                 "intent_pos int, tag string, pattern_pos int, pattern string")
    resp = spark.createDataFrame([(0, 0, "hi!"), (0, 1, "hey!"), (1, 0, "ciao")],
                                 "intent_pos int, resp_pos int, response string")
    q = spark.createDataFrame([("q1", "Hello there "), ("q2", "good night"), ("q3", "zzz")], "qid string, text string")
    got = {r.qid: (r.tag, r.answer) for r in rt.intent_stage(q, "qid", "text", pats, resp).collect()}
    assert got["q1"][0] == "greet" and got["q1"][1] in {"hi!", "hey!"}
    assert got["q2"] == ("empty", None) and "q3" not in got


# ---------------------------------------------------------------------------- vectors

def test_nearest_ties_and_empty(spark):
    """Equal best scores -> lowest id; no KB -> -1."""
    kb = spark.createDataFrame([(5, [1.0, 0.0]), (3, [2.0, 0.0]), (7, [0.0, 1.0])], "kid long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 3.0])], "qid long, embedding array<double>")
    got = {r.qid: (r.best_id, round(r.score, 6)) for r in vx.nearest(q, kb).collect()}
    assert got == {1: (3, 1.0), 2: (7, 1.0)}
    empty = kb.filter("kid < 0")
    assert {r.qid: r.score for r in vx.nearest(q, empty).collect()} == {1: -1.0, 2: -1.0}


def _sil_brute(X, lab):
    n = len(X)
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    s = []
    for i in range(n):
        own = lab == lab[i]
        if own.sum() <= 1:
            s.append(0.0)
            continue
        a = D[i, own].sum() / (own.sum() - 1)
        b = min(D[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(s))


def test_silhouette_brute_force_with_singleton(spark):
    rnd = np.random.default_rng(1)
    X = rnd.normal(size=(60, 4))
    lab = np.array([0] * 30 + [1] * 29 + [2])
    df = spark.createDataFrame([(i, int(lab[i]), X[i].tolist()) for i in range(60)], "id long, c long, v array<double>")
    got = vx.silhouette(df, "id", "c", "v", block_rows=16).first()
    assert math.isclose(got.silhouette, _sil_brute(X, lab), rel_tol=1e-9)
    one = vx.silhouette(df.withColumn("c", F.lit(0).cast("long")), "id", "c", "v").first()
    assert math.isnan(one.silhouette)


def test_davies_bouldin_brute_force(spark):
    rnd = np.random.default_rng(2)
    X = rnd.normal(size=(40, 3))
    lab = np.array([0] * 15 + [1] * 15 + [2] * 10)
    df = spark.createDataFrame([(i, int(lab[i]), X[i].tolist()) for i in range(40)], "id long, c long, v array<double>")
    got = vx.davies_bouldin(df, "id", "c", "v").first().davies_bouldin
    cents = np.array([X[lab == c].mean(0) for c in range(3)])
    S = np.array([np.linalg.norm(X[lab == c] - cents[c], axis=1).mean() for c in range(3)])
    M = np.linalg.norm(cents[:, None] - cents[None], axis=-1)
    want = np.mean([max((S[i] + S[j]) / M[i, j] for j in range(3) if j != i) for i in range(3)])
    assert math.isclose(got, want, rel_tol=1e-9)


# ---------------------------------------------------------------------------- evaluation

def test_report_zero_division_and_union_labels(spark):
    """A class only predicted and a class never predicted; zero_division = 0."""
    yy = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "a"), ("b", "a")], "y_true string, y_pred string")
    rep = {r.label: r for r in ev.classification_report(yy).collect()}
    assert rep["b"].precision == 0.0 and rep["b"].f1 == 0.0
    assert rep["c"].support == 0 and rep["c"].recall == 0.0
    assert rep["accuracy"].f1 == 0.25
    cm = {(r.y_true, r.y_pred): r.n for r in ev.confusion_matrix(yy).collect()}
    assert len(cm) == 9 and cm[("b", "a")] == 2 and cm[("c", "c")] == 0


def test_stratified_split_exact_counts(spark):
    rows = [(i, "big" if i < 700 else ("mid" if i < 950 else "one")) for i in range(951)]
    df = spark.createDataFrame(rows, "id long, lab string")
    s = ev.stratified_split(df, "id", "lab", 0.2, 42, n_buckets_hex=1)
    got = {(r.lab, r.split): r.n for r in s.groupBy("lab", "split").agg(F.count("*").alias("n")).collect()}
    assert got[("big", "test")] == 140 and got[("mid", "test")] == 50 and got[("one", "test")] == 1
    assert s.count() == 951


def test_blocked_lead_equals_lead(spark):
    """next_row (blocked lead, skew-safe) equals a plain lead, across block edges and
    empty blocks."""
    from pyspark.sql import Window

    from ticketlake.sources.tables import next_row

    rnd = random.Random(1)
    rows = [(rnd.randint(0, 3), t, f"x{t}") for t in rnd.sample(range(5000), 1500)]
    df = spark.createDataFrame(rows, "k int, o long, v string")
    a = {(r.k, r.o): (r.next_o, r.next_v) for r in next_row(df, "k", "o", ["v"], block=16).collect()}
    w = Window.partitionBy("k").orderBy("o")
    b = {(r.k, r.o): (r.n1, r.n2)
         for r in df.select("k", "o", F.lead("o").over(w).alias("n1"), F.lead("v").over(w).alias("n2")).collect()}
    assert a == b
