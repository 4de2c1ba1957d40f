"""Quality rules, prefix trie and centroid clustering against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from math import comb, floor

import numpy as np
import pyarrow as pa
import pytest

from ticketlake.llm import centroids, prefix_trie, quality_rules, queries

LONG = " ".join(f"long{k % 977} word{k % 31}" for k in range(20000))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    repeated = {p for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), len(lines)]


def test_measures_equal_plain_python():
    rng = random.Random(2)
    texts = [None, "", " ", "\n\n", "a", "a b\n a b\na b\n", LONG, "x " * 30, "ünï cödé | # \x85\xa0  x", "a\x0bb\x0cc\rd\te", "\x1c \x00"]
    for _ in range(300):
        vocabulary = rng.choice([["a", "b"], ["a", "bb", "é", "#"], [f"w{k}" for k in range(40)]])
        texts.append("".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "  ", "\t", "\n\n", " "]) for _ in range(rng.randint(0, 60))))
    assert quality_rules.measure(texts).tolist() == [plain_measures(t) for t in texts]
    assert quality_rules.measure([]).shape == (0, 6)


def test_binomial_tail_is_exact():
    for n, p in ((1, 0.05), (40, 0.05), (300, 0.01), (500, 0.2)):
        for k in (0, 1, 3, int(n * p) - 1):
            if 0 <= k < n * p:
                q = Fraction(str(p))
                exact = sum(comb(n, i) * q ** i * (1 - q) ** (n - i) for i in range(k + 1))
                assert quality_rules.binomial_tail(k, n, p) == pytest.approx(float(exact), rel=1e-9)
    assert quality_rules.binomial_tail(3, 20, 0.05) == 1.0 and quality_rules.binomial_tail(0, 0, 0.05) == 1.0


def corpus(rng, n, strata=("en", "de", None, "xx")):
    rows, labels = [], []
    for k in range(n):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(15, 80))]
        for _ in range(0 if good else rng.randint(3, 30)):
            words.append(rng.choice(["#", "$$", "|", "<>"]))
        if rng.random() < 0.03:
            words += ["##"] * 20
        lang = rng.choice(strata[:2] if rng.random() < 0.9 else strata[2:])
        rows.append((k, "\n".join(" ".join(words[i:i + 9]) for i in range(0, len(words), 9)), lang))
        if rng.random() < 0.9 and lang != "xx":
            labels.append((k, int(good)))
    return rows, labels


def plain_verdicts(rows, labels):
    """Rules, proposals and certification with plain counts and exact fractions."""
    def rungs(m):
        m = dict(zip(quality_rules.MEASURES, m))
        out = []
        for over, under, more, ladder in quality_rules.RULES.values():
            hit = [g for g, cut in enumerate(ladder, 1) if m[under] and ((100 * m[over] > cut * m[under]) if more else (100 * m[over] < cut * m[under]))]
            out.append(min(hit, default=9))
        return out

    truth, alpha, delta = dict(labels), Fraction(1, 20), Fraction(1, 20)
    docs = [(d, lang, plain_measures(t)) for d, t, lang in rows]
    base = {k: m[0] < 20 or 100 * m[4] > 30 * m[0] for k, (_, _, m) in enumerate(docs)}
    fold = lambda d: zlib.crc32(str(d).encode()) % 5
    used = [(lang, fold(d) >= 3, truth[d], rungs(m)) for k, (d, lang, m) in enumerate(docs) if d in truth and not base[k] and fold(d)]
    strata, cut = {u[0] for u in used}, {}
    for s in strata:
        propose = [(y, r) for lang, sure, y, r in used if lang == s and not sure]
        good, bad = [r for y, r in propose if y], [r for y, r in propose if not y]
        target = [0] * 5
        for k in range(5):
            for g in range(1, 9):
                lost, hit = sum(r[k] <= g for r in good), sum(r[k] <= g for r in bad)
                if good and bad and lost * 5 <= alpha * len(good) and hit and hit * len(good) >= 5 * lost * len(bad):
                    target[k] = g
        sure = [r for lang, c, y, r in used if lang == s and c and y]
        best = 0
        for t in range(1, 9):
            k = sum(any(g and g - (8 - t) > 0 and r[i] <= g - (8 - t) for i, g in enumerate(target)) for r in sure)
            tail = sum(comb(len(sure), i) * alpha ** i * (1 - alpha) ** (len(sure) - i) for i in range(k + 1))
            if not sure or not any(target) or tail > delta / len(strata):
                break
            best = t
        cut[s] = [max(g - (8 - best), 0) if best and g else 0 for g in target]
    kept = [not base[k] and not any(g and r <= g for g, r in zip(cut.get(lang, [0] * 5), rungs(m))) for k, (_, lang, m) in enumerate(docs)]
    return [(d, *m, base[k], kept[k]) for k, (d, _, m) in enumerate(docs)], cut


def test_quality_rules_equal_plain_python(spark):
    rows, labels = corpus(random.Random(5), 1500)
    rows += [(9000, None, "en"), (9001, "", None), (9002, LONG, "de"), (None, rows[0][1], "en"), rows[3], rows[3]]
    labels += [(9000, 1), (None, 1), (77777, 1), (labels[0][0], 0), (5, 7)]
    best = {}
    for d, y in labels:
        if d is not None and y in (0, 1):
            best[d] = max(y, best.get(d, 0))
    wanted, cut = plain_verdicts(rows, list(best.items()))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr(
        "*", "1 as id", "'x' as stratum", "2 as n_words", "array(1) as rungs", "true as kept").repartition(5)
    got = quality_rules.judge(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r.doc_id, *(r[m] for m in quality_rules.MEASURES), r.base_failed, r.kept) for r in got), key=key) == sorted(wanted, key=key)
    assert any(cut["en"]) and any(cut["de"]) and not any(cut[None])  # too few labels show nothing
    assert sum(not r.base_failed and not r.kept for r in got) > 100


def test_false_rejections_stay_under_alpha():
    """Over many draws from one law, the true share of rejected good documents exceeds
    alpha in at most a share delta of the draws."""
    rng = np.random.default_rng(3)
    law = rng.dirichlet(np.ones(9) * 0.6)  # of a good document's first violated rung
    over, draws = 0, 400
    for _ in range(draws):
        cells = []
        for part in (0, 1):
            for good, p in ((1, law), (0, np.array([0.5, 0.5, *[0.0] * 7]))):
                for rung, n in enumerate(rng.multinomial(400, p), 1):
                    cells.append((part, good, int(n), rung, 9, 9, 9, 9))
        rungs, _, _ = quality_rules.choose(cells, 1, 0.05, 0.1)
        over += law[:rungs[0]].sum() > 0.05
    assert over / draws <= 0.1


def test_quality_rules_of_little(spark):
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame([(1, "word " * 25, "en"), (2, "few words", "en")], schema)
    none = spark.createDataFrame([], "doc_id long, quality int")
    # 25 equal words are windows found again; they fail the base
    assert {(r.doc_id, r.base_failed, r.kept) for r in quality_rules.judge(docs, none).collect()} == {(1, True, False), (2, True, False)}
    assert quality_rules.judge(docs.limit(0), none).count() == 0
    unstratified = quality_rules.judge(docs.drop("lang"), none, stratum_col=None)
    assert unstratified.count() == 2


# --- prefix trie


def plain_trie(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        whole[c] = own.get(base, [])[:h] + t[h:]
    nodes = {}
    for c, t in whole.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    children = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, m in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1].encode()) if k else 0)
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else -1, len(m), children[k], leaves[k], saved[k],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(k)).encode()).hexdigest()) for k, m in nodes.items())


def trie_rows(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
                  for r in df.collect())


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("shard_rows", [250_000, 40, 7])
def test_prefix_trie_equals_plain_python(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", shard_rows)  # small: conversations run over many ranges
    monkeypatch.setattr(prefix_trie, "ENDS_CHARS", 20)
    rng = random.Random(shard_rows)
    rows = []
    for c in rng.sample(range(300), 120):
        for t in range(rng.choice([0, 1, 2, 4, 9, 14])):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t > 3 else "user", rng.choice(["hi", "ho", "é" * 3]) if t > 2 else "same"))
    rows += [(c, t, "user", f"turn {t % 3}") for c in (400, 401, 1405) for t in range(150)]  # one path of many ranges
    rows += [(c, t, "user", "shared" if t < 90 else str(c)) for c in (500, 505, 510, 515) for t in range(100)]
    rows += [(600, None, None, None), (600, 1, "user", ""), (600, 0, "", LONG), (None, 0, "user", "no id"), (None, 1, "user", "x"), (-7, 0, "user", "below"), (-7, 1, "user", "zero")]
    rows += [(601, 3, "user", "twice"), (601, 3, "user", "twice")]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as conv", "'y' as shard", "2 as depth", "3 as a").repartition(6)
    assert trie_rows(prefix_trie.prefix_trie(df)) == plain_trie(rows)


def test_prefix_trie_of_little(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_trie(empty).count() == 0
    # conversation 6 has h turns from an absent base and none left: a member of the root only
    short = [c for c in range(1, 60) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0][:3]
    rows = [(c, 0, "user", "gone") for c in short]
    got = trie_rows(prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS)))
    assert got == plain_trie(rows) and len(got) == 1 and got[0][3] == 3


def test_tied_turns_have_one_order(spark):
    rows = [(5 * c, 0, role, text) for c in range(4) for role, text in (("user", "b"), ("user", "a"), ("x", "a"))]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = trie_rows(prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(3)))
        assert [(r[1], r[3]) for r in got] == [(0, 4), (1, 4), (2, 4), (3, 4)]  # the same path for all


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 20000):
        hi, lo = rng.integers(0, 1 << 63, n, np.uint64), rng.integers(0, 1 << 63, n, np.uint64)
        table = prefix_trie.PerfectHash(hi, lo)
        assert sorted(table(hi, lo)) == list(range(n))  # minimal and perfect
        assert (table(hi, lo + np.uint64(1)) == -1).all()  # a foreign key is noticed
    same = np.arange(1000, dtype=np.uint64)
    assert sorted(prefix_trie.PerfectHash(same * 0, same)(same * 0, same)) == list(range(1000))


def test_colliding_prefixes_fail(monkeypatch):
    rows = {"conv": [0, 0, 5, 5], "depth": [0, 1, 0, 1], "t1": [0, 1, 0, 2], "t2": [0, 3, 0, 4], "check": [0, 5, 0, 6], "bytes": [0, 1, 0, 1]}
    batch = pa.RecordBatch.from_pydict({**{k: pa.array(v, pa.int64()) for k, v in rows.items()}, "shard": pa.array([0] * 4, pa.int32())})
    run = prefix_trie._counted(prefix_trie.Running([]))
    assert next(run(iter([batch]))).num_rows == 3
    monkeypatch.setattr(prefix_trie, "_salted", lambda h, place, salt: np.full(len(h), salt, np.uint64))  # every turn has one digest
    with pytest.raises(ValueError, match="share a digest"):
        list(run(iter([batch])))


# --- centroid clustering


def plain_clusters(rows, dim=64, k=16, rounds=3):
    kept = [(i, [floor(64 * Fraction(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), [str(x) for x in v], v) for i, v in kept if i is not None)[:k]
    centres = [v for _, _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [min((far(v, c), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, at) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    inertia = Counter()
    for d, c in at:
        inertia[c] += d
    fit = lambda x: x if x < 1 << 63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, c, fit(d), fit(inertia[c]), fit(sum(inertia.values())), sha[c]) for (i, _), (d, c) in zip(kept, at)]


def cluster_rows(df):
    return Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


VECTORS = "vec_id long, embedding array<float>"


def test_clusters_equal_plain_python(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(9, 64))
    rows = [(i, (base[rng.integers(9)] * 0.3 + rng.normal(size=64) * 0.05).astype("float32").tolist()) for i in range(250)]
    rows += [(1000 + i, [0.5] * 64) for i in range(20)] + [(1030 + i, [0.5] * 63 + [-0.5]) for i in range(20)]  # ties
    nan = float("nan")
    odd = [(2000, None), (2001, []), (2002, [0.1] * 63), (2003, [nan] * 64), (2004, [None] + [0.0] * 63), (2005, [float("inf")] * 64), (2006, [0.0] * 65)]
    rows += [*odd, (None, [0.25] * 64), rows[0], rows[0], (7, [0.0] * 64)]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as id", "2 as cluster", "3 as v").repartition(5)
    assert cluster_rows(centroids.cluster_vectors(df)) == Counter(plain_clusters(rows))


def test_clusters_of_huge_and_few_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=64) * 10.0 ** (i % 3 * 18)).astype("float32").tolist()) for i in range(30)] + [(50, [3.4e38] * 64), (51, [-3.4e38] * 64)]
    assert cluster_rows(centroids.cluster_vectors(spark.createDataFrame(rows, VECTORS))) == Counter(plain_clusters(rows))
    few = rows[:3]
    assert cluster_rows(centroids.cluster_vectors(spark.createDataFrame(few, VECTORS))) == Counter(plain_clusters(few))
    alike = [(i, [0.5] * 64) for i in range(40)]  # all first centroids are equal
    got = cluster_rows(centroids.cluster_vectors(spark.createDataFrame(alike, VECTORS)))
    assert got == Counter(plain_clusters(alike)) and {r[1] for r in got} == {0}
    nothing = centroids.cluster_vectors(spark.createDataFrame(rows, VECTORS).limit(0))
    assert nothing.count() == 0 and nothing.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert centroids.cluster_vectors(spark.createDataFrame([(None, [0.5] * 64)], VECTORS)).count() == 0


def test_bisectors_equal_distances():
    rng = np.random.default_rng(6)
    for size in (3, 1 << 20, 1 << 45):
        c = rng.integers(-size, size + 1, (7, 5)).tolist()
        x = rng.integers(-size, size + 1, (200, 5))
        x = x.astype(object) if size > 1 << 26 else x
        cluster, far = centroids.Bisectors(c).nearest(x)
        wanted = [min((sum((int(a) - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c)) for v in x]
        assert [(int(d), int(j)) for d, j in zip(far, cluster)] == wanted


def test_new_queries_on_the_table(spark, sf_dir):
    assert queries.op12_prefix_trie(spark, sf_dir).count() > 200
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(queries.op12_prefix_trie(spark, sf_dir)) == plain_trie(rows)
