"""The operators as Spark jobs, against brute force on small tables with odd rows."""

import hashlib
import os
import random
import shutil
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_kernels import distance, edited
from tests.oracle import compare, duck
from ticketlake.llm import (
    bpe, chat_format, decontaminate, license_scan, line_dedup, ngram_join, quality, queries, toxicity, url_filter, vector_dedup,
)

LONG = " ".join(f"long{k % 977} word{k % 31}" for k in range(20000))
CLASH = "doc_id long, text string, id long, key long, __lines string, __hits string, __line_parts string, label int"


def roots(nodes, pairs):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def odd_rows(texts):
    """Documents with nulls, an empty and a very long text, repeated rows and columns
    whose names the operators use themselves."""
    rows = [(k, t, 1, 2, "x", "y", "z", 0) for k, t in enumerate(texts)]
    rows += [(900, None, None, None, None, None, None, None), (901, "", 5, 5, "", "", "", 5), (902, LONG, 0, 0, "a", "b", "c", 1)]
    return rows + rows[:2]


def shingles(text):
    words = (text or "").lower().split()
    n = min(5, max(1, len(words)))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()


def test_ngram_join(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 8)  # several blocks a group
    rng = random.Random(1)
    texts = []
    for _ in range(25):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([0, 1, 3, 30, 60]))]
        for _ in range(rng.choice([1, 2, 12])):
            own = list(words)
            for _ in range(rng.randrange(3)):
                if own:
                    own[rng.randrange(len(own))] = f"w{rng.randrange(400)}"
            texts.append(" ".join(own))
    rows = odd_rows(texts)
    df = spark.createDataFrame(rows, CLASH).repartition(4)
    got = ngram_join.jaccard_classes(df).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: shingles(r[1]) for r in rows}
    pairs, links = [], {}
    for a, _, *_ in rows:
        n = -1
        for b, *_ in rows:
            x, y = by_id[a], by_id[b]
            if x == y or (x and y and len(x & y) / len(x | y) >= 0.8):
                n += 1
                pairs.append((a, b))
        links[a] = n
    component = roots(by_id, pairs)
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (links[r.doc_id], component[r.doc_id], component[r.doc_id] == r.doc_id), r
    kept = ngram_join.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(component.values()))


def test_ngram_join_without_ids_or_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (None, "z")], "doc_id long, text string")
    got = ngram_join.jaccard_classes(df).collect()
    assert sorted(r.n_links for r in got) == [0, 2, 2, 2]
    assert {r.component_id for r in got if r.n_links} == {3}
    assert ngram_join.drop_near_copies(df).count() == 4  # rows without id stay
    assert ngram_join.jaccard_classes(df.limit(0)).count() == 0


def test_ngram_join_of_one_id_with_two_texts(spark):
    a, b = ([f"{c}{k}" for k in range(60)] for c in "ab")
    near = lambda words, k: " ".join(words[:k] + ["other"] + words[k + 1:])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a, 3)), (3, near(b, 3)), (4, " ".join(b))]
    rows += [(20, "x y z"), (21, "x y z"), (21, "p q r"), (22, "p q r")]  # the id isn't the smallest of both its classes
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.jaccard_classes(df).collect()
    assert sorted((r.doc_id, r.n_links, r.component_id) for r in got) == [
        (1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1), (20, 1, 20), (21, 1, 20), (21, 1, 20), (22, 1, 20)]
    assert sorted(r.doc_id for r in ngram_join.drop_near_copies(df).collect()) == [1, 20]


def test_line_dedup(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 8)  # hot keys go through block cells
    monkeypatch.setattr(line_dedup, "CELL", 16)
    rng = random.Random(3)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(5, 60))) for _ in range(25)]
    texts = ["\n".join(edited(rng, rng.choice(base), 3, "abcde") for _ in range(5)) for _ in range(60)]
    texts += [f"the common head of a templated line, number {k:03d} {rng.randrange(10**5):05d}" for k in range(120)]
    texts += ["\n\n", "one\n\none \n\tone"]
    rows = odd_rows(texts) + [(None, base[0], 0, 0, "", "", "", 0)]
    df = spark.createDataFrame(rows, CLASH).repartition(4)
    occurrences = sorted({(d, p, s) for d, t, *_ in rows if d is not None and t for p, x in enumerate(t.split("\n")) if (s := x.strip(" \t\r"))})
    lines = sorted({s for _, _, s in occurrences})
    pairs = [(a, b) for i, a in enumerate(lines) for b in lines[:i]
             if (t := min(2, min(len(a), len(b)) // 10)) and abs(len(a) - len(b)) <= t and distance(a, b) <= t]
    name = roots(lines, pairs)
    first = {}
    for d, p, s in occurrences:
        first.setdefault(name[s], (d, p))
    keep = set(first.values())
    got = line_dedup.drop_repeated_lines(df).collect()
    wanted = []
    for row in rows:
        d, text = row[:2]
        if d is None or not text or not text.strip("\n \t\r"):
            wanted.append((d, text))
        elif any(x.strip(" \t\r") and (d, p) in keep for p, x in enumerate(text.split("\n"))):
            wanted.append((d, "\n".join(x for p, x in enumerate(text.split("\n")) if not x.strip(" \t\r") or (d, p) in keep)))
    order = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got), key=order) == sorted(wanted, key=order)
    assert line_dedup.drop_repeated_lines(df).columns == df.columns
    assert line_dedup.line_classes(df.limit(0)).count() == 0


def test_line_dedup_of_long_lines(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    lines = []
    for size in (100, 148, 155, 200, 398, 402, 700, 1250, 1900):
        for _ in range(3):
            base = " ".join(word() for _ in range(size))[:size].strip()
            lines += [base, *(edited(rng, base, size // 40 + 2, "abcdefgh ").strip() for _ in range(4))]
            chain = base
            for _ in range(3):  # one more word replaced in each
                words = chain.split(" ")
                words[rng.randrange(len(words))] = word()
                lines.append(chain := " ".join(words))
    passage = " ".join(word() for _ in range(12))  # in many lines, at other places
    lines += [" ".join([*(word() for _ in range(rng.randint(5, 40))), passage, *(word() for _ in range(rng.randint(5, 40)))]) for _ in range(60)]
    many = " ".join(word() for _ in range(60))
    lines += [edited(rng, many, 4, "abcdefgh").strip() for _ in range(60)]
    assert {min(2, len(x) // 10) for x in lines} == {2}
    wanted = roots(lines, [
        (a, b) for i, a in enumerate(lines) for b in lines[:i]
        if abs(len(a) - len(b)) <= (t := max(2, min(len(a), len(b)) // 50)) and line_dedup.within(a, b, t)])
    for a, b in rng.sample([(a, b) for a in lines[:70] for b in lines[:70] if abs(len(a) - len(b)) < 8], 40):
        limit = rng.randint(2, 60)
        assert line_dedup.within(a, b, limit) == (distance(a, b) <= limit)
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    first = {}
    for k, x in enumerate(lines):
        first.setdefault(wanted[x], k)
    for block, cell, many in ((64, 256, 4096), (4, 16, 12)):  # the second sends keys through classes, centres and cells
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        monkeypatch.setattr(line_dedup, "CELL", cell)
        monkeypatch.setattr(line_dedup, "MANY", many)
        got = {r.id: r.lines[0].first_doc for r in line_dedup.line_classes(df).collect()}
        assert got == {k: first[wanted[x]] for k, x in enumerate(lines)}


def labelled(rng, n, insult):
    rows, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice("aeioust") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(10, 60))]
        y = k % 4 == 0
        if y:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(insult)
        rows.append((k, " ".join(words)))
        labels.append((k, int(y)))
    return rows, labels


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, module, label):
    rows, labels = labelled(random.Random(4), 600, ["grubnak", "zorvex", "QWERTY%%%"])
    docs = spark.createDataFrame(rows + [(9000, None), (9001, ""), (9002, LONG), (None, "no id"), (0, rows[0][1])], "doc_id long, text string")
    table = spark.createDataFrame(labels + [(9000, None), (None, 1)], f"doc_id long, {label} int").selectExpr("*", "1 as text", "2 as id")
    got = module.score(docs.selectExpr("*", "'x' as id", "1 as score", "2 as y"), table).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 for r in got)
    truth = dict(labels)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    fold = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum((r.score >= 0.5) == truth[r.doc_id] for r in fold) / len(fold) > 0.93
    # labels of the held-out fold have no influence
    flipped = [(d, 1 - y if zlib.crc32(str(d).encode()) % 5 == 0 else y) for d, y in labels]
    again = module.score(docs, spark.createDataFrame(flipped, f"doc_id long, {label} int")).collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in got}
    none = module.score(docs, table.limit(0)).collect()
    assert {round(r.score, 6) for r in none} == {0.5} and module.score(docs.limit(0), table).count() == 0


def test_toxicity_filter_keeps_columns(spark):
    rows, labels = labelled(random.Random(4), 400, ["grubnak", "zorvex"])
    docs = spark.createDataFrame([(*r, 1, "u") for r in rows], "doc_id long, text string, score int, id string")
    kept = toxicity.drop_toxic(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.collect()}
    assert left == {r.doc_id for r in toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).where("predicted = 0").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_form(spark, sf_dir, name):
    ok, message = compare(queries.queries()[name](spark, sf_dir), duck(sf_dir), queries.oracle_sql()[name])
    assert ok, message


def test_url_filter(spark):
    rows = [(1, None, "h"), (2, "", "h"), (None, "http://a.net/x", "h"), (4, "http://A.NET/" + "y" * 100000, "h"), (4, "x://", "h")]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), queries.URL_RULES).collect()
    assert sorted((r.page_id or 0, r.host, r.rule, r.verdict) for r in got if r.rule) == [(0, "a.net", "net/", "block"), (4, "a.net", "net/", "block")]
    assert len(got) == 5 and {r.verdict for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), []).collect()} == {"allow"}


def test_url_index_parts(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_INDEX_BYTES", 60)  # every rule gets an index of its own
    df = spark.createDataFrame([(1, "http://example.net/en/a"), (2, "http://example.org/fr/")], "page_id long, url string")
    assert sorted(r.rule for r in url_filter.judge_urls(df, queries.URL_RULES).collect()) == ["example.net/en/", "org/fr/"]


def test_bpe(spark):
    path = queries.rank_file()
    rows = odd_rows(["a b", "it's 12 o'clock\n\n now"])
    got = bpe.encode(spark.createDataFrame(rows, CLASH), path).collect()
    texts = {d: t or "" for d, t, *_ in rows}
    assert len(got) == len(rows) and all(bytes(r.decoded).decode() == texts[r.doc_id] for r in got)
    first = bpe.digests(bpe.encode(spark.createDataFrame(rows[:1], CLASH), path)).first()
    assert (first.n_tokens, first.decoded_sha256) == (2, hashlib.sha256(b"a b").hexdigest())
    assert bpe.encode(spark.createDataFrame([], CLASH), path).count() == 0


def test_decontamination(spark):
    items = [(k, " ".join(f"q{k}w{j}" for j in range(12))) for k in range(20)] + [(20, None), (21, ""), (0, "q0w0 q0w1")]
    texts = [" ".join(["some", "other", "words"] * 20 + [items[k][1].upper()] + ["tail"] * 50) for k in range(10)]
    texts += ["nothing here", " ".join(items[3][1].split()[:4])]
    df = spark.createDataFrame(odd_rows(texts), CLASH)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(df, benchmark)
    found = {r.doc_id: [h.item for h in r[decontaminate.HITS]] for r in got.collect()}
    assert found == {**{d: [] for d in (*range(12), 900, 901, 902)}, **{k: [k] for k in range(10)}}
    left = decontaminate.drop_leaks(df, benchmark)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [10, 11, 900, 901, 902]
    assert decontaminate.drop_leaks(df, benchmark.limit(0)).count() == df.count()
    assert decontaminate.drop_leaks(df.limit(0), benchmark).count() == 0


def test_decontamination_in_parts(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(150)]
    items = [(k, " ".join(rng.choice(words[:10 + 7 * k]) for _ in range(rng.randint(6, 30)))) for k in range(20)] + [(20, ""), (21, None)]
    texts = []
    for k in range(60):
        own = items[k % 20][1].split()
        for _ in range(rng.randint(0, len(own) // 3)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join([*rng.choices(words, k=40), *own, *rng.choices(words, k=20)]))
    df = spark.createDataFrame(list(enumerate(texts)) + [(100, None), (101, "")], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    hits = lambda: {r.doc_id: [tuple(h) for h in r[decontaminate.HITS]] for r in decontaminate.find_leaks(df, benchmark).collect()}
    one = hits()
    assert sum(map(len, one.values())) > 20
    monkeypatch.setattr(decontaminate, "MAX_PART_CHARS", 1000)
    assert len(list(decontaminate.indexes(benchmark, "item_id", "text"))) > 2
    assert hits() == one


def test_chat_formatting(spark, sf_dir):
    got = {r.conv_id: r for r in queries.op7_chat_formatting(spark, sf_dir).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", queries.CONTROL), (-1, 1, "assistant", queries.CONTROL)]
    wanted = {}
    for c, _, role, text in sorted(rows):
        wanted.setdefault(c, []).append((role, text or ""))
    assert set(got) == set(wanted)
    for c, turns in wanted.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_formatting_of_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", ""), (None, 0, "user", "x"), (2, None, "user", LONG), (2, 0, "assistant", "a\\<|"), (2, 0, "assistant", "a\\<|")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as conv", "'y' as formatted")
    got = {r.conv_id: r for r in chat_format.conversation_digests(chat_format.format_turns(df)).collect()}
    assert {c: r.n_turns for c, r in got.items()} == {1: 2, None: 1, 2: 3}
    assert got[1].turns_sha256 == hashlib.sha256(b"\n\nassistant\n\n").hexdigest()
    assert got[2].loss_sha256 == hashlib.sha256(b"a\\<|a\\<|").hexdigest()
    assert chat_format.conversation_digests(chat_format.format_turns(df.limit(0))).count() == 0


def brute_vectors(rows, threshold=0.9):
    """Links of every row and the smallest id of its component; rows may repeat an id."""
    fine = [(k, np.array(v, float)) for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, pairs = [0] * len(rows), []
    for a, x in fine:
        for b, y in fine:
            if a != b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[a] += 1
                pairs.append((a, b))
    root = roots(range(len(rows)), pairs)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    return Counter((i, links[k], least.get(root[k]), i == least.get(root[k])) for k, (i, _) in enumerate(rows))


def test_near_vectors(spark, monkeypatch):
    for name, value in (("HOME", 40), ("VISITORS", 30), ("SAMPLE", 100)):
        monkeypatch.setattr(vector_dedup, name, value)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 6))
    rows = [(i, (base[rng.integers(12)] + rng.normal(size=6) * rng.choice([0.05, 0.2, 0.4])).astype("float32").tolist()) for i in range(400)]
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None), (2001, [0.0] * 6), (2002, [nan] * 6), (2003, [1.0, None, 0.0]), (2004, [1.0, 0.0]), (2005, [2.0, 0.0]), (2006, []), (2007, [inf, 1.0])]
    rows += rows[:3] + [(None, [1.0, 0.0]), (None, [0.0, 1.0]), (3000, None)]
    rows += [(3001, [1.0, 0.0, 0.0]), (3001, [0.0, 1.0, 0.0]), (3002, [1.0, 0.01, 0.0]), (3003, [0.0, 1.0, 0.02])]  # one id, two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as cell", "3 as name", "4 as root")
    got = vector_dedup.near_vectors(df).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == brute_vectors(rows)
    assert sorted((r.n_links, r.component_id) for r in got if r.vec_id in (3001, 3002, 3003)) == [(1, 3001)] * 4
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_of_the_table(spark, sf_dir):
    got = queries.op9_embedding_near_dedup(spark, sf_dir).collect()
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == brute_vectors(rows)


def test_near_vectors_equal_their_sql_where_vectors_link(spark, tmp_path):
    """The given vectors hardly link; the same query and SQL over tight groups and odd rows."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(15, 8))
    rows = [(i, (base[i % 15] + rng.normal(size=8) * rng.choice([0.02, 0.3])).astype("float32").tolist(), 0) for i in range(200)]
    rows += [(500, None, 1), (501, [0.0] * 8, 1), (502, [1.0, 0.0], 1), (503, [float("nan")] * 8, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    df = queries.op9_embedding_near_dedup(spark, str(tmp_path))
    ok, message = compare(df, con, queries.oracle_sql()["op9_embedding_near_dedup"])
    assert ok and df.where("n_links > 0").count() > 100, message


def test_license_scan(spark):
    texts = ["text\nReleased under the MIT License.\nmore", "All rights reserved.", "no license to kill here, just words and more words", "MIT"]
    rows = odd_rows(texts) + [(None, "All rights reserved.", 0, 0, "", "", "", 0)]
    df = spark.createDataFrame(rows, CLASH)
    got = license_scan.document_licenses(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.licenses for r in got if r.licenses} == {0: ["MIT"], 1: ["all-rights-reserved"]}
    hits = license_scan.scan(df).where("doc_id = 0").collect()
    assert {(r.pos, r.block, r.n_diff) for r in hits} == {(1, "Released under the MIT License.", 0)}
    assert license_scan.document_licenses(df, templates={}).where("n_blocks > 0").count() == 0
    assert license_scan.document_licenses(df.limit(0)).count() == 0


def test_license_beside_other_sentences_and_over_lines(spark):
    texts = ["Great article about trains. Released under the MIT License.", "Copyright 2020 Foo Inc. All rights reserved.",
             "/*\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following\n"
             " * conditions are met.\n */", "x\nReleased under\nthe MIT License. " + "word " * 200 + "All rights reserved. All rights reserved.",
             "Released under the other and different MIT License.", "All their rights reserved."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.pos, r.license, r.n_diff) for r in license_scan.scan(df).collect()}
    assert got == {(0, 0, "MIT", 0), (1, 0, "all-rights-reserved", 0), (2, 1, "BSD-3-Clause", 0), (3, 1, "MIT", 0), (3, 2, "all-rights-reserved", 0)}
    assert {r.doc_id: r.n_blocks for r in license_scan.document_licenses(df).collect()} == {0: 1, 1: 1, 2: 1, 3: 3, 4: 0, 5: 0}


def test_license_gate_loses_nothing(spark):
    rng = random.Random(9)
    templates = {
        **license_scan.TEMPLATES, "granted": "Permission is hereby granted, free of charge, to any person obtaining a copy",
        "unlicense": "This is free and unencumbered software released into the public domain.", "other script": "Все права защищены ΟΔΟΣ."}
    texts = ["Released under the MIT terms.", templates["granted"], templates["unlicense"], "x ВСЕ ПРАВА ЗАЩИЩЕНЫ Οδος"]
    for text in templates.values():
        for _ in range(3):
            words = text.split()
            for _ in range(rng.randint(0, len(words) // 4 + 1)):
                at, kind = rng.randrange(len(words)), rng.random()
                words[at:at + (kind > 0.3)] = [] if kind > 0.7 and len(words) > 2 else [rng.choice(["zebra", "the", "license", "all"])]
            texts.append(f"some {rng.choice(['words.', 'rights'])}\n" + "".join(w + rng.choice([" ", " ", "\n", ", "]) for w in words) + "and more")
    scanner = license_scan.Scanner(templates)
    wanted = {(k, *x[:3]) for k, text in enumerate(texts) for x in scanner.blocks(text, gated=False)}
    assert 30 < len({x[0] for x in wanted}) < len(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.start, r.block, r.license) for r in license_scan.scan(df, templates=templates).collect()}
    assert got == wanted
    assert {(x[0], x[3]) for x in got if x[0] < 4} == {(0, "MIT"), (1, "granted"), (2, "unlicense"), (3, "other script")}
    whole = {name: license_scan.TEMPLATES[name] for name in license_scan.TEMPLATES if name.endswith("text")}
    wrapped = [(name, text.replace(". ", ".\n\n * ")) for name, text in whole.items()]
    found = license_scan.document_licenses(spark.createDataFrame(wrapped, "doc_id string, text string").selectExpr("crc32(doc_id) as doc_id", "text"))
    assert {r.doc_id: r.licenses for r in found.collect()} == {zlib.crc32(name.encode()): [name] for name in whole}


def test_pipeline_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "decontamination", "byte_bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    out = corpus_pipeline.run(spark, sf_dir).collect()
    # the same decisions, taken stage by stage in plain Python on what the classifier kept
    kept = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir)
    assert kept.columns == columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    second = corpus_pipeline.STAGES[1][1](spark, kept, sf_dir)
    assert second.columns == columns and second.where("n_chars <> length(text)").count() == 0
    lines = {}
    for d, t in sorted(rows):
        for p, x in enumerate((t or "").split("\n")):
            lines.setdefault(x.strip(" \t\r"), (d, p))
    texts = {r.doc_id: r.text for r in second.collect()}
    for d, t in rows:  # exact repeats are all gone; near repeats may take more
        own = {x.strip(" \t\r") for x in (texts.get(d) or "").split("\n")} - {""}
        assert all(lines[x][0] == d for x in own)
        assert [x for x in (t or "").split("\n") if x.strip(" \t\r") in own or not x.strip(" \t\r")] != [] or d not in texts or not t
    grams = {d: shingles(t) for d, t in texts.items()}
    index = {}
    for d, g in grams.items():
        for x in g:
            index.setdefault(x, []).append(d)
    pairs = set()
    for owners in index.values():
        pairs |= {(a, b) for a in owners for b in owners if a < b and len(owners) < 200}
    near = [(a, b) for a, b in pairs if len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.8]
    empty = [d for d, g in grams.items() if not g]
    name = roots(grams, near + list(zip(empty, empty[1:])))
    items = [" ".join((r.text or "").lower().split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = {d for d in grams if name[d] == d}
    clean = {d for d in left if not any(x in " ".join((texts[d] or "").lower().split()) for x in items)}
    got = {r.doc_id for r in out}
    assert got <= clean and len(clean - got) <= 0.01 * len(clean)  # verbatim items go; edited ones may too
    for r in out:
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_pipeline_of_an_empty_table(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        shutil.copy(os.path.join(sf_dir, f"{name}.parquet"), tmp_path)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
