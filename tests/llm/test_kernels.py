"""Parts that run inside tasks, against plain Python."""

import base64
import random

import numpy as np
import pytest

from ticketlake.llm import bpe, chat_format, decontaminate, license_scan, line_dedup, ngram_join, url_filter
from ticketlake.llm.kernels import Words
from ticketlake.llm.linear_text import Distinct, char_ngrams


def test_words_and_shingles():
    texts = ["A b  c\td e f", "", None, "x", "a b c d e f", " one two "]
    words = Words(texts)
    assert np.diff(words.first).tolist() == [6, 0, 0, 1, 6, 2]
    h, at = words.shingles(5)
    assert np.diff(at).tolist() == [2, 0, 0, 1, 2, 1]
    assert h[0:2].tolist() == h[at[4]:at[5]].tolist()
    assert Words([]).first.tolist() == [0]


def test_char_ngrams_stay_inside_documents():
    words = Words(["abcdef", "", "xy", "abcdef"])
    ids, at = char_ngrams(words, 3, 18)
    assert np.diff(at).tolist() == [4, 0, 0, 4]
    assert ids[:4].tolist() == ids[4:].tolist()
    assert sorted(Distinct(18)(np.array([5, 7, 5, 5, 9], np.int32)).tolist()) == [5, 7, 9]


def test_choose_bands():
    bands, rows = ngram_join.choose_bands(0.8, 0.999)
    assert bands * rows <= 128
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, s, most, letters):
    out = list(s)
    for _ in range(rng.randint(0, most)):
        i, kind = rng.randint(0, len(out)), rng.random()
        if kind < 0.4 and out:
            out[i % len(out)] = rng.choice(letters)
        elif kind < 0.7:
            out.insert(i, rng.choice(letters))
        elif out:
            del out[i % len(out)]
    return "".join(out)


def test_banded_distance():
    rng = random.Random(1)
    for _ in range(5000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        b = edited(rng, a, 6, "abc")
        limit = rng.randint(0, 5)
        assert line_dedup.within(a, b, limit) == (distance(a, b) <= limit), (a, b, limit)


@pytest.fixture(scope="module")
def codec():
    tokenizers = pytest.importorskip("public_tokenizers")
    return bpe.codec(tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_bpe_equals_tiktoken(codec):
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(2)
    parts = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", "1", "½", "a", "Z", "é", "中", "!", "?", "　",
             "\x85", "\x1c", "​", "🙂", "'S", "ß", "'ll", "\r\n", "ⅷ", "́"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(8000)]
    texts += ["", " ", "\n\n a", "'s", "''s", " 's", "x'", "x'l", "a" * 1000, "!" * 500, " " * 300 + "a", "🙂" * 200, "ab" * 3000]
    for at in range(0, len(texts), 700):
        part = texts[at:at + 700]
        ids = codec.encode(part)
        for text, got in zip(part, ids):
            assert np.frombuffer(got, np.uint32).tolist() == own.encode_ordinary(text), text
        assert codec.decode(ids) == [t.encode() for t in part]


def test_bpe_equals_tiktoken_on_every_code_point(codec):
    """Each beside letters, digits, apostrophes, blanks and itself."""
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for lo in range(0, 0x110000, 0x4000):
        points = [chr(c) for c in range(lo, lo + 0x4000) if not 0xD800 <= c < 0xE000]
        if not (lo < 0x34000 or lo >= 0xE0000 and lo < 0xE4000 or lo == 0xF0000):  # unassigned and private planes: a part
            points = points[::97]
        texts = [form.replace("_", c) for c in points for form in ("_", "a_b", "1_2", "x'_ '_s", " _ _", "__\n_")]
        for at in range(0, len(texts), 20000):
            part = texts[at:at + 20000]
            for text, got, wanted in zip(part, codec.encode(part), own.encode_ordinary_batch(part, num_threads=2)):
                assert np.frombuffer(got, np.uint32).tolist() == wanted, [hex(ord(c)) for c in text]


def test_long_merge_equals_short_merge(codec):
    rng = random.Random(5)
    for _ in range(50):
        piece = "".join(rng.choice("abst e") for _ in range(100)).encode()
        assert bpe._merge_long(piece, codec.ranks) == bpe.merge(piece, codec.ranks)


def test_rank_file_with_holes_is_refused(tmp_path):
    path = tmp_path / "bad"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([b])) + b" %d" % (b * 2) for b in range(256)))
    with pytest.raises(ValueError):
        bpe.Codec(str(path))


def test_chat_round_trip():
    rng = random.Random(3)
    parts = ["<", "|", "\\", "\n", "a", "n", "<|im_end|>", "<|im_start|>", "é", "assistant", "<\\|", "🙂", ""]
    for _ in range(1500):
        roles = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 6))]
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in roles]
        out, at, begin, end = chat_format.assemble(roles, texts)
        got_roles, got_texts = chat_format.read_back(out.tobytes())
        assert [x.decode() for x in got_roles] == roles and [x.decode() for x in got_texts] == texts
        for k in range(len(roles)):
            turn = out[at[k]:at[k + 1]].tobytes()
            assert turn.count(b"<|im_start|>") == 1 and turn.count(b"<|im_end|>") == 1
    with pytest.raises(ValueError):
        chat_format.read_back(b"no conversation")


def test_url_rules(tmp_path):
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("a.b/x", "block"), ("b/x", "allow"), ("b", "block"), ("twice/", "allow"), ("twice/", "block")]
    path = tmp_path / "index"
    path.write_bytes(url_filter.build_index(rules))
    index = url_filter.Index(str(path))
    cases = {"http://x.net/": ("net/", "block"), "http://EXAMPLE.net/en/1?q": ("example.net/en/", "allow"), "http://example.net/en": ("net/", "block"),
             "http://notnet/": (None, None), "http://a.b/xyz": ("a.b/x", "block"), "http://c.b/xyz": ("b/x", "allow"), "http://c.b/": ("b/", "block"),
             "http://net": (None, None), "net/": (None, None), "http://twice/": ("twice/", "block"), "http://.net/": ("net/", "block")}
    rule, verdict = index.best([url_filter.parse(u) for u in cases])
    assert list(zip(rule, verdict)) == list(cases.values())
    empty = tmp_path / "empty"
    empty.write_bytes(url_filter.build_index([]))
    assert url_filter.Index(str(empty)).best([("a.b", "/")]) == ([None], [None])
    assert url_filter.parse(None) == ("", "") and url_filter.parse("http://A?b/c") == ("a", "")


def test_block_max_retrieval_is_exact():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, *decontaminate.split_item(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12))))) for k in range(37)]
    index = decontaminate.Index(items)
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25))) for _ in range(80)]
    words = Words(texts)
    term = index.lookup(words.hashes())
    owner = np.searchsorted(words.first, np.arange(len(term)), "right") - 1
    key = np.unique(owner[term >= 0] * len(index.terms) + term[term >= 0])
    passage, term = key // len(index.terms), key % len(index.terms)
    full = np.zeros((len(texts), len(index.ids)))
    for p, t in zip(passage, term):
        for e in range(index.entry_at[t], index.entry_at[t + 1]):
            for x in range(index.post[e], index.post[e + 1]):
                full[p, index.item[x]] += index.share[x]
    for threshold in (0.05, 0.3, 0.7):
        got = index.retrieve(passage, term, len(texts), threshold)
        assert {(p, i) for p, i in zip(got[0].tolist(), got[1].tolist())} == {(p, i) for p, i in zip(*np.nonzero(full >= threshold - 1e-9))}


def test_leaks_are_found_anywhere_in_a_long_text():
    rng = random.Random(6)
    filler = [f"filler{k}" for k in range(500)]
    items = [(k, *decontaminate.split_item(" ".join(f"item{k}word{j}" for j in range(10 + 5 * k)))) for k in range(5)]
    index = decontaminate.Index(items)
    texts, wanted = [], []
    for _ in range(60):
        k, lead = rng.randrange(5), rng.randint(0, 400)
        texts.append(" ".join([*(rng.choice(filler) for _ in range(lead)), items[k][1], items[k][2], *(rng.choice(filler) for _ in range(lead))]))
        wanted.append([k])
    texts += [None, "", "filler1 filler2", items[4][1].split()[0]]
    wanted += [[], [], [], []]
    assert [sorted(x) for x in decontaminate.search(index, texts, 0.4, 0.5, 0.5)] == wanted
    assert decontaminate.search(decontaminate.Index([]), texts, 0.4, 0.5, 0.5) == [{} for _ in texts]


def test_license_blocks():
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    for name, text in license_scan.TEMPLATES.items():
        assert scanner.best(text)[0] == name and scanner.best(text)[2] == 0
    name, _, count, diff = scanner.best("Released under the MIT terms.")
    assert (name, count, diff) == ("MIT", 1, ["-license +terms"])
    # a word that names another license, version or clause, or a denial, is never a free one
    for text in ("Licensed under the Apache License, Version 2.1.", "Licensed under the Apache License, Version 1.1.", "Released under the Apache License.",
                 "Released under the BSD License.", "This work is licensed under the GNU General Public License, version 2.",
                 "This work is licensed under the GNU Lesser General Public License, version 3.", "Licensed under CC BY-ND 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                 "This work is licensed under a Creative Commons Attribution 3.0 International License.",
                 "This work is not licensed under the GNU General Public License, version 3.", "No rights reserved.", "Not released under the MIT License."[4:].replace("the", "no")):
        assert scanner.best(text) is None, text
    near = scanner.blocks("Licensed under the Apache License, Version 1.1.")
    assert [(x[2], x[4], x[5], x[6]) for x in near] == [("Apache-2.0", 1, ["-2.0 +1.1"], True)]
    assert scanner.best("A license for nothing but driving, issued by the county office on request") is None
    assert scanner.best("") is None or scanner.best("")[2] == 0
    many = scanner.blocks("Released under the MIT License. Licensed under the BSD License, Version 2.0.\n" * 500)
    assert [(x[2], x[6]) for x in many] == [("MIT", False), ("Apache-2.0", True)] * 500


def test_reach_is_the_edit_distance(monkeypatch):
    rng = random.Random(11)
    for k in range(1500):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        b = list(a)
        for _ in range(rng.randint(0, 9)):
            at = rng.randint(0, len(b))
            b[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "d"])
        b = "".join(b) if k % 4 else "".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        limit = rng.randint(0, 9)
        assert line_dedup.reachable(a, b, limit) == (distance(a, b) <= limit), (a, b, limit)
    # unrelated texts: only diagonals that can still lead to the end are followed
    calls, common = [], line_dedup._common
    monkeypatch.setattr(line_dedup, "_common", lambda *x: calls.append(x) or common(*x))
    a, b = ("".join(rng.choice("abcdefgh") for _ in range(1000)) for _ in range(2))
    assert not line_dedup.reachable(a, b, 20)
    assert len(calls) < 21 * 21 / 2
