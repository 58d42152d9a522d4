"""Operator 13 against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest

from vaultql.llm import windows
from vaultql.llm.windows import SuperKmers, remove_repeated_windows

SCHEMA = "doc_id long, text string, n_words string, extra int"


def corpus(seed, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcDé", k=rng.randint(1, 3)))
    passages = [[word() for _ in range(length + rng.randint(0, 40))] for _ in range(4)]
    texts = []
    for _ in range(90):
        words = [word() for _ in range(rng.choice([0, 1, length - 1, length, 2 * length, 90]))]
        kind = rng.random()
        if kind < 0.25 and texts:
            words = re.findall(r"[^ \n\t]+", rng.choice(texts))
            if words and rng.random() < 0.7:
                words[rng.randrange(len(words))] = word()
        elif kind < 0.6:
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            words[len(words) // 2 : len(words) // 2] = p[a : a + rng.randint(length - 2, length + 30)]
        elif kind < 0.7:
            words = ["x"] * rng.randint(length - 1, 2 * length)
        elif kind < 0.75:
            words = words + words
        texts.append("".join(w + rng.choice([" ", "\n", "  ", "\t"]) for w in words))
    rows = [(i, t, "x", i) for i, t in enumerate(texts)]
    return rows + [(5, texts[7], "x", 0), (9, texts[9], "x", 0), (None, texts[3], "x", 0), (None, None, None, None), (95, "", "x", 1), (96, " \n", "x", 1)]


def brute(rows, length):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    found = [(i, word.findall(t or "")) for i, t, *_ in rows]
    count = Counter(tuple(w[k : k + length]) for _, w in found for k in range(len(w) - length + 1))
    out = []
    for i, w in found:
        gone = set()
        for k in range(len(w) - length + 1):
            if count[tuple(w[k : k + length])] > 1:
                gone.update(range(k, k + length))
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed, length, hot, chunk, block", [(1, 35, 5000, 1 << 20, 1 << 20), (2, 9, 5000, 50, 16), (3, 35, 1, 7, 100), (4, 1, 2, 30, 1 << 20)])
def test_remove_repeated_windows(spark, seed, length, hot, chunk, block, monkeypatch):
    monkeypatch.setattr(windows, "CHUNK", chunk)
    monkeypatch.setattr(windows, "BLOCK", block)
    rows = corpus(seed, length)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 AS _vq_key", "'x' AS key", "'y' AS _vq_found")
    got = remove_repeated_windows(docs, length=length, hot_strings=hot).collect()
    want = brute(rows, length)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert {r.key for r in got} == {"x"} and sum(w[2] for w in want) > 200
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 and sum(r.removed[1::2]) - sum(r.removed[::2]) == r.n_removed for r in got)


def test_empty_table_and_a_very_long_text(spark):
    assert remove_repeated_windows(spark.createDataFrame([], SCHEMA)).collect() == []
    passage = " ".join(f"p{k}" for k in range(60))
    long = " ".join(f"w{k}" for k in range(400_000)) + "\n" + passage + " end"
    rows = [(1, long), (2, "a b " + passage.replace(" ", "\t")), (3, "c " * 30)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in remove_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"]).collect()}
    assert got == {1: (400_061, 60), 2: (62, 60), 3: (30, 0)}


def test_one_string_in_many_contexts(spark):
    """A run of words in 3000 texts, each in its own context: one bucket of many strings, dealt out by window."""
    run = " ".join(f"r{k}" for k in range(40))
    rows = [(i, " ".join(f"{i}a{k}" for k in range(30)) + " " + run + " " + " ".join(f"{i}b{k}" for k in range(30))) for i in range(3000)]
    got = remove_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"], hot_strings=100).collect()
    assert {(r.n_words, r.n_removed) for r in got} == {(100, 40)} and len(got) == 3000


def test_equal_windows_have_one_bucket_and_place():
    a = SuperKmers(b" ".join(b"w%d" % (k % 11) for k in range(200)), 35)
    assert (a.stop - a.start).max() <= 35 - windows.gram_size(35) + 1
    by = {}
    for i in range(len(a.start)):
        words = a.packed(i).split(b" ")
        each = [tuple(words[k : k + 35]) for k in range(a.stop[i] - a.start[i])]
        assert len(set(each)) == len(each)
        for w in each:
            assert by.setdefault(w, a.bucket[i]) == a.bucket[i]
