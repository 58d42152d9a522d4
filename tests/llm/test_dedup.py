"""Operators 1, 3 and 4 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from vaultql.llm import substrings
from vaultql.llm.decontaminate import decontaminate
from vaultql.llm.neardup import near_duplicates
from vaultql.llm.substrings import remove_repeats

SCHEMA = "doc_id long, text string, n_words string, extra int"


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(150)]
    passage = [" ".join(rng.choices(vocabulary, k=40)) for _ in range(4)]
    texts = []
    for _ in range(n):
        words = " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 8, 30, 90])))
        kind = rng.random()
        if kind < 0.35 and texts:
            words = rng.choice(texts) or ""
            if rng.random() < 0.7:
                parts = words.split(" ")
                parts[rng.randrange(len(parts))] = rng.choice(vocabulary).upper()
                words = " ".join(parts)
        elif kind < 0.5:
            words = words + " " + rng.choice(passage) + "\n" + words
        elif kind < 0.55:
            words = "a" * rng.randint(40, 200)
        texts.append(words if rng.random() < 0.97 else None)
    rows = [(i, t, "x", i) for i, t in enumerate(texts)]
    rows += [(5, "dup id " + (texts[7] or ""), "x", 0), (9, texts[9], "x", 0), (None, texts[3], "x", 0), (None, None, None, None)]
    rng.shuffle(rows)
    return rows, passage


def test_near_duplicates(spark):
    rows, _ = corpus()
    near = [(1000 + i, " ".join(f"w{j}" if j != 7 * i else "zz" for j in range(200)), "x", 0) for i in range(30)]
    rows += near
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), size=2).collect()

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t, *_ in rows]
    up = {i: i for i, _ in sets if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, o in sets[:k]:
            if i is not None and j is not None and s and o and 100 * len(s & o) >= 80 * len(s | o):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    want = sorted((-1 if i is None else i, len(s), -1 if i is None else root(i), i is None or root(i) == i) for i, s in sets)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept) for r in got) == want
    assert len({r.component_id for r in got}) < len(got)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_triggers_of_long_texts_are_those_of_short_ones(monkeypatch):
    rng = np.random.default_rng(5)
    values = rng.integers(0, 40, 5000, np.uint64) << np.uint64(7) | rng.integers(0, 128, 5000, np.uint64)  # ties above, none below
    monkeypatch.setattr(substrings, "_BITS", 8)
    got = substrings._leftmost_least(values, 31)
    high = values >> np.uint64(8)
    assert got.tolist() == [k + int(high[k : k + 31].argmin()) for k in range(5000 - 30)]


def test_a_long_text_shares_a_passage_with_a_short_one(spark):
    rng = random.Random(4)
    passage = "".join(rng.choices("abcdefgh ", k=300))
    long = "".join(rng.choices("ijklmnop", k=4096)) + "".join(map(str, range(2_900_000))) + passage + "!"
    assert len(long) > 1 << 24
    rows = [(1, long), (2, "<" * 60 + passage + ">"), (3, passage)]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"]).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].n_spans, got[3].n_removed) == (0, 300, 1, 300)


@pytest.mark.parametrize("seed, hot, chunk", [(1, 10_000, 1 << 20), (2, 10_000, 300), (2, 1, 40)])
def test_remove_repeats(spark, seed, hot, chunk, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", chunk)  # goes to the tasks with the functions
    rows, _ = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 AS _vq_phrases", "'x' AS doc")
    got = remove_repeats(docs, hot_rows=hot).collect()
    assert {r.doc for r in got} == {"x"}
    first = {}
    raws = [(i, (t or "").encode()) for i, t, *_ in rows]
    for i, b in raws:
        for p in range(len(b) - 49):
            if i is not None:
                first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    want = []
    for i, b in raws:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if i is not None and first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        want.append((-1 if i is None else i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    assert sum(w[2] for w in want) > 1000
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("block", [1 << 20, 150])
def test_decontaminate(spark, block):
    rows, passage = corpus(3)
    items = [(1, passage[0]), (2, passage[1][:60]), (3, "b"), (4, None), (5, "!!"), (None, passage[2]), (2, passage[3]), (7, rows[4][1])]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'kept' AS hit_items", "'gone' AS hits")
    got = decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block).collect()
    assert {r.hit_items for r in got} == {"kept"} and all(r.hits != "gone" for r in got)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = [(i, tuple(w[k : k + 13])) for i, t in items if i is not None for w in [low(t)] for k in range(max(1, len(w) - 12) if w else 0)]
    want = []
    for i, t, *_ in rows:
        w, hit, ids = low(t), set(), set()
        for item, x in windows:
            for p in range(len(w) - len(x) + 1):
                if tuple(w[p : p + len(x)]) == x:
                    hit.update(range(p, p + len(x)))
                    ids.add(str(item))
        want.append((-1 if i is None else i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(want)
    assert {"extra", "text"} <= set(got[0].asDict())
