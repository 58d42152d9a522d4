"""Operator 12 against brute force."""

import hashlib
import random
import zlib

import pytest

from vaultql.llm import trie
from vaultql.llm.trie import prefix_trie, rebuilt_conversations

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def brute(rows):
    by = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    by = {c: [x[2:] for x in sorted(t)] for c, t in by.items()}
    made = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        made[c] = tuple(by.get(base, [])[:h] + own[h:])
    nodes = {}
    for c, t in made.items():
        for d in range(len(t) + 1):
            nodes.setdefault(t[:d], []).append(c)
    kids = {}
    for n in nodes:
        if n:
            kids.setdefault(n[:-1], []).append(n)
    out, total = [], {}
    for n in sorted(nodes, key=len, reverse=True):
        leaves, saved = total.get(n, (0, 0))
        leaves += n not in kids
        saved += (len(nodes[n]) - 1) * len(n[-1][1].encode()) if n else 0
        if n:
            up = total.get(n[:-1], (0, 0))
            total[n[:-1]] = up[0] + leaves, up[1] + saved
        ends = ",".join(str(c) for c in sorted(c for c in nodes[n] if made[c] == n))
        out.append((min(nodes[n]), len(n), min(nodes[n[:-1]]) if n else None, len(nodes[n]), len(kids.get(n, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n=120):
    rng = random.Random(seed)
    texts = ["", "a", "bé", "long text " * 20, None, "x y"]
    rows = []
    for c in rng.sample(range(-20, n), n - 10):
        same = rng.random() < 0.5
        for turn in range(rng.choice([1, 2, 3, 8, 12, 30])):
            text = texts[turn % 3] if same and turn < 6 else rng.choice(texts)
            rows.append((c, None if turn == 3 else turn, rng.choice(["user", None]) if turn > 4 else "user", text, "x"))
    rows += rows[:7] + [(None, 1, "user", "nobody's", "x"), (7, 1, "tie", "b", "x"), (7, 1, "tie", "a", "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, part", [(1, 1 << 16), (2, 8)])
def test_prefix_trie(spark, seed, part, monkeypatch):
    monkeypatch.setattr(trie, "PART", part)
    rows = conversations(seed)
    got = prefix_trie(*rebuilt_conversations(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    got = sorted((tuple(r) for r in got.collect()), key=repr)
    assert got == brute(rows) and len(got) > 300
    assert max(n[3] for n in got if n[1] > 1) > 20


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x", "")], [(3, None, None, None, "")], [(8, 0, "user", "x", ""), (9, 0, "user", "x", "")]])
def test_small_tables(spark, rows):
    got = prefix_trie(*rebuilt_conversations(spark.createDataFrame(rows, SCHEMA)))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_many_copies_and_a_long_conversation(spark):
    """A third of all conversations are equal, and one has 3000 turns with a light edge at each."""
    rows = [(c, t, "user", f"t{t}", "") for c in range(0, 2000, 5) for t in range(9)]
    rows += [(5000, t, "user", f"L{t}", "") for t in range(3000)]
    rows += [(10_000 + 5 * k, t, "user", f"L{t}" if t < 9 + k else f"{k}", "") for k in range(0, 300, 10) for t in range(10 + k)]
    got = prefix_trie(*rebuilt_conversations(spark.createDataFrame(rows, SCHEMA)))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)
