"""Operator 11 against brute force over whole texts."""

import hashlib
import random
from collections import Counter

import pytest

from vaultql.llm import alignment
from vaultql.llm.alignment import BYTE_LEVEL, PIECES, Aligner, Tokenizers, align_tokens, load_tokenizers

SCHEMA = "doc_id long, text string, n_a string, _vq_row int"


@pytest.fixture(scope="module")
def files():
    with open(PIECES, "rb") as f:
        return Tokenizers(open(BYTE_LEVEL).read(), f.read())


def texts(seed, n=60):
    rng = random.Random(seed)
    parts = [" the", " of", "onhe", " Éreté", ".", ",", "\n", "\n\n", "  ", "\t", " 12.5", " it's", "中文", " a|b", "<s>", "<|endoftext|>", "<0x0A>", "\x00", "🙂", " x" * 9, "ﬁ", "é", "\x85", "　", "'ll", "q" * 30]
    made = ["".join(rng.choices(parts, k=rng.randint(1, 50))) for _ in range(n)]
    return made + [None, "", " ", "\n", "a▁b", "▁ the", made[3], made[3], "the " * 2000, "z" * 5000]


def brute(files, rows):
    know = Aligner(files)
    found, pairs = [], Counter()
    for i, t in rows:
        a = know.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = know.b.encode(t) if t else []
        if t and not b"".join(know.a_bytes[x] for x in a) == (" " + t).encode() == b"".join(know.b_bytes[x] for x in b):
            a = b = []
        spans = []
        for ids, table in ((a, know.a_bytes), (b, know.b_bytes)):
            at, own = 0, []
            for x in ids:
                own.append((at, at + len(table[x]), x))
                at += len(table[x])
            spans.append(own)
        links, j = [], 0
        for s, e, x in spans[0]:
            while j and spans[1][j][0] > s:
                j -= 1
            while j < len(spans[1]) and spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((x, spans[1][k][2]))
                k += 1
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(x) for s, e, x in side if low <= s and e <= c) for side in spans) if len(t) < 3000 else "")
            low = c
        pairs.update(links)
        found.append((i, len(a), len(b), len(groups), links, ";".join(groups)))
    best = Counter()
    for (_, b), n in pairs.items():
        best[b] = max(best[b], n)
    return [
        (i, a, b, g, len(links), sum(pairs[x] == best[x[1]] for x in links), sum(pairs[x] for x in links), t, hashlib.sha256(t.encode()).hexdigest() if t else "")
        for i, a, b, g, links, t in found
    ]


@pytest.mark.parametrize("seed, hot, text, aligned, remembered", [(1, 1 << 18, 4_000_000, 2_000_000, 600_000), (2, 20, 300, 100, 50), (3, 0, 4000, 900, 200)])
def test_align_tokens(spark, files, seed, hot, text, aligned, remembered, monkeypatch):
    for name, value in (("TEXT", text), ("ALIGNED", aligned), ("REMEMBERED", remembered)):
        monkeypatch.setattr(alignment, name, value)
    rows = [(None if i == 5 else i % 60, t) for i, t in enumerate(texts(seed))]
    docs = spark.createDataFrame([(i, t, "gone", 1) for i, t in rows], SCHEMA).repartition(3)
    got = align_tokens(docs, files, hot_pairs=hot, keep=["doc_id", "text"]).collect()
    want = brute(files, rows)
    short = lambda r: (str(r[0]), *r[1:7], r[7:] if r[7] and len(r[7]) < 9000 else "long")
    own = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups, r.groups_sha256) for r in got]
    by_text = {t: w[7] for (_, t), w in zip(rows, want, strict=True)}
    assert all(r.groups == by_text[r.text] for r in got if r.text is None or len(r.text) < 3000)
    assert sorted(map(lambda r: short(r)[:7], own)) == sorted(map(lambda r: short(r)[:7], want))
    assert all(r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in got)
    assert sum(w[3] == 0 for w in want) == 4 and sum(w[6] for w in want) > 10_000


def test_whole_texts_where_a_vocabulary_crosses(files, monkeypatch):
    """Without places to cut, whole texts are aligned, with the same result."""
    know = Aligner(files)
    whole = Aligner(files)
    whole.cut, whole.segments = False, (lambda t: [t])
    for t in texts(7):
        if t and "▁" not in t:
            parts = know.segments(" " + t)
            know.learn([s for s in dict.fromkeys(parts) if s not in know.index])
            whole.learn([" " + t] if " " + t not in whole.index else [])
            ids = [know.index[s] for s in parts]
            assert know.counts[ids].sum(0).tolist() == whole.counts[whole.index[" " + t]].tolist()
            assert ";".join(know.groups[i] for i in ids) == whole.groups[whole.index[" " + t]]


def test_empty_table_and_load(spark, files):
    assert load_tokenizers(spark) == files == load_tokenizers(spark, "file://" + BYTE_LEVEL, "file://" + PIECES)
    assert align_tokens(spark.createDataFrame([], SCHEMA), files).collect() == []
