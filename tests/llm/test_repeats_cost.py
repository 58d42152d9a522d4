"""op4's work: texts are parsed many at a time, and only suffixes that may have an equal one are sorted."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vaultql.llm import substrings
from vaultql.llm.substrings import Parsed, remove_repeats

LENGTH = 50


def phrases(n=400, seed=3):
    """Dictionary phrases of five triggers, in their order; the first trigger has more than all others."""
    rng = random.Random(seed)
    rows = []
    for doc in range(n):
        k = rng.choice([0, 0, 0, 0, 1, 2, 3, 4])
        head = f"{k}{rng.choice(['left', 'LEFT', str(doc)])}" + "x" * 20
        rows.append((k - 2, (head + f"trigger number {k}" + rng.choice("abcdefgh") * 30)[: rng.randint(LENGTH, 70)].encode(), doc, False))
    rows.append((7, bytes(range(100, 100 + LENGTH)), 9, True))  # known to repeat, so it needs no equal one
    return sorted(rows)


def suffixes_of(rows, per_batch):
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.bool_())
    table = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["dealt", "phrase", "doc", "known"])
    made = substrings._suffixes(LENGTH)(iter([table.slice(at, per_batch) for at in range(0, len(rows), per_batch)]))
    return [x for b in made for x in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)]


def test_suffixes_without_an_equal_one_are_not_sorted():
    rows = phrases()
    every = [(p[at : at + LENGTH], doc, known) for _, p, doc, known in rows for at in range(len(p) - LENGTH + 1)]
    times = Counter(s for s, *_ in every)
    want = sorted(x for x in every if times[x[0]] > 1 or x[2])
    assert 0 < len(want) < len(every) * 0.9
    assert sorted(suffixes_of(rows, 1000)) == want
    assert sorted(suffixes_of(rows, 7)) == want


@pytest.mark.parametrize("held", [1, 20, 90])
def test_a_trigger_that_a_task_cannot_hold_goes_on_whole(held, monkeypatch):
    monkeypatch.setattr(substrings, "HELD", held)
    rows = phrases()
    every = Counter((p[at : at + LENGTH], doc, known) for _, p, doc, known in rows for at in range(len(p) - LENGTH + 1))
    times = Counter(s for s, *_ in every.elements())
    for per_batch in (1, 7, 1000):
        got = Counter(suffixes_of(rows, per_batch))
        assert got <= every
        assert got >= Counter({x: n for x, n in every.items() if times[x[0]] > 1 or x[2]})


def test_a_run_of_texts_is_parsed_like_each_by_itself():
    rng = random.Random(5)
    raws = ["".join(rng.choices("ab é", k=rng.choice([0, 3, 40, 49, 50, 51, 200, 900]))).encode() for _ in range(80)]
    column = pa.array([*raws, None, b"z" * 60], pa.binary()).slice(1)
    values = [x or b"" for x in column.to_pylist()]

    def parsed(byte, edges):
        p = Parsed(byte, edges, LENGTH, names=True)
        return list(zip(p.text.tolist(), (p.start - edges[p.text]).tolist(), (p.stop - edges[p.text]).tolist(), p.trigger.tolist(), p.phrase.tolist(), p.name.tolist(), strict=True))

    alone = [(k, *x[1:]) for k, v in enumerate(values) for x in parsed(np.frombuffer(v, np.uint8), np.array([0, len(v)]))]
    assert {sum(stop - start for k, start, stop, *_ in alone if k == n) for n, v in enumerate(values) if len(v) == 51} == {2}
    for block in (1, 300, 1 << 16):
        runs = list(substrings._runs(column, block))
        assert [x for rows, *_ in runs for x in range(rows.start, rows.stop)] == list(range(len(values)))
        assert [(rows.start + k, *rest) for rows, byte, edges in runs for k, *rest in parsed(byte, edges)] == alone
        assert (len(runs) == 1) == (block == 1 << 16)


@pytest.mark.parametrize("block, held, chunk", [(1 << 16, 1 << 15, 1 << 20), (1, 3, 40), (700, 40, 300)])
def test_neighbours_that_go_as_a_whole_keep_their_own_spans(spark, block, held, chunk, monkeypatch):
    for name, value in (("BLOCK", block), ("HELD", held), ("CHUNK", chunk)):  # go to the tasks with the functions
        monkeypatch.setattr(substrings, name, value)
    rng = random.Random(6)
    base = ["".join(rng.choices("abcdefg é", k=300)) for _ in range(3)]
    texts = [base[0], base[0], base[0][:60], "", None, base[0][7:57], base[1], base[2] + base[1][100:160], "x" + base[2][:49], base[1] + base[2], base[1][:49]]
    for k in range(40):
        left, right = rng.randint(0, 240), rng.randint(0, 240)
        texts.append(f"{k}" + base[k % 3][left : left + 55] + f"<{k}>" + base[(k + 1) % 3][right : right + 58])
    raws = [(t or "").encode() for t in texts]
    first, want = {}, []
    for b in raws:
        gone = bytearray(len(b))
        for at in range(len(b) - LENGTH + 1):
            if first.setdefault(b[at : at + LENGTH], len(want)) < len(want):
                gone[at : at + LENGTH] = b"\1" * LENGTH
        edge = [k for k in range(len(b) + 1) if (k > 0 and gone[k - 1]) != (k < len(b) and gone[k])]
        want.append((len(want), len(b), sum(gone), len(edge) // 2, edge, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = remove_repeats(docs).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.removed, bytes(r.kept_text)) for r in got) == want
    assert sum(w[1] == w[2] > 0 for w in want) >= 3
