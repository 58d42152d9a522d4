"""The scanner against plain patterns, and on long texts of each form."""

import random
import re
import time

import pyarrow as pa
import pytest

from vaultql.sources import markdown as M

PARTS = ["[[a]]", "![[b|c]]", "[[", "]]", "[", "]", "!", "x", "é\n", "[[]]", "[[[z]]"]


def test_double_brackets_are_the_leftmost_ones():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choices(PARTS, k=rng.randint(1, 14)))
        want = [(m.start(), m.end(), m[2]) for m in re.finditer(r"(!?)\[\[([^\]]+)\]\]", text)]
        assert list(M._double_brackets(text)) == want, text


def test_places_are_those_of_a_count_from_the_start():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choices(["a", "é", "\n", "😀", "\r\n", "\x0c"], k=rng.randint(1, 60)))
        place = M._Places(text, 3, 17)
        for at in sorted(rng.choices(range(len(text)), k=5)) + [0]:
            begin = text.rfind("\n", 0, at) + 1
            assert place(at) == (3 + text.count("\n", 0, at) + 1, len(text[begin:at].encode()) + 1, 17 + len(text[:at].encode()))


def test_links_hold_no_links_but_images_may():
    found = [(label, address) for _, _, label, address in M._inline_links(r"[a [b](c) d](e) ![i [j](k)](l) \[no](x) [m](<n o>) [p](q 'r') [s](t(u)v) [w]()")]
    assert found == [("b", "c"), ("j", "k"), ("i [j](k)", "l"), ("m", "n o"), ("p", "q"), ("s", "t(u)v"), ("w", "")]


@pytest.mark.parametrize("form, n", [("# H\n", 1), ("[", 4), ("[[", 2), ("[a](b.md) ", 1), ("é [[a]] ", 1), ("[[a]]\n", 1), ("[a](b ", 1), ("[[a]", 1), ("[a][", 1), ("![", 2)])
def test_long_texts_take_time_in_proportion(form, n):
    def took(size):
        began = time.process_time()
        M.parse("p.md", (form * (size // len(form.encode()))).encode())
        return time.process_time() - began

    small, large = min(took(50_000) for _ in range(3)), took(400_000)
    assert large < 8 * 4 * small + 0.5


def test_batches_are_cut_by_bytes(spark):
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 3000 + ["y" * (3 << 20), "z"])], names=["a"])
    parts = list(M.pieces(batch))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and all(p.num_rows == 1 or p.nbytes <= 1 << 20 for p in parts) and len(parts) > 5
    files = spark.range(3000, numPartitions=1).selectExpr("concat(id, '.md') AS path", "CAST(concat('# ', id, '\n', repeat('word ', 200), '[[', id, ']]') AS binary) AS content")
    r = M.relations(M.parse_files(files))
    assert r["links"].where("source_path = concat(target, '.md')").count() == 3000 == r["headings"].where("doc_path = concat(text, '.md')").count()


def test_plain_texts_take_no_scan(monkeypatch):
    """Text without marks of code, links or headings isn't looked at line by line; with them the result is the full scan's."""
    text = "some words\nand more\n" * 50
    monkeypatch.setattr(M, "inside", lambda *a, **k: pytest.fail("a line was scanned"))
    monkeypatch.setattr(M, "_inline_links", lambda *a: pytest.fail("links were looked for"))
    assert M.masked(text) == text and M.parse("p.md", text.encode())["headings"] == []
    monkeypatch.undo()
    full = M.parse("p.md", b"---\na: '[[y]]'\n---\n# A\n\nB\n---\n\n    [[no]]\n\n`[[no]]` [t](x.md) [r] ^id\n\n[r]: z.md\n")
    assert [x[2] for x in full["links"]] == ["y", "x.md", "z.md"] and [h[1] for h in full["headings"]] == ["A", "B"] and full["block_ids"] == ["id"]
