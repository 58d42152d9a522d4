"""Truths of predicates, patterns, links, edits and streams on small hand-made inputs."""

import json

import pytest
from pyspark.sql import functions as F

from vaultql.functions import globs
from vaultql.functions import values as V
from vaultql.operators import graph as G
from vaultql.operators import mutate as M
from vaultql.operators import repair as R
from vaultql.operators.find import Query, page
from vaultql.sources import markdown
from vaultql.streaming import audit

ROWS = {
    "a": {"s": "alpha", "n": 5, "f": 5.0, "b": True, "tags": ["x", "[[y]]"], "d": "2024-01-05"},
    "b": {"s": "[[alpha]]", "n": 1, "b": False, "tags": [], "d": "2024-01-05T10:00", "z": None},
    "c": {"s": "Alpha", "n": "5", "b": 1, "tags": "x", "o": {"k": 1}},
    "d": {"s": "", "tags": [None], "n": [1, 5]},
}


@pytest.fixture(scope="module")
def q(spark):
    frame = spark.createDataFrame([(k, k, json.dumps(v), f"Body 100% of {k.upper()} É") for k, v in ROWS.items()], "path string, stem string, j string, body string")
    return Query(frame.withColumn("metadata", F.parse_json("j")))


@pytest.mark.parametrize(("make", "want"), [
    (lambda q: q.eq("s", "alpha"), "ab"), (lambda q: q.eq("s", "[[alpha]]"), "ab"), (lambda q: q.eq("n", 5), "ad"), (lambda q: q.eq("n", "5"), "c"),
    (lambda q: q.eq("f", 5), "a"), (lambda q: q.eq("b", True), "ac"), (lambda q: q.eq("b", 1), "ac"), (lambda q: q.eq("tags", "y"), "a"),
    (lambda q: q.not_eq("tags", "x"), "bd"), (lambda q: q.not_eq("z", 1), ""), (lambda q: q.isin("s", ["Alpha", ""]), "cd"), (lambda q: q.isin("s", []), ""),
    (lambda q: q.not_in("tags", ["x", "q"]), "bd"), (lambda q: q.not_in("s", []).has("s"), "abcd"), (lambda q: q.has("z"), ""), (lambda q: q.missing("z"), "abcd"),
    (lambda q: q.has("tags"), "abcd"), (lambda q: q.starts_with("s", "al"), "ab"), (lambda q: q.contains("b", "tru"), "a"), (lambda q: q.ends_with("tags", "y"), "a"),
    (lambda q: q.starts_with("s", "[["), ""), (lambda q: q.before("d", "2024-01-05T"), "a"), (lambda q: q.on("d", "2024-01-05"), "a"), (lambda q: q.after("d", "2024-01-05"), "b"),
    (lambda q: q.text("body 1%a"), "a"), (lambda q: q.text("é"), ""), (lambda q: q.path("[ab]"), "ab"), (lambda q: q.path("{a,c}", "[d"), "ac"), (lambda q: q.eq("o", '{"k":1}'), "c"),
])
def test_predicates(q, make, want):
    assert "".join(sorted(r.path for r in make(q).frame().collect())) == want


def test_sort_and_gate(q):
    assert [r.path for r in q.sorted("n", everything=True).collect()][0:2] == ["b", "a"]
    assert [r.path for r in page(q.sorted("s", descending=True, everything=True), 2, 2).collect()] == ["b", "c"]
    with pytest.raises(ValueError):
        q.frame()


def test_coercion_and_globs():
    assert [V.coerced(x) for x in ("true", "5", "5.5", "x")] == [True, 5, 5.5, "x"]
    import re

    hit = lambda g, p: re.match(globs.path_regex(g).replace("(?<", "(?P<"), p) is not None
    assert hit("/a/**", "a/b.md") and hit("a/*/c.md", "a/b/c.md") and not hit("a/*.md", "a/b/c.md") and hit("**/c.md", "c.md") and hit("{{x}}/n.md", "p/n.md")
    assert re.match(globs.ignore_regex("a/**/b"), "a/x/y/b") and not re.match(globs.ignore_regex("a*"), "ab/c")


def test_markdown_tree(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "x.md").write_text("[[one]]")
    (tmp_path / "one.md").write_text("---\ndate: 2024-01-01\nok: yes\naliases: [First, 42]\nup: '[[two]]'\n---\n# One A\n[[two#Part B|label]] `[[no]]` ![[pic.png]]\n```\n[[no]]\n```\n[t](sub/two.md#part-b) [[#One A]] [w](https://x.y) [[first]] [[gone]] text ^blk\n")
    (tmp_path / "sub" / "two.md").write_text("## Part B\n[[one#^blk]] [[one#missing]] [r][ref]\n\n[ref]: ../one.md\n")
    (tmp_path / "bad.md").write_text("---\na: [1\n---\nx\n")
    (tmp_path / "pic.png").write_bytes(b"\x89")
    files, parsed = markdown.read_tree(spark, str(tmp_path))
    r = markdown.relations(parsed)
    assert sorted(x.path for x in files.collect()) == ["bad.md", "one.md", "pic.png", "sub/two.md"]
    meta = {x.path: x.frontmatter_json for x in r["documents"].collect()}
    assert json.loads(meta["one.md"])["date"] == "2024-01-01" and json.loads(meta["one.md"])["ok"] == "yes" and meta["bad.md"] is None
    assert [x.code for x in r["diagnostics"].collect()] == ["frontmatter-parse-failed"]
    aliases = G.aliases_of(r["documents"])
    assert sorted(x.alias for x in aliases.collect()) == ["42", "first"]
    links = G.resolve(r["links"], files, r["documents"], r["headings"], r["block_ids"], aliases)
    got = sorted((x.source_path, x.raw, x.status, x.resolved_path, x.reason) for x in links.collect())
    want = [
        ("one.md", "![[pic.png]]", "resolved", "pic.png", None), ("one.md", "[[#One A]]", "resolved", "one.md", None), ("one.md", "[[first]]", "resolved", "one.md", None),
        ("one.md", "[[gone]]", "unresolved", None, "target-missing"), ("one.md", "[[two#Part B|label]]", "resolved", "sub/two.md", None), ("one.md", "[[two]]", "resolved", "sub/two.md", None),
        ("one.md", "[t](sub/two.md#part-b)", "resolved", "sub/two.md", None), ("sub/two.md", "[[one#^blk]]", "resolved", "one.md", None),
        ("sub/two.md", "[[one#missing]]", "unresolved", "one.md", "anchor-missing"), ("sub/two.md", "[r][ref]", "resolved", "one.md", None),
    ]
    assert got == sorted(want)
    assert [x.path for x in G.lookup(r["documents"], aliases, "[[TWO|x]]").collect()] == ["sub/two.md"]


def test_edits(spark):
    body = "# A\none\n## B\ntwo\n# C\nthree\n"
    assert M.edited(body, [("replace_section", "B", "new"), ("append_to_section", "C", "end")]) == "# A\none\n## B\nnew\n# C\nthree\nend\n"
    assert M.edited(body, [("delete_section", "A", "")]) == "# C\nthree\n"
    fenced = "# A\none\n\n```\n# A\n```\n\n# B\ntwo  \n"
    assert M.edited(fenced, [("append_to_section", "A", "\nmore\n")]) == "# A\none\n\n```\n# A\n```\nmore\n\n# B\ntwo  \n"
    assert M.edited(fenced, [("delete_section", "A", "")]) == "# B\ntwo  \n" and M.edited(fenced, [("append_to_section", "B", "x")]).endswith("two\nx\n")
    assert M.edited("a a", [("replace_all", "a", "b")]) == "b b" and M.relinked("[[x|l]] ![[x#h]] `[[x]]` [[xy]]", {"x": "z"}) == "[[z|l]] ![[z#h]] `[[x]]` [[xy]]"
    with pytest.raises(M.EditRefused):
        M.edited("a a", [("str_replace", "", "b")])
    assert M.set_key("a: 1\nb:\n- x\nc: 2\n", "b", "3") == "a: 1\nb: 3\nc: 2\n"
    docs = spark.createDataFrame([("x", body, "h"), ("y", body, "h")], "path string, body string, hash string")
    edits = spark.createDataFrame([("x", 0, "str_replace", "one", "1", "h"), ("y", 0, "str_replace", "two", "2", "h"), ("y", 1, "str_replace", "no", "", "h"), ("z", 0, "str_replace", "a", "b", None)], "path string, position int, op string, target string, text string, expected_hash string")
    got = {r.path: (r.refused, r.body) for r in M.apply_edits(docs, edits).collect()}
    assert got == {"x": (None, body.replace("one", "1")), "y": ("match-missing", body), "z": ("path-missing", None)}


def test_closest_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    stems = sorted({"".join(rng.choices("abcd", k=rng.randint(1, 12))) for _ in range(150)})
    broken = sorted({"".join(rng.choices("abcd", k=rng.randint(1, 12))) for _ in range(60)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {}
    for t in broken:
        scored = [(1 - distance(t, s) / max(len(t), len(s)), s) for s in stems]
        top = max(x for x, _ in scored)
        best = [s for x, s in scored if x == top]
        want[t] = ("none", None) if top < 0.7 else ("ambiguous", None) if len(best) > 1 else ("high" if top == 1 else "medium", best[0])
    got = R.closest(spark.createDataFrame([(t,) for t in broken], "target string"), spark.createDataFrame([(s,) for s in stems], "stem string"))
    assert {r.target: (r.outcome, r.stem) for r in got.collect()} == want


def test_audit_stream(spark, tmp_path):
    lines = [{"Timestamp": f"2024-01-0{d}T0{h}:00:00Z", "TraceId": "t", "SpanId": f"s{d}{h}", "EventName": "e", "Attributes": {"target": "x", "status": "ok"}} for d in (1, 2) for h in (1, 2)]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "events-2024-01-01.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    batch = audit.read(spark, str(tmp_path / "log"))
    assert batch.count() == 4 and [r.span for r in audit.newest(audit.select(batch, target="x", until="2024-01-01"), 1).collect()] == ["s12"]
    made = audit.windowed(audit.once(audit.stream(spark, str(tmp_path / "log"))), "1 day")
    run = made.writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    assert [(r.event, r.n) for r in spark.table("windows").collect()] == [("e", 2)]


def test_maintained_snapshots(spark, tmp_path):
    for k, rows in enumerate([[("a", "1", 1), ("b", "1", 1)], [("a", "2", 2), ("c", "1", 2)]]):
        spark.createDataFrame(rows, "path string, hash string, seen long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("path string, hash string, seen long").parquet(str(tmp_path / "in"))
        run = audit.maintain(source, str(tmp_path / "out"), str(tmp_path / "ck")).start()
        run.processAllAvailable()
        run.stop()
    like = spark.createDataFrame([], "path string, hash string, seen long")
    shown = lambda below: sorted((r.path, r.hash) for r in audit.current(spark, str(tmp_path / "out"), like, below).collect())
    assert shown(None) == [("a", "2"), ("b", "1"), ("c", "1")] and shown(1) == [("a", "1"), ("b", "1")]
