"""Links resolved again by changed keys equal those of a rebuild; triage by target and reason; named targets."""

import random

import pytest

from vaultql.operators import graph
from vaultql.operators import validate as C
from vaultql.operators.find import Query
from vaultql.sources import markdown
from vaultql.streaming import audit

NAMES = ["a", "B", "c", "x/a", "x/d", "y/c", "y/e.v2"]


def text(rng):
    meta = rng.choice(["", "---\naliases: [al, Be]\n---\n", "---\naliases: al\n---\n", "---\nup: '[[c]]'\n---\n"])
    target = lambda: rng.choice(["a", "b", "B.md", "x/a", "X/D", "c#Part", "c#^id", "al", "be", "", "nope", "y/e.v2"])
    lines = [rng.choice([f"[[{target()}]]", f"![[{target()}]]", f"[t]({target().replace(' ', '')}.md)", "# Part", "text ^id", f"[t](../{target()})"]) for _ in range(rng.randint(0, 6))]
    return (meta + "\n".join(lines) + "\n").encode()


@pytest.mark.parametrize("seed", [1, 2])
def test_refresh_by_keys_equals_a_rebuild(spark, seed):
    rng = random.Random(seed)
    before = {f"{n}.md": text(rng) for n in NAMES if rng.random() < 0.8} | {"old.md": b"[[a]]", "keep.md": b"[[c#Part]] [[al]] ![[x/a]]"}
    after = {p: (text(rng) if rng.random() < 0.3 else t) for p, t in before.items() if rng.random() < 0.8 or p == "keep.md"} | {f"{n}.md": text(rng) for n in ("x/a", "new", "z/a")}
    frame = lambda rows: spark.createDataFrame(sorted(rows.items()), "path string, content binary")
    full = lambda rows, pics: _resolved(markdown.relations(markdown.parse_files(frame(rows))), spark.createDataFrame([(p,) for p in [*rows, *pics]], "path string"))
    old, want = full(before, ["p.png"]), full(after, ["q.png"])["links"]
    changed = {p: t for p, t in after.items() if before.get(p) != t}
    gone = spark.createDataFrame([(p,) for p in before if p not in after] or [("none",)], "path string")
    got = audit.refreshed(old, markdown.parse_files(frame(changed)), gone, spark.createDataFrame([(p,) for p in [*after, "q.png"]], "path string"))["links"]
    shown = lambda f: sorted(map(str, f.select(*sorted(want.columns)).collect()))
    assert shown(got) == shown(want)
    assert {"resolved", "unresolved"} <= {r.status for r in got.collect()}


def _resolved(r, files):
    r["files"] = files
    r["links"] = graph.resolve(r["links"], files, r["documents"], r["headings"], r["block_ids"], graph.aliases_of(r["documents"]))
    return r


def test_triage_by_target_and_reason(spark):
    links = spark.createDataFrame([("a.md", "x", "unresolved", "target-missing"), ("a.md", "y", "unresolved", "anchor-missing"), ("b.md", "z", "ambiguous", None), ("b.md", "w", "resolved", None)], "source_path string, target string, status string, reason string")
    found = C.link_findings(links, details=True)
    codes = lambda **asked: sorted(r.code for r in C.triage(found, **asked).collect())
    assert codes(target="x,z") == ["link-ambiguous", "link-target-missing"] and codes(reason="anchor-missing", path="a*") == ["link-anchor-missing"] and codes(target="w") == []
    assert C.triage(C.link_findings(links), target="x").collect() == []
    with pytest.raises(ValueError, match="colour"):
        C.triage(found, colour="red")


def test_links_to_named(spark):
    docs = spark.createDataFrame([("a.md", "a"), ("d/a.md", "a"), ("b.md", "b")], "path string, stem string")
    links = spark.createDataFrame([("a.md", "b.md", "resolved"), ("b.md", "d/a.md", "resolved")], "source_path string, resolved_path string, status string")
    aliases = spark.createDataFrame([("b.md", "bee")], "doc_path string, alias string")
    q = Query(docs, links=links)
    assert [r.path for r in q.links_to_named("[[B]]").frame().collect()] == ["a.md"] == [r.path for r in q.links_to_named("Bee", aliases=aliases).frame().collect()]
    assert [r.path for r in q.links_to_named("d/a.md").frame().collect()] == ["b.md"]
    for name, what in (("nope", "no document"), ("a", "several")):
        with pytest.raises(LookupError, match=what):
            q.links_to_named(name)


def test_a_name_that_very_many_share(spark):
    docs = spark.range(5000).selectExpr("concat('d', lpad(id, 5, '0'), '/Same.md') AS path", "'Same' AS stem").unionByName(spark.createDataFrame([("one.md", "one")], "path string, stem string"))
    links = spark.createDataFrame([("x.md", "wikilink", "same"), ("x.md", "wikilink", "one"), ("x.md", "wikilink", "none")], "source_path string, kind string, target string").selectExpr("*", "CAST(NULL AS string) AS anchor", "CAST(NULL AS string) AS block_ref")
    none = spark.createDataFrame([], "doc_path string, slug string, block_id string")
    out = graph.resolve(links, docs.select("path"), docs, none, none)
    got = {r.target: r for r in out.collect()}
    assert got["same"].status == "ambiguous" and got["same"].candidates == [f"d{k:05}/Same.md" for k in range(graph.MOST_CANDIDATES)] and got["same"].resolved_path is None
    assert got["one"].resolved_path == "one.md" and got["none"].status == "unresolved"
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    rows = graph.candidate_rows(links, docs)
    assert rows.groupBy("target", "n").count().collect()[0]["count"] in (5000, 1) and {(r.target, r.n) for r in rows.select("target", "n").distinct().collect()} == {("same", 5000), ("one", 1)}


def test_namesakes_are_counted_in_full(spark):
    docs = spark.range(250).selectExpr("concat('d', id, '/Same.md') AS path", "'Same' AS stem")
    owners = spark.range(130).selectExpr("concat('d', id, '/Same.md') AS doc_path", "'al' AS alias")
    links = spark.createDataFrame([("wikilink", "same"), ("embed", "al"), ("wikilink", "d1/Same"), ("wikilink", "none")], "kind string, target string").selectExpr("'x.md' AS source_path", "*", "CAST(NULL AS string) AS anchor", "CAST(NULL AS string) AS block_ref")
    none = spark.createDataFrame([], "doc_path string, slug string, block_id string")
    out = graph.resolve(links, docs.select("path"), docs, none, none, owners)
    assert {(r.target, r.n_candidates) for r in out.collect()} == {("same", 250), ("al", 130), ("d1/Same", 1), ("none", 0)}
    keyed = graph.resolve_by_key(links.select(graph.F.lower("target").alias("stem")), docs.select(graph.F.lower("stem").alias("stem"), "path"), "stem")
    assert {(r.stem, r.n_candidates, r.status) for r in keyed.collect()} == {("same", 250, "ambiguous"), ("al", 0, "unresolved"), ("d1/same", 0, "unresolved"), ("none", 0, "unresolved")}
