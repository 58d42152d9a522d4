"""Creation from rules, sequences and preconditions against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vaultql.operators import create as N
from vaultql.operators import mutate as M
from vaultql.operators.validate import Rule
from vaultql.sources import config

TEMPLATES = ["t/a-{{seq}}.md", "t/{{seq}}.md", "t/a1{{seq}}.md", "t/{{seq}}2.md", "u/a-{{seq}}.md", "{{seq}}", "t/b"]
WRONG = ["{{seq}}/a.md", "t/{{seq}}-{{seq}}.md", "{{seq}}/{{seq}}.md"]
THERE = ["t/a-7.md", "t/a-3.md", "t/a-.md", "t/a-1-2.md", "t/a1234.md", "t/92.md", "t/02.md", "u/x-9.md", "t/a-99999999999999999999.md", "t/a-4.txt", "5", "t/7x.md"]


def one_by_one(creates, there):
    names, out = list(there), []
    for _, path in creates:
        made = path
        if N.SEQ in path:
            if path.count(N.SEQ) != 1 or N.SEQ not in path.rsplit("/", 1)[-1]:
                out.append((path, "seq-misplaced"))
                continue
            prefix, suffix = path.split(N.SEQ)
            found = [int(m[1]) for n in names if (m := re.fullmatch(re.escape(prefix) + "([0-9]+)" + re.escape(suffix), n)) and int(m[1]) < 1 << 64]
            made = f"{prefix}{max(found, default=0) + 1}{suffix}"
        names.append(made)
        out.append((made, None))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_allocated_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    creates = []
    for i in range(200):
        kind = rng.random()
        path = rng.choice(WRONG) if kind < 0.05 else rng.choice(TEMPLATES[:2] + TEMPLATES[4:]).replace(N.SEQ, str(rng.randint(1, 300))) if kind < 0.2 else rng.choice(TEMPLATES)
        creates.append((i, path))
    docs = spark.createDataFrame([(p,) for p in THERE], "path string")
    frame = spark.createDataFrame(creates, "op_idx int, path string").repartition(5)
    got = N.allocated(frame, docs).orderBy("op_idx").collect()
    # scopes with digits of their own may see each other's numbers; brute force resolves them in turn, so they are apart here
    plain = [c for c in creates if "a1" not in c[1] and "}}2" not in c[1]]
    want = dict(zip([c[0] for c in plain], one_by_one(plain, THERE), strict=True))
    assert all((r.path, r.seq_refused) == want[r.op_idx] for r in got if r.op_idx in want)
    odd = [r.path for r in got if r.op_idx not in want]
    assert len(set(odd)) == len(odd) and "t/a1235.md" in odd and any(re.fullmatch(r"t/1?02\.md|t/[0-9]+2\.md", p) for p in odd)


def test_allocated_on_nothing(spark):
    none = spark.createDataFrame([], "op_idx int, path string")
    docs = spark.createDataFrame([], "path string")
    assert N.allocated(none, docs).collect() == []
    one = spark.createDataFrame([(1, "{{seq}}.md"), (2, "plain.md"), (3, None)], "op_idx int, path string")
    assert sorted((r.op_idx, r.path) for r in N.allocated(one, docs).collect()) == [(1, "1.md"), (2, "plain.md"), (3, None)]


def test_one_scope_of_many_creations_has_no_gaps(spark):
    frame = spark.range(20_000).select(F.col("id").cast("int").alias("op_idx"), F.lit("t/n{{seq}}.md").alias("path"))
    got = N.allocated(frame, spark.createDataFrame([("t/n41.md",)], "path string"))
    number = F.regexp_extract("path", "([0-9]+)", 1).cast("int")
    row = got.agg(F.min(number), F.max(number), F.count_distinct("path"), F.min(number - F.col("op_idx")), F.max(number - F.col("op_idx"))).first()
    assert tuple(row) == (42, 20_041, 20_000, 42, 42)


RULES = [
    Rule("task", target="w/{{var.w}}/{{title|slugify}}.md", types={"n": "number", "who": "wikilink", "s": "string"}, max_length={"s": 3}, defaults={"kind": "task {{path.w}}", "made": "{{date:YYYY}}"}, required=("who", "kind"), body="Hi {{title}}"),
    Rule("seen", where={"kind": "task x"}, defaults={"of": "{{var.more}}"}), Rule("last", where={"of": "M"}, defaults={"end": True}),
]


def test_planned(spark):
    rows = [
        (1, "task", "A b", {"w": "x", "more": "M"}, {"n": "12", "who": "bo"}, None), (2, "task", None, {"w": "x"}, {}, None), (3, "task", "T", {}, {}, None), (4, None, "T", {}, {}, None),
        (5, "task", "C", {"w": ".."}, {}, None), (6, "task", "D", {"w": "x"}, {"n": "twelve"}, None), (7, "task", "E", {"w": "x"}, {"s": "long"}, None), (8, "task", "F", {"w": "x"}, {}, "own"),
        (9, "task", "f!", {"w": "x"}, {}, None), (10, "task", "gone", {"w": "x"}, {}, None), (11, "task", "Z", {"w": "ig"}, {}, None),
    ]
    requests = spark.createDataFrame(rows, "op_idx int, rule string, title string, vars map<string,string>, fields map<string,string>, body string")
    docs = spark.createDataFrame([("w/x/gone.md",), ("other/A-B.md",)], "path string")
    got = {r.op_idx: r for r in N.planned(requests, docs, RULES, now=F.lit("2024-03-05 00:00:00").cast("timestamp"), ignore=("w/ig/**",)).collect()}
    assert {k: r.refused for k, r in got.items()} == {
        1: None, 2: "title-missing", 3: "var-missing: w", 4: "rule-unknown", 5: "outside", 6: "field-type-invalid: n no-number", 7: "field-type-invalid: s too-long", 8: "path-twice", 9: "path-twice", 10: "path-exists", 11: "path-ignored",
    }
    one = got[1]
    assert one.path == "w/x/a-b.md" and one.body == "Hi A b" and one.warnings == ["stem-exists"]
    assert config.loaded(one.block) == {"n": 12, "who": "[[bo]]", "kind": "task x", "made": "2024", "of": "M", "end": True}
    assert got[8].body == "own" and "required-missing: who" not in (got[8].warnings or [])


def test_defaults_go_on_until_nothing_changes(spark):
    chain = [Rule(f"r{k}", where={f"f{k - 1}": "v"} if k else {}, path=None if k else "a*", defaults={f"f{k}": "v"}) for k in reversed(range(17))]
    docs = spark.createDataFrame([("a1", {}), ("b", {}), ("b2", {"f14": '"v"'})], "path string, fields map<string,string>")
    out = config.with_defaults(docs, chain, title=F.lit("t"), now=F.current_timestamp())
    assert len(out._jdf.queryExecution().logical().toString()) < 20_000
    got = {r.path: len(r.fields) for r in out.collect()}
    assert got == {"a1": 17, "b": 0, "b2": 3}


def documents(spark):
    rows = [("a/x.md", "x", '{"id": 9007199254740993, "tags": ["p", "q"]}'), ("b/X.md", "X", '{"id": 5.0, "of": "[[p]]"}'), ("c/y.md", "y", '{"id": 5}'), ("d.md", "d", None)]
    return spark.createDataFrame(rows, "path string, stem string, j string").select("path", "stem", F.parse_json("j").alias("metadata"), F.lit(None).cast("string").alias("block"), F.lit("text").alias("body"), F.sha2(F.lit("text"), 256).alias("hash"))


def test_owner_sets(spark):
    docs = documents(spark)
    creates = spark.createDataFrame([("n", "new/Y.md"), ("m", "other/y.md"), ("k", "k.md")], "op_id string, path string")
    asked = [
        {"id": "stem", "stem": "x", "expected_paths": ["a/x.md", "b/X.md", "a/x.md"]}, {"id": "one", "stem": "X", "expected_paths": ["a/x.md"]}, {"id": "gone", "stem": "zz", "expected_paths": ["q.md"]},
        {"id": "number", "eq": ["id:5"], "expected_paths": ["b/X.md", "c/y.md"]}, {"id": "large", "eq": ["id:9007199254740992"], "expected_paths": []}, {"id": "float", "eq": ["id:9007199254740992.0"], "expected_paths": []},
        {"id": "both", "eq": ["tags:q", "id:9007199254740993"], "expected_paths": ["a/x.md"]}, {"id": "link", "eq": ["of:p"], "expected_paths": ["b/X.md"]},
        {"id": "create", "stem_from_operation": "n", "expected_paths": ["c/y.md"]}, {"id": "again", "stem_from_operation": "k", "expected_paths": []}, {"id": "twice", "stem_from_operation": "k", "expected_paths": []},
    ]
    got = {r.id: (r.error, r.n_missing, r.n_unexpected) for r in N.verdicts(N.owner_sets(docs, asked, creates), asked).collect()}
    fine = (None, 0, 0)
    assert got == {
        "stem": fine, "one": ("owner-set-mismatch", 0, 1), "gone": ("owner-set-mismatch", 1, 0), "number": fine, "large": fine, "float": fine, "both": fine, "link": fine,
        "create": ("owner-claim-conflict", 0, 0), "again": fine, "twice": fine,
    }
    for bad in ([asked[0], asked[0]], [{"id": "e", "stem": "", "expected_paths": []}], [{"id": "e", "eq": [], "expected_paths": []}], [{"id": "e", "stem_from_operation": "nope", "expected_paths": []}]):
        with pytest.raises(M.EditRefused):
            N.owner_sets(docs, bad, creates).collect()


def test_a_failed_precondition_refuses_the_whole_plan(spark):
    docs = documents(spark)
    links = spark.createDataFrame([], "source_path string, resolved_path string")
    schema = "op_idx int, op_id string, path string, operation string, field string, old_value string, new_value string, destination string, document_hash string"
    changes = [(0, "new", "n/y-{{seq}}.md", "create_document", None, None, "one", None, None), (1, "more", "n/y-{{seq}}.md", "create_document", None, None, "two", None, None), (2, "cut", "d.md", "delete_document", None, None, None, None, None)]
    plan = spark.createDataFrame(changes, schema)
    holds = [{"id": "free", "stem_from_operation": "more", "expected_paths": []}, {"id": "d", "stem": "d", "expected_paths": ["d.md"]}]
    out, refused, verdicts = N.applied(docs, links, plan, holds)
    assert {r.path: r.body for r in out.collect()} == {"a/x.md": "text", "b/X.md": "text", "c/y.md": "text", "n/y-1.md": "one", "n/y-2.md": "two"} and refused.collect() == [] and {r.status for r in verdicts.collect()} == {"passed"}
    out, refused, verdicts = N.applied(docs, links, plan, [*holds, {"id": "bad", "stem": "d", "expected_paths": []}])
    assert out.count() == 4 and {(r.path, r.reason) for r in refused.collect()} == {(p, "precondition-failed") for p in ("n/y-1.md", "n/y-2.md", "d.md")}
    assert {r.id: r.status for r in verdicts.collect()} == {"free": "passed", "d": "passed", "bad": "failed"}
    out, refused, _ = N.applied(docs, links, spark.createDataFrame([(0, "w", "{{seq}}/a.md", "create_document", None, None, "x", None, None)], schema))
    assert out.count() == 4 and [r.reason for r in refused.collect()] == ["seq-misplaced"]


def test_links_in_metadata_follow_moves_and_redirects(spark):
    docs = spark.createDataFrame(
        [("a/old.md", "old", "x: 1\n", "old text"), ("b.md", "b", 'up: "[[old]]"\nmore:\n  - "[[old#h|L]]"\n', "see [[old]] `[[old]]` and ![[a/old]]"), ("c.md", "c", None, "nothing"), ("d.md", "d", 'up: "[[c]]"\n', "none")],
        "path string, stem string, block string, body string",
    ).withColumn("hash", F.sha2("body", 256))
    raw = ["[[old]]", "[[old#h|L]]", "![[a/old]]"]
    edges = [("b.md", "a/old.md", r, "embed" if r[0] == "!" else "wikilink", "a/old" if "a/" in r else "old") for r in raw] + [("d.md", "c.md", "[[c]]", "wikilink", "c")]
    links = spark.createDataFrame(edges, "source_path string, resolved_path string, raw string, kind string, target string")
    moves = spark.createDataFrame([("a/old.md", "z/new.md")], "path string, new_path string")
    got = {r.path: r for r in M.moved(docs, links, moves)[0].collect()}
    assert got["b.md"].block == 'up: "[[new]]"\nmore:\n  - "[[new#h|L]]"\n' and got["b.md"].body == "see [[new]] `[[old]]` and ![[z/new]]"
    assert got["z/new.md"].stem == "new" and got["c.md"].body == "nothing" and set(got["b.md"].asDict()) == {"path", "stem", "block", "body", "hash"}
    gone = spark.createDataFrame([("a/old.md", "c.md"), ("c.md", None), ("d.md", "never.md")], "path string, redirect string")
    got = {r.path: r for r in M.deleted(docs, links, gone).collect()}
    assert set(got) == {"a/old.md", "b.md"} - {"a/old.md"} | ({"a/old.md"} if "a/old.md" in got else set())
    assert "c.md" not in got and "d.md" not in got  # what linked to c went too; a redirect to what goes is none
    led = spark.createDataFrame([("a/old.md", "c.md")], "path string, redirect string")
    got = {r.path: r for r in M.deleted(docs, links, led).collect()}
    assert set(got) == {"b.md", "c.md", "d.md"} and got["b.md"].block.startswith('up: "[[c]]"') and got["b.md"].body.startswith("see [[c]] `[[old]]`")
    report = M.link_report(__import__("vaultql.operators.repair", fromlist=["x"]).link_impact(links, moves)).collect()
    assert [tuple(r) for r in report] == [("a/old.md", 3, 0, 0)]
    schema = "path string, operation string, field string, old_value string, new_value string, destination string, document_hash string"
    plan = spark.createDataFrame([("a/old.md", "delete_document", None, None, None, "c.md", None), ("d.md", "move_document", None, None, None, "e/f.md", None), ("c.md", "delete_document", None, None, None, None, "stale")], schema)
    out, refused = M.apply_plan(docs, links, plan)
    got = {r.path: r for r in out.collect()}
    assert set(got) == {"b.md", "c.md", "e/f.md"} and got["b.md"].block.startswith('up: "[[c]]"') and {(r.path, r.reason) for r in refused.collect()} == {("c.md", "hash-mismatch")}
