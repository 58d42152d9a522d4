"""Templates, configuration, plans, moves, metadata edits, snapshots and the audit log on small hand-made inputs."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vaultql.functions import globs, templates
from vaultql.functions import values as V
from vaultql.operators import graph as G
from vaultql.operators import mutate as M
from vaultql.operators import repair as R
from vaultql.operators import validate as C
from vaultql.operators.find import Query
from vaultql.sources import config, markdown
from vaultql.streaming import audit


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("template", "want"), [
    ("{{title | titlecase}}", "My Big Note A"), ("{{title|sentencecase}}", "My big note a"), ("{{title|slugify}}", "my-big-note-a"), ("{{title|unsep|upper}}", "MY BIG NOTE A"), ("{{{{title}}}}", "{{title}}"),
    ("{{now}} {{date}} {{time}}", "2026-05-05T18:03 2026-05-05 18:03"), ("{{date:D.M.YY [D] dddd MMMM}}", "5.5.26 D Tuesday May"), ("{{date:h A a hh H ddd MMM [x}}", "6 PM pm 06 18 Tue May [x"), ("{{var.k}}-{{path.none}}", "2020-01-02-v-"), ("{{var.k|strip_date_prefix}}", "v"), ("é{x}", "é{x}"),
])
def test_templates(spark, template, want):
    now = F.lit("2026-05-05 18:03:09").cast("timestamp")
    assert one(spark, templates.rendered(template, title=F.lit("my_big-note A"), now=now, names={"k": F.lit("2020-01-02-v")})) == want


def test_template_errors_durations_and_targets():
    for bad in ("{{nope}}", "{{title|nope}}", "{{title"):
        with pytest.raises(templates.TemplateError):
            templates.rendered(bad, title=F.lit(""), now=F.lit(""))
    assert [templates.seconds(x) for x in ("90d", "12h", "2w", "5m", "10", "x", "-1d")] == [7776000, 43200, 1209600, 300, None, None, None]
    assert globs.glob_of_target("a/{{var.b}}/{{title|slugify}}.md") == "a/{{b}}/*.md" and globs.glob_of_target("{{var.x}}-y/{{path.z}}") == "*-y/{{z}}"


def test_destinations(spark):
    meta = F.parse_json(F.lit('{"t": "x", "n": 5, "l": [1]}'))
    got = {t: spark.range(1).select(*templates.destination(t, F.lit("a/b.c.md"), meta, folder=f)).first() for t, f in [("z/{filename}", False), ("{frontmatter.t}/{frontmatter.n}", True), ("{frontmatter.q}", False), ("{frontmatter.l}/{stem}", False), ("{x}", False), ("{stem", False)]}
    assert {k: tuple(v) for k, v in got.items()} == {
        "z/{filename}": ("z/b.c.md", None), "{frontmatter.t}/{frontmatter.n}": ("x/5/b.c.md", None), "{frontmatter.q}": (None, "missing field q"), "{frontmatter.l}/{stem}": (None, "field l is no scalar"),
        "{x}": (None, "unknown placeholder x"), "{stem": (None, "malformed template"),
    }


def test_values(spark):
    big = spark.createDataFrame([("a", '{"n": 9007199254740993, "d": 5.0}'), ("b", '{"n": 9007199254740992, "d": [1, null, "x"]}')], "path string, j string").withColumn("metadata", F.parse_json("j"))
    assert [r.path for r in Query(big).eq("n", 9007199254740993).frame().collect()] == ["a"] and [r.path for r in Query(big).eq("d", 5).frame().collect()] == ["a"]
    assert {r[0] for r in big.select(V.inline(V.field("metadata", "d"))).collect()} == {"5", "1, (null), x"}
    assert [one(spark, V.contained(F.lit(p))) for p in ("a/b", "../a", "/a", "a/../b", "", "a//b")] == [True, False, False, False, False, False]
    assert [one(spark, V.relative(F.lit(a), F.lit(b))) for a, b in (("", "x/y"), ("a/b", "a/c/d"), ("a", "a/d"), ("a/b/c", "d"))] == ["x/y", "../c/d", "d", "../../../d"]


CONFIG = """
files: {ignore: ["tmp/**"]}
validate:
  ignore: ["archive/**"]
  required_frontmatter: [type]
  rules:
    - name: tasks
      match: {path: "tasks/{{area}}/*.md", path_not: "tasks/old/**", frontmatter: {type: [task, todo]}}
      exclude: {path: "tasks/x/*.md"}
      field_types: {due: date, title: {type: string, max_length: 20}}
      allowed_values: {status: [open, done]}
      frontmatter_defaults: {status: open, area: "{{path.area | titlecase}}"}
      field_references: {parent: project}
repair:
  rules:
    - match: {code: value-not-allowed, field: status}
      set_frontmatter: {field: status, value: open}
    - match: {code: document-misrouted}
      move_document: {directory: "tasks/{frontmatter.type}"}
events: {retention: 2w}
"""


def test_config():
    c = config.parse_config(CONFIG)
    assert [r.name for r in c.rules] == ["everywhere", "tasks"] and c.rules[1].path_not == "tasks/old/**" and c.rules[1].max_length == {"title": 20} and c.rules[1].references == {"parent": ("project",)}
    assert c.repairs[0].value == "open" and c.repairs[1].folder and c.retention == "2w" and c.ignore_validate == ("archive/**",) and config.parse_config("") == config.Config()


@pytest.mark.parametrize(("change", "says"), [
    (("files:", "filez:"), "unknown keys"), (("due: date", "due: dates"), "unknown type"), (("max_length: 20", "max_length: 300"), "between 1 and 256"), (("path: \"tasks/{{area}}/*.md\"", "path: \"tasks/[\""), "no pattern"),
    (("status: open,", "status: shut,"), "isn't allowed"), (("titlecase", "shout"), "unknown transforms"), (("parent: project", "due: project"), "holds no links"), (("retention: 2w", "retention: long"), "no duration"),
    (("set_frontmatter: {field: status, value: open}", "set_frontmatter: {field: status}"), "needs a field"), (("{directory:", "{folder:"), "directory is expected"), (("name: tasks", "name: everywhere"), "there twice"), (("[open, done]", "open"), "list of plain values"),
])
def test_config_errors(change, says):
    assert change[0] in CONFIG
    with pytest.raises(config.ConfigError, match=says):
        config.parse_config(CONFIG.replace(*change))


def test_plans_in_json_and_yaml(spark, tmp_path):
    plan = {"changes": [{"path": "a.md", "operation": "set_frontmatter", "field": "x", "new_value": [1, "é"]}, {"path": "b.md", "operation": "delete_document"}]}
    (tmp_path / "p.json").write_text(json.dumps(plan))
    (tmp_path / "p.yaml").write_text("changes:\n- {path: a.md, operation: set_frontmatter, field: x, new_value: [1, é]}\n- path: b.md\n  operation: delete_document\n")
    got = [config.read_plan(spark, str(tmp_path / f"p.{e}")) for e in ("json", "yaml")]
    assert got[0][1] == got[1][1] and got[0][0].collect() == got[1][0].collect() and got[0][0].first().new_value == '[1, "é"]'
    for bad in ("[]", "changes: [{path: a, operation: fly}]", "changes: [{path: a, operation: delete_document, x: 1}]"):
        with pytest.raises(config.ConfigError):
            config.parse_plan(bad)


def test_metadata_edits():
    block = "# kept\ntitle: 'A'  # too\ntags:\n  - a\nn: 1\n"
    assert M.with_metadata(block, [("set", "n", "2"), ("push", "tags", "b"), ("push", "tags", "a")]) == "# kept\ntitle: 'A'  # too\ntags:\n  - a\n  - b\nn: 2\n"
    assert M.with_metadata(block, [("pop", "tags", "a"), ("remove", "n", ""), ("set", "new", "x: y")]) == "# kept\ntitle: 'A'  # too\ntags: []\nnew:\n  x: y\n".replace("new:\n  x: y", "new: {x: y}")
    types = {"up": "wikilink", "day": "date", "at": "datetime", "l": "list_of_strings", "s": "string", "n": "number"}
    assert M.with_metadata("", [("set", k, v) for k, v in (("up", "Note"), ("day", "2024-01-02"), ("l", "x"), ("s", "true"), ("n", "5"))], types) == "up: '[[Note]]'\nday: '2024-01-02'\nl:\n  - x\ns: 'true'\nn: 5\n"
    for field, raw in (("day", "soon"), ("at", "2024-01-02"), ("n", "x"), ("up", "")):
        with pytest.raises(M.EditRefused):
            M.with_metadata("", [("set", field, raw)], types)
    with pytest.raises(M.EditRefused):
        M.with_metadata("", [("set", "s", "long")], types, {"s": 3})


def tree(tmp_path, files):
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(tmp_path)


def vault(spark, root):
    files, parsed = markdown.read_tree(spark, root)
    r = markdown.relations(parsed)
    r["links"] = G.resolve(r["links"], files, r["documents"], r["headings"], r["block_ids"], G.aliases_of(r["documents"]))
    return files, parsed, r


def test_places_and_unreadable_files(spark, tmp_path):
    root = tree(tmp_path, {"a.md": "---\nup: ['[[b]]', '[[c]]']\n---\né [[b]]\nTitle\n=====\n# Title\n", "bad.md": b"\xff\xfe", "p.png": b"\x89"})
    files, parsed, r = vault(spark, root)
    places = {(x.area, x.target): (x.line, x.column, x.byte_offset) for x in r["links"].collect()}
    assert places == {("frontmatter", "b"): (2, 7, 10), ("frontmatter", "c"): (2, 16, 19), ("body", "b"): (4, 4, 34)}
    assert [(x.text, x.level, x.line) for x in r["headings"].collect()] == [("Title", 1, 5)]
    assert [(x.doc_path, x.code, x.severity) for x in r["diagnostics"].collect()] == [("bad.md", "read-failed", "error")]
    assert {x.path: bool(x.hash) for x in markdown.inventory(files, parsed).collect()} == {"a.md": True, "bad.md": False, "p.png": False}
    again = tree(tmp_path / "x", {"a.md": "---\nup:   ['[[b]]', '[[c]]']\n---\né [[b]]\nTitle\n=====\n# Title\n"})
    assert vault(spark, again)[2]["documents"].first().hash not in {d.hash for d in r["documents"].collect()}


def test_containers_and_sections(spark, tmp_path):
    body = "> # Quoted\n> ```\n> [[no]]\n> ```\n> [[yes]]\n\n- # Item\n  text\n1. ~~~\n   [[no]]\n   ~~~\n\n> ```\n> [[no]]\nout [[also]]\n## Last\nend\n"
    got = markdown.parse("x.md", body.encode())
    assert [h[1] for h in got["headings"]] == ["Quoted", "Item", "Last"] and [x[2] for x in got["links"]] == ["yes", "also"]
    docs = spark.createDataFrame([("x.md", body), ("y.md", "# Last\n\n# Last\n"), ("z.md", None)], "path string, body string")
    assert {r.path: (r.text, r.refused) for r in M.sections(docs, ["Last"]).collect()} == {"x.md": ("end\n", None), "y.md": (None, "heading-ambiguous"), "z.md": (None, "heading-missing")}


def test_moves_rewrite_bodies(spark, tmp_path):
    root = tree(tmp_path, {"a/one.md": "see [[two|T]] and [[a/one]] `[[two]]` [x](../b/two.md#h)\n", "b/two.md": "back [[one]] ![[one#x]] [y](two.md)\n", "c.md": "[[two]]\n"})
    _, _, r = vault(spark, root)
    moves = spark.createDataFrame([("b/two.md", "a/three.md"), ("a/one.md", "a/one.md2.md")], "path string, new_path string").where("path = 'b/two.md'")
    docs, links = M.moved(r["documents"], r["links"], moves)
    got = {x.path: (x.body, x.stem) for x in docs.collect()}
    assert got["a/one.md"][0] == "see [[three|T]] and [[a/one]] `[[two]]` [x](three.md#h)\n" and got["c.md"][0] == "[[three]]\n"
    assert got["a/three.md"] == ("back [[one]] ![[one#x]] [y](three.md)\n", "three") and {x.resolved_path for x in links.collect()} == {"a/three.md", "a/one.md"}


def test_refresh_equals_rebuild(spark, tmp_path):
    root = tree(tmp_path / "v", {"a.md": "[[b]] [[new]]\n", "b.md": "# H\n[[a]]\n", "c.md": "[[b#H]]\n"})
    _, _, old = vault(spark, root)
    old = {k: spark.createDataFrame(v.collect(), v.schema) for k, v in old.items()}
    tree(tmp_path / "v", {"new.md": "hi\n", "b.md": "# G\n"})
    (tmp_path / "v" / "a.md").unlink()
    files, parsed, want = vault(spark, root)
    changed = parsed.where("path IN ('new.md', 'b.md')")
    got = audit.refreshed(old, changed, spark.createDataFrame([("a.md",)], "path string"), files)
    for name in want:
        key = lambda f: sorted(map(str, f.drop("metadata").collect()))
        assert key(got[name].select(*want[name].columns)) == key(want[name]), name


def test_creations(spark):
    docs = spark.createDataFrame([("a.md", "a", "x")], "path string, stem string, body string")
    new = spark.createDataFrame([("a.md", "y"), ("d/b.md", "y"), ("../c.md", "y"), ("e.md", "1"), ("e.md", "2")], "path string, body string")
    assert sorted((r.path, r.refused or "", r.stem) for r in M.created(docs, new).collect()) == [("../c.md", "outside", "c"), ("a.md", "", "a"), ("a.md", "path-exists", "a"), ("d/b.md", "", "b"), ("e.md", "path-twice", "e"), ("e.md", "path-twice", "e")]


def test_plan_application(spark):
    docs = spark.createDataFrame([(p, p[0], "k: 1\n", f"# H\n{p}\n", "h") for p in ("a.md", "b.md", "c.md", "d.md", "e.md")], "path string, stem string, block string, body string, hash string")
    links = spark.createDataFrame([("a.md", "b.md", "[[b]]", "wikilink", "b")], "source_path string, resolved_path string, raw string, kind string, target string")
    rows = [
        ("a.md", "str_replace", None, "a.md", "A", None, "h"), ("a.md", "set_frontmatter", "k", None, "2", None, "h"), ("b.md", "delete_document", None, None, None, None, None), ("c.md", "delete_document", None, None, None, None, None),
        ("c.md", "create_document", None, None, "new", None, None), ("d.md", "move_document", None, None, None, "c.md", None), ("e.md", "move_document", None, None, None, "f/e.md", "other"), ("g.md", "str_replace", None, "x", "y", None, None),
    ]
    changes = spark.createDataFrame(rows, "path string, operation string, field string, old_value string, new_value string, destination string, document_hash string")
    out, refused = M.apply_plan(docs, links, changes)
    assert {r.path: (r.block, r.body) for r in out.collect()} == {"a.md": ("k: 2\n", "# H\nA\n"), "b.md": ("k: 1\n", "# H\nb.md\n"), "c.md": (None, "new"), "d.md": ("k: 1\n", "# H\nd.md\n"), "e.md": ("k: 1\n", "# H\ne.md\n")}
    assert {(r.path, r.reason) for r in refused.collect()} == {("b.md", "linked"), ("d.md", "path-exists"), ("e.md", "hash-mismatch"), ("g.md", "path-missing")}
    with pytest.raises(M.EditRefused):
        M.apply_plan(docs, links, changes.withColumn("operation", F.lit("fly")))


def test_repeated_findings_and_change_ids(spark):
    found = spark.createDataFrame([("p", "c", None), ("p", "c", None), ("p", "c", "")], "path string, code string, actual_value string")
    rules = spark.createDataFrame([(2, "late", None, None), (1, "first", "c", None), (0, "other", "d", None)], "rule_idx int, action string, code string, actual_value string")
    assert [(r.rule_idx, r.action) for r in R.first_rule(found, rules, ["code", "actual_value"]).collect()] == [(1, "first")] * 3
    ids = R.with_change_ids(found.withColumnRenamed("actual_value", "old_value")).collect()
    assert len({r.change_id for r in ids}) == 3


def test_confidence_and_ties(spark):
    docs = spark.createDataFrame([("a/longer name.md", "longer name", "h", "{}"), ("b/other.md", "other", "h", "{}"), ("c/Other.md", "Other", "h", "{}")], "path string, stem string, hash string, j string").withColumn("metadata", F.parse_json("j"))
    found = spark.createDataFrame([("link-target-missing", "b/other.md", "longer nam"), ("link-target-missing", "b/other.md", "Longer_Name"), ("link-target-missing", "b/other.md", "othe"), ("link-target-missing", "gone.md", "longer name"), ("link-target-missing", "b/other.md", "---")], "code string, path string, actual_value string")
    found = found.select("code", F.lit("warning").alias("severity"), "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("field"), "actual_value", F.lit(None).cast("string").alias("expected"))
    changes, skipped = R.plan(found, [], docs)
    assert sorted((r.old_value, r.new_value, r.confidence) for r in changes.collect()) == [("Longer_Name", "longer name", "high"), ("longer nam", "longer name", "medium")]
    assert sorted((r.actual_value, r.skip_reason) for r in skipped.collect()) == [("---", "link-decision-needed"), ("longer name", "missing-hash"), ("othe", "ambiguous-target")]
    assert [r.confidence for r in R.plan(found, [], docs, only_high=True)[0].collect()] == ["high"]


def test_audit_append_and_retention(spark, tmp_path):
    rows = [(f"2024-01-0{d} 10:00:00", f"s{d}", "e", "ok", {"k": "v"}) for d in (1, 2, 3)]
    events = spark.createDataFrame(rows, "t string, span string, event string, status string, attributes map<string,string>").withColumn("timestamp", F.to_timestamp("t")).drop("t")
    folder = str(tmp_path / "log")
    assert audit.append(events, folder, retention=None, cap_bytes=None) == []
    assert audit.prune(spark, folder, "2d", None, today="2024-01-04") == ["2024-01-01"] and audit.prune(spark, folder, None, 1) == ["2024-01-02"]
    got = audit.read(spark, folder).collect()
    assert [(str(r.timestamp), r.span, r.event, r.status, r.attributes) for r in got] == [("2024-01-03 10:00:00", "s3", "e", "ok", {"k": "v", "status": "ok"})]
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = audit.append(source, str(tmp_path / "live"), retention=None, cap_bytes=None).start()
    run.processAllAvailable()
    run.stop()
    assert sorted(r.span for r in audit.read(spark, str(tmp_path / "live")).collect()) == ["s1", "s2", "s3"]
    assert audit.bound("2024-01-02", end=True) == "2024-01-02T23:59:59.999999Z"


def test_exempt_documents(spark):
    docs = spark.createDataFrame([("a.md", "{}"), ("x/b.md", "{}"), ("archive/c.md", "{}")], "path string, j string").withColumn("metadata", F.parse_json("j"))
    rules = [C.Rule("r", required=("t",), exclude="x/*")]
    assert [r.path for r in C.findings(docs, rules, ignore=("/archive/**",)).collect()] == ["a.md"]
    with pytest.raises(ValueError):
        C.findings(docs, [C.Rule("r", types={"t": "colour"})])


def test_edits_take_batches_in_parts(spark, monkeypatch):
    """Each part that an edit's task turns into Python objects has 1 MiB at most, or one row."""
    batch = pa.RecordBatch.from_pylist([{"path": f"{k}.md", "body": "# A\n" + "word " * 400} for k in range(3000)])
    docs = spark.range(1).selectExpr("'a.md' AS path", "'# A' AS body")
    caught = {}
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: caught.setdefault("run", f))
    M.sections(docs, ["A"])
    made = list(caught["run"](iter([batch])))
    assert len(made) > 5 and sum(b.num_rows for b in made) == 3000


def test_stem_collisions_of_common_names_are_dealt_out(spark):
    """A name that very many share meets in parts: the same rows, and no task has more than a few parts."""
    docs = spark.range(900).selectExpr("concat('d', id, '.md') AS path", "CASE WHEN id < 800 THEN 'Same' ELSE concat('s', id) END AS stem")
    moves = docs.where("path LIKE '%5.md'").selectExpr("path", "concat('x/', stem, '.md') AS new_path")
    plain, dealt = R.stem_collisions(docs, moves), R.stem_collisions(docs, moves, side=20)
    assert sorted(plain.collect()) == sorted(dealt.collect()) and plain.count() == 80 * 799
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [n for n in R.stem_collisions(docs, moves, side=20).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) > 50 and max(sizes) < 80 * 799 // 10
