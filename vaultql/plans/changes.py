"""Named queries that create, number, move and redirect documents, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import create as N
from ..operators import graph as G
from ..operators import mutate as M
from ..operators.validate import Rule
from ..operators import validate as C
from ..sources import markdown
from ..sources import tables as T
from ..sources.store import stored
from ..streaming import audit
from .catalog import query

_TREE = "(SELECT doc_id, source || '/' || lang AS folder, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path, CAST(doc_id AS VARCHAR) AS stem, source, lang, text FROM documents)"
_NOW = "2024-03-05 07:08:09"


def _documents(spark, sf_dir) -> DataFrame:
    return T.documents(spark, sf_dir, labelled=False)


# -- sequences and creation ----------------------------------------------------------------------


@query(f"""WITH d AS {_TREE}, asked AS (
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN folder || '/' WHEN 1 THEN 'notes/' || lang || '-' WHEN 2 THEN 'v2' END AS prefix, CASE doc_id % 4 WHEN 2 THEN '.5.md' ELSE '.md' END AS suffix,
      CASE WHEN doc_id % 4 = 3 THEN doc_id + 10 END AS e, lang FROM d WHERE folder IS NOT NULL),
  scoped AS (SELECT doc_id, coalesce(prefix, 'notes/' || lang || '-') AS prefix, suffix, e FROM asked),
  taken AS (SELECT folder || '/' AS prefix, '.md' AS suffix, max(doc_id) AS m FROM d GROUP BY folder),
  run AS (SELECT *, sum(CASE WHEN e IS NULL THEN 1 ELSE 0 END) OVER w AS s FROM scoped WINDOW w AS (PARTITION BY prefix, suffix ORDER BY doc_id)),
  high AS (SELECT *, max(e - s) OVER (PARTITION BY prefix, suffix ORDER BY doc_id) AS h FROM run)
  SELECT doc_id, prefix || CAST(CASE WHEN e IS NOT NULL THEN e ELSE s + greatest(coalesce(m, 0), coalesce(h, 0)) END AS VARCHAR) || suffix AS path FROM high LEFT JOIN taken USING (prefix, suffix)""")
def seq_allocated(spark, sf_dir):
    """Three kinds of scopes: folders with numbered documents, prefixes with numbers given by hand in between, and one
    whose prefix and suffix have digits of their own.
    """
    d = _documents(spark, sf_dir).where("source IS NOT NULL AND lang IS NOT NULL")
    kind = F.col("doc_id") % 4
    path = F.when(kind == 0, F.concat("source", F.lit("/"), "lang", F.lit("/{{seq}}.md"))).when(kind == 1, F.concat(F.lit("notes/"), "lang", F.lit("-{{seq}}.md")))
    path = path.when(kind == 2, "v2{{seq}}.5.md").otherwise(F.concat(F.lit("notes/"), "lang", F.lit("-"), (F.col("doc_id") + 10).cast("string"), F.lit(".md")))
    return N.allocated(d.select("doc_id", path.alias("path")), _documents(spark, sf_dir).select("path"), order="doc_id").select("doc_id", "path")


_RULES = [
    Rule("task", target="{{var.place}}/{{var.lang}}/{{title|slugify}}-{{seq}}.md", defaults={"place": "{{var.place}}", "kind": "task", "on": "{{date}}"}, types={"size": "number", "tags": "list_of_strings"}, body="# {{title|titlecase}}\n", required=("owner",)),
    Rule("note", target="notes/{{title}}.md", where={}, defaults={"kind": "note"}),
    Rule("tasks", path="src1/**", where={"kind": "task"}, defaults={"of": "one"}),
]


@query(f"""WITH d AS {_TREE}, r AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'note' WHEN 4 THEN 'nothing' ELSE 'task' END AS rule, source, lang FROM d WHERE source IS NOT NULL AND lang IS NOT NULL),
  n AS (SELECT *, CASE WHEN rule = 'nothing' THEN 'rule-unknown' WHEN doc_id % 5 = 3 THEN 'var-missing: lang' WHEN rule = 'task' AND source = 'src2' THEN 'path-ignored' END AS why FROM r),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY source, lang, doc_id % 5 ORDER BY doc_id) AS k FROM n WHERE why IS NULL AND rule = 'task')
  SELECT doc_id, source || '/' || lang || '/a-title-' || CAST(doc_id % 5 AS VARCHAR) || '-' || CAST(k AS VARCHAR) || '.md' AS path,
    'kind: task' || chr(10) || CASE WHEN source = 'src1' THEN 'of: one' || chr(10) ELSE '' END || 'on: ''2024-03-05''' || chr(10) || 'place: ' || source || chr(10) || 'size: 4' || chr(10) || 'tags:' || chr(10) || '  - x y' || chr(10) AS block,
    '# A Title ' || CAST(doc_id % 5 AS VARCHAR) || chr(10) AS body, CAST(NULL AS VARCHAR) AS refused, 'required-missing: owner' AS warnings FROM numbered
  UNION ALL SELECT doc_id, CASE WHEN rule = 'note' THEN 'notes/' || CAST(doc_id AS VARCHAR) || '.md' END, CASE WHEN rule = 'note' THEN 'kind: note' || chr(10) || 'size: 4' || chr(10) || 'tags: x y' || chr(10) END, CASE WHEN rule = 'note' THEN '' END, why, CASE WHEN rule = 'note' THEN 'stem-exists' END
    FROM n WHERE why IS NOT NULL OR rule = 'note'""")
def created_from_rules(spark, sf_dir):
    """Creations from rules, titles and variables, with what is refused and what is warned about."""
    d = _documents(spark, sf_dir).where("source IS NOT NULL AND lang IS NOT NULL")
    kind = F.col("doc_id") % 5
    lang = F.when(kind != 3, F.col("lang"))
    rule = F.when(kind == 0, "note").when(kind == 4, "nothing").otherwise("task")
    title = F.when(kind == 0, F.col("stem")).otherwise(F.concat(F.lit("a title "), kind.cast("string")))
    requests = d.select(
        "doc_id", rule.alias("rule"), title.alias("title"), F.create_map(F.lit("place"), F.col("source"), F.lit("lang"), lang).alias("vars"), F.create_map(F.lit("size"), F.lit("4"), F.lit("tags"), F.lit("x y")).alias("fields")
    )
    made = N.planned(requests, _documents(spark, sf_dir), _RULES, now=F.lit(_NOW).cast("timestamp"), ignore=("src2/**",), order="doc_id")
    fine = F.col("refused").isNull()
    return made.select("doc_id", *(F.when(fine, F.col(c)).alias(c) for c in ("path", "block", "body")), "refused", F.when(fine, F.array_join("warnings", ";")).alias("warnings"))


# -- preconditions -------------------------------------------------------------------------------


def _plan(spark, sf_dir, preconditions: list[dict]):
    d = _documents(spark, sf_dir).withColumns({"hash": F.sha2("body", 256), "block": F.lit(None).cast("string")})
    none = F.lit(None).cast("string")
    creates = d.where("doc_id % 50 = 0").select(F.col("doc_id").cast("int").alias("op_idx"), F.lit("made/m-{{seq}}.md").alias("path"), F.lit("create_document").alias("operation"), none.alias("field"), none.alias("old_value"), F.lit("new").alias("new_value"), none.alias("destination"), none.alias("document_hash"))
    gone = d.where("doc_id % 50 = 1").select(F.col("doc_id").cast("int").alias("op_idx"), "path", F.lit("delete_document").alias("operation"), none.alias("field"), none.alias("old_value"), none.alias("new_value"), none.alias("destination"), none.alias("document_hash"))
    links = d.limit(0).select(F.col("path").alias("source_path"), F.col("path").alias("resolved_path"))
    return N.applied(d.select("path", "stem", "metadata", "block", "body", "hash"), links, creates.unionByName(gone), preconditions)


def _owners(spark, sf_dir, wrong: bool) -> list[dict]:
    """Who owns stem 7, and the numbers of documents that the creations with op_idx 0 and 50 get: 1 and 2."""
    seven = _documents(spark, sf_dir).where("doc_id = 7").select("path").first()[0]  # one row
    return [
        {"id": "seven", "stem": "7", "expected_paths": [seven] + ["elsewhere.md"] * wrong}, {"id": "free", "stem_from_operation": "50", "expected_paths": []},
        {"id": "nobody", "eq": ["lang:xx", "n_chars:3"], "expected_paths": []},
    ]


@query(f"""WITH d AS {_TREE} SELECT path, text AS body FROM d WHERE doc_id % 50 <> 1
  UNION ALL SELECT 'made/m-' || CAST(row_number() OVER (ORDER BY doc_id) AS VARCHAR) || '.md', 'new' FROM d WHERE doc_id % 50 = 0""")
def plan_passed(spark, sf_dir):
    return _plan(spark, sf_dir, _owners(spark, sf_dir, wrong=False))[0].select("path", "body")


@query(f"WITH d AS {_TREE} SELECT path, text AS body, false AS refused FROM d UNION ALL SELECT path, NULL, true FROM d WHERE doc_id % 50 = 1 UNION ALL SELECT 'made/m-' || CAST(row_number() OVER (ORDER BY doc_id) AS VARCHAR) || '.md', NULL, true FROM d WHERE doc_id % 50 = 0")
def plan_refused(spark, sf_dir):
    """One precondition doesn't hold, so no change is made."""
    out, refused, _ = _plan(spark, sf_dir, _owners(spark, sf_dir, wrong=True))
    return out.select("path", "body", F.lit(False).alias("refused")).unionByName(refused.where("reason = 'precondition-failed'").select("path", F.lit(None).cast("string").alias("body"), F.lit(True).alias("refused")))


@query(f"""WITH d AS {_TREE}, ids AS (SELECT unnest(['all', 'lang', 'none', 'stem']) AS id),
  owners AS (SELECT 'lang' AS id, path FROM d WHERE lang = 'en' AND source = 'src3' UNION ALL SELECT 'stem', path FROM d WHERE stem = '12' UNION ALL SELECT 'all', path FROM d WHERE source = 'src1'),
  expected AS (SELECT 'stem' AS id, path FROM d WHERE doc_id = 12 UNION ALL SELECT 'lang', path FROM d WHERE doc_id = 12)
  SELECT id, CASE WHEN m + u > 0 THEN 'failed' ELSE 'passed' END AS status, m AS n_missing, u AS n_unexpected FROM (
    SELECT id, (SELECT count(*) FROM expected e WHERE e.id = ids.id AND NOT EXISTS (SELECT 1 FROM owners o WHERE o.id = e.id AND o.path = e.path)) AS m,
      (SELECT count(*) FROM owners o WHERE o.id = ids.id AND NOT EXISTS (SELECT 1 FROM expected e WHERE o.id = e.id AND o.path = e.path)) AS u FROM ids)""")
def owner_preconditions(spark, sf_dir):
    d = _documents(spark, sf_dir)
    twelve = d.where("doc_id = 12").select("path").first()[0]  # one row
    asked = [{"id": "all", "eq": ["source:src1"], "expected_paths": []}, {"id": "lang", "eq": ["lang:en", "source:[[src3]]"], "expected_paths": [twelve]}, {"id": "none", "stem": "no such", "expected_paths": []}, {"id": "stem", "stem": "12", "expected_paths": [twelve]}]
    return N.verdicts(N.owner_sets(d, asked), asked).select("id", "status", "n_missing", "n_unexpected")


# -- moves and redirects -------------------------------------------------------------------------


def _linked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The real texts, each with a link to the next document above it and one to the document before in its metadata."""
    d = _documents(spark, sf_dir).where("body IS NOT NULL")
    link = lambda k: F.concat(F.lit("[["), (F.col("doc_id") + k).cast("string"), F.lit("]]"))
    docs = d.select("doc_id", "path", "stem", F.concat(F.lit('up: "'), link(-1), F.lit('"\nlang: '), F.coalesce("lang", F.lit("und")), F.lit("\n")).alias("block"), F.concat(link(1), F.lit("\n"), "body").alias("body"))
    docs = docs.withColumn("hash", F.sha2(F.concat(F.lit("---\n"), "block", F.lit("---\n"), "body"), 256))
    ends = d.select(F.col("doc_id").alias("_to"), F.col("path").alias("resolved_path"))
    edges = d.select(F.col("path").alias("source_path"), F.explode(F.array(F.struct((F.col("doc_id") + 1).alias("to"), F.lit("body").alias("area")), F.struct((F.col("doc_id") - 1).alias("to"), F.lit("frontmatter").alias("area")))).alias("e"))
    edges = edges.select("source_path", F.col("e.to").alias("_to"), "e.area").join(ends, "_to")
    return docs, edges.select("source_path", "resolved_path", F.concat(F.lit("[["), F.col("_to").cast("string"), F.lit("]]")).alias("raw"), F.lit("wikilink").alias("kind"), F.col("_to").cast("string").alias("target"), "area")


_LINKED = f"""WITH d AS (SELECT * FROM {_TREE} WHERE text IS NOT NULL), names AS (SELECT doc_id, {{}} AS name FROM d),
  linked AS (SELECT d.doc_id, path, stem, source, lang, 'up: "[[' || coalesce(b.name, CAST(d.doc_id - 1 AS VARCHAR)) || ']]"' || chr(10) || 'lang: ' || coalesce(lang, 'und') || chr(10) AS block,
    '[[' || coalesce(a.name, CAST(d.doc_id + 1 AS VARCHAR)) || ']]' || chr(10) || text AS body FROM d LEFT JOIN names a ON a.doc_id = d.doc_id + 1 LEFT JOIN names b ON b.doc_id = d.doc_id - 1)"""


@query(_LINKED.format("CASE WHEN doc_id % 9 = 0 THEN stem || 'x' ELSE stem END") + " SELECT CASE WHEN doc_id % 9 = 0 THEN 'archive/' || stem || 'x.md' ELSE path END AS path, block, body, sha256('---' || chr(10) || block || '---' || chr(10) || body) AS hash FROM linked")
def move_with_metadata_links(spark, sf_dir):
    docs, links = _linked(spark, sf_dir)
    moves = docs.where("doc_id % 9 = 0").select("path", F.concat(F.lit("archive/"), "stem", F.lit("x.md")).alias("new_path"))
    return M.moved(docs.drop("doc_id"), links, moves)[0].select("path", "block", "body", "hash")


@query(_LINKED.format("CASE WHEN doc_id % 10 = 3 AND EXISTS (SELECT 1 FROM d x WHERE x.doc_id = d.doc_id + 4) THEN CAST(doc_id + 4 AS VARCHAR) ELSE stem END") + """
  SELECT path, block, body FROM linked WHERE NOT (doc_id % 10 = 3 AND (EXISTS (SELECT 1 FROM d x WHERE x.doc_id = linked.doc_id + 4) OR NOT EXISTS (SELECT 1 FROM d x WHERE x.doc_id IN (linked.doc_id + 1, linked.doc_id - 1))))""")
def delete_redirected(spark, sf_dir):
    """Every tenth document goes, and links to it lead to another one; without that it stays, as others link to it."""
    docs, links = _linked(spark, sf_dir)
    to = docs.select((F.col("doc_id") - 4).alias("doc_id"), F.col("path").alias("redirect"))
    gone = docs.where("doc_id % 10 = 3").select("doc_id", "path").join(to, "doc_id", "left").select("path", "redirect")
    return M.deleted(docs.drop("doc_id"), links, gone).select("path", "block", "body")


_CHANGED = f"""WITH d AS {_TREE}, after AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'al-' || CAST(doc_id - 1 AS VARCHAR) ELSE 'al-' || stem END AS alias FROM d WHERE doc_id % 7 <> 3),
  linked AS (SELECT path, 'al-' || CAST(doc_id + 1 AS VARCHAR) AS target FROM after UNION ALL SELECT path, CAST(doc_id + 2 AS VARCHAR) FROM after),
  owners AS (SELECT alias AS name, path FROM after UNION ALL SELECT stem, path FROM after)
  SELECT l.path, l.target, CASE WHEN count(o.path) = 1 THEN max(o.path) END AS resolved_path, CASE WHEN count(o.path) = 1 THEN 'resolved' WHEN count(o.path) = 0 THEN 'unresolved' ELSE 'ambiguous' END AS status
  FROM linked l LEFT JOIN owners o ON o.name = l.target GROUP BY l.path, l.target"""


def _refreshed(spark, sf_dir) -> DataFrame:
    """The links after every fifth document got another alias and every seventh went; only those whose keys changed are
    resolved again.
    """
    d = _documents(spark, sf_dir)
    number = lambda k: (F.col("doc_id") + k).cast("string")
    text = lambda alias: F.concat(F.lit("---\naliases: "), alias, F.lit("\n---\n[[al-"), number(1), F.lit("]] and [["), number(2), F.lit("]]\n"), F.coalesce("body", F.lit("")))
    files = d.select("doc_id", "path", text(F.concat(F.lit("al-"), "stem")).cast("binary").alias("content"))
    old = markdown.relations(stored(markdown.parse_files(files), "parsed"))
    old["files"] = files.select("path")
    asked = old["links"].where("target LIKE 'al-%' OR target RLIKE '^[0-9]+$'")
    old["links"] = stored(G.resolve(asked, old["files"], old["documents"], old["headings"], old["block_ids"], G.aliases_of(old["documents"])), "links")
    again = d.where("doc_id % 5 = 0 AND doc_id % 7 <> 3").select("path", text(F.concat(F.lit("al-"), number(-1))).cast("binary").alias("content"))
    found = audit.refreshed(old, stored(markdown.parse_files(again), "again"), files.where("doc_id % 7 = 3").select("path"), files.where("doc_id % 7 <> 3").select("path"))
    return found["links"].where("target LIKE 'al-%' OR target RLIKE '^[0-9]+$'")


@query(_CHANGED)
def refresh_by_keys(spark, sf_dir):
    return _refreshed(spark, sf_dir).select(F.col("source_path").alias("path"), "target", "resolved_path", "status")


@query(f"SELECT code, path, target, reason FROM (SELECT CASE status WHEN 'ambiguous' THEN 'link-ambiguous' ELSE 'link-target-missing' END AS code, path, target, CASE status WHEN 'ambiguous' THEN 'ambiguous' ELSE 'target-missing' END AS reason FROM ({_CHANGED}) WHERE status <> 'resolved') WHERE reason = 'target-missing'")
def findings_by_reason(spark, sf_dir):
    found = C.link_findings(_refreshed(spark, sf_dir), details=True)
    return C.triage(found, reason="target-missing").select("code", "path", "target", "reason")
