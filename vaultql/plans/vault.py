"""Named queries over a linked tree of documents made from the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import globs, templates
from ..functions import values as V
from ..operators import aggregate as A
from ..operators import graph as G
from ..operators import mutate as M
from ..operators import repair as R
from ..operators import validate as C
from ..operators.find import Query, by_display, page
from ..sources import config, markdown
from ..sources import tables as T
from ..streaming import audit
from .catalog import DOC, FINDINGS, findings, query

#: The documents in SQL, with one link each of a kind that the id decides.
VAULT = "(SELECT doc_id, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path, CAST(doc_id AS VARCHAR) AS stem, source, lang, doc_id % 6 AS t FROM documents)"


def _documents(spark, sf_dir) -> DataFrame:
    return T.documents(spark, sf_dir, labelled=False)


def _by_kind(*choices: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, c in enumerate(choices):
        out = F.when(F.col("doc_id") % 6 == k, c).otherwise(out)
    return out


def _links(spark, sf_dir) -> DataFrame:
    """Stems, root paths in other letters, relative paths, embeds, own headings and aliases, a sixth each."""
    d = _documents(spark, sf_dir)
    next_to = lambda k: (F.col("doc_id") + k).cast("string")
    target = _by_kind(
        next_to(1), F.concat(F.upper("source"), F.lit("/"), "lang", F.lit("/"), "stem"), F.concat(F.lit("../"), "lang", F.lit("/"), next_to(7), F.lit(".md")), next_to(3), F.lit(""),
        F.concat(F.lit("Alias "), (F.col("doc_id") % 20).cast("string")),
    )
    kind = _by_kind(F.lit("wikilink"), F.lit("wikilink"), F.lit("markdown"), F.lit("embed"), F.lit("wikilink"), F.lit("wikilink"))
    anchor = F.when(F.col("doc_id") % 6 == 4, F.concat(F.lit("Part "), (F.col("doc_id") % 10).cast("string")))
    wiki = lambda mark, end: F.concat(F.lit(mark + "[["), target, F.lit(end + "]]"))
    raw = _by_kind(wiki("", "|L"), wiki("", ""), F.concat(F.lit("[t]("), target, F.lit("#a)")), wiki("!", ""), F.concat(F.lit("[[#"), anchor, F.lit("]]")), wiki("", ""))
    return d.select("doc_id", F.col("path").alias("source_path"), kind.alias("kind"), target.alias("target"), anchor.alias("anchor"), F.lit(None).cast("string").alias("block_ref"), raw.alias("raw"), F.lit("body").alias("area"), F.lit(0).cast("long").alias("byte_offset"))


def _aliases(spark, sf_dir) -> DataFrame:
    d = _documents(spark, sf_dir).where("doc_id % 50 = 0")
    return d.select(F.col("path").alias("doc_path"), F.concat(F.lit("alias "), (F.expr("doc_id div 50") % 15).cast("string")).alias("alias"))


def _resolved(spark, sf_dir) -> DataFrame:
    d = _documents(spark, sf_dir)
    headings = d.select(F.col("path").alias("doc_path"), F.lit("part-4").alias("slug"))
    blocks = d.limit(0).select(F.col("path").alias("doc_path"), F.lit("").alias("block_id"))
    return G.resolve(_links(spark, sf_dir), d.select("path"), d.select("path", "stem"), headings, blocks, _aliases(spark, sf_dir))


RESOLVED = f"""(WITH v AS {VAULT}, na AS (SELECT 'alias ' || CAST((doc_id // 50) % 15 AS VARCHAR) AS alias, count(*) AS n, min(path) AS p FROM v WHERE doc_id % 50 = 0 GROUP BY 1),
  c AS (SELECT a.doc_id, a.path, a.t, a.stem, a.source, a.lang,
    CASE a.t WHEN 0 THEN b1.path WHEN 1 THEN a.path WHEN 2 THEN b7.path WHEN 3 THEN b3.path WHEN 4 THEN a.path ELSE CASE WHEN na.n = 1 THEN na.p END END AS resolved_path,
    CASE WHEN a.t = 5 THEN coalesce(na.n, 0) WHEN a.t = 0 THEN count_if(b1.path IS NOT NULL) OVER (PARTITION BY a.doc_id) WHEN a.t = 2 THEN count_if(b7.path IS NOT NULL) OVER (PARTITION BY a.doc_id) WHEN a.t = 3 THEN count_if(b3.path IS NOT NULL) OVER (PARTITION BY a.doc_id) ELSE 1 END AS n
    FROM v a LEFT JOIN v b1 ON b1.doc_id = a.doc_id + 1 LEFT JOIN v b3 ON b3.doc_id = a.doc_id + 3 LEFT JOIN v b7 ON b7.doc_id = a.doc_id + 7 AND b7.source = a.source AND b7.lang = a.lang LEFT JOIN na ON na.alias = 'alias ' || CAST(a.doc_id % 20 AS VARCHAR))
  SELECT *, CASE WHEN n = 0 THEN 'target-missing' WHEN t = 4 AND doc_id % 10 <> 4 THEN 'anchor-missing' END AS reason,
    CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 0 OR t = 4 AND doc_id % 10 <> 4 THEN 'unresolved' ELSE 'resolved' END AS status,
    CASE t WHEN 0 THEN CAST(doc_id + 1 AS VARCHAR) WHEN 1 THEN upper(source) || '/' || lang || '/' || stem WHEN 2 THEN '../' || lang || '/' || CAST(doc_id + 7 AS VARCHAR) || '.md' WHEN 3 THEN CAST(doc_id + 3 AS VARCHAR) WHEN 4 THEN '' ELSE 'Alias ' || CAST(doc_id % 20 AS VARCHAR) END AS target
  FROM c)"""


@query(f"SELECT doc_id, status, reason, resolved_path, CAST(n AS BIGINT) AS n FROM {RESOLVED}")
def resolve_links(spark, sf_dir):
    return _resolved(spark, sf_dir).select("doc_id", "status", "reason", "resolved_path", F.col("n_candidates").alias("n"))


@query(f"SELECT CASE WHEN status = 'ambiguous' THEN 'link-ambiguous' WHEN reason = 'anchor-missing' THEN 'link-anchor-missing' ELSE 'link-target-missing' END AS code, path, target AS actual_value FROM {RESOLVED} WHERE status <> 'resolved'")
def link_findings(spark, sf_dir):
    return C.link_findings(_resolved(spark, sf_dir)).select("code", "path", "actual_value")


@query(f"""WITH r AS {RESOLVED} SELECT a.path, 1::BIGINT AS n_out, CAST(a.status = 'unresolved' AS INT)::BIGINT AS n_unresolved,
  coalesce((SELECT string_agg(b.path, ',' ORDER BY b.path) FROM r b WHERE b.resolved_path = a.path), '') AS incoming FROM r a""")
def show_deep(spark, sf_dir):
    found = G.deep(_documents(spark, sf_dir).select("path"), _resolved(spark, sf_dir))
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return found.select("path", count("outgoing").alias("n_out"), count("unresolved").alias("n_unresolved"), F.coalesce(F.array_join("incoming", ","), F.lit("")).alias("incoming"))


@query(f"SELECT path FROM {RESOLVED} WHERE status = 'unresolved' INTERSECT SELECT path FROM {DOC} WHERE lang = 'en'")
def find_unresolved_links(spark, sf_dir):
    return Query(_documents(spark, sf_dir), links=_resolved(spark, sf_dir), typed=("lang",), plain=("lang",)).eq("lang", "en").unresolved_links().frame().select("path")


@query(f"""WITH v AS {VAULT}, al AS (SELECT path, 'alias ' || CAST((doc_id // 50) % 15 AS VARCHAR) AS alias FROM v WHERE doc_id % 50 = 0 UNION ALL SELECT path, CAST(doc_id + 1 AS VARCHAR) FROM v WHERE doc_id % 50 = 1)
  SELECT 'frontmatter-alias-duplicate' AS code, a.path, a.alias AS actual_value, string_agg(b.path, ',' ORDER BY b.path) AS expected FROM al a JOIN al b ON a.alias = b.alias AND a.path <> b.path GROUP BY a.path, a.alias
  UNION ALL SELECT 'frontmatter-alias-shadowed', al.path, alias, v.path FROM al JOIN v ON v.stem = alias
  UNION ALL SELECT 'frontmatter-alias-malformed', path, '["x"]', NULL FROM v WHERE doc_id % 50 = 2""")
def alias_findings(spark, sf_dir):
    d = _documents(spark, sf_dir)
    entry = F.when(F.col("doc_id") % 50 == 1, F.to_json(F.struct((F.col("doc_id") + 1).cast("string").alias("aliases")))).when(F.col("doc_id") % 50 == 2, F.lit('{"aliases": [["x"], null]}'))
    meta = d.select("path", F.parse_json(entry).alias("metadata")).where("metadata IS NOT NULL")
    found = C.alias_findings(_aliases(spark, sf_dir).unionByName(G.aliases_of(meta)), d, G.malformed_aliases(meta))
    return found.select("code", "path", "actual_value", "expected")


@query(f"""WITH v AS {VAULT} SELECT 'frontmatter-reference-type' AS code, a.path, 'parent' AS field, b.lang AS actual_value, 'en,fr' AS expected FROM v a JOIN v b ON b.doc_id = a.doc_id + 11
  WHERE a.source = 'src1' AND NOT starts_with(a.path, 'src1/de/') AND b.source <> 'src3' AND b.lang NOT IN ('en', 'fr')""")
def typed_references(spark, sf_dir):
    d = _documents(spark, sf_dir)
    to = d.select((F.col("doc_id") - 11).alias("doc_id"), F.col("path").alias("resolved_path"))
    links = d.select("doc_id", F.col("path").alias("source_path"), F.lit("parent").alias("property")).join(to, "doc_id")
    rules = [C.Rule("parents", path="/src1/**", path_not="src1/de/**", references={"parent": ("en", "fr")})]
    return C.typed_references(d, links, rules, type_field="lang", ignore=("src3/**",)).select("code", "path", "field", "actual_value", "expected")


@query(f"""SELECT 'frontmatter-required-field-missing' AS code, path, rule, field FROM (
  SELECT path, 'one' AS rule, 'quality' AS field FROM {DOC} WHERE starts_with(source, 'src1') AND source <> 'src10' AND lang <> 'de' AND NOT starts_with(path, 'src12/fr/') AND quality IS NULL
  UNION ALL SELECT path, 'made', 'toxic' FROM {DOC} WHERE source = 'src2' AND toxic IS NULL) WHERE NOT suffix(path, '7.md')""")
def rules_selection(spark, sf_dir):
    rules = [C.Rule("one", path="src1*/**", path_not="{src10/**,*/de/*}", exclude="src12/fr/**", required=("quality",)), C.Rule("made", target="src2/{{var.lang}}/{{title | slugify}}.md", required=("toxic",))]
    return C.findings(T.documents(spark, sf_dir), rules, ignore=("**/*7.md",)).select("code", "path", "rule", "field")


@query("SELECT code, severity, path, actual_value FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'frontmatter-unclosed' ELSE 'read-failed' END AS code, CASE WHEN doc_id % 2 = 0 THEN 'warning' ELSE 'error' END AS severity, CAST(doc_id AS VARCHAR) AS path, 'at ' || CAST(doc_id AS VARCHAR) AS actual_value FROM documents WHERE doc_id % 10 < 2)")
def diagnostic_findings(spark, sf_dir):
    return C.diagnostic_findings(_diagnostics(spark, sf_dir)).select("code", "severity", "path", "actual_value")


def _diagnostics(spark, sf_dir) -> DataFrame:
    even = F.col("doc_id") % 2 == 0
    d = T.table(spark, sf_dir, "documents").where("doc_id % 10 < 2")
    return d.select(F.col("doc_id").cast("string").alias("doc_path"), F.when(even, "warning").otherwise("error").alias("severity"), F.when(even, "frontmatter-unclosed").otherwise("read-failed").alias("code"), F.concat(F.lit("at "), F.col("doc_id").cast("string")).alias("message"))


@query("SELECT count_if(doc_id % 10 = 1) > 0 AS any_error FROM documents")
def any_error(spark, sf_dir):
    return A.any_error(_diagnostics(spark, sf_dir))


# -- values, templates ---------------------------------------------------------------------------

_SHAPES = """(SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN d WHEN 1 THEN d || 'T00:00:00.0Z' WHEN 2 THEN d || ' 10:20' WHEN 3 THEN '10:20:30.5+01:00' WHEN 4 THEN substr(d, 1, 8) || '31' WHEN 5 THEN d || 'T24:00' ELSE '1' || d END AS s
  FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders))"""
_DAY = "(regexp_full_match({0}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND TRY_CAST({0} AS DATE) IS NOT NULL)"


@query(f"""SELECT o_orderkey, coalesce({_DAY.format('s')} OR (regexp_full_match(s, '.{{10}}[T ]00:00(:00(\\.\\d+)?)?Z?') AND {_DAY.format('substr(s, 1, 10)')}), FALSE) AS is_date,
  coalesce(regexp_full_match(s, '.{{10}}[T ]([01]\\d|2[0-3]):[0-5]\\d(:[0-5]\\d(\\.\\d+)?)?Z?') AND {_DAY.format('substr(s, 1, 10)')}, FALSE) AS is_datetime,
  regexp_full_match(s, '([01]\\d|2[0-3]):[0-5]\\d(:[0-5]\\d(\\.\\d+)?)?([+]\\d\\d:\\d\\d)?') AS is_time FROM {_SHAPES}""")
def date_shapes(spark, sf_dir):
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    forms = [d, F.concat(d, F.lit("T00:00:00.0Z")), F.concat(d, F.lit(" 10:20")), F.lit("10:20:30.5+01:00"), F.concat(F.substring(d, 1, 8), F.lit("31")), F.concat(d, F.lit("T24:00")), F.concat(F.lit("1"), d)]
    s = F.element_at(F.array(*forms), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return T.table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", V.is_date(F.col("s")).alias("is_date"), V.is_datetime(F.col("s")).alias("is_datetime"), V.is_time(F.col("s")).alias("is_time"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') || ' on ' || strftime(o_orderdate, '%a') || ' ' || strftime(o_orderdate, '%I') || lower(strftime(o_orderdate, '%p')) || ' M' || ' {{' || upper(o_orderpriority) || '}} '
  || trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') || '/' || upper(o_orderstatus) || ' x y' AS s FROM orders""")
def template_render(spark, sf_dir):
    names = {"p": F.col("o_orderpriority"), "s": F.concat(F.lit("2020-01-02-"), F.lower("o_orderstatus"), F.lit("_X-y"))}
    template = "{{date:YYYYMMDD [on] ddd hha}} M {{{{{{title|upper}}}}}} {{ var.p | slugify }}/{{var.s | strip_date_prefix | sentencecase}}{{path.none}}"
    return T.table(spark, sf_dir, "orders").select("o_orderkey", templates.rendered(template, title=F.col("o_orderpriority"), now=F.col("o_orderdate"), names=names).alias("s"))


@query(f"SELECT path, CASE WHEN quality IS NOT NULL THEN 'q' || CAST(quality AS VARCHAR) || '/' || stem || '-' || lang || '/' || stem || '.md' END AS new_path, CASE WHEN quality IS NULL THEN 'missing field quality' END AS problem FROM {DOC}")
def destinations(spark, sf_dir):
    made, problem = templates.destination("q{frontmatter.quality}/{stem}-{frontmatter.lang}/", F.col("path"), F.col("metadata"), folder=True)
    return T.documents(spark, sf_dir).select("path", made.alias("new_path"), problem.alias("problem"))


@query(f"WITH v AS {VAULT} SELECT a.doc_id, CASE WHEN a.source = b.source AND a.lang = b.lang THEN b.stem || '.md' WHEN a.source = b.source THEN '../' || b.lang || '/' || b.stem || '.md' ELSE '../../' || b.path END AS way FROM v a JOIN v b ON b.doc_id = a.doc_id + 1")
def relative_paths(spark, sf_dir):
    d = _documents(spark, sf_dir).select("doc_id", "path")
    to = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("path").alias("to"))
    return d.join(to, "doc_id").select("doc_id", V.relative(V.path_parts(F.col("path"))[0], F.col("to")).alias("way"))


@query(f"SELECT path, CASE WHEN source = 'src1' THEN lang END AS language, CASE WHEN source = 'src1' THEN stem END AS name FROM {DOC}")
def path_captures(spark, sf_dir):
    caught = globs.captures(F.col("path"), "src1/{{language}}/{{name}}.md")
    return _documents(spark, sf_dir).select("path", *[c.alias(n) for n, c in caught.items()])


@query("SELECT conv_id, string_agg(coalesce(role, '(null)'), ', ' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def inline_lists(spark, sf_dir):
    c = T.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    v = V.field(F.parse_json(F.to_json(F.struct("r"))), "r")
    return c.select("conv_id", V.inline(v).alias("roles"))


@query(f"SELECT doc_id, quality FROM {DOC} ORDER BY CAST(quality AS VARCHAR) DESC NULLS LAST, path LIMIT 25 OFFSET 5")
def get_order(spark, sf_dir):
    return page(by_display(T.documents(spark, sf_dir), "quality", descending=True), 25, 6).select("doc_id", "quality")


@query("SELECT unnest(['lang', 'quality', 'source', 'toxic']) AS field")
def field_names(spark, sf_dir):
    return A.field_names(T.documents(spark, sf_dir), dated=("n_chars",))


@query(f"SELECT path, 'lang' AS field, lang AS value FROM {DOC} UNION ALL SELECT path, 'quality', CAST(quality AS VARCHAR) FROM {DOC} UNION ALL SELECT path, 'never', NULL FROM {DOC}")
def fields_with_absent(spark, sf_dir):
    return A.exploded(T.documents(spark, sf_dir), declared=("lang", "quality", "never")).where("field IN ('lang', 'quality', 'never')")


@query("SELECT source, count(*) AS n FROM documents WHERE lang IN ('en', 'fr') AND source <> 'src4' AND starts_with(source, 'src1') GROUP BY 1")
def find_brackets(spark, sf_dir):
    d = _documents(spark, sf_dir).withColumn("ref", F.concat(F.lit("[["), "source", F.lit("]]")))
    d = d.withColumn("metadata", F.parse_json(F.to_json(F.struct("ref", "lang"))))
    found = [Query(d, typed=t).isin("lang", ["en", "[[fr]]"]).not_eq("ref", "src4").starts_with("ref", "[[src1").frame() for t in (("ref", "lang"), ())]
    both = found[0].select("doc_id", "source").join(found[1].select("doc_id"), "doc_id")  # the two ways agree
    return both.groupBy("source").agg(F.count("*").alias("n"))


# -- plans and edits -----------------------------------------------------------------------------

_REPAIRS = [
    R.Repair("add_frontmatter", code="frontmatter-required-field-missing", field="quality", set_field="quality", value="0"), R.Repair("set_frontmatter", code="value-not-allowed", actual_value="src7", set_field="source", value="src3"),
    R.Repair("remove_frontmatter", code="frontmatter-forbidden-field"), R.Repair("move_document", code="document-misrouted", destination="src1/{frontmatter.lang}/{filename}"),
]
PLANNED = f"""(SELECT path, code, rule, field, actual_value, lang, CASE WHEN code = 'frontmatter-required-field-missing' AND field = 'quality' THEN 'add_frontmatter' WHEN code = 'value-not-allowed' AND actual_value = 'src7' THEN 'set_frontmatter'
  WHEN code = 'frontmatter-forbidden-field' THEN 'remove_frontmatter' WHEN code = 'document-misrouted' THEN 'move_document' END AS operation FROM ({FINDINGS}) JOIN (SELECT path, lang FROM {DOC}) USING (path))"""


def _planned(spark, sf_dir):
    d = T.documents(spark, sf_dir).withColumn("hash", F.sha2("body", 256))
    return R.plan(findings(spark, sf_dir), _REPAIRS, d)


@query(f"""SELECT path, code, operation, field, CASE WHEN operation IN ('set_frontmatter', 'remove_frontmatter') THEN actual_value END AS old_value, CASE operation WHEN 'add_frontmatter' THEN '0' WHEN 'set_frontmatter' THEN 'src3' END AS new_value,
  CASE WHEN operation = 'move_document' THEN 'src1/' || lang || '/' || regexp_extract(path, '[^/]*$') END AS destination FROM {PLANNED} WHERE operation IS NOT NULL""")
def repair_plan(spark, sf_dir):
    return _planned(spark, sf_dir)[0].select("path", "code", "operation", "field", "old_value", "new_value", "destination")


@query(f"SELECT CASE WHEN code = 'frontmatter-required-field-missing' THEN 'missing-default' ELSE 'no-rule-matched' END AS skip_reason, count(*) AS n FROM {PLANNED} WHERE operation IS NULL GROUP BY 1")
def repair_skips(spark, sf_dir):
    return R.skip_summary(_planned(spark, sf_dir)[1])


@query(f"""WITH r AS {RESOLVED} SELECT path, CASE WHEN t = 5 AND status = 'ambiguous' THEN 'ambiguous-target' ELSE 'link-decision-needed' END AS skip_reason FROM r WHERE status <> 'resolved'""")
def repair_broken_links(spark, sf_dir):
    d = _documents(spark, sf_dir).withColumns({"hash": F.lit("h"), "stem": F.concat(F.lit("a stem unlike any target "), "stem")})
    changes, skipped = R.plan(C.link_findings(_resolved(spark, sf_dir)), [], d)
    return skipped.select("path", "skip_reason").unionByName(changes.select("path", F.lit("none").alias("skip_reason")))


_MOVED = "CASE WHEN doc_id % 9 = 0 THEN 'archive/' || stem || 'x.md' WHEN doc_id % 9 = 1 THEN 'archive/' || stem || '.md' END"


@query(f"""WITH r AS {RESOLVED}, m AS (SELECT path, {_MOVED} AS new_path, source || '/' || lang AS folder, doc_id FROM {VAULT} WHERE doc_id % 9 < 2),
  hit AS (SELECT m.path, m.new_path, coalesce(o.new_path, r.path) AS source_path, r.t, r.target, r.status, o.new_path AS own FROM r JOIN m ON r.resolved_path = m.path LEFT JOIN m o ON o.path = r.path)
  SELECT path, new_path, source_path, CASE t WHEN 2 THEN 'markdown' WHEN 1 THEN 'path' ELSE 'stem' END AS how,
    CASE t WHEN 0 THEN '[[' || regexp_extract(new_path, '([^/]*)\\.md$', 1) || '|L]]' WHEN 1 THEN '[[' || regexp_extract(new_path, '^(.*)\\.md$', 1) || ']]' WHEN 2 THEN '[t](' || CASE WHEN own IS NULL THEN '../../' || new_path ELSE regexp_extract(new_path, '[^/]*$') END || '#a)'
      WHEN 3 THEN '![[' || regexp_extract(new_path, '([^/]*)\\.md$', 1) || ']]' ELSE '[[' || regexp_extract(new_path, '([^/]*)\\.md$', 1) || CASE WHEN t = 4 THEN '#Part ' || (SELECT CAST(doc_id % 10 AS VARCHAR) FROM m x WHERE x.path = hit.path) ELSE '' END || ']]' END AS new_raw
  FROM hit WHERE t IN (1, 2) OR suffix(new_path, 'x.md')""")
def move_rewrites(spark, sf_dir):
    d = _documents(spark, sf_dir)
    new = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("archive/"), "stem", F.lit("x.md"))).when(F.col("doc_id") % 9 == 1, F.concat(F.lit("archive/"), "stem", F.lit(".md")))
    moves = d.select("path", new.alias("new_path")).where("new_path IS NOT NULL")
    return R.link_impact(_resolved(spark, sf_dir), moves).select("path", "new_path", "source_path", "how", "new_raw")


@query(f"""WITH r AS {RESOLVED} SELECT path, 'rewrite_link' AS operation, CAST(NULL AS VARCHAR) AS field, '7' AS old_value, 'new' AS new_value FROM r WHERE resolved_path = (SELECT path FROM r WHERE doc_id = 7) AND t IN (0, 3)
  UNION ALL SELECT path, 'rewrite_link', NULL, target, 'new' FROM r WHERE doc_id = 7 AND t IN (1, 4) AND resolved_path = path
  UNION ALL SELECT path, 'set_frontmatter', 'one', '[[7]]', '[[new]]' FROM r WHERE doc_id % 100 = 3
  UNION ALL SELECT path, 'set_frontmatter', 'many', '["[[7]]","[[8]]",7]', '["[[new]]","[[8]]",7]' FROM r WHERE doc_id % 100 = 4""")
def rewrite_wikilink(spark, sf_dir):
    d = _documents(spark, sf_dir)
    meta = F.when(F.col("doc_id") % 100 == 3, '{"one": "[[7]]", "two": "[[7]] and more"}').when(F.col("doc_id") % 100 == 4, '{"many": ["[[7]]", "[[8]]", 7]}').otherwise("{}")
    path = d.where("doc_id = 7").select("path").first()[0]  # one row
    return R.rewrite_wikilink(d.withColumn("metadata", F.parse_json(meta)), _resolved(spark, sf_dir), path, "7", "new")


_BODY = "# A\n\ntext {}\n\n```\n# A\n```\n\n## B\n\nold\n\n# C\nlast [[x|y]] `[[x]]`"


def _bodies(spark, sf_dir) -> DataFrame:
    d = _documents(spark, sf_dir)
    body = F.concat(F.lit(_BODY.split("{}")[0]), "stem", F.lit(_BODY.split("{}")[1]))
    return d.select("doc_id", "path", "stem", F.lit("lang: en # spoken\ntags: [a]\n").alias("block"), body.alias("body")).withColumn("hash", F.sha2(F.concat(F.lit("---\n"), "block", F.lit("---\n"), "body"), 256))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("{}", "' || stem || '") .replace("\n", "' || chr(10) || '") + "'"


_AFTER = {
    0: _BODY.replace("old\n", "old\nmore\n"), 1: "# A\n\ntext {}\n\n```\n# A\n```\n\n# C\nnew\n", 2: _BODY, 3: _BODY.replace("last [[x|y]]", "last [[z|y]]").replace("# C", "above\n# C"), 4: _BODY,
}
_REFUSED = {2: "heading-missing", 4: "hash-mismatch"}


@query("SELECT doc_id, CASE doc_id % 6 " + " ".join(f"WHEN {k} THEN {_sql_text(t)}" for k, t in _AFTER.items()) + f" ELSE {_sql_text(_BODY)} END AS body, CASE doc_id % 6 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in _REFUSED.items()) + f" END AS refused FROM {VAULT}")
def body_edits(spark, sf_dir):
    d = _bodies(spark, sf_dir)
    edit = lambda k, position, op, target, text: d.where(F.col("doc_id") % 6 == k).select("path", F.lit(position).alias("position"), F.lit(op).alias("op"), F.lit(target).alias("target"), F.lit(text).alias("text"), (F.lit("other") if k == 4 else F.col("hash")).alias("expected_hash"))
    listed = [(0, 0, "append_to_section", "B", "more"), (1, 0, "delete_section", "B", ""), (1, 1, "replace_section", "C", "new"), (2, 0, "replace_section", "C", "gone"), (2, 1, "delete_section", "D", ""), (3, 1, "insert_before_heading", "C", "above"), (3, 0, "rewrite_link", "x", "z"), (4, 0, "str_replace", "old", "new")]
    edits = edit(*listed[0])
    for e in listed[1:]:
        edits = edits.unionByName(edit(*e))
    return M.apply_edits(d.drop("doc_id", "stem"), edits).join(d.select("doc_id", "path"), "path").select("doc_id", "body", "refused")


@query(f"""SELECT CASE doc_id % 7 WHEN 3 THEN 'moved/' || stem || '.md' ELSE path END AS path, CASE doc_id % 7 WHEN 0 THEN 'lang: de' || chr(10) || 'tags: [a]' || chr(10) WHEN 1 THEN 'lang: en # spoken' || chr(10) || 'tags:' || chr(10) || '  - a' || chr(10) || '  - b c' || chr(10)
    ELSE 'lang: en # spoken' || chr(10) || 'tags: [a]' || chr(10) END AS block FROM {VAULT} WHERE doc_id % 7 <> 2
  UNION ALL SELECT 'made/' || stem || '.md', NULL FROM {VAULT} WHERE doc_id % 7 = 4""")
def plan_apply(spark, sf_dir):
    d = _bodies(spark, sf_dir)
    none = F.lit(None).cast("string")

    def change(k, operation, field=None, new=None, path=None, destination=None, stale=False):
        rows = d.where(F.col("doc_id") % 7 == k)
        return rows.select((F.col("path") if path is None else path).alias("path"), F.lit(operation).alias("operation"), F.lit(field).cast("string").alias("field"), none.alias("old_value"), F.lit(new).cast("string").alias("new_value"), (none if destination is None else destination).alias("destination"), (F.lit("x") if stale else none if path is not None else F.col("hash")).alias("document_hash"))

    changes = change(0, "set_frontmatter", "lang", "de").unionByName(change(1, "push_frontmatter", "tags", "b c")).unionByName(change(2, "delete_document"))
    changes = changes.unionByName(change(3, "move_document", destination=F.concat(F.lit("moved/"), "stem", F.lit(".md")))).unionByName(change(4, "create_document", new="hello", path=F.concat(F.lit("made/"), "stem", F.lit(".md"))))
    changes = changes.unionByName(change(5, "move_document", destination=F.lit("../out.md"))).unionByName(change(6, "remove_frontmatter", "lang", stale=True))
    links = d.limit(0).select(F.col("path").alias("source_path"), F.col("path").alias("resolved_path"))
    return M.apply_plan(d.drop("doc_id"), links, changes)[0].select("path", "block")


@query(f"""WITH r AS {RESOLVED}, gone AS (SELECT path FROM {VAULT} WHERE doc_id % 4 = 0) SELECT path FROM {VAULT} WHERE path NOT IN (SELECT path FROM gone) OR path IN (SELECT resolved_path FROM r WHERE resolved_path IS NOT NULL AND path NOT IN (SELECT path FROM gone))""")
def delete_guarded(spark, sf_dir):
    d = _documents(spark, sf_dir)
    return M.deleted(d.select("doc_id", "path"), _resolved(spark, sf_dir), d.where("doc_id % 4 = 0").select("path")).select("path")


@query(f"""SELECT path, CASE WHEN source = 'src1' THEN '"a ' || lang || '"' WHEN lang = 'de' THEN '2' END AS kind, CASE WHEN source = 'src1' AND lang = 'fr' THEN '"gold ' || stem || '"' WHEN lang = 'en' THEN 'true' END AS tier FROM {VAULT}""")
def defaults_fixpoint(spark, sf_dir):
    rules = [
        C.Rule("late", where={"kind": "a fr"}, defaults={"tier": "gold {{title}}"}), C.Rule("first", path="src1/{{place}}/*.md", defaults={"kind": "a {{path.place}}"}), C.Rule("second", where={"lang": "de"}, defaults={"kind": 2, "lang": "never"}),
        C.Rule("third", where={"lang": ["en", "xx"]}, defaults={"tier": True}),
    ]
    d = _documents(spark, sf_dir).withColumn("fields", F.create_map(F.lit("lang"), F.concat(F.lit('"'), "lang", F.lit('"'))))
    out = config.with_defaults(d, rules, title=F.col("stem"), now=F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return out.select("path", F.try_element_at("fields", F.lit("kind")).alias("kind"), F.try_element_at("fields", F.lit("tier")).alias("tier"))


@query("""WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) * 100 AS bytes FROM events GROUP BY 1), c AS (SELECT day, row_number() OVER (ORDER BY day DESC) AS r, sum(bytes) OVER (ORDER BY day DESC) AS upto FROM d)
  SELECT day FROM c WHERE day < '2024-01-06' OR (upto > 20000 AND r > 1)""")
def audit_expired(spark, sf_dir):
    days = T.table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg((F.count("*") * 100).alias("bytes"))
    return audit.expired(days, "2024-01-16", 10, 20_000)


# -- Markdown files ------------------------------------------------------------------------------

_FILES = [
    "---\nlang: de\nup: \"[[12]]\"\naliases: [A {}, 5]\n---\n# One {}\n\nsee [[{}|x]] `[[no]]` ![[p.png]]\n", "## Zwei\n\n```\n[[no]]\n```\n[t](../a%20b.md#h) é [[#Zwei]] ^b{}\n",
    "---\nopen\n", "---\na: [1\n---\n[r][q]\n\n[q]: x.md\n",
]
_CONTENT = f"(SELECT path, stem, doc_id, length(stem) AS n, doc_id % 4 AS f, CASE doc_id % 4 " + " ".join(f"WHEN {k} THEN {_sql_text(t)}" for k, t in enumerate(_FILES)) + f" END AS content FROM {VAULT})"


def _parsed(spark, sf_dir) -> dict[str, DataFrame]:
    d = _documents(spark, sf_dir)
    pieces = [F.concat(*[x for k, t in enumerate(f.split("{}")) for x in ([F.col("stem")] if k else []) + [F.lit(t)]]) for f in _FILES]
    content = F.element_at(F.array(*pieces), (F.col("doc_id") % 4 + 1).cast("int"))
    return markdown.relations(markdown.parse_files(d.select("path", content.cast("binary").alias("content"))))


@query(f"""SELECT path, x.kind, x.target, x.label, x.anchor, x.area, x.property, CAST(x.line AS INT) AS line, CAST(x.col AS INT) AS "column", CAST(x.at AS BIGINT) AS byte_offset FROM (SELECT path, unnest(CASE f
  WHEN 0 THEN [{{'kind': 'wikilink', 'target': '12', 'label': NULL::VARCHAR, 'anchor': NULL::VARCHAR, 'area': 'frontmatter', 'property': 'up', 'line': 3, 'col': 6, 'at': 18}},
    {{'kind': 'wikilink', 'target': stem, 'label': 'x', 'anchor': NULL, 'area': 'body', 'property': NULL, 'line': 8, 'col': 5, 'at': 59 + 2 * n}}, {{'kind': 'embed', 'target': 'p.png', 'label': NULL, 'anchor': NULL, 'area': 'body', 'property': NULL, 'line': 8, 'col': 21 + n, 'at': 75 + 3 * n}}]
  WHEN 1 THEN [{{'kind': 'markdown', 'target': '../a b.md', 'label': 't', 'anchor': 'h', 'area': 'body', 'property': NULL, 'line': 6, 'col': 1, 'at': 24}}, {{'kind': 'wikilink', 'target': '', 'label': NULL, 'anchor': 'Zwei', 'area': 'body', 'property': NULL, 'line': 6, 'col': 23, 'at': 46}}]
  WHEN 3 THEN [{{'kind': 'markdown', 'target': 'x.md', 'label': 'r', 'anchor': NULL, 'area': 'body', 'property': NULL, 'line': 4, 'col': 1, 'at': 14}}] END) AS x FROM {_CONTENT})""")
def markdown_links(spark, sf_dir):
    return _parsed(spark, sf_dir)["links"].select(F.col("source_path").alias("path"), "kind", "target", "label", "anchor", "area", "property", "line", "column", "byte_offset")


@query(f"SELECT path, CAST(f + 1 AS INT) AS level, CASE f WHEN 0 THEN 'One ' || stem ELSE 'Zwei' END AS text, CASE f WHEN 0 THEN 'one-' || stem ELSE 'zwei' END AS slug, CAST(CASE f WHEN 0 THEN 6 ELSE 1 END AS INT) AS line FROM {_CONTENT} WHERE f < 2")
def markdown_headings(spark, sf_dir):
    return _parsed(spark, sf_dir)["headings"].select(F.col("doc_path").alias("path"), "level", "text", "slug", "line")


@query(f"SELECT path, CASE f WHEN 0 THEN '{{\"aliases\": [\"A ' || stem || '\", 5], \"lang\": \"de\", \"up\": \"[[12]]\"}}' END AS frontmatter_json, sha256(content) AS hash, CAST(length(CASE f WHEN 3 THEN substr(content, 15) WHEN 0 THEN substr(content, 48 + n) ELSE content END) AS BIGINT) AS n_body FROM {_CONTENT}")
def markdown_documents(spark, sf_dir):
    return _parsed(spark, sf_dir)["documents"].select("path", "frontmatter_json", "hash", F.length("body").cast("long").alias("n_body"))


@query(f"SELECT path, 'alias' AS what, unnest(['a ' || stem, '5']) AS value FROM {_CONTENT} WHERE f = 0 UNION ALL SELECT path, 'block', 'b' || stem FROM {_CONTENT} WHERE f = 1 UNION ALL SELECT path, 'warning', CASE f WHEN 2 THEN 'frontmatter-unclosed' ELSE 'frontmatter-parse-failed' END FROM {_CONTENT} WHERE f > 1")
def markdown_marks(spark, sf_dir):
    r = _parsed(spark, sf_dir)
    row = lambda frame, what, value: frame.select(F.col("doc_path").alias("path"), what.alias("what"), F.col(value).alias("value"))
    return row(G.aliases_of(r["documents"]), F.lit("alias"), "alias").unionByName(row(r["block_ids"], F.lit("block"), "block_id")).unionByName(row(r["diagnostics"], F.col("severity"), "code"))


@query(f"""SELECT a.path, b.path AS resolved_path, CASE WHEN b.path IS NULL THEN 'unresolved' ELSE 'resolved' END AS status FROM {VAULT} a LEFT JOIN {VAULT} b ON b.doc_id = a.doc_id + 1 AND b.doc_id % 7 <> 3 WHERE a.doc_id % 7 <> 3""")
def refresh_links(spark, sf_dir):
    d = _documents(spark, sf_dir)
    content = F.concat(F.lit("[["), (F.col("doc_id") + 1).cast("string"), F.lit("]]")).cast("binary")
    files = d.select("doc_id", "path", content.alias("content"))
    old = markdown.relations(markdown.parse_files(files.where("doc_id % 5 > 0")))
    changed = markdown.parse_files(files.where("doc_id % 5 = 0 AND doc_id % 7 <> 3"))
    found = audit.refreshed(old, changed, files.where("doc_id % 7 = 3").select("path"), files.where("doc_id % 7 <> 3").select("path"))
    return found["links"].select(F.col("source_path").alias("path"), "resolved_path", "status")
