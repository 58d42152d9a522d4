"""Named queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import aggregate as A
from ..operators import graph as G
from ..operators import repair as R
from ..operators import validate as C
from ..operators.find import Query, envelope, nearest_fields, page
from ..sources import tables as T
from ..streaming import audit

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
TYPED = ("lang", "source", "n_chars", "quality", "toxic")
#: The document relation in SQL.
DOC = "(SELECT d.doc_id, source || '/' || lang || '/' || CAST(d.doc_id AS VARCHAR) || '.md' AS path, CAST(d.doc_id AS VARCHAR) AS stem, text AS body, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def docs(spark, sf_dir, labelled: bool = True, typed: bool = True) -> Query:
    return Query(T.documents(spark, sf_dir, labelled), typed=TYPED if typed else (), plain=("lang", "source"))


def _ids(q: Query) -> DataFrame:
    return q.frame().select("doc_id", "path")


# -- predicates ---------------------------------------------------------------------------------


@query(f"SELECT doc_id, path FROM {DOC} WHERE lang = 'en'")
def find_eq_str(spark, sf_dir):
    return _ids(docs(spark, sf_dir, labelled=False).eq("lang", "en"))


@query(f"SELECT doc_id, path FROM {DOC} WHERE lang = 'en'")
def find_eq_variant(spark, sf_dir):
    return _ids(docs(spark, sf_dir, typed=False).eq("lang", "en"))


@query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) = 26")
def find_eq_num_json(spark, sf_dir):
    return Query(T.events(spark, sf_dir)).eq("k", 26).frame().select("event_id")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') LIKE '2%'")
def find_starts_json(spark, sf_dir):
    return Query(T.events(spark, sf_dir)).starts_with("k", "2").frame().select("event_id")


@query(f"SELECT doc_id, path FROM {DOC} WHERE quality IS NOT NULL AND quality <> 1")
def find_not_eq_missing(spark, sf_dir):
    return _ids(docs(spark, sf_dir).not_eq("quality", 1))


@query(f"SELECT doc_id, path FROM {DOC} WHERE quality IS NOT NULL AND quality <> 1")
def find_not_eq_variant(spark, sf_dir):
    return _ids(docs(spark, sf_dir, typed=False).not_eq("quality", 1))


@query(f"SELECT doc_id, path FROM {DOC} WHERE source IN ('src1', 'src7')")
def find_in(spark, sf_dir):
    return _ids(docs(spark, sf_dir, labelled=False).isin("source", ["src1", "src7"]))


@query(f"SELECT doc_id, path FROM {DOC} WHERE toxic IS NOT NULL AND toxic NOT IN (1, 5) AND source NOT IN ('src1', 'src7')")
def find_not_in(spark, sf_dir):
    return _ids(docs(spark, sf_dir).not_in("toxic", [1, 5]).not_in("source", ["src1", "src7"]))


@query(f"SELECT doc_id, path FROM {DOC} WHERE quality IS NOT NULL")
def find_has(spark, sf_dir):
    return _ids(docs(spark, sf_dir, typed=False).has("quality"))


@query(f"SELECT doc_id, path FROM {DOC} WHERE quality IS NULL")
def find_missing(spark, sf_dir):
    return _ids(docs(spark, sf_dir, typed=False).missing("quality"))


def _parts(spark, sf_dir) -> Query:
    p = T.table(spark, sf_dir, "part")
    return Query(p.withColumn("path", F.col("p_partkey").cast("string")), typed=("p_name", "p_type"), plain=("p_name", "p_type"))


@query("SELECT p_partkey FROM part WHERE starts_with(p_type, 'S')")
def find_starts(spark, sf_dir):
    return _parts(spark, sf_dir).starts_with("p_type", "S").frame().select("p_partkey")


@query("SELECT p_partkey FROM part WHERE suffix(p_name, 'bolt')")
def find_ends(spark, sf_dir):
    return _parts(spark, sf_dir).ends_with("p_name", "bolt").frame().select("p_partkey")


@query("SELECT p_partkey FROM part WHERE contains(p_name, 'e')")
def find_contains(spark, sf_dir):
    return _parts(spark, sf_dir).contains("p_name", "e").frame().select("p_partkey")


def _orders(spark, sf_dir) -> Query:
    o = T.table(spark, sf_dir, "orders")
    return Query(o.withColumns({"path": F.col("o_orderkey").cast("string"), "day": F.date_format("o_orderdate", "yyyy-MM-dd")}), typed=("day",), plain=("day",))


@query("SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') < '1995-06-17'")
def find_before(spark, sf_dir):
    return _orders(spark, sf_dir).before("day", "1995-06-17").frame().select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') > '1996-01-01'")
def find_after(spark, sf_dir):
    return _orders(spark, sf_dir).after("day", "1996-01-01").frame().select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') = '1995-06-17'")
def find_on(spark, sf_dir):
    return _orders(spark, sf_dir).on("day", "1995-06-17").frame().select("o_orderkey")


@query(f"SELECT doc_id, path FROM {DOC} WHERE {_FOLD.format('body')} LIKE '%apache%license%'")
def find_text_ascii_ci(spark, sf_dir):
    return _ids(docs(spark, sf_dir, labelled=False).text("Apache%LICENSE"))


@query(f"SELECT doc_id, path FROM {DOC} WHERE regexp_full_match(path, '(src1[^/]*/(en|de)/[^/]*\\.md)|(src2/.*7\\.md)')")
def find_path_glob(spark, sf_dir):
    return _ids(docs(spark, sf_dir, labelled=False).path("src1*/{en,de}/*.md", "src2/**/*7.md"))


def _order_links(spark, sf_dir) -> DataFrame:
    li = T.table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("source_path"), F.col("l_suppkey").alias("resolved_path"), F.lit("resolved").alias("status"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = 3) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = 7)")
def find_links_to_all(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"))
    return Query(o, links=_order_links(spark, sf_dir)).links_to(3, 7).frame().select(F.col("path").alias("o_orderkey"))


def _resolved_orders(spark, sf_dir) -> DataFrame:
    links = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_path"), F.col("o_custkey").alias("key"))
    some = T.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key"), F.col("c_custkey").alias("path"))
    return G.resolve_by_key(links, some, "key")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def find_unresolved(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"))
    return Query(o, links=_resolved_orders(spark, sf_dir)).unresolved_links().frame().select(F.col("path").alias("o_orderkey"))


@query(f"SELECT doc_id, path, n_chars FROM {DOC} WHERE lang = 'en' AND source NOT IN ('src3') ORDER BY n_chars DESC, path LIMIT 10 OFFSET 5")
def find_sort_limit_offset(spark, sf_dir):
    q = docs(spark, sf_dir, labelled=False).eq("lang", "en").not_in("source", ["src3"])
    return page(q.sorted("n_chars", descending=True), 10, 6).select("doc_id", "path", "n_chars")


@query(f"SELECT doc_id, CASE WHEN quality IS NULL THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END AS rank, CASE WHEN quality = 0 THEN CAST(n_chars AS DOUBLE) END AS number, CASE WHEN quality = 1 THEN lang END AS text FROM {DOC}")
def find_sort_mixed(spark, sf_dir):
    """The keys by which a field of mixed types is sorted, for every row: nulls, numbers, text."""
    d = T.documents(spark, sf_dir)
    mixed = F.when(F.col("quality") == 1, F.to_json(F.struct(F.col("lang").alias("m")))).when(F.col("quality") == 0, F.to_json(F.struct(F.col("n_chars").alias("m")))).otherwise("{}")
    ordered = Query(d.withColumn("metadata", F.parse_json(mixed))).sorted("m", everything=True)
    return ordered.select("doc_id", *[k.alias(n) for n, k in zip(("rank", "number", "text"), V.sort_keys(V.field("metadata", "m")))])


@query(f"SELECT count(*) AS total, least(count(*), 10) AS returned, count(*) > 10 AS truncated FROM {DOC} WHERE lang = 'de'")
def find_envelope(spark, sf_dir):
    return envelope(docs(spark, sf_dir, labelled=False).eq("lang", "de").frame(), 10)


@query("SELECT field, CAST(levenshtein(field, 'qualtiy') AS INT) AS distance FROM (VALUES ('lang'), ('source'), ('n_chars'), ('quality'), ('toxic')) t(field) WHERE levenshtein(field, 'qualtiy') <= 2")
def find_did_you_mean(spark, sf_dir):
    return nearest_fields(A.field_names(T.documents(spark, sf_dir)), "qualtiy")


# -- counts and distributions -------------------------------------------------------------------


@query(f"SELECT count(*) AS n FROM {DOC} WHERE lang <> 'en'")
def count_total(spark, sf_dir):
    return docs(spark, sf_dir, labelled=False).not_eq("lang", "en").frame().agg(F.count("*").alias("n"))


@query(f"SELECT coalesce(CAST(quality AS VARCHAR), '(missing)') AS quality, count(*) AS n FROM {DOC} GROUP BY 1")
def count_by(spark, sf_dir):
    return A.count_by(T.documents(spark, sf_dir), {"quality": V.group_key(V.field("metadata", "quality"))})


@query(f"SELECT lang, coalesce(CAST(toxic AS VARCHAR), '(missing)') AS toxic, count(*) AS n FROM {DOC} GROUP BY 1, 2")
def count_by_multi(spark, sf_dir):
    return A.count_by(T.documents(spark, sf_dir), {"lang": F.col("lang"), "toxic": F.col("toxic")})


@query("SELECT coalesce(json_extract_string(props, '$.k'), '(missing)') AS k, count(*) AS n FROM events GROUP BY 1")
def count_by_json(spark, sf_dir):
    return A.count_by(T.events(spark, sf_dir), {"k": V.group_key(V.field("metadata", "k"))})


_LONG = f"(SELECT path, unnest(['lang', 'source', 'quality', 'toxic']) AS field, unnest([lang, source, CAST(quality AS VARCHAR), CAST(toxic AS VARCHAR)]) AS value FROM {DOC})"


def _long(spark, sf_dir) -> DataFrame:
    return A.long_form(T.documents(spark, sf_dir), {n: F.col(n) for n in ("lang", "source", "quality", "toxic")})


@query(f"""SELECT field, value, n, greatest(k - 3, 0) AS more FROM (
  SELECT field, value, n, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS r, count(*) OVER (PARTITION BY field) AS k
  FROM (SELECT field, coalesce(value, '(missing)') AS value, count(*) AS n FROM {_LONG} GROUP BY 1, 2)) WHERE r <= 3""")
def describe_distribution(spark, sf_dir):
    return A.distribution(_long(spark, sf_dir), 3)


@query(f"SELECT field, value, count(*) AS n FROM {_LONG} WHERE value IS NOT NULL GROUP BY 1, 2")
def describe_variant(spark, sf_dir):
    d = T.documents(spark, sf_dir)
    return A.exploded(d).where("field <> 'n_chars'").groupBy("field", "value").agg(F.count("*").alias("n"))


@query(f"""SELECT field, count(value) AS occurrences, count(DISTINCT value) AS n_distinct, count(DISTINCT value) >= 0.9 * count(value) AS is_identity
  FROM (SELECT unnest(['lang', 'source', 'path']) AS field, unnest([lang, source, path]) AS value FROM {DOC}) GROUP BY field""")
def describe_identity_skip(spark, sf_dir):
    d = T.documents(spark, sf_dir, labelled=False)
    return A.identities(A.long_form(d, {"lang": F.col("lang"), "source": F.col("source"), "path": F.col("path")}))


@query("""SELECT 'o_orderdate' AS field, min(strftime(o_orderdate, '%Y-%m-%d')) AS low, max(strftime(o_orderdate, '%Y-%m-%d')) AS high FROM orders
  UNION ALL SELECT 'ts', min(strftime(ts, '%Y-%m-%d')), max(strftime(ts, '%Y-%m-%d')) FROM events""")
def describe_date_bounds(spark, sf_dir):
    one = lambda t, c: T.table(spark, sf_dir, t).select(F.lit(c).alias("field"), F.date_format(c, "yyyy-MM-dd").alias("value"))
    return A.bounds(one("orders", "o_orderdate").unionByName(one("events", "ts")))


@query(f"""SELECT f.field, n_docs, n_distinct, f.field IN ('lang', 'source') AS all_text, top_value FROM
  (SELECT field, count(value) AS n_docs, count(DISTINCT value) AS n_distinct FROM {_LONG} GROUP BY field) f JOIN
  (SELECT field, value AS top_value FROM (SELECT field, value, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, value) AS r FROM {_LONG} WHERE value IS NOT NULL GROUP BY field, value) WHERE r = 1) t USING (field)""")
def field_stats(spark, sf_dir):
    return A.field_stats(_long(spark, sf_dir).withColumn("is_text", ~F.col("field").isin("quality", "toxic")))


@query(f"SELECT DISTINCT source || '/' || lang AS folder FROM {DOC}")
def folder_list(spark, sf_dir):
    return A.folders(T.documents(spark, sf_dir, labelled=False))


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'pages', count(*) FROM pages")
def relation_counts(spark, sf_dir):
    return A.row_counts({t: T.table(spark, sf_dir, t) for t in ("documents", "labels", "pages")})


# -- links --------------------------------------------------------------------------------------


@query("""SELECT c_custkey, CASE WHEN n_nationkey IS NULL THEN 'unresolved' ELSE 'resolved' END AS status, n_nationkey AS resolved
  FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey IN (1, 2)) ON c_nationkey = n_nationkey""")
def link_resolve_status(spark, sf_dir):
    links = T.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("key"))
    some = T.table(spark, sf_dir, "nation").where("n_regionkey IN (1, 2)").select(F.col("n_nationkey").alias("key"), F.col("n_nationkey").alias("path"))
    return G.resolve_by_key(links, some, "key").select("c_custkey", "status", F.col("resolved_path").alias("resolved"))


@query("SELECT p_name, count(DISTINCT p_partkey) AS n, min(p_partkey) AS first FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) > 1")
def link_ambiguous(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    found = G.resolve_by_key(p.select("p_name").distinct(), p.select("p_name", "p_partkey"), "p_name", "p_partkey").where("status = 'ambiguous'")
    return found.select("p_name", F.col("n_candidates").alias("n"), F.element_at("candidates", 1).alias("first"))


_HREF = r"""(SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)"""


def _hrefs(spark, sf_dir) -> DataFrame:
    found = F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1)))
    return T.table(spark, sf_dir, "pages").select("page_id", found.alias("target"))


@query(f"SELECT page_id, target, count(*) AS n FROM {_HREF} WHERE NOT regexp_matches(target, '^(https?://|mailto:|#)') GROUP BY 1, 2")
def href_extract(spark, sf_dir):
    return _hrefs(spark, sf_dir).where(~F.col("target").rlike("^(https?://|mailto:|#)")).groupBy("page_id", "target").agg(F.count("*").alias("n"))


@query(f"SELECT slug, count(*) AS n FROM (SELECT trim(regexp_replace(lower(target), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM {_HREF}) GROUP BY slug")
def href_slug(spark, sf_dir):
    return _hrefs(spark, sf_dir).groupBy(V.slug(F.col("target")).alias("slug")).agg(F.count("*").alias("n"))


@query("SELECT l_suppkey AS path, count(*) AS n_incoming, count(DISTINCT l_orderkey) AS n_sources FROM lineitem GROUP BY 1")
def backlinks(spark, sf_dir):
    return G.incoming(_order_links(spark, sf_dir))


@query("SELECT o_orderkey AS path, count(l_suppkey) AS n_out FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")
def get_deep(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("path"))
    links = _order_links(spark, sf_dir).withColumn("target", F.col("resolved_path")).join(o.withColumnRenamed("path", "source_path"), "source_path", "left_semi")
    found = G.deep(o, links)
    return found.select("path", F.coalesce(F.size("outgoing"), F.lit(0)).cast("long").alias("n_out"))


@query("""SELECT a.conv_id, a.turn, CASE WHEN b.conv_id IS NULL THEN 'anchor-missing' ELSE 'resolved' END AS status
  FROM conversations a LEFT JOIN (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'assistant') b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn WHERE a.role = 'user'""")
def anchor_check(spark, sf_dir):
    c = T.table(spark, sf_dir, "conversations").withColumn("path", F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    docs = c.select("path", F.col("path").alias("stem")).distinct()
    turn = lambda k: F.concat(F.lit("Turn "), (F.col("turn") + k).cast("string"))
    none = F.lit(None).cast("string")
    links = c.where("role = 'user'").select("conv_id", "turn", F.col("path").alias("source_path"), F.lit("wikilink").alias("kind"), F.lit("").alias("target"), turn(1).alias("anchor"), none.alias("block_ref"))
    headings = c.where("role = 'assistant'").select(F.col("path").alias("doc_path"), V.slug(turn(0)).alias("slug"))
    blocks = docs.limit(0).select(F.col("path").alias("doc_path"), F.col("path").alias("block_id"))
    found = G.resolve(links, docs, docs, headings, blocks)
    return found.select("conv_id", "turn", F.coalesce("reason", "status").alias("status"))


@query("SELECT s_suppkey, r_name AS found_type FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name NOT IN ('ASIA', 'EUROPE')")
def ref_type(spark, sf_dir):
    links = T.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("resolved_path"))
    types = T.table(spark, sf_dir, "nation").join(T.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("path"), F.col("r_name").alias("type"))
    return C.reference_findings(links, types, ["ASIA", "EUROPE"]).select("s_suppkey", "found_type")


# -- rules --------------------------------------------------------------------------------------

RULES = [
    C.Rule("labelled", path="src1/**", required=("quality", "toxic"), types={"quality": "number", "lang": "string"}),
    C.Rule("english", where={"lang": "en"}, forbidden=("toxic",), allowed={"source": ["src0", "src1", "src2", "src3"]}),
    C.Rule("short", max_length={"source": 4}, allowed_paths=("src1*/**", "src2/{en,de}/*.md"), types={"n_chars": "string"}),
]
_ROW = "SELECT '{code}' AS code, '{severity}' AS severity, path, '{rule}' AS rule, {field} AS field, {actual} AS actual_value, {expected} AS expected FROM " + DOC + " WHERE {test}"


def _row(code, rule, test, field=None, expected=None, severity="error"):
    quoted = lambda s: "CAST(NULL AS VARCHAR)" if s is None else f"'{s}'"
    return _ROW.format(code=code, severity=severity, rule=rule, field=quoted(field), actual="CAST(NULL AS VARCHAR)" if field is None else f"CAST({field} AS VARCHAR)", expected=quoted(expected), test=test)


FINDINGS = " UNION ALL ".join([
    _row("frontmatter-required-field-missing", "labelled", "source = 'src1' AND quality IS NULL", "quality"),
    _row("frontmatter-required-field-missing", "labelled", "source = 'src1' AND toxic IS NULL", "toxic"),
    _row("frontmatter-forbidden-field", "english", "lang = 'en' AND toxic IS NOT NULL", "toxic"),
    _row("value-not-allowed", "english", "lang = 'en' AND source NOT IN ('src0', 'src1', 'src2', 'src3')", "source", "src0,src1,src2,src3"),
    _row("field-type-invalid", "short", "n_chars IS NOT NULL", "n_chars", "string"),
    _row("frontmatter-exceeds-max-length", "short", "length(source) > 4", "source", "4", "warning"),
    _row("document-misrouted", "short", "NOT (starts_with(source, 'src1') OR (source = 'src2' AND lang IN ('en', 'de')))", None, "src1*/**,src2/{en,de}/*.md", "warning"),
])


@query(FINDINGS)
def findings(spark, sf_dir):
    return C.findings(T.documents(spark, sf_dir), RULES)


@query(f"""WITH f AS (SELECT *, split_part(path, '/', 1) AS prefix FROM ({FINDINGS}))
  SELECT e.by, e.value, count(*) AS n FROM (SELECT unnest([{{'by': 'total', 'value': '(none)'}}, {{'by': 'code', 'value': code}}, {{'by': 'severity', 'value': severity}}, {{'by': 'rule', 'value': rule}}, {{'by': 'field', 'value': coalesce(field, '(none)')}},
    {{'by': CASE WHEN field IS NOT NULL THEN 'field_value' END, 'value': field || '=' || coalesce(actual_value, '(missing)')}}, {{'by': CASE WHEN code = 'field-type-invalid' THEN 'field_type' END, 'value': field || '=' || expected}}, {{'by': 'prefix', 'value': prefix}}]) AS e FROM f)
  WHERE e.by IS NOT NULL GROUP BY 1, 2""")
def findings_summary(spark, sf_dir):
    return A.summary(findings(spark, sf_dir))


@query(f"SELECT * FROM ({FINDINGS}) WHERE code IN ('value-not-allowed', 'frontmatter-required-field-missing', 'frontmatter-forbidden-field') AND severity = 'error' AND regexp_full_match(path, 'src1[^/]*/.*')")
def triage_filter(spark, sf_dir):
    return C.triage(findings(spark, sf_dir), code="value-not-allowed,frontmatter-*", severity="error", path="src1*/**")


@query("SELECT DISTINCT lower(p_name) AS alias, CAST(p_partkey AS VARCHAR) AS path FROM part JOIN (SELECT p_name FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) > 1) USING (p_name)")
def alias_duplicates(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    aliases = p.select(F.col("p_partkey").cast("string").alias("doc_path"), F.lower("p_name").alias("alias"))
    none = p.limit(0).select(F.col("p_name").alias("stem"), F.col("p_name").alias("path"))  # vault.alias_findings has stems
    return C.alias_findings(aliases, none).where("code = 'frontmatter-alias-duplicate'").select(F.col("actual_value").alias("alias"), "path")


# -- repair -------------------------------------------------------------------------------------

_FORM = "trim(regexp_replace(lower({}), '[ \t_-]+', '-', 'g'), '-')"


@query(f"""WITH t AS (SELECT DISTINCT substr(p_name, 1, length(p_name) - 1) || 'x' AS target FROM part),
  s AS (SELECT {_FORM.format('p_name')} AS b, min(p_name) AS stem, count(*) AS owners FROM (SELECT DISTINCT p_name FROM part) GROUP BY 1),
  scored AS (SELECT target, stem, owners, levenshtein({_FORM.format('target')}, b) AS d, 1 - levenshtein({_FORM.format('target')}, b) / greatest(length({_FORM.format('target')}), length(b)) AS score FROM t, s),
  best AS (SELECT target, max(score) AS score FROM scored WHERE score >= 0.7 GROUP BY target),
  top AS (SELECT target, score, sum(owners) AS owners, min(stem) AS stem, min(d) AS d FROM scored JOIN best USING (target, score) GROUP BY 1, 2)
  SELECT target, CASE WHEN owners IS NULL THEN 'none' WHEN owners > 1 THEN 'ambiguous' WHEN score = 1 THEN 'high' ELSE 'medium' END AS outcome, CASE WHEN owners = 1 THEN stem END AS stem, CAST(d AS INT) AS distance FROM t LEFT JOIN top USING (target)""")
def closest_match(spark, sf_dir):
    names = T.table(spark, sf_dir, "part").select("p_name").distinct()
    broken = names.select(F.concat(F.expr("substr(p_name, 1, length(p_name) - 1)"), F.lit("x")).alias("target"))
    return R.closest(broken, names.withColumnRenamed("p_name", "stem"))


REPAIRS = [(1, "frontmatter-required-field-missing", "quality", None, "add_frontmatter"), (2, "value-not-allowed", None, "src7", "set_frontmatter"), (3, "frontmatter-forbidden-field", None, None, "remove_frontmatter"), (4, "value-not-allowed", None, None, "move_document")]


@query(f"""SELECT path, f.code, f.field, f.actual_value, r.rule_idx, coalesce(r.action, 'skip') AS action FROM ({FINDINGS}) f LEFT JOIN LATERAL (
  SELECT * FROM (VALUES (1, 'frontmatter-required-field-missing', 'quality', NULL, 'add_frontmatter'), (2, 'value-not-allowed', NULL, 'src7', 'set_frontmatter'), (3, 'frontmatter-forbidden-field', NULL, NULL, 'remove_frontmatter'), (4, 'value-not-allowed', NULL, NULL, 'move_document')) r(rule_idx, code, field, actual_value, action)
  WHERE r.code = f.code AND (r.field IS NULL OR r.field = f.field) AND (r.actual_value IS NULL OR r.actual_value = f.actual_value) ORDER BY rule_idx LIMIT 1) r ON TRUE""")
def repair_first_rule(spark, sf_dir):
    rules = spark.createDataFrame(REPAIRS, "rule_idx int, code string, field string, actual_value string, action string")
    found = findings(spark, sf_dir).select("path", "code", "field", "actual_value")
    return R.first_rule(found, rules, ["code", "field", "actual_value"])


@query(f"SELECT path, code, field, substr(sha256(path || chr(31) || code || chr(31) || coalesce('=' || actual_value, '') || chr(31) || CAST(row_number() OVER (PARTITION BY path, code, actual_value ORDER BY field) - 1 AS VARCHAR)), 1, 16) AS change_id FROM ({FINDINGS})")
def change_id(spark, sf_dir):
    changes = findings(spark, sf_dir).select("path", "code", F.col("actual_value").alias("old_value"), "field")
    return R.with_change_ids(changes).select("path", "code", "field", "change_id")


@query(f"""SELECT page_id, target, CASE WHEN split_part(target, '#', 1) = '/about' THEN '/moved' || regexp_extract(target, '(#.*)$', 1) ELSE target END AS new_target FROM {_HREF}""")
def link_risk_rewrite(spark, sf_dir):
    return _hrefs(spark, sf_dir).select("page_id", "target", R.moved_markdown(F.col("target"), "/about", "/moved").alias("new_target"))


@query("SELECT * FROM (SELECT CAST(n_nationkey AS VARCHAR) AS path, 'unexpected' AS side FROM nation WHERE n_regionkey = 1 AND n_nationkey > 10 UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'absent' FROM nation WHERE n_regionkey <> 1 AND n_nationkey <= 10)")
def owner_set_diff(spark, sf_dir):
    n = T.table(spark, sf_dir, "nation").withColumn("path", F.col("n_nationkey").cast("string"))
    return R.set_differences(n.where("n_regionkey = 1").select("path"), n.where("n_nationkey <= 10").select("path"))


@query("SELECT max(CAST(regexp_extract(c_name, '^Customer#([0-9]+)$', 1) AS BIGINT)) + 1 AS next FROM customer WHERE regexp_matches(c_name, '^Customer#[0-9]+$')")
def seq_next(spark, sf_dir):
    return A.next_number(T.table(spark, sf_dir, "customer"), "c_name", "Customer#")


@query("SELECT a.path, new_path, b.path AS other FROM (SELECT CAST(p_partkey AS VARCHAR) AS path, 'x/' || p_name || '.md' AS new_path, lower(p_name) AS s FROM part WHERE p_size = 1) a JOIN (SELECT CAST(p_partkey AS VARCHAR) AS path, lower(p_name) AS s FROM part) b USING (s) WHERE a.path <> b.path")
def stem_collisions(spark, sf_dir):
    p = T.table(spark, sf_dir, "part").withColumns({"path": F.col("p_partkey").cast("string"), "stem": F.col("p_name")})
    moves = p.where("p_size = 1").select("path", F.concat(F.lit("x/"), "p_name", F.lit(".md")).alias("new_path"))
    return R.stem_collisions(p, moves)


@query(f"SELECT path, 'archive/' || substr(path, 6) AS new_path FROM {DOC} WHERE starts_with(path, 'src1/')")
def folder_moves(spark, sf_dir):
    return R.folder_moves(T.documents(spark, sf_dir, labelled=False), "src1", "archive")


# -- the audit stream and snapshots -------------------------------------------------------------


def _audit(spark, sf_dir) -> DataFrame:
    e = T.table(spark, sf_dir, "events")
    return e.select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("user_id").cast("string").alias("trace"), F.col("event_id").alias("span"), F.col("event_type").alias("status"), F.col("event_type").alias("event"))


@query("SELECT event_id AS span, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND ts >= TIMESTAMP '2024-01-02' ORDER BY ts DESC, event_id DESC LIMIT 20")
def audit_filter_newest(spark, sf_dir):
    e = _audit(spark, sf_dir)
    found = audit.newest(audit.select(e, status=e.agg(F.min("status")).scalar(), since="2024-01-02"))
    return found.select("span", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type AS event, count(*) AS n FROM events GROUP BY 1, 2")
def audit_window(spark, sf_dir):
    return audit.windowed(_audit(spark, sf_dir)).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event", "n")


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS path, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'deleted' ELSE 'modified' END AS change
  FROM (SELECT doc_id, text FROM documents WHERE lang <> 'fr') a FULL JOIN (SELECT doc_id, CASE WHEN source = 'src5' THEN text || '!' ELSE text END AS text FROM documents WHERE lang <> 'de') b ON a.doc_id = b.doc_id
  WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.text <> b.text""")
def change_detect(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents")
    row = lambda frame, text: frame.select(F.col("doc_id").alias("path"), F.xxhash64(text).alias("hash"))
    return audit.changes(row(d.where("lang <> 'fr'"), F.col("text")), row(d.where("lang <> 'de'"), F.when(F.col("source") == "src5", F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
