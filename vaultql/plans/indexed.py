"""Named queries by way of the stored field index, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fields as I
from ..operators.find import Query
from ..sources import tables as T
from .catalog import DOC, query

_INDEXES: dict[tuple[str, str, str], I.FieldIndex] = {}
#: The documents' metadata as SQL sees it; tags are a list, ref a link in brackets.
META = f"(SELECT doc_id, path, lang, source, n_chars, quality, toxic, [lang, source] AS tags FROM {DOC})"


def _documents(spark, sf_dir) -> DataFrame:
    d = T.documents(spark, sf_dir).drop("metadata")
    tags = F.array_compact(F.array("lang", "source"))
    fields = F.struct("lang", "source", "n_chars", "quality", "toxic", tags.alias("tags"), F.concat(F.lit("[["), "source", F.lit("]]")).alias("ref"))
    return d.select("doc_id", "path", F.parse_json(F.to_json(fields)).alias("metadata"))


def _orders(spark, sf_dir) -> DataFrame:
    fields = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("double").alias("price"))
    return T.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("path"), F.parse_json(F.to_json(fields)).alias("metadata"))


def _query(spark, sf_dir, kind: str = "documents") -> Query:
    """A query on documents or orders whose index is written once for a session and a folder of tables."""
    made = {"documents": _documents, "orders": _orders}[kind](spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _INDEXES:
        names = {"documents": ("lang", "source", "n_chars", "quality", "toxic", "tags", "ref"), "orders": ("day", "status", "price")}[kind]
        _INDEXES[key] = I.build(made, names)
    return Query(made, index=_INDEXES[key])


def _found(q: Query) -> DataFrame:
    return q.frame(route="index").select("doc_id", "path")


def _of_orders(q: Query) -> DataFrame:
    return q.frame(route="index").select("o_orderkey")


@query(f"""
SELECT field, kind, count(*) AS n FROM (
  SELECT unnest([
    {{'field': 'lang', 'kind': CASE WHEN lang IS NULL THEN 'absent' ELSE 'string' END}}, {{'field': 'source', 'kind': CASE WHEN source IS NULL THEN 'absent' ELSE 'string' END}},
    {{'field': 'ref', 'kind': CASE WHEN source IS NULL THEN 'absent' ELSE 'string' END}}, {{'field': 'n_chars', 'kind': CASE WHEN n_chars IS NULL THEN 'absent' ELSE 'number' END}},
    {{'field': 'quality', 'kind': CASE WHEN quality IS NULL THEN 'absent' ELSE 'number' END}}, {{'field': 'toxic', 'kind': CASE WHEN toxic IS NULL THEN 'absent' ELSE 'number' END}}], recursive := true)
  FROM {META}
  UNION ALL SELECT 'tags', CASE WHEN t IS NULL THEN 'empty' ELSE 'string' END FROM (SELECT unnest(CASE WHEN lang IS NULL AND source IS NULL THEN [NULL] ELSE list_filter(tags, lambda x: x IS NOT NULL) END) AS t FROM {META}))
GROUP BY field, kind""")
def field_index_rows(spark, sf_dir):
    return _query(spark, sf_dir).index.frame.groupBy("field", "kind").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, path FROM {META} WHERE lang = 'en'")
def indexed_eq_str(spark, sf_dir):
    return _found(_query(spark, sf_dir).eq("lang", "en"))


@query(f"SELECT doc_id, path FROM {META} WHERE quality = 1")
def indexed_eq_num(spark, sf_dir):
    return _found(_query(spark, sf_dir).eq("quality", 1))


@query(f"SELECT doc_id, path FROM {META} WHERE source = 'src4'")
def indexed_eq_link(spark, sf_dir):
    return _found(_query(spark, sf_dir).eq("ref", "[[src4]]"))


@query(f"SELECT doc_id, path FROM {META} WHERE list_contains(tags, 'fr')")
def indexed_eq_list(spark, sf_dir):
    return _found(_query(spark, sf_dir).eq("tags", "fr"))


@query(f"SELECT doc_id, path FROM {META} WHERE quality IS NOT NULL AND quality <> 1")
def indexed_not_eq(spark, sf_dir):
    return _found(_query(spark, sf_dir).not_eq("quality", 1))


@query(f"SELECT doc_id, path FROM {META} WHERE NOT coalesce(list_contains(tags, 'en'), false)")
def indexed_not_eq_list(spark, sf_dir):
    return _found(_query(spark, sf_dir).not_eq("tags", "en"))


@query(f"SELECT doc_id, path FROM {META} WHERE source IN ('src1', 'src7')")
def indexed_in(spark, sf_dir):
    return _found(_query(spark, sf_dir).isin("source", ["src1", "src7"]))


@query(f"SELECT doc_id, path FROM {META} WHERE toxic IS NOT NULL AND toxic NOT IN (1, 5) AND source IS NOT NULL AND source NOT IN ('src1', 'src7')")
def indexed_not_in(spark, sf_dir):
    return _found(_query(spark, sf_dir).not_in("toxic", [1, 5]).not_in("source", ["src1", "src7"]))


@query(f"SELECT doc_id, path FROM {META} WHERE quality IS NOT NULL")
def indexed_has(spark, sf_dir):
    return _found(_query(spark, sf_dir).has("quality"))


@query(f"SELECT doc_id, path FROM {META} WHERE quality IS NULL")
def indexed_missing(spark, sf_dir):
    return _found(_query(spark, sf_dir).missing("quality"))


@query(f"SELECT doc_id, path FROM {META} WHERE starts_with(source, 'src1')")
def indexed_starts(spark, sf_dir):
    return _found(_query(spark, sf_dir).starts_with("ref", "[[src1"))


@query(f"SELECT doc_id, path FROM {META} WHERE len(list_filter(tags, lambda x: suffix(x, '3'))) > 0")
def indexed_ends(spark, sf_dir):
    return _found(_query(spark, sf_dir).ends_with("tags", "3"))


@query(f"SELECT doc_id, path FROM {META} WHERE contains(CAST(n_chars AS VARCHAR), '77')")
def indexed_contains_num(spark, sf_dir):
    return _found(_query(spark, sf_dir).contains("n_chars", "77"))


@query("SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') < '1995-06-17' AND o_orderstatus = 'O'")
def indexed_before(spark, sf_dir):
    return _of_orders(_query(spark, sf_dir, "orders").before("day", "1995-06-17").eq("status", "O"))


@query("SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') > '1996-01-01' AND strftime(o_orderdate, '%Y-%m-%d') < '1996-03-01'")
def indexed_between(spark, sf_dir):
    return _of_orders(_query(spark, sf_dir, "orders").after("day", "1996-01-01").before("day", "1996-03-01"))


@query("SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') = '1995-06-17'")
def indexed_on(spark, sf_dir):
    return _of_orders(_query(spark, sf_dir, "orders").on("day", "1995-06-17"))


@query(f"SELECT doc_id, path FROM {META} WHERE lang = 'en' AND quality = 1 AND toxic IS NOT NULL AND toxic <> 1 AND path LIKE 'src1/%' AND starts_with(source, 'src')")
def indexed_together(spark, sf_dir):
    """Positive and negative predicates on four fields, and one on the path, which needs no index."""
    return _found(_query(spark, sf_dir).eq("lang", "en").eq("quality", 1).not_eq("toxic", 1).starts_with("source", "src").path("src1/**"))
