"""Counts, distributions and roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V


def long_form(documents: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(path, field, value) for typed metadata columns as text, null where a document hasn't the field. One pass."""
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), c.cast("string").alias("value")) for n, c in fields.items()])
    return documents.select("path", F.explode(pairs).alias("p")).select("path", "p.field", "p.value")


def exploded(documents: DataFrame, metadata: str = "metadata", declared: tuple[str, ...] = ()) -> DataFrame:
    """(path, field, value) for every element of every top-level key of a VARIANT; an empty list has the value [].

    A document without one of the `declared` fields has a row with a null value for it.
    """
    keys = documents.select("path", F.col(metadata).alias("_m")).lateralJoin(documents.sparkSession.tvf.variant_explode_outer(F.col("_m").outer()))
    keys = keys.where("key IS NOT NULL").select("path", F.col("key").alias("field"), F.col("value").alias("v"))
    listed = F.when(V.kind(F.col("v")) == "array", F.when(F.size(V.elements(F.col("v"))) == 0, F.array(F.lit("[]"))).otherwise(F.transform(V.elements(F.col("v")), V.text))).otherwise(F.array(V.group_key(F.col("v"))))
    out = keys.select("path", "field", F.explode(listed).alias("value"))
    if declared:
        absent = F.array_compact(F.array(*[F.when(V.field(metadata, n).isNull(), n) for n in declared]))
        out = out.unionByName(documents.select("path", F.explode(absent).alias("field"), F.lit(None).cast("string").alias("value")))
    return out


def field_names(documents: DataFrame, dated: tuple[str, ...] = (), metadata: str = "metadata") -> DataFrame:
    """(field): all top-level keys that occur, in order, but those that are described by their date bounds."""
    keys = documents.select(F.explode(F.map_keys(F.try_variant_get(F.col(metadata), "$", "map<string,variant>"))).alias("field")).distinct()
    return keys.where(~F.col("field").isin(*dated)).orderBy("field") if dated else keys.orderBy("field")


def count_by(documents: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Documents by one or more rendered keys (at most 16); absent values are (missing)."""
    if not 1 <= len(keys) <= 16:
        raise ValueError("between 1 and 16 keys")
    return documents.groupBy(*[F.coalesce(c.cast("string"), F.lit(V.MISSING)).alias(n) for n, c in keys.items()]).agg(F.count("*").alias("n"))


def distribution(values: DataFrame, top: int = 20) -> DataFrame:
    """(field, value, n, more): the `top` commonest values of each field (0: all), how many others there are.

    Counts come from a partial aggregation; the ranking sees one row for each different value only.
    """
    counted = values.groupBy("field", F.coalesce("value", F.lit(V.MISSING)).alias("value")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("field")
    ranked = counted.select("*", F.row_number().over(w.orderBy(F.desc("n"), "value")).alias("rank"), F.count("*").over(w).alias("of"))
    shown = ranked if top == 0 else ranked.where(F.col("rank") <= top)
    return shown.select("field", "value", "n", (F.lit(0).cast("long") if top == 0 else F.greatest(F.col("of") - top, F.lit(0).cast("long"))).alias("more"))


def identities(values: DataFrame, share: float = 0.9) -> DataFrame:
    """(field, occurrences, n_distinct, is_identity): fields whose values are nearly all different aren't described."""
    out = values.where("value IS NOT NULL").groupBy("field", "value").agg(F.count("*").alias("n"))
    out = out.groupBy("field").agg(F.sum("n").alias("occurrences"), F.count("*").alias("n_distinct"))
    return out.withColumn("is_identity", F.col("n_distinct") >= share * F.col("occurrences"))


def bounds(values: DataFrame) -> DataFrame:
    """(field, low, high): the range of well-formed dates, as text."""
    day = F.substring("value", 1, 10)
    return values.where(V.is_date(day)).groupBy("field").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def field_stats(values: DataFrame) -> DataFrame:
    """(field, n_docs, n_distinct, all_text, top_value): ties go to the smaller value. all_text: no value is a number or
    a boolean; values may say so in a column `is_text`.
    """
    known = values if "is_text" in values.columns else values.withColumn("is_text", F.lit(True))
    known = known.where("value IS NOT NULL")
    counted = known.groupBy("field", "value").agg(F.count_distinct("path").alias("n"))
    docs = known.groupBy("field").agg(F.count_distinct("path").alias("n_docs"), F.bool_and("is_text").alias("all_text"))
    best = counted.groupBy("field").agg(F.count("*").alias("n_distinct"), F.min_by("value", F.struct(-F.col("n"), "value")).alias("top_value"))
    return docs.join(best, "field")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) for each relation."""
    each = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, each)


def folders(documents: DataFrame) -> DataFrame:
    return documents.select(V.path_parts(F.col("path"))[0].alias("folder")).distinct()


def summary(findings: DataFrame) -> DataFrame:
    """(by, value, n): findings in total and by code, severity, rule, field, field and value, field and type (both only
    where there is a field), and first folder; in one pass.
    """
    c = F.col
    keys = [
        ("total", F.lit("(none)")), *[(n, F.coalesce(c(n), F.lit("(none)"))) for n in ("code", "severity", "rule", "field")],
        ("field_value", F.concat_ws("=", "field", F.coalesce("actual_value", F.lit(V.MISSING)))), ("field_type", F.concat_ws("=", "field", F.when(c("code") == "field-type-invalid", c("expected")))),
        ("prefix", V.path_parts(c("path"))[2]),
    ]
    has = {"field_value": c("field").isNotNull(), "field_type": c("field").isNotNull() & (c("code") == "field-type-invalid")}
    each = F.array_compact(F.array(*[F.when(has.get(n, F.lit(True)), F.struct(F.lit(n).alias("by"), k.alias("value"))) for n, k in keys]))
    return findings.select(F.explode(each).alias("e")).groupBy("e.by", "e.value").agg(F.count("*").alias("n"))


def any_error(diagnostics: DataFrame) -> DataFrame:
    """One row: whether a diagnostic or finding is an error."""
    return diagnostics.agg(F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False)).alias("any_error"))


def fingerprint(frame: DataFrame) -> DataFrame:
    """An order-free digest of a table: row count and the sum of row hashes, which repeated rows change too."""
    return frame.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*frame.columns).cast("decimal(38,0)")).alias("digest"))


def next_number(names: DataFrame, column: str, prefix: str, suffix: str = "") -> DataFrame:
    """The number after the largest one between prefix and suffix, 1 if there is none."""
    import re

    digits = F.regexp_extract(column, f"^{re.escape(prefix)}([0-9]+){re.escape(suffix)}$", 1)
    return names.where(digits != "").agg((F.coalesce(F.max(digits.cast("long")), F.lit(0).cast("long")) + 1).alias("next"))
