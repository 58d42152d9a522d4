"""Metadata shredded into a relation of fields, and predicates as semi and anti joins with it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources.store import stored

#: Types whose values are short enough for a field of that type to be indexed without being told.
BOUNDED = ("date", "datetime", "wikilink", "wikilink_or_list", "string", "list_of_strings")
ABSENT, EMPTY = "absent", "empty"
#: Rows of the index that a task sorts and writes.
ROWS = 500_000
_SCHEMA = "path string, kind string, number double, whole decimal(38,0), text string, field string"


@dataclass(frozen=True)
class FieldIndex:
    """fields(path, field, kind, number, whole, text) of the fields in `names`, and only of these."""

    frame: DataFrame
    names: tuple[str, ...]

    @property
    def digest(self) -> str:
        """Of the set of names: an index with another digest must be made anew."""
        return hashlib.sha256("\n".join(sorted(self.names)).encode()).hexdigest()

    def rows(self, name: str) -> DataFrame:
        return self.frame.where(F.col("field") == name)


def indexed_fields(rules: Iterable, explicit: dict[str, bool] | None = None, auto: bool = True) -> tuple[str, ...]:
    """The fields to index: those that a rule names outright (true before false), then, with `auto`, those to which a rule
    gives allowed values or a bounded type.
    """
    bounded = {n for r in rules for n in (*r.allowed, *(n for n, t in r.types.items() if t in BOUNDED))}
    explicit = explicit or {}
    return tuple(sorted({n for n, yes in explicit.items() if yes} | {n for n in bounded if auto and explicit.get(n, True)}))


def shredded(documents: DataFrame, names: Iterable[str], metadata: str = "metadata") -> DataFrame:
    """(path, kind, number, whole, text, field): a row for each element of each of the fields, one at least for each
    document and field. A field that is absent or null has the kind `absent`, a list without elements `empty`.

    number: numbers, and booleans as 1 and 0. whole: whole numbers, exactly. text: what queries compare (see
    values.canonical). One pass over the documents, without a shuffle.
    """
    names = sorted(set(names))
    if not names:
        return documents.sparkSession.createDataFrame([], _SCHEMA)
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), V.field(metadata, n).alias("v")) for n in names])
    each = documents.select("path", F.explode(pairs).alias("p")).select("path", "p.field", "p.v")
    each = each.select("path", "field", V.present(F.col("v")).alias("there"), F.explode_outer(V.elements(F.col("v"))).alias("e"))
    e = F.col("e")
    kind = F.when(~F.col("there"), ABSENT).when(e.isNull(), EMPTY).otherwise(V.kind(e))
    whole = F.when(V.kind(e) == "number", F.try_variant_get(e, "$", "decimal(38,0)"))
    number = F.when(e.isNotNull(), V.number(e))
    return each.select("path", kind.alias("kind"), number.alias("number"), F.when(number == F.floor(number), whole).alias("whole"), F.when(e.isNotNull(), V.canonical(e)).alias("text"), "field")


def build(documents: DataFrame, names: Iterable[str], *, path: str | None = None, metadata: str = "metadata", parts: int | None = None) -> FieldIndex:
    """The stored index: a folder for each field, its files sorted by kind and text, so that a predicate reads the folder
    of its field and, by statistics, the row groups that can match. Without `parts` the documents are counted, and a task
    gets about ROWS rows, however many documents there are.
    """
    names = tuple(sorted(set(names)))
    parts = parts or documents.count() * len(names) // ROWS + 1
    return FieldIndex(stored(shredded(documents, names, metadata), "fields", by="field", order=("kind", "text", "number", "path"), parts=parts, path=path), names)


def refreshed(index: FieldIndex, changed: DataFrame, gone: DataFrame, *, path: str | None = None, metadata: str = "metadata") -> FieldIndex:
    """The index after documents changed or came (`changed`, whole rows) and others went (`gone`: path): rows of other
    paths are taken over, only the changed documents are shredded.
    """
    touched = changed.select("path").unionByName(gone.select("path")).distinct()
    rows = index.frame.join(touched, "path", "left_anti").select(*[c.split()[0] for c in _SCHEMA.split(", ")])
    rows = rows.unionByName(shredded(changed, index.names, metadata))
    parts = (index.frame.count() + changed.count() * len(index.names)) // ROWS + 1
    return FieldIndex(stored(rows, "fields", by="field", order=("kind", "text", "number", "path"), parts=parts, path=path), index.names)


# -- predicates as tests of index rows -----------------------------------------------------------


@dataclass(frozen=True)
class Probe:
    """A predicate as rows of its field: documents that have a row that passes, or, for `without`, that have none."""

    field: str
    test: Column
    without: bool = False


def is_absent() -> Column:
    return F.col("kind") == ABSENT


def equals(value) -> Column:
    """The rows that equal a query's value; plain comparisons, which reach the files' statistics."""
    if V.exact(value):
        return (F.col("kind") == "number") & (F.col("whole") == F.lit(Decimal(value)))
    if isinstance(value, (bool, int, float)):
        return F.col("number") == float(value)
    return F.col("kind").isin("string", "object", "array") & (F.col("text") == V.unbracketed(value))


def ordered(value: str, test) -> Column:
    """Rows whose text stands in an order to a date; booleans are 1 and 0 here."""
    booleans = [k for k in (0, 1) if test(str(k), value)]
    return ((F.col("kind") != "boolean") & test(F.col("text"), value)) | ((F.col("kind") == "boolean") & F.col("number").isin([float(k) for k in booleans]))


def selected(documents: DataFrame, index: FieldIndex, probes: Iterable[Probe]) -> DataFrame:
    """documents that pass all probes: a left-semi or left-anti join by path with the rows of each. Documents meet the
    first by their path and stay where they are for the rest.
    """
    out = documents
    for p in probes:
        out = out.join(index.rows(p.field).where(p.test).select("path"), "path", "left_anti" if p.without else "left_semi")
    return out
