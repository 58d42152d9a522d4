"""Predicates over documents, sorting and paging, as a builder of one DataFrame plan."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import globs
from ..functions import values as V
from . import fields as I
from . import graph


@dataclass(frozen=True)
class Query:
    """documents(path, stem, metadata VARIANT, body, ...) with ANDed predicates.

    `typed` names columns that hold a metadata field with its own type. Predicates on them are plain comparisons, which
    reach the files' statistics, for numbers, dates and booleans, and for those text columns that `plain` names: the
    caller knows that no value there has wikilink brackets. Other text is compared without its brackets, as in
    `metadata`, where all other fields are read and a list matches by any element.
    `links(source_path, resolved_path, status)` serve the predicates on links.

    With an `index` (see fields.build) predicates on metadata have a second form: semi and anti joins with its rows. `frame`
    takes it if all predicates on metadata are on indexed fields, as otherwise the metadata is read anyway; both forms
    give the same documents.
    """

    documents: DataFrame
    links: DataFrame | None = None
    typed: tuple[str, ...] = ()
    plain: tuple[str, ...] = ()
    metadata: str = "metadata"
    tests: tuple[tuple[Column, I.Probe | None | str], ...] = ()
    joins: tuple = field(default_factory=tuple)
    index: I.FieldIndex | None = None

    def _with(self, test: Column, name: str | None = None, probe: Column | None = None, without: bool = False) -> Query:
        """A test, and for metadata its form on the index: the field alone if there is no such form."""
        second = None if name is None or name in self.typed else name if probe is None else I.Probe(name, probe, without)
        return replace(self, tests=(*self.tests, (test, second)))

    def _any(self, name: str, test) -> Column:
        return F.coalesce(F.exists(V.elements(V.field(self.metadata, name)), test), F.lit(False))

    def _has(self, name: str) -> Column:
        return F.col(name).isNotNull() if name in self.typed else V.present(V.field(self.metadata, name))

    def _column(self, name: str) -> tuple[Column, bool]:
        """A typed column as it is compared, and whether it is text."""
        is_text = dict(self.documents.dtypes)[name] == "string"
        return (V.bare(F.col(name)) if is_text and name not in self.plain else F.col(name)), is_text

    def _values(self, name: str, values: list) -> list:
        return [V.unbracketed(str(v)) for v in values] if self._column(name)[1] else list(values)

    def _equal(self, name: str, value) -> Column:
        if name in self.typed:
            return self._column(name)[0] == F.lit(self._values(name, [value])[0])
        return self._any(name, lambda e: V.same(e, value))

    def eq(self, name: str, value) -> Query:
        return self._with(F.coalesce(self._equal(name, value), F.lit(False)) if name not in self.typed else self._equal(name, value), name, I.equals(value))

    def not_eq(self, name: str, value) -> Query:
        """Present, and no element equals; missing and null never pass, an empty list does."""
        return self._with(self._has(name) & ~self._equal(name, value), name, I.is_absent() | F.coalesce(I.equals(value), F.lit(False)), without=True)

    def isin(self, name: str, values: list) -> Query:
        if name in self.typed:
            return self._with(self._column(name)[0].isin(self._values(name, values)) if values else F.lit(False))
        return self._with(self._any(name, lambda e: _or([V.same(e, v) for v in values])), name, _or([I.equals(v) for v in values]))

    def not_in(self, name: str, values: list) -> Query:
        if not values:
            return self
        if name in self.typed:
            return self._with(self._has(name) & ~self._column(name)[0].isin(self._values(name, values)))
        none = I.is_absent() | F.coalesce(_or([I.equals(v) for v in values]), F.lit(False))
        return self._with(self._has(name) & ~self._any(name, lambda e: _or([V.same(e, v) for v in values])), name, none, without=True)

    def has(self, name: str) -> Query:
        return self._with(self._has(name), name, ~I.is_absent())

    def missing(self, name: str) -> Query:
        return self._with(~self._has(name), name, I.is_absent())

    def _text(self, name: str, needle: str, test) -> Query:
        needle = V.unbracketed(needle)
        if not needle:
            return self._with(F.lit(False), name, F.lit(False))
        if name in self.typed:
            return self._with(test(self._column(name)[0].cast("string"), needle))
        return self._with(self._any(name, lambda e: F.coalesce(test(V.canonical(e), needle), F.lit(False))), name, test(F.col("text"), needle))

    def starts_with(self, name: str, needle: str) -> Query:
        return self._text(name, needle, lambda c, s: c.startswith(s))

    def ends_with(self, name: str, needle: str) -> Query:
        return self._text(name, needle, lambda c, s: c.endswith(s))

    def contains(self, name: str, needle: str) -> Query:
        return self._text(name, needle, lambda c, s: c.contains(s))

    def _when(self, name: str, value: str, test) -> Query:
        """Dates compare as text; booleans are 1 and 0 here."""
        value = V.today_or(value)
        if name in self.typed:
            return self._with(test(self._column(name)[0], value))
        shown = lambda e: F.when(V.kind(e) == "boolean", V.number(e).cast("int").cast("string")).otherwise(V.canonical(e))
        return self._with(self._any(name, lambda e: F.coalesce(test(shown(e), value), F.lit(False))), name, I.ordered(value, test))

    def before(self, name: str, value: str) -> Query:
        return self._when(name, value, lambda c, v: c < v)

    def after(self, name: str, value: str) -> Query:
        return self._when(name, value, lambda c, v: c > v)

    def on(self, name: str, value: str) -> Query:
        return self._when(name, value, lambda c, v: c == v)

    def text(self, needle: str) -> Query:
        """Body text, blind to the case of ASCII letters; % and _ in the needle are wildcards. Empty: no predicate."""
        if not needle:
            return self
        folded = needle.translate(str.maketrans(V._UP, V._LOW)).replace("\\", "\\\\")
        return self._with(V.ascii_fold(F.col("body")).like(f"%{folded}%"))

    def path(self, *patterns: str) -> Query:
        """Any of the globs; a malformed one matches nothing."""
        found = [r for r in map(globs.path_regex, patterns) if r]
        return self._with(_or([F.col("path").rlike(r) for r in found]))

    def links_to(self, *targets: str) -> Query:
        """A resolved edge to every one of the paths."""
        return replace(self, joins=(*self.joins, *(("to", t) for t in targets)))

    def links_to_named(self, *names: str, aliases: DataFrame | None = None) -> Query:
        """As `links_to`, for paths, stems or aliases(doc_path, alias); LookupError if a name stands for none or several."""
        paths = []
        for name in names:
            none = self.documents.select(F.col("path").alias("doc_path"), F.lit("").alias("alias")).limit(0)
            found = [r.path for r in graph.lookup(self.documents, none if aliases is None else aliases, name).limit(2).collect()]
            if len(found) != 1:
                raise LookupError(f"{name!r} stands for {'no document' if not found else 'several documents'}")
            paths += found
        return self.links_to(*paths)

    def unresolved_links(self) -> Query:
        return replace(self, joins=(*self.joins, ("unresolved", None)))

    def by_index(self) -> bool:
        """Whether there are predicates on metadata, and the index has the fields of all of them."""
        asked = [p for _, p in self.tests if p is not None]
        return self.index is not None and bool(asked) and all(isinstance(p, I.Probe) and p.field in self.index.names for p in asked)

    def frame(self, everything: bool = False, route: str = "auto") -> DataFrame:
        """The documents that pass. route: `scan` reads the metadata, `index` the index, `auto` the index if it serves."""
        if not (self.tests or self.joins or everything):
            raise ValueError("a query needs a predicate, or everything=True")
        if route not in ("auto", "scan", "index") or route == "index" and not self.by_index():
            raise ValueError(f"no such route: {route}" if route != "index" else "the index doesn't have the fields of all predicates")
        indexed = route != "scan" and self.by_index()
        out = self.documents
        for test, probe in self.tests:
            if not indexed or probe is None:
                out = out.where(test)
        if indexed:
            out = I.selected(out, self.index, [p for _, p in self.tests if p is not None])
        for what, target in self.joins:
            edges = self.links.where(F.col("resolved_path") == target) if what == "to" else self.links.where("status = 'unresolved'")
            out = out.join(edges.select(F.col("source_path").alias("path")).distinct(), "path", "left_semi")
        return out

    def sorted(self, name: str, descending: bool = False, everything: bool = False) -> DataFrame:
        """By a column or a metadata field (null, numbers, text); ties by path, ascending in either direction."""
        columns = [F.col(name)] if name in self.typed or name in ("path", "stem") else V.sort_keys(V.field(self.metadata, name))
        return self.frame(everything).orderBy(*[c.desc_nulls_last() if descending else c.asc_nulls_first() for c in columns], F.col("path").asc())


def _or(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = t if out is None else out | t
    return out


def by_display(frame: DataFrame, name: str, descending: bool = False, metadata: str = "metadata") -> DataFrame:
    """By a field's value as shown on one line; documents without it come last in either direction, ties by path."""
    shown = V.inline(V.field(metadata, name))
    return frame.orderBy(shown.desc_nulls_last() if descending else shown.asc_nulls_last(), F.col("path").asc())


def page(ordered: DataFrame, limit: int | None = 10, starts_at: int = 1) -> DataFrame:
    """A page of an ordered frame: 1-based start; None for no limit."""
    out = ordered.offset(max(0, starts_at - 1))
    return out if limit is None else out.limit(limit)


def envelope(found: DataFrame, limit: int | None = 10, starts_at: int = 1) -> DataFrame:
    """total, returned and truncated of a page, from one count."""
    total = found.agg(F.count("*").alias("total"))
    rest = F.greatest(F.col("total") - (starts_at - 1), F.lit(0).cast("long"))
    returned = rest if limit is None else F.least(rest, F.lit(limit).cast("long"))
    return total.select("total", returned.alias("returned"), (returned < F.col("total")).alias("truncated"))


def nearest_fields(names: DataFrame, wanted: str) -> DataFrame:
    """Known field names close enough to a mistyped one: at most max(2, a third of its length) edits."""
    away = F.levenshtein(F.col("field"), F.lit(wanted))
    return names.select("field", away.alias("distance")).where(F.col("distance") <= max(2, len(wanted) // 3)).orderBy("distance", "field")
