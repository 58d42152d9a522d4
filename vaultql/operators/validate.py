"""Rules as data: declared constraints give findings of one schema."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import globs
from ..functions import values as V

SCHEMA = ["code", "severity", "path", "rule", "field", "actual_value", "expected"]


@dataclass(frozen=True)
class Rule:
    """Constraints on the documents that path patterns and metadata values select.

    `target`, the path template of documents that are made by the rule, selects as `path` does if that is missing;
    `body` is the template of their text.
    `references` names the types that a field's links may lead to; `defaults` are values for fields that are missing.
    """

    name: str
    path: str | None = None
    where: dict = field(default_factory=dict)
    required: tuple[str, ...] = ()
    forbidden: tuple[str, ...] = ()
    types: dict = field(default_factory=dict)
    max_length: dict = field(default_factory=dict)
    allowed: dict = field(default_factory=dict)
    allowed_paths: tuple[str, ...] = ()
    path_not: str | None = None
    exclude: str | None = None
    references: dict = field(default_factory=dict)
    defaults: dict = field(default_factory=dict)
    target: str | None = None
    body: str | None = None


def _matches(path: Column, glob: str) -> Column:
    regex = globs.path_regex(glob)
    return path.rlike(regex) if regex else F.lit(False)


def selected_by_path(rule: Rule, path: Column) -> Column:
    own = rule.path if rule.path is not None else globs.glob_of_target(rule.target) if rule.target is not None else None
    out = F.lit(True) if own is None else _matches(path, own)
    for glob in (rule.path_not, rule.exclude):
        if glob is not None:
            out = out & ~_matches(path, glob)
    return out


def judged(documents: DataFrame, ignore: tuple[str, ...]) -> DataFrame:
    """documents that rules judge: those of ignored paths may be linked to, but have no findings."""
    for glob in ignore:
        documents = documents.where(~_matches(F.col("path"), glob))
    return documents


TYPES = ("string", "text", "number", "boolean", "date", "datetime", "time", "wikilink", "wikilink_or_list", "list_of_strings")


def _is_type(f: Column, wanted: str) -> Column:
    if wanted not in TYPES:
        raise ValueError(f"unknown type {wanted!r}")
    strings = F.coalesce(f["kind"] == "string", F.lit(False))
    each = lambda test: F.coalesce((f["kind"] == "array") & F.forall(F.variant_get(f["value"], "$", "array<variant>"), test), F.lit(False))
    link = lambda x: (V.kind(x) == "string") & V.is_wikilink(F.try_variant_get(x, "$", "string"))
    return {
        "string": lambda: strings, "text": lambda: strings, "number": lambda: f["kind"] == "number", "boolean": lambda: f["kind"] == "boolean",
        "date": lambda: strings & V.is_date(f["text"]), "datetime": lambda: strings & V.is_datetime(f["text"]), "time": lambda: strings & V.is_time(f["text"]),
        "wikilink": lambda: strings & V.is_wikilink(f["text"]), "wikilink_or_list": lambda: strings & V.is_wikilink(f["text"]) | each(link),
        "list_of_strings": lambda: each(lambda x: V.kind(x) == "string"),
    }[wanted]()


def _is(f: Column, value) -> Column:
    """Equality of rules over a field that was taken out once (see V.strictly_same)."""
    if isinstance(value, bool):
        test = (f["kind"] == "boolean") & (f["text"] == str(value).lower())
    elif isinstance(value, (int, float)):
        test = (f["kind"] == "number") & (f["number"] == float(value))
    else:
        test = (f["kind"] == "string") & (f["text"] == value)
    return F.coalesce(test, F.lit(False))


def findings(documents: DataFrame, rules: list[Rule], metadata: str = "metadata", ignore: tuple[str, ...] = ()) -> DataFrame:
    """(code, severity, path, rule, field, actual_value, expected) of all rules, in one pass over the documents.

    Each field that a rule names is taken out of the metadata once; every check is an expression over those that gives
    null or a finding, and a document's findings are one list that is exploded.
    """
    names = sorted({n for r in rules for n in (*r.where, *r.required, *r.forbidden, *r.types, *r.max_length, *r.allowed)})
    numeric = {n for r in rules for d in (r.where, r.allowed) for n, v in d.items() if any(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (v if isinstance(v, (list, tuple)) else [v]))}
    docs = judged(documents, ignore).select("path", *[V.field(metadata, n).alias(f"v{k}") for k, n in enumerate(names)])
    docs = docs.select("path", *[f"v{k}" for k in range(len(names))], *[V.kind(F.col(f"v{k}")).alias(f"k{k}") for k in range(len(names))])
    taken = [F.struct(F.col(f"v{k}").alias("value"), F.col(f"k{k}").alias("kind"), F.when(F.col(f"k{k}") == "string", F.variant_get(f"v{k}", "$", "string")).otherwise(F.to_json(f"v{k}")).alias("text"), (F.try_variant_get(F.col(f"v{k}"), "$", "double") if n in numeric else F.lit(None).cast("double")).alias("number")).alias(f"f{k}") for k, n in enumerate(names)]
    docs = docs.select("path", *taken)
    of = {n: F.col(f"f{k}") for k, n in enumerate(names)}
    present = lambda n: F.coalesce(of[n]["kind"] != "null", F.lit(False))
    checks: list[Column] = []
    for r in rules:
        selected = selected_by_path(r, F.col("path"))
        for name, value in r.where.items():
            selected = selected & reduce(lambda a, b: a | b, [_is(of[name], x) for x in (value if isinstance(value, list) else [value])])

        def found(test, code, name=None, expected=None, severity="error", r=r, selected=selected):
            actual = F.lit(None).cast("string") if name is None else of[name]["text"]
            row = F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(r.name).alias("rule"), F.lit(name).cast("string").alias("field"), actual.alias("actual_value"), F.lit(expected).cast("string").alias("expected"))
            checks.append(F.when(selected & test, row))

        for name in r.required:
            found(~present(name), "frontmatter-required-field-missing", name)
        for name in r.forbidden:
            found(present(name), "frontmatter-forbidden-field", name)
        for name, wanted in r.types.items():
            found(present(name) & ~_is_type(of[name], wanted), "field-type-invalid", name, wanted)
        for name, most in r.max_length.items():
            longest = F.when(of[name]["kind"] == "array", F.array_max(F.transform(V.elements(of[name]["value"]), lambda e: F.length(V.text(e))))).otherwise(F.length(of[name]["text"]))
            found(F.coalesce(present(name) & (longest > most), F.lit(False)), "frontmatter-exceeds-max-length", name, str(most), "warning")
        for name, values in r.allowed.items():
            found(present(name) & ~reduce(lambda a, b: a | b, [_is(of[name], x) for x in values]), "value-not-allowed", name, ",".join(map(str, values)))
        if r.allowed_paths:
            ok = reduce(lambda a, b: a | b, [_matches(F.col("path"), p) for p in r.allowed_paths], F.lit(False))
            found(~ok, "document-misrouted", expected=",".join(r.allowed_paths), severity="warning")
    rows = docs.select("path", F.explode(F.array_compact(F.array(*checks))).alias("f"))
    return rows.select("f.code", "f.severity", "path", "f.rule", "f.field", "f.actual_value", "f.expected")


def _row(frame: DataFrame, code, path: str, field=None, actual=None, expected=None, severity="warning", rule=None, extra=None) -> DataFrame:
    none = F.lit(None).cast("string")
    shown = [(code if isinstance(code, Column) else F.lit(code)), severity if isinstance(severity, Column) else F.lit(severity), F.col(path), *[none if c is None else c for c in (rule, field, actual, expected)]]
    return frame.select(*[c.alias(n) for c, n in zip(shown, SCHEMA, strict=True)], *[c.alias(n) for n, c in (extra or {}).items()])


def diagnostic_findings(diagnostics: DataFrame) -> DataFrame:
    """A finding for each of diagnostics(doc_path, severity, code, message)."""
    return _row(diagnostics, F.col("code"), "doc_path", actual=F.col("message"), severity=F.col("severity"))


def link_findings(links: DataFrame, details: bool = False) -> DataFrame:
    """Findings of links that lead nowhere or to several places; with `details` also the link's `target` and `reason`."""
    code = F.when(F.col("status") == "ambiguous", "link-ambiguous").when(F.col("reason") == "anchor-missing", "link-anchor-missing").when(F.col("reason") == "block-ref-missing", "link-block-missing").when(F.col("status") == "unresolved", "link-target-missing")
    extra = {"target": F.col("target"), "reason": F.coalesce("reason", F.when(F.col("status") == "ambiguous", "ambiguous"))} if details else {}
    return _row(links, code, "source_path", actual=F.col("target"), extra=extra).where("code IS NOT NULL")


def alias_findings(aliases: DataFrame, documents: DataFrame, malformed: DataFrame | None = None) -> DataFrame:
    """Aliases that are some document's stem (expected: the first such path), aliases of several documents (expected: the
    others, by comma) and entries that aren't names.

    The owners of an alias are gathered once by alias; an alias that a great many documents share makes a list as long
    as they are many in each of their findings, as the finding asks for.
    """
    stems = documents.groupBy(F.lower("stem").alias("alias")).agg(F.min("path").alias("by"))
    each = aliases.distinct()
    owners = each.groupBy("alias").agg(F.array_sort(F.collect_set("doc_path")).alias("owners")).where(F.size("owners") > 1)
    shadowed = _row(each.join(stems, "alias"), "frontmatter-alias-shadowed", "doc_path", actual=F.col("alias"), expected=F.col("by"))
    peers = F.array_join(F.array_remove("owners", F.col("doc_path")), ",")
    out = shadowed.unionByName(_row(each.join(owners, "alias"), "frontmatter-alias-duplicate", "doc_path", actual=F.col("alias"), expected=peers))
    if malformed is not None:
        out = out.unionByName(_row(malformed, "frontmatter-alias-malformed", "doc_path", actual=F.col("value")))
    return out


def typed_references(documents: DataFrame, links: DataFrame, rules: list[Rule], metadata: str = "metadata", type_field: str = "type", ignore: tuple[str, ...] = ()) -> DataFrame:
    """Findings for metadata links (source_path, property, resolved_path) to documents of another type than a rule wants.

    Exempt documents have no findings, and links to them aren't judged.
    """
    inside = judged(documents, ignore)
    kinds = inside.select(F.col("path").alias("resolved_path"), V.text(V.field(metadata, type_field)).alias("found_type"))
    out = None
    for r in (r for r in rules if r.references):
        chosen = inside.where(selected_by_path(r, F.col("path")))
        for name, value in r.where.items():
            chosen = chosen.where(reduce(lambda a, b: a | b, [V.strictly_same(V.field(metadata, name), x) for x in (value if isinstance(value, list) else [value])]))
        for name, wanted in r.references.items():
            mine = links.where(F.col("property") == name).join(chosen.select(F.col("path").alias("source_path")), "source_path", "left_semi")
            wrong = reference_findings(mine, kinds.withColumnsRenamed({"resolved_path": "path", "found_type": "type"}), list(wanted))
            rows = _row(wrong, "frontmatter-reference-type", "source_path", field=F.lit(name), actual=F.col("found_type"), expected=F.lit(",".join(wanted)), severity="error", rule=F.lit(r.name))
            out = rows if out is None else out.unionByName(rows)
    return out if out is not None else _row(documents.limit(0), "", "path")


def reference_findings(links: DataFrame, types: DataFrame, wanted: list[str]) -> DataFrame:
    """Metadata links whose target document has another type than those wanted. types(path, type)."""
    typed = links.join(types.withColumnsRenamed({"path": "resolved_path", "type": "found_type"}), "resolved_path")
    return typed.where(~F.coalesce(F.col("found_type").isin(*wanted), F.lit(False)))


def triage(found: DataFrame, **asked: str) -> DataFrame:
    """Findings by column: a comma list is any of its values (globs in `code` and `path`), several columns are all.

    `target` and `reason` are those of findings of links (see link_findings); findings without them don't match.
    """
    if unknown := set(asked) - {*SCHEMA, "target", "reason"}:
        raise ValueError(f"findings have no {sorted(unknown)}")
    for name, listed in asked.items():
        values = [v for v in listed.split(",") if v]
        here = F.col(name) if name in found.columns else F.lit(None).cast("string")
        tests = [here.rlike(globs.path_regex(v) or "$^") if name in ("code", "path") else here == v for v in values]
        found = found.where(reduce(lambda a, b: a | b, tests, F.lit(False)))
    return found
