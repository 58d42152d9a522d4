"""Dynamically typed metadata values as Column expressions: elements, renderings, comparisons, sort keys."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING, NULL = "(missing)", "(null)"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_fold(c: Column) -> Column:
    return F.translate(c, _UP, _LOW)


def bare(c: Column) -> Column:
    """Text without wikilink brackets."""
    return F.replace(F.replace(c, F.lit("[["), F.lit("")), F.lit("]]"), F.lit(""))


def unbracketed(s: str) -> str:
    return s.replace("[[", "").replace("]]", "")


def field(variant: Column | str, name: str) -> Column:
    """One top-level key of a VARIANT; dots and quotes in the name belong to the key."""
    of = F.col(variant) if isinstance(variant, str) else variant
    quote = next((q for q in "\"'" if q not in name), None)
    if not name or quote is None:  # paths can't spell it
        return F.try_element_at(F.try_variant_get(of, "$", "map<string,variant>"), F.lit(name))
    return F.try_variant_get(of, f"$[{quote}{name}{quote}]", "variant")


def kind(v: Column) -> Column:
    """null, boolean, number, string, array or object; SQL null for an absent value."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), None).when(F.is_variant_null(v), "null").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object")
        .when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").otherwise("number")
    )


def present(v: Column) -> Column:
    """Not absent and not null; an empty list is present. Never SQL null."""
    return v.isNotNull() & ~F.coalesce(F.is_variant_null(v), F.lit(True))


def elements(v: Column) -> Column:
    """A list's elements without nulls, or the value itself as a list of one; null if it isn't present."""
    listed = F.variant_get(v, "$", "array<variant>")
    return F.when(~present(v), None).when(kind(v) == "array", F.filter(listed, lambda e: e.isNotNull() & ~F.is_variant_null(e))).otherwise(F.array(v))


def text(v: Column) -> Column:
    """A value as text: strings as they are, true and false, numbers and objects as JSON."""
    return F.when(kind(v) == "string", F.variant_get(v, "$", "string")).otherwise(F.to_json(v))


def canonical(v: Column) -> Column:
    """A value as queries compare it: its text without wikilink brackets."""
    return bare(text(v))


def number(v: Column) -> Column:
    """Numbers, and booleans as 1 and 0, for typed comparisons."""
    return F.when(kind(v) == "boolean", F.when(F.try_variant_get(v, "$", "boolean"), 1.0).otherwise(0.0)).when(kind(v) == "number", F.try_variant_get(v, "$", "double"))


def coerced(value: str) -> bool | int | float | str:
    """A value as written in a query: true or false, then an integer, then a float, then text."""
    if value in ("true", "false"):
        return value == "true"
    for kind_of in (int, float):
        try:
            return kind_of(value)
        except ValueError:
            pass
    return value


def exact(value) -> bool:
    """A whole number beyond what doubles tell apart, which is compared as a decimal."""
    return not isinstance(value, (bool, str)) and float(value).is_integer() and 1 << 53 <= abs(value) < 10**38


def same(e: Column, value) -> Column:
    """Equality of queries: typed for numbers and booleans, bracket-free text otherwise. Never SQL null."""
    if exact(value):
        return F.coalesce((kind(e) == "number") & (F.try_variant_get(e, "$", "decimal(38,0)") == F.lit(Decimal(value))), F.lit(False))
    if isinstance(value, (bool, int, float)):
        return F.coalesce(number(e) == float(value), F.lit(False))
    return F.coalesce(kind(e).isin("string", "object", "array") & (canonical(e) == unbracketed(value)), F.lit(False))


def strictly_same(v: Column, value) -> Column:
    """Equality of rules: neither lists nor kinds of value are looked through. Never SQL null."""
    if isinstance(value, bool):
        test = (kind(v) == "boolean") & (F.try_variant_get(v, "$", "boolean") == value)
    elif isinstance(value, (int, float)):
        test = (kind(v) == "number") & (F.try_variant_get(v, "$", "double") == float(value))
    else:
        test = (kind(v) == "string") & (text(v) == value)
    return F.coalesce(test, F.lit(False))


def group_key(v: Column) -> Column:
    """A value as a key of counts: absent, null, text, or a whole list as JSON."""
    return F.when(v.isNull(), MISSING).when(F.is_variant_null(v), NULL).otherwise(text(v))


def inline(v: Column) -> Column:
    """A value on one line: a list's elements joined by comma and space, (null) for null; SQL null if absent."""
    listed = F.array_join(F.transform(F.variant_get(v, "$", "array<variant>"), lambda e: F.when(e.isNull() | F.is_variant_null(e), NULL).otherwise(text(e))), ", ")
    return F.when(v.isNull(), None).when(F.is_variant_null(v), NULL).when(kind(v) == "array", listed).otherwise(text(v))


def sort_keys(v: Column) -> list[Column]:
    """Null before numbers (booleans as 0 and 1) before text."""
    rank = F.when(~present(v), 0).when(number(v).isNotNull(), 1).otherwise(2)
    return [rank, number(v), F.when(rank == 2, text(v))]


def slug(c: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def match_form(c: Column) -> Column:
    """The form in which names are compared for likeness."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[ \t_-]+", "-"), "^-+|-+$", "")


def likeness(a: Column, b: Column) -> Column:
    """1 - edit distance / length of the longer one; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


# The shape of a time of day, and of midnight.
_OFFSET = r"(Z|[+-]([01]\d|2[0-3]):[0-5]\d)?"
TIME = r"([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?" + _OFFSET
MIDNIGHT = r"00:00(:00(\.\d+)?)?" + _OFFSET


def _is_day(c: Column) -> Column:
    return c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull()


def is_date(c: Column) -> Column:
    """A calendar day, alone or with a time of midnight."""
    return F.coalesce(_is_day(c) | (c.rlike("^.{10}[T ]" + MIDNIGHT + "$") & _is_day(F.substring(c, 1, 10))), F.lit(False))


def is_time(c: Column) -> Column:
    return F.coalesce(c.rlike("^" + TIME + "$"), F.lit(False))


def is_datetime(c: Column) -> Column:
    """A calendar day, T or a space, and a time, with or without an offset."""
    return F.coalesce(c.rlike("^.{10}[T ]" + TIME + "$") & _is_day(F.substring(c, 1, 10)), F.lit(False))


def is_wikilink(c: Column) -> Column:
    return F.coalesce(c.startswith("[[") & c.endswith("]]") & (F.octet_length(c) > 4), F.lit(False))


def path_parts(c: Column) -> tuple[Column, Column, Column]:
    """Folder ("" for the root), stem and first folder ("root" for the root) of a path."""
    folder = F.when(c.contains("/"), F.regexp_extract(c, "^(.*)/[^/]*$", 1)).otherwise("")
    stem = F.regexp_replace(F.substring_index(c, "/", -1), r"\.[^.]*$", "")
    return folder, stem, F.when(c.contains("/"), F.substring_index(c, "/", 1)).otherwise("root")


def relative(folder: Column, path: Column) -> Column:
    """path as seen from a folder: `../` for each level that they don't share, then the rest."""
    split = lambda c: F.filter(F.split(c, "/"), lambda x: x != "")
    one = F.struct(split(folder).alias("a"), split(path).alias("b"))

    def shown(s: Column) -> Column:
        differs = F.filter(F.sequence(F.lit(0), F.size(s["a"])), lambda i: (i >= F.size(s["a"])) | ~F.coalesce(F.get(s["a"], i) == F.get(s["b"], i), F.lit(False)))
        common = F.array_min(differs)
        return F.concat(F.repeat(F.lit("../"), F.size(s["a"]) - common), F.array_join(F.slice(s["b"], common + 1, F.greatest(F.size(s["b"]) - common, F.lit(0))), "/"))

    return F.transform(F.array(one), shown)[0]


def contained(path: Column) -> Column:
    """Within the tree: neither absolute nor empty, and never above its root."""
    parts = F.split(path, "/")
    return F.coalesce((path != "") & ~path.startswith("/") & ~path.contains("\\") & ~F.exists(parts, lambda p: p.isin("..", ".", "")), F.lit(False))


def today_or(value: str) -> str:
    return date.today().isoformat() if value == "today" else value
