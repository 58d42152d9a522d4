"""Templates as Column expressions: placeholders with transforms, date formats, destinations of moves, durations."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V


class TemplateError(ValueError):
    pass


# Date tokens, longest first, and Spark's letters for them.
TOKENS = {
    "MMMM": "MMMM", "dddd": "EEEE", "YYYY": "yyyy", "MMM": "MMM", "ddd": "EEE", "YY": "yy", "MM": "MM", "DD": "dd", "HH": "HH", "hh": "hh",
    "mm": "mm", "ss": "ss", "M": "M", "D": "d", "H": "H", "h": "h", "A": "a", "a": "a",
}
_TOKEN = re.compile(r"\[([^\]]*)\]|" + "|".join(f"({t})" if t == "a" else t for t in TOKENS) + "|.", re.S)


def formatted(now: Column, pattern: str) -> Column:
    """A timestamp in a pattern of date tokens; text in [brackets] and what is no token stays."""
    parts = []
    for m in _TOKEN.finditer(pattern):
        if m[1] is not None:
            parts.append(F.lit(m[1]))
        elif m[0] == "a":
            parts.append(F.lower(F.date_format(now, "a")))
        else:
            parts.append(F.date_format(now, TOKENS[m[0]]) if m[0] in TOKENS else F.lit(m[0]))
    return F.concat(F.lit(""), *parts)


def _spaced(c: Column) -> Column:
    return F.translate(c, "-_", "  ")


def _first_upper(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


TRANSFORMS = {
    "titlecase": lambda c: F.array_join(F.transform(F.filter(F.split(_spaced(c), r"\s+"), lambda w: w != ""), _first_upper), " "),
    "sentencecase": lambda c: _first_upper(F.lower(_spaced(c))), "lower": F.lower, "upper": F.upper, "unsep": _spaced,
    "strip_date_prefix": lambda c: F.regexp_replace(c, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}-", ""), "slugify": V.slug,
}


def rendered(template: str, *, title: Column, now: Column, names: dict[str, Column] | None = None, date_format: str = "YYYY-MM-DD", time_format: str = "HH:mm") -> Column:
    """A template with `{{title}}`, `{{now}}`, `{{date:FORMAT}}`, `{{time:FORMAT}}`, `{{var.name}}` or `{{path.name}}`, each
    with `| transform`s. Four braces are two plain ones. A name that isn't there, or is null, is empty.
    """
    names = names or {}

    def value(expression: str) -> Column:
        first, *steps = (x.strip() for x in expression.split("|"))
        name, colon, argument = first.partition(":")
        name = name.strip()
        if name == "title":
            out = title
        elif name == "now":
            out = formatted(now, "YYYY-MM-DD[T]HH:mm")
        elif name in ("date", "time"):
            out = formatted(now, argument if colon else date_format if name == "date" else time_format)
        elif name.startswith(("path.", "var.")):
            out = names.get(name.split(".", 1)[1], F.lit(""))
        else:
            raise TemplateError(f"unknown variable {name!r}" + (f"; did you mean var.{name}?" if name in names else ""))
        for step in steps:
            if step not in TRANSFORMS:
                raise TemplateError(f"unknown transform {step!r}")
            out = TRANSFORMS[step](out)
        return F.coalesce(out, F.lit(""))

    parts, at = [], 0
    while at < len(template):
        if template.startswith(("{{{{", "}}}}"), at):
            parts.append(F.lit(template[at : at + 2]))
            at += 4
        elif template.startswith("{{", at):
            end = template.find("}}", at)
            if end < 0:
                raise TemplateError("unclosed placeholder")
            parts.append(value(template[at + 2 : end].strip()))
            at = end + 2
        else:
            plain = re.compile(r"(?:(?!\{\{|\}\}\}\}).)+", re.S).match(template, at)[0]
            parts.append(F.lit(plain))
            at += len(plain)
    return F.concat(F.lit(""), *parts)


def destination(template: str, path: Column, metadata: Column | None = None, *, folder: bool = False) -> tuple[Column, Column]:
    """(new path, problem) of a move: `{stem}`, `{filename}` and `{frontmatter.field}` stand for the document's own.

    With `folder` the template names a folder, and the file keeps its name. The problem is null if there is none; a field
    must be there and be text, a number or a boolean.
    """
    if template.count("{") != template.count("}") or re.search(r"\{[^}]*\{|\{[^}]*$", template):
        return F.lit(None).cast("string"), F.lit("malformed template")
    _, stem, _ = V.path_parts(path)
    file = F.substring_index(path, "/", -1)
    parts, problems = [], []
    for text, name in re.findall(r"([^{]*)(?:\{([^}]*)\})?", template):
        parts.append(F.lit(text))
        if name == "stem":
            parts.append(stem)
        elif name == "filename":
            parts.append(file)
        elif name.startswith("frontmatter."):
            v = V.field(metadata if metadata is not None else F.lit(None).cast("variant"), name.removeprefix("frontmatter."))
            parts.append(V.text(v))
            problems.append(F.when(v.isNull(), f"missing field {name.removeprefix('frontmatter.')}").when(~V.kind(v).isin("string", "number", "boolean"), f"field {name.removeprefix('frontmatter.')} is no scalar"))
        elif name:
            problems.append(F.lit(f"unknown placeholder {name}"))
    made = F.concat(*parts)
    made = F.concat(F.regexp_replace(made, "/+$", ""), F.lit("/"), file) if folder else made
    problem = reduce(lambda a, b: F.coalesce(a, b), problems, F.lit(None).cast("string"))
    return F.when(problem.isNull(), made), problem


# Seconds of a duration's unit.
_SECONDS = {"w": 604_800, "d": 86_400, "h": 3_600, "m": 60}


def seconds(duration: str) -> int | None:
    """`90d`, `12h`, `2w`, `5m` in seconds; None for anything else."""
    m = re.fullmatch(r"\s*\+?([0-9]+)\s*([wdhm])\s*", duration)
    return int(m[1]) * _SECONDS[m[2]] if m else None
