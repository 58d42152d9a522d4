"""Rules, repairs and plans from YAML or JSON files, with the checks that a wrong one fails before any job runs."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import globs, templates
from ..operators.mutate import OPERATIONS
from ..operators.repair import Repair
from ..operators.validate import TYPES, Rule, selected_by_path
from .markdown import loaded
from .store import stored


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    ignore_files: tuple[str, ...] = ()
    ignore_validate: tuple[str, ...] = ()
    alias_field: str = "aliases"
    rules: tuple[Rule, ...] = ()
    repairs: tuple[Repair, ...] = ()
    date_format: str = "YYYY-MM-DD"
    time_format: str = "HH:mm"
    retention: str = "90d"


# The keys that a file may have, by section. Strings without a declared length have 64 characters at most,
# and no declared length is above 256.
KEYS = {
    "": {"files", "validate", "repair", "links", "templates", "events"}, "files": {"ignore"}, "links": {"alias_field"}, "templates": {"date_format", "time_format"}, "events": {"retention"},
    "validate": {"ignore", "required_frontmatter", "rules"}, "repair": {"rules"},
    "validate rule": {"name", "match", "exclude", "required_frontmatter", "forbidden_frontmatter", "field_types", "allowed_values", "allowed_paths", "field_references", "frontmatter_defaults", "target", "body"},
    "match": {"path", "path_not", "frontmatter"}, "exclude": {"path"}, "repair rule": {"name", "match", "set_frontmatter", "add_frontmatter", "remove_frontmatter", "move_document"},
    "repair match": {"code", "rule", "field", "actual_value"}, "field type": {"type", "max_length", "indexed"},
}
DEFAULT_LENGTH, MOST_LENGTH = 64, 256


def _known(found, kind: str, where: str) -> dict:
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ConfigError(f"{where}: a mapping is expected")
    if extra := set(map(str, found)) - KEYS[kind]:
        raise ConfigError(f"{where}: unknown keys {sorted(extra)}")
    return found


def _glob(glob, where: str) -> str | None:
    if glob is not None and (not isinstance(glob, str) or globs.path_regex(glob) is None):
        raise ConfigError(f"{where}: {glob!r} is no pattern")
    return glob


def _rule(raw, k: int, everywhere: tuple[str, ...]) -> Rule:
    where = f"validate.rules[{k}]"
    raw = _known(raw, "validate rule", where)
    match, exclude = _known(raw.get("match"), "match", f"{where}.match"), _known(raw.get("exclude"), "exclude", f"{where}.exclude")
    types, lengths = {}, {}
    for name, spec in (raw.get("field_types") or {}).items():
        spec = _known({"type": spec} if isinstance(spec, str) else spec, "field type", f"{where}.field_types.{name}")
        if spec.get("type") not in TYPES:
            raise ConfigError(f"{where}.field_types.{name}: unknown type {spec.get('type')!r}")
        types[name], most = spec["type"], spec.get("max_length")
        if most is not None and (not isinstance(most, int) or isinstance(most, bool) or not 1 <= most <= MOST_LENGTH):
            raise ConfigError(f"{where}.field_types.{name}: max_length is between 1 and {MOST_LENGTH}")
        if most is not None and spec["type"] not in ("string", "list_of_strings"):
            raise ConfigError(f"{where}.field_types.{name}: {spec['type']} has no max_length")
        if spec["type"] in ("string", "list_of_strings"):
            lengths[name] = most or DEFAULT_LENGTH
    required, forbidden = (tuple(raw.get(f"{w}_frontmatter") or ()) for w in ("required", "forbidden"))
    if both := set(required) & set(forbidden):
        raise ConfigError(f"{where}: {sorted(both)} are required and forbidden")
    allowed = raw.get("allowed_values") or {}
    for name, values in allowed.items():
        if not isinstance(values, list) or not values or any(isinstance(v, (list, dict)) or v is None for v in values):
            raise ConfigError(f"{where}.allowed_values.{name}: a list of plain values is expected")
    defaults = raw.get("frontmatter_defaults") or {}
    for name, value in defaults.items():
        if isinstance(value, str):
            _template(value, f"{where}.frontmatter_defaults.{name}")
        if name in allowed and not (isinstance(value, str) and "{{" in value) and value not in allowed[name]:
            raise ConfigError(f"{where}.frontmatter_defaults.{name}: {value!r} isn't allowed")
        if name in forbidden:
            raise ConfigError(f"{where}.frontmatter_defaults.{name}: the field is forbidden")
    references = {n: tuple([v] if isinstance(v, str) else v) for n, v in (raw.get("field_references") or {}).items()}
    for name in references:
        if types.get(name, "wikilink") not in ("wikilink", "wikilink_or_list"):
            raise ConfigError(f"{where}.field_references.{name}: {types[name]} holds no links")
    target = raw.get("target")
    if target is not None:
        try:
            _glob(globs.glob_of_target(target), f"{where}.target")
        except ValueError as e:
            raise ConfigError(f"{where}.target: {e}") from e
    if raw.get("body") is not None and target is None:
        raise ConfigError(f"{where}: a body needs a target")
    paths = tuple(_glob(p, f"{where}.allowed_paths") for p in raw.get("allowed_paths") or ())
    return Rule(
        raw.get("name") or f"rule {k + 1}", _glob(match.get("path"), where), match.get("frontmatter") or {}, tuple(dict.fromkeys((*everywhere, *required))), forbidden, types, lengths, allowed, paths,
        _glob(match.get("path_not"), where), _glob(exclude.get("path"), where), references, defaults, target, raw.get("body"),
    )


def _template(text: str, where: str) -> None:
    """Every placeholder and transform is known."""
    for inner in re.findall(r"\{\{(.*?)\}\}", text.replace("{{{{", "").replace("}}}}", "")):
        first, *steps = (x.strip() for x in inner.split("|"))
        if bad := [s for s in steps if s not in templates.TRANSFORMS]:
            raise ConfigError(f"{where}: unknown transforms {bad}")
        if first.partition(":")[0].strip() not in ("title", "now", "date", "time") and not first.startswith(("path.", "var.")):
            raise ConfigError(f"{where}: unknown variable {first!r}")


def _repair(raw, k: int) -> Repair:
    where = f"repair.rules[{k}]"
    raw = _known(raw, "repair rule", where)
    match = _known(raw.get("match"), "repair match", f"{where}.match")
    actions = [a for a in ("set_frontmatter", "add_frontmatter", "remove_frontmatter", "move_document") if a in raw]
    if len(actions) != 1:
        raise ConfigError(f"{where}: one action is expected, not {actions}")
    action, spec = actions[0], raw[actions[0]]
    keys = {k: None if match.get(k) is None else str(match[k]) for k in KEYS["repair match"]}
    if action == "move_document":
        spec = {"destination": spec} if isinstance(spec, str) else spec
        if not isinstance(spec, dict) or set(spec) not in ({"destination"}, {"directory"}):
            raise ConfigError(f"{where}: a destination or a directory is expected")
        return Repair(action, **keys, destination=next(iter(spec.values())), folder="directory" in spec)
    spec = {"field": spec} if isinstance(spec, str) else spec
    if not isinstance(spec, dict) or not spec.get("field") or ("value" in spec) == (action == "remove_frontmatter"):
        raise ConfigError(f"{where}: {action} needs a field{'' if action == 'remove_frontmatter' else ' and a value'}")
    return Repair(action, **keys, set_field=spec["field"], value=None if "value" not in spec else spec["value"] if isinstance(spec["value"], str) else json.dumps(spec["value"]))


def parse_config(text: str) -> Config:
    """A Config from YAML; ConfigError names the first thing that is wrong."""
    raw = _known(loaded(text), "", "config")
    files, validate, repair, links, texts, events = (_known(raw.get(s), s, s) for s in ("files", "validate", "repair", "links", "templates", "events"))
    everywhere = tuple(validate.get("required_frontmatter") or ())
    rules = [_rule(r, k, ()) for k, r in enumerate(validate.get("rules") or [])]
    if everywhere:
        rules.insert(0, Rule("everywhere", required=everywhere))
    names = [r.name for r in rules]
    if twice := {n for n in names if names.count(n) > 1}:
        raise ConfigError(f"validate.rules: {sorted(twice)} are there twice")
    clash = {}
    for r in rules:
        for name, value in r.defaults.items():
            if r.path is not None and clash.setdefault((r.path, json.dumps(r.where, sort_keys=True), name), value) != value:
                raise ConfigError(f"validate.rules: two defaults of {name} for {r.path}")
    retention = str(events.get("retention", "90d"))
    if templates.seconds(retention) is None:
        raise ConfigError(f"events.retention: {retention!r} is no duration")
    ignored = [tuple(s.get("ignore") or ()) for s in (files, validate)]
    for glob in ignored[1]:
        _glob(glob, "validate.ignore")
    return Config(
        *ignored, str(links.get("alias_field", "aliases")), tuple(rules), tuple(_repair(r, k) for k, r in enumerate(repair.get("rules") or [])),
        str(texts.get("date_format", "YYYY-MM-DD")), str(texts.get("time_format", "HH:mm")), retention,
    )


# -- plans ---------------------------------------------------------------------------------------

PLAN = "op_idx int, path string, operation string, field string, old_value string, new_value string, destination string, document_hash string"


def parse_plan(text: str) -> tuple[list[dict], str]:
    """(changes in order, digest) of a plan in JSON or YAML: a mapping with a list `changes`. The digest is that of the
    canonical JSON, so it is the same for both forms.
    """
    raw = loaded(text)
    if not isinstance(raw, dict) or not isinstance(raw.get("changes"), list):
        raise ConfigError("a plan has a list of changes")
    names = [x.split()[0] for x in PLAN.split(", ")][1:]
    out = []
    for k, c in enumerate(raw["changes"]):
        if not isinstance(c, dict) or not c.get("path") or c.get("operation") not in OPERATIONS:
            raise ConfigError(f"changes[{k}]: a path and one of {sorted(OPERATIONS)} are expected")
        if extra := set(c) - set(names):
            raise ConfigError(f"changes[{k}]: unknown keys {sorted(extra)}")
        out.append({"op_idx": k, **{n: c.get(n) if c.get(n) is None or isinstance(c[n], str) else json.dumps(c[n], ensure_ascii=False) for n in names}})
    digest = hashlib.sha256(json.dumps(raw, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    return out, digest


def read_plan(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """A plan's changes and digest; the file may be in any store that Spark reads."""
    text = spark.read.text(path, wholetext=True).first()[0]  # one file, made by hand or by a planner
    rows, digest = parse_plan(text)
    return spark.createDataFrame([tuple(r.values()) for r in rows], PLAN), digest


# -- defaults ------------------------------------------------------------------------------------


def with_defaults(documents: DataFrame, rules: list[Rule], *, title: Column, now: Column, fields: str = "fields", extra: Column | None = None) -> DataFrame:
    """documents whose map `fields` (text by name, values as JSON) has the defaults of all rules that match.

    Rules match by path and by the fields so far, so a default may make further rules match: passes are made until none
    changes anything. Fields that are there are never changed, and earlier rules come first. A default that is text is
    a template (see templates.rendered) with the captures of the rule's pattern as names, and those of the map `extra`.

    No more than two passes can add anything if one rule at most looks at fields: these are one plan. Else each pass is
    a job over the documents that the last one changed, and its rows are written, so that a plan is as large for sixteen
    chained rules as for two.
    """
    held = [r for r in rules if r.defaults]
    looking = sum(bool(r.where) for r in held)
    out = documents
    if looking <= 1:
        for _ in range(min(len(held), 1 + looking)):
            out = _with_defaults_once(out, held, title, now, fields, extra)
        return out
    done, grown = [], F.size(fields) > F.col("_vq_size")
    active = stored(_with_defaults_once(out.withColumn("_vq_size", F.size(fields)), held, title, now, fields, extra), "defaults")
    while True:
        done.append(active.where(~grown).drop("_vq_size"))
        active = active.where(grown)
        if active.isEmpty():
            return reduce(DataFrame.unionByName, done)
        active = stored(_with_defaults_once(active.withColumn("_vq_size", F.size(fields)), held, title, now, fields, extra), "defaults")


def _with_defaults_once(documents: DataFrame, held: list[Rule], title: Column, now: Column, fields: str, extra: Column | None) -> DataFrame:
    added = []
    for r in held:
        test = selected_by_path(r, F.col("path"))
        for name, value in r.where.items():
            wanted = [json.dumps(v, ensure_ascii=False) for v in (value if isinstance(value, list) else [value])]
            test = test & F.coalesce(F.try_element_at(fields, F.lit(name)).isin(wanted), F.lit(False))
        caught = globs.captures(F.col("path"), r.path or globs.glob_of_target(r.target or "**"))
        for name, value in r.defaults.items():
            if isinstance(value, str):
                names = dict(caught)
                for n in re.findall(r"\{\{\s*(?:var|path)\.(\w+)", value) if extra is not None else []:
                    more = F.try_element_at(extra, F.lit(n))
                    names[n] = F.coalesce(caught[n], more) if n in caught else more
                made = F.to_json(F.struct(templates.rendered(value, title=title, now=now, names=names).alias("x")))
                made = F.substring(made, 6, 1 << 30).substr(F.lit(1), F.length(made) - 6)
            else:
                made = F.lit(json.dumps(value, ensure_ascii=False))
            added.append(F.when(test & ~F.array_contains(F.map_keys(fields), name), F.struct(F.lit(name).alias("k"), made.alias("v"))))
    each = F.array_compact(F.array(*added))
    # the first of those with one name
    once = F.filter(each, lambda x, i: ~F.exists(F.slice(each, 1, i), lambda y: y["k"] == x["k"]))
    return documents.withColumn(fields, F.map_concat(fields, F.map_from_entries(once)))
