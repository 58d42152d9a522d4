"""Repair planning: likeliest targets, first matching rules, ids of changes, rewritten links, preconditions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import templates
from ..functions import values as V


def closest(targets: DataFrame, stems: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(target, outcome, stem, distance): the likeliest stem of each broken target; ties are ambiguous.

    Names within the threshold differ in length by a bounded share and, cut into one part more than edits are allowed,
    agree in one part; so the join is on (length, place, part), never all against all. `outcome` is high for an equal
    form, medium, ambiguous or none.
    """
    t = targets.select("target").where("target IS NOT NULL").distinct().withColumn("a", V.match_form(F.col("target")))
    s = stems.select("stem", V.match_form(F.col("stem")).alias("b")).groupBy("b").agg(F.min("stem").alias("stem"), F.count("*").alias("owners"))
    edits = lambda n: F.floor(n * F.lit(1 - threshold) + F.lit(1e-9)).cast("int")
    # the stem's parts, by the most edits that its longest partner could take
    span = F.length("b")
    most = edits(span / F.lit(threshold))
    k = most + 1
    cut = lambda i: F.floor(i * span / k).cast("int")
    parts = s.select("b", "stem", "owners", span.alias("n"), F.explode(F.sequence(F.lit(0), k - 1)).alias("i")).withColumn("start", F.floor(F.col("i") * F.col("n") / (edits(F.col("n") / F.lit(threshold)) + 1)).cast("int"))
    parts = parts.withColumn("end", F.floor((F.col("i") + 1) * F.col("n") / (edits(F.col("n") / F.lit(threshold)) + 1)).cast("int"))
    parts = parts.withColumn("part", F.substring("b", F.col("start") + 1, F.col("end") - F.col("start")))
    # a target looks for each part of each stem length, shifted by no more than the edits
    low, high = F.ceil(F.length("a") * F.lit(threshold) - F.lit(1e-9)).cast("int"), F.floor(F.length("a") / F.lit(threshold) + F.lit(1e-9)).cast("int")
    lengths = s.select(F.length("b").alias("n")).distinct()  # a few hundred at most: names are no longer
    wanted = t.where("a <> ''").select("target", "a", F.explode(F.sequence(F.greatest(low, F.lit(0)), high)).alias("n")).join(lengths, "n")
    allowed = edits(F.col("n") / F.lit(threshold))
    wanted = wanted.select("target", "a", "n", allowed.alias("m"), F.explode(F.sequence(F.lit(0), allowed)).alias("i"))
    start, end = F.floor(F.col("i") * F.col("n") / (F.col("m") + 1)).cast("int"), F.floor((F.col("i") + 1) * F.col("n") / (F.col("m") + 1)).cast("int")
    # part i is shifted by i edits before it and by m - i after it at most, seen from either end
    away = F.length("a") - F.col("n")
    first = F.greatest(F.lit(0), start - F.col("i"), start + away - (F.col("m") - F.col("i")))
    last = F.least(F.length("a") - (end - start), start + F.col("i"), start + away + (F.col("m") - F.col("i")))
    wanted = wanted.select("target", "a", "n", "i", (end - start).alias("len"), first.alias("first"), last.alias("last")).where("first <= last")
    wanted = wanted.select("target", "a", "n", "i", "len", F.explode(F.sequence("first", "last")).alias("at"))
    wanted = wanted.select("target", "a", "n", "i", F.substring("a", F.col("at") + 1, F.col("len")).alias("part")).distinct()
    pairs = wanted.join(parts, ["n", "i", "part"]).select("target", "a", "b", "stem", "owners").distinct()
    scored = pairs.withColumn("distance", F.levenshtein("a", "b")).withColumn("score", V.likeness(F.col("a"), F.col("b"))).where(F.col("score") >= threshold)
    best = scored.groupBy("target").agg(F.max("score").alias("score"))
    top = scored.join(best, ["target", "score"]).groupBy("target", "score").agg(F.sum("owners").alias("owners"), F.min("stem").alias("stem"), F.min("distance").alias("distance"))
    outcome = F.when(F.col("owners") > 1, "ambiguous").when(F.col("score") == 1, "high").otherwise("medium")
    top = top.select("target", outcome.alias("outcome"), F.when(F.col("owners") == 1, F.col("stem")).alias("stem"), F.col("distance").cast("int").alias("distance"))
    return t.select("target").join(top, "target", "left").select("target", F.coalesce("outcome", F.lit("none")).alias("outcome"), "stem", "distance")


def first_rule(found: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """found with rule_idx and action of the first rule whose columns all match; a null in a rule matches anything.

    The rules are configuration, a few dozen rows; above ten thousand the plan is refused. They meet the findings by
    the first of `keys`, each value's rules as one list in order, so a finding is a row before and after, repeated or not.
    """
    held = rules.select("rule_idx", "action", *keys).limit(10_001).collect()
    if len(held) > 10_000:
        raise ValueError("more than 10000 repair rules")
    held = sorted(held, key=lambda r: r["rule_idx"])
    first, *rest = keys
    lists = [(v, [tuple(r) for r in held if r[first] in (None, v)]) for v in sorted({r[first] for r in held if r[first] is not None})]
    types = {f.name: f.dataType.simpleString() for f in rules.schema}
    kind = "array<struct<" + ",".join(f"`{n}`:{types[n]}" for n in ("rule_idx", "action", *keys)) + ">>"
    every = F.array(*[F.struct(*[F.lit(v).cast(types[n]).alias(n) for n, v in r.asDict().items()]) for r in held if r[first] is None]).cast(kind)
    out = found.withColumn("_rules", F.lit(None).cast(kind))
    if lists:
        by_key = F.broadcast(found.sparkSession.createDataFrame(lists, f"_key {types[first]}, _rules {kind}"))
        out = found.join(by_key, F.col(first) == F.col("_key"), "left")

    def fits(r: Column) -> Column:
        test = F.lit(True)
        for k in rest:
            test = test & (r[k].isNull() | F.coalesce(r[k] == F.col(k), F.lit(False)))
        return test

    out = out.withColumn("_c", F.get(F.filter(F.coalesce("_rules", every), fits), 0))
    return out.select(*found.columns, "_c.rule_idx", F.coalesce("_c.action", F.lit("skip")).alias("action"))


def with_change_ids(changes: DataFrame) -> DataFrame:
    """changes(path, code, old_value) with change_id: 16 hex digits of a digest over those and the occurrence.

    No old value and an empty one are different.
    """
    w = Window.partitionBy("path", "code", "old_value").orderBy(*[c for c in changes.columns])
    out = changes.withColumn("occurrence", F.row_number().over(w) - 1)
    old = F.coalesce(F.concat(F.lit("="), "old_value"), F.lit(""))
    return out.withColumn("change_id", F.substring(F.sha2(F.concat_ws("\x1f", "path", "code", old, F.col("occurrence").cast("string")), 256), 1, 16))


def rewritten(raw: Column, target: Column) -> Column:
    """A wikilink's or embed's text with another target; label, anchor and an embed's mark stay. Null if it is neither."""
    inner = F.regexp_extract(raw, r"^!?\[\[(.*)\]\]$", 1)
    rest = F.regexp_extract(inner, r"^[^|#]*([|#].*)$", 1)
    return F.when(raw.rlike(r"^!?\[\[.*\]\]$"), F.concat(F.when(raw.startswith("!"), "!").otherwise(""), F.lit("[["), target, rest, F.lit("]]")))


def rewritten_markdown(raw: Column, source_path: Column, new_path: Column) -> Column:
    """A Markdown link, whole or its address only, that leads to new_path from the source's folder; the anchor stays."""
    address = V.relative(V.path_parts(source_path)[0], new_path)
    whole = raw.rlike(r"\]\(.*\)")
    inside = F.when(whole, F.regexp_extract(raw, r"\]\((.*)\)", 1)).otherwise(raw)
    made = F.concat(address, F.regexp_extract(inside, r"(#.*)$", 1))
    return F.when(whole, F.concat(F.regexp_extract(raw, r"^(.*?\]\()", 1), made, F.lit(")"))).otherwise(made)


def moved_markdown(target: Column, old: str, new: str) -> Column:
    """A Markdown link's path after a move; the anchor stays."""
    path, anchor = F.substring_index(target, "#", 1), F.regexp_extract(target, "(#.*)$", 1)
    return F.when(path == old, F.concat(F.lit(new), anchor)).otherwise(target)


def link_impact(links: DataFrame, moves: DataFrame) -> DataFrame:
    """(path, new_path, source_path, raw, kind, how, new_raw): the links to moved documents whose text must change.

    Wikilinks and embeds with a path get the new one without .md (how: path); those by stem change if the stem does
    (stem); Markdown links get the path from their document's folder (markdown). A link in a document that moves too is
    seen from its new place. links(source_path, resolved_path, raw, kind, target), moves(path, new_path).
    """
    m = moves.select("path", "new_path")
    hit = links.join(m, links["resolved_path"] == m["path"]).select("path", "new_path", "source_path", "raw", "kind", "target")
    own = m.select(F.col("path").alias("source_path"), F.col("new_path").alias("_from"))
    hit = hit.join(own, "source_path", "left")
    place = F.coalesce("_from", "source_path")
    old_stem, new_stem = V.path_parts(F.col("path"))[1], V.path_parts(F.col("new_path"))[1]
    how = F.when(F.col("kind") == "markdown", "markdown").when(F.col("target").contains("/"), "path").when(old_stem != new_stem, "stem")
    new = F.when(how == "markdown", rewritten_markdown(F.col("raw"), place, F.col("new_path"))).when(how == "path", rewritten(F.col("raw"), F.regexp_replace("new_path", r"\.md$", ""))).otherwise(rewritten(F.col("raw"), new_stem))
    return hit.select("path", "new_path", place.alias("source_path"), "raw", "kind", how.alias("how"), new.alias("new_raw")).where("how IS NOT NULL")


def rewrite_wikilink(documents: DataFrame, links: DataFrame, old_path: str, old: str, new: str, metadata: str = "metadata") -> DataFrame:
    """(path, operation, field, old_value, new_value): changes that point all links to old_path at another name.

    rewrite_link for each different target of body wikilinks and embeds that resolve to it; set_frontmatter for metadata
    that is exactly the link `[[old]]`, or a list with it (as JSON).
    """
    none = F.lit(None).cast("string")
    body = links.where((F.col("resolved_path") == old_path) & F.col("kind").isin("wikilink", "embed") & (F.coalesce("area", F.lit("body")) == "body"))
    body = body.select(F.col("source_path").alias("path"), F.lit("rewrite_link").alias("operation"), none.alias("field"), F.col("target").alias("old_value"), F.lit(new).alias("new_value")).distinct()
    fields = documents.select("path", F.explode(F.try_variant_get(F.col(metadata), "$", "map<string,variant>")).alias("field", "v"))
    was, now = f"[[{old}]]", f"[[{new}]]"
    is_link = F.coalesce((V.kind(F.col("v")) == "string") & (V.text(F.col("v")) == was), F.lit(False))
    listed = F.variant_get("v", "$", "array<variant>")
    same = lambda e: F.coalesce((V.kind(e) == "string") & (V.text(e) == was), F.lit(False))
    is_list = (V.kind(F.col("v")) == "array") & F.coalesce(F.exists(listed, same), F.lit(False))
    swapped = F.to_json(F.transform(listed, lambda e: F.when(same(e), F.parse_json(F.to_json(F.struct(F.lit(now).alias("x"))).substr(F.lit(6), F.lit(len(now) + 2)))).otherwise(e)))
    value = F.when(is_link, F.lit(now)).when(is_list, swapped)
    sets = fields.select("path", F.lit("set_frontmatter").alias("operation"), "field", V.text(F.col("v")).alias("old_value"), value.alias("new_value")).where("new_value IS NOT NULL")
    return body.unionByName(sets)


# Why a finding has no change.
SKIPS = {
    "link-ambiguous": "ambiguous-target", "link-target-missing": "link-decision-needed", "link-anchor-missing": "link-decision-needed", "link-block-missing": "link-decision-needed",
    "frontmatter-required-field-missing": "missing-default", "frontmatter-alias-shadowed": "alias-shadowed",
    **{c: "no-rule-matched" for c in ("value-not-allowed", "field-type-invalid", "frontmatter-exceeds-max-length", "frontmatter-forbidden-field", "document-misrouted", "frontmatter-reference-type", "frontmatter-alias-malformed", "frontmatter-alias-duplicate")},
}
NEXT = {
    "ambiguous-target": "name the path in the link or rename a namesake", "link-decision-needed": "make the target or change the link", "missing-default": "give the rule a default or fill the field in",
    "no-rule-matched": "add a repair rule or change the document", "alias-shadowed": "rename the alias or the document", "graph-diagnostic": "mend the document",
    "missing-hash": "read the documents again", "precondition-failed": "give the document what the destination needs",
}


@dataclass(frozen=True)
class Repair:
    """What to do about the findings that match: set, add or remove a field, or move the document.

    `destination` is a template (see templates.destination); with `folder` it names a folder.
    """

    action: str
    code: str | None = None
    rule: str | None = None
    field: str | None = None
    actual_value: str | None = None
    set_field: str | None = None
    value: str | None = None
    destination: str | None = None
    folder: bool = False


def plan(found: DataFrame, repairs: list[Repair], documents: DataFrame, threshold: float = 0.7, only_high: bool = False) -> tuple[DataFrame, DataFrame]:
    """(changes, skipped) for findings (see validate.findings) and documents(path, stem, hash, metadata).

    A finding takes the first repair that matches it; a broken link without one gets the likeliest stem, if one stands
    out (confidence high or medium; `only_high` leaves medium ones out of both). Types of references are never repaired.
    changes(change_id, path, code, rule, operation, field, old_value, new_value, destination, confidence, document_hash),
    skipped(path, code, rule, field, actual_value, skip_reason, detail, next_action). Findings that repeat count each.
    """
    spark = found.sparkSession
    keys = ["code", "rule", "field", "actual_value"]
    schema = "rule_idx int, action string, code string, rule string, field string, actual_value string"
    rules = spark.createDataFrame([(k, str(k), r.code, r.rule, r.field, r.actual_value) for k, r in enumerate(repairs)], schema)
    chosen = first_rule(found, rules, keys).drop("action")
    chosen = chosen.withColumn("rule_idx", F.when(F.col("code") != "frontmatter-reference-type", F.col("rule_idx")))
    docs = documents.select("path", F.col("hash").alias("document_hash"), "metadata")
    chosen = chosen.join(docs, "path", "left")
    operation = new_field = value = target = problem = F.lit(None).cast("string")
    for k, r in enumerate(repairs):
        here = F.col("rule_idx") == k
        operation, new_field = F.when(here, r.action).otherwise(operation), F.when(here, r.set_field or F.col("field")).otherwise(new_field)
        value = F.when(here, F.lit(r.value).cast("string")).otherwise(value)
        if r.destination is not None:
            made, why = templates.destination(r.destination, F.col("path"), F.col("metadata"), folder=r.folder)
            target, problem = F.when(here, made).otherwise(target), F.when(here, why).otherwise(problem)
    broken = (F.col("code") == "link-target-missing") & F.col("rule_idx").isNull()
    chosen = chosen.withColumns({"operation": operation, "new_field": new_field, "new_value": value, "destination": target, "detail": problem})
    likely = closest(chosen.where(broken).select(F.col("actual_value").alias("target")), documents.select("stem"), threshold)
    likely = likely.select(F.col("target").alias("_target"), "outcome", F.col("stem").alias("_stem"))
    chosen = chosen.withColumn("_target", F.when(broken, F.col("actual_value"))).join(likely, "_target", "left")
    is_match = F.coalesce(F.col("outcome").isin("high", "medium"), F.lit(False))
    chosen = chosen.withColumns({
        "operation": F.when(is_match, "rewrite_link").otherwise(F.col("operation")), "new_value": F.when(is_match, F.col("_stem")).otherwise(F.col("new_value")),
        "confidence": F.when(is_match, F.col("outcome")),
        "old_value": F.when(F.col("operation").isin("add_frontmatter", "move_document"), None).otherwise(F.col("actual_value")),
    })
    default = reduce(lambda w, p: w.when(F.col("code") == p[0], p[1]), SKIPS.items(), F).otherwise("graph-diagnostic")
    reason = F.when(F.col("operation").isNull() & (F.coalesce("outcome", F.lit("")) == "ambiguous"), "ambiguous-target").when(F.col("operation").isNull(), default)
    reason = F.coalesce(reason, F.when(F.col("document_hash").isNull(), "missing-hash"), F.when(F.col("detail").isNotNull(), "precondition-failed"))
    chosen = chosen.withColumn("skip_reason", reason)
    if only_high:
        chosen = chosen.where("confidence IS NULL OR confidence = 'high'")
    done = with_change_ids(chosen.where("skip_reason IS NULL").select("path", "code", "rule", "operation", F.when(F.col("operation").endswith("frontmatter"), F.col("new_field")).alias("field"), "old_value", "new_value", "destination", "confidence", "document_hash"))
    why = reduce(lambda w, p: w.when(F.col("skip_reason") == p[0], p[1]), NEXT.items(), F)
    skipped = chosen.where("skip_reason IS NOT NULL").select("path", "code", "rule", "field", "actual_value", "skip_reason", "detail", why.alias("next_action"))
    return done.drop("occurrence"), skipped


def skip_summary(skipped: DataFrame) -> DataFrame:
    return skipped.groupBy("skip_reason").agg(F.count("*").alias("n"))


def set_differences(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, side): what only one of two sets has; empty when a precondition holds."""
    extra = actual.exceptAll(expected).withColumn("side", F.lit("unexpected"))
    return extra.unionByName(expected.exceptAll(actual).withColumn("side", F.lit("absent")))


#: Rows of either side of a stem that meet in one task at a time.
SIDE = 3000


def stem_collisions(documents: DataFrame, moves: DataFrame, side: int = SIDE) -> DataFrame:
    """moves(path, new_path) whose new stem another document has already.

    A stem that many moves and many documents share gives a row for each pair. Its rows are dealt out by parts of `side`
    rows, each part of the moves to each of the documents, over as many tasks as there are pairs for: counts by stem,
    summed first, tell how many.
    """
    new = moves.select("path", "new_path", F.lower(V.path_parts(F.col("new_path"))[1]).alias("_stem"))
    have = documents.select(F.lower("stem").alias("_stem"), F.col("path").alias("other"))
    n = new.groupBy("_stem").agg(F.count("*").alias("_new")).join(have.groupBy("_stem").agg(F.count("*").alias("_have")), "_stem")
    pairs = n.agg(F.sum(F.col("_new").cast("double") * F.col("_have"))).first()[0] or 0
    keys = ["_stem"]
    if pairs > side * side:
        parts = lambda c: F.ceil(F.col(c) / side).cast("int")
        cut = n.select("_stem", parts("_new").alias("_m"), parts("_have").alias("_n")).where("_m > 1 OR _n > 1")
        part = lambda c, k: F.pmod(F.xxhash64(c), F.coalesce(k, F.lit(1))).cast("int")
        each = lambda k: F.explode(F.sequence(F.lit(0), F.coalesce(k, F.lit(1)) - 1))
        keys, tasks = ["_stem", "_i", "_j"], int(pairs // (side * side)) + 1
        new = new.join(cut, "_stem", "left").select("path", "new_path", "_stem", part("path", "_m").alias("_i"), each("_n").alias("_j")).repartition(tasks, *keys)
        have = have.join(cut, "_stem", "left").select("other", "_stem", each("_m").alias("_i"), part("other", "_n").alias("_j")).repartition(tasks, *keys)
    return new.join(have, keys).where(F.col("other") != F.col("path")).select("path", "new_path", "other")


def folder_moves(documents: DataFrame, folder: str, into: str) -> DataFrame:
    """One move for every document under a folder."""
    inside = documents.where(F.col("path").startswith(folder.rstrip("/") + "/"))
    return inside.select("path", F.concat(F.lit(into.rstrip("/") + "/"), F.substring("path", len(folder.rstrip("/")) + 2, 1 << 20)).alias("new_path"))
