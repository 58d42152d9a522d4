"""Documents made from rules, titles and variables; numbers for many of them at once; what a plan takes for granted."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from decimal import Decimal
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import globs, templates
from ..functions import values as V
from ..sources.store import stored
from .mutate import EditRefused, apply_plan, coerced, shown
from .validate import Rule, selected_by_path

SEQ = "{{seq}}"
_MOST = Decimal(18446744073709551615)  # larger numbers in names are no numbers of a sequence


# -- sequences -----------------------------------------------------------------------------------


def misplaced(path: Column) -> Column:
    """Whether a path has the token, but not once and in its file name."""
    n = (F.length(path) - F.length(F.replace(path, F.lit(SEQ), F.lit("")))) / len(SEQ)
    name = F.substring_index(path, "/", -1)
    return (n > 0) & ((n != 1) | ~name.contains(SEQ))


def _scope(path: Column) -> tuple[Column, Column]:
    return F.substring_index(path, SEQ, 1), F.substring_index(path, SEQ, -1)


def numbers(paths: DataFrame, odd: DataFrame | None = None) -> DataFrame:
    """paths with (prefix, suffix, number) for each number in its file name: the runs of digits, whole.

    In the folders of `odd` (folder) every part of a run counts too, as a scope there has digits of its own beside its
    number. A name has few runs, and a run few digits, so rows stay in proportion.
    """
    name = F.substring_index("path", "/", -1)
    digit = lambda i: F.substr(name, i, F.lit(1)).rlike("[0-9]")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda i: digit(i) & ((i == 1) | ~digit(i - 1)))
    runs = paths.select("*", F.explode(starts).alias("_i")).withColumns({"_run": F.regexp_extract(F.substr(name, F.col("_i")), "^[0-9]+", 0), "_folder": F.substr("path", F.lit(1), F.length("path") - F.length(name))})
    before, after = F.concat("_folder", F.substr(name, F.lit(1), F.col("_i") - 1)), F.substr(name, F.col("_i") + F.length("_run"))
    runs = runs.withColumns({"_before": before, "_after": after})
    out = runs.select(*paths.columns, F.col("_before").alias("prefix"), F.col("_after").alias("suffix"), F.col("_run").alias("number"))
    if odd is not None:
        parts = runs.join(odd.withColumnRenamed("folder", "_folder"), "_folder", "left_semi").withColumn("_a", F.explode(F.sequence(F.lit(0), F.length("_run") - 1)))
        parts = parts.withColumn("_b", F.explode(F.sequence(F.col("_a") + 1, F.length("_run")))).where("_b - _a < length(_run)")
        out = out.unionByName(
            parts.select(
                *paths.columns, F.concat("_before", F.substr("_run", F.lit(1), F.col("_a"))).alias("prefix"), F.concat(F.substr("_run", F.col("_b") + 1), "_after").alias("suffix"),
                F.substr("_run", F.col("_a") + 1, F.col("_b") - F.col("_a")).alias("number"),
            )
        )
    number = F.when(F.length(F.ltrim(F.col("number"), F.lit("0"))) <= 20, F.col("number").try_cast("decimal(38,0)"))
    return out.withColumn("number", number).where(F.col("number") <= F.lit(_MOST))


def allocated(creates: DataFrame, documents: DataFrame, order: str = "op_idx") -> DataFrame:
    """creates(path, `order`, ...) with `{{seq}}` in paths replaced, and `seq_refused` for paths where it is misplaced.

    A scope is what stands before and after the token, the folder included. A path gets the number after the largest one
    that its scope has by then: in `documents(path)`, in creations before it with a number of their own, and in those that
    got one; 1 if there is none. So numbers have no gaps but those that are taken.

    With s sequence paths of the scope so far, and e the numbers that others have, the number is s + max(largest taken,
    max over the others so far of (e - their s)): sums and maxima along the order. Rows are dealt out by ranges of (scope,
    order), each range is scanned by itself, and what ranges before it add up to, one row for each range and scope, is
    carried over: a scope of any size has no task of its own.
    """
    path = F.col("path")
    token = F.coalesce(path.contains(SEQ), F.lit(False))
    wrong = F.coalesce(misplaced(path), F.lit(False))
    prefix, suffix = _scope(path)
    asked = creates.where(token & ~wrong).withColumns({"prefix": prefix, "suffix": suffix})
    scopes = asked.select("prefix", "suffix").distinct()
    folder = F.substr("prefix", F.lit(1), F.length("prefix") - F.length(F.substring_index("prefix", "/", -1)))
    odd = scopes.where(F.col("prefix").rlike("[0-9]$") | F.col("suffix").rlike("^[0-9]")).select(folder.alias("folder")).distinct()
    folders = scopes.select(folder.alias("_folder")).distinct()
    own_folder = F.substr("path", F.lit(1), F.length("path") - F.length(F.substring_index("path", "/", -1)))
    there = documents.select("path", own_folder.alias("_folder")).join(folders, "_folder", "left_semi").select("path")
    taken = numbers(there, odd).groupBy("prefix", "suffix").agg(F.max("number").alias("taken"))
    others = numbers(creates.where(~token).select("path", order), odd).select("prefix", "suffix", order, F.col("number").alias("e")).join(scopes, ["prefix", "suffix"], "left_semi")

    events = asked.select("prefix", "suffix", order, F.lit(None).cast("decimal(38,0)").alias("e")).unionByName(others)
    by = ["prefix", "suffix"]
    dealt = stored(events.repartitionByRange(*by, order).sortWithinPartitions(*by, order).withColumn("part", F.spark_partition_id()), "sequence")
    along = Window.partitionBy(*by, "part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumn("s", F.count_if(F.col("e").isNull()).over(along)).withColumn("m", F.max(F.col("e") - F.col("s")).over(along))
    sums = local.groupBy(*by, "part").agg(F.max("s").alias("c"), F.max("m").alias("m"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("c0", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumn("m0", F.max(F.col("m") - F.col("c0")).over(before)).drop("c", "m")
    found = local.where("e IS NULL").join(sums, [*by, "part"]).join(taken, by, "left")
    largest = F.greatest(F.coalesce("taken", F.lit(0)), F.coalesce("m0", F.lit(0)), F.coalesce(F.col("m") - F.col("c0"), F.lit(0)))
    found = found.select(*by, F.col(order).alias("_order"), (F.col("c0") + F.col("s") + largest).cast("decimal(38,0)").alias("_number"))

    named = creates.withColumns({"_prefix": F.when(token & ~wrong, prefix), "_suffix": F.when(token & ~wrong, suffix)})
    out = named.join(found, (named["_prefix"] == found["prefix"]) & (named["_suffix"] == found["suffix"]) & (named[order] == found["_order"]), "left")
    out = out.withColumns({"path": F.when(F.col("_number").isNotNull(), F.concat("_prefix", F.col("_number").cast("string"), "_suffix")).otherwise(path), "seq_refused": F.when(wrong, "seq-misplaced")})
    return out.select(*creates.columns, "seq_refused")


# -- creation ------------------------------------------------------------------------------------


def _names_in(template: str) -> list[str]:
    inner = [x.split("|")[0].strip() for x in re.findall(r"\{\{(.*?)\}\}", template.replace("{{{{", "").replace("}}}}", ""))]
    return list(dict.fromkeys(inner))


def target_paths(requests: DataFrame, rules: Iterable[Rule], *, now: Column, date_format: str = "YYYY-MM-DD", time_format: str = "HH:mm") -> DataFrame:
    """requests(rule, title, vars) with the path that the rule's target gives, `{{seq}}` left in it, and `refused`:
    rule-unknown, title-missing, var-missing (the first that lacks) or seq-misplaced.
    """
    path, why = F.lit(None).cast("string"), F.lit("rule-unknown")
    for r in rules:
        if r.target is None:
            continue
        here, names = F.col("rule") == r.name, _names_in(r.target)
        variables = {n.split(".", 1)[1]: F.try_element_at("vars", F.lit(n.split(".", 1)[1])) for n in names if n.startswith(("var.", "path."))}
        shielded = r.target.replace(SEQ, "\0seq\0")
        made = templates.rendered(shielded, title=F.col("title"), now=now, names=variables, date_format=date_format, time_format=time_format)
        lacks = [F.when(F.col("title").isNull(), "title-missing")] if "title" in names else []
        lacks += [F.when(c.isNull(), f"var-missing: {n}") for n, c in variables.items()]
        path = F.when(here, F.replace(made, F.lit("\0seq\0"), F.lit(SEQ))).otherwise(path)
        why = F.when(here, F.coalesce(*lacks, F.lit(None).cast("string"))).otherwise(why)
    out = requests.withColumns({"path": path, "refused": F.coalesce(why, F.when(F.col("rule").isNull(), "rule-unknown"))})
    return out.withColumn("refused", F.coalesce("refused", F.when(misplaced(F.col("path")), "seq-misplaced")))


def planned(requests: DataFrame, documents: DataFrame, rules: list[Rule], *, now: Column, ignore: Iterable[str] = (), order: str = "op_idx", date_format: str = "YYYY-MM-DD", time_format: str = "HH:mm") -> DataFrame:
    """Documents to be created: requests(`order`, rule, title, vars map, fields map of raw text[, body]) give
    (`order`, path, fields, block, body, refused, warnings); `order` is unique.

    1. The rule's target with title and variables is the path (see target_paths). Ignored paths, and those outside the tree,
       are refused, and take no number.
    2. `{{seq}}` becomes a number (see allocated). Paths that are taken or asked for twice are refused.
    3. Fields are coerced to the type that the first rule selecting the path declares for them; the defaults of all rules
       that match are added until nothing changes (see config.with_defaults). The block has the fields by name.
    4. Warnings: required fields that are missing, and a stem that another document has.
    Rules are matched, templates rendered and numbers found by Column expressions; Python coerces and spells the fields.
    """
    from ..sources.config import with_defaults  # the configuration has the operations of plans, so it is read late

    out = target_paths(requests, rules, now=now, date_format=date_format, time_format=time_format)
    path = F.col("path")
    ignored = F.lit(False)
    for glob in ignore:
        ignored = ignored | path.rlike(globs.ignore_regex(glob))
    why = F.coalesce("refused", F.when(ignored, "path-ignored"), F.when(~V.contained(path), "outside"))
    out = stored(out.withColumn("refused", why), "requests")
    placed = allocated(out.where("refused IS NULL"), documents, order).drop("seq_refused").unionByName(out.where("refused IS NOT NULL"))
    free = placed.where("refused IS NULL")
    there = documents.select(F.col("path").alias("_there")).distinct()
    twice = free.groupBy("path").count().where("count > 1").select(F.col("path").alias("_twice"))
    stems = documents.select(V.ascii_fold(V.path_parts(path)[1]).alias("_stem")).distinct()
    placed = placed.join(there, path == F.col("_there"), "left").join(twice, path == F.col("_twice"), "left")
    placed = placed.withColumn("refused", F.coalesce("refused", F.when(F.col("_there").isNotNull(), "path-exists"), F.when(F.col("_twice").isNotNull(), "path-twice"))).drop("_there", "_twice")
    placed = placed.join(stems, V.ascii_fold(V.path_parts(path)[1]) == F.col("_stem"), "left").withColumn("_clash", F.col("_stem").isNotNull()).drop("_stem")
    placed = placed.withColumn("_rules", F.array_compact(F.array(F.lit(None).cast("int"), *[F.when(F.coalesce(selected_by_path(r, path), F.lit(False)), F.lit(k)) for k, r in enumerate(rules)])))
    placed = placed.mapInArrow(_typed(rules, placed.columns), placed.drop("fields").schema.add("fields", T.MapType(T.StringType(), T.StringType())).add("_why", "string"))
    placed = placed.withColumn("refused", F.coalesce("refused", "_why")).drop("_why")
    full = with_defaults(placed, rules, title=F.col("title"), now=now, extra=F.col("vars"))
    body = F.lit(None).cast("string")
    for r in rules:
        if r.body is not None:
            variables = {n.split(".", 1)[1]: F.try_element_at("vars", F.lit(n.split(".", 1)[1])) for n in _names_in(r.body) if n.startswith(("var.", "path."))}
            body = F.when(F.col("rule") == r.name, templates.rendered(r.body, title=F.col("title"), now=now, names=variables, date_format=date_format, time_format=time_format)).otherwise(body)
    body = F.coalesce(*([F.col("body")] if "body" in requests.columns else []), body, F.lit(""))
    lacking = [F.when(F.array_contains("_rules", k) & ~F.array_contains(F.map_keys("fields"), n), f"required-missing: {n}") for k, r in enumerate(rules) for n in r.required]
    warnings = F.array_distinct(F.array_compact(F.array(F.lit(None).cast("string"), *lacking, F.when(F.col("_clash"), "stem-exists"))))
    full = full.withColumns({"body": body, "warnings": F.when(F.col("refused").isNull(), warnings)})
    kept = [order, "path", "fields", "body", "refused", "warnings"]
    spelled = full.select(*kept).mapInArrow(_spelled(kept), full.select(*kept).schema.add("block", "string"))
    return spelled.select(order, "path", "fields", "block", "body", "refused", "warnings")


def _typed(rules: list[Rule], columns: list[str]):
    """Raw fields as JSON, by the type that the first selecting rule declares."""

    def run(batches):
        for batch in batches:
            fields, why = [], []
            for raw, matched in zip(batch.column(columns.index("fields")).to_pylist(), batch.column(columns.index("_rules")).to_pylist(), strict=True):
                made, problem = [], None
                for name, text in raw or []:
                    rule = next((rules[k] for k in matched if name in rules[k].types), None)
                    try:
                        value = coerced(text, rule and rule.types[name], rule and rule.max_length.get(name))
                    except EditRefused as e:
                        problem = problem or f"field-type-invalid: {name} {e}"
                        continue
                    made.append((name, json.dumps(value, ensure_ascii=False, default=str)))
                fields.append(made)
                why.append(problem)
            rest = [k for k, c in enumerate(columns) if c != "fields"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), pa.array(fields, pa.map_(pa.string(), pa.string())), pa.array(why, pa.string())], names=[*(columns[k] for k in rest), "fields", "_why"])

    return run


def _spelled(columns: list[str]):
    """Fields as a metadata block, by name."""

    def block(fields) -> str:
        lines = [(k, shown(json.loads(v))) for k, v in sorted(fields or [])]
        return "".join(f"{k}:{'' if v.startswith(chr(10)) else ' '}{v}\n" for k, v in lines)

    def run(batches):
        for batch in batches:
            made = [block(f) for f in batch.column(columns.index("fields")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*columns, "block"])

    return run


# -- preconditions -------------------------------------------------------------------------------


def owner_sets(documents: DataFrame, preconditions: list[dict], creates: DataFrame | None = None, metadata: str = "metadata") -> DataFrame:
    """(id, path, side): the differences between the documents that own something and those that a plan expects to.

    A precondition has an `id`, `expected_paths` and one selector: `stem` (in any case of ASCII letters), `eq` (a list of
    field:value, all of which hold) or `stem_from_operation` (the stem of the document that creates(op_id, path) has for
    that operation). side: `missing` for a path that is expected and no owner, `unexpected` for an owner that isn't
    expected, `claimed` for other creations that would own the same stem. An id without rows holds.

    Selectors are the plan's, few; one pass over the documents tests all of `eq`, and stems meet by an equi-join.
    """
    spark = documents.sparkSession
    ids = [p["id"] for p in preconditions]
    if len(set(ids)) < len(ids):
        raise EditRefused("two preconditions have one id")
    for p in preconditions:
        chosen = [k for k in ("stem", "eq", "stem_from_operation") if p.get(k)]
        if len(chosen) != 1:
            raise EditRefused(f"precondition {p['id']}: one selector that isn't empty is expected")
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    expected = frame([(p["id"], e) for p in preconditions for e in set(p["expected_paths"])], "id string, path string")
    stem = lambda c: V.ascii_fold(V.path_parts(c)[1])
    stems = frame([(p["id"], p["stem"].translate(str.maketrans(V._UP, V._LOW))) for p in preconditions if p.get("stem")], "id string, stem string")
    claimed = frame([], "id string, path string")
    wanted = [(p["id"], p["stem_from_operation"]) for p in preconditions if p.get("stem_from_operation")]
    if wanted:
        asked = frame(wanted, "id string, op_id string")
        made = creates.select("op_id", "path", stem(F.col("path")).alias("stem")) if creates is not None else frame([], "op_id string, path string, stem string")
        if lost := [r.id for r in asked.join(made, "op_id", "left_anti").limit(10).collect()]:
            raise EditRefused(f"preconditions {lost} name no creation")
        of_operations = asked.join(made.select("op_id", "stem"), "op_id")
        stems = stems.unionByName(of_operations.select("id", "stem"))
        claimed = of_operations.withColumnRenamed("op_id", "_own").join(made, "stem").where("op_id <> _own").select("id", "path")
    owners = documents.select("path", stem(F.col("path")).alias("stem")).join(F.broadcast(stems), "stem").select("id", "path")
    by_value = [p for p in preconditions if p.get("eq")]
    if by_value:
        tests = []
        for p in by_value:
            test = F.lit(True)
            for pair in p["eq"]:
                name, _, value = pair.partition(":")
                test = test & F.coalesce(F.exists(V.elements(V.field(metadata, name)), partial(_same, V.coerced(value))), F.lit(False))
            tests.append(F.when(test, p["id"]))
        owners = owners.unionByName(documents.select(F.explode(F.array_compact(F.array(*tests))).alias("id"), "path"))
    owners = owners.distinct()
    missing = expected.join(owners, ["id", "path"], "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(owners.join(expected, ["id", "path"], "left_anti").withColumn("side", F.lit("unexpected"))).unionByName(claimed.withColumn("side", F.lit("claimed")))


def _same(value, e: Column) -> Column:
    return V.same(e, value)


def verdicts(differences: DataFrame, preconditions: list[dict]) -> DataFrame:
    """(id, status, error, n_missing, n_unexpected): passed, or failed with owner-set-mismatch or owner-claim-conflict."""
    ids = differences.sparkSession.createDataFrame([(p["id"],) for p in preconditions], "id string")
    counted = differences.groupBy("id").agg(*[F.count_if(F.col("side") == s).alias(f"n_{s}") for s in ("missing", "unexpected", "claimed")])
    out = ids.join(counted, "id", "left").na.fill(0)
    error = F.when(F.col("n_claimed") > 0, "owner-claim-conflict").when(F.col("n_missing") + F.col("n_unexpected") > 0, "owner-set-mismatch")
    return out.select("id", F.when(error.isNull(), "passed").otherwise("failed").alias("status"), error.alias("error"), "n_missing", "n_unexpected")


def applied(documents: DataFrame, links: DataFrame, changes: DataFrame, preconditions: list[dict] | None = None, *, metadata: str = "metadata", types: dict[str, str] | None = None, allow_broken: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(documents, refused, verdicts) after a whole plan: see mutate.apply_plan for changes(op_idx, path, operation, ...).

    Paths of creations get their numbers first (see allocated). Then the preconditions are tested on the documents as
    they are (see owner_sets; an operation's name is its `op_id`, or op_idx as text): one that fails refuses the plan as
    a whole, and no change is made. So does a path whose `{{seq}}` is misplaced.
    """
    if not changes.where(F.col("path").contains(SEQ)).isEmpty():
        is_new = F.col("operation") == "create_document"
        numbered = stored(allocated(changes.where(is_new), documents), "numbered")
        if not numbered.where("seq_refused IS NOT NULL").isEmpty():
            return documents, changes.select("path", F.lit("seq-misplaced").alias("reason")), None
        changes = changes.where(~is_new).unionByName(numbered.drop("seq_refused"))
    found = None
    if preconditions:
        ids = F.col("op_id") if "op_id" in changes.columns else F.col("op_idx").cast("string")
        creates = changes.where("operation = 'create_document'").select(ids.alias("op_id"), "path")
        found = stored(verdicts(owner_sets(documents, preconditions, creates, metadata), preconditions), "verdicts")
        if not found.where("status = 'failed'").isEmpty():
            return documents, changes.select("path", F.lit("precondition-failed").alias("reason")), found
    return (*apply_plan(documents, links, changes, types, allow_broken), found)
