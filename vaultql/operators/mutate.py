"""Edits of documents on snapshots: a new version is the untouched rows and the rewritten ones."""

from __future__ import annotations

import json
import re

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources.markdown import loaded, masked, pieces
from ..sources.store import stored
from . import repair


class EditRefused(ValueError):
    pass


# -- one document's text ------------------------------------------------------------------------


def _headings(body: str) -> list[tuple[int, int, int, str]]:
    """(start, end, level, text) of the headings; what looks like one inside code isn't."""
    clear = masked(body)
    return [(m.start(), m.end(), len(m[1]), body[m.start(2) : m.end(2)].strip()) for m in re.finditer(r"^ {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$", clear, re.M)]


def _section(body: str, heading: str) -> tuple[int, int, int]:
    """Where a heading's line begins, its content begins, and its section ends (at the next one of its level or above)."""
    marks = _headings(body)
    same = [k for k, m in enumerate(marks) if m[3] == heading]
    if len(same) != 1:
        raise EditRefused("heading-missing" if not same else "heading-ambiguous")
    start, end, level, _ = marks[same[0]]
    after = next((m[0] for m in marks[same[0] + 1 :] if m[2] <= level), len(body))
    return start, min(len(body), end + 1), after


def _block(text: str) -> str:
    """One line end after the last line; nothing stays nothing."""
    text = text.rstrip("\n")
    return text and text + "\n"


def edited(body: str, edits: list[tuple[str, str, str]]) -> str:
    """body after (op, where, text) edits in turn; any refusal leaves all undone."""
    for op, where, text in edits:
        if op in ("str_replace", "replace_all"):
            if not where or where not in body:
                raise EditRefused("match-missing" if where else "empty-match")
            if op == "str_replace" and body.count(where) != 1:
                raise EditRefused("match-ambiguous")
            body = body.replace(where, text)
        elif op == "rewrite_link":
            body = relinked(body, {where: text})
        elif op == "replace_raw":
            body = replaced(body, json.loads(text))
        else:
            start, content, end = _section(body, where)
            if op == "replace_section":
                body = body[:content] + _block(text) + body[end:]
            elif op == "append_to_section":
                lines = body[content:end].splitlines(keepends=True)
                blank = next((k for k, x in enumerate(reversed(lines)) if x.strip()), len(lines))
                at = content + sum(map(len, lines[: len(lines) - blank])) if blank < len(lines) else content
                above = body[:at].rstrip() + "\n" if blank < len(lines) else body[:at]
                body = above + text.strip("\n") + "\n" + body[at:]
            elif op == "delete_section":
                body = body[:start] + body[end:]
            elif op == "insert_before_heading":
                body = body[:start] + _block(text) + body[start:]
            elif op == "insert_after_heading":
                body = body[:content] + _block(text) + body[content:]
            else:
                raise EditRefused("unknown-edit")
    return body


def replaced(body: str, pairs: dict[str, str], code: bool = True) -> str:
    """body with some pieces of text replaced where they aren't code, all in one pass, longer ones first. Without `code`
    no part is taken for code, as in metadata.
    """
    if not pairs or not body:
        return body
    clear, out, at = masked(body) if code else body, [], 0
    for m in re.finditer("|".join(map(re.escape, sorted(pairs, key=lambda p: (-len(p), p)))), clear):
        out += [body[at : m.start()], pairs[m[0]]]
        at = m.end()
    return "".join(out) + body[at:]


def relinked(body: str, names: dict[str, str]) -> str:
    """body with wikilinks and embeds that name one of `names` naming another; label and anchor stay."""
    clear, out, at = masked(body), [], 0
    for m in re.finditer(r"(!?\[\[)([^\]|#]*)([^\]]*\]\])", clear):
        new = names.get(m[2].strip())
        if new is not None:
            out += [body[at : m.start()], m[1], new, m[3]]
            at = m.end()
    return "".join(out) + body[at:]


def shown(value) -> str:
    """A value as YAML on the line of its key, or as a block list below it."""
    if isinstance(value, list):
        return "[]" if not value else "".join(f"\n  - {shown(v)}" for v in value)
    return yaml.safe_dump(value, default_flow_style=True, allow_unicode=True, width=1 << 30).split("\n...")[0].rstrip("\n")


def set_key(block: str, key: str, value: str | None) -> str:
    """A metadata block with one key set, or removed for None; other bytes stay as they are."""
    found = re.search(rf"^{re.escape(key)}[ \t]*:.*(?:\n(?:[ \t]+.*|- .*))*\n?", block, re.M)
    line = "" if value is None else f"{key}:{'' if value.startswith(chr(10)) else ' '}{value}\n"
    if found:
        return block[: found.start()] + line + block[found.end() :]
    return block + ("" if not block or block.endswith("\n") else "\n") + line


def coerced(raw: str, wanted: str | None, max_length: int | None = None):
    """A value as the declared type of its field has it, or a refusal; without a type it is read like YAML."""
    if wanted is None:
        return loaded(raw)
    if wanted in ("string", "list_of_strings") and max_length is not None and len(raw) > max_length:
        raise EditRefused("too-long")
    if wanted in ("string", "text"):
        return raw
    if wanted == "list_of_strings":
        return [raw]
    if wanted in ("wikilink", "wikilink_or_list"):
        link = raw if raw.startswith("[[") and raw.endswith("]]") else f"[[{raw}]]"
        if len(link.encode()) <= 4:
            raise EditRefused("no-wikilink")
        return link
    shapes = {"date": r"\d{4}-\d{2}-\d{2}([T ]00:00.*)?", "datetime": r"\d{4}-\d{2}-\d{2}[T ]" + V.TIME, "time": V.TIME, "number": r"[+-]?\d+(\.\d+)?", "boolean": "true|false"}
    if wanted not in shapes:
        raise EditRefused("unknown-type")
    if not re.fullmatch(shapes[wanted], raw):
        raise EditRefused(f"no-{wanted}")
    return loaded(raw) if wanted in ("number", "boolean") else raw


def with_metadata(block: str, edits: list[tuple[str, str, str]], types: dict[str, str] | None = None, lengths: dict[str, int] | None = None) -> str:
    """A metadata block after (op, field, value) edits: set, remove, push to and pop from a list."""
    for op, name, raw in edits:
        now = loaded(block) or {}
        if not isinstance(now, dict):
            raise EditRefused("no-mapping")
        if op == "remove":
            block = set_key(block, name, None)
            continue
        value = coerced(raw, (types or {}).get(name), (lengths or {}).get(name))
        if op == "set":
            block = set_key(block, name, shown(value))
        elif op in ("push", "pop"):
            old = now.get(name)
            old = [] if old is None else old if isinstance(old, list) else [old]
            one = value[0] if isinstance(value, list) and len(value) == 1 else value
            new = [*old, one] if op == "push" and one not in old else [x for x in old if x != one] if op == "pop" else old
            if new != old:
                block = set_key(block, name, shown(new))
        else:
            raise EditRefused("unknown-edit")
    return block


def whole(block: str | None, body: str) -> str:
    """A file's text from its metadata block and its body."""
    return body if not block else f"---\n{block}{'' if block.endswith(chr(10)) else chr(10)}---\n{body}"


def sections(documents: DataFrame, headings: list[str]) -> DataFrame:
    """(path, heading, text, refused) for each document and heading: the section's text without its heading, as edits see
    it, or heading-missing or heading-ambiguous.
    """

    def run(batches):
        for batch in (part for whole_batch in batches for part in pieces(whole_batch)):
            rows = []
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for h in headings:
                    try:
                        _, start, end = _section(body or "", h)
                        rows.append((path, h, body[start:end], None))
                    except EditRefused as e:
                        rows.append((path, h, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 4, names=["path", "heading", "text", "refused"])

    return documents.select("path", "body").mapInArrow(run, "path string, heading string, text string, refused string")


# -- snapshots -----------------------------------------------------------------------------------

_OUT = pa.schema([("path", pa.string()), ("block", pa.string()), ("body", pa.string()), ("refused", pa.string())])
_METADATA = {"set_frontmatter": "set", "add_frontmatter": "set", "remove_frontmatter": "remove", "push_frontmatter": "push", "pop_frontmatter": "pop"}
#: The order in which one document's edits are made.
_PHASE = {**dict.fromkeys(_METADATA, 0), "rewrite_link": 1, "replace_raw": 1}


#: Rows of a plan, and bytes of text in them, that may be sent to every task; a larger plan meets the documents by a shuffle.
FEW, FEW_BYTES = 20_000, 16 << 20


def few(frame: DataFrame, *texts: str) -> DataFrame:
    """frame for a join with the documents: broadcast if its size, which is counted first, allows that."""
    size = F.coalesce(F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in texts), F.lit(0))), F.lit(0))
    n, held = frame.limit(FEW + 1).agg(F.count("*"), size).first()
    return F.broadcast(frame) if n <= FEW and held <= FEW_BYTES else frame


def apply_edits(documents: DataFrame, edits: DataFrame, types: dict[str, str] | None = None, lengths: dict[str, int] | None = None) -> DataFrame:
    """documents(path, body, hash[, block], ...) with refused, after edits(path, position, op, target, text, expected_hash).

    A document's edits are all made or none: metadata first, then links, then the rest, each in the order of position. A
    document that changed since (another hash) refuses. Only touched rows go through Python; the others stay where they
    are, unless the edits are too many to be sent to every task. Edits of a path that isn't there give a row with
    path-missing. The new hash is that of the whole file. `replace_raw` replaces text in the body and in the metadata block.
    """
    none = F.lit(None).cast("string")
    if "block" not in documents.columns:
        documents = documents.withColumn("block", none)
    order = F.coalesce(*[F.when(F.col("op") == o, k) for o, k in _PHASE.items()], F.lit(2))
    lists = edits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(order.alias("phase"), "position", "op", "target", "text"))).alias("_edits"), F.min("expected_hash").alias("_low"), F.max("expected_hash").alias("_high"))
    lists = few(stored(lists.withColumn("_size", F.length(F.to_json("_edits"))), "edits"), "_edits").drop("_size")
    rest = documents.join(lists.select("path"), "path", "left_anti").withColumn("refused", none)
    touched = documents.join(lists, "path")

    def run(batches):
        for batch in (part for whole_batch in batches for part in pieces(whole_batch)):
            out = []
            for r in batch.to_pylist():
                block, body, why = r["block"], r["body"], None
                if (r["_low"], r["_high"]) not in ((None, None), (r["hash"], r["hash"])):
                    why = "hash-mismatch"
                else:
                    try:
                        meta = [(_METADATA[e["op"]], e["target"], e["text"]) for e in r["_edits"] if e["op"] in _METADATA]
                        new_block = with_metadata(block or "", meta, types, lengths) if meta else block
                        for e in r["_edits"]:
                            if e["op"] == "replace_raw" and new_block:
                                new_block = replaced(new_block, json.loads(e["text"]), code=False)
                        new_body = edited(body or "", [(e["op"], e["target"], e["text"]) for e in r["_edits"] if e["op"] not in _METADATA])
                        block, body = new_block, new_body
                    except EditRefused as e:
                        why = str(e)
                out.append({"path": r["path"], "block": block, "body": body, "refused": why})
            yield pa.RecordBatch.from_pylist(out, schema=_OUT)

    made = touched.select("path", "block", "body", "hash", "_edits", "_low", "_high").mapInArrow(run, "path string, block string, body string, refused string")
    text = F.when(F.coalesce(F.length("block"), F.lit(0)) == 0, F.col("body")).otherwise(F.concat(F.lit("---\n"), F.col("block"), F.when(F.col("block").endswith("\n"), "").otherwise("\n"), F.lit("---\n"), F.col("body")))
    made = made.select("path", "block", "body", F.sha2(text, 256).alias("hash"), "refused")
    others = [c for c in documents.columns if c not in ("block", "body", "hash")]
    if others != ["path"]:
        made = touched.select(*others).join(made, "path")
    lost = lists.select("path").join(documents.select("path"), "path", "left_anti").withColumn("refused", F.lit("path-missing"))
    return rest.unionByName(made).unionByName(lost, allowMissingColumns=True)


def created(documents: DataFrame, new: DataFrame) -> DataFrame:
    """documents(path, stem, ...) and the new ones; a new row whose path is taken, unsafe or asked for twice is refused.

    Columns that `new` lacks are null; `refused` says why a row isn't a document.
    """
    out = documents.withColumn("refused", F.lit(None).cast("string"))
    there = documents.select(F.col("path").alias("_there")).distinct()
    twice = new.groupBy("path").count().where("count > 1").select(F.col("path").alias("_twice"))
    rows = new.join(there, new["path"] == F.col("_there"), "left").join(twice, new["path"] == F.col("_twice"), "left")
    why = F.when(~V.contained(F.col("path")), "outside").when(F.col("_there").isNotNull(), "path-exists").when(F.col("_twice").isNotNull(), "path-twice")
    rows = rows.withColumn("refused", why).drop("_there", "_twice")
    return out.unionByName(rows.withColumn("stem", V.path_parts(F.col("path"))[1]), allowMissingColumns=True)


def _link_edits(impact: DataFrame) -> DataFrame:
    """The edits that give links their new text: one for each document that holds some."""
    new = impact.where("new_raw IS NOT NULL AND new_raw <> raw").groupBy("source_path", "raw").agg(F.min("new_raw").alias("new_raw"))
    pairs = new.groupBy(F.col("source_path").alias("path")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("raw", "new_raw")))).alias("text"))
    return pairs.select("path", F.lit(0).alias("position"), F.lit("replace_raw").alias("op"), F.lit("").alias("target"), "text", F.lit(None).cast("string").alias("expected_hash"))


def _relinked(documents: DataFrame, links: DataFrame, impact: DataFrame) -> DataFrame:
    """documents whose links, in bodies and metadata, have the text that `impact` gives them."""
    if not ({"raw", "kind", "target"} <= set(links.columns) and "body" in documents.columns):
        return documents
    had_block = "block" in documents.columns
    out = apply_edits(documents, _link_edits(impact)).where("refused IS NULL").drop("refused")
    return out if had_block else out.drop("block")


def link_report(impact: DataFrame) -> DataFrame:
    """(path, rewritten, kept, failed): of the links to each moved document, how many get another text, keep theirs, or
    have a form for which there is none.
    """
    changed, same = F.col("new_raw") != F.col("raw"), F.col("new_raw") == F.col("raw")
    return impact.groupBy("path").agg(F.count_if(changed).alias("rewritten"), F.count_if(same).alias("kept"), F.count_if(F.col("new_raw").isNull()).alias("failed"))


def moved(documents: DataFrame, links: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, links) after moves(path, new_path): rows, the edges that end or begin at them, and, where links has
    `raw`, `kind` and `target`, the text of the links in bodies and metadata (see repair.link_impact).
    """
    m = few(stored(moves.select("path", "new_path"), "moves"), "path", "new_path")
    docs = documents.join(m, "path", "left").withColumn("path", F.coalesce("new_path", "path")).drop("new_path")
    if {"raw", "kind", "target"} <= set(links.columns):
        docs = _relinked(docs, links, repair.link_impact(links, m))
    if "stem" in docs.columns:
        docs = docs.withColumn("stem", V.path_parts(F.col("path"))[1])
    ends = links.join(m.withColumnsRenamed({"path": "resolved_path", "new_path": "_new"}), "resolved_path", "left").withColumn("resolved_path", F.coalesce("_new", "resolved_path")).drop("_new")
    starts = ends.join(m.withColumnsRenamed({"path": "source_path", "new_path": "_new"}), "source_path", "left").withColumn("source_path", F.coalesce("_new", "source_path")).drop("_new")
    return docs, starts


def deleted(documents: DataFrame, links: DataFrame, paths: DataFrame, allow_broken: bool = False) -> DataFrame:
    """documents without `paths`(path[, redirect]); rows still linked from elsewhere stay unless `allow_broken`.

    Links to a document that has a `redirect`, the path of another one that stays, are rewritten to lead there, so they
    keep nothing. A redirect to what isn't there, or goes too, counts as none.
    """
    gone = paths.select("path", *(["redirect"] if "redirect" in paths.columns else [])).distinct()
    if "redirect" not in paths.columns:
        gone = gone.withColumn("redirect", F.lit(None).cast("string"))
    gone = gone.groupBy("path").agg(F.min("redirect").alias("redirect"))
    going = gone.select(F.col("path").alias("redirect"))
    stays = documents.select(F.col("path").alias("redirect")).join(going, "redirect", "left_anti").distinct().withColumn("_ok", F.lit(True))
    gone = gone.join(stays, "redirect", "left").select("path", F.when(F.col("_ok"), F.col("redirect")).alias("redirect"))
    gone = stored(gone, "gone")
    outside = links.join(gone.select(F.col("path").alias("source_path")), "source_path", "left_anti")
    if not allow_broken:
        held = outside.select(F.col("resolved_path").alias("path")).distinct()
        gone = gone.where("redirect IS NOT NULL").unionByName(gone.where("redirect IS NULL").join(held, "path", "left_anti"))
    out = documents.join(few(gone, "path").select("path"), "path", "left_anti")
    led = gone.where("redirect IS NOT NULL").select("path", F.col("redirect").alias("new_path"))
    return out if "redirect" not in paths.columns else _relinked(out, links, repair.link_impact(outside, led))


#: Operations of a plan, by the phase that makes them.
OPERATIONS = {**dict.fromkeys((*_METADATA, "rewrite_link", "str_replace", "replace_all", "replace_section", "append_to_section", "delete_section", "insert_before_heading", "insert_after_heading"), "content"), "delete_document": "delete", "create_document": "create", "move_document": "move"}


def apply_plan(documents: DataFrame, links: DataFrame, changes: DataFrame, types: dict[str, str] | None = None, allow_broken: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, refused) after changes(path, operation, field, old_value, new_value, destination, document_hash).

    Phases follow each other: content (see apply_edits), delete, create, move with its links. `field` is the key or the
    heading, `old_value` the text that edits look for, `new_value` what they write, `destination` where a move leads. A
    document whose hash isn't the expected one takes part in no phase. refused(path, reason) tells what wasn't done: a
    deletion of what others link to, a creation or a move to a path that is taken, asked for twice or outside. A deletion
    with a `destination` redirects the links to it there.

    What decides about creations, deletions and moves works on paths and hashes, which are written once. Texts are read
    where they are: those of edited documents, of documents with links to moved or redirected ones, and no others go
    through Python, and no text is shuffled unless a plan is too large to be sent to every task (see FEW).
    """
    unknown = [r[0] for r in changes.where(~F.col("operation").isin(*OPERATIONS)).select("operation").distinct().limit(10).collect()]
    if unknown:
        raise EditRefused(f"unknown operations {unknown}")
    base = documents if "block" in documents.columns else documents.withColumn("block", F.lit(None).cast("string"))
    op = F.col("operation")
    phase = F.coalesce(*[F.when(op == o, p) for o, p in OPERATIONS.items()])
    where = F.when(op.isin(*_METADATA) | op.contains("section") | op.contains("heading"), F.col("field")).otherwise(F.col("old_value"))
    edit = F.struct(F.coalesce(*[F.when(op == o, k) for o, k in _PHASE.items()], F.lit(2)).alias("phase"), F.when(op == "remove_frontmatter", 1).otherwise(0).alias("position"), op.alias("op"), where.alias("target"), F.coalesce("new_value", F.lit("")).alias("text"))
    known = F.col("document_hash").isNotNull()
    per = changes.groupBy("path").agg(
        F.array_sort(F.collect_list(F.when(phase == "content", edit))).alias("_edits"), F.min(F.when(known, F.col("document_hash"))).alias("_low"), F.max(F.when(known, F.col("document_hash"))).alias("_high"),
        F.bool_or(phase == "delete").alias("_delete"), F.max(F.when(phase == "create", F.coalesce("new_value", F.lit("")))).alias("_text"), F.count_if(phase == "create").alias("_creates"),
        F.min(F.when(phase == "delete", F.col("destination"))).alias("_redirect"), F.min(F.when(phase == "move", F.col("destination"))).alias("_to"), F.count_distinct(F.when(phase == "move", F.col("destination"))).alias("_moves"),
    )

    stale = (F.col("_low") != F.col("hash")) | (F.col("_high") != F.col("hash"))
    flags = per.drop("_edits").join(base.select("path", "hash"), "path", "left")
    flags = flags.withColumns({"_there": F.col("hash").isNotNull(), "_stale": F.coalesce(stale, F.lit(False))})
    flags = stored(flags, "flags")  # paths and hashes: all that follows about creations, deletions and moves reads this
    late, flags = flags.where("_stale"), flags.where("NOT _stale")
    gone = flags.where("_there AND _delete").select("path", "_redirect")
    ends = base.select(F.col("path").alias("_redirect")).join(gone.select(F.col("path").alias("_redirect")), "_redirect", "left_anti").withColumn("_ok", F.lit(True))
    led = gone.where("_redirect IS NOT NULL").join(ends, "_redirect").select("path", F.col("_redirect").alias("new_path")).distinct()
    outside = links.join(gone.select(F.col("path").alias("source_path")), "source_path", "left_anti")
    if not allow_broken:
        linked = gone.select("path").join(led, "path", "left_anti").join(outside.select(F.col("resolved_path").alias("path")), "path", "left_semi").select("path", F.lit("linked").alias("_linked"))
        flags = flags.join(linked, "path", "left")
    else:
        flags = flags.withColumn("_linked", F.lit(None).cast("string"))
    goes = F.col("_there") & F.col("_delete") & F.col("_linked").isNull()
    made = F.when(F.col("_creates") > 0, F.when(~V.contained(F.col("path")), "outside").when(F.col("_there") & ~goes, "path-exists").when(F.col("_creates") > 1, "path-twice"))
    flags = flags.withColumns({"_goes": goes, "_no_create": made, "_made": (F.col("_creates") > 0) & made.isNull()})
    taken = base.select(F.col("path").alias("_to")).unionByName(flags.where("_made").select(F.col("path").alias("_to"))).join(flags.where("_goes AND NOT _made").select(F.col("path").alias("_to")), "_to", "left_anti").distinct().withColumn("_taken", F.lit(True))
    again = flags.where("_moves > 0").groupBy("_to").count().where("count > 1").select("_to", F.lit(True).alias("_again"))
    flags = flags.join(taken, "_to", "left").join(again, "_to", "left")
    stays = F.when(F.col("_moves") > 0, F.when(~V.contained(F.col("_to")), "outside").when(~F.col("_there") & ~F.col("_made"), "path-missing").when(F.col("_moves") > 1, "path-twice").when(F.col("_again"), "path-twice").when(F.col("_taken"), "path-exists"))
    flags = stored(flags.withColumn("_no_move", stays), "decided")
    moves = flags.where("_moves > 0 AND _no_move IS NULL AND (_made OR NOT _goes)").select("path", F.col("_to").alias("new_path"))

    edits = per.where(F.size("_edits") > 0).join(late.select("path"), "path", "left_anti").select("path", F.explode("_edits").alias("e"), F.lit(None).cast("string").alias("expected_hash"))
    done = apply_edits(base, edits.select("path", "e.position", "e.op", "e.target", "e.text", "expected_hash"), types)
    undone = done.where("refused IS NOT NULL").select("path", F.col("refused").alias("reason"))
    lost = few(flags.where("_goes").select("path"), "path")
    new = flags.where("_made").select("path", F.col("_text").alias("body"), F.sha2("_text", 256).alias("hash"), V.path_parts(F.col("path"))[1].alias("stem"))
    new = new.select(*[c for c in new.columns if c in base.columns])
    after = done.where("NOT coalesce(refused = 'path-missing', false)").drop("refused").join(lost, "path", "left_anti").unionByName(new, allowMissingColumns=True)
    after = _relinked(after, links, repair.link_impact(outside, led.join(lost, "path", "left_semi"))) if "_redirect" in flags.columns and not led.isEmpty() else after
    reasons = F.array_compact(F.array("_linked", "_no_create", "_no_move", F.when(~F.col("_there") & (F.col("_creates") == 0) & (F.col("_moves") == 0), "path-missing")))
    refused = flags.select("path", F.explode(reasons).alias("reason")).unionByName(undone)
    refused = refused.unionByName(late.select("path", F.lit("hash-mismatch").alias("reason"))).distinct()
    return moved(after, links, moves)[0], refused
