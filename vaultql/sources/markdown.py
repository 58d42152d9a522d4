"""Markdown trees: files are parsed in Arrow batches into one nested row each, from which the relations follow."""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_right

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import globs
from ..functions import values as V

SCHEMA = (
    "path string, block string, frontmatter_json string, body_text string, hash string, "
    "links array<struct<raw:string,kind:string,target:string,label:string,anchor:string,block_ref:string,area:string,property:string,line:int,column:int,byte_offset:long>>, "
    "headings array<struct<level:int,text:string,line:int,column:int,byte_offset:long>>, block_ids array<string>, diagnostics array<struct<severity:string,code:string,message:string>>"
)
# The forms of wikilinks and block ids, which the format defines.
_ADDRESS = re.compile(r"\(\s*(<[^<>\n]*>|[^\s()]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+[\"'(][^)]*)?\)")
_REFERENCE, _DEFINED = re.compile(r"!?\[([^\[\]]+)\](?:\[([^\[\]]*)\])?(?![(:])"), re.compile(r"^ {0,3}\[([^\[\]]+)\]:\s*(\S+)", re.M)
_BLOCK = re.compile(r"(?:^|\s)\^([A-Za-z0-9_-]+)\s*$")
# Our own.
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")


class _Loader(yaml.SafeLoader):
    """Dates stay text, and only true and false are booleans."""


_Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if not t.endswith((":timestamp", ":bool", ":merge"))] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
_Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))


def loaded(block: str):
    return yaml.load(block, _Loader)


def split_frontmatter(text: str) -> tuple[str | None, str, bool]:
    """(metadata block, body, unclosed). Without a closing line the whole file is body."""
    if not text.startswith(("---\n", "---\r\n")):
        return None, text, False
    lines = text.splitlines(keepends=True)
    for k, line in enumerate(lines[1:], 1):
        if line.rstrip("\r\n") == "---":
            return "".join(lines[1:k]), "".join(lines[k + 1 :]), False
    return None, text, True


def _parts(target: str) -> tuple[str, str | None, str | None]:
    name, mark, rest = target.partition("#")
    if not mark:
        return name, None, None
    return (name, None, rest[1:]) if rest.startswith("^") else (name, rest, None)


def _percent(s: str) -> str:
    def one(m):
        try:
            return bytes.fromhex(m[0].replace("%", "")).decode()
        except UnicodeDecodeError:
            return m[0]

    return _PERCENT.sub(one, s)


def _double_brackets(text: str):
    """(start, end, inner) of `[[inner]]`, or `![[inner]]`, where inner has a character and no `]`: the leftmost one before
    each `]]`. One pass, however many brackets never close.
    """
    begin, done, at = 0, 0, text.find("]")
    while at >= 0:
        if text.startswith("]]", at) and 0 <= (i := text.find("[[", begin, at)) < at - 2:
            start = i - 1 if i > done and text[i - 1] == "!" else i
            yield start, at + 2, text[i + 2 : at]
            begin = done = at = at + 2
        else:
            begin = at = at + 1
        at = text.find("]", at)


def _wikilinks(text: str):
    """(start, end, fields) of the wikilinks and embeds."""
    for start, end, inner in _double_brackets(text):
        target, mark, label = inner.partition("|")
        name, anchor, block = _parts(target.strip())
        yield start, end, ("embed" if text[start] == "!" else "wikilink", name.strip(), label if mark else None, anchor, block)


_BRACKET = re.compile(r"\\.|!?\[|\]", re.S)


def _inline_links(text: str):
    """(start, end, label, address) of the inline links and images, in the order in which they close.

    One pass with a stack of open brackets: a bracket that closes before an address makes a link, and then none of the
    brackets that are still open can become one, as links hold no links; images may. Escaped brackets are text.
    """
    opened: list[list] = []
    done = 0
    for m in _BRACKET.finditer(text):
        if m.start() < done or m[0][0] == "\\":
            continue
        if m[0] != "]":
            opened.append([m.start(), m.end(), m[0][0] == "!", True])
            continue
        if not opened:
            continue
        start, inner, image, may = opened.pop()
        if may and text.startswith("(", m.end()) and text.find(")", m.end()) >= 0 and (a := _ADDRESS.match(text, m.end())):
            yield start, a.end(), text[inner : m.start()], a[1].strip("<>")
            done = a.end()
            if not image:
                for o in opened:
                    o[3] = o[2]


class _Places:
    """Line, byte column (both from 1) and byte offset of places in a text, from an index of its line starts; places of one
    line that are asked for in order cost what lies between them.
    """

    def __init__(self, text: str, line: int = 0, byte: int = 0):
        self.text, self.line, self.starts, self.bytes = text, line, [0], [byte]
        self.at, self.indexed = (0, 0, 0), False

    def _index(self) -> None:
        for piece in re.findall(r"[^\n]*\n|[^\n]+", self.text):
            self.starts.append(self.starts[-1] + len(piece))
            self.bytes.append(self.bytes[-1] + (len(piece) if piece.isascii() else len(piece.encode())))
        self.indexed = True

    def __call__(self, at: int) -> tuple[int, int, int]:
        if not self.indexed:
            self._index()
        k = max(0, bisect_right(self.starts, at, 0, max(1, len(self.starts) - 1)) - 1)
        last, place, column = self.at
        if last != k or place > at:
            place, column = self.starts[k], 0
        column += len(self.text[place:at].encode())
        self.at = (k, at, column)
        return self.line + k + 1, column + 1, self.bytes[k] + column


def _within(spans: list[tuple[int, int]]):
    """Whether a place is in one of some spans, which are in order and don't overlap."""
    starts = [a for a, _ in spans]
    return lambda at: (k := bisect_right(starts, at) - 1) >= 0 and at < spans[k][1]


def inside(line: str, items: bool = True) -> int:
    """Where a line's own text begins, behind the marks of quotes and, if `items`, of list items."""
    at = 0
    while m := (_MARK if items else _QUOTE).match(line, at):
        at = m.end()
    return at


_SPAN = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
# Marks of containers: quotes, and items of lists with a space behind them.
_QUOTE = re.compile(r" {0,3}> ?")
_MARK = re.compile(r" {0,3}(?:> ?|[-+*] {1,4}(?=\S)|[0-9]{1,9}[.)] {1,4}(?=\S))")


def masked(body: str) -> str:
    """The body with code blanked out, character for character. Code in quotes and list items is code too; a quote that
    ends, ends the code in it.
    """
    if not any(mark in body for mark in ("```", "~~~", "    ", "\t")):
        return _without_spans(body)
    out, fence, quoted, blank_before = [], None, False, True
    for line in body.splitlines(keepends=True):
        ending = len(line) - len(line.rstrip("\r\n"))
        hidden = " " * (len(line) - ending) + line[len(line) - ending :]
        behind_quotes = inside(line, items=False)
        if fence is not None and quoted and not behind_quotes:
            fence = None
        m = _FENCE.match(line[behind_quotes:].lstrip(" ") if fence is not None else line[inside(line) :])
        if fence is not None:
            out.append(hidden)
            if m and m[1].startswith(fence) and not line[behind_quotes:].strip().strip(fence[0]):
                fence = None
        elif m:
            fence, quoted = m[1], behind_quotes > 0
            out.append(hidden)
        elif blank_before and line.startswith(("    ", "\t")) and line.strip():
            out.append(hidden)
            continue  # an indented block goes on
        else:
            out.append(line)
        blank_before = not line.strip()
    return _without_spans("".join(out))


def _without_spans(text: str) -> str:
    return _SPAN.sub(lambda m: re.sub(r"[^\r\n]", " ", m[0]), text) if "`" in text else text


def parse(path: str, raw: bytes) -> dict:
    """A file's metadata, body, links, headings, block ids and diagnostics; one that isn't UTF-8 has but a diagnostic."""
    said: list[tuple[str, str, str]] = []
    try:
        text = raw.decode()
    except UnicodeDecodeError as e:
        empty = {"links": [], "headings": [], "block_ids": []}
        return {"path": path, "block": None, "frontmatter_json": None, "body_text": "", "hash": "", **empty, "diagnostics": [("error", "read-failed", str(e))]}
    block, body, unclosed = split_frontmatter(text)
    if unclosed:
        said.append(("warning", "frontmatter-unclosed", "no closing line"))
    meta = None
    if block is not None:
        try:
            meta = loaded(block)
            shown = None if meta is None else json.dumps(meta, ensure_ascii=False, sort_keys=True)
        except yaml.YAMLError as e:
            said.append(("warning", "frontmatter-parse-failed", str(e).split("\n")[0]))
            meta, shown = None, None
        except (TypeError, ValueError) as e:
            said.append(("warning", "frontmatter-json-conversion-failed", str(e)))
            meta, shown = None, None
    else:
        shown = None
    before = text[: len(text) - len(body)]
    place = _Places(body, before.count("\n"), len(before.encode()))

    links = []
    if isinstance(meta, dict):
        seen, above = len("---\n"), _Places(before)
        for name, value in meta.items():
            for one in value if isinstance(value, list) else [value]:
                if isinstance(one, str):
                    for start, end, found in _wikilinks(one):
                        raw_link = one[start:end]
                        at = text.find(raw_link, seen, len(before))
                        where = (None, None, None)
                        if at >= 0:  # written otherwise, say with escapes, it has no place
                            seen, where = at + len(raw_link), above(at)
                        links.append((raw_link, *found, "frontmatter", str(name), *where))
    clear = masked(body)
    wiki = [(start, end, found) for start, end, found in _wikilinks(clear)]
    placed = [(start, (clear[start:end], *found, "body", None)) for start, end, found in wiki]
    in_wiki = _within([(start, end) for start, end, _ in wiki])
    defined = {m[1].lower(): m[2] for m in _DEFINED.finditer(clear)} if "]:" in clear else {}
    inline = sorted(_inline_links(clear)) if "](" in clear else []
    found = [(start, clear[start:end], label, address) for start, end, label, address in inline]
    outer: list[tuple[int, int]] = []
    for start, end, *_ in inline:  # an image may be within a link
        if not outer or start >= outer[-1][1]:
            outer.append((start, end))
    in_inline = _within(outer)
    found += [(m.start(), m[0], m[1], defined[k]) for m in (_REFERENCE.finditer(clear) if defined else ()) if (k := (m[2] or m[1]).lower()) in defined and not in_inline(m.start()) and not in_wiki(m.start())]
    for at, whole, label, target in found:
        if not target.startswith(("http://", "https://", "mailto:", "#")) and not in_wiki(at):
            name, anchor, ref = _parts(_percent(target))
            placed.append((at, (whole, "embed" if whole.startswith("!") else "markdown", name, label, anchor, ref, "body", None)))
    links += [(*row, *place(at)) for at, row in sorted(placed, key=lambda p: p[0])]
    headings, ids, at, previous, last = [], [], 0, "", ""
    for line, plain in zip(clear.splitlines(keepends=True), body.splitlines(keepends=True), strict=True):
        shown_line = plain if line.strip() else line
        if "#" in shown_line and (m := _HEADING.match(shown_line.rstrip("\r\n")[inside(shown_line) :])) and line.strip():
            headings.append((len(m[1]), re.sub(r"[`*_]", "", m[2] or "").strip(), *place(at)))
        elif line.lstrip(" ").startswith(("=", "-")) and re.fullmatch(r" {0,3}(=+|-+)\s*", line) and previous.strip() and not previous.startswith("#"):
            headings.append((1 if "=" in line else 2, previous.strip(), *place(at - len(last))))
        if "^" in line and (m := _BLOCK.search(line.rstrip("\r\n"))):
            ids.append(m[1])
        previous, last = shown_line.rstrip("\r\n"), plain
        at += len(plain)
    return {"path": path, "block": block, "frontmatter_json": shown, "body_text": body, "hash": hashlib.sha256(raw).hexdigest(), "links": links, "headings": headings, "block_ids": ids, "diagnostics": said}


def read_tree(spark: SparkSession, root: str, ignore: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(files, parsed): all files but hidden and ignored ones, and one parsed row for each Markdown file.

    A file that isn't Markdown is listed without being opened.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = raw.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    prefix = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/") + "/"
    local = F.substring_index(F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?", ""), prefix, -1)
    raw = raw.withColumn("path", F.try_url_decode(F.replace(local, F.lit("+"), F.lit("%2B")))).where(~F.col("path").rlike(r"(^|/)\."))
    for pattern in ignore:
        raw = raw.where(~F.col("path").rlike(globs.ignore_regex(pattern)))
    files = raw.select("path", V.path_parts(F.col("path"))[1].alias("stem"), F.regexp_extract("path", r"\.([^./]*)$", 1).alias("extension"), "length", "modificationTime")

    return files, parse_files(raw.where(F.lower("path").endswith(".md")))


def pieces(batch: pa.RecordBatch, most: int = 1 << 20):
    """A batch in parts of `most` bytes, or of one row that is larger, so that what a task holds in Python objects follows
    neither Spark's batch size nor the number of documents.
    """
    if batch.num_rows > 1 and batch.nbytes > most:
        half = batch.num_rows // 2
        yield from pieces(batch.slice(0, half), most)
        yield from pieces(batch.slice(half), most)
    elif batch.num_rows:
        yield batch


def parse_files(files: DataFrame) -> DataFrame:
    """One parsed row (see SCHEMA) for each of files(path, content)."""
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                made = [parse(p, r) for p, r in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([m[f.name] for m in made], f.type) for f in schema], schema=schema)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def first_headings(headings: DataFrame) -> DataFrame:
    slugs = headings.withColumn("slug", V.slug(F.col("text")))
    rest = [c for c in slugs.columns if c not in ("doc_path", "slug")]
    return slugs.groupBy("doc_path", "slug").agg(F.min_by(F.struct(*rest), "byte_offset").alias("h")).select("doc_path", "h.*", "slug")


def inventory(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """files with the content hash of the Markdown ones, null for others, which aren't opened."""
    return files.join(parsed.select("path", "hash"), "path", "left")


def relations(parsed: DataFrame) -> dict[str, DataFrame]:
    """documents, links, headings, block_ids and diagnostics of parsed files. Of a document's headings with one slug the
    first counts. The hash is that of the file's bytes, empty for one that couldn't be read.
    """
    named = lambda c, doc: parsed.select(F.col("path").alias(doc), F.explode(c).alias("x")).select(doc, "x.*")
    return {
        "documents": parsed.select("path", V.path_parts(F.col("path"))[1].alias("stem"), "frontmatter_json", F.try_parse_json("frontmatter_json").alias("metadata"), F.col("body_text").alias("body"), "block", "hash"),
        "links": named("links", "source_path"), "headings": first_headings(named("headings", "doc_path")),
        "block_ids": parsed.select(F.col("path").alias("doc_path"), F.explode("block_ids").alias("block_id")).distinct(), "diagnostics": named("diagnostics", "doc_path"),
    }
