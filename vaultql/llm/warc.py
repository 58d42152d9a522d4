"""WARC derivatives: metadata and plain-text conversion records that refer to their responses."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, column_strings, slices

HEADERS = "warc_type string, record_id string, target_uri string, warc_date string, refers_to string, content_type string, block_digest string, payload_digest string, source_headers map<string,string>, content_length long, block binary"
DERIVED = HEADERS + ", part int"
#: Elements whose content isn't shown, and elements that begin a line.
HIDDEN = {"script", "style", "noscript", "template", "head", "svg", "iframe"}
#: The start tags that a head may hold; any other one ends it, as text does.
IN_HEAD = {"html", "head", "title", "base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template"}
#: Start tags that end an svg left open, beside those that begin a line.
OUT_OF_SVG = {"b", "big", "center", "code", "em", "embed", "i", "img", "menu", "ruby", "s", "small", "span", "strong", "strike", "sub", "sup", "tt", "u", "var"}
BREAKS = {"p", "br", "div", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "main", "aside", "blockquote", "pre", "form", "hr", "dl", "dt", "dd"}
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc:derivatives")


def digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(*parts: str | bytes) -> str:
    """An id that its parts alone decide, so a task that runs again makes the same records."""
    name = "\x1f".join(p if isinstance(p, str) else digest(p) for p in parts)
    return f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title: list[str] = []
        self.links: list[str] = []
        self.hidden: list[str] = []
        self.held: list[str] = []
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)
        self.in_title = tag == "title" or self.in_title and tag not in BREAKS
        if self.hidden:
            if tag not in IN_HEAD:
                self._end_head()
            if self.hidden and self.hidden[-1] == "svg":
                if tag in BREAKS or tag in OUT_OF_SVG:
                    self.hidden.pop()
                elif tag in ("foreignobject", "desc", "title"):
                    self.hidden.append(tag)  # HTML may stand there
        if tag in HIDDEN:
            self.hidden.append(tag)
        elif tag == "body":
            self._leave(0)
        elif tag in BREAKS:
            self._put("\n")

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in self.hidden:
            at = self.hidden.index(tag)
            if tag == "noscript":
                self.held.clear()
                del self.hidden[at:]
            else:
                self._leave(at)
        elif tag in BREAKS:
            self._put("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        else:
            if self.hidden and data.strip():
                self._end_head()
            self._put(data)

    def close(self):
        super().close()
        self._leave(0)

    def _put(self, data):
        if not self.hidden:
            self.out.append(data)
        elif self.hidden[-1] == "noscript":
            self.held.append(data)

    def _end_head(self):
        """Both of a head's tags may be left out: what it can't hold ends it, in an open noscript too."""
        if self.hidden[0] == "head" and all(x in ("head", "noscript") for x in self.hidden):
            self.hidden = [x for x in self.hidden if x != "head"]

    def _leave(self, at):
        """Ends the hidden elements from `at` on; a noscript among them has no end tag, so its text is the page's."""
        if "noscript" in self.hidden[at:]:
            self.out += self.held
            self.held.clear()
        del self.hidden[at:]


def html_text(html: str) -> tuple[str, str, list[str]]:
    """(text, title, link targets) of a page: one line for a block, single spaces, no blank lines.

    A head ends where HTML ends it, with or without tags. An open svg ends at a block; the text of a noscript without an
    end tag is shown. An open script, style, iframe or template hides the rest of the page, as in HTML.
    """
    parser = _Text()
    try:
        parser.feed(html)
        parser.close()
        raw = "".join(parser.out)
    except (AssertionError, ValueError):  # declarations that the parser refuses
        raw = unescape(re.sub(r"<[^>]*>", " ", html))
    lines = (" ".join(x.split()) for x in raw.split("\n"))
    return "\n".join(x for x in lines if x), " ".join("".join(parser.title).split()), parser.links


def http_parts(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers by lower-cased name (repeated ones joined by comma) and body of an HTTP response."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        head, mark, body = block.partition(b"\n\n")
    if not head.startswith(b"HTTP/"):
        return "", {}, block
    first, *rest = head.decode("latin-1").replace("\r\n", "\n").split("\n")
    headers: dict[str, str] = {}
    for line in rest:
        name, colon, value = line.partition(":")
        if colon:
            name, value = name.strip().lower(), value.strip()
            headers[name] = f"{headers[name]}, {value}" if name in headers else value
    return first, headers, body


def unchunked(body: bytes) -> bytes:
    """A body without the sizes of its chunks; as it is if it has none, and as far as it goes if it is cut short."""
    out, at = [], 0
    while m := _CHUNK.match(body, at):
        size = int(m[1], 16)
        out.append(body[m.end() : m.end() + size])
        at = m.end() + size
        if not size or at >= len(body):
            break
        at += 2 if body.startswith(b"\r\n", at) else body.startswith(b"\n", at)
    return b"".join(out) if at else body


_CHUNK = re.compile(rb"([0-9A-Fa-f]{1,8})[ \t]*(?:;[^\r\n]*)?\r?\n")


#: Bytes that a body may have once it is decoded; what is beyond is left out, and the metadata record says so.
MOST_INFLATED = 64 << 20


def _inflated(body: bytes, most: int, window: int, several: bool) -> bytes:
    """A zlib stream, or with `several` all members one after the other, as far as it goes and up to most + 1 bytes."""
    out, size = [], 0
    while body and size <= most:
        stream = zlib.decompressobj(window)
        try:
            while size <= most and not stream.eof and (piece := stream.decompress(body, min(1 << 20, most + 1 - size))):
                out.append(piece)
                size += len(piece)
                body = stream.unconsumed_tail
        except zlib.error:
            if not out:
                raise
            break  # a later member, or the rest of this one, is no stream
        body = stream.unused_data if stream.eof and several else b""
    return b"".join(out)


def _unzstd(body: bytes, most: int) -> bytes:
    """All zstd frames one after the other, as far as they go and up to most + 1 bytes."""
    out, size = [], 0
    reader = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(body), read_across_frames=True)
    try:
        while size <= most and (piece := reader.read1(min(1 << 20, most + 1 - size))):
            out.append(piece)
            size += len(piece)
    except zstandard.ZstdError:
        if not out:
            raise
    return b"".join(out)


def uncoded(body: bytes, codings: str, most: int = MOST_INFLATED) -> tuple[bytes, str, bool]:
    """A body without its content codings, last one first, what is left of those, and whether it was cut at `most` bytes:
    a coding that isn't known or bytes that aren't so coded stop it. Several gzip members or zstd frames are one body.
    Bytes that are cut short are decoded as far as they go.
    """
    left = [c.strip().lower() for c in codings.split(",") if c.strip() and c.strip().lower() != "identity"]
    while left and body:
        try:
            if left[-1] in ("gzip", "x-gzip"):
                body = _inflated(body, most, 47, several=True)
            elif left[-1] == "deflate":
                try:
                    body = _inflated(body, most, 47, several=False)
                except zlib.error:
                    body = _inflated(body, most, -15, several=False)  # without the header, as some servers send it
            elif left[-1] == "zstd":
                body = _unzstd(body, most)
            else:
                break
        except (zlib.error, zstandard.ZstdError):
            break
        left.pop()
        if len(body) > most:
            return body[:most], ", ".join(left), True
    return body, ", ".join(left), False


def responses_from_pages(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z", keep: list[str] | None = None) -> DataFrame:
    """Response records of HTML pages: record_id, target_uri, warc_date and block, beside the columns `keep` of pages.

    The id follows from page id, url and payload. Edge cases: a null page is a response with an empty body, a null url
    an empty target; repeated rows give the same record twice. Columns of the same names give way.
    """
    names = ["record_id", "target_uri", "warc_date", "block"]
    kept = [c for c in (pages.columns if keep is None else keep) if c not in names]
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")).cast("binary")
    name = F.sha2(F.concat_ws("\x1f", F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.coalesce(url, F.lit("")), F.sha2(body, 256)), 256)
    # a name-based uuid: version 5, variant 1
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(name, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    made = F.concat(F.lit("<urn:uuid:"), F.substring(name, 1, 8), F.lit("-"), F.substring(name, 9, 4), F.lit("-5"), F.substring(name, 14, 3), F.lit("-"), variant, F.substring(name, 18, 3), F.lit("-"), F.substring(name, 21, 12), F.lit(">"))
    return pages.select(*kept, made.alias("record_id"), F.coalesce(url, F.lit("")).alias("target_uri"), F.lit(date).alias("warc_date"), F.concat(head, body).alias("block"))


def derive(responses: DataFrame, *, keep: list[str] | None = None, most_inflated: int = MOST_INFLATED) -> DataFrame:
    """Two records for each response (record_id, target_uri, warc_date, block): metadata (part 0) and conversion (1).

    Both carry the response's id in refers_to, its target and date, and its HTTP headers in source_headers. The
    metadata block (application/warc-fields) lists the source's status, headers, digests, title and outlinks; it is
    linked to the conversion by that record's id. The conversion's block is the page's text in UTF-8; its
    payload_digest is the source payload's (without chunk sizes, its content codings kept), its block_digest that of the
    text. Bodies in gzip, deflate or zstd are decoded, all members and frames of them; for others the text is empty and the
    metadata has source-undecoded. A body that is larger than `most_inflated` bytes once decoded is cut there, so that a
    small record can't fill a task's memory, and the metadata has source-truncated.

    Edge cases: a null block is an empty one; a body that isn't text/html or has no type is decoded as it is. Charsets
    that Python doesn't know count as UTF-8, bytes that don't fit become U+FFFD. Null ids and targets stay null.
    Repeated responses give their records again; other columns named in `keep` come along, clashing ones give way.
    """
    names = [x.split()[0] for x in DERIVED.split(", ")]
    asked = [] if keep is None else [c for c in keep if c not in names]
    frame = responses.select(*asked, "record_id", "target_uri", "warc_date", "block")
    schema = ", ".join([f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in asked] + [DERIVED])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 256):
                ids, uris, dates = (column_strings(part, c) for c in ("record_id", "target_uri", "warc_date"))
                made = [r for row in zip(ids, uris, dates, column_bytes(part, "block"), strict=True) for r in derivatives(*row, most_inflated)]
                twice = pa.array([i for i in range(part.num_rows) for _ in (0, 1)], pa.int64())
                old = [part.column(part.schema.get_field_index(c)).take(twice) for c in asked]
                new = [pa.array([r[k] for r in made], t) for k, t in enumerate(_TYPES)]
                yield pa.RecordBatch.from_arrays(old + new, names=asked + names)

    return frame.mapInArrow(run, schema)


_TYPES = [pa.string()] * 8 + [pa.map_(pa.string(), pa.string()), pa.int64(), pa.binary(), pa.int32()]


def derivatives(source: str | None, uri: str | None, date: str | None, block: bytes | None, most: int = MOST_INFLATED) -> list[tuple]:
    status, headers, body = http_parts(block or b"")
    if "chunked" in headers.get("transfer-encoding", "").lower():
        body = unchunked(body)
    plain_body, undecoded, cut = uncoded(body, headers.get("content-encoding", ""), most)
    kind = headers.get("content-type", "")
    charset = re.search(r"charset=\"?([\w.:-]+)", kind, re.I)
    try:
        decoded = plain_body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        decoded = plain_body.decode("utf-8", "replace")
    text, title, links = ("", "", []) if undecoded else html_text(decoded) if "html" in kind.lower() or not kind else (decoded, "", [])
    plain = text.encode()
    payload = digest(body)
    mine = record_id("conversion", source or "", uri or "", plain)
    one_line = lambda s: " ".join(s.split())
    fields = [("source-status", one_line(status)), *((f"source-header-{k}", one_line(v)) for k, v in sorted(headers.items())), ("source-block-digest", digest(block or b"")), ("source-payload-digest", payload), ("conversion-record-id", mine), ("conversion-digest", digest(plain))]
    fields += [("source-truncated", f"decoded body, after {most} bytes")] * cut + [("source-undecoded", undecoded)] * bool(undecoded) + [("title", title)] * bool(title) + [("outlink", one_line(x)) for x in links]
    listed = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    row = lambda kind, name, type_, raw, part: (kind, name, uri, date, source, type_, digest(raw), payload, list(headers.items()), len(raw), raw, part)
    return [row("metadata", record_id("metadata", source or "", uri or "", listed), "application/warc-fields", listed, 0), row("conversion", mine, "text/plain; charset=utf-8", plain, 1)]


def serialized(records: DataFrame) -> DataFrame:
    """records with `warc`: each one's bytes as a WARC/1.1 record, ready to be written one after another."""
    line = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(name + ": "), F.col(c).cast("string"), F.lit("\r\n"))).otherwise("")
    pairs = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Refers-To", "refers_to"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    head = F.concat(F.lit("WARC/1.1\r\n"), *[line(n, c) for n, c in pairs if c in records.columns], F.lit("\r\n")).cast("binary")
    return records.withColumn("warc", F.concat(head, F.coalesce("block", F.lit(b"")), F.lit(b"\r\n\r\n")))


def parsed(stream: bytes | io.BufferedIOBase):
    """(headers by name, block) of each record of a WARC file, one at a time.

    A record whose length isn't a number is passed over up to the next one that begins on a line of its own. A file that is
    cut short, or whose compression breaks off, ends with the last whole record.
    """
    stream = io.BytesIO(stream) if isinstance(stream, bytes) else stream
    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            headers: dict[str, str] = {}
            while (line := stream.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                headers[name.strip().lower()] = value.strip()
            size = headers.get("content-length", "0")
            if not re.fullmatch("[0-9]+", size):
                continue
            block = stream.read(int(size))
            if len(block) < int(size):
                return
            yield headers, block
    except (EOFError, zlib.error, gzip.BadGzipFile):
        return


def read_warc(spark, path: str) -> DataFrame:
    """Response records of the .warc and .warc.gz files under `path`, which may be in any store that Spark reads.

    A task holds one file as it is stored and one record at a time, so files should be of the usual size of a gigabyte or
    less (Spark's binary files end at 2 GB).
    """
    names = ["record_id", "target_uri", "warc_date", "block"]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string()] * 3 + [pa.binary()], strict=True)], names=names)

    def run(batches):
        for batch in batches:
            for name, raw in zip(column_strings(batch, "path"), column_bytes(batch, "content"), strict=True):
                stream = io.BytesIO(raw)
                rows, size = [], 0
                for h, block in parsed(gzip.GzipFile(fileobj=stream) if name.endswith(".gz") else stream):
                    if h.get("warc-type") == "response":
                        rows.append((h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), block))
                        size += len(block)
                        if size > 8 << 20 or len(rows) == 256:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path)
    return files.select("path", "content").mapInArrow(run, "record_id string, target_uri string, warc_date string, block binary")
