"""Path patterns as regular expressions, translated once on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_regex(glob: str) -> str | None:
    """`*` and `?` stay within a segment, `**` crosses them, `[..]`, `{a,b}` and captures `{{name}}`; None if malformed."""
    glob = glob.removeprefix("/")  # paths have no slash in front
    out, at, depth = [], 0, 0
    while at < len(glob):
        c = glob[at]
        if named := re.match(r"\{\{(\w+)\}\}", glob[at:]):
            out.append("([^/]+)")  # the only capturing groups, in order
            at += len(named[0])
            continue
        if glob.startswith("**/", at) and (at == 0 or glob[at - 1] == "/"):
            out.append("(?:.*/)?")
            at += 3
            continue
        if glob.startswith("**", at):
            out.append(".*")
            at += 2
            continue
        if c == "[":
            end = glob.find("]", at + 2)
            if end < 0:
                return None
            inside = glob[at + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]")
            at = end + 1
            continue
        if c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        else:
            out.append(re.escape(c))
        at += 1
    return None if depth else "^" + "".join(out) + "$"


def captures(path: Column, glob: str) -> dict[str, Column]:
    """What each `{{name}}` of the glob stands for in a path; null where the path doesn't match."""
    regex = path_regex(glob)
    names = re.findall(r"\{\{(\w+)\}\}", glob)
    if regex is None:
        return {n: F.lit(None).cast("string") for n in names}
    return {n: F.when(path.rlike(regex), F.regexp_extract(path, regex, k)) for k, n in enumerate(names, 1)}


def glob_of_target(target: str) -> str:
    """The glob of the paths that a creation template makes: a name that fills a segment is a capture, all else `*`."""
    out, at = "", 0
    for m in re.finditer(r"\{\{(.*?)\}\}", target):
        before = target[at : m.start()]
        name = re.fullmatch(r"(?:var|path)\.(\w+)", m[1].strip())
        whole = (not before or before.endswith("/")) and target[m.end() :][:1] in ("", "/")
        out += before + (f"{{{{{name[1]}}}}}" if name and whole else "*")
        at = m.end()
    if "{{" in target[at:]:
        raise ValueError(f"unclosed placeholder in {target!r}")
    return out + target[at:]


def ignore_regex(glob: str) -> str:
    """The dialect of ignored files: `**` only as a whole segment, `*` within one, nothing else is special."""
    parts = glob.strip("/").split("/")
    out = ""
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:[^/]+/)*"
        else:
            out += "[^/]*".join(map(re.escape, part.split("*"))) + ("" if last else "/")
    return f"^{out}$"
