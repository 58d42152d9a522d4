"""Links between documents: resolution, status, back-links, aliases, lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V

UNIQUE, MANY, NONE = "resolved", "ambiguous", "unresolved"
#: Namesakes that a link lists; more don't change that it is ambiguous.
MOST_CANDIDATES = 100


def status_of(candidates: Column) -> Column:
    n = F.coalesce(F.size(candidates), F.lit(0))
    return F.when(n == 1, UNIQUE).when(n > 1, MANY).otherwise(NONE)


def namesakes(targets: DataFrame, key: str, path: str, named: str, most: int = MOST_CANDIDATES) -> DataFrame:
    """(key, named, n_named): the first `most` paths, in order, of those that share a key, and how many there are in all.

    Each task keeps `most` rows of a key before the shuffle, and so does the one that gets the key: a name that a million
    documents share makes a list of `most`. Their number is counted apart, in full; `candidate_rows` has them all.
    """
    targets = targets.select(key, path).where(F.col(path).isNotNull())
    place = F.row_number().over(Window.partitionBy(key).orderBy(path))
    first = targets.withColumn("_place", place).where(F.col("_place") <= most)
    n = targets.groupBy(key).agg(F.count("*").alias(f"n_{named}"))
    return first.groupBy(key).agg(F.array_sort(F.collect_list(path)).alias(named)).join(n, key)


def candidate_rows(links: DataFrame, documents: DataFrame) -> DataFrame:
    """(target, path, n): a row for each document whose stem each target names, and how many the target has: as rows,
    not lists, so that Spark may split a name that very many share.
    """
    stem = F.lower(F.regexp_replace(F.substring_index("target", "/", -1), r"(?i)\.md$", ""))
    asked = links.select("target").distinct().withColumn("_stem", stem)
    found = documents.select("path", F.lower("stem").alias("_stem")).distinct()
    n = found.groupBy("_stem").agg(F.count("*").alias("n"))
    return asked.join(n, "_stem").join(found, "_stem").select("target", "path", "n")


def resolve_by_key(links: DataFrame, targets: DataFrame, on: str, path: str = "path") -> DataFrame:
    """links with candidates, n_candidates (see namesakes), resolved_path and status, by equality of one key."""
    named = namesakes(targets.select(on, path).distinct(), on, path, "candidates")
    out = links.join(named, on, "left")
    return out.withColumns({"n_candidates": F.coalesce("n_candidates", F.lit(0).cast("long")), "status": status_of(F.col("candidates")), "resolved_path": F.when(F.size("candidates") == 1, F.element_at("candidates", 1))})


def normalized(base: Column, target: Column) -> Column:
    """target relative to the folder `base`, with `.` and `..` taken out; above the root they vanish."""
    parts = F.filter(F.split(F.concat_ws("/", F.when(base != "", base), target), "/"), lambda p: (p != "") & (p != "."))
    up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", up(acc)).otherwise(F.concat(acc, F.array(p)))), "/")


def _keys_of_links() -> tuple[Column, Column, Column]:
    """The folder of a link's document, the paths that the link tries, in order, and the stem that it names."""
    base = V.path_parts(F.col("source_path"))[0]
    rooted, relative = normalized(F.lit(""), F.col("target")), normalized(base, F.col("target"))
    has_ext = F.substring_index("target", "/", -1).contains(".")
    with_md = lambda c: F.when(has_ext, F.array(c)).otherwise(F.array(c, F.concat(c, F.lit(".md"))))
    by_name = F.when(F.col("target").contains("/"), with_md(rooted)).otherwise(F.array().cast("array<string>"))
    tried = F.when(F.col("kind") == "embed", F.concat(with_md(relative), with_md(rooted))).when(F.col("kind") == "wikilink", by_name).otherwise(with_md(relative))
    return base, tried, F.lower(F.regexp_replace(F.substring_index("target", "/", -1), r"(?i)\.md$", ""))


def link_keys(links: DataFrame) -> DataFrame:
    """(source_path, kind, target, key): a row for each key by which a link looks for its target, blind to case."""
    _, tried, stem = _keys_of_links()
    keys = F.concat(F.transform(tried, lambda p: F.concat(F.lit("path:"), F.lower(p))), F.array(F.concat(F.lit("stem:"), stem), F.concat(F.lit("alias:"), F.lower("target"))))
    return links.select("source_path", "kind", "target", F.explode(keys).alias("key")).distinct()


def document_keys(documents: DataFrame) -> Column:
    """The keys by which links find documents(path, stem); aliases are keys too (see aliases_of)."""
    return F.array_compact(F.array(F.concat(F.lit("path:"), F.lower("path")), F.concat(F.lit("stem:"), F.lower("stem"))))


def resolve(links: DataFrame, files: DataFrame, documents: DataFrame, headings: DataFrame, block_ids: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """links(source_path, kind, target, anchor, block_ref, ...) with candidates, n_candidates, resolved_path, status, reason.

    Markdown links try the path from the source's folder, then blind to case, then with .md; embeds also the path from
    the root and then the stem; wikilinks a path with a slash from the root, then stems, then aliases. An empty target
    is the source itself. A document that is found must own the anchor or block id. `candidates` has the first
    MOST_CANDIDATES namesakes, `n_candidates` the number of all.
    """
    base, tried, stem = _keys_of_links()
    is_wiki, is_embed = F.col("kind") == "wikilink", F.col("kind") == "embed"
    keyed = links.withColumns({"_base": base, "_self": F.col("target") == "", "_stem": stem})

    # where a link leads by path depends on its folder, kind and target only: one probe for all links that share them,
    # and nothing that a task that runs again could number otherwise
    asked = keyed.where("NOT _self").select("_base", "kind", "target", tried.alias("_tried")).groupBy("_base", "kind", "target").agg(F.first("_tried").alias("_tried"))
    probes = asked.select("_base", "kind", "target", F.posexplode("_tried").alias("_rank", "_path"))
    key = ["_base", "kind", "target"]
    exact = probes.join(files.select(F.col("path").alias("_path"), F.col("path").alias("found")), "_path").select(*key, (F.col("_rank") * 2).alias("rank"), "found")
    folded = files.groupBy(F.lower("path").alias("_low")).agg(F.max("path").alias("found"))
    loose = probes.withColumn("_low", F.lower("_path")).join(folded, "_low").select(*key, (F.col("_rank") * 2 + 1).alias("rank"), "found")
    by_path = exact.unionByName(loose).groupBy(*key).agg(F.min_by("found", "rank").alias("by_path"))

    stems = namesakes(documents.select(F.lower("stem").alias("_stem"), "path"), "_stem", "path", "by_stem")
    out = keyed.join(by_path, key, "left").join(stems, "_stem", "left")
    if aliases is not None:
        named = namesakes(aliases.select(F.col("alias").alias("_alias"), "doc_path").distinct(), "_alias", "doc_path", "by_alias")
        out = out.join(named, F.lower("target") == F.col("_alias"), "left")
    else:
        out = out.withColumns({"by_alias": F.lit(None).cast("array<string>"), "n_by_alias": F.lit(None).cast("long")})
    names = F.when(is_wiki | is_embed, F.coalesce("by_stem", "by_alias"))
    found = F.when(F.col("_self"), F.array("source_path")).when(F.col("by_path").isNotNull(), F.array("by_path")).otherwise(names)
    of_names = F.when(is_wiki | is_embed, F.when(F.col("by_stem").isNotNull(), F.col("n_by_stem")).otherwise(F.col("n_by_alias")))
    n = F.when(F.col("_self") | F.col("by_path").isNotNull(), F.lit(1).cast("long")).otherwise(of_names)
    out = out.withColumns({"candidates": F.coalesce(found, F.array().cast("array<string>")), "n_candidates": F.coalesce(n, F.lit(0).cast("long"))})
    out = out.withColumn("resolved_path", F.when(F.size("candidates") == 1, F.element_at("candidates", 1)))

    owned = headings.select(F.col("doc_path").alias("_h"), F.col("slug").alias("_slug")).distinct()
    blocks = block_ids.select(F.col("doc_path").alias("_b"), F.col("block_id").alias("_block")).distinct()
    docs = documents.select(F.col("path").alias("_d"))
    out = out.join(owned, (F.col("resolved_path") == F.col("_h")) & (V.slug(F.col("anchor")) == F.col("_slug")), "left")
    out = out.join(blocks, (F.col("resolved_path") == F.col("_b")) & (F.col("block_ref") == F.col("_block")), "left").join(docs, F.col("resolved_path") == F.col("_d"), "left")
    is_doc = F.col("_d").isNotNull()
    reason = (
        F.when(F.size("candidates") == 0, "target-missing").when(F.size("candidates") > 1, None)
        .when(is_doc & F.col("block_ref").isNotNull() & F.col("_b").isNull(), "block-ref-missing")
        .when(is_doc & F.col("anchor").isNotNull() & F.col("block_ref").isNull() & F.col("_h").isNull(), "anchor-missing")
    )
    status = F.when(F.size("candidates") > 1, MANY).when(reason.isNotNull(), NONE).otherwise(UNIQUE)
    return out.select(*links.columns, "candidates", "n_candidates", "resolved_path", status.alias("status"), reason.alias("reason"))


def incoming(links: DataFrame) -> DataFrame:
    """(path, n_incoming, n_sources) for every path that something links to."""
    return links.where("resolved_path IS NOT NULL").groupBy(F.col("resolved_path").alias("path")).agg(F.count("*").alias("n_incoming"), F.count_distinct("source_path").alias("n_sources"))


def deep(documents: DataFrame, links: DataFrame, headings: DataFrame | None = None) -> DataFrame:
    """documents with their outgoing links, those of them without a target, back-links and, if asked for, headings, as
    lists: outgoing ones by their place in the document, back-links by document and place.
    """
    at = F.col("byte_offset") if "byte_offset" in links.columns else F.lit(None).cast("long")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), *c))), lambda x: F.struct(*[x[n].alias(n) for n in c]))
    out_links = links.groupBy(F.col("source_path").alias("path")).agg(listed(["target", "resolved_path", "status"]).alias("outgoing"))
    out_links = out_links.withColumn("unresolved", F.filter("outgoing", lambda x: x["status"] == NONE))
    back = links.where("resolved_path IS NOT NULL").groupBy(F.col("resolved_path").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("source_path"), at.alias("at")))), lambda x: x["source_path"]).alias("incoming"))
    out = documents.join(out_links, "path", "left").join(back, "path", "left")
    if headings is not None:
        listed_headings = headings.groupBy(F.col("doc_path").alias("path")).agg(F.array_sort(F.collect_list(F.struct("line", "level", "text"))).alias("headings"))
        out = out.join(listed_headings, "path", "left")
    return out


def _alias_entries(documents: DataFrame, name: str, metadata: str) -> DataFrame:
    return documents.select(F.col("path").alias("doc_path"), F.explode(V.elements(V.field(metadata, name))).alias("v")).withColumn("kind", V.kind(F.col("v")))


def malformed_aliases(documents: DataFrame, name: str = "aliases", metadata: str = "metadata") -> DataFrame:
    """(doc_path, value): alias entries that are lists or objects, as JSON."""
    return _alias_entries(documents, name, metadata).where("kind IN ('array', 'object')").select("doc_path", V.text(F.col("v")).alias("value"))


def aliases_of(documents: DataFrame, name: str = "aliases", metadata: str = "metadata") -> DataFrame:
    """(doc_path, alias): strings, numbers and booleans in lower case; nulls and nested values aren't aliases."""
    found = _alias_entries(documents, name, metadata).where("kind IN ('string', 'number', 'boolean')")
    return found.select("doc_path", F.lower(V.text(F.col("v"))).alias("alias"))


def lookup(documents: DataFrame, aliases: DataFrame, target: str) -> DataFrame:
    """Documents that a name stands for: an exact path, else stems blind to ASCII case, else aliases."""
    name = target.strip().removeprefix("[[").removesuffix("]]").split("|")[0].split("#")[0].split("^")[0]
    folded = name.translate(str.maketrans(V._UP, V._LOW))
    named = aliases.where(F.col("alias") == name.lower()).select(F.col("doc_path").alias("path"), F.lit(3).alias("way"))
    ways = documents.where(F.col("path") == name).select("path", F.lit(1).alias("way")).unionByName(documents.where(V.ascii_fold(F.col("stem")) == folded).select("path", F.lit(2).alias("way"))).unionByName(named)
    best = ways.agg(F.min("way").alias("way"))
    return ways.join(F.broadcast(best), "way").select("path").distinct()  # best is one row
