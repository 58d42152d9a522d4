"""Prefix trie of conversations, with sums over subtrees by heavy-path decomposition."""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bytes of ids that a row of a node's members holds at most.
PART = 1 << 16


def rebuilt_conversations(conversations: DataFrame, *, family: int = 5, most: int = 9, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns, members): every conversation begins with turns of the first one of its family.

    Conversation c gets the first h turns of conversation c - c % family (all if it has fewer, none if it is absent), then
    its own turns after its first h, where h is the unsigned crc32 of c in decimal digits modulo `most`.
    turns: (conv, depth, role, text), depth from 1; members: (conv), turnless ones too. Turns are in the order of their
    numbers, null first, turns of one number in that of role and text; null roles and texts are empty. Rows without
    conversation are in none.
    """
    known = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text")
    head = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(most))
    placed = written(known.withColumn("place", F.row_number().over(order)).drop("turn").withColumn("h", head("conv")).withColumn("base", F.expr(f"conv - conv % {family}")), "turns")
    members = placed.groupBy("conv").agg(F.first("h").alias("h"), F.first("base").alias("base"), F.least(F.count("*"), F.lit(most - 1)).alias("n"))
    begins = placed.where(F.col("place") < most).select(F.col("conv").alias("base"), F.col("place").alias("depth"), "role", "text")
    first = members.join(begins, "base").where("depth <= h").select("conv", "depth", "role", "text")
    sizes = members.select(F.col("conv").alias("base"), "n")
    own = placed.where("place > h").join(sizes, "base", "left").selectExpr("conv", "CAST(place - h + least(h, coalesce(n, 0)) AS int) AS depth", "role", "text")
    return first.unionByName(own), members.select("conv")


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each distinct sequence of first turns, the empty one too, of turns(conv, depth, role, text).

    conv_id (the smallest member's), depth, parent_conv_id, n_convs, n_children, n_leaves and saved_tokens (bytes of last
    texts that members share, both summed over the subtree) and ends_sha256 (of the ids of the members that end here).

    1. A node is known by its depth and two exclusive ors of 64-bit hashes of (depth, role, text) over its turns, which a
       window gives for each turn; texts go no further. From there on its name is (conv_id, depth).
    2. The heavy child of a node is the one with most members. It has half of them or more than any other child, so at
       most log2(members) light edges lie above a node. A heavy path ends at a leaf, and it lies on the turns of that
       leaf's smallest member, from the last light edge on: no pointer is followed to find it.
    3. Paths are summed from their ends up, as arrays in the order of depth. Level by level, from the paths with most
       light edges above them, each path's sum is attached to the parent of its top node: a logarithm of rounds, each
       of which reads its own level only.
    4. Members that end at a node are packed in order, part by part, and hashed part after part.
    Groups are counted and summed by partial aggregation; a path is no longer than its conversation, and no list of
    members or children is ever held whole.

    Edge cases: without members there is no node, not even the root. Depths of a conversation are 1, 2, ...; turns whose
    conversation isn't among `members` aren't expected. Equal conversations share all nodes.
    """
    two = (F.xxhash64("depth", "role", "text").alias("a"), F.xxhash64(F.lit(29), "depth", "role", "text").alias("b"))
    hashed = turns.select("conv", F.col("depth").cast("int").alias("depth"), *two, F.octet_length("text").cast("long").alias("bytes"))
    along = Window.partitionBy("conv").orderBy("depth")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    rows = hashed.withColumns({"ka": F.bit_xor("a").over(upto), "kb": F.bit_xor("b").over(upto), "last": F.lead("depth").over(along).isNull()})
    rows = written(rows.select("conv", "depth", "ka", "kb", F.col("ka").bitwiseXOR(F.col("a")).alias("pa"), F.col("kb").bitwiseXOR(F.col("b")).alias("pb"), "bytes", "last"), "rows")
    roots = members.join(rows.where("depth = 1").select("conv", F.lit(False).alias("last")), "conv", "left").selectExpr(
        "conv", "0 AS depth", "0L AS ka", "0L AS kb", "CAST(NULL AS long) AS pa", "CAST(NULL AS long) AS pb", "0L AS bytes", "coalesce(last, true) AS last"
    )
    every = rows.unionByName(roots)

    nodes = every.groupBy("ka", "kb", "depth").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), *(F.min(c).alias(c) for c in ("bytes", "pa", "pb")))
    nodes = written(nodes, "nodes")
    above = nodes.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    child = nodes.join(above, ["pa", "pb", "depth"], "left").drop("pa", "pb")
    child = written(child, "children")
    heaviest = F.max(F.struct("n_convs", F.bitwise_not("conv_id").alias("x")))  # of equal ones the smallest id
    kids = child.where("depth > 0").groupBy("parent_conv_id", "depth").agg(F.count("*").alias("n_children"), F.bitwise_not(heaviest["x"]).alias("heavy"))
    kids = written(kids, "kids")
    of_own = kids.select(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"), "n_children")
    of_parent = kids.select("parent_conv_id", "depth", "heavy")
    known = child.join(of_own, ["conv_id", "depth"], "left").join(of_parent, ["parent_conv_id", "depth"], "left")
    known = written(known.withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "heavy": F.col("heavy") == F.col("conv_id")}), "known")

    placed = _paths(rows, known)
    summed = _sums(placed)
    ends = _ends(every.where("last").select("ka", "kb", "depth", "conv"))
    found = summed.join(ends, ["ka", "kb", "depth"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def _paths(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The nodes with the heavy path that each is on: path (its leaf's conv_id), top (its first node's depth) and level
    (light edges above it).
    """
    leaves = known.where("n_children = 0").select(F.col("conv_id").alias("path"))
    chain = rows.select(F.col("conv").alias("path"), "depth", "ka", "kb").join(leaves, "path", "left_semi")
    chain = chain.join(known, ["ka", "kb", "depth"])
    root = known.where("depth = 0").withColumn("heavy", F.lit(True))
    whole = Window.partitionBy("path")
    chain = chain.withColumns({"top": F.coalesce(F.max(F.expr("CASE WHEN NOT heavy THEN depth END")).over(whole), F.lit(0)), "level": F.sum(F.expr("CAST(NOT heavy AS int)")).over(whole)})
    chain = written(chain.where("depth >= top"), "chain")
    with_root = chain.where("top = 0 AND depth = 1").select("path", F.lit(0).alias("depth"))
    on_root = root.join(with_root, "depth", "left").withColumns({"path": F.coalesce("path", "conv_id"), "top": F.lit(0), "level": F.lit(0).cast("long")})
    return written(chain.unionByName(on_root), "paths", by="level")


def _sums(placed: DataFrame) -> DataFrame:
    """n_leaves and saved_tokens of each node's subtree, level by level from the lowest paths."""
    levels = placed.agg(F.max("level")).first()[0]
    down = Window.partitionBy("path").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumns({"leaf": F.expr("CAST(n_children = 0 AS long)"), "saved": F.expr("(n_convs - 1) * bytes")}).drop("heavy", "bytes")
    parts, attached = [], None
    for level in range(-1 if levels is None else levels, -1, -1):
        now = own.where(F.col("level") == level)
        leaf, saved = F.col("leaf"), F.col("saved")
        if attached is not None:
            now = now.join(attached, ["conv_id", "depth"], "left")
            leaf, saved = (c + F.coalesce(more, F.lit(0)) for c, more in ((leaf, "more_leaf"), (saved, "more_saved")))
        now = written(now.withColumns({"n_leaves": F.sum(leaf).over(down), "saved_tokens": F.sum(saved).over(down)}), f"level{level}")
        parts.append(now)
        tops = now.where("depth = top AND depth > 0")
        attached = tops.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.sum("n_leaves").alias("more_leaf"), F.sum("saved_tokens").alias("more_saved"))
    columns: list[Column | str] = ["conv_id", "depth", "ka", "kb", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    if not parts:
        return placed.withColumns({"n_leaves": F.lit(0).cast("long"), "saved_tokens": F.lit(0).cast("long")}).select(*columns)
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])


def _ends(ends: DataFrame) -> DataFrame:
    """The SHA-256 of each node's ids, in order, comma-joined.

    A range of (node, id) is a partition, so a node of very many members has several; each packs its ids into rows of
    PART bytes at most. Only these rows meet by node, in order, and are hashed one after the other.
    """
    key = ["ka", "kb", "depth"]
    packed = ends.repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv").mapInArrow(_pack, "ka long, kb long, depth int, first long, ids binary")
    return packed.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(_digest, "ka long, kb long, depth int, ends_sha256 string")


def _pack(batches):
    now, ids, size, first = None, [], 0, None

    def row():
        return pa.RecordBatch.from_arrays([*(pa.array([x], t) for x, t in zip((*now, first), (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)), pa.array([b",".join(ids)], pa.binary())], names=["ka", "kb", "depth", "first", "ids"])

    made: list[pa.RecordBatch] = []
    for batch in batches:
        for *key, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now or size > PART:
                if now is not None:
                    made.append(row())
                now, ids, size, first = key, [], 0, conv
            ids.append(b"%d" % conv)
            size += len(ids[-1]) + 1
        if len(made) > 500:
            yield _joined(made)
            made = []
    if now is not None:
        made.append(row())
        yield _joined(made)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _digest(batches):
    now, state = None, None
    out: list[tuple] = []

    def flat():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["ka", "kb", "depth", "ends_sha256"])

    for batch in batches:
        for ka, kb, depth, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (ka, kb, depth) == now:
                state.update(b",")
            else:
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = (ka, kb, depth), hashlib.sha256()
            state.update(ids)
        if len(out) > 10_000:
            yield flat()
            out.clear()
    if now is not None:
        out.append((*now, state.hexdigest()))
        yield flat()
