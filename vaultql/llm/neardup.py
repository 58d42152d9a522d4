"""MinHash near-duplicates: a multi-index Hamming join over b-bit signatures, confirmed on whole shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank_words, column_bytes, components, discard, slices, written

#: A signature has CHUNKS chunks of WIDTH values of BITS bits. Two signatures that differ in at most 2 * CHUNKS - 1
#: values have, by pigeonhole, a chunk with one error at most.
CHUNKS, WIDTH, BITS = 11, 6, 12
_VALUES = WIDTH * CHUNKS
#: Ids (8 bytes each) that may be broadcast.
MOST_BROADCAST = 1 << 20
_M = np.uint64(0x9E3779B97F4A7C15)
_N = np.uint64(0xD6E8FEB86659FD93)


class _WordHash(dict):
    """64-bit word hashes; starts anew when it holds many words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = made = xxhash.xxh64_intdigest(word)
        return made


def shingle_set(words: list[bytes], size: int, hashes: _WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words; fewer words are one run."""
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(each))
    made = np.full(len(each) - size + 1, size, np.uint64)
    for j in range(size):
        made = (made ^ each[j : j + len(made)]) * _M
        made ^= made >> np.uint64(31)
    return np.unique(made)


def _factors() -> tuple[np.ndarray, np.ndarray]:
    seeds = np.arange(1, 2 * _VALUES + 1, dtype=np.uint64) * _M
    seeds ^= seeds >> np.uint64(30)
    seeds *= _N
    seeds ^= seeds >> np.uint64(27)
    return seeds[:_VALUES, None] | np.uint64(1), seeds[_VALUES:, None]


def signature(found: np.ndarray) -> bytes:
    """BITS bits of each of _VALUES minimum hashes."""
    a, b = _factors()
    least = np.full(_VALUES, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 256):  # stays in the cache
        mixed = found[None, at : at + 256] * a + b
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(1), out=least)
    return (least * _N >> np.uint64(64 - BITS)).astype(np.uint16).tobytes()


def chunk_keys(sigs: np.ndarray) -> np.ndarray:
    """For signatures (n, _VALUES) the _VALUES keys each: a chunk with one of its values left out, and which."""
    chunks = sigs.reshape(len(sigs), CHUNKS, WIDTH).astype(np.uint64)
    keys = np.empty((len(sigs), CHUNKS, WIDTH), np.uint64)
    for gap in range(WIDTH):
        made = np.zeros((len(sigs), CHUNKS), np.uint64)
        for j in range(WIDTH):
            if j != gap:
                made = made << np.uint64(BITS) | chunks[:, :, j]
        made = (made ^ np.arange(gap, _VALUES, WIDTH, dtype=np.uint64) << np.uint64(60)) * _M
        keys[:, :, gap] = made ^ (made >> np.uint64(29)) ^ np.arange(gap, _VALUES, WIDTH, dtype=np.uint64) * _N
    return keys.reshape(len(sigs), -1).view(np.int64)


def near_duplicates(docs: DataFrame, *, percent: int = 80, size: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept) for each row of docs.

    Documents are linked when their sets of `size`-word shingles have at least `percent` % of their union in common.

    1. Documents with equal sets are one class; only one of a class goes on.
    2. Classes meet by the chunk keys of their signatures. Each key's smallest class is its pivot, found by a partial
       aggregation. Every class is compared with the one pivot that it shares most keys with, and components follow.
    3. Classes and pivots that share a key and are in different components yet are compared: one pivot of a class at a
       time while such pairs are many, as each round lets most of them fall into one component.
    4. Members of one key that are in different components after that are all compared with their pivot, and with each
       other only where their parts within the pivot suffice for a link or those outside it share a rare shingle.
    Comparing two of one component couldn't change the components; all other pairs with a key in common are examined,
    on the whole shingle sets of their texts, which are read again for those classes only.

    Signatures that differ in at most 2 * CHUNKS - 1 = 21 of 66 values always share a key; of those further apart most
    do: two sets at a similarity of exactly 0.8 share none with a probability of 7.7e-6.

    Edge cases: a text without words, or null, has an empty set and is linked with nothing. A row without doc_id is
    kept, alone, with a null component. Rows that repeat a doc_id are one document, linked by any of its texts.
    Ids are whole numbers, or text that is one.
    """
    rows = written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_sketches(size), "doc_id long, n_shingles long, digest binary, sig binary"), "sketches")
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = written(full.groupBy("digest").agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("n"), F.min("sig").alias("sig")), "nodes")
    texts = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text"))

    keys = nodes.select("node", "sig").mapInArrow(_keys, "key long, node long, left_out int")
    pivots = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last").select("key", "pivot")
    shared = written(keys.join(pivots, "key"), "shared")
    details = nodes.select("node", "n")
    bound = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)

    of = full.select("doc_id", "digest").join(nodes.select("digest", "node"), "digest")
    repeated = rows.groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = of.join(repeated, "doc_id", "left_semi").selectExpr("doc_id AS a", "node AS b")
    linked = lambda found: found.where(f"100 * n_both >= {int(percent)} * n_any").select("a", "b")

    def split(rows):
        """rows with their component, of keys that have several."""
        member = rows.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
        some = member.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("key")
        return member.join(some, "key", "left_semi")

    best = shared.where("node <> pivot").groupBy(F.col("node").alias("a")).agg(F.min("pivot").alias("b"))
    compared, apart, label, most = _confirmed(best, texts, size), shared, None, 4 * nodes.count()
    while True:
        if label is not None:
            discard(label)
        label = components(linked(compared).unionByName(again))
        old, apart = apart, written(split(apart.drop("component")), "apart")
        discard(old)
        ends = label.select(F.col("node").alias("pivot"), F.col("component").alias("of_pivot"))
        more = apart.where("node <> pivot").join(ends, "pivot", "left").where(F.col("component") != F.coalesce("of_pivot", "pivot"))
        more = more.groupBy(F.col("node").alias("a"), F.col("pivot").alias("b")).agg(F.lit(1)).select("a", "b").join(compared.select("a", "b"), ["a", "b"], "left_anti")
        more = more.join(details.selectExpr("node AS a", "n AS n_a"), "a").join(details.selectExpr("node AS b", "n AS n_b"), "b").where(bound(F.col("n_a"), F.col("n_b")))
        more = written(more.select("a", "b"), "more")
        n = more.count()
        if not n:
            break
        # one pivot a class each round, until few pairs are left
        some = more.groupBy("a").agg(F.min("b").alias("b")) if n > max(most, 100_000) else more
        compared = compared.unionByName(_confirmed(some, texts, size))
        discard(more)

    left = written(split(apart.where("node <> pivot").drop("component")).select("key", "node", "pivot", "component", "left_out"), "left")
    rest = _through_pivots(left, texts, size, percent)
    if not rest.isEmpty():
        label = components(linked(compared).unionByName(again).unionByName(linked(_confirmed(rest, texts, size))))
    discard(apart, left)

    ends = nodes.select("digest", "node").join(label, "node", "left").select("digest", F.col("node").alias("class_id"), F.coalesce("component", "node").alias("component_id"))
    some = full.join(ends, "digest").select("doc_id", "n_shingles", "class_id", "component_id")
    none = rows.where("doc_id IS NULL OR n_shingles = 0").join(label, F.col("doc_id") == F.col("node"), "left")
    none = none.select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.coalesce("component", "doc_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _sketches(size: int):
    def run(batches):
        hashes = _WordHash()
        for batch in batches:
            for part in slices(batch):
                sets = [shingle_set(blank_words(raw), size, hashes) for raw in column_bytes(part, "text")]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                        # an empty set's digest is never used; its id keeps such rows apart in joins
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "digest", "sig"],
                )

    return run


def _keys(batches):
    """The keys of each node, with the value that was left out (null for a chunk's first)."""
    for batch in batches:
        for part in slices(batch, 2000):
            sigs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, _VALUES)
            node = np.repeat(part.column(0).to_numpy(zero_copy_only=False), _VALUES)
            first = np.tile(np.arange(_VALUES) % WIDTH == 0, len(sigs))
            columns = [pa.array(chunk_keys(sigs).ravel()), pa.array(node), pa.array(sigs.ravel().astype(np.int32), mask=first)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "left_out"])


def _through_pivots(left: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): pairs of left's nodes, in different components, that may be linked, judged by their common pivot.

    With a pivot P, two sets have at most the smaller of their parts within P in common, and what their parts outside P
    share. So either the parts within P suffice for a link, which sizes tell, or the parts outside P must share a
    shingle: then only the rarest of those have to meet, as many as leave too few for a link (prefix filter).
    """
    first = _confirmed(left.select("node", "pivot").distinct(), texts, size, outside=True)
    parts = written(first.select(F.col("a").alias("node"), F.col("b").alias("pivot"), "base", "n_both", "n_a", "outside", F.xxhash64("outside").alias("part")), "parts")
    lows = written(parts.groupBy("base").agg(F.min("n_a").alias("low")), "lows")  # few: one a pivot
    own = left.select("node", "component").distinct()
    old, parts = parts, written(parts.join(lows, "base").join(own, "node"), "parts")
    discard(first, old)
    needs = lambda n, other: F.ceil(percent * (n + other) / (100 + percent) - 1e-9)  # noqa: E731  in common, for a link

    within = parts.where(F.col("n_both") >= needs(F.col("n_a"), F.col("low"))).select("node", "pivot", "base", "n_both", "n_a")
    within = written(left.join(within, ["node", "pivot"]).select("key", "base", "node", "component", "left_out", "n_both", "n_a"), "within")
    x, y = within.alias("x"), within.alias("y")
    # chunks that agree in all values share the keys of all their gaps: the first one will do
    once = F.col("x.left_out").isNull() | (F.col("x.left_out") != F.col("y.left_out"))
    apart = F.col("x.component") < F.col("y.component")
    enough = F.least("x.n_both", "y.n_both") >= needs(F.col("x.n_a"), F.col("y.n_a"))
    by_size = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.base") == F.col("y.base")) & apart & once & enough)

    each = parts.select("base", "node", "part", F.explode("outside").alias("shingle"))
    often = written(each.groupBy("base", "shingle").agg(F.count("*").alias("n")).where("n > 1"), "often")
    ranked = each.join(often, ["base", "shingle"]).groupBy("base", "node", "part").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).shingle.alias("ranked"))
    least = F.greatest(F.lit(1), needs(F.col("n_a"), F.col("low")) - F.col("n_both"))
    some = ranked.join(parts.drop("outside"), ["base", "node", "part"]).withColumn("n_shared", F.size("ranked"))
    some = some.withColumn("n_first", F.col("n_shared") - least + 1).where("n_first > 0").withColumn("shingle", F.explode(F.slice("ranked", F.lit(1), F.col("n_first").cast("int"))))
    some = written(some.select("base", "shingle", "node", "component", "n_both", "n_a", "n_shared"), "some")
    x, y = some.alias("x"), some.alias("y")
    enough = F.least("x.n_both", "y.n_both") + F.least("x.n_shared", "y.n_shared") >= needs(F.col("x.n_a"), F.col("y.n_a"))
    by_shingle = x.join(y, (F.col("x.base") == F.col("y.base")) & (F.col("x.shingle") == F.col("y.shingle")) & apart & enough)
    pair = lambda found: found.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    made = written(pair(by_size).unionByName(pair(by_shingle)).distinct(), "rest")
    discard(parts, lows, within, often, some)
    return made


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, outside: bool = False) -> DataFrame:
    """(a, b, n_both, n_any), a written table: what the shingle sets of each pair's texts have in common and together.

    The texts that are needed are found by their ids: up to MOST_BROADCAST of those go to all executors, beyond that
    the texts are shuffled once. With `outside` also n_a, the size of a's set, its shingles that b lacks, and `base`, a hash of b's set.
    """
    pairs = written(pairs.select("a", "b") if not outside else pairs.toDF("a", "b"), "pairs")
    needed = written(pairs.selectExpr("explode(array(a, b)) AS node").distinct(), "needed")
    texts = texts.join(F.broadcast(needed) if needed.count() <= MOST_BROADCAST else needed, "node", "left_semi")
    both = pairs.join(texts.selectExpr("node AS a", "text AS text_a"), "a").join(texts.selectExpr("node AS b", "text AS text_b"), "b")
    fields = [("a", pa.int64()), ("b", pa.int64()), ("n_both", pa.int64()), ("n_any", pa.int64())]
    if outside:
        fields += [("n_a", pa.int64()), ("base", pa.int64()), ("outside", pa.list_(pa.int64()))]

    def run(batches):
        hashes, last, held, base = _WordHash(), None, np.empty(0, np.uint64), 0
        for batch in batches:
            for part in slices(batch):
                rows = []
                for a, b, x, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), column_bytes(part, "text_a"), column_bytes(part, "text_b"), strict=True):
                    if y != last:
                        last, held = y, shingle_set(blank_words(y), size, hashes)
                        base = xxhash.xxh3_64_intdigest(held.tobytes()) >> 1
                    mine = shingle_set(blank_words(x), size, hashes)
                    at = np.minimum(np.searchsorted(held, mine), max(0, len(held) - 1))
                    shared = held[at] == mine if len(held) else np.zeros(len(mine), bool)
                    n = int(shared.sum())
                    rows.append((a, b, n, len(mine) + len(held) - n, *((len(mine), base, mine[~shared].view(np.int64)) if outside else ())))
                columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
                yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, (_, t) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])

    made = both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, n_both long, n_any long" + ", n_a long, base long, outside array<long>" * outside)
    made = written(made, "compared")
    discard(pairs, needed)
    return made
