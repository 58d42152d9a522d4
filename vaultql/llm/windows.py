"""Exact removal of repeated windows of words by super-k-mer partitioning."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, column_bytes, slices, with_columns, written
from .substrings import _leftmost_least, _mixed, _powers, _tables

_M = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.isin(np.arange(256), list(BLANKS.encode()))
_NEXT_BLANK = re.compile(b"[" + BLANKS.encode() + b"]")
#: Bytes whose words are found at a time.
BLOCK = 1 << 20
#: Rows that a task combines at a time.
CHUNK = 1 << 20
#: A bucket with more different strings has its windows dealt out one by one.
HOT_STRINGS = 500


def gram_size(length: int) -> int:
    """Words of a minimiser. A super-k-mer has length - gram_size + 1 windows at most, which fit a mask of 64 bits."""
    return max(1, length // 4, length - 61)


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Where the words of a text begin and end, and two independent 64-bit hashes of each."""
    begins, ends, hashes = [], [], ([], [])
    at = 0
    while at < len(raw):
        cut = _NEXT_BLANK.search(raw, at + BLOCK) if len(raw) - at > BLOCK else None
        upto = cut.start() if cut else len(raw)
        byte = np.frombuffer(raw, np.uint8, upto - at, at)
        edge = np.flatnonzero(np.diff(np.r_[True, _BLANK[byte], True].astype(np.int8)))
        begin, end = edge[0::2], edge[1::2]
        up, down = _powers(len(byte) + 1)
        for k, table in enumerate((_tables()[0], _tables()[2])):
            total = np.zeros(len(byte) + 1, np.uint64)
            np.cumsum(table[byte] * up[:-1], out=total[1:])
            hashes[k].append(_mixed((total[end] - total[begin]) * down[begin] + _M * (end - begin).astype(np.uint64)))
        begins.append(begin + at)
        ends.append(end + at)
        at = upto
    joined = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    return joined(begins, np.int64), joined(ends, np.int64), [joined(h, np.uint64) for h in hashes]


class SuperKmers:
    """A text's windows of `length` words, cut where the minimiser changes.

    The minimiser of a window is its run of `gram_size` words with the least hash, the leftmost of equal ones. Super-k-mer
    i has the windows that start at words [start[i], stop[i]), all with one minimiser at one place. Equal windows have
    equal minimisers at the same distance from their start, so they have one bucket, and no super-k-mer holds two of them.
    """

    def __init__(self, raw: bytes, length: int):
        self.raw, self.length = raw, length
        self.begin, self.end, words = word_places(raw)
        self.n_words = len(self.begin)
        n = self.n_words - length + 1
        if n <= 0:
            self.start = self.stop = np.empty(0, np.int64)
            self.bucket = np.empty(0, np.int64)
            self.names = (self.bucket, self.bucket)
            return
        up, down = _powers(self.n_words + 1)
        sums = [np.zeros(self.n_words + 1, np.uint64) for _ in words]
        for total, word in zip(sums, words, strict=True):
            np.cumsum(word * up[:-1], out=total[1:])
        gram = gram_size(length)
        order = _mixed((sums[0][gram:] - sums[0][:-gram]) * down[: self.n_words - gram + 1])
        place = _leftmost_least(order, length - gram + 1)
        self.start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        self.stop = np.r_[self.start[1:], n]
        self.bucket = order[place[self.start]].view(np.int64)
        last = self.stop + length - 1
        size = _M * (last - self.start).astype(np.uint64)
        self.names = tuple(_mixed((s[last] - s[self.start]) * down[self.start] + size).view(np.int64) for s in sums)

    def packed(self, i: int) -> bytes:
        """The words of super-k-mer i, joined by a space."""
        words = slice(self.start[i], self.stop[i] + self.length - 1)
        return b" ".join(self.raw[a:b] for a, b in zip(self.begin[words].tolist(), self.end[words].tolist(), strict=True))


def remove_repeated_windows(docs: DataFrame, *, length: int = 35, text: str = "text", keep: list[str] | None = None, hot_strings: int = HOT_STRINGS) -> DataFrame:
    """docs with n_words, n_removed, removed ([first word, word after the last, ...]), kept_text and kept_sha256.

    A word goes if a window of `length` words that covers it also starts anywhere else, the same text included. Windows
    are judged on the input; words are runs of anything but ASCII white space, compared byte by byte.

    1. Each text is cut into super-k-mers. One row for each (text, bucket, name): the bucket is the minimiser's hash, the
       name two independent 64-bit hashes of the super-k-mer's words. Rows are combined within a task and, by name, before
       the shuffle, so copies of a text add to a count only.
    2. A super-k-mer that is there twice has all its windows repeated. One that is there once can share windows only with
       other ones of its bucket: those of such buckets travel to it, each once, as one packed string of words. There the
       strings are cut into windows, and Spark sorts the windows by their bytes; equal ones follow each other. A bucket
       of more than `hot_strings` different strings has its windows dealt out one by one instead.
    3. What is repeated meets the texts again, as a mask of windows for each name.
    Texts are told apart by a hash on their way; two with one hash share their lists of names, which does no harm.
    All sorts are Spark's and spill. What reads them holds one batch and one row more, however many rows a window has.

    Edge cases: a null or empty text has no words; texts with fewer than `length` words are kept, as are their rows if
    there are several. Ids play no part, so rows with one id, or none, count as different texts. Columns named like the
    new ones, `_vq_key` or `_vq_found` give way.
    """
    docs = docs.drop("_vq_key", "_vq_found").withColumn("_vq_key", F.xxhash64(F.col(text)))
    texts = docs.select(F.col("_vq_key").alias("key"), F.col(text).alias("text"))
    found = written(texts.mapInArrow(_super_kmers(length), "key long, bucket long, name long, other long, n int"), "superkmers")

    strings = found.groupBy("bucket", "name", "other").agg(F.sum("n").alias("n"), F.min("key").alias("key"))
    strings = written(strings, "strings")
    buckets = strings.groupBy("bucket").agg(F.count("*").alias("strings"), F.min("n").alias("fewest"))
    buckets = buckets.where("strings > 1 AND fewest = 1").select("bucket", (F.col("strings") > hot_strings).alias("hot"))
    travel = strings.join(buckets, "bucket").groupBy("key").agg(F.collect_list(F.struct("bucket", "name", "other", "n", "hot")).alias("wanted"))
    packed = texts.join(travel, "key").select("text", "wanted", "key").mapInArrow(_packed(length), "dealt long, words binary, at int, name long, other long, n long")
    windows = packed.repartition("dealt").mapInArrow(_windows(length), "words binary, at int, name long, other long, n long").sortWithinPartitions("words", "name", "other")
    shared = windows.mapInArrow(_shared, "name long, other long, mask long").groupBy("name", "other").agg(F.bit_or("mask").alias("mask"))
    masks = strings.where("n > 1").select("name", "other", F.lit(-1).cast("long").alias("mask"))
    masks = written(masks.unionByName(shared), "masks")

    lists = found.join(masks, ["name", "other"]).groupBy(F.col("key").alias("_vq_list")).agg(F.collect_set(F.struct("name", "other", "mask")).alias("_vq_found"))
    joined = docs.join(lists, docs["_vq_key"] == lists["_vq_list"], "left").drop("_vq_list", "_vq_key")
    fields = [("n_words", "long"), ("n_removed", "long"), ("removed", "array<int>"), ("kept_text", "string"), ("kept_sha256", "string")]
    if keep is not None:
        fields = [f for f in fields if f[0] in keep or f[0].startswith("n_") or f[0] == "kept_sha256"]
    kept = [c for c in (docs.columns if keep is None else keep) if c in docs.columns and c != "_vq_key"]
    return with_columns(joined, fields, _cut(length, text, [f[0] for f in fields]), kept)


def _super_kmers(length: int):
    """(key, bucket, name, other, n) for the super-k-mers of texts; n counts equal rows of a chunk."""

    def combined(made):
        key, bucket, name, other = (np.concatenate(c) for c in zip(*made, strict=True))
        order = np.lexsort((key, other, name))
        key, bucket, name, other = key[order], bucket[order], name[order], other[order]
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (name[1:] != name[:-1]) | (other[1:] != other[:-1])])
        n = np.diff(np.r_[new, len(key)]).astype(np.int32)
        for at in range(0, len(new), 50_000):
            pick = new[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key[pick], bucket[pick], name[pick], other[pick], n[at : at + 50_000])], names=["key", "bucket", "name", "other", "n"])

    def run(batches):
        made, rows = [], 0
        for batch in batches:
            for part in slices(batch, 256):
                for key, raw in zip(part.column(0).to_pylist(), column_bytes(part, "text"), strict=True):
                    if not raw:
                        continue
                    s = SuperKmers(raw, length)
                    made.append((np.full(len(s.start), key, np.int64), s.bucket, *s.names))
                    rows += len(s.start)
                    if rows >= CHUNK:
                        yield from combined(made)
                        made, rows = [], 0
        if rows:
            yield from combined(made)

    return run


def _packed(length: int):
    """The packed strings that are wanted, for their buckets: (dealt, words, at, name, other, n).

    Of a hot bucket each window is a row, dealt out by its own bytes; `at` is its place in its super-k-mer.
    """

    def run(batches):
        done = set()  # copies of a text have nothing to add
        for batch in batches:
            for part in slices(batch, 64):
                rows = []
                for raw, wanted, key in zip(column_bytes(part, "text"), part.column(1), part.column(2).to_pylist(), strict=True):
                    if (key, len(raw)) in done:
                        continue
                    if len(done) >= CHUNK:
                        done.clear()
                    done.add((key, len(raw)))
                    s, wanted = SuperKmers(raw, length), wanted.as_py()
                    by_name = {(w["name"], w["other"]): w for w in wanted}
                    pick = np.flatnonzero(np.isin(s.names[0], [w["name"] for w in wanted]))
                    for i, name, other in zip(pick.tolist(), s.names[0][pick].tolist(), s.names[1][pick].tolist(), strict=True):
                        w = by_name.pop((name, other), None)  # once is enough
                        if w and not w["hot"]:
                            rows.append((w["bucket"], s.packed(i), 0, name, other, w["n"]))
                        elif w:
                            words = s.packed(i).split(b" ")
                            for at in range(len(words) - length + 1):
                                window = b" ".join(words[at : at + length])
                                dealt = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True)
                                rows.append((dealt, window, at, name, other, w["n"]))
                    if len(rows) > 20_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names, types = ["dealt", "words", "at", "name", "other", "n"], [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _windows(length: int):
    """Packed strings cut into windows."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1024):
                words, at, source = [], [], []
                for i, (packed, first) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    each = packed.split(b" ")
                    n = len(each) - length + 1
                    words += [b" ".join(each[k : k + length]) for k in range(n)]
                    at += range(first, first + n)
                    source += [i] * n
                rest = [part.column(k).take(pa.array(source, pa.int64())) for k in (3, 4, 5)]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(at, pa.int32()), *rest], names=["words", "at", "name", "other", "n"])

    return run


def _shared(batches):
    """Over windows in the order of their bytes: those that several super-k-mers hold, as bits of their masks, for the
    super-k-mers that are there once; the others are repeated as a whole.
    """
    last = None  # the row before
    for batch in batches:
        if not batch.num_rows:
            continue
        words, at, name, other = batch.column(0).to_pylist(), *(batch.column(k).to_numpy() for k in (1, 2, 3))
        once = batch.column(4).to_numpy() == 1
        if last is not None:
            words, (at, name, other, once) = [last[0], *words], (np.r_[x, c] for x, c in zip(last[1:], (at, name, other, once), strict=True))
        last = words[-1], at[-1], name[-1], other[-1], once[-1]
        same = np.fromiter((a == b for a, b in zip(words, words[1:])), bool, len(words) - 1)  # noqa: B905
        group = np.r_[0, np.cumsum(~same)]
        several = np.zeros(group[-1] + 1, bool)
        differs = same & ((name[1:] != name[:-1]) | (other[1:] != other[:-1]))
        several[group[1:][differs]] = True
        show = several[group] & once
        yield pa.RecordBatch.from_arrays([pa.array(name[show]), pa.array(other[show]), pa.array(np.int64(1) << at[show].astype(np.int64))], names=["name", "other", "mask"])


def _cut(length: int, text: str, names: list[str]):
    def one(raw: bytes, found) -> dict:
        s = SuperKmers(raw, length)
        gone = np.zeros(s.n_words + 1, np.int32)
        if found:
            masks = {(f["name"], f["other"]): f["mask"] for f in found}
            pick = np.flatnonzero(np.isin(s.names[0], [f["name"] for f in found]))
            for i, name, other in zip(pick.tolist(), s.names[0][pick].tolist(), s.names[1][pick].tolist(), strict=True):
                mask, begin, stop = masks.get((name, other), 0), s.start[i], s.stop[i]
                if mask == -1:
                    gone[begin] += 1
                    gone[stop + length - 1] -= 1
                    continue
                for k in range(stop - begin):
                    if mask >> k & 1:
                        gone[begin + k] += 1
                        gone[begin + k + length] -= 1
        hit = np.cumsum(gone[:-1]) > 0
        edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
        kept = b" ".join(raw[a:b] for a, b in zip(s.begin[~hit].tolist(), s.end[~hit].tolist(), strict=True))
        return {"n_words": s.n_words, "n_removed": int(hit.sum()), "removed": edge.tolist(), "kept_text": kept.decode(errors="replace"), "kept_sha256": hashlib.sha256(kept).hexdigest()}

    def task():
        def make(batch):
            found = batch.column(batch.schema.get_field_index("_vq_found")).to_pylist()
            rows = [one(raw or b"", f) for raw, f in zip(column_bytes(batch, text), found, strict=True)]
            return [[r[n] for r in rows] for n in names]

        return make

    return task
