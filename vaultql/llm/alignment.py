"""Alignment of two tokenizers' tokens by byte ranges, with how often their ids meet in the whole corpus."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import column_strings, slices, written

BYTE_LEVEL, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: White space of Unicode, as the byte-level tokenizer's pattern has it.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER, _MARK = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", ".,!?;:|%&*$#\""
#: Characters of texts that are cut at a time, and of new segments that DuckDB aligns at a time.
TEXT, ALIGNED = 2_000_000, 300_000
#: Segments that a task remembers; with more it starts anew.
REMEMBERED = 400_000
#: Pairs of ids, the most frequent ones, that every task gets; 17 bytes each.
HOT_PAIRS = 1 << 18


@dataclass(frozen=True)
class Tokenizers:
    """The files' contents, so that tasks need no path."""

    byte_level: str
    pieces: bytes


def load_tokenizers(spark: SparkSession, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> Tokenizers:
    """From local paths or any folder that Spark reads."""

    def content(path: str) -> bytes:
        if "://" in path:
            return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
        with open(path, "rb") as f:
            return f.read()

    return Tokenizers(content(byte_level).decode(), content(pieces))


def _byte_of() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte: itself if it is visible, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, and the alignment of segments seen before.

    A segment is a part of a text at whose ends both tokenizers cut, whatever stands beside it, so the tokens of a text
    are those of its segments. The byte-level tokenizer's pattern ends a run at white space and, for a letter, before
    one of the marks; the pieces do if none of the vocabulary crosses such a place. If a vocabulary has a piece that
    crosses, or another pattern, whole texts are the segments.
    """

    def __init__(self, files: Tokenizers):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core
        self.a, held = Tokenizer.from_str(files.byte_level), json.loads(files.byte_level)
        self.a.encode_special_tokens = True
        byte = _byte_of()
        vocabulary = held["model"]["vocab"] | {x["content"]: x["id"] for x in held.get("added_tokens", [])}
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.pieces)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        texts = [b.decode(errors="replace") for i, b in enumerate(self.b_bytes) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        regular = held.get("normalizer") is None and (held["pre_tokenizer"] or {}).get("type") == "ByteLevel" and held["pre_tokenizer"].get("use_regex", True)
        alone = [self.b_bytes[i] for i in self.b.encode("\n")] == [b" ", b"\n"]
        self.cut = regular and alone and not any(re.search(f"[^{_WHITE}][ \n]|\n", t) for t in texts)
        marked = not any(re.search(f"[{_LETTER}][{_MARK}]", t) for t in texts)
        word = f"[{_WHITE}]*[{_LETTER}]++(?=[{_MARK}])|" if marked else ""
        self.segments = re.compile(word + f"[{_WHITE}]*[^{_WHITE}]+(?:(?![ \n])[{_WHITE}]+[^{_WHITE}]*)*|[{_WHITE}]+" if self.cut else r"(?s:.+)").findall
        folder = os.path.join(tempfile.gettempdir(), "duckdb")
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": folder})
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)  # A's tokens, B's tokens, groups, links; -1 if bytes differ
        self.first = np.zeros(1, np.int64)  # where the links of a segment begin
        self.link_a, self.link_b = np.empty(0, np.int32), np.empty(0, np.int32)

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        if self.cut:  # after a line end, which is a token of its own, no space is added
            return a, [x[2:] for x in self.b.encode(["\n" + s for s in segments], num_threads=1)]
        return a, self.b.encode([s[1:] for s in segments], num_threads=1)

    def learn(self, segments: list[str]) -> None:
        at, have = 0, 0
        for k, s in enumerate(segments):
            have += len(s)
            if have >= ALIGNED or k + 1 == len(segments):
                self._align(segments[at : k + 1])
                at, have = k + 1, 0

    def _align(self, segments: list[str]) -> None:
        a, b = self.encode(segments)
        raw = [s.encode() for s in segments]
        join = lambda table, ids: b"".join(map(table.__getitem__, ids))
        good = np.fromiter((join(self.a_bytes, x) == r == join(self.b_bytes, y) for x, y, r in zip(a, b, raw, strict=True)), bool, len(raw))
        sides = []
        for ids, size in ((a, self.a_size), (b, self.b_size)):
            ids = [x if g else [] for x, g in zip(ids, good.tolist(), strict=True)]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.int32, n.sum())
            stop = np.cumsum(size[flat])
            sides.append(pa.table({"i": np.arange(len(flat)), "seg": np.repeat(np.arange(len(ids)), n), "id": flat, "s": stop - size[flat], "e": stop}))
        n_links, n_groups, texts, links = self._joined(len(raw), *sides)
        counts = np.stack([np.where(good, np.bincount(t["seg"].to_numpy(), minlength=len(raw)), -1) for t in sides] + [n_groups, n_links], 1)
        begin = len(self.index)
        self.index.update(zip(segments, range(begin, begin + len(segments)), strict=True))
        self.counts = np.concatenate([self.counts, counts])
        self.groups += texts
        self.first = np.r_[self.first, self.first[-1] + np.cumsum(n_links)]
        self.link_a, self.link_b = np.r_[self.link_a, links["a"].to_numpy()], np.r_[self.link_b, links["b"].to_numpy()]

    def _joined(self, n: int, a: pa.Table, b: pa.Table):
        """DuckDB joins the token intervals of both sides: links by segment, and the group of each token.

        Both sides cover the same bytes without gaps. An overlap begins where its A token does, within the B token that
        began last (ASOF), or strictly within its A token, where its B token does (ASOF and the range). A token's group is
        the number of ends that both sides had before it.
        """
        self.db.register("a", a)
        self.db.register("b", b)
        links = self.db.sql("""
            SELECT seg, a, b FROM (
              SELECT a.seg, a.id AS a, b.id AS b FROM a ASOF JOIN b ON a.s >= b.s
              UNION ALL
              SELECT b.seg, a.id AS a, b.id AS b FROM b ASOF JOIN a ON b.s >= a.s WHERE b.s > a.s AND b.s < a.e)
            ORDER BY seg""").to_arrow_table()
        group = """
            SELECT CAST(sum(ends) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) - ends AS BIGINT) AS g
            FROM (SELECT x.i, CASE WHEN y.e IS NULL THEN 0 ELSE 1 END AS ends FROM {} x LEFT JOIN {} y ON x.e = y.e) ORDER BY i"""
        groups = [self.db.sql(group.format(*sides)).to_arrow_table()["g"].to_numpy() for sides in (("a", "b"), ("b", "a"))]
        self.db.unregister("a")
        self.db.unregister("b")
        texts = []
        for table, g in zip((a, b), groups, strict=True):
            start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else g
            ids = list(map(str, table["id"].to_pylist()))
            texts.append([",".join(ids[x:y]) for x, y in zip(start.tolist(), np.r_[start[1:], len(g)].tolist(), strict=True)])
        pairs = [f"{x}|{y}" for x, y in zip(*texts, strict=True)]
        start = np.flatnonzero(np.r_[True, groups[0][1:] != groups[0][:-1]]) if len(pairs) else np.empty(0, np.int64)
        n_groups = np.bincount(a["seg"].to_numpy()[start], minlength=n)
        stop = np.cumsum(n_groups)
        strings = [";".join(pairs[x:y]) for x, y in zip((stop - n_groups).tolist(), stop.tolist(), strict=True)]
        return np.bincount(links["seg"].to_numpy(), minlength=n), n_groups, strings, links

    def links_of(self, ids: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The links of segments that occur so many times, equal pairs of ids as one: A's ids, B's ids, times."""
        n = self.first[ids + 1] - self.first[ids]
        at = np.repeat(self.first[ids] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        pair, weight = self.link_a[at].astype(np.int64) << 32 | self.link_b[at], np.repeat(times, n)
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        new = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.empty(0, np.int64)
        total = np.add.reduceat(weight[order], new) if len(pair) else weight
        return (pair[new] >> 32).astype(np.int32), (pair[new] & 0xFFFFFFFF).astype(np.int32), total


@lru_cache(1)
def _aligner(files: Tokenizers) -> Aligner:
    return Aligner(files)


def align_tokens(docs: DataFrame, files: Tokenizers, *, text: str = "text", only: list[str] | None = None, keep: list[str] | None = None, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """docs with n_a, n_b, n_groups, n_links, n_best, count_sum, groups ("a1,a2|b1;a3|b2,b3") and groups_sha256.

    The byte-level tokenizer (A) reads a space and the text, the pieces' one (B) the text, to which it adds that space.
    Where tokens of both end, a group ends; A and B tokens whose byte ranges overlap are a link. A pair of ids counts in
    how many links of the corpus it is; n_best are a row's links whose count is the highest of their B id, count_sum is
    the sum of the counts over its links.

    1. Each Arrow partition cuts texts into segments at which both tokenizers cut, and aligns every different one once,
       in DuckDB: token interval tables, ASOF joins with a range for the overlaps, window sums for the groups. A row gets
       the sums of its segments and its pairs of ids with their times; each partition adds its partial pair counts.
    2. Spark sums the partial counts by pair, and their maximum by B id (one row for an id: no more than the vocabulary).
    3. The `hot_pairs` most frequent pairs go to every task, and rows look theirs up there. The rest of the rows' pairs,
       all of them rare, are joined with the counts by pair, and their sums with the rows.
    Both tables of steps 1 and 3 are written; a row's name is its place in the first.

    Edge cases: a text that is null or empty, or whose joined A or B bytes aren't a space and the text, has no tokens:
    zeros, an empty `groups` and an empty `groups_sha256`. Rows with one id, or none, are rows of their own. Columns named
    like the new ones, or `_vq_row`, `_vq_counts`, `_vq_a`, `_vq_b`, `_vq_times`, give way.
    """
    fields = [("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"), ("groups", "string"), ("groups_sha256", "string")]
    fields = [f for f in fields if only is None or f[0] in only]
    own = ["_vq_row", "_vq_counts", "_vq_a", "_vq_b", "_vq_times"]
    kept = [c for c in (docs.columns if keep is None else keep) if c in docs.columns and c not in [*own, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256"]]
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in kept] + T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in fields)).fields + T._parse_datatype_string("_vq_row long, _vq_counts boolean, _vq_a array<int>, _vq_b array<int>, _vq_times array<long>").fields)
    shared = docs.sparkSession.sparkContext.broadcast(files)
    source = docs.select(*kept, F.col(text).alias("_vq_text"))
    made = written(source.mapInArrow(_aligned(shared, kept, [f[0] for f in fields]), schema), "aligned", by="_vq_counts")

    partial = made.where("_vq_counts").select(F.explode(F.arrays_zip("_vq_a", "_vq_b", "_vq_times")).alias("x"))
    counts = partial.groupBy(F.col("x._vq_a").alias("a"), F.col("x._vq_b").alias("b")).agg(F.sum("x._vq_times").alias("n"))
    counts = written(counts, "counts")
    best = counts.groupBy(F.col("b").alias("best_b")).agg(F.max("n").alias("most"))
    counts = written(counts.join(F.broadcast(best), F.col("b") == F.col("best_b")).select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "best")
    hot = counts.orderBy(F.desc("n"), "a", "b").limit(hot_pairs).toArrow()
    hot = docs.sparkSession.sparkContext.broadcast(_lookup(hot))

    rows = made.where("NOT _vq_counts").drop("_vq_counts")
    rest = [c for c in rows.columns if not c.startswith("_vq_")]
    schema = T.StructType([*(rows.schema[c] for c in rest), *T._parse_datatype_string("_vq_row long, n_best long, count_sum long, _vq_a array<int>, _vq_b array<int>, _vq_times array<long>").fields])
    rows = written(rows.mapInArrow(_scored(hot, rest), schema), "scored")
    rare = rows.where(F.size("_vq_a") > 0).select("_vq_row", F.explode(F.arrays_zip("_vq_a", "_vq_b", "_vq_times")).alias("x"))
    rare = rare.select("_vq_row", F.col("x._vq_a").alias("a"), F.col("x._vq_b").alias("b"), F.col("x._vq_times").alias("times")).join(counts, ["a", "b"])
    rare = rare.groupBy("_vq_row").agg(F.sum(F.expr("IF(best, times, 0L)")).alias("more_best"), F.sum(F.expr("n * times")).alias("more_sum"))
    found = rows.drop("_vq_a", "_vq_b", "_vq_times").join(rare, "_vq_row", "left")
    return found.select(*rest, *((F.col(c) + F.coalesce(more, F.lit(0))).alias(c) for c, more in (("n_best", "more_best"), ("count_sum", "more_sum"))))


def _lookup(hot: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pair = hot["a"].to_numpy().astype(np.int64) << 32 | hot["b"].to_numpy()
    order = np.argsort(pair)
    return pair[order], hot["n"].to_numpy()[order], hot["best"].to_numpy(zero_copy_only=False)[order]


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), kind))


def _aligned(shared, kept: list[str], names: list[str]):
    """Rows of documents, and of the partition's partial pair counts."""

    def run(batches):
        know = _aligner(shared.value)  # remembers what the worker's partitions before had
        seen = np.zeros(len(know.index), np.int64)  # how often this partition has had each segment
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        types: list[pa.DataType] = []

        def counted() -> Iterator[pa.RecordBatch]:
            some = np.flatnonzero(seen)
            a, b, times = know.links_of(some, seen[some])
            for at in range(0, len(a), 20_000):
                part = [_lists([c[at : at + 20_000]], t) for c, t in ((a, pa.int32()), (b, pa.int32()), (times, pa.int64()))]
                none = [pa.nulls(1, t) for t in types] + [pa.nulls(1, pa.string() if n.startswith("groups") else pa.int64()) for n in names]
                yield pa.RecordBatch.from_arrays([*none, pa.nulls(1, pa.int64()), pa.array([True]), *part], names=[*kept, *names, "_vq_row", "_vq_counts", "_vq_a", "_vq_b", "_vq_times"])

        for part in _by_size(batches):
            types = [part.column(k).type for k in range(len(kept))]
            if len(know.index) > REMEMBERED:
                yield from counted()
                know.clear()
                seen = np.zeros(0, np.int64)
            texts = [know.segments(" " + t) if t else [] for t in column_strings(part, "_vq_text")]
            know.learn(list({s: None for t in texts for s in t if s not in know.index}))
            seen = np.r_[seen, np.zeros(len(know.index) - len(seen), np.int64)]
            sums, strings, lists = np.zeros((len(texts), 4), np.int64), [], ([], [], [])
            for k, segments in enumerate(texts):
                ids = np.fromiter(map(know.index.__getitem__, segments), np.int64, len(segments))
                counts = know.counts[ids]
                if len(ids) and (counts[:, :2] >= 0).all():
                    sums[k] = counts.sum(0)
                    some, times = np.unique(ids, return_counts=True)
                    seen[some] += times
                    made = know.links_of(some, times)
                    strings.append(";".join(map(know.groups.__getitem__, ids.tolist())))
                else:
                    made = (np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int64))
                    strings.append("")
                for held, one in zip(lists, made, strict=True):
                    held.append(one)
            columns = dict(zip(("n_a", "n_b", "n_groups", "n_links"), map(pa.array, sums.T.copy()), strict=True)) | {
                "groups": strings, "groups_sha256": [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in strings]
            }
            out = [part.column(k) for k in range(len(kept))] + [columns[n] if isinstance(columns[n], pa.Array) else pa.array(columns[n], pa.string()) for n in names]
            rows = [pa.array(np.arange(row, row + len(texts))), pa.array(np.zeros(len(texts), bool))]
            row += len(texts)
            yield pa.RecordBatch.from_arrays([*out, *rows, *(_lists(c, t) for c, t in zip(lists, (pa.int32(), pa.int32(), pa.int64()), strict=True))], names=[*kept, *names, "_vq_row", "_vq_counts", "_vq_a", "_vq_b", "_vq_times"])
        yield from counted()

    return run


def _by_size(batches) -> Iterator[pa.RecordBatch]:
    """Batches in parts of TEXT bytes of text or so; one very long text is a part."""
    for batch in batches:
        at, have = 0, 0
        for k, size in enumerate(pc.binary_length(batch.column(batch.num_columns - 1)).to_pylist()):
            have += size or 0
            if have >= TEXT or k + 1 == batch.num_rows:
                yield batch.slice(at, k + 1 - at)
                at, have = k + 1, 0


def _scored(hot, rest: list[str]):
    def run(batches):
        pair, n, best = hot.value
        for batch in batches:
            for part in slices(batch):
                column = lambda name: part.column(part.schema.get_field_index(name))  # noqa: B023, E731
                lists = [column(c) for c in ("_vq_a", "_vq_b", "_vq_times")]
                offset = np.r_[0, np.cumsum(lists[0].value_lengths().to_numpy())]
                a, b, times = (x.flatten().to_numpy() for x in lists)
                own = a.astype(np.int64) << 32 | b
                at = np.minimum(np.searchsorted(pair, own), max(len(pair) - 1, 0))
                known = pair[at] == own if len(pair) else np.zeros(len(own), bool)
                at = at[known]
                total = np.zeros((len(own), 2), np.int64)
                total[known, 0], total[known, 1] = np.where(best[at], times[known], 0), n[at] * times[known]
                total = np.r_[np.zeros((1, 2), np.int64), np.cumsum(total, 0)]
                sums = total[offset[1:]] - total[offset[:-1]]
                size = np.r_[0, np.cumsum(~known)][offset].astype(np.int32)
                left = [pa.ListArray.from_arrays(pa.array(size), pa.array(x[~known])) for x in (a, b, times)]
                yield pa.RecordBatch.from_arrays([*(column(c) for c in rest), column("_vq_row"), pa.array(sums[:, 0]), pa.array(sums[:, 1]), *left], names=[*rest, "_vq_row", "n_best", "count_sum", "_vq_a", "_vq_b", "_vq_times"])

    return run
