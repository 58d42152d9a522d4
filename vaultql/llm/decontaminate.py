"""Benchmark decontamination: a prefix-filtered containment join of item windows against documents."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, column_bytes, with_columns

#: Bytes of item text that one broadcast may hold; more items go in further blocks. A block's arrays and vocabulary
#: take about 15 times as much.
BLOCK_BYTES = 4 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: What one block's pass hands to the next.
_SPANS, _ITEMS = "_vq_spans", "_vq_items"


def decontaminate(
    docs: DataFrame, items: DataFrame, *, window: int = 13, shingle: int = 5, percent: int = 5, text: str = "text",
    item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, hits and contaminated.

    Every run of `window` words of an item is a window (a shorter item is one window). A window must occur whole, so
    any one of its shingles is a necessary prefix: shingles are ordered by how often the documents hold them, and
    only the rarest of each window is looked up. A match must leave room for the words before and after it
    (positional and length bounds) and is then compared word by word. `hits` holds the hit spans as word positions
    [start, end, start, end, ...]; a document is contaminated from `percent` % of its words on.

    Items are broadcast in blocks of at most `block_bytes`, each block with its own pass over the rows, so that what
    is held at once doesn't grow with the benchmark.

    Edge cases: a null or empty text has no words and is clean. Items without an id or without words have no windows.
    Rows that repeat an item id count as one item; repeated documents get a row each. Columns of docs with the names
    above give way; `_vq_spans` and `_vq_items` are this operator's own.
    """
    spark = docs.sparkSession
    items = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull())
    size = items.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    out = docs
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64(item_id, item_text), F.lit(n)) == k)
        rows = [(str(i), alnum_words(t.encode())) for i, t in block.select(item_id, item_text).toLocalIterator()]
        model = _Windows(rows, window, shingle)
        model.order_by(*_rarity(docs, model, text))
        out = _marked(out, spark.sparkContext.broadcast(model), text, percent, first=k == 0, last=k == n - 1, keep=keep)
    return out


class _Windows:
    """The windows of a block of items in flat arrays, and a lookup from prefix shingles to them.

    `flat` has the items' words as numbers, one item after another. Window k is flat[start[k] : start[k] + length[k]];
    equal windows are one, held by the items owner[first_owner[k] : first_owner[k + 1]]. About 50 bytes a window.
    """

    def __init__(self, rows: list[tuple[str, list[bytes]]], window: int, shingle: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({i for i, words in rows if words})
        number = {i: k for k, i in enumerate(self.items)}
        rows = [(number[i], words) for i, words in rows if words]
        flat = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for _, words in rows for w in words]
        self.flat, self.shingle = np.array(flat, np.int32), shingle
        size = np.array([len(words) for _, words in rows], np.int64)
        n = np.maximum(1, size - window + 1)
        begin = np.r_[0, np.cumsum(size)[:-1]] if len(size) else size
        start = np.repeat(begin - np.r_[0, np.cumsum(n)[:-1]] if len(n) else n, n) + np.arange(n.sum())
        length = np.repeat(np.minimum(size, window), n)
        owner = np.repeat(np.array([i for i, _ in rows], np.int64), n)
        # equal windows come together by a hash of their words; each is compared with the one before it word by word
        mixed = np.zeros(len(start), np.uint64)
        for j in range(window):
            mixed = (mixed ^ np.where(j < length, self._word(start + j), 0).astype(np.uint64)) * _MIX
            mixed ^= mixed >> np.uint64(29)
        order = np.lexsort((owner, mixed))
        start, length, owner, mixed = start[order], length[order], owner[order], mixed[order]
        same = np.r_[False, (mixed[1:] == mixed[:-1]) & (length[1:] == length[:-1])] if len(mixed) else np.empty(0, bool)
        for j in range(window):
            here = np.where(j < length, self._word(start + j), 0)
            same[1:] &= here[1:] == here[:-1]
        again = same & np.r_[False, owner[1:] == owner[:-1]] if len(mixed) else same
        self.owner = owner[~again]
        self.first_owner = np.r_[np.flatnonzero(~same[~again]), len(self.owner)]
        self.start, self.length = start[~same], length[~same]
        self.sizes = sorted({min(shingle, int(n)) for n in np.unique(self.length)})
        self.keys = {s: shingles(self.flat, s) for s in self.sizes}  # by place in flat; those across items are never asked for
        self.all_keys = {s: np.unique(self.keys[s][self._places(s)]) for s in self.sizes}
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def _word(self, at: np.ndarray) -> np.ndarray:
        return self.flat[np.minimum(at, len(self.flat) - 1)]

    def _of_size(self, s: int) -> np.ndarray:
        return np.flatnonzero(np.minimum(self.length, self.shingle) == s)

    def _places(self, s: int) -> np.ndarray:
        """The places of flat where a shingle of a window begins."""
        found = np.zeros(len(self.flat) + 1, np.int32)
        some = self._of_size(s)
        np.add.at(found, self.start[some], 1)
        np.subtract.at(found, self.start[some] + self.length[some] - s + 1, 1)
        return np.flatnonzero(np.cumsum(found[:-1])[: len(self.keys[s])] > 0)

    def order_by(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Choose each window's rarest shingle; of equally rare ones the first. `keys` are sorted."""
        for s in self.sizes:
            some, held = self._of_size(s), self.keys[s]
            at = np.minimum(np.searchsorted(keys, held), max(0, len(keys) - 1))
            often = np.where(keys[at] == held, counts[at], 0) if len(keys) else np.zeros(len(held), np.int64)
            best, low = np.zeros(len(some), np.int64), np.full(len(some), np.iinfo(np.int64).max)
            for j in range(int(self.length[some].max()) - s + 1):
                here = np.where(j <= self.length[some] - s, often[np.minimum(self.start[some] + j, len(held) - 1)], np.iinfo(np.int64).max)
                best, low = np.where(here < low, j, best), np.minimum(low, here)
            chosen = held[self.start[some] + best]
            order = np.argsort(chosen, kind="stable")
            distinct, first = np.unique(chosen[order], return_index=True)
            self.prefix[s] = (distinct, np.r_[first, len(order)], some[order], best[order])
        self.keys, self.all_keys = {}, {}

    def numbered(self, words: list[bytes]) -> np.ndarray:
        find = self.vocabulary.get
        return np.array([find(w, 0) for w in words], np.int64)

    def names(self, window: int) -> list[str]:
        return [self.items[i] for i in self.owner[self.first_owner[window] : self.first_owner[window + 1]].tolist()]

    def occurrences(self, ids: np.ndarray):
        """(window, start, end) of each place where a window occurs."""
        for s, (keys, first, windows, offsets) in self.prefix.items():
            if len(ids) < s:
                continue
            made = shingles(ids, s)
            hits = np.flatnonzero(within(made, keys))
            which = np.searchsorted(keys, made[hits])
            for at, k in zip(hits.tolist(), which.tolist(), strict=True):
                for m in range(first[k], first[k + 1]):
                    window, start = int(windows[m]), at - int(offsets[m])
                    begin, n = self.start[window], self.length[window]
                    if start >= 0 and start + n <= len(ids) and np.array_equal(ids[start : start + n], self.flat[begin : begin + n]):
                        yield window, start, start + int(n)


def shingles(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit key of each run of `size` numbers; 0 where a number is 0."""
    n = len(ids) - size + 1
    keys, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(size):
        part = ids[j : j + n]
        keys = (keys ^ part.astype(np.uint64)) * _MIX
        keys ^= keys >> np.uint64(29)
        known &= part > 0
    return np.where(known, keys | np.uint64(1), np.uint64(0))


def within(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which values are among the sorted keys."""
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def _rarity(docs: DataFrame, model: _Windows, text: str) -> tuple[np.ndarray, np.ndarray]:
    """How often the documents hold each shingle of the block, by sorted keys; as large as the block at most."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches):
        import pyarrow as pa

        model = held.value
        totals = {s: np.zeros(len(k), np.int64) for s, k in model.all_keys.items()}
        for batch in batches:
            for raw in column_bytes(batch, text):
                ids = model.numbered(alnum_words(raw))
                for s, keys in model.all_keys.items():
                    if len(ids) >= s and ids.any():
                        made = shingles(ids, s)
                        np.add.at(totals[s], np.searchsorted(keys, made[within(made, keys)]), 1)
        for s, keys in model.all_keys.items():
            some = totals[s] > 0
            yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(totals[s][some])], names=["key", "n"])

    if not len(model.start):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    counted = docs.select(text).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    keys, n = (counted.column(c).to_numpy() for c in ("key", "n"))
    order = np.argsort(keys.view(np.uint64))
    return keys.view(np.uint64)[order], n[order]


def _marked(docs: DataFrame, held, text: str, percent: int, *, first: bool, last: bool, keep: list[str] | None) -> DataFrame:
    def task():
        model = held.value

        def make(batch):
            spans, found = ([[]] * batch.num_rows if first else batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (_SPANS, _ITEMS))
            rows = []
            for raw, old, had in zip(column_bytes(batch, text), spans, found, strict=True):
                words = alnum_words(raw)
                ids, items = model.numbered(words), set(had)
                new = list(zip(old[::2], old[1::2], strict=True))
                if ids.any():
                    for k, start, end in model.occurrences(ids):
                        items.update(model.names(k))
                        new.append((start, end))
                merged: list[int] = []
                for start, end in sorted(new):
                    if merged and start <= merged[-1]:
                        merged[-1] = max(end, merged[-1])
                    else:
                        merged += (start, end)
                rows.append((len(words), merged, sorted(items)))
            if not last:
                return [[r[1] for r in rows], [r[2] for r in rows]]
            hit = [sum(m[1::2]) - sum(m[::2]) for _, m, _ in rows]
            return [
                [r[0] for r in rows], hit, [len(r[2]) for r in rows],
                [hashlib.sha256(",".join(r[2]).encode()).hexdigest() for r in rows], [r[1] for r in rows],
                [h > 0 and 100 * h >= percent * r[0] for h, r in zip(hit, rows, strict=True)],
            ]

        return make

    fields = [("n_words", "long"), ("n_hit", "long"), ("n_items", "long"), ("items_sha256", "string"), ("hits", "array<int>"), ("contaminated", "boolean")]
    if not last:
        return with_columns(docs, [(_SPANS, "array<int>"), (_ITEMS, "array<string>")], task)
    return with_columns(docs, fields, task, [c for c in docs.columns if c not in (_SPANS, _ITEMS)] if keep is None else keep)
