"""Exact removal of repeated substrings by prefix-free parsing.

The corpus is parsed into overlapping phrases at triggers of a rolling hash. Equal phrases collapse into a dictionary
entry. The parse orders a phrase's documents; the suffixes of the dictionary's phrases are sorted by their bytes, trigger
by trigger and cut at the match length, as an order that deep is all that matches of that length need. Suffix order and
parse together give the documents of every match in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_columns, written

#: Bytes of a trigger. A match of `length` bytes always holds one, as it is the least of the hashes in it.
TRIGGER = 20
_P = 0x5851F42D4C957F2D
_M = np.uint64(0x9E3779B97F4A7C15)
_BITS = 24  # for positions beside a hash
#: Rows that a task combines at a time.
CHUNK = 1 << 20
#: A trigger with fewer open phrases isn't a hot one.
HOT_ROWS = 10_000
#: Bytes of the texts that are parsed at a time, as one run; a longer text is one by itself.
BLOCK = 1 << 16
#: Dictionary phrases whose suffixes a task compares before they are sorted.
HELD = 1 << 15

np.empty(1 << 22, np.uint8)  # once such a piece is freed, smaller ones stay with the process, and needn't be mapped anew for each run


@lru_cache(1)
def _tables() -> tuple[np.ndarray, int, np.ndarray]:
    rng = np.random.default_rng(11)
    odd = lambda: rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    return odd(), pow(_P, -1, 1 << 64), odd()


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 17)
        for k, base in enumerate((_P, _tables()[1])):
            made = np.full(size, base, np.uint64)
            made[0] = 1
            _POWERS[k] = np.multiply.accumulate(made)
    return _POWERS[0][:n], _POWERS[1][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    other = h >> np.uint64(31)
    out = np.bitwise_xor(h, other)
    out *= _M
    out ^= np.right_shift(out, np.uint64(29), out=other)
    return out


class Parsed:
    """The phrases of texts that lie one behind another in `byte`, text k from edges[k] to edges[k + 1]. Phrase i belongs
    to text[i], owns the match starts [start[i], stop[i]) and reaches `length` - 1 bytes further. No phrase crosses texts.
    """

    def __init__(self, byte: np.ndarray, edges: np.ndarray, length: int, trigger: int = TRIGGER, names: bool = False):
        up, down = _powers(len(byte) + 1)
        self._sum, self._down, self._length = _sums(byte, 0), down, length
        if len(byte) < length:
            self.text = self.start = self.stop = self.trigger = self.phrase = self.name = np.empty(0, np.int64)
            return
        trigger = min(trigger, length)
        order = _mixed(self.grams(trigger))
        place = _leftmost_least(order, length - trigger + 1)
        new = np.r_[True, place[1:] != place[:-1]]
        new[edges[:-1][edges[:-1] < len(new)]] = True
        start = np.flatnonzero(new)
        text = np.searchsorted(edges, start, "right") - 1
        last = edges[1:] - length + 1  # behind a text's last match
        inside = start < last[text]
        self.start, self.text = start[inside], text[inside]
        self.stop = np.minimum(np.r_[self.start[1:], len(byte)], last[self.text])
        self.trigger = order[place[self.start]].view(np.int64)
        end = self.stop + length - 1
        whole = (self._sum[end] - self._sum[self.start]) * self._down[self.start]
        self.phrase = _mixed(whole + _M * (end - self.start).astype(np.uint64)).view(np.int64)
        if names:  # a second hash of the phrases, from another table of bytes
            other = _sums(byte, 2)
            self.name = _mixed((other[end] - other[self.start]) * down[self.start]).view(np.int64)

    def grams(self, size: int) -> np.ndarray:
        """The rolling hash of each run of `size` bytes."""
        n = max(0, len(self._sum) - size)
        out = self._sum[size:] - self._sum[:n]
        out *= self._down[:n]
        return out

    def matches(self) -> np.ndarray:
        """Of each run of `length` bytes, those across texts as well."""
        return _mixed(self.grams(self._length)).view(np.int64)


def _sums(byte: np.ndarray, table: int) -> np.ndarray:
    out = np.zeros(len(byte) + 1, np.uint64)
    made = _tables()[table][byte]
    made *= _powers(len(byte) + 1)[0][:-1]
    np.cumsum(made, out=out[1:])
    return out


def _runs(column: pa.Array, block: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """A text or binary column in runs of whole rows of `block` bytes at most, if no row is longer: (rows, bytes, edges).
    Nulls are empty.
    """
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + block, "right")) - 1)
        yield slice(at, to), every[edges[at] : edges[to]], edges[at : to + 1] - edges[at]
        at = to


def _listed(hashes: np.ndarray, row: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """The places of the hashes that are in the list of their row."""
    values, sizes = lists.flatten().to_numpy(), lists.value_lengths().fill_null(0).to_numpy()
    low = np.int64((1 << 16) - 1)
    some = np.zeros(low + 1, bool)  # most hashes are in no list, and this tells at a glance
    some[values & low] = True
    at = np.flatnonzero(some[hashes & low])
    if not len(at):
        return at
    every, rank = np.unique(values, return_inverse=True)
    pairs = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(every) + rank)
    found = np.minimum(np.searchsorted(every, hashes[at]), len(every) - 1)
    same = every[found] == hashes[at]
    at, found = at[same], found[same]
    pair = row[at] * len(every) + found
    return at[pairs[np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)] == pair]


def _match_hashes(rows: np.ndarray) -> np.ndarray:
    """What `Parsed.matches` gives for the same bytes."""
    return _mixed((_tables()[0][rows] * _powers(rows.shape[1] + 1)[0][:-1]).sum(1, dtype=np.uint64)).view(np.int64)


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least value in each run of `width` values, by their upper bits, the leftmost of equal ones.

    Long texts go by overlapping blocks, whose places fit beside the bits; the order is the same in all.
    """
    block, n = (1 << _BITS) - width, len(values) - width + 1
    if n > block:
        return np.concatenate([_leftmost_least(values[at : at + block + width - 1], width) + at for at in range(0, n, block)])
    mask = np.uint64((1 << _BITS) - 1)
    least, have = values & ~mask, 1
    least |= np.arange(len(values), dtype=np.uint64)
    while have < width:
        step = min(have, width - have)
        least, have = np.minimum(least[:-step], least[step:], out=least[:-step]), have + step
    least &= mask
    return least.view(np.int64)


def remove_repeats(docs: DataFrame, *, length: int = 50, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, removed ([start, end, ...]), kept_text (bytes) and kept_sha256.

    A byte goes if a run of `length` bytes that covers it also starts in a document with a smaller id. Runs are
    judged on the input, and never cross documents.

    1. Parse: each text is cut at triggers, the least rolling hashes within a match's reach, into phrases that overlap
       by length - 1 bytes, so every match lies within one phrase and has its trigger. One row for each phrase (trigger,
       phrase, doc), dealt out by trigger and sorted there by phrase name and document: the parse. Reading in order, a
       phrase seen before in a smaller document is a repeat as a whole. A dictionary phrase (a first one) whose trigger
       also heads another phrase is open; all others have no suffix in common with any other phrase.
    2. Dictionary: the bytes of open phrases, a few per cent of the text, meet by trigger. Their suffixes, cut at `length`
       bytes, are sorted by their bytes: a suffix array of the trigger's part of the dictionary, as deep as matches need.
       Equal ones follow each other, by document; one that a smaller document has is a repeat. A suffix that shares its
       hash with no other one has no equal and needn't be sorted.
    3. Both lists meet the texts again by doc, which drop the bytes.
    All sorts are Spark's and spill; what reads them holds a batch and the last key only, however many rows a key has.
    Phrases are told apart by 128 bits of hashes, matches by their bytes. A trigger with more than HOT_ROWS open phrases and
    a thousandth of all (so at most a thousand triggers) has its matches dealt out one by one.

    Edge cases: a null text is empty; texts shorter than `length` are whole. A row without id repeats nothing and
    is repeated by nothing. Rows with one id are the same document: they don't remove each other's bytes. Columns named
    like the new ones, `_vq_phrases` or `_vq_matches` give way. Ids are whole numbers.
    """
    known = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    parsed = known.mapInArrow(_phrases(length), "dealt long, item long, name long, doc long, known boolean")
    parsed = parsed.repartition("dealt").sortWithinPartitions("dealt", "item", "name", "doc")
    found = written(parsed.mapInArrow(_repeats, "doc long, item long, trigger long, whole boolean"), "phrases")

    open_phrases = found.where("NOT whole")
    counted = open_phrases.groupBy("trigger").count()
    limit = max(hot_rows, open_phrases.count() // 1000)
    hot = np.array([r["trigger"] for r in counted.where(F.col("count") > limit).select("trigger").collect()], np.int64)  # 1000 at most
    opened = open_phrases.groupBy("doc").agg(F.collect_set("item").alias("open"))
    dictionary = known.join(opened, "doc").select("doc", "text", "open").mapInArrow(_dictionary(length, hot), "dealt long, phrase binary, doc long, known boolean")
    suffixes = dictionary.repartition("dealt").sortWithinPartitions("dealt").mapInArrow(_suffixes(length), "suffix binary, doc long, known boolean").sortWithinPartitions("suffix", "doc")
    matched = written(suffixes.mapInArrow(_equal_suffixes(length), "doc long, match long"), "matches")

    lists = found.where("whole").selectExpr("doc AS _vq_doc", "item AS phrase", "CAST(NULL AS long) AS match").unionByName(matched.selectExpr("doc AS _vq_doc", "CAST(NULL AS long) AS phrase", "match"))
    lists = lists.groupBy("_vq_doc").agg(F.collect_set("phrase").alias("_vq_phrases"), F.collect_set("match").alias("_vq_matches"))
    docs = docs.drop("_vq_phrases", "_vq_matches")
    joined = docs.join(lists, docs[doc_id].cast("long") == lists["_vq_doc"], "left").drop(lists["_vq_doc"])
    fields = [("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("removed", "array<int>"), ("kept_text", "binary"), ("kept_sha256", "string")]
    if keep is not None:
        fields = [f for f in fields if f[0] in keep or f[0].startswith("n_") or f[0] == "kept_sha256"]
    kept = [c for c in (docs.columns if keep is None else keep) if c in docs.columns]
    return with_columns(joined, fields, _cut(length, text, [f[0] for f in fields]), kept)


def _phrases(length: int):
    """The parse: (dealt, item, name, doc, known) for each phrase of each text. `item` and `name` are two independent
    64-bit hashes of a phrase's bytes; `dealt` is its trigger.

    Chunks of rows are combined before they leave the task: a phrase that a smaller document of the chunk has is known
    to repeat and needn't meet the others of its trigger. It is dealt out by a hash of its own, so however many
    documents share a phrase, each chunk sends the trigger's task one row of it.
    """

    def combined(made):
        dealt, item, name, doc = (np.concatenate(c) for c in zip(*made, strict=True))
        made.clear()
        known, once = np.zeros(len(doc), bool), np.ones(len(doc), bool)
        order = np.argsort(item)
        same = item[order[1:]] == item[order[:-1]]
        order = order[np.r_[False, same] | np.r_[same, False]]  # of phrases that are there twice
        if len(order):
            order = order[np.lexsort((doc[order], item[order]))]  # two phrases with one item might mix, and would only be combined less
            d, i, n, x = dealt[order], item[order], name[order], doc[order]
            new = np.r_[True, (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (n[1:] != n[:-1])]
            once[order] = new | np.r_[True, x[1:] != x[:-1]]
            more = x > x[np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))]
            known[order] = more
            dealt[order[more]] = _mixed(i[more].view(np.uint64) ^ (x[more].astype(np.uint64) * _M)).view(np.int64)
        for at in range(0, len(doc), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(c[part][once[part]]) for c in (dealt, item, name, doc, known)], names=["dealt", "item", "name", "doc", "known"])

    def run(batches):
        made, rows = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for part, byte, edges in _runs(batch.column(1), BLOCK):
                p = Parsed(byte, edges, length, names=True)
                if len(p.start):
                    made.append((p.trigger, p.phrase, p.name, ids[part][p.text]))
                    rows += len(p.start)
                if rows >= CHUNK:
                    yield from combined(made)
                    rows = 0
        if made:
            yield from combined(made)

    return run


def _repeats(batches):
    """Over rows sorted by (dealt, item, name, doc): the phrases that a smaller document has (whole), and the first ones
    of a trigger that has several phrases, with that trigger: they are open.
    """
    last: tuple | None = None  # the trigger and phrase that the rows before ended with, and its smallest doc
    open_trigger, waiting = None, None  # a trigger with one phrase so far, whose first rows wait for another
    for batch in batches:
        known = batch.column(4).to_numpy(zero_copy_only=False)
        trigger, item, name, doc = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:4])
        out = [doc[known], item[known], trigger[known], np.ones(known.sum(), bool)]
        trigger, item, name, doc = trigger[~known], item[~known], name[~known], doc[~known]
        if len(doc):
            new_trigger = np.r_[last is None or trigger[0] != last[0], trigger[1:] != trigger[:-1]]
            new_item = new_trigger | np.r_[last is None or (item[0], name[0]) != last[1:3], (item[1:] != item[:-1]) | (name[1:] != name[:-1])]
            head = np.maximum.accumulate(np.where(new_item, np.arange(len(doc)), -1))
            first = np.where(head >= 0, doc[np.maximum(head, 0)], last[3] if last else 0)
            whole = doc > first
            out = [np.concatenate(c) for c in zip(out, [doc[whole], item[whole], trigger[whole], np.ones(whole.sum(), bool)], strict=True)]
            group = np.cumsum(new_trigger) - new_trigger[0]  # 0 goes on with the batch before
            several = np.zeros(group[-1] + 1, bool)
            several[group[new_item & ~new_trigger]] = True
            going_on = not new_trigger[0]
            if going_on and open_trigger:
                several[0] = True
            if going_on and several[0] and waiting is not None:
                out = [np.concatenate(c) for c in zip(out, waiting, strict=True)]
                waiting = None
            firsts = ~whole & (new_item | (doc == first))
            firsts &= np.r_[True, (doc[1:] != doc[:-1]) | new_item[1:]]  # a document once
            if last and not new_item[0] and doc[0] == last[3]:
                firsts[0] = False
            show = firsts & several[group]
            out = [np.concatenate(c) for c in zip(out, [doc[show], item[show], trigger[show], np.zeros(show.sum(), bool)], strict=True)]
            tail = firsts & (group == group[-1]) & ~several[-1]
            if tail.any():
                waiting = [doc[tail], item[tail], trigger[tail], np.zeros(tail.sum(), bool)]
            elif group[-1] > 0 or several[-1]:
                waiting = None
            open_trigger = bool(several[-1])
            last = (trigger[-1], item[-1], name[-1], first[-1])
        doc, item, trigger, whole = out
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(item), pa.array(trigger, mask=whole), pa.array(whole)], names=["doc", "item", "trigger", "whole"])


def _dictionary(length: int, hot: np.ndarray):
    """The bytes of the open phrases: (dealt, phrase, doc, known), dealt out by trigger. A hot trigger's phrases are cut
    into their matches, each a phrase of `length` bytes, which are dealt out by their bytes and combined by chunk.
    """

    def flat(rows):
        dealt, phrase, doc, known = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(dealt, pa.int64()), pa.array(phrase, pa.binary()), pa.array(doc, pa.int64()), pa.array(known, pa.bool_())], names=["dealt", "phrase", "doc", "known"])

    def combined(least, more):
        """Of each match the smallest document, dealt out by the match, and the others, dealt out anyhow."""
        rows = [(xxhash.xxh3_64_intdigest(m) - (1 << 63), m, doc, False) for m, doc in least.items()]
        rows += [(xxhash.xxh3_64_intdigest(m, doc & 0x7FFFFFFF) - (1 << 63), m, doc, True) for m, doc in more if doc > least[m]]
        for at in range(0, len(rows), 20_000):
            yield flat(rows[at : at + 20_000])

    def run(batches):
        least, more = {}, []
        for batch in batches:
            ids, wanted = batch.column(0).to_numpy(), batch.column(2)
            for part, byte, edges in _runs(batch.column(1), BLOCK):
                p = Parsed(byte, edges, length)
                pick = _listed(p.phrase, p.text, wanted[part])
                is_hot = np.isin(p.trigger[pick], hot)
                pick, hot_ones = pick[~is_hot], pick[is_hot]
                if len(pick):
                    size = p.stop[pick] + length - 1 - p.start[pick]
                    at = np.r_[0, np.cumsum(size)]
                    raw = byte[np.repeat(p.start[pick] - at[:-1], size) + np.arange(at[-1])]
                    phrase = pa.Array.from_buffers(pa.binary(), len(pick), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)])
                    yield pa.RecordBatch.from_arrays([pa.array(p.trigger[pick]), phrase, pa.array(ids[part][p.text[pick]]), pa.array(np.zeros(len(pick), bool))], names=["dealt", "phrase", "doc", "known"])
                if len(hot_ones):
                    raw = byte.tobytes()
                    for doc, start, stop in zip(ids[part][p.text[hot_ones]].tolist(), p.start[hot_ones].tolist(), p.stop[hot_ones].tolist(), strict=True):
                        for at in range(start, stop):
                            match = raw[at : at + length]
                            more.append((match, doc))
                            least[match] = min(doc, least.get(match, doc))
                    if len(more) >= CHUNK // 4:
                        yield from combined(least, more)
                        least, more = {}, []
        if more:
            yield from combined(least, more)

    return run


def _rows_of(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of values of `width` bytes each as a matrix."""
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty((0, width), np.uint8)
    begin = np.frombuffer(offsets, np.int32 if column.type == pa.binary() else np.int64)[column.offset]
    return np.frombuffer(data, np.uint8)[begin : begin + width * len(column)].reshape(-1, width)


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, width * n + 1, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _suffixes(length: int):
    """Over dictionary phrases in the order of their triggers: their suffixes, cut at `length` bytes: (suffix, doc, known).

    Equal suffixes have one trigger. Of triggers whose phrases fit in HELD rows, suffixes that no other one shares a
    64-bit hash with are left out: they have no equal. Those of a larger trigger all go on.
    """

    def suffixes(rows, all_of_them):
        made = []
        for part, byte, edges in _runs(rows.column(1), BLOCK):
            n = np.diff(edges) - length + 1
            at = np.repeat(edges[:-1] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            sums = _sums(byte, 0)
            h = None if all_of_them else (sums[at + length] - sums[at]) * _powers(len(sums))[1][at]
            made.append((byte, at, h, np.repeat(np.arange(part.start, part.stop), n)))
            if all_of_them:
                yield from shown(rows, made, None)
                made = []
        if made:
            h = np.concatenate([m[2] for m in made])
            order = np.argsort(h)
            same = h[order[1:]] == h[order[:-1]]
            shared = np.zeros(len(h), bool)
            shared[order[np.r_[False, same] | np.r_[same, False]]] = True
            yield from shown(rows, made, shared)

    def shown(rows, made, shared):
        doc, known = (rows.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
        done = 0
        for byte, at, _, row in made:
            if shared is not None:
                show = shared[done : done + len(at)] | known[row]
                done += len(at)
                at, row = at[show], row[show]
            cut = np.lib.stride_tricks.sliding_window_view(byte, length)[at]
            yield pa.RecordBatch.from_arrays([_binary(cut), pa.array(doc[row]), pa.array(known[row])], names=["suffix", "doc", "known"])

    def run(batches):
        held, large = None, None  # rows of a trigger that may go on; a trigger whose rows all go on
        for batch in batches:
            if large is not None:
                to = int(np.searchsorted(batch.column(0).to_numpy(), large, "right"))
                yield from suffixes(batch.slice(0, to), True)
                if to == batch.num_rows:
                    continue
                batch, large = batch.slice(to), None
            held = batch if held is None else pa.concat_batches([held, batch])
            if held.num_rows < HELD:
                continue
            dealt = held.column(0).to_numpy()
            whole = int(np.searchsorted(dealt, dealt[-1]))
            yield from suffixes(held.slice(0, whole), False)
            held = held.slice(whole)
            if held.num_rows >= HELD:
                yield from suffixes(held, True)
                held, large = None, dealt[-1]
        if held is not None:
            yield from suffixes(held, False)

    return run


def _equal_suffixes(length: int):
    """Over suffixes in the order of their bytes and documents: (doc, match) of those that a smaller document has."""

    def run(batches):
        last: tuple | None = None  # the suffix that the rows before ended with, and its smallest doc
        for batch in batches:
            if not batch.num_rows:
                continue
            suffix, doc, known = _rows_of(batch.column(0), length), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            new = np.r_[last is None or suffix[0].tobytes() != last[0], (suffix[1:] != suffix[:-1]).any(1)]
            head = np.maximum.accumulate(np.where(new, np.arange(len(doc)), -1))
            first = np.where(head >= 0, doc[np.maximum(head, 0)], last[1] if last else 0)
            gone = known | (doc > first)
            last = (suffix[-1].tobytes(), first[-1])
            yield pa.RecordBatch.from_arrays([pa.array(doc[gone]), pa.array(_match_hashes(suffix[gone]))], names=["doc", "match"])

    return run


def _cut(length: int, text: str, names: list[str]):
    def run(byte: np.ndarray, edges: np.ndarray, phrases: pa.ListArray, matches: pa.ListArray) -> dict:
        gone = np.zeros(len(byte), bool)
        if len(byte) >= length and (len(phrases.flatten()) or len(matches.flatten())):
            p = Parsed(byte, edges, length)
            pick = _listed(p.phrase, p.text, phrases)
            begin, end = p.start[pick], p.stop[pick] + length - 1
            if len(matches.flatten()):
                hashes = p.matches()
                row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))[: len(hashes)]
                at = _listed(hashes, row, matches)
                at = at[at + length <= edges[row[at] + 1]]
                begin, end = np.r_[begin, at], np.r_[end, at + length]
            gone = np.cumsum(np.bincount(begin, minlength=len(byte)) - np.bincount(end, minlength=len(byte) + 1)[:-1]) > 0
        first, last = gone.copy(), gone.copy()  # of each removed run, which ends with its text
        first[1:] &= ~gone[:-1]
        last[:-1] &= ~gone[1:]
        some = np.flatnonzero(np.diff(edges))
        first[edges[some]] = gone[edges[some]]
        last[edges[some + 1] - 1] = gone[edges[some + 1] - 1]
        spans = np.stack([np.flatnonzero(first), np.flatnonzero(last) + 1], 1)
        of = np.r_[0, np.cumsum(first)][edges]  # spans before each text
        removed = np.r_[0, np.cumsum(gone)][edges]
        kept, at = byte[~gone].tobytes(), (edges - removed).tolist()
        kept = [kept[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
        out = {"n_bytes": np.diff(edges).tolist(), "n_removed": np.diff(removed).tolist(), "n_spans": np.diff(of).tolist(), "kept_text": kept}
        out["kept_sha256"] = [hashlib.sha256(x).hexdigest() for x in kept]
        if "removed" in names:
            out["removed"] = [(spans[x:y] - edge).ravel().tolist() for x, y, edge in zip(of[:-1], of[1:], edges, strict=False)]
        return out

    def task():
        def make(batch):
            phrases, matches = (batch.column(batch.schema.get_field_index(c)) for c in ("_vq_phrases", "_vq_matches"))
            made = [run(byte, edges, phrases[part], matches[part]) for part, byte, edges in _runs(batch.column(batch.schema.get_field_index(text)), BLOCK)]
            return [[x for r in made for x in r[n]] for n in names]

        return make

    return task
