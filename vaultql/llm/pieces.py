"""SentencePiece sampling: forward filtering, backward sampling over the piece lattice, and lossless decoding."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import column_strings, with_columns

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_SPACE, _MARK = 0x2581, 0x110000  # how pieces write a space; a written U+2581 itself, beyond Unicode here
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: A word's mark of punctuation is a segment of its own if no piece goes from a letter on to such a mark.
_MARKED = r"[^\W_²](?=[.,!?;:|%&*$#\"])"
_WORDS = r" *[^ \n]+|\n+| +"
_M = np.uint64(0x9E3779B97F4A7C15)
#: A lattice cache of more edges than this starts anew.
MOST_EDGES = 2_000_000


@dataclass
class PieceModel:
    """Pieces with log weights. Byte pieces stand for characters that have no piece of their own."""

    pieces: dict[str, int]
    weight: np.ndarray
    byte_ids: np.ndarray
    raw: list[bytes]
    segment: str = _WORDS


def load_pieces(spark: SparkSession, path: str = DEFAULT_MODEL, *, exponent: float = 1.0) -> PieceModel:
    """The model file's pieces, from a local path or any folder that Spark reads.

    The weight of the r-th merged piece is (r + 1) ** -exponent: the vocabulary is a byte-pair one, whose scores are
    ranks, and word frequencies fall about so with the rank. The vocabulary is used as it is; nothing is trained.
    """
    if "://" in path:
        proto = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
        held = sentencepiece.SentencePieceProcessor(model_proto=proto)
    else:
        held = sentencepiece.SentencePieceProcessor(model_file=path)
    n = held.get_piece_size()
    byte_ids, raw, pieces, weight = np.full(256, -1), [b""] * n, {}, np.full(n, -np.inf)
    for i in range(n):
        piece = held.id_to_piece(i)
        if held.is_byte(i):
            byte = int(_BYTE.fullmatch(piece)[1], 16)
            byte_ids[byte], raw[i] = i, bytes([byte])
        elif not (held.is_control(i) or held.is_unknown(i) or held.is_unused(i)):
            pieces[piece], raw[i] = i, piece.replace("▁", " ").encode()
            # ranks are scores from 0 down; user-defined pieces far below all come first
            weight[i] = -exponent * np.log1p(max(0.0, -held.get_score(i)) if held.get_score(i) > -1e8 else 0.0)
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces, so it can't be lossless")
    if any("\n" in p or re.search("[^▁]▁", p) for p in pieces):
        raise ValueError("the model has pieces that cross a word start or a line end")
    crossed = any(re.search(_MARKED, p) for p in pieces)
    return PieceModel(pieces, weight, byte_ids, raw, _WORDS if crossed else r" *[^\W_²]*" + _MARKED + "|" + _WORDS)


class Sampler:
    """Lattices of text segments as flat arrays, kept for segments seen before, and sampling from them.

    No piece crosses a segment's ends, so a text's lattice is the chain of its segments' lattices and they
    can be sampled apart. A node is a place between characters; its edges are the pieces that end there.
    """

    def __init__(self, model: PieceModel):
        self.model, self.segment = model, re.compile(model.segment).findall
        text = list(model.pieces)
        self.longest = max(map(len, text))
        by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for size in range(1, self.longest + 1):
            some = [p for p in text if len(p) == size]
            keys = _rolled(np.array([[ord(c) for c in p] for p in some], np.uint64).reshape(len(some), size))
            order = np.argsort(keys)
            may = np.zeros(1 << 20, bool)  # most substrings are no piece, and this tells at a glance
            may[keys & np.uint64((1 << 20) - 1)] = True
            by_length.append((keys[order], np.array([model.pieces[p] for p in some], np.int64)[order], may))
        self.by_length = by_length
        worst = model.weight[np.isfinite(model.weight)].min()
        self.fallback = worst - 5.0
        self.clear()

    def clear(self) -> None:
        self.end: dict[str, int] = {}
        self.edges = 0
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.nodes = 0
        self.first = np.zeros(1, np.int64)  # where the edges of a node begin
        self.upto = np.empty(0)  # cumulative probability, for each edge of a node; the last has more than 1
        self.back = np.empty(0, np.int64)  # the node where it starts
        self.piece = np.empty(0, np.int64)  # its piece, or the number of pieces + the character it spells in bytes

    def add(self, segments: list[str]) -> None:
        """Forward filtering for new segments, all at once, by place."""
        size = np.array([len(s) for s in segments], np.int64)
        chars = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32).astype(np.int64)
        chars = np.where(chars == _SPACE, _MARK, np.where(chars == 32, _SPACE, chars)).astype(np.uint64)
        start = np.r_[0, np.cumsum(size)]
        left = np.repeat(start[1:], size) - np.arange(len(chars))  # characters up to the segment's end
        place = np.arange(len(chars)) - np.repeat(start[:-1], size)
        node = np.arange(len(chars)) + np.repeat(np.arange(len(segments)), size)  # each segment has one node more
        begin, finish, piece = [], [], []
        rolled, lone = np.zeros(len(chars), np.uint64), np.ones(len(chars), bool)
        for k, (keys, ids, may) in enumerate(self.by_length):
            rolled = _roll(rolled[: len(chars) - k], chars[k:])
            if not len(rolled):
                break
            if len(keys):
                hit = np.flatnonzero(may[rolled & np.uint64((1 << 20) - 1)] & (left[: len(rolled)] > k))
                at = np.minimum(np.searchsorted(keys, rolled[hit]), len(keys) - 1)
                same = keys[at] == rolled[hit]
                hit, at = hit[same], at[same]
                begin.append(node[hit])
                finish.append(node[hit] + k + 1)
                piece.append(ids[at])
                if k == 0:
                    lone[hit] = False
        plain = np.flatnonzero(lone)
        begin.append(node[plain])
        finish.append(node[plain] + 1)
        piece.append(len(self.model.raw) + chars[plain].astype(np.int64))
        # each length's edges are in order, and the longest come first among those of a node
        begin, finish, piece = (np.concatenate(x[-1:] + x[-2::-1]) for x in (begin, finish, piece))
        order = np.argsort(finish, kind="stable")
        begin, finish, piece = begin[order], finish[order], piece[order]
        weight = np.where(piece < len(self.model.raw), self.model.weight[np.minimum(piece, len(self.model.raw) - 1)], self.fallback)

        total = len(chars) + len(segments)
        first = np.searchsorted(finish, np.arange(total + 1))
        log = np.zeros(total)
        ends = node + 1  # all nodes but the segments' first ones, and how far in they are
        for some in np.split(ends[np.argsort(place, kind="stable")], np.cumsum(np.bincount(place))[:-1]) if len(place) else []:
            n = first[some + 1] - first[some]
            heads = np.r_[0, np.cumsum(n)[:-1]]
            pick = np.repeat(first[some] - heads, n) + np.arange(n.sum())
            log[some] = np.logaddexp.reduceat(log[begin[pick]] + weight[pick], heads)
        share = np.exp(log[begin] + weight - log[finish])
        upto = np.cumsum(share)
        upto -= np.repeat(np.r_[0.0, upto][first[:-1]], np.diff(first))
        upto[first[1:][np.diff(first) > 0] - 1] = 2.0
        self.first = np.r_[self.first[:-1], first + self.edges]
        self.upto = np.r_[self.upto, upto]
        self.back, self.piece = np.r_[self.back, begin + self.nodes], np.r_[self.piece, piece]
        self.end.update(zip(segments, (start[1:] + np.arange(len(segments)) + self.nodes).tolist(), strict=True))
        self.nodes += total
        self.edges += len(piece)

    def sample(self, texts: list[str | None], keys: list, seed: int) -> list[np.ndarray]:
        """Piece ids of each text, drawn backwards through its segments' lattices by numbers that only the seed, the
        row's key, the segment's number in the text and the place in it decide.
        """
        split = [self.segment(" " + t) if t else [] for t in texts]
        if self.edges > MOST_EDGES:
            self.clear()
        new = list(set(chain.from_iterable(split)) - self.end.keys())
        for at in range(0, len(new), 20_000):
            self.add(new[at : at + 20_000])
        n = np.array([len(s) for s in split], np.int64)
        now = np.fromiter(map(self.end.__getitem__, chain.from_iterable(split)), np.int64, n.sum())
        salt = np.array([xxhash.xxh64_intdigest(str(k).encode(), seed) for k in keys], np.uint64)
        within = np.arange(len(now)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
        salt = _mixed(np.repeat(salt, n) + within.astype(np.uint64) * _M)
        length = np.zeros(len(now), np.int64)
        active, steps, left = np.arange(len(now)), [], now.copy()
        while len(active):
            draw = (_mixed(salt[active] + (now[active] - left).astype(np.uint64)) >> np.uint64(11)) * (1.0 / (1 << 53))
            edge = self.first[left]
            beyond = np.flatnonzero(draw >= self.upto[edge])
            while len(beyond):
                edge[beyond] += 1
                beyond = beyond[draw[beyond] >= self.upto[edge[beyond]]]
            steps.append((active, self.piece[edge]))
            length[active] += 1
            left = self.back[edge]
            more = self.first[left + 1] > self.first[left]
            active, left = active[more], left[more]
        offset = np.cumsum(length)
        out = np.empty(int(offset[-1]) if len(offset) else 0, np.int64)
        for k, (some, ids) in enumerate(steps):  # the k-th drawn is the k-th from the segment's end
            out[offset[some] - 1 - k] = ids
        per_text = np.add.reduceat(np.r_[length, 0], np.minimum(np.r_[0, np.cumsum(n)[:-1]], len(length))) * (n > 0) if len(n) else n
        virtual = np.flatnonzero(out >= len(self.model.raw))
        if len(virtual):
            spelled = [chr(_SPACE if c == _MARK else c).encode() for c in (out[virtual] - len(self.model.raw)).tolist()]
            sizes = np.ones(len(out), np.int64)
            sizes[virtual] = list(map(len, spelled))
            owner = np.repeat(np.repeat(np.arange(len(n)), per_text), sizes)
            out = np.repeat(out, sizes)
            out[out >= len(self.model.raw)] = self.model.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
            per_text = np.bincount(owner, minlength=len(n))
        return np.split(out.astype(np.int32), np.cumsum(per_text)[:-1]) if len(n) else []


def _roll(key: np.ndarray, char: np.ndarray) -> np.ndarray:
    key = (key ^ (char + np.uint64(1))) * _M
    return key ^ (key >> np.uint64(29))


def _rolled(chars: np.ndarray) -> np.ndarray:
    key = np.zeros(len(chars), np.uint64)
    for k in range(chars.shape[1]):
        key = _roll(key, chars[:, k])
    return key


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def joined(ids: np.ndarray, raw: list[bytes]) -> bytes:
    """The bytes that ids spell, without the space that encoding puts in front."""
    return b"".join(map(raw.__getitem__, ids.tolist()))[1:]


def sample_encode(
    docs: DataFrame, model: PieceModel, *, seed: int = 0, key: str = "doc_id", text: str = "text", only: list[str] | None = None, keep: list[str] | None = None,
) -> DataFrame:
    """docs with ids (array<int>), n_pieces, ids_sha256 (of little-endian 32-bit ids) and lossless; `only` names some.

    A segmentation is drawn with a probability in proportion to the product of its pieces' weights. The same seed, row
    key and text give the same ids, however the rows are dealt out. `lossless` says that decoding gave the text's bytes.

    Edge cases: a null text has null ids, an empty one no ids; both count 0 pieces and are lossless. A null key is a
    key like another. Repeated rows get the same ids each; columns of the same names give way.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in [("ids", "array<int>"), ("n_pieces", "long"), ("ids_sha256", "string"), ("lossless", "boolean")] if only is None or f[0] in only]

    def task():
        sampler, raw = Sampler(held.value), held.value.raw

        def make(batch):
            texts = column_strings(batch, text)
            found = sampler.sample(texts, batch.column(batch.schema.get_field_index(key)).to_pylist(), seed)
            made = {}
            for name, _ in fields:
                if name == "ids":
                    made[name] = [None if t is None else f for t, f in zip(texts, found, strict=True)]
                elif name == "n_pieces":
                    made[name] = [len(f) for f in found]
                elif name == "ids_sha256":
                    made[name] = [hashlib.sha256(f.astype("<i4").tobytes()).hexdigest() for f in found]
                else:
                    made[name] = [joined(f, raw) == (t or "").encode() for t, f in zip(texts, found, strict=True)]
            return list(made.values())

        return make

    return with_columns(docs, fields, task, keep)


def decode(docs: DataFrame, model: PieceModel, *, ids: str = "ids", into: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """docs with the text that `ids` spell. Null ids give null; bytes that aren't UTF-8 become U+FFFD."""
    held = docs.sparkSession.sparkContext.broadcast(model.raw)

    def task():
        def make(batch):
            column = batch.column(batch.schema.get_field_index(ids))
            return [[None if not x.is_valid else joined(np.asarray(x.values), held.value).decode(errors="replace") for x in column]]

        return make

    return with_columns(docs, [(into, "string")], task, keep)
