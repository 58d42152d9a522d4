"""Quality: a generalised additive model with pairwise interactions, scored by adding bins of lookup tables."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_strings, slices, with_columns

FEATURES = [
    "log_words", "mean_word", "distinct_words", "top_word", "repeats_of_last", "symbols", "digits", "uppers", "marks", "bars",
    "log_lines", "words_a_line", "repeated_lines", "line_ends", "short_words", "long_words", "capitals", "symbol_words", "compression", "other_letters",
]
_SYMBOLS, _ENDS = re.compile(r"[#*$%&|<>]"), (".", "!", "?")
_DIGITS, _MARKS = re.compile(r"[0-9]"), re.compile(r"[!?.,;:]")


def features(text: str | None, compress) -> list[float]:
    """FEATURES of a whole text; all 0 for null or a text without words."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    n, chars = len(words), len(text)
    kinds = Counter(words)
    sizes = list(map(len, words))
    lines = [x for x in text.split("\n") if x.strip()]
    symbols = len(_SYMBOLS.findall(text))
    raw = text.encode(errors="replace")
    return [
        np.log1p(n), sum(sizes) / n, len(kinds) / n, max(kinds.values()) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        symbols / n, len(_DIGITS.findall(text)) / n, sum(w.isupper() and len(w) > 1 for w in words) / n, len(_MARKS.findall(text)) / n, text.count("|") / n,
        np.log1p(len(lines)), n / len(lines), 1 - len(set(lines)) / len(lines), sum(x.rstrip().endswith(_ENDS) for x in lines) / len(lines), sum(s <= 2 for s in sizes) / n,
        sum(s >= 12 for s in sizes) / n, sum(w[0].isupper() for w in words) / n, sum(w[-1] in "#*$%&|<>!" for w in words) / n, len(compress(raw)) / len(raw), (len(raw) - chars) / chars,
    ]


@dataclass
class AdditiveModel:
    """bias + a table for each feature + a table for each chosen pair of features, by bins."""

    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for rows of features: only lookups and additions."""
        z = np.full(len(x), self.bias)
        for f, table in enumerate(self.tables):
            z += table[np.searchsorted(self.edges[f], x[:, f], "right")]
        for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[np.searchsorted(self.pair_edges[f], x[:, f], "right"), np.searchsorted(self.pair_edges[g], x[:, g], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(slope: np.ndarray, weight: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Values by bin of a shallow tree that is grown greedily on bins' sums of slopes and of curvatures."""
    s, w = np.r_[0.0, np.cumsum(slope)], np.r_[0.0, np.cumsum(weight)]
    gain = lambda a, b: (s[b] - s[a]) ** 2 / (w[b] - w[a] + ridge)
    parts = [(0, len(slope))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a > 1:
                cuts = np.arange(a + 1, b)
                gains = gain(a, cuts) + gain(cuts, b) - gain(a, b)
                k = int(gains.argmax())
                if gains[k] > best[0]:
                    best = (float(gains[k]), (a, b), int(cuts[k]))
        if best[1] is None:
            break
        (a, b), cut = best[1], best[2]
        parts = [p for p in parts if p != (a, b)] + [(a, cut), (cut, b)]
    out = np.empty(len(slope))
    for a, b in parts:
        out[a:b] = (s[b] - s[a]) / (w[b] - w[a] + ridge)
    return out


def _pair_tree(slope: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Values by cell of the best tree with one cut of each axis, and its gain over one value for all."""
    s, w = np.zeros(np.add(slope.shape, 1)), np.zeros(np.add(slope.shape, 1))
    s[1:, 1:], w[1:, 1:] = slope.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    i, j = np.arange(1, slope.shape[0])[:, None], np.arange(1, slope.shape[1])[None]
    if not i.size or not j.size:
        return np.zeros(slope.shape), 0.0
    quarters = [(s[i, j], w[i, j]), (s[i, -1] - s[i, j], w[i, -1] - w[i, j]), (s[-1, j] - s[i, j], w[-1, j] - w[i, j])]
    quarters.append((s[-1, -1] - sum(q[0] for q in quarters), w[-1, -1] - sum(q[1] for q in quarters)))
    gains = sum(a**2 / (b + ridge) for a, b in quarters) - s[-1, -1] ** 2 / (w[-1, -1] + ridge)
    k = np.unravel_index(int(gains.argmax()), gains.shape)
    made = np.empty(slope.shape)
    value = [a[k] / (b[k] + ridge) for a, b in quarters]
    x, y = k[0] + 1, k[1] + 1
    made[:x, :y], made[:x, y:], made[x:, :y], made[x:, y:] = value
    return made, float(gains[k])


def fit(x: np.ndarray, labels: np.ndarray, *, bins: int = 32, pair_bins: int = 8, n_pairs: int = 8, rounds: int = 150, pair_rounds: int = 60, rate: float = 0.08, leaves: int = 3, ridge: float = 5.0) -> AdditiveModel:
    """Cyclic boosting: every round gives each feature in turn one shallow tree on what is left to explain. Then the
    n_pairs pairs that explain most of the rest are boosted the same way.
    """
    k = x.shape[1]
    if not len(x) or labels.min() == labels.max():
        base = float(np.clip(labels.mean() if len(x) else 0.5, 0.001, 0.999))
        return AdditiveModel(float(np.log(base / (1 - base))), [np.empty(0)] * k, [np.zeros(1)] * k, [], [np.empty(0)] * k, [])
    edges, coarse = ([_quantiles(x[:, f], b) for f in range(k)] for b in (bins, pair_bins))
    at = [np.searchsorted(edges[f], x[:, f], "right") for f in range(k)]
    small = [np.searchsorted(coarse[f], x[:, f], "right") for f in range(k)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    mean = labels.mean()
    bias = float(np.log(mean / (1 - mean)))
    z = np.full(len(x), bias)

    def rest():
        p = 1 / (1 + np.exp(-z))
        return labels - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(k):
            slope, weight = rest()
            size = len(tables[f])
            step = rate * _tree(np.bincount(at[f], slope, size), np.bincount(at[f], weight, size), leaves, ridge)
            tables[f] += step
            z += step[at[f]]

    def cells(f, g):
        slope, weight = rest()
        shape = len(coarse[f]) + 1, len(coarse[g]) + 1
        cell = small[f] * shape[1] + small[g]
        return (np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (slope, weight))

    gains = {(f, g): _pair_tree(*cells(f, g), ridge)[1] for f in range(k) for g in range(f)}
    pairs = sorted(gains, key=lambda p: (-gains[p], p))[:n_pairs]
    pair_tables = [np.zeros((len(coarse[f]) + 1, len(coarse[g]) + 1)) for f, g in pairs]
    for _ in range(pair_rounds):
        for (f, g), table in zip(pairs, pair_tables, strict=True):
            step = rate * _pair_tree(*cells(f, g), ridge)[0]
            table += step
            z += step[small[f], small[g]]
    return AdditiveModel(bias, edges, tables, pairs, coarse, pair_tables)


def learn_quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", doc_id: str = "doc_id", text: str = "text", rows: int = 16000, **options) -> AdditiveModel:
    """A model learned from at most `rows` labelled rows, those with the smallest hash of the id.

    Only the sample's features reach the driver. Labels other than 0 and 1, null ids and ids without a document are
    left out; a document with several label rows counts for each. Ids are whole numbers, or text that
    is one. Without both labels the model scores their mean.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), F.col(label).cast("int").alias("label"))
    picked = known.orderBy(F.xxhash64("doc", F.lit(10)), "doc").limit(rows)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))

    def measure(batches):
        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in slices(batch):
                made = [np.array(features(t, compress)).tobytes() for t in column_strings(part, "text")]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.binary())], names=["doc", "label", "x"])

    # the sample is bounded by its limit, so broadcasting it and gathering its features is safe at any size of the tables;
    # the exchange makes one job with a task for each input split, not one job a split
    found = texts.join(F.broadcast(picked), "doc").select("doc", "label", "text").mapInArrow(measure, "doc long, label int, x binary")
    got = sorted((r["doc"], r["label"], bytes(r["x"])) for r in found.repartition(1).toLocalIterator())
    x = np.frombuffer(b"".join(g[2] for g in got)).reshape(-1, len(FEATURES))
    return fit(x, np.array([g[1] for g in got], float), **options)


def score_quality(docs: DataFrame, model: AdditiveModel, *, text: str = "text", threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from `threshold` on), for every whole text.

    Edge cases: null and empty texts and texts of white space have features of 0 and are scored by them. Repeated rows
    get a row each; columns of the same names give way.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def task():
        model, compress = held.value, zstandard.ZstdCompressor(level=1).compress

        def make(batch):
            x = np.array([features(t, compress) for t in column_strings(batch, text)]).reshape(-1, len(FEATURES))
            scores = model.score(x)
            return [scores, (scores >= threshold).astype(np.int32)]

        return make

    return with_columns(docs, [("score", "double"), ("predicted", "int")], task, keep)
