"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_strings, slices, with_columns

_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that are terms beside the whole word: compounds keep their stem there.
BEGINNINGS = range(3, 9)
BITS = 20


def terms(word: str) -> list[int]:
    """Hashed terms of a lower-cased word: itself and its beginnings."""
    mask = (1 << BITS) - 1
    made = [xxhash.xxh32_intdigest("=" + word) & mask]
    return made + [xxhash.xxh32_intdigest("^" + word[:k]) & mask for k in BEGINNINGS if len(word) > k]


class _Known(dict):
    """The terms among `wanted` (all if None) of each word, as positions there; starts anew when it holds many words."""

    def __init__(self, wanted: np.ndarray | None):
        self.at = None if wanted is None else {int(t): k for k, t in enumerate(wanted)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 400_000:
            self.clear()
        found = terms(word)
        self[word] = made = tuple(found if self.at is None else [self.at[t] for t in found if t in self.at])
        return made


def counted(text: str | None, known: _Known) -> tuple[np.ndarray, np.ndarray, int]:
    """Terms of a text, how often each occurs, and the number of words."""
    words = _WORD.findall(text.lower()) if text else []
    found = [t for w in words for t in known[w]]
    ids, n = np.unique(np.array(found, np.int64), return_counts=True)
    return ids, n, len(words)


def values(n: np.ndarray, n_words) -> np.ndarray:
    """A term's value: grows with its count, and with its share of the text."""
    return (np.log1p(n) * 0.5 + np.minimum(1.0, 30.0 * n / np.maximum(30, n_words)) * 0.5).astype(np.float32)


@dataclass
class FactorizationMachine:
    """score = sigmoid(bias + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j) over the terms in `wanted`."""

    wanted: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, ids: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[ids] * x[:, None]
        z = self.bias + float(self.weights[ids] @ x) + 0.5 * float((v.sum(0) ** 2 - (v * v).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], labels: np.ndarray, shares: np.ndarray, *, rank: int = 4, epochs: int = 20, rate: float = 0.05, decay: float = 2e-2, sparsity: float = 0.1, doubt: float = 2.5, caution: float = 1e-2, batch: int = 256, seed: int = 7) -> FactorizationMachine:
    """A machine for rows of (hashed terms, counts, words). `shares` weighs rows, so that a stratified sample stands
    for its table. Every hashed term of the rows has a weight and factors, however rare: none is chosen by its own worth
    or by how often it occurs, as a term may matter only beside another one, and rare insults are what is looked for.
    The regularisation decides: weights are learned by follow the regularised leader, which holds those at 0 whose
    summed slopes stay below `sparsity`, or below `doubt` times their noise at the start, as rare words that fell to
    one label by chance do; a term is so held back by what its rows say, not by the size of the sample. Factors are
    learned for all terms, by damped steps that stay short (`caution`) for a term that has had few slopes, so that rare
    terms don't spell out single rows. A slope is divided by `batch`, not by the number of rows, so a term's slopes add
    up to the same in a large sample as in a small one.
    """
    if not len(rows) or labels.min() == labels.max():
        base = float(np.clip(labels.mean() if len(rows) else 0.0, 0.001, 0.999))
        return FactorizationMachine(np.empty(0, np.int64), float(np.log(base / (1 - base))), np.empty(0, np.float32), np.empty((0, rank), np.float32))
    seen = np.zeros(1 << BITS, bool)
    for r in rows:
        seen[r[0]] = True
    wanted, at = np.flatnonzero(seen), (np.cumsum(seen) - 1).astype(np.int32)

    rng = np.random.default_rng(seed)
    prior = float(np.average(labels, weights=shares))
    bias, w, v = float(np.log(prior / (1 - prior))), np.zeros(len(wanted)), rng.normal(0, 0.01, (rank, len(wanted)))
    gb, gw, gv, lead = 1e-6, np.full(len(wanted), 1e-6), np.full((rank, len(wanted)), caution), np.zeros(len(wanted))
    weight = shares / shares.mean()
    damp = decay / len(rows) * batch
    order = rng.permutation(len(rows))
    batches = []
    for some in (order[k : k + batch] for k in range(0, len(rows), batch)):
        n = np.array([len(rows[k][0]) for k in some])
        used, i = np.unique(at[np.concatenate([rows[k][0] for k in some])], return_inverse=True)
        x = values(np.concatenate([rows[k][1] for k in some]), np.repeat([rows[k][2] for k in some], n))
        batches.append((some, np.repeat(np.arange(len(some), dtype=np.int32), n), used, i.astype(np.int32), x))
    slope = (prior - labels) * weight
    total, noise = np.zeros(len(wanted)), np.full(len(wanted), 1e-12)
    for some, r, used, i, xs in batches:
        total[used] += np.bincount(i, slope[some][r] * xs, len(used))
        noise[used] += np.bincount(i, (slope[some][r] * xs) ** 2, len(used))
    margin = np.where(np.abs(total) >= doubt * np.sqrt(noise), sparsity, np.inf)
    for _ in range(epochs):
        for some, r, used, i, xs in (batches[k] for k in rng.permutation(len(batches))):
            vu = v[:, used]
            vx = vu[:, i] * xs
            total = np.stack([np.bincount(r, each, len(some)) for each in vx])
            squares = np.bincount(r, (vx * vx).sum(0), len(some))
            score = bias + np.bincount(r, w[used][i] * xs, len(some)) + 0.5 * ((total**2).sum(0) - squares)
            slope = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[some]) * weight[some] / batch
            sx = slope[r] * xs
            dw = np.bincount(i, sx, len(used))
            dv = np.stack([np.bincount(i, sx * (t[r] - each), len(used)) for t, each in zip(total, vx, strict=True)]) + damp * vu
            gb += slope.sum() ** 2
            bias -= rate * slope.sum() / np.sqrt(gb)
            before = np.sqrt(gw[used])
            gw[used] += dw**2
            now = np.sqrt(gw[used])
            lead[used] += dw - (now - before) / rate * w[used]
            w[used] = -np.sign(lead[used]) * np.maximum(0, np.abs(lead[used]) - margin[used]) / (now / rate + decay)
            gv[:, used] += dv**2
            v[:, used] = vu - rate * dv / np.sqrt(gv[:, used])
    return FactorizationMachine(wanted, bias, w.astype(np.float32), np.ascontiguousarray(v.T, np.float32))


def learn_toxicity(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", rows_per_label: int = 4000, **options) -> FactorizationMachine:
    """A machine learned from a bounded sample of labelled rows: at most about `rows_per_label` of each label.

    The sample is those rows whose hash of the id is smallest, whatever the size of the tables; only their term counts
    reach the driver. Labels other than 0 and 1, null ids and ids without a document are left out; a document with
    several label rows counts for each. Ids are whole numbers, or text that is one. Without both labels the machine scores their mean everywhere.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), F.col(label).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    at = F.xxhash64("doc", F.lit(5))
    picked = None
    for value, _ in sorted(counts.items()):
        some = known.where(F.col("label") == value).orderBy(at, "doc").limit(rows_per_label)
        picked = some if picked is None else picked.unionByName(some)
    if picked is None:
        return fit([], np.empty(0), np.empty(0), **options)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))

    def count(batches):
        known = _Known(None)
        for batch in batches:
            for part in slices(batch):
                made = [counted(t, known) for t in column_strings(part, "text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([m[0].astype(np.int32).tobytes() for m in made], pa.binary()), pa.array([m[1].astype(np.int32).tobytes() for m in made], pa.binary()), pa.array([m[2] for m in made], pa.int64())],
                    names=["doc", "label", "ids", "n", "words"],
                )

    # the sample is bounded by its limits, so broadcasting it and gathering its counts is safe at any size of the tables;
    # the exchange makes one job with a task for each input split, not one job a split
    found = texts.join(F.broadcast(picked), "doc").select("doc", "label", "text").mapInArrow(count, "doc long, label int, ids binary, n binary, words long")
    rows, marks, keys = [], [], []
    for r in found.repartition(1).toLocalIterator():
        rows.append((np.frombuffer(r["ids"], np.int32).astype(np.int64), np.frombuffer(r["n"], np.int32).astype(np.int64), r["words"]))
        marks.append(r["label"])
        keys.append((r["doc"], r["label"], xxhash.xxh64_intdigest(bytes(r["ids"]))))
    order = sorted(range(len(rows)), key=keys.__getitem__)  # not as the tasks happened to end
    marks = np.array(marks, np.int64)[order]
    share = np.array([counts[int(m)] / max(1, int((marks == m).sum())) for m in marks])
    return fit([rows[k] for k in order], marks, share, **options)


def score_toxicity(docs: DataFrame, model: FactorizationMachine, *, text: str = "text", threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from `threshold` on), for every whole text.

    Edge cases: null or empty texts and texts without known terms get the machine's bias as score. Repeated rows get a
    row each; columns of the same names give way.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def task():
        model = held.value
        known = _Known(model.wanted)

        def make(batch):
            scores = []
            for value in column_strings(batch, text):
                ids, n, words = counted(value, known)
                scores.append(model.score(ids, values(n, words)))
            return [scores, [int(s >= threshold) for s in scores]]

        return make

    return with_columns(docs, [("score", "double"), ("predicted", "int")], task, keep)
