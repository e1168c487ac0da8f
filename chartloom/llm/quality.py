"""Quality: random-indexing word vectors pooled per document, then a small calibrated network.

Each word has two hashed symbols: itself, and its shape (runs of lower case,
upper case, digits, other letters; marks as they are).  Each symbol has a fixed
sparse random index vector, drawn by hash.  The context vector of a symbol is the
sum of the index vectors of the words beside it over the whole corpus; as that
is a sum of integers, partial sums of any partitioning add up to the same vectors.
A document is pooled into the mean and spread of its normalised vectors and the
mean step between neighbours.
A network of two layers, written in numpy, learns quality from a bounded
sample; a temperature fitted on a part it has not seen calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .labelled import remainder, train
from .scratch import Scratch, small_batches, tidy

BUCKETS = 1 << 14
DIMS = 32
INPUTS = 4 * DIMS + 2
"""Mean and spread for words and for shapes, the mean step, the log of the length."""
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48
_CLASS[128:] = 128


def shapes(w: W.Words) -> np.ndarray:
    """Hash of the class runs of each word."""
    kind = _CLASS[w.buf]
    fresh = np.ones(len(kind), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[w.starts] = True
    place = np.cumsum(fresh)
    some = kind[fresh]
    up, down = W.powers(W.BASE, len(some))
    with np.errstate(over="ignore"):
        total = np.zeros(len(some) + 1, np.uint64)
        np.cumsum(W.BYTE_VALUE[some] * up[: len(some)], out=total[1:])
        a, b = place[w.starts] - 1, place[w.ends - 1]
        return W.mix((total[b] - total[a]) * down[a], 3)


def symbols(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, shape hashes)."""
    return w.hashes, shapes(w)


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 14)).astype(np.int64)


def accumulate(w: W.Words, into: np.ndarray) -> None:
    """Adds to each symbol's context vector the index vectors of its neighbours."""
    words, shape = symbols(w)
    n = len(words)
    if n < 2:
        return
    beside = np.ones(n - 1, bool)
    edges = w.first[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    beside[edges - 1] = False
    left = np.flatnonzero(beside)
    mine = bucket(words), bucket(shape) + BUCKETS
    cells, signs = [], []
    for a, b in ((left, left + 1), (left + 1, left)):
        for h in (words, shape):
            x = W.mix(h[b], 41)
            dim, sign = (x >> np.uint64(59)).astype(np.int64), ((x & np.uint64(1)).astype(np.int8) * 2 - 1)
            for own in mine:
                cells.append(own[a] * DIMS + dim)
                signs.append(sign)
    cells, signs = np.concatenate(cells), np.concatenate(signs)
    into += np.bincount(cells, signs, into.size).astype(np.int64)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(2 * BUCKETS * DIMS, np.int64)
    for batch in batches:
        for _, _, w in W.rows(batch, "text"):
            accumulate(w, total)
    yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column(0):
            one = np.frombuffer(x.as_buffer(), "<i8")
            total = one.copy() if total is None else total + one
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def pooled(w: W.Words, vectors: np.ndarray) -> np.ndarray:
    """What the vectors of each text's words and shapes come to (see ``INPUTS``)."""
    n = np.diff(w.first)
    some = np.flatnonzero(n)
    out = np.zeros((len(n), INPUTS), np.float32)
    if len(some):
        count = n[some, None].astype(np.float32)
        for k, h in enumerate(symbols(w)):
            v = vectors[bucket(h) + k * BUCKETS]
            mean = np.add.reduceat(v, w.first[:-1][some], axis=0) / count
            square = np.add.reduceat(v * v, w.first[:-1][some], axis=0) / count
            out[some, 2 * k * DIMS : (2 * k + 1) * DIMS] = mean
            out[some, (2 * k + 1) * DIMS : (2 * k + 2) * DIMS] = np.sqrt(np.maximum(square - mean * mean, 0))
            if k == 0 and len(v) > 1:
                # How far neighbouring words are apart: little where one word is repeated.
                step = np.zeros(len(v), np.float32)
                step[1:] = np.square(v[1:] - v[:-1]).sum(1)
                step[w.first[:-1][some]] = 0
                out[some, -2] = np.add.reduceat(step, w.first[:-1][some]) / np.maximum(count[:, 0] - 1, 1)
    out[:, -1] = np.log1p(n)
    return out


class Network:
    """Two layers with tanh between, trained by Adam; probabilities are calibrated by a temperature."""

    def __init__(self, inputs: int, hidden: int = 24, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w1 = rng.normal(0, inputs**-0.5, (inputs, hidden))
        self.b1 = np.zeros(hidden)
        self.w2 = rng.normal(0, hidden**-0.5, hidden)
        self.b2 = np.zeros(1)
        self.mean, self.scale = np.zeros(inputs), np.ones(inputs)
        self.temperature, self.shift = 1.0, 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x) / self.temperature + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, share: float, rounds: int = 250, rate: float = 0.01, decay: float = 1e-3) -> Network:
        if not len(y) or y.min() == y.max():
            self.w2[:] = 0
            self.shift = float(np.log(share / (1 - share)))
            return self
        rng = np.random.default_rng(11)
        order = rng.permutation(len(y))
        cut = max(1, len(y) // 5)
        test, use = order[:cut], order[cut:]
        self.mean, self.scale = x[use].mean(0), x[use].std(0) + 1e-6
        parts = [self.w1, self.b1, self.w2, self.b2]
        m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
        scaled = np.clip((x[use] - self.mean) / self.scale, -6, 6)
        t = 0
        for _ in range(rounds // 10):
            for batch in np.array_split(rng.permutation(len(use)), max(1, len(use) // 256)):
                a, b = scaled[batch], y[use][batch]
                h = np.tanh(a @ self.w1 + self.b1)
                g = (1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2[0], -40, 40))) - b) / len(b)
                gh = np.outer(g, self.w2) * (1 - h * h)
                grads = [a.T @ gh + decay * self.w1, gh.sum(0), h.T @ g + decay * self.w2, np.array([g.sum()])]
                t += 1
                for i, (p, d) in enumerate(zip(parts, grads)):
                    m[i] = 0.9 * m[i] + 0.1 * d
                    v[i] = 0.999 * v[i] + 0.001 * d * d
                    p -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        z = self.logits(x[test])
        losses = [np.mean(np.logaddexp(0, np.where(y[test] == 1, -1, 1) * z / k)) for k in _TEMPERATURES]
        self.temperature = float(_TEMPERATURES[int(np.argmin(losses))])
        here = y.mean()
        self.shift = float(np.log(share / (1 - share)) - np.log(here / (1 - here)))
        return self


_TEMPERATURES = np.geomspace(0.5, 8, 33)


def text_pools(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    found = [pooled(w, vectors) for _, _, w in W.rows(batch, "text")]
    return np.concatenate(found).astype(np.float64) if found else np.zeros((0, INPUTS))


def _scorer(model: Network, vectors: np.ndarray, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.probability(pooled(w, vectors).astype(np.float64)) for _, _, w in W.rows(batch, "text")]
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return run


class QualityClassifier:
    """Scores texts for quality; a null text is empty and scored as such.

    Word vectors come from every text of ``docs``.  The network learns from at
    most ``each`` texts of either label whose crc32(id) modulo ``folds`` is not
    ``held``; only the text is an input.  Ids may repeat; a null id counts as not
    held out.  Other columns are ignored by ``score``; empty tables give an empty result, and
    without labels of both kinds every score is the prior.
    """

    def __init__(self, each: int = 1500, folds: int = 3, held: int = 1):
        self.each, self.folds, self.held = each, folds, held

    def vectors(self, docs: DataFrame) -> np.ndarray:
        """Unit context vectors by bucket: words first, then shapes.  A fixed number of bytes."""
        scratch = Scratch(docs.sparkSession)
        sums = scratch.keep(docs.select("text").mapInArrow(tidy(_vectors), "sums binary"), "sums")
        for width in (64, 1):
            sums = scratch.keep(sums.coalesce(width).mapInArrow(tidy(_add), "sums binary"), f"sums{width}")
        row = sums.first()
        total = np.frombuffer(row["sums"], "<i8").reshape(-1, DIMS).astype(np.float32) if row else np.zeros((2 * BUCKETS, DIMS), np.float32)
        norm = np.sqrt((total * total).sum(1, keepdims=True))
        return (total / np.maximum(norm, 1)).astype(np.float32)

    def train(self, docs: DataFrame, labels: DataFrame, vectors: np.ndarray) -> Network:
        allowed = remainder(F.col("doc_id"), self.folds) != self.held
        fit = lambda texts, marks, share: Network(INPUTS).fit(text_pools(texts, vectors), np.array(marks, np.float64), share)
        return train(docs.select("doc_id", "text"), labels, "quality", allowed, self.each, fit)

    def score(self, docs: DataFrame, labels: DataFrame) -> DataFrame:
        """(doc_id, held_out, score, predicted), a row for each row of ``docs``."""
        small_batches(docs.sparkSession)
        vectors = self.vectors(docs)
        model = self.train(docs, labels, vectors)
        held = F.coalesce(remainder(F.col("doc_id"), self.folds) == self.held, F.lit(False))
        src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
        return src.mapInArrow(tidy(_scorer(model, vectors, ["doc_id", "held_out"])), "doc_id long, held_out boolean, score double, predicted int")

    def filter(self, docs: DataFrame, labels: DataFrame) -> DataFrame:
        """``docs`` without the rows that the classifier rejects; all columns stay."""
        small_batches(docs.sparkSession)
        vectors = self.vectors(docs)
        model = self.train(docs, labels, vectors)
        score = f"{'_'.join(docs.columns)}_score"
        run = _judge(model, vectors, score)
        kept = docs.mapInArrow(tidy(run), docs.select("*", F.lit(True).alias(score)).schema)
        return kept.where(score).drop(score)


def _judge(model: Network, vectors: np.ndarray, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.probability(pooled(w, vectors).astype(np.float64)) for _, _, w in W.rows(batch, "text")]
            good = np.concatenate(scores) >= 0.5 if scores else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(good)], names=[*batch.schema.names, name])

    return run
