"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Each text is the set of its hashed n-grams of three to five characters (ASCII
letters in lower case).  From a bounded sample of labelled texts come the ratio
r of every feature, the log of its smoothed share among toxic texts over that
among others, and a logistic regression on the features scaled by r.  Every text
is scored whole; the sample's balance is corrected to the share of
toxic labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .labelled import remainder, train
from .scratch import small_batches, tidy

BITS = 18
SIZES = (3, 4, 5)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def characters(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points with ASCII letters in lower case, and the offsets of the texts in them."""
    points = np.frombuffer(W.LOWER[buf].tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offsets]
    return points, ends


def ngrams(points: np.ndarray) -> list[np.ndarray]:
    """Feature numbers of the n-grams that begin at each character, for each size."""
    with np.errstate(over="ignore"):
        x = points.astype(np.uint64) + np.uint64(7)
        h, power, out = x.copy(), _STEP, []
        for n in range(2, max(SIZES) + 1):
            if len(x) < n:
                h = h[:0]
            else:
                h = h[: len(x) - n + 1] + x[n - 1 :] * power
            power = power * _STEP
            if n in SIZES:
                g = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93 + 2 * n)
                out.append((g >> np.uint64(64 - BITS)).astype(np.int32))
        return out


class Featurizer:
    """Distinct feature numbers of one text after another; holds one stamp table."""

    def __init__(self):
        self.stamp = np.zeros(1 << BITS, np.int32)

    def each(self, buf: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        points, ends = characters(buf, offsets)
        grams = ngrams(points)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            found = np.concatenate([g[a : max(a, b - n + 1)] for g, n in zip(grams, SIZES)])
            order = np.arange(len(found), dtype=np.int32)
            self.stamp[found] = order
            yield found[self.stamp[found] == order]


def texts_features(texts: list[str]) -> list[np.ndarray]:
    buf, offsets = W.flat(pa.array(texts, pa.large_string()))
    f = Featurizer()
    return [x for a, b in W.runs(offsets) for x in f.each(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]


class NaiveBayesLinear:
    """The fitted model: a weight for each feature, already scaled by its ratio, and an intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights.astype(np.float32), float(intercept)

    def score(self, features: np.ndarray) -> float:
        z = float(self.weights[features].sum(dtype=np.float64)) + self.intercept
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(features: list[np.ndarray], labels: list[int], share: float, smooth: float = 1.0, ridge: float = 0.02, rounds: int = 80) -> NaiveBayesLinear:
    """Naive Bayes ratios and ridge logistic regression on four fifths, calibrated on the rest.

    Features of one text, or whose ratio is within a factor of 1.3 of none, are left out.
    The calibration is a logistic regression of the label on the score, its two sides
    weighed as ``share`` says.
    """
    size, y = 1 << BITS, np.array(labels, np.float64)
    test = np.arange(len(y)) % 5 == 4
    if min(y[~test].sum(), (1 - y[~test]).sum()) < 1:
        return NaiveBayesLinear(np.zeros(size), np.log(share / (1 - share)))
    flat = np.concatenate(features)
    owner = np.repeat(np.arange(len(y)), [len(f) for f in features])
    use = ~test[owner]
    toxic = np.bincount(flat[use], y[owner[use]], size) + smooth
    clean = np.bincount(flat[use], 1 - y[owner[use]], size) + smooth
    ratio = np.log(toxic / (y[~test].sum() + 2 * smooth)) - np.log(clean / ((1 - y[~test]).sum() + 2 * smooth))
    ratio[(toxic + clean - 2 * smooth < 2) | (np.abs(ratio) < np.log(1.3))] = 0.0
    keep = ratio[flat] != 0
    flat, owner = flat[keep], owner[keep]
    train = ~test[owner]
    f, o = flat[train], owner[train]
    scaled = ratio[f]
    w, b, n = np.zeros(size), 0.0, int((~test).sum())
    # The mean of squared norms bounds the curvature from below; steps shrink where the loss would rise.
    step = 16.0 / (np.bincount(o, scaled**2, len(y))[~test].mean() + 1.0)
    v, vb, t, last = w.copy(), b, 1.0, np.inf
    for _ in range(rounds):
        z = (np.bincount(o, scaled * v[f], len(y)) + vb)[~test]
        loss = np.logaddexp(0, np.where(y[~test] == 1, -z, z)).mean() + 0.5 * ridge * (v @ v) / n
        if loss > last:
            step, t, v, vb, last = step / 2, 1.0, w.copy(), b, np.inf
            continue
        last = loss
        g = np.zeros(len(y))
        g[~test] = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[~test]) / n
        nw, nb = v - step * (np.bincount(f, scaled * g[o], size) + ridge * v / n), vb - step * g.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    z = (np.bincount(owner, (w * ratio)[flat], len(y)) + b)[test]
    slope, shift = platt(z, y[test], share)
    return NaiveBayesLinear(w * ratio * slope, b * slope + shift)


def platt(z: np.ndarray, y: np.ndarray, share: float, rounds: int = 100) -> tuple[float, float]:
    """(slope, shift) of a logistic regression of y on z by damped Newton steps, with smoothed targets."""
    pos, neg = y.sum(), (1 - y).sum()
    if not pos or not neg:
        return 1.0, 0.0
    weight = np.where(y == 1, share / pos, (1 - share) / neg) * len(y)
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(1e-9, float(np.std(z)))
    x = np.stack([z / scale, np.ones(len(z))])
    a = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ x, -40, 40)))
        h = (x * (weight * p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        d = np.linalg.solve(h, x @ (weight * (p - target)) + 1e-3 * a)
        a = a - d * min(1.0, 2.0 / (np.abs(d).max() + 1e-12))
    return float(a[0] / scale), float(a[1])


def _scorer(model: NaiveBayesLinear):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Featurizer()
        for batch in batches:
            buf, offsets = W.flat(batch.column("text"))
            scores = [model.score(x) for a, b in W.runs(offsets) for x in f.each(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return run


class ToxicityClassifier:
    """Scores texts for toxicity; a null text is empty and scored as such.

    Learns from at most ``each`` texts of either label whose crc32(id) modulo
    ``folds`` is not ``held``; only the text is an input.  Ids may repeat; a null
    id counts as not held out.  Other columns are ignored; empty tables give an
    empty result, and without labels of both kinds every score is the prior.
    """

    def __init__(self, each: int = 1200, folds: int = 5, held: int = 0):
        self.each, self.folds, self.held = each, folds, held

    def train(self, docs: DataFrame, labels: DataFrame) -> NaiveBayesLinear:
        allowed = remainder(F.col("doc_id"), self.folds) != self.held
        return train(docs.select("doc_id", "text"), labels, "toxic", allowed, self.each, lambda texts, marks, share: fit(texts_features(texts), marks, share))

    def score(self, docs: DataFrame, model: NaiveBayesLinear) -> DataFrame:
        """(doc_id, held_out, score, predicted), a row for each row of ``docs``."""
        small_batches(docs.sparkSession)
        held = F.coalesce(remainder(F.col("doc_id"), self.folds) == self.held, F.lit(False))
        src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))
        return src.mapInArrow(tidy(_scorer(model)), "doc_id long, held_out boolean, score double, predicted int")
