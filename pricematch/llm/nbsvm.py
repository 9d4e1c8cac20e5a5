"""Quality classifier: n-gram indicators scaled by naive Bayes ratios under a linear hinge-loss model."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, text_bytes
from .shingles import WordHashes, shingle_row

BITS = 18
_RUN = re.compile(rb"(.)\1+")
_SHAPE_TABLE = bytes(
    97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256)
)


class Grams:
    """Distinct n-grams of a text as bucket numbers below 2**BITS: triples of bytes, pairs of word shapes
    (letters, capitals and digits as one sign each, runs as one), and how often three-word windows recur."""

    def __init__(self) -> None:
        self.words, self.shapes = WordHashes(), WordHashes()
        self.seen = np.zeros(1 << BITS, bool)
        self.of_word: dict[bytes, int] = {}

    def shape(self, word: bytes) -> int:
        out = self.of_word.get(word)
        if out is None:
            if len(self.of_word) > 300_000:
                self.of_word.clear()
            out = self.of_word[word] = self.shapes[_RUN.sub(rb"\1", word.translate(_SHAPE_TABLE))]
        return out

    def of(self, raw: bytes) -> np.ndarray:
        seen, top = self.seen, np.uint64(64 - BITS)
        seen[:] = False
        if len(raw) > 2:
            b = np.frombuffer(raw, np.uint8).astype(np.uint32)
            triples = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
            seen[(triples * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)] = True
        words = raw.split()
        if words:
            shapes = np.fromiter(map(self.shape, words), np.uint64, len(words))
            seen[shingle_row(shapes, 2) >> top] = True
            windows = shingle_row(self.words.of(words), 3)
            distinct = len(np.unique(windows)) / len(windows)
            level = np.array([1000 + int(distinct * 10), 2000 + min(int(np.log2(len(words))), 12)], np.uint64)
            seen[(level * np.uint64(0x9E3779B97F4A7C15)) >> top] = True
        return np.flatnonzero(seen)


def _grams() -> Grams:
    return held("grams", Grams)


@dataclass
class Model:
    """``weights`` already hold the ratios; ``squares`` are the ratios' squares, for the length of a row."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, grams: np.ndarray) -> float:
        norm = float(np.sqrt(self.squares[grams].sum(dtype=np.float64))) or 1.0
        return float(self.weights[grams].sum(dtype=np.float64)) / norm + self.bias

    def score(self, grams: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(grams) + self.shift, -500, 500))))


def ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """Log of the smoothed shares of each n-gram in the good and in the bad rows."""
    counts = [np.bincount(np.concatenate([r for r, g in zip(rows, good, strict=True) if g == side] or [np.zeros(0, int)]), minlength=1 << BITS) + 1.0 for side in (True, False)]
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def descend(rows: list[np.ndarray], good: np.ndarray, scale: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss: weights (times ``scale``) and bias.

    Rows are scaled to length 1. Each step sets one row's dual variable to its best value between 0 and
    ``cost`` and moves the weights by the difference.
    """
    rng = np.random.default_rng(seed)
    w, bias, dual = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    values = [scale[r] / (np.sqrt((scale[r] ** 2).sum()) or 1.0) for r in rows]
    sign = np.where(good, 1.0, -1.0)
    own = [float((v * v).sum()) + 1.0 for v in values]
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            r, v, y = rows[i], values[i], sign[i]
            slack = 1.0 - y * (float(w[r] @ v) + bias)
            new = min(max(dual[i] + slack / own[i], 0.0), cost)
            if new != dual[i]:
                step = (new - dual[i]) * y
                w[r] += step * v
                bias += step
                dual[i] = new
    return w, bias


def _sigmoid(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn margins into the chance of a good label, by Newton steps on smoothed targets."""
    pos, neg = good.sum(), (~good).sum()
    target = np.where(good, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        d, w = p - target, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(w * margins * margins).sum() + 1e-6, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, [(d * margins).sum(), d.sum()])
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(max(a, 1e-3)), float(b)


def train(rows: list[np.ndarray], good: np.ndarray) -> Model:
    """Ratios and weights on all rows; the sigmoid on margins of halves that the other half's model gives.

    With labels of one kind only, or none, every text gets the share of good labels (one half without any).
    """
    def fitted(some: np.ndarray) -> Model:
        part, y = [rows[i] for i in some], good[some]
        scale = ratios(part, y)
        w, bias = descend(part, y, scale)
        return Model(w * scale, scale**2, bias, 1.0, 0.0)

    every = np.arange(len(rows))
    halves = [every[::2], every[1::2]]
    if not len(rows) or any(len(set(good[h].tolist())) < 2 for h in halves):
        share = float(np.clip(good.mean() if len(rows) else 0.5, 0.01, 0.99))
        zero = np.zeros(1 << BITS)
        return Model(zero, zero, 0.0, 1.0, float(np.log(share / (1 - share))))
    margins = np.zeros(len(rows))
    for a, b in (halves, halves[::-1]):
        model = fitted(a)
        margins[b] = [model.margin(rows[i]) for i in b]
    out = fitted(every)
    out.slope, out.shift = _sigmoid(margins, good)
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on at most ``sample`` labelled documents (``quality`` 0 or 1), by the order of a hash of the id.

    Documents with two different labels, null ids and null labels teach nothing. Only texts are looked at.
    """
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("top"))
    known = known.filter("q = top").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("id"), "q")
    texts = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("raw")).join(F.broadcast(known), "id")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_grams().of(raw).astype("<u4").tobytes() for raw in batch.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("q"), pa.array(made, pa.binary())], names=["id", "q", "grams"])

    found = texts.select("id", F.col("q").cast("int").alias("q"), "raw").mapInArrow(grams, "id long, q int, grams binary")
    found = found.orderBy(F.xxhash64("id"), "id", "grams").limit(sample).collect()
    return train([np.frombuffer(r.grams, "<u4").astype(np.int64) for r in found], np.array([r.q == 1 for r in found], bool))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for each row: the chance of quality label 1, and 1 where it is at least a half.

    Null or empty text: no n-gram, so the score of the bias alone. Null and repeated ids: a row each. Equal texts
    get equal scores. Very long texts are read whole. No rows: none. Other columns are not read.
    """

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([model.score(_grams().of(raw)) for raw in batch.column("raw").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("raw"))
    return texts.mapInArrow(rate, "doc_id long, score double, predicted int")
