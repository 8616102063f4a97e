"""Quality classifier: n-gram indicators scaled by naive Bayes log-count ratios under a linear support vector machine.

Indicators (which n-grams a text holds, not how often) are hashed into
``DIMENSIONS`` features: byte trigrams, n-grams over the shapes of the text
(runs of capitals, letters, digits, signs), and steps of how many word n-grams
repeat one before.  Each feature is scaled by the log of the ratio of its
smoothed shares among the two classes; rows are brought to unit length; a
hinge-loss model is fitted by dual coordinate descent; a logistic curve
turns its margins into probabilities.

The model is fitted on a bounded sample of labelled rows (``max_rows``, the
rows with the smallest hash of their id); every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIGRAM_BITS, SHAPE_BITS = 15, 14
STEPS = np.array([0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
_REPEATS = (1 << TRIGRAM_BITS) + (1 << SHAPE_BITS)
DIMENSIONS = _REPEATS + 3 * (len(STEPS) + 1)
MAX_ROWS = 12_000
THRESHOLD = 0.7

_SPACE, _UPPER, _LETTER, _DIGIT = 0, 1, 2, 3
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[[9, 10, 11, 12, 13, 32]] = _SPACE
_SHAPE[ord("A") : ord("Z") + 1] = _UPPER
_SHAPE[ord("a") : ord("z") + 1] = _LETTER
_SHAPE[ord("0") : ord("9") + 1] = _DIGIT
_SHAPE[128:] = _LETTER


def _slots(grams: np.ndarray, bits: int) -> np.ndarray:
    return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _trigram_slots(data: np.ndarray) -> np.ndarray:
    wide = data.astype(np.uint32)
    grams = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    return (grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - TRIGRAM_BITS)


def _grams(codes: np.ndarray, size: int) -> np.ndarray:
    if len(codes) < size:
        return np.empty(0, np.uint64)
    out = np.full(len(codes) - size + 1, size, np.uint64)
    for j in range(size):
        out = (out << np.uint64(8)) | codes[j : len(codes) - size + 1 + j]
    return out


def _repeat_shares(words: list[bytes]) -> list[float]:
    """Shares of words equal to the word before, and of word pairs and 5-grams that occurred before."""
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)  # compared inside this text only
    shares = [float(np.mean(hashes[1:] == hashes[:-1])) if len(words) > 1 else 0.0]
    for size in (2, 5):
        count = len(words) - size + 1
        if count < 2:
            shares.append(0.0)
            continue
        mixed = np.zeros(count, np.uint64)
        for j in range(size):
            mixed = (mixed ^ hashes[j : j + count]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        shares.append(1 - len(np.unique(mixed)) / count)
    return shares


def indicators(text: str | None) -> np.ndarray:
    """The sorted features that a whole text holds."""
    raw = text.encode("utf-8", "replace") if text else b""
    held = np.zeros(DIMENSIONS, bool)
    data = np.frombuffer(raw, np.uint8)
    if len(data) > 2:
        held[_trigram_slots(data)] = True
    shapes = _SHAPE[data]
    if len(shapes):
        shapes = shapes[np.concatenate([[True], shapes[1:] != shapes[:-1]])].astype(np.uint64)
    for size in (2, 4, 6):
        held[(1 << TRIGRAM_BITS) + _slots(_grams(shapes, size), SHAPE_BITS)] = True
    words = raw.split()
    if words:
        for i, share in enumerate(_repeat_shares(words)):
            steps = int(np.searchsorted(STEPS, share, side="right"))
            first = _REPEATS + i * (len(STEPS) + 1)
            held[first : first + steps + 1] = True
    return np.flatnonzero(held)


@dataclass(frozen=True)
class Model:
    """score = 1 / (1 + exp(-(slope * margin + offset))), margin = weights . scaled unit row + bias."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, held: np.ndarray) -> float:
        scaled = self.ratios[held]
        length = float(np.sqrt(scaled @ scaled))
        return float(scaled @ self.weights[held]) / length + self.bias if length else self.bias

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(indicators(text)) + self.offset, -500, 500))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    counts = np.full((2, DIMENSIONS), smoothing)
    for held, label in zip(rows, labels, strict=True):
        counts[int(label), held] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_coordinate_descent(
    rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, costs: np.ndarray, rounds: int = 30, tolerance: float = 0.01
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + sum of costs * max(0, 1 - sign * (w . x + bias)).

    Each step solves the dual for one row exactly; the bias is the weight of
    a constant feature 1.  Ends when no projected gradient exceeds ``tolerance``.
    """
    weights, bias = np.zeros(DIMENSIONS), 0.0
    alphas = np.zeros(len(rows))
    squares = np.array([v @ v + 1.0 for v in values])
    order = np.random.default_rng(9)
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(len(rows)):
            gradient = signs[i] * (weights[rows[i]] @ values[i] + bias) - 1
            projected = min(gradient, 0.0) if alphas[i] <= 0 else max(gradient, 0.0) if alphas[i] >= costs[i] else gradient
            if projected == 0:
                continue
            worst = max(worst, abs(projected))
            before = alphas[i]
            alphas[i] = min(max(before - gradient / squares[i], 0.0), costs[i])
            step = (alphas[i] - before) * signs[i]
            weights[rows[i]] += step * values[i]
            bias += step
        if worst < tolerance:
            break
    return weights, bias


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve with smoothed targets, by Newton steps with a small ridge on the slope."""
    positive, negative = labels.sum(), (1 - labels).sum()
    targets = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    slope, offset = 1.0, float(np.log((positive + 1) / (negative + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -50, 50)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - targets) * margins).sum() + 1e-3 * slope, (p - targets).sum()])
        h = np.array([[(w * margins**2).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-6]])
        change = np.linalg.solve(h, g)
        change *= min(1.0, 5 / max(np.abs(change).max(), 1e-12))
        slope, offset = slope - change[0], offset - change[1]
        if np.abs(change).max() < 1e-8:
            break
    return float(slope), float(offset)


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0) -> Model:
    """Fits on three rows of four and sets the curve on the fourth; with one class only, a constant score."""
    positive, negative = int((labels == 1).sum()), int((labels == 0).sum())
    if positive < 2 or negative < 2:
        share = (positive + 1) / (positive + negative + 2)
        zeros = np.zeros(DIMENSIONS)
        return Model(zeros, zeros, 0.0, 0.0, float(np.log(share / (1 - share))))
    # every fourth row of each class sets the curve; a class of two or three rows serves both ends
    turn = np.zeros(len(labels), np.int64)
    for label in (0, 1):
        turn[labels == label] = np.arange((labels == label).sum())
    curve = turn % 4 == 1
    learn = np.flatnonzero(~curve)
    ratios = log_count_ratios([rows[i] for i in learn], labels[learn])
    values = []
    for i in learn:
        scaled = ratios[rows[i]]
        values.append(scaled / max(np.sqrt(scaled @ scaled), 1e-12))
    signs = np.where(labels[learn] == 1, 1.0, -1.0)
    share = {1.0: (signs > 0).mean(), -1.0: (signs < 0).mean()}
    costs = np.array([cost / (2 * share[s]) for s in signs])
    weights, bias = dual_coordinate_descent([rows[i] for i in learn], values, signs, costs)
    plain = Model(ratios, weights, bias, 1.0, 0.0)
    held = np.flatnonzero(curve)
    slope, offset = _logistic(np.array([plain.margin(rows[i]) for i in held]), labels[held].astype(float))
    return Model(ratios, weights, bias, slope, offset)


def _indicator_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [indicators(t.as_py()).astype(np.uint16).tobytes() for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), batch.column(1), batch.column(2)], names=["held", "label", "turn"])


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the quarter of the ids whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, cost: float = 1.0) -> Model:
    """A model of ``labels`` (doc_id, quality 0 or 1) over ``docs`` (doc_id, text).

    Learns from at most ``max_rows`` labelled ids that are not held out, those
    with the smallest hashes; this bounds what reaches the driver to
    ``max_rows`` rows of at most DIMENSIONS short integers.  Null ids or
    labels and other label values are no labels; an id with both labels counts
    with each.
    """
    usable = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out())
    usable = usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).distinct()
    # at most max_rows short rows: a bounded broadcast
    chosen = usable.withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id", "label").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("text", "label", "turn").mapInArrow(_indicator_rows, "held binary, label int, turn long")
    # an id that many rows repeat must not lift the bound
    sample = rows.orderBy("turn", "label", "held").limit(max_rows).toArrow()
    held = [np.frombuffer(h.as_py(), np.uint16).astype(np.int64) for h in sample["held"]]
    return fit_rows(held, sample["label"].to_numpy(), cost)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, score, predicted) for every row of ``docs``; null and empty texts are scored, too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([shared.value.score(t.as_py()) for t in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) of every document, with a model of ``labels``.

    ``held_out`` marks the ids whose labels were not learned from (a null id
    is not held out).  Without usable labels of both classes every text gets
    the smoothed share of the labels seen.  Repeated rows are scored alike;
    columns other than doc_id and text are not read.
    """
    model = fit(docs, labels, max_rows)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that a model of ``labels`` scores below ``threshold``; columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_rows))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(t.as_py()) >= threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
