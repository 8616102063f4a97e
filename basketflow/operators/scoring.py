"""Feed-forward rankers applied to feature tables in Arrow batches, and a ranker Spark trains itself.

Weights are small parameters (at most a few hundred thousand numbers) and
travel with the task; the feature rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketflow.functions.vectors import SCORE_DIGITS
from basketflow.operators.ranking import FEATURES
from basketflow.session import settle

Layer = tuple[np.ndarray, np.ndarray]  # weights (out, in), bias (out)
NORM_EPSILON = 1e-5
SCORED_ROWS = 1_024  # rows whose layers stay in a core's cache


def _linear(x: np.ndarray, layer: Layer) -> np.ndarray:
    return x @ layer[0].T + layer[1]


def _relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0.0)


def _normed(x: np.ndarray, scale: Layer) -> np.ndarray:
    spread = x.var(axis=1, keepdims=True) + NORM_EPSILON
    return (x - x.mean(axis=1, keepdims=True)) / np.sqrt(spread) * scale[0] + scale[1]


@dataclass
class DenseRanker:
    """Hidden layers with layer norm and skips.

    layout 'norm_first': norm before ReLU, skip wherever widths match.
    layout 'norm_last': norm after ReLU on the first two layers, whose sum
    feeds a third layer without norm.
    """

    hidden: list[Layer]
    out: Layer
    norms: list[Layer] = field(default_factory=list)
    layout: str = "norm_first"

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.layout == "norm_last":
            first = _normed(_relu(_linear(x, self.hidden[0])), self.norms[0])
            second = _normed(_relu(_linear(first, self.hidden[1])), self.norms[1])
            return _linear(_relu(_linear(first + second, self.hidden[2])), self.out)[:, 0]
        for i, layer in enumerate(self.hidden):
            y = _linear(x, layer)
            y = _relu(_normed(y, self.norms[i]) if self.norms else y)
            x = y + x if y.shape[1] == x.shape[1] else y
        return _linear(x, self.out)[:, 0]


@dataclass
class CrossRanker:
    """Cross layers next to hidden layers; both ends feed the output layer."""

    cross: list[Layer]  # weights (in,), bias (in)
    hidden: list[Layer]
    out: Layer

    def __call__(self, x: np.ndarray) -> np.ndarray:
        crossed, deep = x, x
        for weight, bias in self.cross:
            crossed = x * (crossed @ weight)[:, None] + bias + crossed
        for layer in self.hidden:
            deep = _relu(_linear(deep, layer))
        return _linear(np.concatenate([crossed, deep], axis=1), self.out)[:, 0]


@dataclass
class WideRanker:
    """A linear score on the wide features plus hidden layers on the deep ones."""

    wide: Layer
    hidden: list[Layer]
    out: Layer
    wide_columns: tuple[int, ...]
    deep_columns: tuple[int, ...]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        deep = x[:, list(self.deep_columns)]
        for layer in self.hidden:
            deep = _relu(_linear(deep, layer))
        return (_linear(x[:, list(self.wide_columns)], self.wide) + _linear(deep, self.out))[:, 0]


def score_features(df: DataFrame, ranker, features=FEATURES, name: str = "score") -> DataFrame:
    """Adds the ranker's score; rows keep their order and partition."""
    columns = list(features)

    def apply(batches):
        for batch in batches:
            at = batch.schema.names
            x = [batch.column(at.index(c)).to_numpy(zero_copy_only=False).astype(np.float64) for c in columns]
            scores = ranker(np.stack(x, axis=1)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*at, name])

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    return df.mapInArrow(apply, schema)


def _among_best(keys: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Which rows can be among the k best of their key once scores are rounded; NaN stands above all numbers, as in Spark."""
    scores = np.where(np.isnan(scores), np.inf, scores)
    order = np.lexsort((-scores, keys))
    first = np.searchsorted(keys[order], keys, side="left")
    count = np.searchsorted(keys[order], keys, side="right") - first
    return (count <= k) | (scores >= scores[order[first + np.minimum(k, count) - 1]] - 2 * 10.0**-SCORE_DIGITS)


def best_scored(df: DataFrame, rankers: Mapping[str, object], k: int, features=FEATURES, key: str = "query_id") -> DataFrame:
    """``(key, item_idx, <name of each ranker>)``: the rows that can be among the k best of a key, and null for rankers that have them not there.

    One pass over the features for all rankers.  Each batch of them keeps its
    own best, which hold the best of all: ``rerank`` sorts k rows per key and
    batch, not every candidate.
    """
    columns = list(features)

    def apply(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in columns], axis=1)
            keys = batch.column(key).dictionary_encode().indices.fill_null(-1).to_numpy()
            scores = {name: ranker(x) for name, ranker in rankers.items()}
            best = {name: _among_best(keys, found, k) for name, found in scores.items()}
            kept = np.flatnonzero(np.any(list(best.values()), axis=0))
            shown = [pa.array(scores[name][kept], mask=~best[name][kept]) for name in rankers]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(kept)) for c in (key, "item_idx")), *shown], [key, "item_idx", *rankers])

    schema = T.StructType([*(df.schema[c] for c in (key, "item_idx")), *(T.StructField(name, T.DoubleType()) for name in rankers)])
    return df.select(key, "item_idx", *columns).mapInArrow(apply, schema)


def among_best(df: DataFrame, k: int, score: str = "score", key: str = "query_id") -> DataFrame:
    """The rows that can be among the k best of their key by ``score``, of each batch: all that need be sorted for a list of k."""
    def apply(batches):
        for batch in batches:
            keys = batch.column(key).dictionary_encode().indices.fill_null(-1).to_numpy()
            scores = batch.column(score).to_numpy(zero_copy_only=False).astype(np.float64)
            yield batch.filter(pa.array(_among_best(keys, scores, k)))

    return df.mapInArrow(apply, df.schema)


def cross_columns(df: DataFrame, cross: list[tuple[list[float], list[float]]], features=FEATURES) -> DataFrame:
    """The cross layers alone as column expressions: adds ``cross_<feature>``."""
    first = [F.col(c) for c in features]
    now = first
    for weights, bias in cross:
        mixed = sum((x * w for x, w in zip(now[1:], weights[1:])), now[0] * weights[0])
        now = [a * mixed + b + x for a, b, x in zip(first, bias, now)]
    return df.select("*", *[x.alias(f"cross_{c}") for c, x in zip(features, now)])


def wide_column(df: DataFrame, weights: list[float], bias: float, features=FEATURES) -> DataFrame:
    """The wide part alone as a column expression: adds ``wide``."""
    return df.withColumn("wide", sum((F.col(c) * w for c, w in zip(features, weights)), F.lit(bias)))


def fit_ranker(features: DataFrame, hidden: tuple[int, ...] = (16, 8), kind: str = "mlp", seed: int = 42, iterations: int = 40):
    """A binary ranker trained on ``label`` by Spark ML.

    Spark reads the rows for their size, their labels and each copy it keeps,
    so they are settled: what they are made from runs once.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.feature import VectorAssembler

    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="_x")
    common = {"featuresCol": "_x", "labelCol": "label", "maxIter": iterations}
    if kind == "mlp":
        learner = MultilayerPerceptronClassifier(layers=[len(FEATURES), *hidden, 2], seed=seed, **common)
    else:
        learner = LogisticRegression(**common)
    return Pipeline(stages=[assembled, learner]).fit(settle(features.select(*FEATURES, "label")))


class _Perceptron:
    """The second probability of a fitted perceptron, whose layers are applied to a batch at a time: sigmoids, and a softmax at the end."""

    def __init__(self, layers: list[int], weights: np.ndarray):
        self.layers, at = [], 0
        for n_in, n_out in zip(layers[:-1], layers[1:], strict=True):
            matrix, bias = weights[at:at + n_in * n_out].reshape(n_in, n_out), weights[at + n_in * n_out:at + (n_in + 1) * n_out]
            self.layers.append((matrix, bias))
            at += (n_in + 1) * n_out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if np.isnan(x).any():
            raise ValueError("a feature is null or NaN")  # as the assembler has it
        out = np.empty(len(x))
        for at in range(0, len(x), SCORED_ROWS):
            y = x[at:at + SCORED_ROWS]
            for i, (matrix, bias) in enumerate(self.layers):
                y = y @ matrix + bias
                if i < len(self.layers) - 1:
                    with np.errstate(over="ignore"):  # the sigmoid of a far negative number is 0
                        y = 1.0 / (1.0 + np.exp(-y))
            y = np.exp(y - y.max(axis=1, keepdims=True))
            out[at:at + SCORED_ROWS] = y[:, 1] / y.sum(axis=1)
        return out


def score_with(model, features: DataFrame) -> DataFrame:
    """Adds the probability of label 1 by a model of ``fit_ranker``; a perceptron scores whole batches, Spark's own transform a row at a time."""
    from pyspark.ml.classification import MultilayerPerceptronClassificationModel
    from pyspark.ml.functions import vector_to_array

    last = model.stages[-1]
    if isinstance(last, MultilayerPerceptronClassificationModel):
        scored = score_features(features, _Perceptron(list(last.getLayers()), np.asarray(last.weights.toArray())))
    else:
        scored = model.transform(features).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*features.columns, "score")
