"""The derived tables the queries start from."""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketflow.functions.rounding import rounded
from basketflow.operators.clean import MEASURES, CleaningRules, clean_lines, until_merged
from basketflow.operators.ingest import compute_prices
from basketflow.operators.matrix import count_matrix, interaction_matrix
from basketflow.operators.scoring import CrossRanker, DenseRanker, WideRanker
from basketflow.operators.sequences import build_sequences, of_split
from basketflow.operators.tables import interactions_table
from basketflow.session import settle
from basketflow.sources.retail import event_lines, item_vectors, raw_lines

KS = (5, 10, 20)
K_CANDS = 200


def priced(spark: SparkSession, d: str) -> DataFrame:
    return compute_prices(raw_lines(spark, d))


def merged(spark: SparkSession, d: str) -> DataFrame:
    return until_merged(priced(spark, d))


def clean(spark: SparkSession, d: str, rules: CleaningRules = CleaningRules()) -> DataFrame:
    rows = interactions_table(clean_lines(priced(spark, d), rules))
    # Without a rule on rare items or users these are settled lines inside bounds: to read them costs no more than to read a copy.
    return rows if rules.handle_outliers and max(rules.min_purchases_per_item, rules.min_events_per_user) <= 1 else settle(rows)


def clean_prices(spark: SparkSession, d: str) -> DataFrame:
    """The clean lines without their texts, for what is computed from items and prices alone."""
    return clean_lines(priced(spark, d), attributes=()).select("customer_id", "stock_code", "invoice_date", *MEASURES)


def sequences(spark: SparkSession, d: str) -> DataFrame:
    return build_sequences(event_lines(spark, d), tie="event_id", query_id="event_id")


def split(spark: SparkSession, d: str, *names: str) -> DataFrame:
    return of_split(sequences(spark, d), *names)


def tests(spark: SparkSession, d: str) -> DataFrame:
    return split(spark, d, "test")


def users(spark: SparkSession, d: str) -> DataFrame:
    return tests(spark, d).select("user_idx").distinct()


def matrix(spark: SparkSession, d: str) -> DataFrame:
    return settle(interaction_matrix(split(spark, d, "train")))


def knn_matrix(spark: SparkSession, d: str) -> DataFrame:
    return settle(count_matrix(event_lines(spark, d), sequences(spark, d)))


def n_items(spark: SparkSession, d: str) -> int:
    return event_lines(spark, d).select("item_idx").distinct().count()


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return item_vectors(spark, d)


class Shared:
    """The derived tables of one query, each built and settled once however often it is read."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d

    @cached_property
    def sequences(self) -> DataFrame:
        return settle(sequences(self.spark, self.d))

    def split(self, *names: str) -> DataFrame:
        return of_split(self.sequences, *names)

    @property
    def tests(self) -> DataFrame:
        return self.split("test")

    @cached_property
    def users(self) -> DataFrame:
        return settle(self.tests.select("user_idx").distinct())

    @cached_property
    def matrix(self) -> DataFrame:
        return settle(interaction_matrix(self.split("train")))

    @cached_property
    def knn_matrix(self) -> DataFrame:
        return settle(count_matrix(event_lines(self.spark, self.d), self.sequences))

    @cached_property
    def n_items(self) -> int:
        return n_items(self.spark, self.d)

    @property
    def vectors(self) -> DataFrame:
        return vectors(self.spark, self.d)

    @cached_property
    def clean(self) -> DataFrame:
        return clean(self.spark, self.d)


def six(*names: str):
    return [rounded(F.col(n), 6).alias(n) for n in names]


def nine(*names: str):
    """For values that are short decimals: no half is met at nine digits."""
    return [rounded(F.col(n), 9).alias(n) for n in names]


# ---- small rankers with weights from a rule ---------------------------------------------------
def _weights(rows: int, cols: int, layer: int) -> np.ndarray:
    i, j = np.meshgrid(np.arange(rows), np.arange(cols), indexing="ij")
    return np.sin(1.0 + 3.0 * i + 7.0 * j + 11.0 * layer).round(6)


def _layer(rows: int, cols: int, number: int):
    return _weights(rows, cols, number), np.cos(np.arange(rows) + number).round(6) / 10


def _unscaled(size: int):
    return np.ones(size), np.zeros(size)


def dense_ranker(layout: str = "norm_first") -> DenseRanker:
    hidden = [_layer(8, 5, 0), _layer(8, 8, 1), _layer(4, 8, 2)]
    norms = [_unscaled(8), _unscaled(8), _unscaled(4)]
    return DenseRanker(hidden, _layer(1, 4, 3), norms if layout == "norm_first" else norms[:2], layout)


def cross_ranker() -> CrossRanker:
    cross = [(_weights(1, 5, 10 + n)[0], np.cos(np.arange(5) + n).round(6) / 10) for n in range(3)]
    return CrossRanker(cross, [_layer(6, 5, 20), _layer(4, 6, 21)], _layer(1, 9, 22))


def wide_ranker() -> WideRanker:
    return WideRanker(_layer(1, 5, 30), [_layer(6, 5, 31), _layer(4, 6, 32)], _layer(1, 4, 33), (0, 1, 2, 3, 4), (0, 1, 2, 3, 4))
