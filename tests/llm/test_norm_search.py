"""Exact search against all products, with long tails of lengths, ties, repeated rows and broken vectors."""

import math
import random

import pytest

from basketflow.llm import norm_search
from basketflow.llm.norm_search import integer_vectors, top_products

SCHEMA = "vec_id long, embedding array<float>, label int, v string, _square string"


def table(seed, count=700, width=12):
    draw = random.Random(seed)
    rows = [(i, [draw.gauss(0, 1) * (1 + 5 * (draw.random() ** 8)) * (0.7**j) for j in range(width)], 1, "x", "y") for i in range(count)]
    same = [round(x * 16) / 16 for x in rows[7][1]]
    rows += [(10_000 + i, same, 1, "x", "y") for i in range(count // 3)]
    rows += [
        (20_000, None, 1, "x", "y"), (20_020, [1.0, None, 2.0], 1, "x", "y"), (20_040, [float("nan")] * width, 1, "x", "y"),
        (20_060, [float("inf")] + [0.0] * (width - 1), 1, "x", "y"), (20_080, [], 1, "x", "y"), (20_100, [0.0] * width, 1, "x", "y"),
        (20_120, [3.0, -2.0], 1, "x", "y"), (None, [1.0] * width, 1, "x", "y"), (40, same, 1, "x", "y"),
    ]
    draw.shuffle(rows)
    return rows


def brute(rows, k):
    good = []
    for vec_id, vector, *_ in rows:
        if vec_id is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            import numpy as np

            good.append((vec_id, [math.floor(64 * float(np.float32(x))) for x in vector]))
    out = []
    for i, (query, q) in enumerate(good):
        if query % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), c) for j, (c, v) in enumerate(good) if j != i)
            out += [(query, r, c, -s) for r, (s, c) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [64, 8192])
def test_equal_to_all_products(spark, monkeypatch, block):
    monkeypatch.setattr(norm_search, "VECTOR_BLOCK", block)
    monkeypatch.setattr(norm_search, "QUERY_BLOCK", 16 if block == 64 else 1024)
    monkeypatch.setattr(norm_search, "SLICE", 48)
    rows = table(block)
    docs = spark.createDataFrame(rows, SCHEMA)
    found = top_products(integer_vectors(docs), "vec_id % 20 = 0", 20)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, 20)


def test_fewer_candidates_than_k_and_none(spark):
    rows = [(0, [1.0, 2.0], 1, "x", "y"), (1, [2.0, 1.0], 1, "x", "y"), (20, [0.5, 0.5], 1, "x", "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, top_products(integer_vectors(docs), "vec_id % 20 = 0", 20).collect())) == brute(rows, 20)
    assert top_products(integer_vectors(docs.where("vec_id = 20")), "vec_id % 20 = 0", 20).collect() == []
    assert top_products(integer_vectors(docs.where("false")), "vec_id % 20 = 0", 20).collect() == []
