"""The classifier: held-out accuracy, the dual solver against a plain subgradient method, edge rows."""

import random
import zlib

import numpy as np

from basketflow.llm import nbsvm
from basketflow.llm.nbsvm import DIMENSIONS, accepted, dual_coordinate_descent, fit_rows, indicators, quality_scores


def texts(count, seed=1):
    draw = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("th", "ea", "on", "re") for b in ("ing", "er", "a", "ou") for c in ("n", "st", "", "ly")]
    rows = []
    for i in range(count):
        body = draw.choices(words, k=draw.randint(1, 120))
        good = draw.random() < 0.8
        if not good:
            kind = draw.randrange(3)
            body = [w + "***" for w in body] if kind == 0 else [w.upper() + "!!" for w in body] if kind == 1 else [body[0]] * 60
        rows.append((i, " ".join(body), "en", "s", 1, int(good)))
    return rows


def test_learns_without_held_out_labels(spark):
    rows = texts(900)
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows}
    # labels that are held out are all wrong: they must change nothing
    labels = spark.createDataFrame([(r[0], 1 - r[5] if out[r[0]] else r[5], 0) for r in rows], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    assert all(found[i].held_out == out[i] for i in out)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in found.values())
    right = [found[r[0]].predicted == r[5] for r in rows if out[r[0]]]
    assert np.mean(right) > 0.97
    kept = accepted(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if r.predicted}


def test_edge_rows(spark):
    schema = "doc_id long, text string, score string, label string"
    docs = spark.createDataFrame([(None, None, "x", "y"), (1, "", "x", "y"), (1, "", "x", "y"), (2, "word " * 200_000, None, None)], schema)
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 1), (3, 7, 0)], "doc_id long, quality int, toxic int")
    found = quality_scores(docs, labels).collect()
    assert len(found) == 4 and len({r.score for r in found}) == 1  # one class: its smoothed share
    assert accepted(docs, labels).count() in (0, 4)
    none = labels.where("false")
    assert {r.score for r in quality_scores(docs, none).collect()} == {0.5}
    assert quality_scores(docs.where("false"), labels).collect() == []


def test_dual_solver_meets_the_primal_optimum():
    draw = np.random.default_rng(2)
    rows = [np.sort(draw.choice(60, 12, replace=False)) for _ in range(80)]
    values = [draw.normal(size=12) for _ in rows]
    signs = np.where(draw.random(80) < 0.5, 1.0, -1.0)
    costs = np.full(80, 0.3)

    def loss(w, b):
        margins = np.array([w[r] @ v + b for r, v in zip(rows, values, strict=True)])
        return (w @ w + b * b) / 2 + (costs * np.maximum(0, 1 - signs * margins)).sum()

    weights, bias = dual_coordinate_descent(rows, values, signs, costs, rounds=500, tolerance=1e-6)
    w, b, best = np.zeros(DIMENSIONS), 0.0, np.inf
    for t in range(1, 6000):
        gw, gb = w.copy(), b
        for r, v, s, c in zip(rows, values, signs, costs, strict=True):
            if s * (w[r] @ v + b) < 1:
                gw[r] -= c * s * v
                gb -= c * s
        w, b = w - gw / (t + 10), b - gb / (t + 10)
        best = min(best, loss(w, b)) if t > 5000 else best
    assert loss(weights, bias) <= best + 1e-3


def test_indicators_are_presence_only():
    once, twice = indicators("Abc def"), indicators("Abc def\nAbc def")
    assert set(once[once < nbsvm._REPEATS]) <= set(twice)
    assert len(indicators(None)) == len(indicators("")) == 0
    model = fit_rows([once, twice] * 4, np.array([1, 0] * 4))
    assert model.score("Abc def") > model.score("Abc def\nAbc def")
