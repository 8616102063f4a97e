"""Near duplicates against brute force over all pairs of full sets."""

import random

import numpy as np
import pytest

from basketflow.llm import odd_sketch
from basketflow.llm.odd_sketch import near_duplicates, one_per_group

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, component string"


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    size = min(5, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, percent=85):
    """(doc_id, n, component, kept) by comparing all pairs, linked from ``percent`` of their shingles on."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            same = rows[i][0] == rows[j][0] and sets[i] and sets[j]
            if same or (sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])):
                parent[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        component = min((rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None), default=None)
        out.append((doc_id, len(sets[i]), component, doc_id is None or doc_id == component))
    return sorted(out, key=str)


def corpus(seed, groups=12, copies=9):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for g in range(groups):
        base = draw.choices(vocabulary, k=draw.choice([3, 8, 40, 150, 400]))
        for c in range(copies):
            words = list(base)
            for _ in range(draw.randint(0, max(1, len(words) // 60))):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            rows.append((1000 * g + c, (" " if c % 2 else "\n").join(words).upper() if c == 3 else " ".join(words)))
    rows += [(5, rows[20][1]), (77, ""), (78, None), (79, " \t\n"), (None, rows[0][1]), (80, "w1"), (81, "W1"), (82, "w1 w2")]
    rows += [(2003, rows[-1][1]), (90, "x " * 30_000), (91, "x " * 500), (7, rows[0][1]), (7, rows[0][1])]
    draw.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, 1, 3, "x") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("block", [3, 1024])
def test_equal_to_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(odd_sketch, "BLOCK_ROWS", block)
    rows = corpus(block)
    found = near_duplicates(frame(spark, rows))
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_one_document_of_each_group_stays(spark):
    rows = corpus(4)
    left = one_per_group(frame(spark, rows))
    assert left.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    kept = sorted((r for r in brute(rows) if r[3]), key=str)
    assert sorted((r[0] for r in left.collect()), key=str) == sorted((r[0] for r in kept), key=str)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_estimate_follows_similarity():
    draw = np.random.default_rng(0)
    for similarity in (0.7, 0.85, 0.95):
        errors = []
        for _ in range(60):
            shared = draw.integers(0, 1 << 63, 2000, dtype=np.uint64)
            own = round(2000 * (1 - similarity) / (1 + similarity))
            a, b = (np.concatenate([shared[own:], draw.integers(0, 1 << 63, own, dtype=np.uint64)]) for _ in range(2))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            x, y = (odd_sketch.odd_sketch(odd_sketch.minhash(s)).view(np.uint64) for s in (a, b))
            errors.append(float(odd_sketch.estimate(np.bitwise_count(x ^ y).sum())) - true)
        assert abs(np.mean(errors)) < 0.02
        assert np.std(errors) < 1.3 * np.sqrt(similarity * (1 - similarity) / odd_sketch.SAMPLES) + 0.01


def test_a_threshold_is_met_or_refused():
    missed = lambda s: (1 - s**odd_sketch.ROWS) ** odd_sketch.bands_for(s)
    assert all(missed(s) <= missed(0.85) for s in np.arange(0.77, 1.0, 0.01))
    for threshold in (0.76, 0.5, 0.0, -1.0, 1.01):
        with pytest.raises(ValueError):
            odd_sketch.bands_for(threshold)
