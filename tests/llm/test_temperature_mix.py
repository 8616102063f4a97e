"""Temperature mixing: limits are met, quotas are filled, and the realised mix equals SQL."""

import math
from collections import Counter, defaultdict

import pytest

from basketflow.llm.temperature_mix import temperature_mix

SCHEMA = "doc_id long, text string, source string, mix_key string, tokens long"
SIZES = {"a": 600, "b": 150, "c": 40, "d": 9, None: 60}


def frame(spark):
    rows, i = [], 0
    for source, count in SIZES.items():
        for _ in range(count):
            rows.append((i, " ".join(["w"] * (i % 13)), source, "x", 1))
            i += 1
    rows += [(None, None, "a", "x", 1), (None, "", "b", "x", 1), (3, rows[3][1], "a", "x", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def size(text):
    return len((text or "").split()) + 1


def shares(rows):
    total = Counter()
    for r in rows:
        total[r.source] += size(r.text)
    return {s: n / sum(total.values()) for s, n in total.items()}, total


def test_entropy_is_met_and_quotas_are_filled(spark):
    docs = frame(spark)
    _, have = shares(docs.collect())
    mixed = temperature_mix(docs, target_entropy=0.9)
    assert mixed.columns == [*docs.columns, "mix_tokens", "mix_weight", "mix_quota", "mix_pass"]
    rows = mixed.collect()
    weights = {r.source: r.mix_weight for r in rows}
    assert math.isclose(sum(weights.values()), 1, rel_tol=1e-9)
    assert math.isclose(-sum(w * math.log(w) for w in weights.values()), 0.9 * math.log(5), rel_tol=1e-6)
    taken, largest = defaultdict(int), max(size(r.text) for r in rows)
    times = Counter()
    for r in rows:
        assert r.mix_tokens == size(r.text)
        taken[r.source] += r.mix_tokens
        times[r.source, r.doc_id, r.text, r.mix_pass] += 1
    quota = {r.source: r.mix_quota for r in rows}
    for source in SIZES:
        assert abs(quota[source] - weights[source] * sum(have.values())) <= 1
        assert quota[source] - 2 * largest < taken[source] <= quota[source]
        # every pass but the last is whole
        whole = quota[source] // have[source]
        for p in range(whole):
            assert sum(n for (s, _, _, q), n in times.items() if s == source and q == p) == docs.where(docs.source.eqNullSafe(source)).count()


def test_whole_budget_keeps_every_document_within_the_limit(spark):
    docs = frame(spark)
    rows = temperature_mix(docs, max_repeats=2.0, budget_share=None).collect()
    assert {(r.doc_id, r.text) for r in rows} == {(r.doc_id, r.text) for r in docs.collect()}
    passes = {s: max(r.mix_pass for r in rows if r.source == s) + 1 for s in SIZES}
    assert passes["a"] == 1 and max(passes.values()) == 2
    _, have = shares(docs.collect())
    _, now = shares(rows)
    assert max(now[s] / have[s] for s in have) <= 2.0 + 1e-9


def test_limits_that_cannot_hold(spark):
    with pytest.raises(ValueError):
        temperature_mix(frame(spark), max_repeats=1.5, budget_share=2.0)


def test_one_source_and_none(spark):
    docs = frame(spark).where("source = 'd'")
    assert temperature_mix(docs, target_entropy=0.9).count() == docs.count()
    assert temperature_mix(docs.where("false"), target_entropy=0.9, max_repeats=3.0).collect() == []
