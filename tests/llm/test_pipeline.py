"""The pipeline's stages, each judged on its own input, on the smallest tables."""

import random
from collections import Counter, defaultdict

import pytest

from test_odd_sketch import brute, shingles

import corpus_pipeline
from basketflow.llm import odd_sketch
from basketflow.session import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, folder))
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == COLUMNS
        out.append(docs.collect())
    return out


def test_stage_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "temperature_mixing", "histogram_sharding"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_quality_drops_junk_and_little_else(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    before, after = ({r.doc_id for r in rows} for rows in steps[:2])
    assert after < before
    good = [i for i in labels if labels[i] == 1]
    assert len([i for i in good if i in after]) >= 0.95 * len(good)


def test_one_document_of_each_group(steps):
    kept = {r[0] for r in brute([(r.doc_id, r.text) for r in steps[1]], 80) if r[3]}
    assert {r.doc_id for r in steps[2]} == kept


def test_near_copies_from_four_fifths_on_go(spark):
    """Pairs of a similarity between 0.75 and 0.9, judged by comparing all pairs at 80 percent."""
    draw = random.Random(8)
    rows = []
    for g in range(60):
        base = [f"w{draw.randrange(10**6)}" for _ in range(400)]
        copy = list(base)
        for i in range(5 + g % 7):
            copy[20 + 30 * i] = f"w{draw.randrange(10**6)}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
    sets = {i: shingles(t) for i, t in rows}
    share = lambda a, b: 100 * len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    linked = {b for a in sets for b in sets if a < b and share(a, b) >= 80}
    between = {b for a in sets for b in sets if a < b and 80 <= share(a, b) < 85}
    assert len(between) >= 15 and len(linked) < 60
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == COLUMNS and {r.doc_id for r in kept.collect()} == set(sets) - linked


def test_bands_find_the_threshold_as_surely():
    missed = lambda s: (1 - s**odd_sketch.ROWS) ** odd_sketch.bands_for(s)
    assert odd_sketch.bands_for(0.85) == odd_sketch.bands_for(0.95) == odd_sketch.BANDS and missed(0.8) <= missed(0.85)


def test_documents_with_items_go(spark, steps):
    items = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    left = {r.doc_id for r in steps[3]}
    for r in steps[2]:
        if any(i in r.text for i in items):
            assert r.doc_id not in left
        elif not any(i.split()[1] in r.text for i in items):
            assert r.doc_id in left


def test_mix_keeps_every_document_and_flattens(steps):
    times = Counter(r.doc_id for r in steps[4])
    assert set(times) == {r.doc_id for r in steps[3]} and max(times.values()) <= 2
    size = lambda rows: Counter(dict((s, sum(len(r.text.split()) + 1 for r in rows if r.source == s)) for s in {r.source for r in rows}))
    before, after = size(steps[3]), size(steps[4])
    assert max(after.values()) / min(after.values()) <= max(before.values()) / min(before.values())


def test_shards_hold_everything(steps):
    last = steps[5]
    assert Counter((r.doc_id, r.text) for r in last) == Counter((r.doc_id, r.text) for r in steps[4])
    slots, sizes = defaultdict(list), Counter()
    for r in last:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in last)
