"""Decontamination: WAND against exhaustive scores, hits against planted items and a brute-force search."""

import random
from collections import Counter

import numpy as np
import pytest

from basketflow.llm import decontaminate
from basketflow.llm.decontaminate import bare_words, block_max_wand, build_shard, clean_documents, contaminated, question_and_answer

DOCS = "doc_id long, text string, lang string, source string, score string, item_id string"


def bench(seed, count):
    draw = random.Random(seed)
    common, rare = ["the", "of", "and", "a"], [f"r{i}" for i in range(600)]
    out = []
    for i in range(count):
        words = [draw.choice(common) if draw.random() < 0.4 else draw.choice(rare) for _ in range(draw.randint(2, 60))]
        for j in range(8, len(words), 9):
            words[j] += "."
        out.append((i, " ".join(words)))
    return out


def shard_of(items):
    df = Counter(w for _, t in items for w in set(bare_words(t)))
    sizes = [len(bare_words(t)) for _, t in items]
    return build_shard(items, df, len(items), float(np.mean(sizes)), max(sizes))


@pytest.mark.parametrize("least", [0.05, 0.3, 0.8])
def test_wand_finds_all_above_the_threshold(least):
    shard = shard_of(bench(3, 150))
    draw = random.Random(1)
    for _ in range(60):
        terms = draw.sample(range(len(shard.terms)), draw.randint(0, 120))
        scores = np.zeros(len(shard.items))
        for t in terms:
            scores[shard.postings[t]] += shard.weights[t]
        found = dict(block_max_wand(shard, terms, least))
        assert set(found) == set(np.flatnonzero(scores >= least - 1e-9))
        assert all(abs(found[i] - scores[i]) < 1e-9 for i in found)


def brute(docs, items):
    """Pairs with a window that holds enough of both parts, by plain sets and all windows."""
    span = max(len(bare_words(t)) for _, t in items)
    shard = shard_of(items)
    weights = {i: {} for i in range(len(items))}
    for term, t in shard.terms.items():
        for p, w in zip(shard.postings[t].tolist(), shard.weights[t].tolist(), strict=True):
            weights[p][term] = w
    texts = dict(items)

    def grams(words, width):
        return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}

    found = set()
    for doc_id, text in docs:
        words = bare_words(text)
        for start in range(0, max(1, len(words)), span):
            window = words[start : start + 2 * span]
            if start and len(words) <= start + span:
                continue  # lies in the window before it
            for place, item_id in enumerate(shard.items):
                if sum(w for t, w in weights[place].items() if t in set(window)) < 0.6 - 1e-9:
                    continue
                parts = question_and_answer(texts[item_id])
                if all(
                    len(grams(p, min(5, len(p))) & grams(window, min(5, len(p)))) >= 0.8 * len(grams(p, min(5, len(p)))) for p in parts
                ):
                    found.add((doc_id, item_id))
    return found


def planted(items, seed=5):
    draw = random.Random(seed)
    filler = [f"f{i}" for i in range(500)] + ["the", "of", "and", "a"] * 50
    docs = []
    for i in range(120):
        words = draw.choices(filler, k=draw.choice([0, 3, 40, 300]))
        kind = i % 4
        item = bare_words(draw.choice(items)[1])
        item = [w.decode() for w in item]
        if i % 8 == 0:
            item[-1] += ".***"
        if kind == 0:
            at = draw.randint(0, len(words))
            words[at:at] = item
        elif kind == 1:
            words += item[: len(item) // 2]  # half an item is no copy
        elif kind == 2:
            if len(item) > 30:
                item[3] = "changed"
            words = words + [w.upper() for w in item]
        docs.append((i, " ".join(words)))
    return docs


def test_equal_to_brute_force(spark, monkeypatch):
    items = bench(7, 60)
    docs = planted(items)
    edge = [(None, None), (500, ""), (501, " \n"), (None, items[40][1]), (502, items[40][1]), (502, items[40][1]), (503, "x " * 60_000 + items[41][1])]
    monkeypatch.setattr(decontaminate, "BATCH_WORDS", 700)
    frame = spark.createDataFrame([(i, t, "en", None, "s", "x") for i, t in docs + edge], DOCS)
    tests = spark.createDataFrame([*items, (900, None), (901, "")], "item_id long, text string")
    want = brute(docs + edge, items)
    found = contaminated(frame, tests)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    assert found.count() == len(want)
    assert all(any(d == i for d, _ in want) for i, _ in docs if i % 4 == 0)
    left = clean_documents(frame, tests)
    assert left.columns == frame.columns
    bad = {d for d, _ in want if d is not None}
    assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == sorted(i for i, _ in docs + edge if i is not None and i not in bad)
    assert left.where("doc_id is null").count() == 1


def test_shards_change_nothing(spark, monkeypatch):
    items = bench(8, 50)
    frame = spark.createDataFrame([(i, t, "en", None, "s", "x") for i, t in planted(items)], DOCS)
    tests = spark.createDataFrame(items, "item_id long, text string")
    whole = {(r.doc_id, r.item_id) for r in contaminated(frame, tests).collect()}
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 20)
    assert {(r.doc_id, r.item_id) for r in contaminated(frame, tests).collect()} == whole


def test_without_items(spark):
    frame = spark.createDataFrame([(1, "a b", "en", None, "s", "x")], DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(frame, none).collect() == [] and clean_documents(frame, none).count() == 1
    assert contaminated(frame.where("false"), spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []
