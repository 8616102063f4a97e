"""Term-at-a-time search against the formula over every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from basketflow.llm import term_search as T
from basketflow.llm.term_search import term_search, terms_of

DOCS = "doc_id long, text string, item_id string, score string, term int"
ITEMS = "item_id long, text string, rank string, df int"


def words(text):
    lower = lambda w: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
    return [lower(w) for w in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")]


def brute(docs, items, k=10):
    held = [(i, Counter(words(t)), len(words(t))) for i, t in docs if words(t)]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    texts = {}
    for item, text in dict.fromkeys(items):
        texts.setdefault(item, []).extend(words(text))
    out = []
    for item, asked in texts.items():
        found = []
        for doc, counts, n in held:
            m = 25 + (75 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 8 * m))
                        for t in asked if counts[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        for rank, (score, missing, doc) in enumerate(sorted(found)[:k], 1):
            out.append((item, rank, None if missing else doc, -score))
    return sorted(out, key=str)


def corpus(seed, count=400):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünï", "straße", "日本", "A1b2", "don't", "x_y"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda n: draw.choice([" ", ", ", "\n"]).join(draw.choices(vocabulary, weights, k=n))
    docs = [(i, text(draw.choice([1, 5, 30, 200]))) for i in range(count)]
    docs += [(5, docs[9][1]), (9, docs[9][1]), (None, docs[9][1]), (900, None), (901, ""), (902, " .,!\n"), (903, "w1 " * 20_000)]
    docs += [(1000 + i, docs[3][1]) for i in range(15)]
    items = [(i, text(draw.choice([1, 4, 25]))) for i in range(25)]
    items += [(2, items[2][1]), (3, "w7 w7 W7 w290"), (None, "w8 straße"), (50, None), (51, ""), (52, "nowhere"), (53, "w1"), (54, "w0 w0 w0")]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, "x", "y", 1) for i, t in docs], DOCS).repartition(3),
            spark.createDataFrame([(i, t, "x", 1) for i, t in items], ITEMS))


@pytest.mark.parametrize(("block", "shard"), [(7, 5), (1 << 16, 4096)])
def test_equal_to_the_formula(spark, monkeypatch, block, shard):
    monkeypatch.setattr(T, "BLOCK_DOCS", block)
    monkeypatch.setattr(T, "SHARD_ITEMS", shard)
    docs, items = corpus(block)
    found = term_search(*frames(spark, docs, items))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items)


def test_terms():
    for text in ("Don't STOP\x00now", "ÀÉ ñandú_x", "", None, "\x7f~{", "ı İ ß"):
        assert [t.decode() for t in terms_of(text)] == words(text)


def test_accumulators_stop_opening_and_lose_nothing():
    """A rare term that decides, then very frequent ones: most postings open no accumulator."""
    draw = np.random.default_rng(1)
    n = 5000
    queries = T.Queries([1], {b"rare": 0, b"usual": 1, b"common": 2}, np.array([9000, 300, 40]), [])
    lists = [np.sort(draw.choice(n, size, replace=False)) for size in (40, 2500, 4900)]
    gains = [queries.weights[t] * draw.integers(500_000, 990_000, len(rows)) for t, rows in enumerate(lists)]
    starts = np.cumsum([0, *map(len, lists)])
    block = T._Block(np.arange(n), starts, np.concatenate(lists), np.concatenate(gains), np.array([g.max() for g in gains]))
    scores = np.zeros(n, np.int64)
    rows, opened = T.ranked_in_block(block, np.arange(3), np.array([1, 2, 1]), 10, 0, scores)
    full = np.zeros(n, np.int64)
    for (held, gain), times in zip(zip(lists, gains, strict=True), (1, 2, 1), strict=True):
        full[held] += gain * times
    best = np.lexsort((np.arange(n), -full))[:10]
    mine = rows[np.lexsort((rows, -scores[rows]))[:10]]
    assert mine.tolist() == best.tolist() and scores[mine].tolist() == full[best].tolist()
    assert opened == len(lists[0]) < 100


def test_empty_tables(spark):
    docs, items = corpus(1, 20)
    none_d, none_i = frames(spark, docs, items)[0].limit(0), frames(spark, docs, items)[1].limit(0)
    assert term_search(none_d, frames(spark, docs, items)[1]).collect() == []
    assert term_search(frames(spark, docs, items)[0], none_i).collect() == []
