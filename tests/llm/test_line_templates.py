"""Line templates against a brute-force tree in dictionaries."""

import random
from collections import Counter, defaultdict

import pytest

from basketflow.llm import line_templates
from basketflow.llm.line_templates import drop_templates, tokens_of

SCHEMA = "doc_id long, text string, lines string, leaf string, key string"


def brute(texts, least):
    """Kept text by text."""
    held = defaultdict(set)  # masked line -> texts
    for text in {t for t in texts if t}:
        for line in text.encode().split(b"\n"):
            tokens = tuple(tokens_of(line))
            if len(tokens) >= 3:
                held[tokens].add(text)
    leafs = defaultdict(set)
    for tokens, where in held.items():
        leafs[len(tokens), tokens[:3]] |= where
    support = Counter()
    known = [t for t in held if len(leafs[len(t), t[:3]]) >= least]
    for tokens in known:
        for i, token in enumerate(tokens):
            support[len(tokens), tokens[:3], i, token] += len(held[tokens])
    shape, seen = {}, defaultdict(set)
    for tokens in known:
        out = tuple(t if support[len(tokens), tokens[:3], i, t] >= least else None for i, t in enumerate(tokens))
        if sum(t is not None for t in out) >= 0.5 * len(tokens):
            shape[tokens] = tuple(t or b"<*>" for t in out)
            seen[shape[tokens]] |= held[tokens]
    gone = {t for t, s in shape.items() if len(seen[s]) >= least}
    return {t: "\n".join(x for x in t.split("\n") if tuple(tokens_of(x.encode())) not in gone) if t is not None else None for t in texts}


def corpus(seed):
    draw = random.Random(seed)
    words = [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"] + ["the", "of", "and"]
    names = [a + b + c for a in "ABCDEFGH" for b in "aeiouy" for c in "dfgklmnprst"]
    rows = []
    for i in range(260):
        lines = [" ".join(draw.choices(words, k=draw.randint(0, 8))) for _ in range(draw.randint(0, 6))]
        if draw.random() < 0.3:
            lines.insert(draw.randint(0, len(lines)), f"Posted by user {draw.choice(names)}{i} on page {draw.randint(1, 900)} of this forum")
        if draw.random() < 0.3:
            lines.append(f"Share this article with {draw.choice(names)} and subscribe now")
        if draw.random() < 0.2:
            lines.append("All rights  reserved.")
        rows.append((i, "\n".join(lines)))
    rows += [(1000 + i, "A text of which there are many copies\nand its second line is here") for i in range(50)]
    rows += [(None, None), (2, ""), (None, rows[5][1]), (5, rows[5][1]), (3000, "All rights reserved.\n" * 3000 + "end"), (3001, "\n\n \n")]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("bits", [6, 23])
def test_equal_to_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(line_templates, "BITMAP_BITS", bits)
    rows = corpus(bits)
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    found = drop_templates(docs)
    assert found.columns == ["doc_id", "text", "leaf", "key", "lines", "lines_dropped"]
    want = brute([t for _, t in rows], 5)
    got = sorted((str(r.doc_id), str(r.text), r.lines, r.lines_dropped) for r in found.collect())
    count = lambda t: 0 if t is None else t.count("\n") + 1
    kept = lambda t: 0 if not t or not want[t] else count(want[t])
    for r in found.collect():
        assert r.lines_dropped <= r.lines
    assert [g[:3] for g in got] == sorted((str(i), str(want[t]), count(t)) for i, t in rows)
    text = "\n".join(w for w in want.values() if w)
    assert "Posted by" not in text and "subscribe" not in text and "All rights" not in text
    assert "A text of which there are many copies" in text
    assert kept(rows[0][1]) <= count(rows[0][1])


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert drop_templates(docs).collect() == []
