"""Spliced chunks against the library on whole texts."""

import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from basketflow.llm.token_counts import SPACE, token_counts, token_spans, token_table, vocabulary  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_tokens string, ids int"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    draw = random.Random(3)
    words = ["the", "token", "naïve", "straße", "日本語", "données", "x1", "😀", "\n", "\t", "  ", "<s>", "</s>", "a▁b", "\x00", "é", "…"]
    out = ["", " ", "  ", "a", "aaaa", "<unk> </s>", "▁", " ", "😀"]
    for _ in range(120):
        out.append(draw.choice(["", " "]).join(draw.choices(words, k=draw.randint(1, 400))))
    for _ in range(30):
        out.append("".join(draw.choices("ab", k=draw.randint(50, 900))))
    out += ["a" * 5000, " " * 3000, "ab " * 2000, "\n" * 1500, "漢" * 700, "=" * 2000 + " end", "word" * 900]
    return out


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 20), (64, 32), (300, 40), (10_000, 256)])
def test_equal_to_the_library_whatever_the_chunks(library, chunk, overlap):
    vocab = vocabulary(PATH)
    for text in texts():
        found = np.concatenate([ids for ids, _ in token_spans(vocab, text, chunk, overlap)])
        assert found.tolist() == library.encode(text), (text[:60], chunk)


def test_boundaries_are_stable_only_where_no_piece_crosses():
    vocab = vocabulary(PATH)
    assert vocab.stable("the" + SPACE + "end", 3)
    assert not vocab.stable(SPACE + "the" + SPACE, 2)
    text = "ab" * 20
    crossing = any(text[i:j] in vocab.pieces for i in range(10) for j in range(11, len(text) + 1))
    assert vocab.stable(text, 10) is not crossing


def test_overlaps_are_widened_where_alignment_fails(library):
    """A run without a stable boundary is longer than many overlaps."""
    text = "start " + "a" * 700 + " then more words " * 400
    portions = list(token_spans(vocabulary(PATH), text, 64, 32))
    assert sum(len(i) for i, _ in portions) == len(library.encode(text))
    lengths = np.diff([0, *[int(e[-1]) for _, e in portions]])
    assert lengths.max() > 700 and len(portions) > 50 and lengths[-3:].max() < 100


def test_counts_of_a_table(spark, library):
    rows = [(i, t) for i, t in enumerate(texts())] + [(3, None), (None, "no id"), (3, "again"), (3, "again"), (9, "long text " * 40_000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    found = token_counts(docs, limit=900)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    expected = []
    for i, t in rows:
        n = len(library.encode(t or ""))
        expected.append((i, len((t or "").encode()), n, n > 900))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    assert token_counts(docs.limit(0)).collect() == []


def test_spans_lead_back_to_the_text(spark, library):
    rows = [(i, t) for i, t in enumerate(["some words here " * 30, "naïve 😀 text", "", None])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    found = {}
    for r in token_table(docs, chunk=64, overlap=32).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == {i for i, _ in rows}
    for i, t in rows:
        portions = sorted(found[i], key=lambda r: r.ends[-1] if r.ends else -1)
        assert [x for r in portions for x in r.ids] == library.encode(t or "")
        spans = [(a, b) for r in portions for a, b in zip(r.starts, r.ends, strict=True)]
        assert "".join((t or "")[a:b] for a, b in spans) == (t or "")
