"""Spelling variants against comparing all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from basketflow.llm.spelling_groups import corpus_words, near_pairs, spelling_groups
from basketflow.session import Scratch

SCHEMA = "doc_id long, text string, word string, n int, root string"


def one_edit(a, b):
    """Whether exactly one inserted, deleted or replaced code point makes a into b."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    at = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :]


def counted(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute(rows):
    n = counted(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def variants(word, draw, letters):
    at = draw.randrange(len(word) + 1)
    kind = draw.randrange(3)
    if kind == 0:
        return word[:at] + draw.choice(letters) + word[at:]
    at = min(at, len(word) - 1)
    return word[:at] + ("" if kind == 1 else draw.choice(letters)) + word[at + 1 :]


def corpus(seed):
    draw = random.Random(seed)
    letters = "abcdeé" if seed % 2 else "ab"
    base = ["".join(draw.choices(letters, k=draw.randint(6, 14))) for _ in range(60)]
    pool = base + [variants(w, draw, letters) for w in base for _ in range(4)]
    pool += [variants(w, draw, letters) for w in pool[60:160]] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "baaaaaaa", "aaaaaaab", "Àÿ" * 5, "àÿ" * 5, "zz"]
    weights = [draw.choice([1, 3, 40]) for _ in pool]
    rows = []
    for i in range(60):
        words = [w.upper() if draw.random() < 0.1 else w for w in draw.choices(pool, weights, k=60)]
        rows.append((draw.choice([i, 7, None]), draw.choice([" ", "-", " 1 ", "\n"]).join(words)))
    long = "abcdefghij" * 400
    rows += [(500, None), (501, ""), (502, "12 34"), (503, f"{long} {long} {long}x {long}x q{long} q{long} {long[1:]} {long[1:]}")]
    rows += [rows[0], rows[0]]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_to_all_pairs(spark, seed):
    rows = corpus(seed)
    found = spelling_groups(frame(spark, rows))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_pairs_of_many_short_alphabets(spark):
    """All words of two letters and nine places: every word has near ones at every place, runs included."""
    words = sorted({"".join(random.Random(i).choices("ab", k=random.Random(-i - 1).choice([7, 8, 9]))) for i in range(500)})
    table = spark.createDataFrame(list(enumerate(words)), "id long, word string")
    with Scratch(spark) as scratch:
        found = {(words[r.a], words[r.b]) if words[r.a] < words[r.b] else (words[r.b], words[r.a]) for r in near_pairs(table, scratch).collect()}
    assert found == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def test_words_counted_once_per_occurrence(spark):
    rows = corpus(5)
    assert {r.word: r.n for r in corpus_words(frame(spark, rows)).collect()} == counted(rows)


def test_chain_of_forms_leads_to_its_root(spark):
    rows = [(0, "wordsab " * 2 + "wordsabc " * 30 + "wordsabcd " * 400 + "wordsabcde " * 5000)]
    found = {r.word: (r.form, r.root) for r in spelling_groups(frame(spark, rows)).collect()}
    assert set(dict(brute(rows)[i][:2] for i in range(len(found)))) == set(found)
    assert sorted((w, *f) for w, f in found.items()) == [x[:3] for x in brute(rows)]


def test_empty_table(spark):
    assert spelling_groups(frame(spark, corpus(1)).limit(0)).collect() == []
