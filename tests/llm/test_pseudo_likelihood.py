"""The window network: scores against a plain loop, gradients against differences, held-out likelihood, edge rows."""

import math
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from basketflow.llm import pseudo_likelihood as pl
from basketflow.llm.pseudo_likelihood import SIZE, WINDOW, Network, TokenIds, Trainer, padded, pseudo_likelihood
from basketflow.session import Scratch


def plain_score(net, tokens):
    """Sum of log-probabilities, a token at a time."""
    total = 0.0
    for i, token in enumerate(tokens):
        a = net.bias.astype(float).copy()
        for table, o in zip(net.context, [x for x in range(-WINDOW, WINDOW + 1) if x], strict=True):
            a += table[tokens[i + o] if 0 <= i + o < len(tokens) else 0]
        total += token_log_probability(net, np.tanh(a), int(token))
    return total


def token_log_probability(net, hidden, token):
    """Of the token's class among all classes, and of the token among those of its class."""
    of = token // pl.CLASS_SIZE
    kinds = [float(hidden @ w + b) for w, b in zip(net.classes, net.class_bias, strict=True)]
    first = of * pl.CLASS_SIZE
    inside = [float(hidden @ net.output[t] + net.output_bias[t]) for t in range(first, first + pl.CLASS_SIZE)]
    return kinds[of] - math.log(sum(map(math.exp, kinds))) + inside[token - first] - math.log(sum(map(math.exp, inside)))


def test_probabilities_of_all_tokens_add_up_to_one():
    net = Network.fresh(np.random.default_rng(2).integers(0, 50, SIZE).astype(float))
    hidden = np.tanh(np.random.default_rng(3).normal(size=pl.HIDDEN))
    assert math.isclose(sum(math.exp(token_log_probability(net, hidden, t)) for t in range(SIZE)), 1, rel_tol=1e-5)


def test_scores_equal_a_plain_loop():
    draw = np.random.default_rng(0)
    net = Network.fresh(draw.integers(0, 99, SIZE).astype(float))
    texts = [draw.integers(1, SIZE, n).astype(np.uint8) for n in (0, 1, 2, 3, 50, 0, 7)]
    tokens, at, owner = padded(texts)
    scores = np.bincount(owner, net.log_probabilities(tokens, at), len(texts))
    assert np.allclose(scores, [plain_score(net, t) for t in texts], rtol=1e-4, atol=1e-4)
    assert np.allclose(net.packed(), Network.unpacked(net.packed()).packed())


def test_a_step_follows_the_gradient():
    draw = np.random.default_rng(1)
    windows, targets = draw.integers(0, SIZE, (64, 2 * WINDOW)), draw.integers(1, SIZE, 64)

    def loss(net):
        hidden = np.tanh(net.bias + sum(net.context[i][windows[:, i]] for i in range(2 * WINDOW)))
        return -float(np.mean([token_log_probability(net, h, int(t)) for h, t in zip(hidden.astype(float), targets, strict=True)]))

    net = Network.fresh(np.ones(SIZE))
    trainer, before = Trainer(net), loss(net)
    for _ in range(40):
        trainer.step(windows, targets)
    assert loss(net) < before - 1


def test_gradients_equal_differences():
    """The first Adagrad step shows the gradient of every weight; compared with differences of the loss."""
    draw = np.random.default_rng(7)
    windows, targets = draw.integers(0, SIZE, (40, 2 * WINDOW)), draw.integers(1, SIZE, 40)

    def loss(net):
        hidden = np.tanh(net.bias + sum(net.context[i][windows[:, i]] for i in range(2 * WINDOW)))
        return -float(np.mean([token_log_probability(net, h, int(t)) for h, t in zip(hidden, targets, strict=True)]))

    net = Network.fresh(np.ones(SIZE))
    trainer = Trainer(net)
    before = [a.copy() for a in net.arrays()]
    trainer.step(windows, targets)
    for k, (old, square) in enumerate(zip(before, trainer.squares, strict=True)):
        place = np.unravel_index(np.argmax(square), square.shape)
        size = math.sqrt(float(square[place]) - 1e-3)
        ends = []
        for step in (1e-3, -1e-3):
            wide = Network(*[a.astype(np.float64) for a in before])
            wide.arrays()[k][place] = old[place] + step
            ends.append(loss(wide))
        slope = (ends[0] - ends[1]) / 2e-3
        assert math.isclose(abs(slope), size, rel_tol=2e-2, abs_tol=2e-4)
        assert slope * (net.arrays()[k][place] - old[place]) <= 0


def grammar(seed, count):
    """Texts in which each word follows from its neighbors."""
    draw = random.Random(seed)
    out = []
    for _ in range(count):
        word, words = draw.randrange(40), []
        for _ in range(draw.randint(5, 120)):
            words.append(f"w{word}")
            word = (word + draw.choice([1, 1, 1, 7])) % 40
        out.append(" ".join(words))
    return out


def test_held_out_text_is_likelier_than_shuffled(spark, monkeypatch):
    monkeypatch.setattr(pl, "MASK_EVERY", 2)
    known, unseen = grammar(1, 1500), grammar(2, 30)
    draw = random.Random(3)
    mixed = [" ".join(draw.sample(t.split(), len(t.split()))) for t in unseen]
    # the unseen texts are a fiftieth of the corpus, so the model comes from the known ones
    rows = list(enumerate(known)) + [(10_000 + i, t) for i, t in enumerate(unseen)] + [(20_000 + i, t) for i, t in enumerate(mixed)]
    edge = [(None, None), (30_000, ""), (30_001, " \n"), (5, known[5]), (30_002, "w1 " * 70_000)]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows + edge], "doc_id long, text string, score string, tokens double")
    found = pseudo_likelihood(docs.repartition(3))
    assert found.columns == ["doc_id", "n_tokens", "score", "mean_score"]
    got = found.collect()
    assert len(got) == len(rows) + len(edge)
    mean = {r.doc_id: r.mean_score for r in got}
    likely, unlikely = (np.mean([mean[b + i] for i in range(30)]) for b in (10_000, 20_000))
    assert likely > math.log(1 / 40) + 1.2 and likely > unlikely + 1.2
    assert {(r.n_tokens, r.score, r.mean_score) for r in got if r.doc_id in (None, 30_000, 30_001)} == {(0, 0.0, None)}
    assert len({round(r.score, 2) for r in got if r.doc_id == 5}) == 1
    assert next(r.n_tokens for r in got if r.doc_id == 30_002) == 70_000


def test_rounds_train_every_position():
    """Over the rounds, as set for production or fewer, the targets are all tokens of all texts, short ones too."""
    draw = np.random.default_rng(4)
    texts = [draw.integers(1, SIZE, n).astype(np.uint8).tobytes() for n in (1, 2, 0, 3, 500, 1, 4000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(part, pa.binary())], names=["tokens"]) for part in (texts[:4], texts[4:])]
    shared = SimpleNamespace(value=Network.fresh(np.ones(SIZE)).packed())

    def trained(rounds):
        return [sum(sum(out["examples"].to_pylist()) for out in pl._train(shared, turn, rounds)(iter(batches))) for turn in range(rounds)]

    total = sum(map(len, texts))
    assert sum(trained(pl.ROUNDS)) == sum(trained(1)) == total and min(trained(pl.ROUNDS)) > 0
    assert min(trained(3)) > 0 and sum(trained(3)[:2]) == total


def test_words_of_one_bucket_have_probabilities_of_their_own(spark, monkeypatch):
    """Two words of one token differ by their counts, in whatever chunk, and the probabilities of a token's words add up to its own."""
    common = [f"f{i}" for i in range(pl.WORDS)]
    ids, by_bucket = TokenIds({}), {}
    for i in range(200):
        by_bucket.setdefault(ids[f"r{i}".encode()], []).append(f"r{i}")
    often, seldom, once = max(by_bucket.values(), key=len)[:3]
    texts = [" ".join(common)] * 90 + [f"f1 f2 {w} f3 f4" for w, n in ((often, 60), (seldom, 20), (once, 1)) for _ in range(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r.doc_id: r.score for r in pseudo_likelihood(docs.coalesce(1)).collect()}
    assert math.isclose(whole[90] - whole[150], math.log(60 / 20), abs_tol=1e-3)
    assert math.isclose(whole[90] - whole[170], math.log(60), abs_tol=1e-3)
    # the same where few words, or none, have their counts at hand
    for few in (0, 2):
        monkeypatch.setattr(pl, "KNOWN_WORDS", few)
        small = {r.doc_id: r.score for r in pseudo_likelihood(docs.coalesce(1)).collect()}
        assert small.keys() == whole.keys() and all(math.isclose(small[i], whole[i], abs_tol=1e-3) for i in whole)


@pytest.mark.parametrize("known", [0, 30, 1 << 18])
def test_whole_scores_equal_a_plain_loop(spark, monkeypatch, known):
    """Network, tokens and word shares together: each score from the network's own probabilities and counts of a plain dictionary."""
    monkeypatch.setattr(pl, "KNOWN_WORDS", known)
    draw = random.Random(6)
    vocabulary = [f"v{i}" for i in range(900)] + ["é" * 40, "İx", "x" * 99]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = [" ".join(draw.choices(vocabulary, weights, k=draw.randint(0, 60))) for _ in range(150)] + [None, "", "V1 v1\tonce", "é" * 40 + " " + "x" * 99]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    with Scratch(spark) as scratch:
        _, _, network = pl.fitted(docs, scratch)
    words = [(t or "").encode().lower().split() for t in texts]
    counts = Counter(w for t in words for w in t)
    frequent = sorted(counts, key=lambda w: (-counts[w], w))[: pl.WORDS]
    ids = TokenIds({w: i + 1 for i, w in enumerate(frequent)})
    totals = Counter()
    for w, n in counts.items():
        totals[ids[w]] += n
    got = {r.doc_id: r for r in pseudo_likelihood(docs).collect()}
    for i, held in enumerate(words):
        tokens = np.array([ids[w] for w in held], np.uint8)
        score = plain_score(network, tokens) + sum(math.log(counts[w] / totals[ids[w]]) for w in held if ids[w] > pl.WORDS)
        assert got[i].n_tokens == len(held) and math.isclose(got[i].score, score, rel_tol=1e-4, abs_tol=1e-3)


def test_empty_table_and_rare_words(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pseudo_likelihood(docs).collect() == []
    ids = TokenIds({b"the": 1})
    tokens = ids.of("The xyzzy the")
    assert tokens[0] == tokens[2] == 1 and 1 + pl.WORDS <= tokens[1] < SIZE
