"""Masked pseudo-likelihood: a small two-sided window network predicts every token; its log-probabilities score texts.

Tokens are the most frequent words of the whole corpus; all other words share
hash buckets.  The probability of a word is that of its token by the network
times the word's share of the token's count in the corpus, so every word has
its own, however many there are.  A token is predicted from WINDOW tokens on
each side, itself masked: hidden = tanh(bias + sum over the offsets of a table
row per context token), probabilities = softmax(hidden x output + output bias).

Training goes over the whole corpus in rounds.  In a round every task takes
gradient steps (Adagrad) on one masked position of every MASK_EVERY of its
texts, from the weights of the round before; the weights of the tasks are
averaged by the number of their examples.  All rounds together train every
position.  A score is the sum of the conditional log-probabilities of all
words of the whole text.

The counts of the words stay a table.  Where a text is encoded, the counts of a
bounded number of words are at hand; only the rarer words of a text, which are
a small part of it and none of which is frequent, are joined with the table,
and words that occur once need no count.  The network scores every text where
it lies: no text is ever shuffled.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.llm.words import words_of
from basketflow.session import Scratch, settle

WORDS, BUCKETS = 191, 64  # token 0 stands outside the text, so a token is one byte
SIZE = 1 + WORDS + BUCKETS
CLASS_SIZE = 16  # tokens of like frequency make a class
CLASSES = SIZE // CLASS_SIZE
WINDOW, HIDDEN = 2, 24
MASK_EVERY = ROUNDS = 2  # so each position is masked in one round
BATCH, RATE = 1024, 0.1
CHUNK = 8192  # positions scored at once
SCORED_TEXTS = 1000  # whose positions are held at once
KNOWN_WORDS, KNOWN_BYTES = 1 << 18, 32  # words whose counts every task has, and the longest of them: 12 MB at most
GROUPS = 64  # of tasks whose weights are added before the driver sees them
_OFFSETS = [o for o in range(-WINDOW, WINDOW + 1) if o]


class TokenIds(dict):
    """Token of a word (bytes): its number if it is frequent, else its bucket."""

    def __missing__(self, word: bytes) -> int:
        return 1 + WORDS + zlib.crc32(word) % BUCKETS

    def of(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), np.uint8, len(words))


@dataclass(frozen=True)
class Lexicon:
    """Tokens of the frequent words, counts of the most frequent other words, and the counts of all tokens."""

    ids: TokenIds
    known: dict[bytes, int]  # word outside the frequent ones -> its count
    totals: np.ndarray

    def codes(self) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
        """Code per word; token and log-share of the token per code.  Frequent words are their token."""
        words = list(self.known)
        code = dict(self.ids) | {w: SIZE + i for i, w in enumerate(words)}
        tokens = np.array([*range(SIZE), *map(self.ids.__missing__, words)], np.uint8)
        logs = np.zeros(SIZE + len(words))
        logs[SIZE:] = np.log(np.fromiter(self.known.values(), np.float64, len(words)))
        logs[SIZE:] -= np.log(np.maximum(self.totals, 1))[tokens[SIZE:]]
        return code, tokens, logs


def _log_softmax(logits: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Of the row ``own`` of each column; ``logits`` is used up."""
    logits -= logits.max(axis=0)
    chosen = logits[own, np.arange(logits.shape[1])].astype(np.float64)
    np.exp(logits, out=logits)
    return chosen - np.log(logits.sum(axis=0))


def _errors(logits: np.ndarray, own: np.ndarray, count: int) -> np.ndarray:
    """Softmax of each column less one at its row ``own``, over ``count``."""
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0) * np.float32(count)
    logits[own, np.arange(logits.shape[1])] -= np.float32(1 / count)
    return logits


def _by_class(targets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """Places in order of their class, and the span of each class that occurs."""
    kinds = targets // CLASS_SIZE
    order = np.argsort(kinds, kind="stable")
    ends = np.cumsum(np.bincount(kinds, minlength=CLASSES)).tolist()
    spans = [(g, slice(a, b)) for g, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if b > a]
    return order, spans


@dataclass
class Network:
    context: np.ndarray  # offsets x SIZE x HIDDEN
    bias: np.ndarray
    classes: np.ndarray  # CLASSES x HIDDEN
    class_bias: np.ndarray
    output: np.ndarray  # SIZE x HIDDEN
    output_bias: np.ndarray

    @classmethod
    def fresh(cls, counts: np.ndarray, seed: int = 2) -> Network:
        """Small random weights; the biases start at the smoothed frequencies of classes, and of tokens in their class."""
        draw = np.random.default_rng(seed)
        shares = ((counts + 0.5) / (counts + 0.5).sum()).reshape(CLASSES, CLASS_SIZE)
        of_class = shares.sum(axis=1)
        small = lambda scale, *shape: draw.normal(0, scale, shape).astype(np.float32)
        return cls(small(0.3, len(_OFFSETS), SIZE, HIDDEN), np.zeros(HIDDEN, np.float32), small(0.1, CLASSES, HIDDEN),
                   np.log(of_class).astype(np.float32), small(0.1, SIZE, HIDDEN), np.log(shares / of_class[:, None]).ravel().astype(np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.context, self.bias, self.classes, self.class_bias, self.output, self.output_bias]

    def packed(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()]).astype(np.float64)

    @classmethod
    def unpacked(cls, flat: np.ndarray) -> Network:
        shapes = [(len(_OFFSETS), SIZE, HIDDEN), (HIDDEN,), (CLASSES, HIDDEN), (CLASSES,), (SIZE, HIDDEN), (SIZE,)]
        parts, at = [], 0
        for shape in shapes:
            size = int(np.prod(shape))
            parts.append(flat[at : at + size].reshape(shape).astype(np.float32))
            at += size
        return cls(*parts)

    def hidden(self, windows: list[np.ndarray]) -> np.ndarray:
        """Examples x HIDDEN, from the context tokens of each offset."""
        total = np.broadcast_to(self.bias, (len(windows[0]), HIDDEN)).copy()
        for table, tokens in zip(self.context, windows, strict=True):
            total += table.take(tokens, axis=0)
        return np.tanh(total, out=total)

    def log_probabilities(self, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the tokens at the positions ``at``, each given its window; the text is padded by WINDOW zeros."""
        out = np.empty(len(at), np.float64)
        for start in range(0, len(at), CHUNK):
            some = at[start : start + CHUNK]
            targets = tokens[some]
            hidden = self.hidden([tokens[some + o] for o in _OFFSETS])
            logits = self.classes @ hidden.T
            logits += self.class_bias[:, None]
            found = _log_softmax(logits, targets // CLASS_SIZE)
            order, spans = _by_class(targets)
            hidden, own = hidden.take(order, axis=0), targets[order] % CLASS_SIZE
            for g, span in spans:
                some_of = slice(g * CLASS_SIZE, (g + 1) * CLASS_SIZE)
                logits = self.output[some_of] @ hidden[span].T
                logits += self.output_bias[some_of, None]
                found[order[span]] += _log_softmax(logits, own[span])
            out[start : start + CHUNK] = found
        return out


class Trainer:
    """Adagrad steps on batches of masked positions."""

    def __init__(self, network: Network):
        self.net = network
        self.squares = [np.full_like(a, 1e-3) for a in network.arrays()]

    def step(self, windows: np.ndarray, targets: np.ndarray) -> None:
        """``windows`` holds the context tokens (examples x offsets)."""
        net, count = self.net, len(targets)
        hidden = net.hidden([windows[:, i] for i in range(len(net.context))])
        logits = net.classes @ hidden.T
        logits += net.class_bias[:, None]
        wrong = _errors(logits, targets // CLASS_SIZE, count)
        inner = wrong.T @ net.classes
        of_classes, of_class_bias = wrong @ hidden, wrong.sum(axis=1)
        order, spans = _by_class(targets)
        ordered, own, back = hidden.take(order, axis=0), targets[order] % CLASS_SIZE, np.empty_like(inner)
        of_output, of_output_bias = np.zeros_like(net.output), np.zeros_like(net.output_bias)
        for g, span in spans:
            some_of = slice(g * CLASS_SIZE, (g + 1) * CLASS_SIZE)
            logits = net.output[some_of] @ ordered[span].T
            logits += net.output_bias[some_of, None]
            wrong = _errors(logits, own[span], count)
            of_output[some_of], of_output_bias[some_of] = wrong @ ordered[span], wrong.sum(axis=1)
            back[span] = wrong.T @ net.output[some_of]
        inner[order] += back
        inner *= 1 - hidden * hidden
        # sums of the rows of `inner` by context token, one table per offset
        tables, places = np.empty_like(net.context), windows.astype(np.int64) * HIDDEN
        for i in range(len(tables)):
            at = (places[:, i, None] + np.arange(HIDDEN)).ravel()
            tables[i] = np.bincount(at, inner.ravel(), SIZE * HIDDEN).reshape(SIZE, HIDDEN)
        gradients = tables, inner.sum(axis=0), of_classes, of_class_bias, of_output, of_output_bias
        for array, square, gradient in zip(net.arrays(), self.squares, gradients, strict=True):
            square += gradient * gradient
            array -= RATE * gradient / np.sqrt(square)


def padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array with WINDOW zeros around each; the positions of their tokens, and whose they are."""
    gap = np.zeros(WINDOW, np.uint8)
    tokens = np.concatenate([gap, *[x for t in texts for x in (t, gap)]])
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = WINDOW + np.concatenate([[0], np.cumsum(sizes + WINDOW)[:-1]]) if len(texts) else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    return tokens, at.astype(np.int64), owner


def _texts(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint8) for x in batch.column(column)]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flushed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        counts.clear()
        return batch

    for batch in batches:
        for text in batch.column(0):
            counts.update(words_of(text.as_py()))
            if len(counts) > 300_000:
                yield flushed()
    yield flushed()


def _train(shared, turn: int, rounds: int):
    parts = min(rounds, MASK_EVERY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network.unpacked(shared.value)
        trainer, examples = Trainer(network), 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = number = 0
        for batch in batches:
            tokens, at, _ = padded(_texts(batch, 0))
            # one position of every MASK_EVERY, another one in each round, none left out
            drawn = (np.arange(number, number + len(at), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            # with fewer rounds than MASK_EVERY, a round takes several residues
            chosen = at[drawn % np.uint64(MASK_EVERY) % np.uint64(parts) == np.uint64(turn % parts)]
            number += len(at)
            held.append((np.stack([tokens[chosen + o] for o in _OFFSETS], axis=1), tokens[chosen]))
            waiting += len(chosen)
            while waiting >= BATCH:
                windows, targets = (np.concatenate(x) for x in zip(*held, strict=True))
                for start in range(0, len(targets) - BATCH + 1, BATCH):
                    trainer.step(windows[start : start + BATCH], targets[start : start + BATCH])
                    examples += BATCH
                rest = len(targets) % BATCH
                held, waiting = [(windows[len(targets) - rest :], targets[len(targets) - rest :])], rest
        if waiting:
            windows, targets = (np.concatenate(x) for x in zip(*held, strict=True))
            trainer.step(windows, targets)
            examples += waiting
        if examples:
            weights = (network.packed() * examples).tobytes()
            group = zlib.crc32(weights) % GROUPS
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([examples], pa.int64()), pa.array([weights], pa.binary())], names=["part", "examples", "weights"])

    return run


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(rows["weights"].iloc[0]) // 8)
    for weights in rows["weights"]:
        total += np.frombuffer(weights)
    return pd.DataFrame({"examples": [rows["examples"].sum()], "weights": [total.tobytes()]})


def train(encoded: DataFrame, counts: np.ndarray, scratch: Scratch, rounds: int = ROUNDS) -> Network:
    """A network trained on all rows of ``encoded`` (tokens binary); the driver gets at most GROUPS sums a round."""
    weights = Network.fresh(counts).packed()
    for turn in range(rounds):
        shared = encoded.sparkSession.sparkContext.broadcast(weights)
        trained = encoded.select("tokens").mapInArrow(_train(shared, turn, rounds), "part int, examples long, weights binary")
        sums = scratch.settle(trained.groupBy("part").applyInPandas(_added, "examples long, weights binary")).toArrow()
        examples = sum(sums["examples"].to_pylist())
        if examples:
            weights = sum(np.frombuffer(w) for w in sums["weights"].to_pylist()) / examples
    return Network.unpacked(weights)


def _encode(shared):
    """Per text its tokens, the log-shares of its known words, and its rarer words, of whose shares only the tokens' part is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon: Lexicon = shared.value
        code, token_of, log_of = lexicon.codes()
        minus = np.log(np.maximum(lexicon.totals, 1))
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            tokens, extra, words, times = [], [], [], []
            for text in batch.column(1):
                found = words_of(text.as_py())
                codes = np.fromiter(map(code.get, found, repeat(-1)), np.int64, len(found))
                own = token_of[codes]
                rare = np.flatnonzero(codes < 0)
                lost = [found[i] for i in rare.tolist()]
                own[rare] = np.fromiter(map(lexicon.ids.__missing__, lost), np.uint8, len(lost))
                counts = Counter(lost)
                tokens.append(own.tobytes())
                extra.append(float(log_of[codes[codes >= 0]].sum() - minus[own[rare]].sum()))
                words.append(list(counts))
                times.append(list(counts.values()))
            rows = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [rows, batch.column(0), pa.array(tokens, pa.binary()), pa.array(extra, pa.float64()), pa.array(words, pa.list_(pa.binary())),
                 pa.array(times, pa.list_(pa.int64()))], names=["row", "doc_id", "tokens", "extra", "words", "times"])

    return run


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network.unpacked(shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, SCORED_TEXTS):
                batch = whole.slice(start, SCORED_TEXTS)
                tokens, at, owner = padded(_texts(batch, 2))
                scores = np.bincount(owner, network.log_probabilities(tokens, at), batch.num_rows) + batch.column(3).to_numpy()
                sizes = np.bincount(owner, minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(scores)],
                                                 names=["row", "doc_id", "n_tokens", "partial"])

    return run


def lexicon_of(counted: DataFrame) -> Lexicon:
    """From the counts (word, n) of all words; the driver gets WORDS + KNOWN_WORDS short words at most."""
    frequent = counted.orderBy(F.desc("n"), "word").limit(WORDS).toArrow()
    ids = TokenIds({w: i + 1 for i, w in enumerate(frequent["word"].to_pylist())})
    counts = np.zeros(SIZE)
    buckets = counted.groupBy((F.crc32("word") % BUCKETS).alias("bucket")).agg(F.sum("n").alias("n")).toArrow()
    counts[1 + WORDS + buckets["bucket"].to_numpy()] = buckets["n"].to_numpy()
    for word, n in zip(frequent["word"].to_pylist(), frequent["n"].to_pylist(), strict=True):
        counts[ids[word]] = n
        counts[TokenIds()[word]] -= n
    short = counted.where((F.octet_length("word") <= KNOWN_BYTES) & (F.col("n") > 1))
    # from the highest level of counts down, as long as the words of all levels together are few enough
    level = F.floor(8 * F.log2("n"))
    levels = short.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).toArrow()
    lowest, held = 1 << 20, 0
    for at, n in sorted(zip(levels["level"].to_pylist(), levels["words"].to_pylist(), strict=True), reverse=True):
        held += n
        if held > WORDS + KNOWN_WORDS:
            break
        lowest = at
    known = short.where(level >= lowest).toArrow()
    pairs = zip(known["word"].to_pylist(), known["n"].to_pylist(), strict=True)
    return Lexicon(ids, {w: n for w, n in pairs if w not in ids}, counts)


def fitted(texts: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, Network]:
    """The counts of all words, the encoded rows of ``texts`` (doc_id, text), and the network trained on all of them."""
    counted = texts.select("text").mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = scratch.settle(counted)
    lexicon = lexicon_of(counted)
    schema = "row long, doc_id long, tokens binary, extra double, words array<binary>, times array<long>"
    encoded = scratch.settle(texts.mapInArrow(_encode(texts.sparkSession.sparkContext.broadcast(lexicon)), schema))
    return counted, encoded, train(encoded, lexicon.totals, scratch, rounds)


def pseudo_likelihood(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Rows (doc_id, n_tokens, score, mean_score) of every row of ``docs``, by a network trained on all of them.

    score is the sum of the log-probabilities of all words, 0 for a null or
    empty text, mean_score its share per word, null there.  Words are counted
    over the whole corpus; ties among frequent words go to the smaller one.
    Repeated rows are scored each, equal texts alike to single precision.
    The weights are averaged over tasks, so a table cut into other tasks
    gives slightly other scores.  Other columns are not read.  The result is
    settled.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with Scratch(spark) as scratch:
        counted, encoded, network = fitted(texts, scratch, rounds)
        shared = spark.sparkContext.broadcast(network.packed())
        scored = encoded.select("row", "doc_id", "tokens", "extra").mapInArrow(_score(shared), "row long, doc_id long, n_tokens long, partial double")
        # words that occur once have a count whose logarithm is 0
        rare = encoded.where(F.size("words") > 0).select("row", F.inline(F.arrays_zip("words", "times"))).withColumnRenamed("words", "word")
        rare = rare.join(counted.where("n > 1"), "word").groupBy("row").agg(F.sum(F.col("times") * F.log("n")).alias("rare"))
        whole = scored.join(rare, "row", "left").withColumn("score", F.col("partial") + F.coalesce("rare", F.lit(0.0)))
        mean = F.when(F.col("n_tokens") > 0, F.col("score") / F.col("n_tokens"))
        return settle(whole.select("doc_id", "n_tokens", "score", mean.alias("mean_score")))
