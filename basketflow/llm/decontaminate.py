"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

The index holds the test items; a passage of training text is the query.  An
item's score is the sum of the BM25 weights of its terms that the passage
holds, as a share of the item's own total: 1 when the passage has all its
terms.  Passages are windows of two spans that overlap by one span, and a span
is as long as the longest item, so every copy of an item lies whole in a window.

Block-max WAND retrieves all items above a share: upper bounds of a window
over each block of items (the largest weight of each term in the block) leave
out most windows at once, for a whole Arrow batch; the rest walk the postings
document at a time, skipping by the term's largest weight and the block's.
Retrieved pairs are verified: the passage must hold the given share of the
5-word shingles of the item's question (all but its last sentence) and of its
answer (the last sentence).

The index is cut into shards of bounded size; all documents query each shard
in turn, so neither the driver nor a task holds more than one shard.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.llm.words import shingle_hashes, words_of
from basketflow.session import Scratch, settle

K1, B = 1.2, 0.75
SHARE = 0.6  # of an item's own score, to be retrieved
OVERLAP = 0.8  # of the shingles of question and answer, to be verified
SHARD_ITEMS, SHARD_BYTES = 4096, 8 << 20
BATCH_WORDS = 200_000
HITS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


# Whatever stands around a word in ASCII and is no letter or digit; whitespace is gone already.
_AROUND = bytes(c for c in range(128) if not chr(c).isalnum())


def _bare(words: list[bytes]) -> list[bytes]:
    return [w for w in (x.strip(_AROUND) for x in words) if w]


def bare_words(text: str | None) -> list[bytes]:
    """The words of a text without the ASCII signs around them, so that marks set beside an item do not hide it."""
    return _bare(words_of(text))


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words of all sentences but the last, and of the last; an item of one sentence is both."""
    words = words_of(text)
    ends = [i for i, w in enumerate(words[:-1]) if w[-1:] in (b".", b"?", b"!")]
    if ends:
        question, answer = _bare(words[: ends[-1] + 1]), _bare(words[ends[-1] + 1 :])
        if question and answer:
            return question, answer
    return _bare(words), _bare(words)


@dataclass(frozen=True)
class Shard:
    """Postings of a bounded number of items, ordered by item, with block maxima."""

    items: list[int | None]
    terms: dict[bytes, int]
    postings: list[np.ndarray]  # per term: item positions, ascending
    weights: list[np.ndarray]  # per term: the share of the item's own score
    largest: np.ndarray  # per term
    blocks: np.ndarray  # terms x blocks: the largest weight in the block
    block_items: int
    span: int
    parts: list[tuple[tuple[int, np.ndarray], tuple[int, np.ndarray]]]  # (shingle width, shingles) of question and answer


def build_shard(items: list[tuple[int | None, str]], frequencies: dict[bytes, int], total: int, mean_words: float, span: int) -> Shard:
    """The index of ``items``; ``frequencies``, ``total``, ``mean_words`` and ``span`` are those of all items of all shards."""
    words = [bare_words(text) for _, text in items]
    # items of like length stand together, which makes block maxima tighter
    order = sorted(range(len(items)), key=lambda i: (len(words[i]), words[i]))
    terms: dict[bytes, int] = {}
    found: list[list[tuple[int, float]]] = []
    for place, i in enumerate(order):
        counts = Counter(words[i])
        weights = {}
        for term, tf in counts.items():
            df = frequencies[term]
            rarity = np.log1p((total - df + 0.5) / (df + 0.5))
            weights[term] = float(rarity * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words[i]) / mean_words)))
        own = sum(weights.values())
        for term, weight in weights.items():
            if term not in terms:
                terms[term] = len(found)
                found.append([])
            found[terms[term]].append((place, weight / own))
    block_items = max(4, -(-len(items) // 128))
    blocks = np.zeros((len(found), max(1, -(-len(items) // block_items))), np.float32)
    for term, entries in enumerate(found):
        for place, weight in entries:
            blocks[term, place // block_items] = max(blocks[term, place // block_items], weight)
    blocks *= np.float32(1 + 1e-6)  # single precision must not fall below a weight
    parts = []
    for i in order:
        parts.append(tuple((min(5, len(p)), shingle_hashes(p)) for p in question_and_answer(items[i][1])))
    return Shard(
        [items[i][0] for i in order], terms, [np.array([p for p, _ in e]) for e in found], [np.array([w for _, w in e]) for e in found],
        blocks.max(axis=1, initial=0.0), blocks, block_items, span, parts,
    )


def block_max_wand(shard: Shard, terms: list[int], least: float) -> list[tuple[int, float]]:
    """All (item position, score) with a score of at least ``least``, for a query of distinct terms."""
    least -= 1e-9
    found = []
    end = len(shard.items)
    lists = [(shard.postings[t].tolist(), shard.weights[t].tolist(), float(shard.largest[t]), t) for t in terms]
    at = [0] * len(lists)
    heads = [postings[0] for postings, *_ in lists]

    def seek(i: int, item: int) -> None:
        postings, place = lists[i][0], at[i]
        while place < len(postings) and postings[place] < item:
            place += 1
        at[i], heads[i] = place, postings[place] if place < len(postings) else end

    while True:
        order = sorted(range(len(lists)), key=heads.__getitem__)
        bound, pivot = 0.0, end
        for i in order:
            if heads[i] == end:
                break
            bound += lists[i][2]
            if bound >= least:
                pivot = heads[i]
                break
        if pivot == end:
            return found
        block = pivot // shard.block_items
        ahead = [i for i in order if heads[i] <= pivot]
        if sum(shard.blocks[lists[i][3], block] for i in ahead) < least:
            # nothing before the next block, or before the next list begins, can reach it
            rest = [heads[i] for i in order if heads[i] > pivot]
            for i in ahead:
                seek(i, min([(block + 1) * shard.block_items, *rest]))
        elif heads[order[0]] == pivot:
            score = sum(lists[i][1][at[i]] for i in ahead)
            if score >= least:
                found.append((pivot, score))
            for i in ahead:
                seek(i, pivot + 1)
        else:
            for i in ahead:
                seek(i, pivot)


def _verified(shard: Shard, item: int, passage: list[bytes], held: dict[int, np.ndarray]) -> tuple[float, float]:
    """The shares of the question's and the answer's shingles that the passage holds."""
    shares = []
    for width, wanted in shard.parts[item]:
        if width not in held:
            held[width] = shingle_hashes(passage, width)
        shares.append(float(np.isin(wanted, held[width], assume_unique=True).mean()))
    return shares[0], shares[1]


def _hits(shard: Shard, ids: list[int | None], texts: list[list[bytes]], share: float, overlap: float) -> Iterator[tuple]:
    """Verified (doc_id, item_id, score, question_overlap, answer_overlap) of some documents, one row per window."""
    size = [len(w) for w in texts]
    spans = [-(-n // shard.span) for n in size]
    first = np.concatenate([[0], np.cumsum(spans)])
    keys = []
    for doc, words in enumerate(texts):
        terms = np.fromiter(map(shard.terms.get, words, repeat(-1)), np.int64, len(words))
        known = np.flatnonzero(terms >= 0)
        keys.append((first[doc] + known // shard.span) * len(shard.terms) + terms[known])
    keys = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64)
    if not len(keys):
        return
    span_of, term_of = keys // len(shard.terms), keys % len(shard.terms)
    starts = np.flatnonzero(np.concatenate([[True], span_of[1:] != span_of[:-1]]))
    bounds = np.zeros((first[-1] + 1, shard.blocks.shape[1]), np.float32)
    bounds[span_of[starts]] = np.add.reduceat(shard.blocks[term_of], starts, axis=0)
    ends = np.searchsorted(span_of, np.arange(first[-1] + 1))
    doc_of = np.repeat(np.arange(len(texts)), spans)
    last = np.concatenate([doc_of[1:] != doc_of[:-1], [True]])
    paired = bounds[:-1].copy()
    paired[~last] += bounds[1:][~last]
    # a term that both spans of a window hold counts once
    twice = np.flatnonzero(np.isin(keys + len(shard.terms), keys, assume_unique=True) & ~last[span_of])
    if len(twice):
        begin = np.flatnonzero(np.concatenate([[True], span_of[twice][1:] != span_of[twice][:-1]]))
        paired[span_of[twice][begin]] -= np.add.reduceat(shard.blocks[term_of[twice]], begin, axis=0)
    # a window of two spans; the last span of a longer document lies in the window before it
    single = last & (np.concatenate([[True], last[:-1]]))
    for span in np.flatnonzero((paired.max(axis=1) >= share - 1e-4) & (~last | single)).tolist():
        doc = int(doc_of[span])
        terms = np.unique(term_of[ends[span] : ends[span + (1 if last[span] else 2)]]).tolist()
        found = block_max_wand(shard, terms, share)
        if not found:
            continue
        start = (span - int(first[doc])) * shard.span
        passage, held = texts[doc][start : start + 2 * shard.span], {}
        for item, score in found:
            question, answer = _verified(shard, item, passage, held)
            if question >= overlap and answer >= overlap:
                yield ids[doc], shard.items[item], score, question, answer


def _portions(ids: list, texts: pa.Array) -> Iterator[tuple[int, list, list[list[bytes]]]]:
    """(first row, ids, words) of consecutive rows with about BATCH_WORDS words together."""
    start, held, words = 0, [], 0
    for row, text in enumerate(texts):
        held.append(bare_words(text.as_py()))
        words += len(held[-1])
        if words >= BATCH_WORDS or row == len(texts) - 1:
            yield start, ids[start : row + 1], held
            start, held, words = row + 1, [], 0


def _query(shared, share: float, overlap: float):
    names, types = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"], [pa.int64(), pa.int64(), *[pa.float64()] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, words in _portions(batch.column(0).to_pylist(), batch.column(1)):
                rows = list(_hits(shared.value, ids, words, share, overlap))
                if rows:
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def _without_hits(shared, at: int, share: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for _, rows, words in _portions(list(range(batch.num_rows)), batch.column(at)):
                clean[[hit[0] for hit in _hits(shared.value, rows, words, share, overlap)]] = False
            yield batch.filter(pa.array(clean))

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [bare_words(t.as_py()) for t in batch.column(1)]
        terms = [sorted(set(w)) for w in words]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(terms, pa.list_(pa.binary()))],
            names=["shard", "words", "terms"],
        )


def shards(benchmark: DataFrame, scratch: Scratch) -> Iterator[Shard]:
    """The index of ``benchmark`` (item_id, text), a shard at a time; items without words are in none."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where(F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"))
    size = items.agg(F.count(F.lit(1)).alias("items"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if not size["items"]:
        return
    count = max(-(-size["items"] // SHARD_ITEMS), -(-size["bytes"] // SHARD_BYTES))
    items = scratch.settle(items.withColumn("shard", F.pmod(F.xxhash64("text", "item_id"), F.lit(count))))
    terms = scratch.settle(items.select("shard", "text").mapInArrow(_item_terms, "shard long, words long, terms array<binary>"))
    mean, span = terms.agg(F.avg("words"), F.max("words")).first()
    each = terms.select("shard", F.explode("terms").alias("term"))
    frequencies = scratch.settle(each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.collect_set("shard").alias("shards")))
    for shard in range(count):
        rows = items.where(F.col("shard") == shard).select("item_id", "text").toArrow()
        known = frequencies.where(F.array_contains("shards", F.lit(shard).cast("long"))).select("term", "df").toArrow()
        pairs = list(zip(rows["item_id"].to_pylist(), rows["text"].to_pylist(), strict=True))
        if pairs:
            yield build_shard(pairs, dict(zip(known["term"].to_pylist(), known["df"].to_pylist(), strict=True)), size["items"], mean, span)


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, overlap: float = OVERLAP) -> DataFrame:
    """Rows (doc_id, item_id, score, question_overlap, answer_overlap): the documents that hold a test item.

    Each pair counts once, with the best figures of its windows.  All words
    of all documents are searched.  Null and empty texts hold nothing; items
    without words are not looked for; an item of less than five words is one
    shingle.  Repeated documents and items give one row per pair of ids; a
    null id is an id of its own.  Without items the result is empty.  Other
    columns are not read.  The result is settled.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    best = [F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")]
    with Scratch(spark) as scratch:
        parts = [
            scratch.settle(texts.mapInArrow(_query(spark.sparkContext.broadcast(shard), share, overlap), HITS))
            for shard in shards(benchmark, scratch)
        ]
        hits = reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], HITS)
        return settle(hits.groupBy("doc_id", "item_id").agg(*best))


def clean_documents(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, overlap: float = OVERLAP) -> DataFrame:
    """``docs`` without the rows whose text holds a test item, in one pass and without a shuffle."""
    context, schema, at = docs.sparkSession.sparkContext, docs.schema, docs.columns.index("text")
    with Scratch(docs.sparkSession) as scratch:
        for shard in shards(benchmark, scratch):
            docs = docs.mapInArrow(_without_hits(context.broadcast(shard), at, share, overlap), schema)
    return docs
