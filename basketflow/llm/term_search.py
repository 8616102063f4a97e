"""Ranked lexical search: term at a time over documents, with a limited set of accumulators.

The collection is read once.  Each document gives its length and its counts
of the terms that queries hold; a bitmap of the query terms leaves out most
others, and the terms themselves are compared later.  From that table come
the document frequencies and the weights.

Scores are then found where the documents lie.  A task inverts a block of
documents into postings by term and answers every query on it: the rarest term
comes first, its postings open accumulators; as soon as all terms still to
come could not lift a new document to the k-th best partial score, no more
accumulators are opened, and those that can still reach it are updated
exactly to the end.  The k best of the blocks before set the bar of the next
block.  Every task sends k documents per query at most, and the k best of
those are the answer.  Queries beyond a bounded number are further passes over
the table of counts, not over the texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.llm.bitmap import bitmap, is_set
from basketflow.operators.ordering import top_rows
from basketflow.session import Scratch, settle

TOP = 10
SHARD_ITEMS, SHARD_TERMS = 4096, 1 << 18
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 16, 1 << 20
MAX_BITS = 24  # the bitmap of query terms has 2 MB at most
COUNTS = "doc_id long, length long, terms array<binary>, counts array<long>"
FOUND = "item_id long, doc_id long, score long"

# ASCII letters in lower case, digits as they are, every other ASCII character a space; the rest belongs to terms.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The maximal runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case, in UTF-8."""
    return text.encode("utf-8").translate(_TERM_BYTES).split() if text else []


def _hashes(terms: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms)).view(np.int64)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = Counter(terms_of(text))
            terms = list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([item] * len(terms), pa.int64()), pa.array(terms, pa.binary()),
                 pa.array(list(counts.values()), pa.int64()), pa.array(_hashes(terms))],
                names=["item_id", "term", "times", "hash"])


def _term_counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, terms, counts = [], [], []
            for text in batch.column(1):
                words = terms_of(text.as_py())
                found = Counter(words)
                names = list(found)
                wanted = np.flatnonzero(is_set(shared.value, _hashes(names))).tolist()
                lengths.append(len(words))
                terms.append([names[i] for i in wanted])
                counts.append([found[t] for t in terms[-1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int64()))],
                names=["doc_id", "length", "terms", "counts"])

    return run


@dataclass(frozen=True)
class Queries:
    """A bounded number of queries: terms with weights, and per item its terms from the rarest on with their repeats."""

    ids: list[int | None]
    terms: dict[bytes, int]
    weights: np.ndarray
    plans: list[tuple[np.ndarray, np.ndarray]]


def _queries(rows: pa.Table) -> Queries:
    """From rows (item_id, term, times, df, weight)."""
    by_item: dict[int | None, list[tuple]] = {}
    terms: dict[bytes, int] = {}
    weights: list[int] = []
    for item, term, times, df, weight in zip(*(rows[c].to_pylist() for c in ("item_id", "term", "times", "df", "weight")), strict=True):
        if term not in terms:
            terms[term] = len(weights)
            weights.append(weight)
        by_item.setdefault(item, []).append((df, term, times))
    plans = []
    for held in by_item.values():
        held.sort()
        plans.append((np.array([terms[t] for _, t, _ in held], np.int64), np.array([n for *_, n in held], np.int64)))
    return Queries(list(by_item), terms, np.array(weights, np.int64), plans)


@dataclass
class _Block:
    """Postings of some documents by term; ``gains`` holds what one occurrence of the term in a query adds."""

    ids: np.ndarray
    starts: np.ndarray  # per term, into documents and gains
    documents: np.ndarray
    gains: np.ndarray
    most: np.ndarray  # per term: the largest gain in the block


def _inverted(queries: Queries, parts: list[pa.RecordBatch], documents: int, total: int) -> _Block:
    table = pa.Table.from_batches(parts)
    # a null id stands last on a tie
    ids = table["doc_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
    lengths = table["length"].to_numpy()
    lists = table["terms"].combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    sizes = lists.value_lengths().fill_null(0).to_numpy()
    coded = lists.flatten().dictionary_encode()
    known = np.array([queries.terms.get(t, -1) for t in coded.dictionary.to_pylist()], np.int64)
    term = known[coded.indices.to_numpy()] if len(known) else np.empty(0, np.int64)
    counts = table["counts"].combine_chunks()
    counts = (counts if isinstance(counts, pa.ListArray) else pa.concat_arrays(counts.chunks)).flatten().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    wanted = np.flatnonzero(term >= 0)
    order = wanted[np.argsort(term[wanted], kind="stable")]
    term, row, counts = term[order], row[order], counts[order]
    spread = 25 + (75 * lengths * documents) // max(total, 1)
    gains = queries.weights[term] * ((1_000_000_000 * counts) // (1000 * counts + 8 * spread[row]))
    starts = np.searchsorted(term, np.arange(len(queries.weights) + 1))
    most = np.zeros(len(queries.weights), np.int64)
    held = np.flatnonzero(starts[1:] > starts[:-1])
    if len(held):
        most[held] = np.maximum.reduceat(gains, starts[held])
    return _Block(ids, starts, row, gains, most)


def ranked_in_block(block: _Block, terms: np.ndarray, times: np.ndarray, k: int, bar: int, scores: np.ndarray) -> tuple[np.ndarray, int]:
    """Rows of the block that may be among the k best, their scores left in ``scores``; and how many postings opened accumulators.

    ``terms`` stand from the rarest on.  ``bar`` is a score that k documents
    elsewhere have reached.  ``scores`` must be zero and is not cleared.
    """
    present = block.starts[terms + 1] > block.starts[terms]
    terms, times = terms[present], times[present]
    gains = block.most[terms] * times
    rest = np.concatenate([np.cumsum(gains[::-1])[::-1], [0]])
    held, opened, alive = np.empty(0, np.int64), 0, None
    for i, (term, repeats) in enumerate(zip(terms.tolist(), times.tolist(), strict=True)):
        span = slice(block.starts[term], block.starts[term + 1])
        rows, gain = block.documents[span], block.gains[span]
        if alive is None and rest[i] < bar:
            # what is still to come lifts no new document to the k-th best: only open ones go on
            alive = np.zeros(len(scores), bool)
            alive[held[scores[held] + rest[i] >= bar]] = True
        if alive is not None:
            going = alive[rows]
            rows, gain = rows[going], gain[going]
        scores[rows] += gain * repeats
        if alive is None:
            opened += len(rows)
            held = np.flatnonzero(scores)
            if len(held) >= k and rest[i + 1]:
                bar = max(bar, int(np.partition(scores[held], len(held) - k)[len(held) - k]))
    return held if alive is None else np.flatnonzero(alive), opened


def _ranker(shared, k: int, documents: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shared.value
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in queries.plans]

        def answer(parts: list[pa.RecordBatch]) -> None:
            block = _inverted(queries, parts, documents, total)
            scores = np.zeros(len(block.ids), np.int64)
            for at, (terms, times) in enumerate(queries.plans):
                ids, values = best[at]
                bar = int(values[-1]) if len(values) == k else 0
                rows, _ = ranked_in_block(block, terms, times, k, bar, scores)
                found = scores[rows]
                good = found >= max(bar, 1)
                ids, values = np.concatenate([ids, block.ids[rows[good]]]), np.concatenate([values, found[good]])
                first = np.lexsort((ids, -values))[:k]
                best[at] = ids[first], values[first]
                scores[:] = 0

        parts, rows, postings = [], 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(start, BLOCK_DOCS)
                parts.append(part)
                rows += part.num_rows
                postings += len(part.column(2).flatten())
                if rows >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                    answer(parts)
                    parts, rows, postings = [], 0, 0
        if parts:
            answer(parts)
        ids = [x for x, (found, _) in zip(queries.ids, best, strict=True) for _ in range(len(found))]
        docs = np.concatenate([found for found, _ in best]) if best else np.empty(0, np.int64)
        values = np.concatenate([v for _, v in best]) if best else np.empty(0, np.int64)
        missing = docs == np.iinfo(np.int64).max
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(docs, pa.int64(), mask=missing), pa.array(values)],
                                         names=["item_id", "doc_id", "score"])

    return run


def term_search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the k best documents of each item, with a score above 0.

    ``docs`` has doc_id and text, ``items`` item_id and text.  The score sums
    weight · ((10⁹·tf) div (1000·tf + 8·m)) over the item's terms, repeats
    included, with weight = ⌊1000·ln((2N+2)/(2df+1))⌋ and m = 25 + (75·n·N) div L;
    equal scores go by doc_id, a null id last.  Null texts and texts without
    terms are no documents; an item without terms, or with none that occurs,
    has no rows.  Repeated documents count and rank as often as they occur;
    a repeated item counts once, and different texts of one item_id are one
    item.  A null item_id is an id of its own.  Empty tables give an empty
    result.  Other columns are not read.  The result is settled.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string").alias("text")
    with Scratch(spark) as scratch:
        asked = items.select(F.col("item_id").cast("long").alias("item_id"), text).distinct()
        wanted = asked.mapInArrow(_item_terms, "item_id long, term binary, times long, hash long")
        wanted = scratch.settle(wanted.groupBy("item_id", "term", "hash").agg(F.sum("times").alias("times")))
        size = wanted.agg(F.countDistinct("item_id").alias("items"), F.countDistinct("hash").alias("terms"), F.count(F.lit(1)).alias("rows")).first()
        if not size["rows"]:
            return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
        bits = min(MAX_BITS, max(10, (32 * size["terms"]).bit_length()))
        words = spark.sparkContext.broadcast(bitmap(wanted.select("hash").distinct(), "hash", bits))
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
        counts = scratch.settle(texts.mapInArrow(_term_counts(words), COUNTS))
        documents, total = counts.where("length > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        df = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * documents + 2) / (2.0 * F.col("df") + 1))).cast("long")
        shards = max(-(-(size["items"] + 1) // SHARD_ITEMS), -(-size["rows"] // SHARD_TERMS))
        shard = F.pmod(F.xxhash64("item_id"), F.lit(shards)).alias("shard")
        plans = scratch.settle(wanted.join(df, "term").select(shard, "item_id", "term", "times", "df", weight.alias("weight")))
        found = []
        for at in range(shards):
            queries = _queries(plans.where(F.col("shard") == at).toArrow())
            if queries.plans:
                shared = spark.sparkContext.broadcast(queries)
                found.append(scratch.settle(counts.where(F.size("terms") > 0).mapInArrow(_ranker(shared, k, documents, total), FOUND)))
        if not found:
            return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        best = top_rows(reduce(DataFrame.union, found), ["item_id"], order, k)
        return settle(best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
