"""Nearest items by vector: exact, by cell, by hash bucket; candidate lists; retriever mixes."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from basketflow.functions.vectors import (
    NORM_FLOOR, SCORE_DIGITS, as_matrix, bounds, flat, list_column, norm, unit, unit_rows,
)
from basketflow.operators.blocks import WHOLE_ROWS, meet, ranges
from basketflow.operators.gathering import BucketedVectors, gather, rows_of  # noqa: F401
from basketflow.operators.ordering import top_rows
from basketflow.operators.sequences import last_items
from basketflow.session import settle

# Rows of one side that meet at a time in a block search without groups, and in one task of a search in groups.
SEARCH_BLOCK = 4_096
QUERY_BLOCK = 65_536
ITEM_BLOCK = 16_384
HISTORY_BLOCK = 4_096
TASK_QUERIES = 256  # a small table of queries is dealt to tasks of so many
TASK_ITEMS = 1 << 17  # items that a task holds in blocks
LISTED = 1 << 22  # entries of the lists that a task finds
HELD = 1 << 20  # entries of the lists of a block
CHUNK = 128  # queries whose products with a block of items stay in a cache
EMITTED = 1 << 16  # scores that a task of the whole table holds at once
KEY_BITS = 32  # of an item's id, in a number that also has its score
NO_KEY = np.iinfo(np.int64).max


# ---- vectors of queries -----------------------------------------------------------------------

def unit_vectors(vectors: DataFrame, column: str = "vector") -> DataFrame:
    return vectors.withColumn(column, unit(F.col(column)))


class _Means:
    """Sums of the vectors that each query of a block lists, whatever block of the items they come from."""

    def __init__(self, block: pa.Table):
        self.ids, lists = block["query_id"], flat(block["items"])
        items = lists.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(items, kind="stable")
        self.items, self.rows = items[order], np.repeat(np.arange(len(lists)), np.diff(bounds(lists)))[order]
        self.sums, self.counts = None, np.zeros(len(lists), np.int64)

    def add(self, block: pa.Table):
        ids = block["item_idx"].to_numpy()
        start = np.searchsorted(self.items, ids, side="left")
        count = np.searchsorted(self.items, ids, side="right") - start
        if count.any():
            vectors = as_matrix(block["vector"])
            rows, of = self.rows[ranges(start, count)], np.repeat(np.arange(len(ids)), count)
            order = np.argsort(rows, kind="stable")
            rows, of = rows[order], of[order]
            if self.sums is None:
                self.sums = np.zeros((len(self.counts), vectors.shape[1]))
            for at in range(0, len(rows), EMITTED):
                some, first = np.unique(rows[at:at + EMITTED], return_index=True)
                self.sums[some] += np.add.reduceat(vectors[of[at:at + EMITTED]], first, axis=0)
            self.counts += np.bincount(rows, minlength=len(self.counts))
        return ()

    def end(self):
        known = np.flatnonzero(self.counts)
        if len(known):
            means = self.sums[known] / self.counts[known][:, None]
            yield pa.record_batch({"query_id": flat(self.ids).take(pa.array(known)), "vector": list_column(unit_rows(means))})


def history_vectors(
    queries: DataFrame, vectors: DataFrame | BucketedVectors, keep_empty: bool = False, max_history: int = 15
) -> DataFrame:
    """``(query_id, vector)``: mean of the last history items' vectors, at length 1.

    With ``keep_empty`` queries without any known item get a zero vector.
    Only the lists of items are grouped; blocks of them meet the vectors where
    those lie, so no vector is sent per list entry.
    """
    own = F.filter(last_items(F.col("history"), max_history), lambda x: x.isNotNull()).cast("array<bigint>")
    lists = settle(queries.groupBy("query_id").agg(F.flatten(F.collect_list(own)).alias("items")))
    # The lists are small and each task streams the catalog past its own: all cores take part.
    tasks = lists.sparkSession.sparkContext.defaultParallelism
    lists = lists.repartition(max(1, min(4 * tasks, -(-lists.count() // TASK_QUERIES))))
    known = rows_of(vectors).where(F.col("item_idx").isNotNull() & F.col("vector").isNotNull())
    known = known.select(F.col("item_idx").cast("long").alias("item_idx"), "vector")
    found = meet(lists, known, HISTORY_BLOCK, WHOLE_ROWS, _Means, "query_id long, vector array<double>", whole=True)
    if not keep_empty:
        return found
    dim = rows_of(vectors).agg(F.max(F.size("vector"))).scalar()
    zero = F.array_repeat(F.lit(0.0), F.coalesce(dim, F.lit(0)))
    return queries.select("query_id").join(found, "query_id", "left").withColumn("vector", F.coalesce("vector", zero))


# ---- block search -----------------------------------------------------------------------------

def best_columns(scores: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k best scores per row; ties go to the lower column."""
    n_rows, n_cols = scores.shape
    most = int(min(k.max(initial=0), n_cols))
    if most == 0:
        return np.zeros(0, int), np.zeros(0, int)
    if most < n_cols:
        limit = np.partition(scores, n_cols - most, axis=1)[:, n_cols - most]
        rows, cols = np.nonzero(scores >= limit[:, None])
    else:
        rows, cols = np.divmod(np.arange(n_rows * n_cols), n_cols)
    order = np.lexsort((cols, -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, np.arange(n_rows))
    keep = np.arange(len(rows)) - first[rows] < k[rows]
    return rows[keep], cols[keep]


def _block_scorer(metric: str):
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, items, values = [], [], []
        if left.num_rows and right.num_rows:
            right = right.sort_by("item_idx")
            query_ids, item_ids = left["query_id"].to_numpy(), right["item_idx"].to_numpy()
            q, v, want = as_matrix(left["vector"]), item_matrix(right), left["want"].to_numpy()
            if metric == "cosine":
                q, v = unit_rows(q), unit_rows(v)
            for at in range(0, len(q), CHUNK):
                part = q[at:at + CHUNK]
                if metric == "l2":
                    squares = (part * part).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2.0 * (part @ v.T)
                    found = -np.sqrt(np.maximum(squares, 0.0))
                else:
                    found = part @ v.T
                found = np.round(found, SCORE_DIGITS) + 0.0
                rows, cols = best_columns(found, want[at:at + CHUNK])
                ids.append(query_ids[at + rows])
                items.append(item_ids[cols])
                values.append(found[rows, cols])
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.table({
            "query_id": join(ids, pa.int64()), "item_idx": join(items, pa.int64()),
            "score": join(values, pa.float64()),
        })
    return score


def item_matrix(table: pa.Table) -> np.ndarray:
    """The vectors of a block, from one-byte codes where the table has those."""
    if "codes" not in table.column_names:
        return as_matrix(table["vector"])
    rows = table.num_rows
    codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.int8).reshape(rows, -1)
    return codes * table["scale"].to_numpy()[:, None]


class _Best:
    """The ``want`` best items of each query of a block, over all blocks of items that it meets.

    Products in four-byte numbers, with a bound of their error, leave out what
    is surely below the scores held so far; the rest is scored in doubles.
    A score of nine digits and an id below 2**32 are held as one whole number,
    the lowest of which are the best; where they do not fit, as three arrays.
    """

    def __init__(self, metric: str, block: pa.Table, listed: bool = False):
        self.metric, self.ids, self.want, self.listed = metric, block["query_id"], block["want"].to_numpy(), listed
        self.queries = as_matrix(block["vector"])
        if metric == "cosine":
            self.queries = unit_rows(self.queries)
        self.short = self.queries.astype(np.float32)
        self.lengths = np.sqrt((self.queries * self.queries).sum(axis=1))
        self.least = np.full(len(self.want), -np.inf)  # the score that a new item must reach
        self.last = np.full(len(self.want), np.iinfo(np.int64).max)  # and the id it must be below at that score
        chunks = -(-len(self.want) // CHUNK)
        none = np.zeros(0, np.int64)
        self.held = [(none, none, np.zeros(0))] * chunks
        # Lists of very different lengths would waste most of a table with a row for each.
        self.packed = metric != "l2" and self.want.max(initial=0) * len(self.want) <= 4 * np.maximum(self.want, 0).sum()
        self.keys = [np.zeros((min(CHUNK, len(self.want) - at * CHUNK), 0), np.int64) for at in range(chunks)]
        self.reach = np.full(len(self.want), NO_KEY)  # the number that a new item must be below

    def add(self, block: pa.Table):
        return self._add(block, np.arange(len(self.want)))

    def _add(self, block: pa.Table, asking: np.ndarray):
        """Meets a block of items with some of the queries, whose numbers rise."""
        block = block.sort_by("item_idx")
        ids, items = block["item_idx"].to_numpy(), item_matrix(block)
        if self.metric == "cosine":
            items = unit_rows(items)
        longest = np.sqrt((items * items).sum(axis=1).max(initial=0.0))
        most = longest * self.lengths.max(initial=0.0)
        bound = (items.shape[1] + 4) * 2.0**-22 * self.lengths * longest + 10.0**-SCORE_DIGITS
        exact = self.metric == "l2" or not (np.isfinite(bound).all() and most < 1e30)
        short = None if exact else items.astype(np.float32)
        if self.packed and len(ids) and not (not exact and most <= 2 and ids.dtype.kind == "i" and ids[0] >= 0 and ids[-1] < 1 << KEY_BITS):
            self._unpack()
        for n, at in enumerate(range(0, len(self.want), CHUNK)):
            whole = slice(at, min(at + CHUNK, len(self.want)))
            asked = asking[slice(*np.searchsorted(asking, [whole.start, whole.stop]))]
            if not len(asked):
                continue
            part = whole if len(asked) == whole.stop - whole.start else asked
            found = self._scores(part, items) if exact else self.short[part] @ short.T
            rows, cols = self._possible(found, part, ids, 0.0 * bound[part] if exact else bound[part])
            if exact or len(rows) * 16 > found.size:
                scores = (found if exact else self._scores(part, items))[rows, cols]
            else:
                scores = np.empty(len(rows))
                for i in range(0, len(rows), EMITTED):
                    some = slice(i, i + EMITTED)
                    scores[some] = np.einsum("cd,cd->c", self.queries[asked[rows[some]]], items[cols[some]])
                scores = np.round(scores, SCORE_DIGITS) + 0.0
            if self.packed:
                keys = (np.rint(scores * -(10.0**SCORE_DIGITS)).astype(np.int64) << KEY_BITS) + ids[cols]
                better = keys < self.reach[part][rows]
                if better.any():
                    self._hold_keys(n, whole, asked[rows[better]] - at, keys[better])
                continue
            least = self.least[part][rows]
            better = (scores > least) | ((scores == least) & (ids[cols] < self.last[part][rows]))
            if better.any():
                self._hold(n, whole, asked[rows[better]] - at, ids[cols[better]], scores[better])
        return ()

    def _scores(self, part: slice | np.ndarray, items: np.ndarray) -> np.ndarray:
        queries = self.queries[part]
        if self.metric == "l2":
            squares = (queries * queries).sum(1)[:, None] + (items * items).sum(1)[None, :] - 2.0 * (queries @ items.T)
            return np.round(-np.sqrt(np.maximum(squares, 0.0)), SCORE_DIGITS) + 0.0
        return np.round(queries @ items.T, SCORE_DIGITS) + 0.0

    def _possible(self, found: np.ndarray, part: slice | np.ndarray, ids: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns that may be among the best; ``ids`` rise."""
        limit, want, (n_rows, n_cols) = self.least[part] - bound, self.want[part], found.shape
        open_ = np.isneginf(limit) & (want > 0)
        most = int(min(want[open_].max(initial=0), n_cols))
        if 0 < most < n_cols:
            limit[open_] = np.partition(found[open_], n_cols - most, axis=1)[:, n_cols - most] - 2 * bound[open_]
        limit[want <= 0] = np.inf
        # every item has score 0 for a zero vector: the lowest ids are the best
        zero = (self.lengths[part] == 0) & (want > 0) if self.metric != "l2" else np.zeros(n_rows, bool)
        limit[zero] = np.inf
        reached = found >= np.nextafter(limit.astype(found.dtype), -np.inf)[:, None] if found.dtype != limit.dtype else found >= limit[:, None]
        rows, cols = np.divmod(np.flatnonzero(reached), max(n_cols, 1))
        real = limit[rows] < np.inf
        rows, cols = rows[real], cols[real]
        first = np.where(zero & (ids[0] < self.last[part]), np.minimum(want, n_cols), 0) if n_cols else np.zeros(n_rows, np.int64)
        if first.any():
            rows, cols = np.append(rows, np.repeat(np.arange(n_rows), first)), np.append(cols, ranges(np.zeros(n_rows, np.int64), first))
        return rows, cols

    def _hold_keys(self, n: int, part: slice, rows: np.ndarray, keys: np.ndarray) -> None:
        """Rows that get new keys keep the lowest of the old and new ones, in any order."""
        if (rows[1:] < rows[:-1]).any():
            order = np.argsort(rows, kind="stable")
            rows, keys = rows[order], keys[order]
        held, want = self.keys[n], self.want[part]
        count = np.bincount(rows, minlength=len(held))
        some = np.flatnonzero(count)
        place = np.arange(len(rows)) - (np.cumsum(count) - count)[rows]
        width, want, most = held.shape[1], want[some], int(want.max())
        met = np.full((len(some), width + int(count.max())), NO_KEY)
        met[:, :width] = held[some]
        met[np.searchsorted(some, rows), width + place] = keys
        if (want == most).all():
            if met.shape[1] >= most:
                met.partition(most - 1, axis=1)
                self.reach[part.start + some] = met[:, most - 1]
        else:
            met.sort(axis=1)
            met[np.arange(met.shape[1])[None, :] >= want[:, None]] = NO_KEY
            many = want <= met.shape[1]
            self.reach[part.start + some[many]] = met[many, want[many] - 1]
        met = met[:, :most]
        if met.shape[1] > width:
            grown = np.full((len(held), met.shape[1]), NO_KEY)
            grown[:, :width] = held
            self.keys[n] = held = grown
        held[some] = met
        full = part.start + some[self.reach[part.start + some] < NO_KEY]
        _, self.last[full], self.least[full] = self._opened(self.reach[full][:, None])

    @staticmethod
    def _opened(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, item and score of each key of a table of them."""
        rows, places = np.nonzero(keys < NO_KEY)
        keys = keys[rows, places]
        return rows, keys & ((1 << KEY_BITS) - 1), -(keys >> KEY_BITS) / 10.0**SCORE_DIGITS

    def _unpack(self) -> None:
        self.held, self.packed, self.keys = self._parts(), False, []

    def _parts(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, items and scores held in each chunk, best first."""
        return [self._opened(np.sort(keys, axis=1)) for keys in self.keys] if self.packed else self.held

    def _hold(self, n: int, part: slice, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        rows, ids, scores = (np.append(*x) for x in zip(self.held[n], (rows, ids, scores), strict=True))
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        want, size = self.want[part], part.stop - part.start
        first, end = np.searchsorted(rows, np.arange(size)), np.searchsorted(rows, np.arange(size), side="right")
        kept = np.arange(len(rows)) - first[rows] < want[rows]
        full = np.flatnonzero((end - first >= want) & (want > 0))
        self.least[part.start + full], self.last[part.start + full] = scores[first[full] + want[full] - 1], ids[first[full] + want[full] - 1]
        self.held[n] = rows[kept], ids[kept], scores[kept]

    def numbered(self) -> tuple[np.ndarray, np.ndarray]:
        """Query numbers, which rise, and the items held for them, best first."""
        rows, ids, _ = zip(*self._parts(), strict=True)
        return np.concatenate([n * CHUNK + r for n, r in enumerate(rows)]), np.concatenate(ids)

    def _lists(self, n: int, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
        """One row per query that has items, best first."""
        some, first = np.unique(rows, return_index=True)
        ends = pa.array(np.append(first, len(rows)), pa.int32())
        return pa.record_batch({
            "query_id": flat(self.ids).take(pa.array(n * CHUNK + some)), "item_idx": pa.ListArray.from_arrays(ends, pa.array(ids, pa.int64())),
            "score": pa.ListArray.from_arrays(ends, pa.array(scores)),
        })

    def end(self):
        for n, (rows, ids, scores) in enumerate(self._parts()):
            if self.listed:
                yield self._lists(n, rows, ids, scores)
                continue
            for at in range(0, len(rows), EMITTED):
                some = slice(at, at + EMITTED)
                yield pa.record_batch({
                    "query_id": flat(self.ids).take(pa.array(n * CHUNK + rows[some])), "item_idx": ids[some], "score": scores[some],
                })


def _lists_of(rows: np.ndarray, values: np.ndarray, count: int) -> pa.ListArray:
    """``count`` lists of the values, whose row numbers rise."""
    ends = np.searchsorted(rows, np.arange(count + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))


class _BestInCells(_Best):
    """The best items of each query among those of the cells that it probes; items come in the order of their cells."""

    def __init__(self, block: pa.Table):
        super().__init__("cosine", block)
        lists = flat(block["cells"])
        cells, rows = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(bounds(lists)))
        order = np.argsort(cells, kind="stable")
        self.cells, self.probing = cells[order], rows[order]

    def add(self, block: pa.Table):
        cells = block["cell"].to_numpy()
        cuts = np.flatnonzero(np.diff(cells)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)], strict=True):
            asking = self.probing[slice(*np.searchsorted(self.cells, [cells[start], cells[start] + 1]))] if end > start else ()
            if len(asking):
                self._add(block.slice(start, end - start), asking)
        return ()


class _NearestToHistory:
    """The nearest items of each query of a block to its mean vector, which needs the whole catalog first: it is met twice.

    With ``probes`` blocks of centers and of items by cell come along: the
    second meeting is with the items of the nearest cells, and a third finds
    exact lists for the queries that have fewer than k items there.
    """

    def __init__(self, k: int, keep_empty: bool, probes: int, block: pa.Table):
        self.block, self.k, self.keep_empty, self.probes = block, k, keep_empty, probes
        self.means, self.dim, self.centers, self.turns, self.best = _Means(block), 0, [], 0, None
        self.rows, self.found = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, block: pa.Table):
        searched = "cell" in block.column_names
        if self.turns == 0:
            if "center" in block.column_names:
                self.centers.append(block.rename_columns({"center": "item_idx"}))
            elif not searched:
                block = block.drop_null()  # history_vectors passes over these; the search takes the catalog as it is
                if block.num_rows:
                    self.dim = len(flat(block["vector"])[0])
                    self.means.add(block)
        elif self.best is not None and searched == bool(self.probes):
            self.best.add(block)
        return ()

    def _asked(self, numbers: np.ndarray, want: int, **more) -> pa.Table:
        return pa.table({"query_id": numbers, "want": np.full(len(numbers), want), "vector": list_column(self.vectors[numbers]), **more})

    def turn(self):
        self.turns += 1
        if self.turns == 1:
            known, size = np.flatnonzero(self.means.counts), len(self.means.counts)
            self.vectors = np.zeros((size, self.dim))
            if len(known):
                self.vectors[known] = unit_rows(self.means.sums[known] / self.means.counts[known][:, None])
            self.asking = np.arange(size) if self.keep_empty else known
            if not len(self.asking):
                return
            asked = self._asked(self.asking, self.k)
            if self.probes:
                near = _Best("l2", asked.set_column(1, "want", pa.array(np.full(len(self.asking), self.probes))))
                for block in self.centers:
                    near.add(block)
                rows, cells = near.numbered()
                self.best = _BestInCells(asked.append_column("cells", _lists_of(rows, cells, len(self.asking))))
            else:
                self.best = _Best("cosine", asked)
        elif self.best is not None:
            self._take()
            short = np.setdiff1d(self.asking, np.flatnonzero(np.bincount(self.rows, minlength=len(self.vectors)) >= self.k))
            kept = ~np.isin(self.rows, short)
            self.rows, self.found, self.asking = self.rows[kept], self.found[kept], short
            self.best = _Best("cosine", self._asked(short, self.k)) if len(short) else None

    def _take(self):
        """Adds what the search has found to the lists."""
        rows, found = self.best.numbered()
        rows, found = np.append(self.rows, self.asking[rows]), np.append(self.found, found)
        order = np.argsort(rows, kind="stable")
        self.rows, self.found = rows[order], found[order]

    def end(self):
        if self.best is not None:
            self._take()
        # A query that occurs n times has each item n times, as its rows together have.
        copies = flat(self.block["rows"]).value_lengths().to_numpy()[self.rows]
        if (copies > 1).any():
            rows, found = np.repeat(self.rows, copies), np.repeat(self.found, copies)
            first = np.arange(len(rows)) - np.searchsorted(rows, rows) < self.k
            self.rows, self.found = rows[first], found[first]
        some = np.unique(self.rows)
        lists = _lists_of(np.searchsorted(some, self.rows), self.found, len(some))
        for at in range(0, len(some), CHUNK):
            taken = pa.array(some[at:at + CHUNK])
            yield pa.record_batch({
                "query_id": flat(self.block["query_id"]).take(taken), "rows": flat(self.block["rows"]).take(taken), "items": lists.slice(at, CHUNK),
            })


def _streamed_scorer(metric: str, emitted: int):
    """Over rows in order of (qb, ib, side): keeps the items of a block, and answers its queries in batches of bounded size."""
    def scores(queries: np.ndarray, items: np.ndarray) -> np.ndarray:
        if metric == "l2":
            squares = (queries * queries).sum(1)[:, None] + (items * items).sum(1)[None, :] - 2.0 * (queries @ items.T)
            return -np.sqrt(np.maximum(squares, 0.0))
        return queries @ items.T

    def run(batches):
        block, held, ids, items = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            qb, ib, side = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((np.diff(qb) != 0) | (np.diff(ib) != 0) | (np.diff(side) != 0)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                part = batch.slice(start, end - start)
                if block != (qb[start], ib[start]):
                    block, held, items = (qb[start], ib[start]), [], None
                own, rows = part.column(3).to_numpy(), as_matrix(part.column(4))
                rows = unit_rows(rows) if metric == "cosine" else rows
                if side[start] == 0:
                    held.append((own, rows))
                    continue
                if not held:
                    continue
                if items is None:
                    ids, items = (np.concatenate(x) for x in zip(*held, strict=True))
                step = max(1, emitted // len(ids))
                for at in range(0, len(own), step):
                    some = own[at:at + step]
                    for first in range(0, len(ids), emitted):
                        wide = ids[first:first + emitted]
                        found = np.round(scores(rows[at:at + step], items[first:first + emitted]), SCORE_DIGITS) + 0.0
                        yield pa.record_batch({"query_id": np.repeat(some, len(wide)), "item_idx": np.tile(wide, len(some)), "score": found.ravel()})
    return run


class _Every:
    """All scores of a block of queries, ``emitted`` at a time."""

    def __init__(self, metric: str, block: pa.Table, emitted: int):
        self.scored, self.queries = _streamed_scorer(metric, emitted), self._rows(1, block["query_id"], as_matrix(block["vector"]))

    @staticmethod
    def _rows(side: int, ids, vectors: np.ndarray) -> pa.RecordBatch:
        sides = np.full(len(vectors), side)
        return pa.record_batch({"qb": 0 * sides, "ib": 0 * sides, "side": sides, "id": flat(ids), "vector": list_column(vectors)})

    def add(self, block: pa.Table):
        return self.scored(iter([self._rows(0, block["item_idx"], item_matrix(block)), self.queries]))

    def end(self):
        return ()


def block_scores(
    queries: DataFrame,
    items: DataFrame,
    k: int | None,
    metric: str = "dot",
    group: list[str] | None = None,
    query_block: int | None = None,
    item_block: int | None = None,
) -> DataFrame:
    """``(query_id, item_idx, score)``: per query the ``k`` best items of each part of the items.

    Without groups neither table is sent: blocks of query_block queries and
    item_block items meet where the tables lie, a part is what one task holds
    of the items (about ``TASK_ITEMS``), and a task holds one block of each and
    the lists of its queries.  With ``group`` columns only rows of the same
    group meet: both are hashed into blocks and every pair of blocks of a group
    meets in one task; a group that holds a large share of the items is simply
    more blocks, and rows sent are |Q|·|I|/item_block + |I|·|Q|/query_block.
    A ``want`` column in ``queries`` gives each query its own k; k=None returns
    every score.  Items may have ``codes`` and ``scale`` in place of ``vector``.
    """
    group = group or []
    most = F.lit(2**31 - 1 if k is None else k)
    queries = queries.withColumn("want", (F.col("want") if "want" in queries.columns else most).cast("long"))
    content = ["codes", "scale"] if "codes" in items.columns else ["vector"]
    if group:
        # Query vectors are counted and then sent: settled, they are computed once.
        queries = settle(queries.select(*group, "query_id", "vector", "want"))
        return _grouped_scores(queries, items, metric, group, content, query_block or QUERY_BLOCK, item_block or ITEM_BLOCK)
    return _met(queries, items, content, metric, k, query_block or SEARCH_BLOCK, item_block or SEARCH_BLOCK, EMITTED)


def _met(
    queries: DataFrame, items: DataFrame, content: list[str], metric: str, k: int | None, query_block: int, item_block: int, emitted: int,
    listed: bool = False,
) -> DataFrame:
    """The best scores of each query in each part of the items, as rows or ``listed`` in one row, or all scores."""
    queries = settle(queries.select("query_id", "vector", F.col("want").cast("long").alias("want")))
    items = settle(items.select(F.col("item_idx").cast("long").alias("item_idx"), *content))
    parts = max(1, -(-items.count() // TASK_ITEMS))
    size = queries.agg(F.count(F.lit(1)).alias("rows"), F.max("want").alias("most")).head()
    most = 0 if k is None else size.most or 0
    begin = (lambda block: _Every(metric, block, emitted)) if k is None else (lambda block: _Best(metric, block, listed))
    rows = min(query_block, max(HELD // max(most, 1), 64))
    return meet(
        _dealt(queries, size.rows, most), items.coalesce(parts), rows, item_block, begin,
        "query_id long, item_idx array<long>, score array<double>" if listed else "query_id long, item_idx long, score double")


def _dealt(queries: DataFrame, rows: int, most: int) -> DataFrame:
    """The queries in enough tasks to keep all cores busy, and to keep the lists that a task finds small."""
    tasks = queries.sparkSession.sparkContext.defaultParallelism
    wanted = max(min(4 * tasks, -(-rows // TASK_QUERIES)), -(-rows * most // LISTED), 1)
    few = rows <= 4 * tasks * SEARCH_BLOCK
    return queries.repartition(wanted) if few or wanted > 4 * tasks else queries


def _grouped_scores(
    queries: DataFrame, items: DataFrame, metric: str, group: list[str], content: list[str], query_block: int, item_block: int
) -> DataFrame:
    sizes = lambda df, size, name: df.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    shape = sizes(items, item_block, "_ni").join(sizes(queries, query_block, "_nq"), group)
    queries, items = queries.join(shape, group), items.join(shape, group)
    whole = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cut = lambda ident, n: F.pmod(F.xxhash64(ident), F.col(n)).cast("int")
    left = queries.select(*group, "query_id", "vector", "want", cut("query_id", "_nq").alias("_qb"),
                          F.explode(whole("_ni")).alias("_ib"))
    # Fresh aliases: queries and items may be the same table.
    fresh = [F.col(c).alias(c) for c in (*group, "item_idx", *content)]
    right = items.select(*fresh, cut("item_idx", "_ni").alias("_ib"),
                         F.explode(whole("_nq")).alias("_qb"))
    keys = [*group, "_qb", "_ib"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys))
    return met.applyInArrow(_block_scorer(metric), "query_id long, item_idx long, score double")


def best_first() -> list[Column]:
    return [F.col("score").desc(), F.col("item_idx")]


def top_items(scores: DataFrame, k: int, key: str = "query_id") -> DataFrame:
    """``(key, rank, item_idx, score)``: the k best items per key, lower item first on a tie."""
    return top_rows(scores.select(key, "item_idx", "score"), [key], best_first(), k).select(
        key, "rank", "item_idx", "score"
    )


def nearest_items(
    queries: DataFrame, items: DataFrame, k: int, metric: str = "cosine", index: CellIndex | None = None, probes: int = 0, **blocks
) -> DataFrame:
    """The k nearest items per query: cosine, dot, or l2 (score = −distance).

    Exact without an ``index``; with one, cosine search in the ``probes`` nearest cells of each query.
    """
    if index is not None:
        if metric != "cosine":
            raise ValueError("cells are searched by cosine")
        return nearest_by_cell(queries, index, k, probes)
    return top_items(block_scores(queries, items, k, metric, **blocks), k)


def nearest_lists(
    queries: DataFrame, items: DataFrame, k: int, metric: str = "cosine", index: CellIndex | None = None, probes: int = 0, name: str = "cands"
) -> DataFrame:
    """``nearest_items`` as one array per query, best first.

    A task sends one row per query with its best items and their scores, not
    a row per item; lists of several parts of the items are merged.
    """
    if index is not None:
        return as_lists(nearest_items(queries, items, k, metric, index, probes), name=name)
    queries = queries.withColumn("want", F.lit(k).cast("long"))
    found = _met(queries, items, ["vector"], metric, k, SEARCH_BLOCK, SEARCH_BLOCK, EMITTED, listed=True)
    found = found.groupBy("query_id").agg(F.collect_list(F.struct("score", "item_idx")).alias("_lists"))
    worse = lambda x: F.zip_with(x["score"], x["item_idx"], lambda score, item: F.struct((-score).alias("worse"), item.alias("item_idx")))
    merged = F.slice(F.array_sort(F.flatten(F.transform("_lists", worse))), 1, k)
    one = F.col("_lists")[0]["item_idx"]
    return found.select("query_id", F.when(F.size("_lists") == 1, one).otherwise(F.transform(merged, lambda x: x["item_idx"])).alias(name))


def similarity_table(
    queries: DataFrame, items: DataFrame, metric: str = "cosine", query_block: int = SEARCH_BLOCK, item_block: int = SEARCH_BLOCK,
    emitted: int = EMITTED,
) -> DataFrame:
    """Every (query, item) score; the result itself has |Q|·|I| rows, of which a task holds ``emitted`` at a time.

    Blocks of both tables meet where the tables lie: nothing is sent but the scores.
    """
    return _met(queries.withColumn("want", F.lit(0)), items, ["vector"], metric, None, query_block, item_block, emitted)


def coded_vectors(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """``(item_idx, codes, scale)``: one byte per coordinate of the vector at length 1, and what a step of the codes is worth."""
    units = unit_vectors(vectors.where(F.col(column).isNotNull()).select("item_idx", F.col(column).alias("vector")))
    return units.mapInArrow(_coded, "item_idx long, codes binary, scale double")


def _coded(batches):
    for batch in batches:
        if batch.num_rows:
            rows = as_matrix(batch.column(1))
            scale = np.maximum(np.abs(rows).max(axis=1), NORM_FLOOR) / 127
            codes = np.rint(rows / scale[:, None]).astype(np.int8)
            yield pa.record_batch({"item_idx": batch.column(0), "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "scale": scale})


def nearest_by_codes(queries: DataFrame, codes: DataFrame, items: DataFrame, k: int, more: int = 4, **blocks) -> DataFrame:
    """The k best items by cosine among the ``more``·k best by one-byte codes, with exact scores.

    The blocks of the first pass carry a byte per coordinate in place of
    eight; only the vectors of the items it leaves are read in full.
    """
    from basketflow.operators.graph import pair_scores

    queries = settle(unit_vectors(queries.select("query_id", "vector")))
    rough = top_items(block_scores(queries, codes, more * k, "dot", **blocks), more * k).select("query_id", "item_idx")
    return top_items(pair_scores(rough, queries, unit_vectors(items.select("item_idx", "vector")), queries.count()), k)


def unseen_items(
    queries: DataFrame, items: DataFrame, excluded: DataFrame, k: int, metric: str = "cosine", **blocks
) -> DataFrame:
    """Exact k nearest items outside ``excluded`` (query_id, item_idx).

    Each query asks for as many items more as it excludes, so k allowed ones remain.
    """
    excluded = excluded.select("query_id", "item_idx").distinct()
    more = excluded.groupBy("query_id").agg(F.count(F.lit(1)).alias("_more"))
    queries = queries.join(more, "query_id", "left")
    queries = queries.withColumn("want", F.coalesce(F.col("_more"), F.lit(0)) + k).drop("_more")
    scores = block_scores(queries, items, k, metric, **blocks)
    return top_items(scores.join(excluded, ["query_id", "item_idx"], "left_anti"), k)


def drop_excluded(found: DataFrame, excluded: DataFrame, key: str = "query_id") -> DataFrame:
    """Takes excluded items out of finished lists, which become shorter; ranks close up."""
    left = found.join(excluded.select(key, "item_idx"), [key, "item_idx"], "left_anti")
    return top_rows(left.drop("rank"), [key], best_first(), 2**31 - 1).select(key, "rank", "item_idx", "score")


def retrieve_for_users(users: DataFrame, items: DataFrame, k: int, excluded: DataFrame | None = None, **how):
    """k nearest items per user vector; exclusions apply to the finished list."""
    found = nearest_items(users, items, k, **how)
    return found if excluded is None else drop_excluded(found, excluded)


def history_items(queries: DataFrame, max_history: int = 15) -> DataFrame:
    return queries.select("query_id", F.explode(last_items(F.col("history"), max_history)).alias("item_idx")).distinct()


def retrieve_for_history(
    queries: DataFrame, items: DataFrame, k: int, excluded: DataFrame | None = None, max_history: int = 15, **how
) -> DataFrame:
    """k nearest items to the history vector, then without history and excluded items."""
    found = nearest_items(history_vectors(queries, items, True, max_history), items, k, **how)
    gone = history_items(queries, max_history)
    if excluded is not None:
        gone = gone.unionByName(excluded.select("query_id", "item_idx")).distinct()
    return drop_excluded(found, gone)


# ---- candidate lists --------------------------------------------------------------------------

def force_positive(cands: Column, positive: Column) -> Column:
    """The list itself when it holds the positive, else with the positive in its last slot."""
    shorter = F.slice(cands, 1, F.greatest(F.size(cands) - 1, F.lit(0)))
    return F.when(F.array_contains(cands, positive), cands).otherwise(F.concat(shorter, F.array(positive)))


def as_lists(ranked: DataFrame, key: str = "query_id", name: str = "cands") -> DataFrame:
    """Ranked rows to one array per key; lists are as short as the k they were cut to."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", "item_idx")))
    return ranked.groupBy(key).agg(F.transform(pairs, lambda p: p["item_idx"]).alias(name))


def with_nearest(
    queries: DataFrame, items: DataFrame | BucketedVectors, k: int, keep_empty: bool = False, max_history: int = 15,
    index: CellIndex | None = None, probes: int = 0, name: str = "cands",
) -> DataFrame:
    """``queries`` (query_id, history, …) with the k items nearest to their ``history_vectors``, best first, by cosine.

    Rows of one query_id are one query, as in ``history_vectors``; with
    ``keep_empty`` one without a known item is searched by a zero vector, else
    it drops out.  Only rows of queries are grouped.  A block of them meets the
    catalog twice where it lies, for its vectors and for its lists, so neither
    vectors nor scores are sent or written.
    """
    others = [c for c in queries.columns if c != "query_id"]
    rows = settle(queries.where(F.col("query_id").isNotNull()))
    tasks = max(1, min(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_QUERIES)))
    grouped = rows.repartition(tasks, "query_id").groupBy("query_id").agg(F.collect_list(F.struct(*others)).alias("rows"))
    nothing = F.array().cast("array<bigint>")
    own = lambda r: F.coalesce(F.filter(last_items(r["history"], max_history), lambda x: x.isNotNull()).cast("array<bigint>"), nothing)
    lists = grouped.select("query_id", "rows", F.flatten(F.transform("rows", own)).alias("items"))
    catalog = rows_of(items).select(F.col("item_idx").cast("long").alias("item_idx"), "vector")
    more, probes = [], probes if index is not None else 0
    if index is not None:
        celled = index.vectors.where(F.col("item_idx").isNotNull() & F.col("cell").isNotNull())
        celled = celled.select(F.col("item_idx").cast("long").alias("item_idx"), "vector", F.col("cell").cast("int").alias("cell"))
        more = [settle(celled.sort("cell", "item_idx")), index.centers.select(F.col("item_idx").cast("long").alias("center"), "vector")]
    kind = T.StructType([lists.schema["query_id"], lists.schema["rows"], T.StructField("items", T.ArrayType(T.LongType()))])
    found = meet(
        lists, catalog, min(SEARCH_BLOCK, max(HELD // max(k, 1), 64)), SEARCH_BLOCK,
        lambda block: _NearestToHistory(k, keep_empty, probes, block), kind, whole=True, lookups=more, passes=3 if more else 2)
    return found.select("query_id", F.inline("rows"), F.col("items").alias(name))


def candidate_lists(queries: DataFrame, items: DataFrame, k: int, force: bool = True, **how) -> DataFrame:
    """``(query_id, history, pos_item_idx, cands, ts)`` with the positive among the candidates, for every query.

    A history without any known item is a zero vector, which is as near to one item as to the next.
    """
    if how:
        lists = nearest_lists(history_vectors(queries, items, keep_empty=True), items, k, **how)
        rows = queries.join(lists, "query_id")
    else:
        rows = with_nearest(queries.select("query_id", "history", "pos_item_idx", "ts"), items, k, keep_empty=True)
    cands = force_positive(F.col("cands"), F.col("pos_item_idx")) if force else F.col("cands")
    return rows.select("query_id", "history", "pos_item_idx", cands.alias("cands"), "ts")


def mix_retrievers(found: Mapping[str, DataFrame], k: int, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Sum of weight·score per item over the retrievers that returned it; weights sum to 1."""
    weights = weights or {name: 1.0 for name in found}
    total = sum(weights[name] for name in found)
    rows = None
    for name, ranked in found.items():
        part = ranked.select("query_id", "item_idx", (F.col("score") * (weights[name] / total)).alias("score"))
        rows = part if rows is None else rows.unionByName(part)
    mixed = rows.groupBy("query_id", "item_idx").agg(F.round(F.sum("score"), SCORE_DIGITS).alias("score"))
    return top_items(mixed, k)


# ---- indexes ----------------------------------------------------------------------------------

def index_statistics(items: DataFrame, metric: str = "cosine") -> DataFrame:
    return items.agg(F.count(F.lit(1)).alias("n_items"), F.max(F.size("vector")).cast("long").alias("dimension")).select(
        "n_items", "dimension", F.lit(metric).alias("metric")
    )


def _ml_vectors(df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("_features", array_to_vector(unit(F.col("vector"))))


def fit_cells(items: DataFrame, n_cells: int, seed: int = 42):
    """Coarse centers of the item vectors, for search by cell."""
    from pyspark.ml.clustering import KMeans

    return KMeans(k=n_cells, seed=seed, featuresCol="_features", predictionCol="cell").fit(_ml_vectors(items))


def with_cells(items: DataFrame, model) -> DataFrame:
    return model.transform(_ml_vectors(items)).drop("_features")


@dataclass(frozen=True)
class CellIndex:
    """Items by cell: ``vectors`` (item_idx, vector of length 1, length, cell) and ``centers`` (item_idx = cell, vector)."""

    vectors: DataFrame
    centers: DataFrame

    @classmethod
    def build(cls, items: DataFrame, n_cells: int, seed: int = 42) -> CellIndex:
        model = fit_cells(items, n_cells, seed)
        rows = with_cells(items.withColumn("length", norm(F.col("vector"))), model)
        # one center per cell, and the number of cells is an argument
        centers = [(i, [float(x) for x in center]) for i, center in enumerate(model.clusterCenters())]
        frame = items.sparkSession.createDataFrame(centers, "item_idx long, vector array<double>")
        return cls(rows.withColumn("vector", unit(F.col("vector"))), frame)

    def write(self, path: str) -> None:
        """Vectors partitioned by cell, so a search reads the cells it probes, and the centers next to them."""
        self.vectors.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
        self.centers.write.mode("overwrite").parquet(f"{path}/centers")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> CellIndex:
        return cls(spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/centers"))


def nearest_by_cell(queries: DataFrame, index: CellIndex, k: int, probes: int) -> DataFrame:
    """The k best items among those in each query's ``probes`` nearest cells.

    A query whose cells hold fewer than k items is searched in all cells, so every query gets k items where there are k.
    Items in the order of their cells meet blocks of queries, each of which
    keeps its best over all cells that it probes: k rows per query and part of
    the items, however many cells are probed.
    """
    queries = settle(unit_vectors(queries.select("query_id", "vector")))
    near = nearest_items(queries, index.centers, probes, "l2").select("query_id", F.col("item_idx").cast("int").alias("cell"))
    # A query that occurs twice may have a cell twice: a list holds it once, and there are as many lists.
    near = near.withColumn("_list", F.row_number().over(W.partitionBy("query_id", "cell").orderBy("cell")))
    cells = near.groupBy("query_id", "_list").agg(F.collect_list("cell").alias("cells"))
    probed = settle(queries.join(cells, "query_id").select("query_id", "vector", F.lit(k).cast("long").alias("want"), "cells"))
    items = index.vectors.where(F.col("cell").isNotNull()).select(F.col("item_idx").cast("long").alias("item_idx"), "vector", F.col("cell").cast("int").alias("cell"))
    items = settle(items.sort("cell", "item_idx"))
    parts = max(1, -(-items.count() // TASK_ITEMS))
    found = meet(
        _dealt(probed, probed.count(), k), items.coalesce(parts), min(SEARCH_BLOCK, max(HELD // max(k, 1), 64)), SEARCH_BLOCK, _BestInCells,
        "query_id long, item_idx long, score double")
    found = top_items(found, k)
    return _filled(queries, found, index.vectors, k)


def nearest_by_hash(
    queries: DataFrame, items: DataFrame, k: int, bucket_length: float = 1.0, tables: int = 4, seed: int = 42
) -> DataFrame:
    """The k best items among those that share a hash bucket with the query in some table.

    A query whose buckets hold fewer than k items is searched exactly, so every query gets k items where there are k.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import vector_to_array

    lsh = BucketedRandomProjectionLSH(
        inputCol="_features", outputCol="_hashes", bucketLength=bucket_length, numHashTables=tables, seed=seed
    )
    model = lsh.fit(_ml_vectors(items))

    def buckets(df: DataFrame) -> DataFrame:
        mark = lambda t: F.struct(
            F.lit(t).alias("table"), vector_to_array(F.col("_hashes")[t])[0].cast("long").alias("bucket")
        )
        marks = F.array(*[mark(t) for t in range(tables)])
        return model.transform(_ml_vectors(df)).select(*df.columns, F.inline(marks))

    queries = settle(queries.select("query_id", "vector"))
    scores = block_scores(buckets(queries), buckets(items), k, "cosine", ["table", "bucket"])
    return _filled(queries, top_items(scores.dropDuplicates(["query_id", "item_idx"]), k), items, k)


def _filled(queries: DataFrame, found: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """``found`` with exact lists for the queries that have fewer than k items there."""
    found = settle(found)
    full = found.where(F.col("rank") == k).select("query_id")
    short = queries.join(full, "query_id", "left_anti")
    again = top_items(block_scores(short, items, k, "cosine"), k)
    return found.join(full, "query_id", "left_semi").unionByName(again)


def trained_vectors(matrix: DataFrame, rank: int = 64, seed: int = 42, iterations: int = 10) -> tuple[DataFrame, DataFrame]:
    """User and item unit vectors learnt from the matrix by implicit-feedback ALS."""
    model = fit_factors(matrix, rank, seed, implicit=True, iterations=iterations)
    users = model.userFactors.select(F.col("id").cast("long").alias("user_idx"), unit(F.col("features")).alias("vector"))
    items = model.itemFactors.select(F.col("id").cast("long").alias("item_idx"), unit(F.col("features")).alias("vector"))
    return users, items


def fit_factors(matrix: DataFrame, rank: int, seed: int = 42, implicit: bool = False, iterations: int = 10):
    from pyspark.ml.recommendation import ALS

    return ALS(
        rank=rank, seed=seed, implicitPrefs=implicit, nonnegative=not implicit, maxIter=iterations,
        userCol="user_idx", itemCol="item_idx", ratingCol="weight",
    ).fit(matrix.withColumn("weight", F.col("weight").cast("float")))
