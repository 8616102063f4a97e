"""Sharding by histogram sort: splitters are refined by exact byte counts, then the rows are exchanged once.

Rows are ordered by a key (hash of the text, doc_id, number of the row), so
equal texts stand together.  For every cut that shards of equal size need, a
bracket of two keys with known bytes below them is narrowed: sampled keys of
the bracket become probes, and one pass counts the exact bytes and rows
between all probes.  A cut between two shards ends at the first key with its
share of the bytes below, so the law does not depend on the probes; cuts
inside a shard only bound what one task gets and end within a tolerance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from basketflow.llm.hashing import md5_long
from basketflow.session import Scratch, settle

PROBES = 32  # sampled keys per open cut and round
PART_BYTES = 1 << 30  # a shard is dealt to tasks in parts of about this size
PART_TOLERANCE = 0.1  # of a part, for the cuts inside a shard
_LOWEST = -(1 << 63)
_KEY = ["_hash", "_id", "_row"]


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    """The key columns as 24 bytes that compare as the key does."""
    columns = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in _KEY]
    flipped = np.stack([c.view(np.uint64) ^ np.uint64(1 << 63) for c in columns], axis=1)
    return np.frombuffer(flipped.astype(">u8").tobytes(), "S24") if batch.num_rows else np.empty(0, "S24")


def _padded(keys: np.ndarray) -> list[bytes]:
    return [bytes(k).ljust(24, b"\0") for k in keys]


def histogram(rows: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact (bytes, rows) below each of the sorted ``probes``; the driver gets a row per probe."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(probes) + 1), np.int64)
        for batch in batches:
            place = np.searchsorted(probes, _keys(batch), side="right")
            size = batch.column(batch.schema.get_field_index("_size")).to_numpy(zero_copy_only=False)
            np.add.at(sums[0], place, size)
            sums[1] += np.bincount(place, minlength=len(probes) + 1)
        held = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[0][held]), pa.array(sums[1][held])], names=["place", "bytes", "rows"])

    found = rows.select(*_KEY, "_size").mapInArrow(count, "place long, bytes long, rows long")
    found = found.groupBy("place").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).toArrow()
    sums = np.zeros((2, len(probes) + 1), np.int64)
    for i, name in enumerate(("bytes", "rows")):
        sums[i, found["place"].to_numpy()] = found[name].to_numpy()
    return np.cumsum(sums[0])[:-1], np.cumsum(sums[1])[:-1]


def _sampled(rows: DataFrame, low: np.ndarray, high: np.ndarray, shares: np.ndarray, turn: int) -> np.ndarray:
    """Keys strictly inside the brackets, each kept with its bracket's share."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys(batch)
            bracket = np.searchsorted(low, keys, side="right") - 1
            inside = (bracket >= 0) & (keys > low[bracket]) & (keys < high[bracket])
            mixed = (batch.column(batch.num_columns - 1).to_numpy().view(np.uint64) + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            kept = keys[inside & ((mixed >> np.uint64(11)).astype(np.float64) / (1 << 53) < shares[bracket])]
            yield pa.RecordBatch.from_arrays([pa.array(_padded(kept), pa.binary())], names=["key"])

    found = rows.select(*_KEY, F.xxhash64(*_KEY).alias("_draw")).mapInArrow(pick, "key binary").toArrow()
    return np.unique(np.array(found["key"].to_pylist(), "S24"))


@dataclass
class Splitters:
    """Cuts of the key order, with the exact bytes and rows below each."""

    keys: np.ndarray
    bytes_below: np.ndarray
    rows_below: np.ndarray
    rounds: int = 0
    probes: int = field(default=0)


def find_splitters(rows: DataFrame, targets: np.ndarray, tolerance: np.ndarray, total: tuple[int, int]) -> Splitters:
    """For each target the first key with at least that many bytes below it, or any key within its tolerance.

    ``total`` holds the bytes and rows of all ``rows``.  Each round is two
    passes over the narrow key columns: one samples the open brackets, one
    counts exactly below the samples.
    """
    ends = np.array([b"", b"\xff" * 25], "S25")
    known = {"keys": ends, "bytes": np.array([0, total[0]]), "rows": np.array([0, total[1]])}
    turn = probes = 0
    while True:
        at = np.searchsorted(known["bytes"], targets, side="left")  # the first known key that reaches the target
        at = np.where(targets > 0, at, 0)
        over = known["bytes"][at] - targets
        before = np.maximum(at - 1, 0)
        under = targets - known["bytes"][before]
        # a row lies strictly inside the bracket if more than the row of its lower end does
        inside = known["rows"][at] - known["rows"][before] - (before > 0)
        closed = (inside <= 0) | (over <= tolerance) | ((under <= tolerance) & (before > 0))
        if closed.all():
            exact = (inside <= 0) | (over <= np.where(before > 0, under, over))
            chosen = np.where(exact, at, before)
            return Splitters(known["keys"][chosen], known["bytes"][chosen], known["rows"][chosen], turn, probes)
        low, which = np.unique(before[~closed], return_index=True)
        high, count = at[~closed][which], inside[~closed][which]
        # cuts that share a bracket share its probes
        wanted = PROBES * np.bincount(np.searchsorted(low, before[~closed]), minlength=len(low))
        turn += 1
        sample = _sampled(rows, known["keys"][low], known["keys"][high], np.minimum(1.0, wanted / np.maximum(count, 1)), turn)
        if not len(sample):
            continue
        probes += len(sample)
        counted = histogram(rows, sample)
        keys = np.concatenate([known["keys"], sample.astype("S25")])
        order = np.argsort(keys, kind="stable")
        known = {
            "keys": keys[order],
            "bytes": np.concatenate([known["bytes"], counted[0]])[order],
            "rows": np.concatenate([known["rows"], counted[1]])[order],
        }


def shard_rows(
    docs: DataFrame, shards: int = 8, carry: tuple[str, ...] | None = None, part_bytes: int = PART_BYTES
) -> DataFrame:
    """The columns ``carry`` (default: all) of every row of ``docs``, with size, text_crc32, shard and slot.

    size is the UTF-8 length of the text plus one (null: one); shard s holds
    the rows whose bytes below them in key order, times ``shards`` over all
    bytes, round down to s: shards differ by less than twice the largest row.
    slot numbers the rows of a shard from 0 without gaps.  A null text has
    no checksum; a null doc_id comes first; equal rows differ by their number
    and may be cut apart, as are equal texts where a shard ends among them.
    Columns named as the added ones are replaced, all others are kept.  The
    rows are settled first, so that the rows counted are the rows exchanged.
    """
    added = ["size", "text_crc32", "shard", "slot"]
    carry = tuple(c for c in (carry or docs.columns) if c not in added)
    body = F.col("text").cast("string")
    # whatever their names, the caller's columns stay apart from those of the sort
    prepared = docs.select(
        F.struct(*carry).alias("_carried"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("_size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.coalesce(md5_long(body), F.lit(-1).cast("long")).alias("_hash"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST).cast("long")).alias("_id"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = settle(prepared)
    total, count = rows.agg(F.sum("_size"), F.count(F.lit(1))).first()
    total = total or 0
    parts = max(1, -(-total // (shards * part_bytes)))
    cuts = np.arange(1, shards * parts)
    targets = (cuts * total + shards * parts - 1) // (shards * parts)
    tolerance = np.where(cuts % parts == 0, 0, int(PART_TOLERANCE * total / (shards * parts)))
    splitters = find_splitters(rows, targets, tolerance, (total, count)) if count else Splitters(*[np.empty(0, "S25")] * 3)
    starts = np.concatenate([[0], splitters.rows_below]).astype(np.int64)
    offsets = starts - starts[(np.arange(len(starts)) // parts) * parts]
    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_offset", T.LongType())])
    cut_keys = splitters.keys

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.searchsorted(cut_keys, _keys(batch).astype("S25"), side="right")
            columns = [*batch.columns, pa.array(part.astype(np.int32)), pa.array(offsets[part])]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_part", "_offset"])

    dealt = rows.mapInArrow(deal, schema).repartitionById(shards * parts, F.col("_part"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(*_KEY))
    return dealt.select(
        *[F.col("_carried")[c].alias(c) for c in carry],
        F.col("_size").alias("size"),
        "text_crc32",
        F.floor(F.col("_part") / parts).cast("int").alias("shard"),
        (F.col("_offset") + place - 1).cast("long").alias("slot"),
    )
