"""Two tables that meet in blocks, without an exchange of either.

The task that reads rows packs them into blocks, one Arrow stream each, and a
block travels as one row through Spark's cartesian product, which pairs the
partitions of both tables and reads each where it lies.  For a block of the
left table the task sees one block of the right table after the other, so it
keeps what the left block asks for and sends only results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOOKUP_ROWS = 1 << 16
WHOLE_ROWS = 4_096  # rows of the right table in a block where a task reads all of it


def _packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """One binary column: a block of up to ``size`` rows as an Arrow stream."""

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as writer:
                    writer.write_batch(batch.slice(at, size))
                yield pa.record_batch({name: pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return rows.mapInArrow(pack, f"{name} binary")


def _opened(block) -> pa.Table:
    return pa.ipc.open_stream(block.as_buffer()).read_all()


def meet(
    left: DataFrame, right: DataFrame, left_rows: int, right_rows: int, begin: Callable[[pa.Table], object], schema,
    whole: bool = False, lookups: Sequence[DataFrame] = (), passes: int = 1,
) -> DataFrame:
    """What ``begin(block)`` yields for each block of ``left`` in its ``add(block)`` per block of ``right`` and its ``end()``.

    A task pairs one partition of each table, so the right partitions must be
    few and each fits a task: ``end`` speaks for one of them.  With ``whole``
    every task reads all of ``right``, block by block, and ``end`` speaks for
    the whole table, even an empty one.  Blocks of ``lookups``, tables with
    columns of their own, come along with those of ``right``.  With several
    ``passes`` a block meets all of them again, after a call of ``turn()``.
    """
    def run(batches) -> Iterator[pa.RecordBatch]:
        now, at, state = None, 0, None
        for batch in batches:
            for number, turn, mine, theirs in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2), batch.column(3), strict=True):
                if number != now:  # the first row of a block brings it along
                    if state is not None:
                        yield from state.end()
                    now, at, state = number, 0, begin(_opened(mine))
                if turn != at:
                    at = turn
                    state.turn()
                if len(theirs.as_buffer()):
                    yield from state.add(_opened(theirs))
        if state is not None:
            yield from state.end()

    blocks = _packed(right, right_rows, "_right")
    for table in lookups:
        blocks = blocks.unionByName(_packed(table, right_rows if "vector" in table.columns else LOOKUP_ROWS, "_right"))
    if whole:
        none = right.sparkSession.range(0, 1, 1, 1).select(F.lit(b"").alias("_right"))
        blocks = blocks.unionByName(none)
    # A left block travels with the first right block of a partition, not with each.
    blocks = blocks.select("_right", (F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0).alias("_first"))
    blocks = blocks.coalesce(1) if whole else blocks
    pairs = _packed(left, left_rows, "_left").select(F.monotonically_increasing_id().alias("_block"), "_left")
    pairs = pairs.select("*", (F.explode(F.array(*map(F.lit, range(passes)))) if passes > 1 else F.lit(0)).alias("_pass"))
    pairs = pairs.crossJoin(blocks.hint("shuffle_replicate_nl"))
    sent = F.when(F.col("_first") & (F.col("_pass") == 0), F.col("_left")).alias("_left")
    return pairs.select("_block", "_pass", sent, "_right").mapInArrow(run, schema)


def stored_matrix(column) -> np.ndarray:
    """A list column as a (rows, dim) matrix of the stored kind."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, … of each run, one run after the other."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
