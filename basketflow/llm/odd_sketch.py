"""Near-duplicate documents: MinHash bands find candidates, odd sketches estimate them, full sets decide.

1. Every text becomes its set of word shingles.  Texts with equal sets are
   one representative, however many copies there are.
2. MinHash samples of a set go into bands (candidates share a band) and are
   folded into a parity bitmap: the population count of the XOR of two
   bitmaps estimates how many samples differ, most precisely where few do.
3. The members of a band's bucket are compared inside tasks, in blocks of
   bounded size.  A task keeps a spanning forest of the pairs whose estimate
   lies above the threshold less ``MARGIN`` deviations; pairs never leave it.
4. The components of these forests are the candidate groups.  In each, again
   in blocks, pairs that the estimate lets through are decided on the full
   sets, unless they are connected already; links leave as a forest too.
5. The components of the links are the result.

A pair with similarity s shares no band with probability (1 - s^ROWS)^bands,
2e-6 at 0.85 with BANDS; a lower threshold takes more bands, so that it is
found as surely; above that the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.llm.bitmap import bitmap, is_set
from basketflow.llm.components import components
from basketflow.llm.words import shingle_hashes, words_of
from basketflow.session import Scratch, settle

BANDS, ROWS = 18, 4  # of the first BANDS * ROWS samples; the bands are those of a threshold of 0.85
SAMPLES, BITS = 128, 256  # folded into the sketch, and its length
MARGIN = 5.5  # deviations of the estimate
BLOCK_ROWS = 1024  # members of a bucket or group that meet in a task, from each side
BITMAP_BITS = 25  # of the documents whose full sets are needed: 4 MB, whatever the input
BLOCK_SHINGLES = 1 << 21  # at most so many shingles in a block, unless one set alone has more

_A = (np.random.default_rng(5).integers(0, 1 << 31, SAMPLES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = np.random.default_rng(55).integers(0, 1 << 32, SAMPLES, dtype=np.uint32)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """SAMPLES minima over a non-empty set of 64-bit hashes."""
    least = np.full(SAMPLES, np.iinfo(np.uint32).max, np.uint32)
    folded = (shingles >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(folded), 4096):
        values = _A[:, None] * folded[None, start : start + 4096]
        values += _B[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def bands_for(threshold: float) -> int:
    """So many bands that a pair at ``threshold`` is missed no more often than one at 0.85 by BANDS.

    Below 0.77 the samples do not suffice for that, which is an error.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold is a share above 0, at most 1")
    needed = np.log(1 - 0.85**ROWS) * BANDS / np.log(1 - min(threshold, 0.85) ** ROWS)
    bands = int(np.ceil(needed - 1e-9))
    if bands > SAMPLES // ROWS:
        raise ValueError(f"threshold {threshold} takes {bands} bands, and {SAMPLES} samples make {SAMPLES // ROWS}")
    return bands


def bands_of(samples: np.ndarray, bands: int = BANDS) -> list[int]:
    """One 64-bit key per band."""
    return [
        xxhash.xxh3_64_intdigest(samples[i * ROWS : (i + 1) * ROWS].tobytes(), seed=i) - (1 << 63) for i in range(bands)
    ]


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """The parity bitmap of the samples: every (position, value) flips one of BITS bits."""
    mixed = (samples.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    bits = np.bincount((mixed >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def estimate(differing: np.ndarray | int) -> np.ndarray:
    """The similarity that ``differing`` bits of the XOR of two sketches stand for."""
    share = np.minimum(np.asarray(differing) / BITS, 0.4999)
    return 1 + BITS / (4 * SAMPLES) * np.log(1 - 2 * share)


def bits_allowed(threshold: float) -> int:
    """The most differing bits that a pair of at least ``threshold`` may show."""
    deviation = np.sqrt(threshold * (1 - threshold) / SAMPLES)
    counts = np.arange(BITS + 1)
    return int(counts[estimate(counts) >= threshold - MARGIN * deviation].max(initial=0))


def _signatures(bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shingles = shingle_hashes(words_of(text.as_py()))
                if len(shingles):
                    samples = minhash(shingles)
                    rows.append((doc_id, len(shingles), xxhash.xxh3_128_digest(shingles.tobytes()), bands_of(samples, bands), odd_sketch(samples).tolist()))
                else:
                    rows.append((doc_id, 0, None, None, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SIGNATURE_TYPES, strict=True)], names=_SIGNATURE_NAMES)

    return run


_SIGNATURE_NAMES = ["doc_id", "n_shingles", "set_key", "bands", "sketch"]
_SIGNATURE_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def signatures(docs: DataFrame, bands: int = BANDS) -> DataFrame:
    """Per row: doc_id, size and 128-bit key of the shingle set, band keys, odd sketch (null without words)."""
    schema = "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch array<long>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_signatures(bands), schema)


def _shingle_sets(needed):
    """The full sets of the documents whose bit is set, by the key of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.filter(pa.array(is_set(needed.value, batch.column(0).to_numpy()))).column(1)
            for start in range(0, len(texts), 500):
                sets = [shingle_hashes(words_of(t.as_py())) for t in texts[start : start + 500]]
                keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                shingles = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, shingles], names=["set_key", "shingles"])

    return run


class Forest:
    """Union-find over the integers below ``size``."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y

    def stars(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges from the first member of each tree to all others."""
        roots = np.array([self.root(x) for x in range(len(self.parent))], np.int64)
        others = np.flatnonzero(roots != np.arange(len(roots)))
        return ids[roots[others]], ids[others]


def _edges(stars: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [np.concatenate([np.empty(0, np.int64), *[s[i] for s in stars]]) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of consecutive rows that agree in the first ``keys`` columns, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(i)) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        first = tuple(c[0] for c in columns)
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for start, end in zip(starts[:-1], starts[1:], strict=True):
            if held and (start > 0 or first != last):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def _fixed_lists(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.concatenate([np.asarray(c.flatten()) for c in column.chunks]).view(np.uint64).reshape(-1, width)


def _similar(sizes: np.ndarray, sketches: np.ndarray, row: int, others: np.ndarray, threshold: int, allowed: int) -> np.ndarray:
    """Those of ``others`` whose size and sketch do not rule out a link with ``row`` (threshold in percent)."""
    size = sizes[others]
    near = 100 * np.minimum(size, sizes[row]) >= threshold * np.maximum(size, sizes[row])
    others = others[near]
    differing = np.bitwise_count(sketches[others] ^ sketches[row]).sum(axis=1)
    return others[differing <= allowed][np.argsort(differing[differing <= allowed], kind="stable")]


def _candidate_forest(threshold: int, allowed: int):
    """In each block of a bucket: a spanning forest of the pairs that may be links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stars = []
        for table in _runs(batches, 3):
            if table.num_rows < 2:
                continue
            ids, sizes = table["id"].to_numpy(), table["n_shingles"].to_numpy()
            sketches = _fixed_lists(table["sketch"], BITS // 64)
            forest = Forest(len(ids))
            for row in range(len(ids) - 1):
                for other in _similar(sizes, sketches, row, np.arange(row + 1, len(ids)), threshold, allowed).tolist():
                    forest.join(row, other)
            stars.append(forest.stars(ids))
            if len(stars) >= 10_000:
                yield _edges(stars)
                stars = []
        yield _edges(stars)

    return run


def _link_forest(threshold: int, allowed: int):
    """In each block of a candidate group: a spanning forest of its links, decided on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stars = []
        for table in _runs(batches, 3):
            if table.num_rows < 2:
                continue
            ids, sizes = table["id"].to_numpy(), table["n_shingles"].to_numpy()
            sketches = _fixed_lists(table["sketch"], BITS // 64)
            shingles = [x.values.to_numpy().view(np.uint64) for x in table["shingles"]]
            forest = Forest(len(ids))
            for row in range(len(ids) - 1):
                others = _similar(sizes, sketches, row, np.arange(row + 1, len(ids)), threshold, allowed)
                others = np.array([x for x in others.tolist() if forest.root(x) != forest.root(row)], np.int64)
                if not len(others):
                    continue
                ends = np.cumsum(sizes[others])
                joined = np.concatenate([shingles[x] for x in others])
                at = np.minimum(np.searchsorted(shingles[row], joined), len(shingles[row]) - 1)
                shared = np.add.reduceat((shingles[row][at] == joined).astype(np.int64), ends - sizes[others])
                for other in others[100 * shared >= threshold * (sizes[others] + sizes[row] - shared)].tolist():
                    forest.join(row, other)
            stars.append(forest.stars(ids))
        yield _edges(stars)

    return run


def _blocks(members: DataFrame, key: str, chunk: str, chunks: str) -> DataFrame:
    """Copies of each member for every pair of chunks of its key, tagged (key, i, j) with i <= j."""
    other = F.explode(F.sequence(F.lit(0), F.col(chunks) - 1))
    pairs = members.withColumn("_other", other)
    return pairs.select(
        F.col(key).alias("key"), F.least(chunk, "_other").alias("i"), F.greatest(chunk, "_other").alias("j"),
        *[c for c in members.columns if c not in (key, chunk, chunks)],
    )


def _in_blocks(blocks: DataFrame, function) -> DataFrame:
    """Runs ``function`` over each block; blocks of one key are spread over tasks."""
    dealt = blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    return dealt.mapInArrow(function, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text, …).

    Links: Jaccard similarity of the sets of 5-word shingles of the whole
    texts of at least ``threshold`` (whole percents).  component_id is the
    smallest doc_id reachable over links, kept tells doc_id = component_id.
    A text without words (or null) has the empty set and links with nothing.
    Rows that repeat a doc_id are one document: its texts are connected.  A
    row without doc_id links with nothing, has no component and is kept.
    Other columns are not read.  A threshold below 0.77 raises.  The result is settled.
    """
    spark = docs.sparkSession
    percent = round(100 * threshold)
    allowed = bits_allowed(threshold)
    with Scratch(spark) as scratch:
        rows = scratch.settle(signatures(docs, bands_for(threshold)))
        known = rows.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
        # 1. one row per set, with a number of its own
        firsts = [F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")]
        sets = known.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), *firsts)
        sets = scratch.settle(sets.withColumn("id", F.monotonically_increasing_id()))
        numbers = sets.select("id", "n_shingles", "sketch")
        # 3. buckets of bands, in blocks
        banded = sets.select("id", F.explode("bands").alias("band"))
        sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        chunks = F.ceil(F.col("members") / BLOCK_ROWS)
        members = banded.join(sizes, "band").withColumn("chunks", chunks)
        members = members.select("band", "id", "chunks", F.pmod(F.xxhash64("id", "band"), "chunks").alias("chunk"))
        members = members.join(numbers, "id")
        forest = _in_blocks(_blocks(members, "band", "chunk", "chunks"), _candidate_forest(percent, allowed))
        # 4. candidate groups, in blocks of bounded weight
        groups = components(forest, scratch).withColumnsRenamed({"node": "id", "component": "group"})
        groups = scratch.settle(groups.join(sets.select("id", "set_key", "doc_id", "n_shingles", "sketch"), "id"))
        weights = groups.groupBy("group").agg(F.count(F.lit(1)).alias("_rows"), F.sum("n_shingles").alias("_shingles"))
        chunks = F.greatest(F.ceil(F.col("_rows") / BLOCK_ROWS), F.ceil(F.col("_shingles") / BLOCK_SHINGLES))
        weighed = groups.drop("doc_id").join(weights.select("group", chunks.alias("chunks")), "group")
        weighed = weighed.withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks"))
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        # only the sets of candidates travel, and a few more; the join below keeps the candidates
        needed = spark.sparkContext.broadcast(bitmap(groups, "doc_id", BITMAP_BITS))
        shingles = texts.where("doc_id IS NOT NULL").mapInArrow(_shingle_sets(needed), "set_key binary, shingles array<long>")
        shingles = shingles.groupBy("set_key").agg(F.first("shingles").alias("shingles"))
        blocks = _blocks(weighed.join(shingles, "set_key").drop("set_key"), "group", "chunk", "chunks")
        links = _in_blocks(blocks, _link_forest(percent, allowed))
        # 5. a document with several texts connects them
        members_of = scratch.settle(known.select("doc_id", "n_shingles", "set_key").join(sets.select("set_key", "id"), "set_key").drop("set_key"))
        several = members_of.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("_last")).where("a < _last")
        repeats = members_of.join(several, "doc_id").select("a", F.col("id").alias("b"))
        linked = components(links.union(repeats), scratch).withColumnRenamed("node", "id")
        smallest = sets.select("id", "doc_id").join(linked, "id", "left").withColumn("group", F.coalesce("component", "id"))
        names = smallest.groupBy("group").agg(F.min("doc_id").alias("component_id"))
        found = members_of.join(smallest.select("id", "group"), "id").join(names, "group").select("doc_id", "n_shingles", "component_id")
        alone = rows.where("doc_id IS NULL OR set_key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        everything = found.union(alone)
        return settle(everything.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def _marked(marks, at: int, wanted: bool):
    """The rows whose doc_id has, or has not, its bit set; a null id has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(at).cast(pa.int64())
            found = is_set(marks.value, ids.fill_null(0).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(found == wanted))

    return run


def one_per_group(docs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``docs`` without the documents that are not kept; rows that repeat a doc_id stay or go together.

    Only rows that a bitmap of the dropped ids marks are joined with these ids; all others stay without a shuffle.
    """
    dropped = settle(near_duplicates(docs, threshold).where("NOT kept").select(F.col("doc_id").alias("_dropped")).distinct())
    marks = docs.sparkSession.sparkContext.broadcast(bitmap(dropped, "_dropped", BITMAP_BITS))
    at = docs.columns.index("doc_id")
    sure = docs.mapInArrow(_marked(marks, at, False), docs.schema)
    maybe = docs.mapInArrow(_marked(marks, at, True), docs.schema)
    return sure.union(maybe.join(dropped, maybe["doc_id"] == dropped["_dropped"], "left_anti"))
