"""Histogram sort against a plain sort on the driver, with hot groups, ties and many parts."""

import hashlib
import random
import zlib

import pytest

from basketflow.llm.histogram_sort import shard_rows

SCHEMA = "doc_id long, text string, size string, slot string, source string"


def rows_of(seed, count=900):
    draw = random.Random(seed)
    rows = [(i, "x" * draw.choice([0, 1, 30, 400]) + str(i), "s", "t", "u") for i in range(count)]
    rows += [(5000 + i, "one text that a third of all rows hold " * 3, "s", "t", "u") for i in range(count // 2)]
    rows += [(None, None, None, None, None)] * 40 + [(1, "same row", "s", "t", "u")] * 60 + [(6, "", "s", "t", "u"), (8, "é" * 9000, "s", "t", "u")]
    draw.shuffle(rows)
    return rows


def plain(rows, shards):
    """(doc_id, text, size, crc, shard, slot) by one sort."""
    def key(r):
        return (-1 if r[1] is None else int(hashlib.md5(r[1].encode()).hexdigest()[:15], 16), r[0] is not None, r[0] or 0)

    total, below, slots, out = sum(len((r[1] or "").encode()) + 1 for r in rows), 0, [0] * shards, []
    for r in sorted(rows, key=key):
        size = len((r[1] or "").encode()) + 1
        shard = below * shards // total
        out.append((r[0], r[1], size, None if r[1] is None else zlib.crc32(r[1].encode()), shard, slots[shard]))
        slots[shard] += 1
        below += size
    return out


@pytest.mark.parametrize(("shards", "part_bytes"), [(8, 1 << 30), (8, 2000), (3, 5000)])
def test_equal_to_a_plain_sort(spark, shards, part_bytes):
    rows = rows_of(shards)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = shard_rows(docs, shards, part_bytes=part_bytes)
    assert found.columns == ["doc_id", "text", "source", "size", "text_crc32", "shard", "slot"]
    got = [(r.doc_id, r.text, r["size"], r.text_crc32, r.shard, r.slot) for r in found.collect()]
    assert sorted(got, key=str) == sorted(plain(rows, shards), key=str)


def test_shards_are_near_equal_and_slots_gapless(spark):
    rows = rows_of(11)
    found = shard_rows(spark.createDataFrame(rows, SCHEMA), 8).collect()
    sizes, slots = [0] * 8, [[] for _ in range(8)]
    for r in found:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in found)
    assert all(sorted(s) == list(range(len(s))) for s in slots)


def test_few_rows_and_none(spark):
    docs = spark.createDataFrame([(1, "a", "s", "t", "u")], SCHEMA)
    assert [(r.shard, r.slot) for r in shard_rows(docs, 8).collect()] == [(0, 0)]
    assert shard_rows(docs.where("false"), 8).collect() == []


def test_one_exchange(spark):
    plan = shard_rows(spark.createDataFrame(rows_of(1), SCHEMA), 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
