"""Vectors gathered from buckets: same rows as a join, no exchange of the catalog, hot items, other sessions."""

import re

import numpy as np
import pytest

from basketflow.operators import ranking, retrieval
from basketflow.operators.gathering import BucketedVectors
from basketflow.session import fresh_path
from basketflow.sources.bucketed import bucket_count, read_bucketed, write_bucketed


@pytest.fixture(autouse=True)
def no_small_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def vectors(spark):
    drawn = np.random.default_rng(1).normal(size=(200, 8)).astype(np.float32)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(drawn)], "item_idx long, vector array<float>")


@pytest.fixture
def stored(spark, vectors):
    return BucketedVectors.write(vectors, fresh_path(spark, "bucketed"), 7)


def lists_of(spark, extra=()):
    draw = np.random.default_rng(2)
    rows = [(i, int(x), int(x) % 3) for i, x in enumerate(draw.integers(0, 220, 3_000))]
    rows += [(10_000 + i, 5, 0) for i in range(2_000)]  # one item holds a third and more of all rows
    rows += [(20_000 + i, 215, 1) for i in range(1_000)]  # a frequent item without a vector
    return spark.createDataFrame([*rows, *extra], "query_id long, item_idx long, bucket long")


def plain(rows):
    return sorted((r.query_id, -1 if r.item_idx is None else r.item_idx, r.bucket, None if r.vector is None else tuple(r.vector)) for r in rows)


def scans_without_exchange(plan: str) -> bool:
    """Whether every bucketed scan is read in its buckets, and no exchange lies between it and its sort."""
    lines = plan.split("\n")
    at = [i for i, line in enumerate(lines) if "FileScan parquet" in line and "Bucketed: true" in line]
    return bool(at) and not any("Exchange" in line for i in at for line in lines[max(0, i - 4):i])


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("share", [1, 10, 1_000])
def test_same_rows_as_a_join(spark, vectors, stored, how, share):
    lists = lists_of(spark, [(30_000, None, 2), (30_001, None, 2)])
    expected = lists.join(vectors, "item_idx", how)
    assert plain(stored.gather(lists, how, share).collect()) == plain(expected.collect())


def test_empty_tables(spark, vectors, stored):
    lists = lists_of(spark)
    assert stored.gather(lists.limit(0), "left").isEmpty()
    nothing = BucketedVectors.write(vectors.limit(0), fresh_path(spark, "bucketed"))
    assert nothing.gather(lists).isEmpty()
    assert nothing.gather(lists, "left").where("vector IS NULL").count() == lists.count()


def test_the_catalog_is_not_exchanged(spark, stored):
    plan = stored.gather(lists_of(spark))._jdf.queryExecution().executedPlan().toString()
    joined = plan[plan.index("SortMergeJoin"):]
    assert scans_without_exchange(joined), plan
    # the lists and the few hot items, into the table's buckets
    assert joined.count("SortMergeJoin") == 2 == len(re.findall(r"Exchange hashpartitioning\(item_idx#\d+L, 7\)", joined))


def test_another_session_reads_the_buckets(spark, vectors):
    path = fresh_path(spark, "bucketed")
    write_bucketed(vectors, path, "item_idx", 5)
    for name in [t.name for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]:
        spark.sql(f"DROP TABLE {name}")  # what a session that did not write knows
    read = read_bucketed(spark, path)
    assert sorted(map(tuple, read.select("item_idx").collect())) == sorted(map(tuple, vectors.select("item_idx").collect()))
    plan = BucketedVectors(read).gather(lists_of(spark))._jdf.queryExecution().executedPlan().toString()
    assert scans_without_exchange(plan[plan.index("SortMergeJoin"):])
    assert len(read.inputFiles()) == 5


def test_a_folder_is_replaced(spark, vectors):
    path = fresh_path(spark, "bucketed")
    BucketedVectors.write(vectors, path, 5)
    again = BucketedVectors.write(vectors.where("item_idx < 10"), path, 3)
    assert again.rows.count() == 10


def test_unknown_way(spark, stored):
    with pytest.raises(ValueError):
        stored.gather(lists_of(spark), "right")


def test_bucket_count():
    assert bucket_count(0, 520) == 1 and bucket_count(10, 520, 8) == 8
    assert bucket_count(1_000_000_000, 520) == 3_875


def test_histories_and_features_are_the_same(spark, vectors, stored):
    draw = np.random.default_rng(3)
    rows = [(q, draw.integers(0, 210, q % 20).tolist(), 5, draw.permutation(220)[:30].tolist()) for q in range(120)]
    queries = spark.createDataFrame(rows, "query_id long, history array<long>, pos_item_idx long, cands array<long>")

    def shown(frame, keys):
        return {tuple(r[k] for k in keys): [round(float(x), 9) for c, x in r.asDict().items() if c not in keys] for r in frame.collect()}

    units = lambda v: {r.query_id: np.round(r.vector, 9).tolist() for r in retrieval.history_vectors(queries, v, keep_empty=True).collect()}
    assert units(stored) == units(vectors) and len(units(stored)) == 120
    keys = ("query_id", "slot", "item_idx")
    found = shown(ranking.pair_features(queries, stored), keys)
    assert found == shown(ranking.pair_features(queries, vectors), keys) and len(found) == 120 * 30
