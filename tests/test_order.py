"""Order-dependent operators, with keys that hold much of the table."""

import datetime as dt
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from basketflow.operators import negatives as N, sequences as S
from basketflow.operators.ordering import all_ranks, previous_values, row_index, running_total, top_rows
from basketflow.operators.tables import dense_ids


def skewed(spark, n=1200, seed=1):
    rng = np.random.default_rng(seed)
    users = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n))
    rows = [(int(u), int(t), i, int(x)) for i, (u, t, x) in enumerate(zip(users, rng.integers(0, 50, n), rng.integers(0, 30, n)))]
    return spark.createDataFrame(rows, "u long, t long, id long, x long").repartition(5), rows


def test_row_index_is_dense_and_ordered(spark):
    df, rows = skewed(spark)
    got = {r["id"]: r["n"] for r in row_index(df, [F.col("t").desc(), F.col("id")], "n").collect()}
    assert got == {r[2]: n for n, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[2])))}


def test_running_total(spark):
    df, rows = skewed(spark)
    want, sums = {}, defaultdict(int)
    for u, _, i, x in sorted(rows, key=lambda r: (r[0], r[2])):
        want[i], sums[u] = sums[u], sums[u] + x
    for parts in (1, 9):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r["id"]: r["b"] for r in running_total(df, ["u"], [F.col("id")], "x", "b").collect()}
        assert got == want


def test_previous_values_of_a_hot_key(spark):
    df, rows = skewed(spark)
    want, seen = {}, defaultdict(list)
    for u, _, i, x in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        want[i] = seen[u][-4:]
        seen[u].append(x)
    for parts in (1, 3, 40):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r["id"]: r["h"] for r in previous_values(df, "u", ["t", "id"], "x", "h", 4).collect()}
        assert got == want


def test_all_ranks_of_a_hot_key(spark):
    df, rows = skewed(spark)
    want, counts = {}, defaultdict(int)
    for u, t, i, _ in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
        counts[u] += 1
        want[i] = counts[u]
    for parts in (1, 9):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r["id"]: r["n"] for r in all_ranks(df, ["u"], [F.col("t").desc(), F.col("id")], "n").collect()}
        assert got == want


def test_top_rows(spark):
    df, rows = skewed(spark)
    got = top_rows(df, ["u"], [F.col("x").desc(), F.col("id")], 3).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    want = {(r[2], n + 1) for g in groups.values() for n, r in enumerate(sorted(g, key=lambda r: (-r[3], r[2]))[:3])}
    assert {(r["id"], r["rank"]) for r in got} == want


def test_top_rows_are_cut_before_the_shuffle(spark):
    df, _ = skewed(spark)
    plan = top_rows(df, ["u"], [F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_dense_ids(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("10",)], "k string")
    assert {r["k"]: r["i"] for r in dense_ids(df, "k", "i").collect()} == {"10": 0, "a": 1, "b": 2}


def events(spark, n=18, users=1):
    start = dt.datetime(2024, 1, 1)
    rows = [(u, u, start + dt.timedelta(hours=i), i, i % 7, "AB"[i % 2]) for u in range(users) for i in range(n)]
    return spark.createDataFrame(rows, "customer_id long, user_idx long, ts timestamp_ntz, event long, item_idx long, country string")


def test_sequences_of_one_customer(spark):
    out = S.build_sequences(events(spark), tie="event", query_id="event").orderBy("query_id").collect()
    assert [r["query_id"] for r in out] == list(range(2, 18))
    assert [len(r["history"]) for r in out] == list(range(2, 16)) + [15, 15]
    assert out[-1]["history"] == [i % 7 for i in range(2, 17)]
    assert {r["country"] for r in out} == {"B"}


def test_split_borders(spark):
    rows = events(spark, 11)
    out = {r["query_id"]: r["split"] for r in S.build_sequences(rows, tie="event", query_id="event").collect()}
    # quantiles 0.8 and 0.9 of 11 equal steps fall exactly on events 8 and 9
    assert out[7] == "train" and out[8] == "val" and out[9] == "test" and out[10] == "test"


def test_sequences_without_ids_and_with_hot_customer(spark):
    rows = events(spark, 60, 3)
    usual = S.build_sequences(rows, tie="event").orderBy("query_id").collect()
    spark.conf.set("spark.sql.shuffle.partitions", 30)
    hot = S.build_sequences(rows, tie="event").orderBy("query_id").collect()
    assert [r["query_id"] for r in usual] == list(range(len(usual)))
    assert usual == hot


def test_history_never_holds_later_rows(spark):
    df, rows = skewed(spark, 400)
    start = dt.datetime(2024, 1, 1)
    lines = spark.createDataFrame([(u, u, start + dt.timedelta(days=t), i, i) for u, t, i, _ in rows],
                                  "customer_id long, user_idx long, ts timestamp_ntz, event long, item_idx long")
    when = {i: (u, t, i) for u, t, i, _ in rows}
    for r in S.build_sequences(lines, tie="event", query_id="event").collect():
        own = when[r["query_id"]]
        assert all(when[h][0] == own[0] and when[h][1:] < own[1:] for h in r["history"])


def test_negatives(spark):
    rows = spark.createDataFrame([(q, [1, 2, q % 11], 5) for q in range(200)], "query_id long, history array<long>, pos_item_idx long")
    for n_items, n in ((11, 4), (11, 50), (97, 20)):
        for r in N.with_negatives(rows, n_items, n).collect():
            forbidden = set(r["history"]) | {r["pos_item_idx"]}
            available = set(range(n_items)) - forbidden
            assert len(r["neg"]) == len(set(r["neg"])) == min(n, len(available))
            assert set(r["neg"]) <= available


def test_negatives_when_none_are_left(spark):
    rows = spark.createDataFrame([(1, [0, 1], 2)], "query_id long, history array<long>, pos_item_idx long")
    assert N.with_negatives(rows, 3, 5).first()["neg"] == []
    assert N.with_epoch_negatives(rows, 3, 5).first()["neg"] == []


def test_epoch_negatives(spark):
    rows = spark.createDataFrame([(q, [0], 1) for q in range(50)], "query_id long, history array<long>, pos_item_idx long")
    out = N.with_epoch_negatives(rows, 5, 8).collect()
    assert all(len(r["neg"]) == 8 and set(r["neg"]) == {2, 3, 4} and r["neg"][:3] == r["neg"][3:6] for r in out)
    one, two = (N.with_epoch_negatives(rows, 1000, 8, epoch=e).orderBy("query_id").collect() for e in (0, 1))
    assert one != two


def test_negatives_are_spread_over_the_catalog(spark):
    rows = spark.range(4000).select(F.col("id").alias("query_id"), F.array(F.lit(0).cast("long")).alias("history"), F.lit(1).cast("long").alias("pos_item_idx"))
    counts = N.with_negatives(rows, 100, 10).select(F.explode("neg").alias("i")).groupBy("i").count().toPandas()
    assert len(counts) == 98 and counts["count"].min() > 250 and counts["count"].max() < 600


def test_fixed_sample(spark):
    rows = spark.range(1000).withColumnRenamed("id", "query_id")
    one, two = (sorted(r[0] for r in N.fixed_sample(rows.repartition(p), 50).collect()) for p in (1, 7))
    assert one == two and len(set(one)) == 50
    assert N.fixed_sample(rows.limit(5), 50).count() == 5
