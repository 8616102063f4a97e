"""Whole jobs, storage, serving, streaming, and every registered query."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from basketflow.operators import serving as V
from basketflow.plans.prepare import prepare, prepared
from basketflow.session import shared_dir
from basketflow.sources import tables as S
from basketflow.sources.retail import raw_lines


def test_prepare(spark, data, tmp_path):
    folder = str(tmp_path / "out")
    prepare(raw_lines(spark, data), folder, negatives=5)
    lines = prepared(spark, folder, "interactions_clean")
    assert prepared(spark, folder, "items_clean").agg(F.sum("popularity")).first()[0] == lines.count()
    assert prepared(spark, folder, "customers_clean").agg(F.sum("n_lines")).first()[0] == lines.count()
    sequences = S.read_sequences(spark, f"{folder}/sequences")
    assert sequences.where("size(neg) <> 5").count() == 0
    assert {r[0] for r in sequences.select("split").distinct().collect()} == {"train", "val", "test"}
    items, customers = S.read_id_maps(spark, folder)
    assert items.agg(F.max("item_idx")).first()[0] == items.count() - 1
    report = S.read_report(spark, f"{folder}/quality_report", "ordinal long, step string, rows_removed long")
    removed = report.agg(F.sum("rows_removed")).first()[0]
    assert raw_lines(spark, data).count() - removed == lines.count()


def test_missing_split_raises(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.createDataFrame([(1, "train"), (2, "val")], "query_id long, split string")
    S.write_sequences(rows, path)
    assert S.read_sequences(spark, path, ["val"]).count() == 1
    with pytest.raises(FileNotFoundError):
        S.read_sequences(spark, path)
    assert S.read_candidates(spark, path)[1] == ["test"]


def test_split_read_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "s")
    S.write_sequences(spark.createDataFrame([(1, "train"), (2, "val")], "query_id long, split string"), path)
    plan = S.read_sequences(spark, path, ["val"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [split" in plan or "PartitionFilters: [isnotnull(split" in plan


def test_row_rules_reach_the_scan(spark, data):
    from basketflow.operators.clean import keep_valid_rows

    rows = spark.read.parquet(f"{data}/lineitem.parquet").withColumnRenamed("l_quantity", "quantity")
    plan = keep_valid_rows(rows)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity" in plan


def test_return_rule_reaches_the_scan(spark, data):
    from basketflow.operators.clean import keep_valid_rows

    rows = spark.read.parquet(f"{data}/orders.parquet").withColumnRenamed("o_orderpriority", "unique_transaction")
    plan = keep_valid_rows(rows)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(o_orderpriority,C)" in plan


def test_feature_files_are_cut(spark, tmp_path):
    path = str(tmp_path / "f")
    S.write_features(spark.range(0, 1000, 1, 1), path, shard_rows=300)
    assert len(list((tmp_path / "f").glob("part-*.parquet"))) == 4


def test_seeded_order_is_that_of_the_whole_table(spark, tmp_path):
    path = str(tmp_path / "f")
    rows = spark.range(0, 500, 1, 3).selectExpr("id % 50 AS query_id", "id AS item_idx", "id % 2 AS label")
    S.write_features(rows, path, shard_rows=40)

    def order(seed, partitions):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        return [r.item_idx for r in S.read_features(spark, path, ["item_idx"], seed).collect()]

    first = order(7, 2)
    assert first == order(7, 5) and sorted(first) == list(range(500))
    assert first != order(8, 2) and first != sorted(first)


def test_csv_lines(spark, tmp_path):
    path = str(tmp_path / "lines.csv")
    spark.createDataFrame([("1", "2")], "a string, b string").write.option("header", True).csv(path)
    assert S.read_lines(spark, path).columns == ["a", "b"]


def test_first_existing(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "b" / "t"))
    assert S.first_existing(spark, [str(tmp_path / "a"), str(tmp_path / "b")], "t").count() == 3
    with pytest.raises(FileNotFoundError):
        S.first_existing(spark, [str(tmp_path / "a")], "t")


def test_display_count(spark):
    rows = spark.createDataFrame([(n,) for n in (1, 2, 3, 5, 11, 12, 100)], "n long")
    assert [r[0] for r in rows.select(V.display_count(F.col("n"))).collect()] == [1, 2, 3, 3, 8, 9, 9]


def test_stream_of_lines(spark, data, tmp_path):
    from basketflow.streaming.lines import start, valid_lines

    source = str(tmp_path / "in")
    raw_lines(spark, data).repartition(3).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    query = start(stream, str(tmp_path / "out"), str(tmp_path / "state"), availableNow=True)
    assert query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == valid_lines(spark.read.parquet(source)).count()


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())


def test_entry(spark, data):
    rows = entry.entry(spark).collect()
    assert len(rows) == 12


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


FAST = ["p2_parse_dates", "f14_clean_lines", "w1_line_sequences", "m4_popularity_metrics", "e8_nearest_for_histories", "r1_features", "l1_info_nce"]


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, data, name):
    import duckdb

    from tools.check_sql import TABLES, rows_of

    db = duckdb.connect()
    for table in TABLES.split():
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    mine = entry.queries()[name](spark, data).toPandas()
    assert rows_of(mine) == rows_of(db.execute(entry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["j3_unseen_scores", "m6_item_knn", "m8_user_knn", "e8_nearest_for_histories", "r1_features", "v1_recall"])
def test_plans_have_no_cross_join(spark, data, name):
    plan = entry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_sequences_shuffle_rows_once_more_for_their_runs(spark, data):
    plan = entry.queries()["w1_sequences"](spark, data)._jdf.queryExecution().executedPlan().toString()
    # the settled, range-partitioned lines go to their runs; the countries are combined first
    assert plan.count("Exchange hashpartitioning(_run") == 1
    assert plan.count("Exchange hashpartitioning(user_idx") <= 2 and "Exchange rangepartitioning" not in plan


def test_full_evaluation_on_a_sample(spark, data):
    from basketflow.catalog import views as W
    from basketflow.operators.scoring import score_features
    from basketflow.plans.evaluation import BASELINES, evaluate_all

    scorer = lambda features: score_features(features, W.dense_ranker())
    out = evaluate_all(W.sequences(spark, data), W.vectors(spark, data), scorer, ["val", "test"], (5, 10), 500, 20, sample=30).collect()
    assert {r["model"] for r in out} == {*BASELINES, "Retrieval", "Ranked candidates"}
    assert {r["split"] for r in out} == {"val", "test"} and all(0 <= r["value"] <= 1 for r in out)
    values = {(r["model"], r["split"], r["metric"], r["k"]): r["value"] for r in out}
    assert all(values[m, s, "Recall", 5] <= values[m, s, "Recall", 10] for m, s, _, _ in values)
