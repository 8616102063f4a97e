"""Queries over event lines and clean lines: samples, splits, lists, negatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketflow.catalog import query, views as V
from basketflow.catalog.sql import mixed, part, sql
from basketflow.functions.text import format_id_list, parse_id_list
from basketflow.operators import negatives as N, sequences as S, tables as T
from basketflow.operators.evaluate import rank_of
from basketflow.operators.matrix import user_profile
from basketflow.sources.retail import event_lines

TEXT = "array_to_string({}, ' ')"


@query("a7_time_cutoffs", sql("cutoffs", "SELECT round(q80, 0) AS q80, round(q90, 0) AS q90 FROM cutoffs"))
def a7(spark, d):
    cut = S.time_cutoffs(event_lines(spark, d))
    return cut.select(F.round(F.get("cutoffs", F.lit(0)), 0).alias("q80"), F.round(F.get("cutoffs", F.lit(1)), 0).alias("q90"))


@query("w1_sequences", sql("seq", f"""
SELECT query_id, user_idx, ts, {TEXT.format('history')} AS history_idx, pos_item_idx, country, split FROM seq"""))
def w1(spark, d):
    rows = S.to_text_lists(V.sequences(spark, d))
    return rows.select("query_id", "user_idx", "ts", "history_idx", "pos_item_idx", "country", "split")


part("mapped", "clean item_map customer_map", """
SELECT user_idx, item_idx, stock_code, invoice_date AS ts FROM clean JOIN item_map USING (stock_code) JOIN customer_map USING (customer_id)""")
part("line_cut", "mapped", "SELECT quantile_cont(epoch_us(ts), 0.8) AS q80, quantile_cont(epoch_us(ts), 0.9) AS q90 FROM mapped")
part("line_seq", "mapped line_cut", """
SELECT row_number() OVER (ORDER BY user_idx, ts, stock_code) - 1 AS query_id, user_idx, ts, history, item_idx AS pos_item_idx,
       CASE WHEN epoch_us(ts) < q80 THEN 'train' WHEN epoch_us(ts) < q90 THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, list(item_idx) OVER (PARTITION BY user_idx ORDER BY ts, stock_code ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS history
      FROM mapped), line_cut WHERE len(history) >= 2""")


@query("w1_line_sequences", sql("line_seq", f"""
SELECT query_id, user_idx, ts, {TEXT.format('history')} AS history_idx, pos_item_idx, split FROM line_seq"""))
def w1_lines(spark, d):
    rows = V.clean(spark, d)
    mapped = T.with_ids(rows, T.item_id_map(rows), T.customer_id_map(rows)).withColumnRenamed("invoice_date", "ts")
    out = S.to_text_lists(S.build_sequences(mapped, tie="stock_code"))
    return out.select("query_id", "user_idx", "ts", "history_idx", "pos_item_idx", "split")


@query("w2_last_country", sql("ev", """
SELECT user_idx, arg_max(country, (ts, event_id)) AS country FROM ev GROUP BY 1"""))
def w2(spark, d):
    return S.last_country(event_lines(spark, d), ["ts", "event_id"])


@query("w3_split_sizes", sql("seq", """
SELECT split, count(*) AS samples, min(ts) AS first_ts, max(ts) AS last_ts FROM seq GROUP BY 1"""))
def w3(spark, d):
    rows = V.sequences(spark, d).groupBy("split")
    return rows.agg(F.count(F.lit(1)).alias("samples"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


part("timed", "ev", """
SELECT event_id, ts, list(item_idx) OVER (PARTITION BY user_idx ORDER BY ts, event_id ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS history
FROM ev WHERE event_id % 10 <> 3""")


@query("w3_without_time", sql("timed", """
SELECT event_id AS query_id, array_to_string(history, ' ') AS history, CASE
  WHEN epoch_us(ts) < (SELECT quantile_cont(epoch_us(ts), 0.8) FROM timed) THEN 'train'
  WHEN epoch_us(ts) < (SELECT quantile_cont(epoch_us(ts), 0.9) FROM timed) THEN 'val' ELSE 'test' END AS split
FROM timed WHERE len(history) >= 2"""))
def w3_untimed(spark, d):
    lines = event_lines(spark, d).withColumn("ts", F.when(F.col("event_id") % 10 != 3, F.col("ts")))
    rows = S.build_sequences(lines, tie="event_id", query_id="event_id")
    return rows.select("query_id", format_id_list(F.col("history")).alias("history"), "split")


@query("w5_train_dev", sql("train", """
SELECT query_id, CASE WHEN epoch_us(ts) < (SELECT quantile_cont(epoch_us(ts), 0.9) FROM train) THEN 'train' ELSE 'dev' END AS part
FROM train"""))
def w5(spark, d):
    return S.train_dev_split(V.split(spark, d, "train")).select("query_id", "part")


@query("w6_last_items", sql("seq", f"SELECT query_id, {TEXT.format('history[-5:]')} AS last_items FROM seq"))
def w6(spark, d):
    return V.sequences(spark, d).select("query_id", format_id_list(S.last_items(F.col("history"), 5)).alias("last_items"))


@query("f20_until_last_train", sql("ev train", "SELECT event_id, item_idx FROM ev WHERE ts <= (SELECT max(ts) FROM train)"))
def f20(spark, d):
    return S.until_last_train(event_lines(spark, d), V.sequences(spark, d)).select("event_id", "item_idx")


@query("f21_valid_items", sql("seq", f"""
SELECT query_id, {TEXT.format('[x FOR x IN history IF x >= 0 AND x < 60]')} AS valid FROM seq"""))
def f21(spark, d):
    return V.sequences(spark, d).select("query_id", format_id_list(S.valid_items(F.col("history"), 60)).alias("valid"))


@query("d3_text_lists", sql("seq", f"""
SELECT query_id, len(history)::BIGINT AS n, list_sum(history)::BIGINT AS total,
       CASE WHEN query_id % 2 = 0 THEN len(history) ELSE 0 END::BIGINT AS n_checked FROM seq"""))
def d3(spark, d):
    rows = S.to_text_lists(V.sequences(spark, d))
    broken = F.when(F.col("query_id") % 2 == 0, F.col("history_idx")).otherwise(F.concat("history_idx", F.lit(" x")))
    rows = rows.withColumn("checked", F.size(parse_id_list(broken))).transform(S.from_text_lists)
    total = F.aggregate("history", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("query_id", F.size("history").cast("long").alias("n"), total.alias("total"),
                       F.col("checked").cast("long").alias("n_checked"))


@query("a10_statistics", sql("ev seq", """
SELECT 'n_users' AS name, count(DISTINCT user_idx) AS value FROM ev
UNION ALL SELECT 'n_items', count(DISTINCT item_idx) FROM ev
UNION ALL SELECT split || '_sequences', count(*) FROM seq GROUP BY split"""))
def a10(spark, d):
    ev = event_lines(spark, d)
    return S.dataset_statistics(V.sequences(spark, d), ev.select("user_idx").distinct(), ev.select("item_idx").distinct())


@query("u1_splits_together", sql("seq", "SELECT query_id, pos_item_idx, split FROM seq"))
def u1(spark, d):
    rows = V.sequences(spark, d)
    parts = [S.of_split(rows, name) for name in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("query_id", "pos_item_idx", "split")


@query("u2_item_difference", sql("seq", f"""
SELECT query_id, {TEXT.format('list_sort(list_distinct([x FOR x IN history IF NOT list_contains(history[-3:], x)]))')} AS rest FROM seq"""))
def u2(spark, d):
    rest = N.set_difference(F.col("history"), S.last_items(F.col("history"), 3))
    return V.sequences(spark, d).select("query_id", format_id_list(F.array_sort(rest)).alias("rest"))


@query("u3_item_union", sql("seq", f"""
SELECT query_id, {TEXT.format('list_sort(list_distinct(list_append(history, pos_item_idx)))')} AS items FROM seq"""))
def u3(spark, d):
    both = N.set_union(F.col("history"), F.array("pos_item_idx"))
    return V.sequences(spark, d).select("query_id", format_id_list(F.array_sort(both)).alias("items"))


# ---- negatives --------------------------------------------------------------------------------
part("catalog_size", "all_items", "SELECT max(item_idx) + 1 AS n FROM all_items")
part("prime", "catalog_size", """
SELECT n, (SELECT min(x) FROM range(n, n + 300) t(x) WHERE NOT EXISTS
           (SELECT 1 FROM range(2, 3000) s(y) WHERE y < x AND x % y = 0)) AS p FROM catalog_size""")


def _draws(seed: int, n: int) -> str:
    start, stride = mixed(str(seed), "query_id") + " % p", f"({mixed(str(seed + 1), 'query_id')} % (p - 1) + 1)"
    return f"""
SELECT query_id, [x FOR x IN [({start} + j * {stride}) % p FOR j IN range(0, least(len(forbidden) + {n} + p - n, p))]
                  IF x < n AND NOT list_contains(forbidden, x)][:{n}] AS neg
FROM (SELECT query_id, list_distinct(list_append(history, pos_item_idx)) AS forbidden FROM seq), prime"""


def _catalog_size(spark, d) -> int:
    return event_lines(spark, d).agg(F.max("item_idx")).first()[0] + 1


@query("k8_negatives", sql("seq prime", f"SELECT query_id, {TEXT.format('neg')} AS neg_idx FROM ({_draws(42, 50)})"))
def k8(spark, d):
    rows = N.with_negatives(V.sequences(spark, d), _catalog_size(spark, d), 50)
    return rows.select("query_id", format_id_list(F.col("neg")).alias("neg_idx"))


@query("k9_epoch_negatives", sql("seq prime", f"""
SELECT query_id, {TEXT.format('[neg[(j % len(neg) + 1)::BIGINT] FOR j IN range(0, 120)]')} AS neg_idx FROM ({_draws(49, 120)})"""))
def k9(spark, d):
    rows = N.with_epoch_negatives(V.sequences(spark, d), _catalog_size(spark, d), 120, epoch=1)
    return rows.select("query_id", format_id_list(F.col("neg")).alias("neg_idx"))


@query("k10_fixed_sample", sql("seq", f"""
SELECT query_id, pos_item_idx FROM seq ORDER BY {mixed('42', 'query_id')}, query_id LIMIT 200"""))
def k10(spark, d):
    return N.fixed_sample(V.sequences(spark, d).select("query_id", "pos_item_idx"), 200)


# ---- lists and profiles -----------------------------------------------------------------------
@query("w9_truth_rank", sql("seq", """
SELECT query_id, nullif(list_position(history[:10], pos_item_idx), 0)::BIGINT AS rank FROM seq"""))
def w9(spark, d):
    return V.sequences(spark, d).select("query_id", rank_of(F.col("history"), F.col("pos_item_idx"), 10).cast("long").alias("rank"))


@query("w10_profiles", sql("mat users", "SELECT user_idx, item_idx, weight FROM mat SEMI JOIN users USING (user_idx)"))
def w10(spark, d):
    return user_profile(V.matrix(spark, d), V.users(spark, d))
