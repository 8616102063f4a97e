"""Queries over item vectors: user vectors, nearest items, candidates, mixes, indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketflow.catalog import ORACLES, query, views as V
from basketflow.catalog.sql import candidates as define_candidates, history_vectors as define_vectors, part, sql, top
from basketflow.functions import vectors as X
from basketflow.functions.text import format_id_list
from basketflow.operators import graph as G, retrieval as R
from basketflow.operators.gathering import BucketedVectors
from basketflow.operators.sequences import valid_items
from basketflow.session import fresh_path, settle

ENDS = "round(v[1], 6) AS first, round(v[64], 6) AS last, round(list_sum(v), 6) AS total"


def _ends(rows):
    v = F.col("vector")
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return rows.select("query_id", F.round(v[0], 6).alias("first"), F.round(v[63], 6).alias("last"), F.round(total, 6).alias("total"))


def _self_queries(spark, d):
    return V.vectors(spark, d).withColumnRenamed("item_idx", "query_id")


def user_queries(spark, d):
    """Per user the history of the latest training sample."""
    latest = V.split(spark, d, "train").groupBy("user_idx")
    latest = latest.agg(F.max_by("history", F.struct("ts", "query_id")).alias("history"))
    return latest.withColumnRenamed("user_idx", "query_id")


def _user_vectors(spark, d):
    return R.history_vectors(user_queries(spark, d), V.vectors(spark, d))


part("uq", "train", "SELECT user_idx AS query_id, arg_max(history, (ts, query_id)) AS history FROM train GROUP BY 1")

define_vectors("uv", "uq")
part("user_scores", "uv vec", "SELECT query_id, item_idx, round(list_dot_product(uv.v, vec.u), 9) AS score FROM uv, vec")
part("self_scores", "vec", "SELECT a.item_idx AS query_id, b.item_idx, round(list_dot_product(a.u, b.u), 9) AS score FROM vec a, vec b")


def ranked(source: str, k: int) -> str:
    return f"SELECT query_id, rank, item_idx, score FROM ({top(source, k)})"


@query("e1_history_vectors", sql("hv", f"SELECT query_id, {ENDS} FROM hv"))
def e1(spark, d):
    return _ends(R.history_vectors(V.sequences(spark, d), V.vectors(spark, d)))


part("few", "seq", "SELECT query_id, [x FOR x IN history IF x < 10] AS history FROM seq")
define_vectors("fv", "few")


@query("e1_sparse_histories", sql("few fv", f"""
SELECT query_id, {ENDS} FROM (SELECT query_id, coalesce(fv.v, [0.0 FOR i IN range(64)]) AS v FROM few LEFT JOIN fv USING (query_id))"""))
def e1_sparse(spark, d):
    rows = V.sequences(spark, d).select("query_id", valid_items(F.col("history"), 10).alias("history"))
    return _ends(R.history_vectors(rows, V.vectors(spark, d), keep_empty=True))


@query("e2_unit_vectors", sql("", """
SELECT vec_id AS query_id, round(w[1] / n, 6) AS first, round(w[64] / n, 6) AS last, round(list_sum(w) / n, 6) AS total
FROM (SELECT vec_id, w, greatest(sqrt(list_dot_product(w, w)), 1e-8) AS n
      FROM (SELECT vec_id, [x * (vec_id + 1) FOR x IN embedding::DOUBLE[]] AS w FROM embeddings))"""))
def e2(spark, d):
    scaled = F.transform("vector", lambda x: x.cast("double") * (F.col("query_id") + 1))
    return _ends(R.unit_vectors(_self_queries(spark, d).withColumn("vector", scaled)))


@query("e3_nearest_cosine", sql("self_scores", ranked("self_scores", 10)))
def e3(spark, d):
    return R.nearest_items(_self_queries(spark, d), V.vectors(spark, d), 10)


@query("e3_nearest_small_blocks", sql("self_scores", ranked("self_scores", 10)))
def e3_blocks(spark, d):
    return R.nearest_items(_self_queries(spark, d), V.vectors(spark, d), 10, query_block=100, item_block=64)


part("far_scores", "vec", """
SELECT a.item_idx AS query_id, b.item_idx, round(-sqrt(greatest(list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v)
  - 2 * list_dot_product(a.v, b.v), 0)), 9) AS score FROM vec a, vec b WHERE a.item_idx <> b.item_idx""")


@query("e4_nearest_l2", sql("far_scores", ranked("far_scores", 9)))
def e4(spark, d):
    rows = R.nearest_items(_self_queries(spark, d), V.vectors(spark, d), 10, "l2")
    own = _self_queries(spark, d).select("query_id", F.col("query_id").alias("item_idx"))
    return R.drop_excluded(rows, own)


part("hop", "vec", """
SELECT a.item_idx AS query_id, b.item_idx, list_dot_product(a.u, b.u) AS similarity FROM vec a JOIN vec b ON b.item_idx = a.item_idx + 1""")


@query("e5_cosine_from_distance", sql("hop", "SELECT query_id, round(similarity, 6) AS direct, round(similarity, 6) AS converted FROM hop"))
def e5(spark, d):
    rows = R.unit_vectors(V.vectors(spark, d))
    other = rows.select((F.col("item_idx") - 1).alias("item_idx"), F.col("vector").alias("next"))
    pairs = rows.join(other, "item_idx")
    return pairs.select(
        F.col("item_idx").alias("query_id"), F.round(X.cosine(F.col("vector"), F.col("next")), 6).alias("direct"),
        F.round(X.cosine_from_distance(X.squared_distance(F.col("vector"), F.col("next"))), 6).alias("converted"),
    )


RECALL = 0.9


def _judged(spark, d, found):
    """Per query how many items are listed, and whether their scores are the exact cosines; whether all lists together hold RECALL of the exact ones."""
    mine, units = settle(found), settle(R.unit_vectors(V.vectors(spark, d)))
    pairs = mine.join(units.withColumnRenamed("vector", "theirs"), "item_idx").join(units.select(F.col("item_idx").alias("query_id"), "vector"), "query_id")
    off = F.abs(F.col("score") - X.dot(F.col("vector"), F.col("theirs")))
    exact = R.nearest_items(_self_queries(spark, d), V.vectors(spark, d), 10)
    near = mine.join(exact.select("query_id", "item_idx", F.lit(1).alias("is_near")), ["query_id", "item_idx"], "left")
    recall = near.agg(F.count("is_near") / F.count(F.lit(1))).scalar()
    lists = pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("listed"), (F.max(off) <= 1e-6).alias("exact_scores"))
    return lists.withColumn("recall_reached", recall >= RECALL)


LISTS = "SELECT vec_id AS query_id, 10::BIGINT AS listed, true AS exact_scores, true AS recall_reached FROM embeddings"


def _recall_per_query(spark, d, found):
    exact = R.nearest_items(_self_queries(spark, d), V.vectors(spark, d), 10).select("query_id", "item_idx")
    near = exact.join(found.select("query_id", "item_idx", F.lit(1).alias("is_found")), ["query_id", "item_idx"], "left")
    return near.groupBy("query_id").agg((F.count("is_found") / F.count(F.lit(1))).alias("recall"))


def _by_cell(spark, d):
    return R.nearest_by_cell(_self_queries(spark, d), R.CellIndex.build(V.vectors(spark, d), 16), 10, 11)


@query("e6_nearest_by_cell", LISTS)
def e6(spark, d):
    return _judged(spark, d, _by_cell(spark, d))


@query("e6_recall_per_query")
def e6_recall(spark, d):
    """The share of the exact ten nearest that each query's list holds."""
    return _recall_per_query(spark, d, _by_cell(spark, d))


@query("e6_all_cells_probed", sql("self_scores", ranked("self_scores", 10)))
def e6_all(spark, d):
    return R.nearest_by_cell(_self_queries(spark, d), R.CellIndex.build(V.vectors(spark, d), 8), 10, 8)


@query("e9_nearest_by_codes", LISTS)
def e9_codes(spark, d):
    """Search by one-byte codes, the best of it scored exactly."""
    items = V.vectors(spark, d)
    return _judged(spark, d, R.nearest_by_codes(_self_queries(spark, d), R.coded_vectors(items), items, 10))


@query("e15_similarity_table_streamed", sql("user_scores", "SELECT query_id, item_idx, score FROM user_scores"))
def e15_streamed(spark, d):
    """The same table from small blocks and small batches."""
    return R.similarity_table(_user_vectors(spark, d), V.vectors(spark, d), query_block=40, item_block=64, emitted=100)


@query("e7_nearest_by_hash", LISTS)
def e7(spark, d):
    return _judged(spark, d, R.nearest_by_hash(_self_queries(spark, d), V.vectors(spark, d), 10, tables=6))


def _by_graph(spark, d):
    return G.nearest_by_graph(_self_queries(spark, d), G.NeighborGraph.build(V.vectors(spark, d)), 10)


@query("e7_neighbor_graph", LISTS)
def e7_graph(spark, d):
    return _judged(spark, d, _by_graph(spark, d))


@query("e7_graph_lists")
def e7_lists(spark, d):
    """The lists that the graph gives; recall is judged by e7_neighbor_graph."""
    return _by_graph(spark, d)


@query("e7_graph_edges", "SELECT vec_id AS id, 16::BIGINT AS degree, true AS ordered, true AS no_loop FROM embeddings")
def e7_edges(spark, d):
    """What holds of every node of a built graph: as many edges as asked for, none to itself, each to another node."""
    edges = G.NeighborGraph.build(V.vectors(spark, d)).edges
    return edges.groupBy("id").agg(
        F.count(F.lit(1)).alias("degree"), (F.countDistinct("near") == F.count(F.lit(1))).alias("ordered"), F.bool_and(F.col("id") != F.col("near")).alias("no_loop"))


@query("e8_nearest_for_histories", sql("near_scores", ranked("near_scores", 10)))
def e8(spark, d):
    items = V.vectors(spark, d)
    return R.nearest_items(R.history_vectors(V.sequences(spark, d), items), items, 10)


def _written_index(spark, d, cells):
    path = fresh_path(spark, "index")
    R.CellIndex.build(V.vectors(spark, d), cells).write(path)
    return R.CellIndex.read(spark, path)


@query("e9_index_table", "SELECT vec_id AS item_idx, 64::BIGINT AS dimension, 1.0::DOUBLE AS length, true AS cell_known FROM embeddings")
def e9(spark, d):
    return _written_index(spark, d, 16).vectors.select(
        "item_idx", F.size("vector").cast("long").alias("dimension"), F.round(X.norm(F.col("vector")), 6).alias("length"),
        F.col("cell").between(0, 15).alias("cell_known"))


@query("a13_index_statistics", "SELECT count(*) AS n_items, max(len(embedding))::BIGINT AS dimension, 'cosine' AS metric FROM embeddings")
def a13(spark, d):
    return R.index_statistics(V.vectors(spark, d))


part("user_top", "user_scores", top("user_scores", 20))
part("user_out", "uq", "SELECT DISTINCT query_id, unnest(history) AS item_idx FROM uq")


@query("e10_for_users", sql("user_top user_out", f"""
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_idx) AS rank, item_idx, score
FROM user_top ANTI JOIN user_out USING (query_id, item_idx)"""))
def e10(spark, d):
    return R.retrieve_for_users(_user_vectors(spark, d), V.vectors(spark, d), 20, R.history_items(user_queries(spark, d)))


part("all_top", "near_scores", top("near_scores", 20))


@query("e11_for_histories", sql("all_top seq", """
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_idx) AS rank, item_idx, score
FROM all_top t ANTI JOIN (SELECT DISTINCT query_id, unnest(history) AS item_idx FROM seq) h USING (query_id, item_idx)"""))
def e11(spark, d):
    return R.retrieve_for_history(V.sequences(spark, d), V.vectors(spark, d), 20)


@query("e12_for_many_users", sql("user_scores", ranked("user_scores", 20)))
def e12(spark, d):
    return R.retrieve_for_users(_user_vectors(spark, d), V.vectors(spark, d), 20)


@query("e13_candidate_lists", sql("cands", "SELECT query_id, pos_item_idx, ts, array_to_string(cands, ' ') AS cands FROM cands"))
def e13(spark, d):
    rows = R.candidate_lists(V.tests(spark, d), V.vectors(spark, d), V.K_CANDS)
    return rows.select("query_id", "pos_item_idx", "ts", format_id_list(F.col("cands")).alias("cands"))


part("bare", "tests", """
SELECT query_id, CASE query_id % 7 WHEN 0 THEN []::BIGINT[] WHEN 1 THEN [999999]::BIGINT[] ELSE history END AS history, pos_item_idx, ts FROM tests""")
define_vectors("bv", "bare")
part("bare_scores", "bare bv vec", """
SELECT query_id, item_idx, coalesce(round(list_dot_product(bv.v, vec.u), 9), 0) AS score FROM (SELECT query_id FROM bare) CROSS JOIN vec LEFT JOIN bv USING (query_id)""")
define_candidates("bare_cands", "bare_scores", "bare", 20)


@query("e13_without_history", sql("bare_cands", "SELECT query_id, pos_item_idx, ts, array_to_string(cands, ' ') AS cands FROM bare_cands"))
def e13_bare(spark, d):
    gone = F.when(F.col("query_id") % 7 == 0, F.array().cast("array<bigint>")).when(F.col("query_id") % 7 == 1, F.array(F.lit(999_999).cast("long")))
    queries = V.tests(spark, d).withColumn("history", F.coalesce(gone, "history"))
    rows = R.candidate_lists(queries, V.vectors(spark, d), 20)
    return rows.select("query_id", "pos_item_idx", "ts", format_id_list(F.col("cands")).alias("cands"))


@query("e13_candidates_by_cells", sql("cands", "SELECT query_id, pos_item_idx, ts, array_to_string(cands, ' ') AS cands FROM cands"))
def e13_cells(spark, d):
    rows = R.candidate_lists(V.tests(spark, d), V.vectors(spark, d), V.K_CANDS, index=_written_index(spark, d, 8), probes=8)
    return rows.select("query_id", "pos_item_idx", "ts", format_id_list(F.col("cands")).alias("cands"))


@query("k5_forced_positive", sql("seq", """
SELECT query_id, array_to_string(CASE WHEN list_contains(history, pos_item_idx) THEN history
  ELSE list_append(history[:len(history) - 1], pos_item_idx) END, ' ') AS cands FROM seq"""))
def k5(spark, d):
    forced = R.force_positive(F.col("history"), F.col("pos_item_idx"))
    return V.sequences(spark, d).select("query_id", format_id_list(forced).alias("cands"))


part("user_pop", "pop_recs", "SELECT user_idx AS query_id, item_idx, score FROM pop_recs")
part("mixed", "user_top user_pop", """
SELECT query_id, item_idx, round(sum(score), 9) AS score FROM (
  SELECT query_id, item_idx, score * (3.0::DOUBLE / 4.0) AS score FROM user_top
  UNION ALL SELECT query_id, item_idx, score * (1.0::DOUBLE / 4.0) FROM user_pop) GROUP BY 1, 2""")


@query("e14_mixed_retrievers", sql("mixed", ranked("mixed", 10)))
def e14(spark, d):
    from basketflow.operators.baselines import recommend_popular

    near = R.retrieve_for_users(_user_vectors(spark, d), V.vectors(spark, d), 20)
    popular = recommend_popular(V.matrix(spark, d), V.users(spark, d), 20).withColumnRenamed("user_idx", "query_id")
    return R.mix_retrievers({"vectors": near, "popular": popular}, 10, {"vectors": 3.0, "popular": 1.0})


@query("e15_similarity_table", sql("user_scores", "SELECT query_id, item_idx, score FROM user_scores"))
def e15(spark, d):
    return R.similarity_table(_user_vectors(spark, d), V.vectors(spark, d))


@query("j6_all_scores", sql("vec", """
SELECT a.item_idx AS query_id, b.item_idx, round(list_dot_product(a.v, b.v), 9) AS score FROM vec a, vec b"""))
def j6(spark, d):
    return R.similarity_table(_self_queries(spark, d), V.vectors(spark, d), "dot")


part("unseen_scores", "user_scores user_out", "SELECT * FROM user_scores ANTI JOIN user_out USING (query_id, item_idx)")


@query("e16_unseen_for_users", sql("unseen_scores", ranked("unseen_scores", 10)))
def e16(spark, d):
    out = R.history_items(user_queries(spark, d))
    return R.unseen_items(_user_vectors(spark, d), V.vectors(spark, d), out, 10)


@query("j11_exclusions", sql("self_scores", """
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_idx) AS rank, item_idx, score
FROM (SELECT * FROM self_scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_idx) <= 10) WHERE item_idx <> query_id"""))
def j11(spark, d):
    own = _self_queries(spark, d).select("query_id", F.col("query_id").alias("item_idx"))
    return R.drop_excluded(R.nearest_items(_self_queries(spark, d), V.vectors(spark, d), 10), own)


@query("j5_gathered_vectors", sql("seq vec", """
SELECT query_id, item_idx, round(v[1], 6) AS first FROM (SELECT query_id, unnest(history) AS item_idx FROM seq) JOIN vec USING (item_idx)"""))
def j5(spark, d):
    rows = V.sequences(spark, d).select("query_id", F.explode("history").alias("item_idx"))
    return R.gather(rows, V.vectors(spark, d)).select("query_id", "item_idx", F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


def stored_vectors(spark, d):
    return BucketedVectors.write(V.vectors(spark, d), fresh_path(spark, "bucketed"))


@query("j5_gathered_from_buckets", ORACLES["j5_gathered_vectors"])
def j5_buckets(spark, d):
    rows = V.sequences(spark, d).select("query_id", F.explode("history").alias("item_idx"))
    found = R.gather(rows, stored_vectors(spark, d))
    return found.select("query_id", "item_idx", F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


@query("e1_history_vectors_from_buckets", ORACLES["e1_history_vectors"])
def e1_buckets(spark, d):
    return _ends(R.history_vectors(V.sequences(spark, d), stored_vectors(spark, d)))


@query("e17_trained_vectors", sql("mat", """
SELECT 'user' AS side, user_idx AS id, 64::BIGINT AS dimension, 1.0::DOUBLE AS length FROM (SELECT DISTINCT user_idx FROM mat)
UNION ALL SELECT 'item', item_idx, 64, 1.0 FROM (SELECT DISTINCT item_idx FROM mat)"""))
def e17(spark, d):
    shown = lambda rows, side, ident: rows.select(
        F.lit(side).alias("side"), F.col(ident).alias("id"), F.size("vector").cast("long").alias("dimension"),
        F.round(X.norm(F.col("vector")), 6).alias("length"))
    users, items = R.trained_vectors(V.matrix(spark, d), 64)
    return shown(users, "user", "user_idx").union(shown(items, "item", "item_idx"))


@query("e18_pair_scores", sql("hv seq vec", """
SELECT query_id, round(list_dot_product(hv.v, vec.u), 6) AS score FROM seq JOIN hv USING (query_id) JOIN vec ON vec.item_idx = pos_item_idx"""))
def e18(spark, d):
    rows, items = V.sequences(spark, d), R.unit_vectors(V.vectors(spark, d))
    pairs = rows.select("query_id", F.col("pos_item_idx").alias("item_idx")).join(items.withColumnRenamed("vector", "item"), "item_idx")
    pairs = pairs.join(R.history_vectors(rows, V.vectors(spark, d)), "query_id")
    return pairs.select("query_id", F.round(X.dot(F.col("vector"), F.col("item")), 6).alias("score"))


@query("e19_exported_vectors", sql("mat", "SELECT DISTINCT item_idx, 64::BIGINT AS dimension FROM mat"))
def e19(spark, d):
    from basketflow.sources.tables import read_vectors, write_vectors

    path = fresh_path(spark, "vectors")
    write_vectors(R.trained_vectors(V.matrix(spark, d), 64)[1], path)
    return read_vectors(spark, path).select("item_idx", F.size("vector").cast("long").alias("dimension"))
