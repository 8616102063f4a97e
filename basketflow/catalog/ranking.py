"""Queries over candidates: features, negatives, rankers, re-ordering, ranker mixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketflow.catalog import query, views as V
from basketflow.catalog.sql import X, added, linear, mixed, normed, numbers, part, relu, sql, steps, top
from basketflow.operators import ranking as R, scoring as S, tables as T
from basketflow.operators.evaluate import recall_from_scores
from basketflow.operators.gathering import BucketedVectors
from basketflow.operators.retrieval import candidate_lists
from basketflow.session import fresh_path, settle

NAMES = ("dot_uv", "max_sim_recent", "pop", "hist_len", "price_z")


def candidates(spark, d):
    return candidate_lists(V.tests(spark, d), V.vectors(spark, d), V.K_CANDS)


_PRICES: dict[tuple[str, str], object] = {}


def price(spark, d):
    """The price feature of all items, which needs the clean sales lines: settled once per application and folder, as a catalog table is."""
    key = spark.sparkContext.applicationId, d
    if key not in _PRICES:
        rows = V.clean_prices(spark, d)
        _PRICES[key] = settle(R.price_feature(T.item_catalog(rows, ()), T.item_id_map(rows)))
    return _PRICES[key]


def features(spark, d, queries=None, shared=None):
    """All five features; ``queries`` with candidates default to those of the test split."""
    v = shared or V.Shared(spark, d)
    queries = candidate_lists(v.tests, v.vectors, V.K_CANDS) if queries is None else queries
    return R.build_features(queries, v.vectors, R.popularity_feature(v.split("train")), price(spark, d))


@query("a4_popularity_feature", sql("pop_feat", "SELECT item_idx, round(pop, 6) AS pop FROM pop_feat"))
def a4(spark, d):
    return R.popularity_feature(V.split(spark, d, "train")).select("item_idx", *V.six("pop"))


@query("a5_price_feature", sql("price_feat", "SELECT item_idx, round(price_z, 6) AS price_z FROM price_feat"))
def a5(spark, d):
    return price(spark, d).select("item_idx", *V.six("price_z"))


@query("j8_item_prices", sql("items item_map", """
SELECT item_idx, round(price_median, 9) AS price_median FROM items JOIN item_map USING (stock_code)"""))
def j8(spark, d):
    rows = V.clean(spark, d)
    return T.item_catalog(rows).join(T.item_id_map(rows), "stock_code").select("item_idx", *V.nine("price_median"))


SHOWN = "query_id, item_idx, slot, " + ", ".join(f"round({c}, 6) AS {c}" for c in NAMES) + ", label"


@query("r1_features", sql("feat", f"SELECT {SHOWN} FROM feat"))
def r1(spark, d):
    return features(spark, d).select("query_id", "item_idx", "slot", *V.six(*NAMES), "label")


@query("r1_features_from_buckets", sql("feat", f"SELECT {SHOWN} FROM feat"))
def r1_buckets(spark, d):
    v = V.Shared(spark, d)
    stored = BucketedVectors.write(v.vectors, fresh_path(spark, "bucketed"))
    built = R.build_features(candidate_lists(v.tests, v.vectors, V.K_CANDS), stored, R.popularity_feature(v.split("train")), price(spark, d))
    return built.select("query_id", "item_idx", "slot", *V.six(*NAMES), "label")


@query("r1_unknown_candidates", sql("feat cands", f"""
SELECT {SHOWN} FROM feat
UNION ALL SELECT query_id, 999999, len(cands)::BIGINT, 0.0, 0.0, 0.0, round(least(len(history), 15) / 15.0::DOUBLE, 6), 0.0, 0.0 FROM cands"""))
def r1_unknown(spark, d):
    rows = candidates(spark, d).withColumn("cands", F.concat("cands", F.array(F.lit(999_999).cast("long"))))
    pop = R.popularity_feature(V.split(spark, d, "train"))
    built = R.build_features(rows, V.vectors(spark, d), pop, price(spark, d))
    return built.select("query_id", "item_idx", "slot", *V.six(*NAMES), "label")


@query("r8_without_lookups", sql("feat", """
SELECT query_id, item_idx, round(dot_uv, 6) AS dot_uv, 0.0::DOUBLE AS pop, 0.0::DOUBLE AS price_z, label FROM feat"""))
def r8(spark, d):
    rows = R.build_features(candidates(spark, d), V.vectors(spark, d))
    return rows.select("query_id", "item_idx", *V.six("dot_uv"), "pop", "price_z", "label")


def _picked(order: str, n: int) -> str:
    return f"""SELECT query_id, item_idx, label, row_number() OVER (PARTITION BY query_id ORDER BY label DESC, {order}, item_idx) AS rank
FROM feat QUALIFY rank <= {n + 1}"""


@query("k6_hard_negatives", sql("feat", _picked("round(dot_uv, 9) DESC", 5)))
def k6(spark, d):
    return R.hard_negatives(features(spark, d), 5).select("query_id", "item_idx", "label", "rank")


@query("k7_random_negatives", sql("feat", _picked(mixed("42", "query_id", "item_idx"), 5)))
def k7(spark, d):
    return R.random_negatives(features(spark, d), 5).select("query_id", "item_idx", "label", "rank")


def _masked(col: str, seed: int) -> str:
    return f"round(CASE WHEN {mixed(str(seed), 'query_id', 'item_idx')} / 2147483647.0::DOUBLE > 0.3 THEN {col} ELSE 0 END, 6) AS {col}"


@query("r9_masked_features", sql("feat", f"SELECT query_id, item_idx, {_masked('dot_uv', 42)}, {_masked('max_sim_recent', 43)} FROM feat"))
def r9(spark, d):
    rows = R.mask_features(features(spark, d), ("dot_uv", "max_sim_recent"))
    return rows.select("query_id", "item_idx", *V.six("dot_uv", "max_sim_recent"))


# ---- rankers ----------------------------------------------------------------------------------
first, last, cross, wide = V.dense_ranker("norm_first"), V.dense_ranker("norm_last"), V.cross_ranker(), V.wide_ranker()


def _dense_first(source: str) -> str:
    a, b, c = first.hidden
    return steps(source, X, [
        ("z1", linear("x", a)), ("h1", relu(f"({normed('z1', 8)})")),
        ("z2", linear("h1", b)), ("r2", relu(f"({normed('z2', 8)})")), ("h2", added("r2", "h1", 8)),
        ("z3", linear("h2", c)), ("h3", relu(f"({normed('z3', 4)})")),
        ("score", f"({linear('h3', first.out)})[1]")])


def _dense_last(source: str) -> str:
    a, b, c = last.hidden
    return steps(source, X, [
        ("z1", relu(f"({linear('x', a)})")), ("h1", normed("z1", 8)),
        ("z2", relu(f"({linear('h1', b)})")), ("h2", normed("z2", 8)), ("s", added("h1", "h2", 8)),
        ("h3", relu(f"({linear('s', c)})")), ("score", f"({linear('h3', last.out)})[1]")])


def _crossed(source: str) -> str:
    columns, now = [], "x"
    for i, (w, b) in enumerate(cross.cross):
        columns.append((f"m{i}", f"list_dot_product({now}, {numbers(w)})"))
        columns.append((f"c{i}", f"[x[i] * m{i} + {numbers(b)}[i] + {now}[i] FOR i IN range(1, 6)]"))
        now = f"c{i}"
    deep, more = cross.hidden
    columns += [("d1", relu(f"({linear('x', deep)})")), ("d2", relu(f"({linear('d1', more)})")),
                ("both_ends", f"list_concat({now}, d2)"), ("score", f"({linear('both_ends', cross.out)})[1]")]
    return steps(source, X, columns)


def _wide_deep(source: str) -> str:
    a, b = wide.hidden
    return steps(source, X, [
        ("wide", f"({linear('x', wide.wide)})[1]"), ("d1", relu(f"({linear('x', a)})")), ("d2", relu(f"({linear('d1', b)})")),
        ("score", f"wide + ({linear('d2', wide.out)})[1]")])


def _scores(inner: str) -> str:
    return sql("feat", f"SELECT query_id, item_idx, round(score, 6) AS score FROM ({inner})")


def _scored(spark, d, ranker):
    return S.score_features(features(spark, d), ranker)


def _reranked(spark, d, ranker, k, queries=None):
    return R.rerank(S.best_scored(features(spark, d, queries), {"score": ranker}, k), k)


def _shown(rows):
    return rows.select("query_id", "item_idx", *V.six("score"))


@query("r10_dense_ranker", _scores(_dense_first("feat")))
def r10(spark, d):
    return _shown(_scored(spark, d, first))


@query("r10_dense_ranker_norm_last", _scores(_dense_last("feat")))
def r10_last(spark, d):
    return _shown(_scored(spark, d, last))


@query("r11_cross_ranker", _scores(_crossed("feat")))
def r11(spark, d):
    return _shown(_scored(spark, d, cross))


@query("r11_cross_columns", sql("feat", f"""
SELECT query_id, item_idx, round(c2[1], 6) AS cross_dot_uv, round(c2[5], 6) AS cross_price_z FROM ({_crossed('feat')})"""))
def r11_columns(spark, d):
    rows = S.cross_columns(features(spark, d), [(w.tolist(), b.tolist()) for w, b in cross.cross])
    return rows.select("query_id", "item_idx", *V.six("cross_dot_uv", "cross_price_z"))


@query("r12_wide_ranker", _scores(_wide_deep("feat")))
def r12(spark, d):
    return _shown(_scored(spark, d, wide))


@query("r12_wide_column", sql("feat", f"SELECT query_id, item_idx, round(wide, 6) AS wide FROM ({_wide_deep('feat')})"))
def r12_column(spark, d):
    rows = S.wide_column(features(spark, d), wide.wide[0][0].tolist(), float(wide.wide[1][0]))
    return rows.select("query_id", "item_idx", *V.six("wide"))


@query("r13_trained_ranker", sql("feat", "SELECT query_id, item_idx, true AS is_probability FROM feat"))
def r13(spark, d):
    v = V.Shared(spark, d)
    train = features(spark, d, candidate_lists(v.split("val"), v.vectors, V.K_CANDS), v)
    model = S.fit_ranker(R.hard_negatives(train, 20), (128, 64), iterations=20)
    scored = S.score_with(model, features(spark, d, shared=v))
    return scored.select("query_id", "item_idx", F.col("score").between(0, 1).alias("is_probability"))


part("dense_scores", "feat", f"SELECT query_id, item_idx, slot, label, round(score, 9) AS score FROM ({_dense_first('feat')})")
part("cross_scores", "feat", f"SELECT query_id, item_idx, slot, label, round(score, 9) AS score FROM ({_crossed('feat')})")


@query("r14_reranked", sql("dense_scores", top("dense_scores", 10)))
def r14(spark, d):
    return _reranked(spark, d, first, 10)


@query("r15_one_query", sql("dense_scores", f"""
SELECT query_id, rank, item_idx, score FROM ({top('dense_scores', 10)}) WHERE query_id = (SELECT min(query_id) FROM dense_scores)"""))
def r15(spark, d):
    rows = candidates(spark, d)
    one = rows.orderBy("query_id").limit(1)
    return _reranked(spark, d, first, 10, one)


part("some_scores", "dense_scores", "SELECT * FROM dense_scores WHERE query_id % 3 <> 0")


@query("r16_order_kept_without_scores", sql("some_scores cands", f"""
SELECT query_id, rank, item_idx, score FROM ({top('some_scores', 10)})
UNION ALL SELECT query_id, unnest(range(1, 11)), unnest(cands[:10]), 1.0 FROM cands WHERE query_id % 3 = 0"""))
def r16(spark, d):
    v = V.Shared(spark, d)
    queries = settle(candidate_lists(v.tests, v.vectors, V.K_CANDS))
    scored = S.best_scored(features(spark, d, queries, v), {"score": first}, 10)
    scored = scored.withColumn("score", F.when(F.col("query_id") % 3 != 0, F.col("score")))
    return R.rerank_or_keep(queries, scored, 10)


part("dense_top", "dense_scores", top("dense_scores", 10))
part("cross_top", "cross_scores", top("cross_scores", 10))


def _mix(combine: str) -> str:
    return f"""
SELECT c.query_id, c.item_idx, round(coalesce(s.score, 0), 9) AS score
FROM (SELECT DISTINCT query_id, unnest(cands) AS item_idx FROM cands) c LEFT JOIN (
  SELECT query_id, item_idx, {combine}(score) AS score FROM (
    SELECT query_id, item_idx, score * (2.0::DOUBLE / 3.0) AS score FROM dense_top
    UNION ALL SELECT query_id, item_idx, score * (1.0::DOUBLE / 3.0) FROM cross_top) GROUP BY 1, 2) s
ON s.query_id = c.query_id AND s.item_idx = c.item_idx"""


def _register_mix(method: str, combine: str) -> None:
    part(f"mix_{method}", "cands dense_top cross_top", _mix(combine))

    @query(f"r17_rankers_{method}", sql(f"mix_{method}", top(f"mix_{method}", 10)))
    def r17(spark, d):
        v = V.Shared(spark, d)
        queries = settle(candidate_lists(v.tests, v.vectors, V.K_CANDS))
        # All rankers score the features as they are made, and only what can be among a ranker's best is written.
        rankers = {"dense": first, "cross": cross}
        best = settle(S.best_scored(features(spark, d, queries, v), rankers, 10))
        of = lambda name: best.where(F.col(name).isNotNull()).select("query_id", "item_idx", F.col(name).alias("score"))
        ranked = {name: R.rerank(of(name), 10) for name in rankers}
        return R.mix_rankers(queries, ranked, 10, {"dense": 2.0, "cross": 1.0}, method)


for _method, _combine in (("average", "avg"), ("max", "max"), ("min", "min")):
    _register_mix(_method, _combine)


@query("r18_top_scores", sql("cross_scores", top("cross_scores", 5)))
def r18(spark, d):
    return _reranked(spark, d, cross, 5)


@query("v12_recall_from_scores", sql("dense_scores", f"""
SELECT round(avg(hit), 6) AS recall FROM (SELECT query_id, max(label) AS hit FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_idx) AS rank FROM dense_scores) WHERE rank <= 10 GROUP BY 1)"""))
def v12(spark, d):
    return recall_from_scores(_scored(spark, d, first), 10).select(*V.six("recall"))
