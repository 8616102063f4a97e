"""The neighbor graph: recall against all pairs, islands, hubs and small tables."""

import numpy as np
import pyarrow as pa
import pytest

from basketflow.operators import retrieval as R
from basketflow.operators.graph import NeighborGraph, nearest_by_graph


def frame(spark, vectors, name="item_idx"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], f"{name} long, vector array<double>")


def exact(vectors, queries, k):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8)
    scores = np.round(unit(queries) @ unit(vectors).T, 9)
    return [np.lexsort((np.arange(len(vectors)), -row))[:k].tolist() for row in scores], scores


def test_recall_and_scores(spark):
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(700, 24))
    vectors[:250] = vectors[0] + 0.2 * draw.normal(size=(250, 24))  # a crowd that a third of all belong to
    queries = draw.normal(size=(40, 24))
    graph = NeighborGraph.build(frame(spark, vectors))
    assert graph.changes[-1] < 0.01 and all(b < a for a, b in zip(graph.changes, graph.changes[1:], strict=False))
    rows = nearest_by_graph(frame(spark, queries, "query_id"), graph, 10).collect()
    best, scores = exact(vectors, queries, 10)
    found = {q: [r for r in sorted(rows, key=lambda r: r.rank) if r.query_id == q] for q in range(40)}
    assert all([r.rank for r in found[q]] == list(range(1, 11)) for q in found)
    assert all(abs(r.score - scores[q, r.item_idx]) < 1e-8 for q in found for r in found[q])
    assert np.mean([len(set(best[q]) & {r.item_idx for r in found[q]}) / 10 for q in found]) >= 0.9


def test_edges_are_near_to_exact_neighbors(spark):
    vectors = np.random.default_rng(4).normal(size=(400, 16))
    graph = NeighborGraph.build(frame(spark, vectors), degree=10)
    rows = graph.edges.collect()
    _, scores = exact(vectors, vectors, 11)
    np.fill_diagonal(scores, -2)
    want = {i: set(np.argsort(-scores[i], kind="stable")[:10].tolist()) for i in range(400)}
    assert len(rows) == 4000 and all(r.id != r.near for r in rows)
    assert sum(r.near in want[r.id] for r in rows) >= 0.9 * len(rows)


def test_islands_and_short_tables_give_full_lists(spark, tmp_path):
    """Two far groups: a search that begins in neither finds full lists all the same; so does one over three items."""
    draw = np.random.default_rng(5)
    one, two = np.eye(8)[0] + 0.01 * draw.normal(size=(30, 8)), np.eye(8)[1] + 0.01 * draw.normal(size=(6, 8))
    vectors = np.concatenate([one, two])
    graph = NeighborGraph.build(frame(spark, vectors), degree=4)
    graph.write(str(tmp_path / "graph"))
    graph = NeighborGraph.read(spark, str(tmp_path / "graph"))
    rows = nearest_by_graph(frame(spark, vectors[-3:], "query_id"), graph, 12, width=12, entries=2).collect()
    assert sorted((r.query_id, r.rank) for r in rows) == [(q, i) for q in range(3) for i in range(1, 13)]
    few = NeighborGraph.build(frame(spark, vectors[:3]))
    assert len(nearest_by_graph(frame(spark, vectors[:2], "query_id"), few, 5).collect()) == 6
    none = NeighborGraph.build(frame(spark, vectors).where("false"))
    assert nearest_by_graph(frame(spark, vectors[:2], "query_id"), none, 5).collect() == []


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_whole_tables_leave_in_bounded_batches(metric):
    draw = np.random.default_rng(8)
    items, queries = draw.normal(size=(23, 4)), draw.normal(size=(17, 4))
    sides = [0] * 23 + [1] * 17
    columns = [pa.array([1] * 40, pa.int32()), pa.array([2] * 40, pa.int32()), pa.array(sides, pa.int32()),
               pa.array([*range(23), *range(17)], pa.int64()), pa.array([v.tolist() for v in [*items, *queries]], pa.list_(pa.float64()))]
    whole = pa.RecordBatch.from_arrays(columns, names=["qb", "ib", "side", "id", "vector"])
    found = list(R._streamed_scorer(metric, 10)(iter([whole.slice(i, 6) for i in range(0, 40, 6)])))
    assert max(b.num_rows for b in found) <= 10 and sum(b.num_rows for b in found) == 23 * 17
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {"cosine": unit(queries) @ unit(items).T, "dot": queries @ items.T,
            "l2": -np.linalg.norm(queries[:, None] - items[None], axis=2)}[metric]
    for b in found:
        for q, i, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            assert abs(x - want[q, i]) < 1e-6


def test_codes_hold_a_byte_per_coordinate_and_find_the_neighbors(spark):
    vectors = np.random.default_rng(9).normal(size=(600, 32))
    items = frame(spark, vectors)
    codes = R.coded_vectors(items)
    assert {len(r.codes) for r in codes.collect()} == {32} and codes.columns == ["item_idx", "codes", "scale"]
    rows = R.nearest_by_codes(frame(spark, vectors[:50], "query_id"), codes, items, 10).collect()
    best, scores = exact(vectors, vectors[:50], 10)
    assert all(abs(r.score - scores[r.query_id, r.item_idx]) < 1e-8 for r in rows)
    assert sum(r.item_idx in best[r.query_id] for r in rows) >= 0.9 * 500 and len(rows) == 500
