from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reportloom.operators import retrieval, vectors as vx


def _plain(ids, x, query_ids, q, k, threshold):
    def unit(m):
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    scores = np.round(unit(q) @ unit(x).T, 6)
    out = set()
    for i, row in zip(query_ids, scores, strict=True):
        hits = sorted((-s, v) for s, v in zip(row, ids, strict=True) if s >= threshold)[:k]
        out |= {(i, v, -s, r) for r, (s, v) in enumerate(hits, 1)}
    return out


def _frame(spark, ids, x, names):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], f"{names} long, embedding array<double>")


@pytest.mark.parametrize("spread, k, threshold", [(0.05, 7, 0.2), (0.5, 20, 0.5), (5.0, 3, -1.0), (0.05, 2000, 0.9)])
def test_index_equals_brute_force(spark, monkeypatch, spread, k, threshold):
    monkeypatch.setattr(vx, "BLOCK_ROWS", 40)
    if k == 20:
        monkeypatch.setattr(retrieval._search, "__defaults__", (500, 90))
    rnd = np.random.default_rng(int(spread * 100))
    centres = rnd.normal(size=(12, 16))
    x = np.concatenate([c + spread * rnd.normal(size=(80, 16)) for c in centres] + [np.repeat(centres[:1], 300, axis=0)])
    ids = rnd.permutation(len(x)) * 3
    q = np.concatenate([x[::150], rnd.normal(size=(4, 16)), -centres[:1]])
    vectors = _frame(spark, ids, x, "vec_id").unionByName(
        spark.createDataFrame([(-1, None), (-2, [0.0] * 16), (-3, [float("nan")] * 16)], "vec_id long, embedding array<double>")
    )
    queries = _frame(spark, range(len(q)), q, "query_id").unionByName(spark.createDataFrame([(99, [0.0] * 16)], "query_id long, embedding array<double>"))
    index = vx.build_index(vectors.withColumn("cell", F.lit("x")), sample_rows=500)
    assert index.cells.sizes.sum() == len(x) and len(index.cells.centroids) == int(np.sqrt(len(x)) / 2)
    assert index.vectors.groupBy("cell", "block").count().agg(F.max("count")).first()[0] <= 3 * 40  # the equal 300 too
    found = vx.index_top_k(index, queries, k, threshold)
    assert {tuple(r) for r in found.collect()} == _plain(ids, x, range(len(q)), q, k, threshold)
    if spread == 0.05 and k == 7:
        seen = vx.cells_visited(index, queries, found, k, threshold).agg(F.avg("share")).first()[0]
        assert seen < 0.5  # clustered vectors: most cells are ruled out


def test_index_of_nothing_and_of_one(spark):
    ddl = "vec_id long, embedding array<double>"
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert vx.index_top_k(vx.build_index(spark.createDataFrame([], ddl)), queries).collect() == []
    one = vx.build_index(spark.createDataFrame([(5, [2.0, 0.0])], ddl))
    assert [tuple(r) for r in vx.index_top_k(one, queries).collect()] == [(1, 5, 1.0, 1)]
    assert vx.index_top_k(one, queries.limit(0)).collect() == []


def test_blocks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 10)
    monkeypatch.setattr(retrieval._search, "__defaults__", (64, 12))
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(95, 4))
    got = retrieval.vector_top_k(_frame(spark, range(95), x, "vec_id"), _frame(spark, range(3), x[:3], "query_id"), 5, 0.0)
    assert {tuple(r) for r in got.select("query_id", "vec_id", "score", "rank").collect()} == _plain(range(95), x, range(3), x[:3], 5, 0.0)


def test_cells_to_visit_come_in_bounded_pieces():
    """a batch of queries does not hand on all its cells at once."""
    rnd = np.random.default_rng(2)
    cells = vx.Cells(vx._unit_rows(rnd.normal(size=(20, 4))), np.full(20, 5), np.full(20, np.pi))
    asked = pd.DataFrame({"query_id": range(50), "vec": list(rnd.normal(size=(50, 4))), "floor": 0.0})
    pieces = list(vx._ask(cells, 5, -1.0, True, most=20 * 4 * 3)(iter([asked])))
    assert max(map(len, pieces)) <= 20 * 3
    whole = pd.concat(pieces)
    assert len(whole) == 50 * 19 and not whole.duplicated(["query_id", "cell"]).any()


def test_queries_are_dealt_in_groups(spark, monkeypatch):
    """a task meets a bounded number of queries, however many there are, and sorts no hits before the shuffle."""
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 10)
    monkeypatch.setattr(retrieval, "HIT_ROWS", 50)
    seen, search = [], retrieval.search_blocks
    monkeypatch.setattr(retrieval, "search_blocks", lambda rows, *a: seen.append(rows) or search(rows, *a))
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(95, 4))
    got = retrieval.vector_top_k(_frame(spark, range(95), x, "vec_id"), _frame(spark, range(80), x[:80], "query_id"), 5, 0.0)
    assert {tuple(r) for r in got.select("query_id", "vec_id", "score", "rank").collect()} == _plain(range(95), x, range(80), x[:80], 5, 0.0)
    assert seen[0].groupBy("block", "is_query").count().agg(F.max("count")).first()[0] <= 3 * 10
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("WindowGroupLimit") == plan.split("REPARTITION_BY_NUM")[0].count("WindowGroupLimit")
