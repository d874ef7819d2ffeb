"""Nearest vectors: exact blocks against all pairs, and the recall of the index."""

import os

import numpy as np
import pytest

from geosweep.operators import vectors

BASE, QUERY = "id long, vector array<float>", "query_id long, query array<float>"
SF = "/root/testdata/sf0.1"


def brute(x, ids, k, above):
    unit = np.nan_to_num(x / np.linalg.norm(x, axis=1, keepdims=True))
    s = np.round(unit @ unit.T, 12)
    np.fill_diagonal(s, -np.inf)
    out = {}
    for i, line in enumerate(s):
        order = sorted((j for j in range(len(ids)) if line[j] > above), key=lambda j: (-line[j], ids[j]))[:k]
        out[ids[i]] = [ids[j] for j in order]
    return out


@pytest.mark.parametrize("block", [8192, 7])
def test_exact_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", max(3, block // 2))
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (60, 4)).astype(float)  # ties, copies and zeros
    ids = [int(i) for i in rng.permutation(1000)[:60]]
    base = spark.createDataFrame([*((i, [float(v) for v in row]) for i, row in zip(ids, x, strict=True)), (5000, None), (5001, [1.0]), (5002, [float("nan")] * 4)], BASE)
    got = {}
    for r in vectors.cosine_top_k(base.where("id < 5000").selectExpr("id AS query_id", "vector AS query"), base, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    want = {i: v for i, v in brute(x, ids, 5, 0.0).items() if v}
    assert {i: [d for _, d in sorted(v)] for i, v in got.items()} == want


def test_index_of_everything_is_exact(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8))
    base = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], BASE)
    index = vectors.VectorIndex(base, lists=9)
    assert index.lists.count() == 300 and index.lists.select("key").distinct().count() <= 9
    got = {(r["query_id"], r["id"]) for r in index.search(base.selectExpr("id AS query_id", "vector AS query"), 3, exact=True).collect()}
    f32 = x.astype(np.float32).astype(float)
    assert got == {(i, d) for i, v in brute(f32, list(range(300)), 3, -np.inf).items() for d in v}


def test_empty_index(spark):
    empty = spark.createDataFrame([], BASE)
    assert vectors.VectorIndex(empty).search(spark.createDataFrame([(1, [1.0])], QUERY), 3).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_recall_of_the_index(spark):
    """Of the ten nearest of the stated queries among all rows, the share that the probed lists hold."""
    import __spark_entry__ as entry

    exact = {(r["query_id"], r["id"]) for r in entry.queries()["vector_top_k"](spark, SF).collect()}
    found = {(r["query_id"], r["id"]) for r in entry.queries()["vector_index_top_k"](spark, SF).collect()}
    assert len(exact) >= 300 and len(exact & found) / len(exact) >= 0.9
