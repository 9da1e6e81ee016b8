"""Exact top-k and similarity joins against brute force, with odd vectors and small blocks."""

import numpy as np
import pytest

from skerry.operators import ranking


def unit(v):
    v = None if v is None else np.array(v, float)
    return None if v is None or not np.any(v) else v / np.linalg.norm(v)


def scores(documents, leaves):
    out = {}
    for d, v in documents:
        for c, w in leaves:
            a, b = unit(v), unit(w)
            out[d, c] = None if a is None or b is None else round(float(a @ b), 6)
    return out


@pytest.fixture
def data():
    rng = np.random.default_rng(8)
    leaves = [(i, rng.standard_normal(8).tolist()) for i in range(300)]
    leaves += [(300 + i, leaves[i][1]) for i in range(20)] + [(400, [0.0] * 8), (401, None)]
    documents = [(i, rng.standard_normal(8).tolist()) for i in range(50)] + [(50, leaves[3][1]), (51, [0.0] * 8), (52, None)]
    return documents, leaves


@pytest.mark.parametrize("block", [7, 64, 4096])
@pytest.mark.parametrize("size", [1, 5, 320, 1000])
def test_pool_keeps_the_nearest_with_ties_by_id(spark, monkeypatch, data, block, size):
    documents, leaves = data
    monkeypatch.setattr(ranking, "ROWS", 16)
    d = spark.createDataFrame(documents, "document_id long, vector array<double>")
    w = spark.createDataFrame(leaves, "concept_id int, leaf_vector array<double>").repartition(3)
    monkeypatch.setattr(ranking, "BLOCK", block)
    found = ranking.pool(d, w, size)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r.document_id, []).append((r.rank, r.concept_id, r.score))
    told = scores(documents, leaves)
    for doc, _ in documents:
        order = sorted((c for c, _ in leaves), key=lambda c: (told[doc, c] is None, -(told[doc, c] or 0.0), c))[:size]
        assert sorted(got[doc]) == [(i + 1, c, told[doc, c]) for i, c in enumerate(order)]


def test_similar_keeps_all_that_are_alike(spark, data):
    documents, leaves = data
    d = spark.createDataFrame(documents, "document_id long, vector array<double>")
    w = spark.createDataFrame(leaves, "concept_id int, leaf_vector array<double>")
    want = {(a, b): s for (a, b), s in scores(documents, leaves).items() if s is not None and s >= 0.45}
    assert {(r.document_id, r.concept_id): r.score for r in ranking.similar(d, w, 0.45).collect()} == want
    assert ranking.pool(d.where("false"), w, 3).count() == ranking.pool(d, w.where("false"), 3).count() == 0


@pytest.mark.parametrize(("threshold", "cell"), [(0.92, 4096), (0.92, 40), (0.4, 100), (-1.0, 200)])
def test_near_pairs_agree_with_all_pairs(spark, monkeypatch, threshold, cell):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((12, 24))
    rows = [(i, (centres[i % 12] + 0.25 * rng.standard_normal(24)).tolist()) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(30)] + [(900, None), (901, [0.0] * 24)]
    monkeypatch.setattr(ranking, "CELL", cell)
    vectors = spark.createDataFrame(rows, "concept_id int, vector array<float>")
    known = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and any(v)]
    x = np.array([v / np.linalg.norm(v) for _, v in known])
    s = np.round(x @ x.T, 6)
    want = {(known[i][0], known[j][0]): s[i, j] for i in range(len(known)) for j in range(i + 1, len(known)) if s[i, j] >= threshold}
    got = {(r.a, r.b): r.score for r in ranking.near_pairs(vectors, threshold).collect()}
    assert got == want and ranking.near_pairs(vectors, threshold).count() == len(want)
    share = ranking.near_pairs(vectors, threshold, counts=True).first()
    assert share.pairs == 430 * 429 // 2 and share.found == len(want) <= share.compared <= share.met <= share.pairs
    if threshold == 0.92:
        assert share.compared < 0.1 * share.pairs
    assert ranking.near_pairs(vectors.where("false"), threshold).count() == 0


def test_few_pairs_of_the_tables_vectors_are_compared(spark):
    from pathlib import Path

    folder = Path("/root/testdata/sf0.1/embeddings.parquet")
    if not folder.exists():
        pytest.skip("the driver's tables aren't here")
    vectors = spark.read.parquet(str(folder)).selectExpr("vec_id AS concept_id", "embedding AS vector")
    share = ranking.near_pairs(vectors, 0.92, counts=True).first()
    assert share.compared < 0.1 * share.pairs, share
