"""Nearest vectors by the tree against distances to all rows."""
import math

import numpy as np
import pytest

from terralith.llm import kmeans_tree as kt
from terralith.llm.queries import op11_nearest_vectors


def exact(rows, queries, k):
    """(query_id, rank, vec_id, score) by brute force; rows and queries are distinct (id, vector as tuple)."""
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], dtype=float)
    out = set()
    for i, v in queries:
        far = np.sqrt(np.square(vectors - np.array(v, dtype=float)).sum(axis=1))
        near = [(d, j) for d, j, w in zip(far.tolist(), ids.tolist(), (w for _, w in rows)) if (j, w) != (i, v)]
        out |= {(i, r, j, d) for r, (d, j) in enumerate(sorted(near)[:k], 1)}
    return out


def found(df):
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    rows = [(r.vec_id, tuple(r.embedding)) for r in
            spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    want = exact(rows, [r for r in rows if r[0] % 100 == 0], 10)
    got = found(op11_nearest_vectors(spark, f"/root/testdata/{sf}"))
    hits = {(q, i) for q, _, i, _ in want} & {(q, i) for q, _, i, _ in got}
    assert len(got) == len(want) and len(hits) >= 0.9 * len(want)
    scores = {(q, i): d for q, _, i, d in want}
    assert all(math.isclose(d, scores[q, i], rel_tol=1e-12) for q, _, i, d in got if (q, i) in scores)


def test_all_leaves_give_the_exact_answer(spark):
    """With every leaf visited, many small blocks and many copies, ties and self-exclusion come out exactly."""
    rng = np.random.default_rng(3)
    points = rng.integers(-3, 4, (400, 3)).astype(float)
    rows = [(i, tuple(p)) for i, p in enumerate(points.tolist()) if any(p)]
    rows += [(1000 + i, (1.0, 1.0, 1.0)) for i in range(300)]       # one hot vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    small = dict(sample_rows=300, branches=3, leaf_rows=5, wanted=1.0)
    got = kt.search(df, df.where("vec_id % 7 = 0"), k=10, **small)
    want = exact(rows, [r for r in rows if r[0] % 7 == 0], 10)
    assert {(q, r, i, round(d, 9)) for q, r, i, d in found(got)} == {(q, r, i, round(d, 9)) for q, r, i, d in want}
    assert got.count() == len(want)


def test_blocks_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(kt, "BLOCK_ROWS", 7)
    monkeypatch.setattr(kt, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(4)
    rows = [(i, tuple(p)) for i, p in enumerate(rng.normal(size=(300, 4)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = kt.search(df, df, k=5, sample_rows=200, branches=4, leaf_rows=20, wanted=1.0)
    hits = {(q, i) for q, _, i, _ in found(got)} & {(q, i) for q, _, i, _ in exact(rows, rows, 5)}
    assert len(hits) >= 0.99 * 1500 and got.count() == 1500


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [2.0, 0.0]), (1, None), (2, [0.0, -0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]),
            (5, [None, 1.0]), (6, []), (7, [1.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0]), (100, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows],
                               "vec_id long, embedding array<float>, ids int, leaf string, score double")
    got = found(kt.search(df, df.where("vec_id % 100 = 0"), k=10))
    kept = [(0, (1.0, 0.0)), (0, (2.0, 0.0)), (8, (1.0, 2.0)), (100, (1.0, 0.0))]
    assert got == exact(kept, [r for r in kept if r[0] % 100 == 0], 10)
    assert kt.search(df.limit(0), df, k=3).count() == 0
    assert kt.search(df.where("vec_id = 8"), df.where("vec_id = 8"), k=3).count() == 0
    assert kt.search(df, df.limit(0), k=3).count() == 0


def test_best_bin_first_visits_every_leaf_once():
    rng = np.random.default_rng(5)
    tree = kt.grow(rng.normal(size=(2000, 8)))
    order = tree.visits(rng.normal(size=8), tree.leaves)
    assert sorted(order) == list(range(tree.leaves)) and tree.leaves > 8
    assert kt.grow(np.ones((500, 8))).leaves == 1 and kt.grow(np.empty((0, 3))).leaves == 1
