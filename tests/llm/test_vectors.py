"""Similar vectors over many blocks: against all pairs, and what is shuffled and stored for them."""
from __future__ import annotations

import numpy as np
import pytest

from shopaudit.llm import vectors


def plain(rows, cosine):
    """(id, links, smallest id in reach) of every row, by all pairs; rows without a usable vector link with nothing."""
    points = vectors.unit([v for _, v in rows])
    near = points @ points.T >= cosine
    low = np.array([i for i, _ in rows], dtype=object)
    while True:
        least = np.array([min(low[np.flatnonzero(n)]) for n in near], dtype=object)
        if (least == low).all():
            return sorted((i, int(n.sum()) - 1, m) for (i, _), n, m in zip(rows, near, low))
        low = least


def groups(n, width, centres, noise, seed):
    random = np.random.default_rng(seed)
    points = random.normal(size=(centres, width))[random.integers(0, centres, n)] + noise * random.normal(size=(n, width))
    return points.astype(np.float32).astype(float).tolist()


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 48)
    monkeypatch.setattr(vectors, "LIMIT", 60)


def found(df, cosine=0.9):
    return sorted((r["vector_id"], r["n_links"], r["component_id"]) for r in vectors.similar_vectors(df, cosine).collect())


def test_vectors_are_shuffled_and_stored_once(spark, monkeypatch, small_blocks):
    plans = {}
    stored = vectors.stored

    def seen(df, name):
        plans[name] = (df._jdf.queryExecution().executedPlan().toString(), [t for _, t in df.dtypes])
        return stored(df, name)

    monkeypatch.setattr(vectors, "stored", seen)
    rows = list(enumerate(groups(400, 16, 400, 0.0, 1)))
    assert found(spark.createDataFrame(rows, "vector_id long, vector array<float>")) == plain(rows, 0.9)
    # Pairs of blocks read the stored blocks; a shuffle would carry both blocks for every pair.
    assert "Exchange" not in plans["met"][0]
    assert [n for n, (_, kinds) in plans.items() if any(k in ("binary", "array<float>", "array<double>", "array<binary>") for k in kinds)] == ["blocks"]


def test_many_blocks_against_all_pairs(spark, small_blocks):
    points = groups(150, 8, 25, 0.3, 2)
    copies = [points[k] for k in np.random.default_rng(3).integers(0, 150, 500)]
    rows = [(k % 400, v) for k, v in enumerate(copies + [copies[0]] * 300)]
    assert found(spark.createDataFrame(rows, "vector_id long, vector array<float>")) == plain(rows, 0.9)
    rows = [(f"v{k:03d}", v) for k, v in enumerate(groups(200, 6, 3, 0.003, 4))]
    assert found(spark.createDataFrame(rows, "vector_id string, vector array<double>"), 0.99) == plain(rows, 0.99)
    # Angles at multiples of a fortieth of the limit: single precision can't decide them.
    turns = np.random.default_rng(5).choice(np.arange(0, 6.28, np.arccos(0.9) / 40), 300)
    rows = [(k, np.array([np.cos(t), np.sin(t)]).astype(np.float32).astype(float).tolist()) for k, t in enumerate(turns)]
    assert found(spark.createDataFrame(rows, "vector_id int, vector array<float>")) == plain(rows, 0.9)


def test_packed_trees_and_sums():
    points = vectors.unit(groups(300, 5, 6, 0.1, 6))
    _, nodes = vectors.cover_tree(points)
    first, radii = vectors.packed_tree(nodes)
    for level, again in zip(nodes, vectors.unpacked_tree(np.frombuffer(first, np.uint8), np.frombuffer(radii)), strict=True):
        for name in ("start", "stop", "centre", "radius", "parent"):
            assert (level[name] == again[name]).all()
    sums = vectors.together(np.array([7, 3, 5, 3, 9]), np.array([1, 2, 1, 4, 1]), np.array([5, 3, 5, 2, 9]))
    assert [x.tolist() for x in sums] == [[3, 5, 7, 9], [6, 1, 1, 1], [2, 5, 5, 9]]
