"""Problem 6 against brute force."""

import numpy as np
import pytest

from kelvara.llm import neighbours

D = 16


def frame(spark, vectors, extra=()):
    rows = [(i, [float(x) for x in v], "x") for i, v in vectors] + [(i, v, "x") for i, v in extra]
    return spark.createDataFrame(rows, "vec_id bigint, vec array<float>, rank string").repartition(3)


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, D))
    return centre[rng.integers(0, 6, n)] + rng.normal(scale=0.25, size=(n, D))


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 128)
    monkeypatch.setattr(neighbours, "CELL_ROWS", 60)


ODD = [(9001, None), (9002, [0.0] * D), (9003, [float("nan")] * D), (9004, [1.0]), (9005, [float("inf")] + [1.0] * (D - 1)), (9006, [None] + [1.0] * (D - 1))]


def test_pairs_are_exact(spark):
    x = clustered(500)
    x[100:140] = x[0] * np.linspace(0.5, 3, 40)[:, None]  # one vector at many lengths
    x[200] = x[201]
    df = frame(spark, list(enumerate(x)), ODD)
    u = np.array(x, np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    want = {(i, j) for i in range(500) for j in range(i + 1, 500) if s[i, j] >= 0.95}
    close = {(i, j) for i in range(500) for j in range(i + 1, 500) if abs(s[i, j] - 0.95) < 1e-6}
    got = {(r.vec_lo, r.vec_hi) for r in neighbours.pairs_above(df, dims=D).collect()}
    assert got - close == want - close
    assert (200, 201) in got and (100, 139) in got


def test_nearest_recall_and_ties(spark):
    x = clustered(400, 3)
    x[50:70] = x[50]
    df = frame(spark, list(enumerate(x)), ODD)
    u = np.array(x, np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    rows = neighbours.nearest(df, k=5, probes=4, dims=D).collect()
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, []).append((r["rank"], r.neighbour_id, r.cosine))
    assert set(by) == set(range(400)) and all(len(v) == 5 for v in by.values())
    kth = -np.sort(-s, axis=1)[:, 4]
    assert np.mean([c >= kth[i] - 1e-6 for i, v in by.items() for _, _, c in v]) >= 0.9
    assert all(i not in [n for _, n, _ in v] for i, v in by.items())
    # among equal vectors the smaller ids come first
    assert [n for _, n, _ in sorted(by[69])] == [50, 51, 52, 53, 54] and [n for _, n, _ in sorted(by[50])] == [51, 52, 53, 54, 55]


def test_few_and_no_vectors(spark):
    df = frame(spark, [(1, np.eye(D)[0]), (2, np.eye(D)[1]), (2, np.eye(D)[1])])
    got = {(r.vec_id, r.neighbour_id) for r in neighbours.nearest(df, dims=D).collect()}
    assert got == {(1, 2), (2, 1)}
    assert neighbours.pairs_above(df, dims=D).count() == 0
    empty = frame(spark, [(1, np.eye(D)[0])]).limit(0)
    assert neighbours.nearest(empty, dims=D).count() == 0 and neighbours.pairs_above(empty, dims=D).count() == 0
    only_odd = spark.createDataFrame([(i, v, "x") for i, v in ODD], "vec_id bigint, vec array<float>, rank string")
    assert neighbours.pairs_above(only_odd, dims=D).count() == 0


@pytest.mark.parametrize("most", [4, 1024])
def test_cells_from_two_codebooks(spark, monkeypatch, most):
    monkeypatch.setattr(neighbours, "MOST_CENTROIDS", most)
    monkeypatch.setattr(neighbours, "HOT_CELLS", 1)
    monkeypatch.setattr(neighbours, "CLASS_BLOCK", 8)
    x = clustered(600, 7)
    x[100:140] = x[0]
    df = frame(spark, list(enumerate(x)), ODD)
    u = np.array(x, np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    want = {(i, j) for i in range(600) for j in range(i + 1, 600) if s[i, j] >= 0.95}
    close = {(i, j) for i, j in want if abs(s[i, j] - 0.95) < 1e-6}
    got = {(r.vec_lo, r.vec_hi) for r in neighbours.pairs_above(df, dims=D).collect()}
    assert got - close == want - close
    classes = {r.vec_id: (r.class_id, r.class_size) for r in neighbours.classes_above(df, dims=D).collect()}
    assert len(classes) == 600 and all(classes[i] == (0, 41) for i in (0, 100, 139)) and classes[1] == (1, 1)
    np.fill_diagonal(s, -2)
    kth = -np.sort(-s, axis=1)[:, 4]
    rows = neighbours.nearest(df, k=5, dims=D).collect()
    assert len(rows) == 3000 and np.mean([r.cosine >= kth[r.vec_id] - 1e-6 for r in rows]) >= 0.9


def test_int8_bound_holds():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, D)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    row = {"ids": np.arange(200, dtype=np.int64).tobytes(), "codes": codes.tobytes(), "scale": scale.astype(np.float32).tobytes(), "err": np.linalg.norm(x - codes * scale[:, None], axis=1).astype(np.float32).tobytes()}
    side = neighbours._Side(row, D)
    approx, bound = neighbours._tile(side, side)
    assert (np.abs(approx - x.astype(np.float64) @ x.T.astype(np.float64)) <= bound).all()
