import numpy as np
import pytest
from palimpsest.llm import curves
from pyspark.sql import functions as F


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[ids == ids[q]] = np.inf
        o = np.lexsort((ids, d))[:k]
        out[int(ids[q])] = [(int(ids[i]), float(d[i])) for i in o if np.isfinite(d[i])]
    return out


def test_hilbert_keys_walk_the_grid():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 2), -1).reshape(-1, 2)
    order = cells[np.argsort(curves.hilbert_keys(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()
    cells = np.stack(np.meshgrid(*[np.arange(4)] * 3), -1).reshape(-1, 3)
    keys = curves.hilbert_keys(cells, 2)
    assert sorted(keys.tolist()) == list(range(64)) and (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("clustered", [False, True])
def test_recall(spark, clustered):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 32)) * (0.2 if clustered else 1) + (rng.normal(size=(40, 32))[rng.integers(0, 40, 6000)] if clustered else 0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in curves.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(np.arange(6000), x, range(0, 6000, 100), 10)
    assert all(len(v) == 10 for v in got.values()) and len(got) == 60
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 10 for q in want]) >= 0.9
    for q, v in got.items():
        assert all(s == pytest.approx(np.sqrt(((x[q] - x[a]) ** 2).sum()), abs=1e-12) for a, s in v)


def test_odd_vectors_ties_and_copies(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, float(i % 3)]) for i in range(30)] + [(100, None), (200, [0.0, 0.0]), (300, [nan, 1.0]), (400, [inf, 1.0]), (500, [None, 1.0]), (600, [1.0]), (None, [1.0, 2.0]), (700, [1.0, 0.0]), (700, [1.0, 0.0])]
    out = curves.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in out} == {0, 700}
    assert [r.vec_id for r in out if r.query_id == 0] == [3, 6, 9, 12, 15, 18, 21, 24, 27, 700]
    assert [r.vec_id for r in out if r.query_id == 700] == [0, 3, 6, 9, 12, 15, 18, 21, 24, 27]
    assert curves.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in curves.search(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1.0)]


def test_one_common_vector(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(9000, 8))
    x[:6000] = 1.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = curves.search(df, F.col("vec_id") == 5000).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in out] == [(i, 0.0) for i in range(10)]


def test_windows_follow_the_structure(spark):
    """Clustered vectors need a small part of the table, and are found; every row is a candidate."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12_000, 24)) * 0.1 + rng.normal(size=(600, 24))[rng.integers(0, 600, 12_000)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    seen = []
    fit, curves.fit_window = curves.fit_window, lambda *a: seen.append(fit(*a)) or seen[-1]
    try:
        got = {}
        for r in curves.search(df, F.col("vec_id") % 100 == 0).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
    finally:
        curves.fit_window = fit
    assert 2 * seen[0] * curves.CURVES < 0.6 * len(x)
    want = brute(np.arange(len(x)), x, range(0, len(x), 100), 10)
    assert np.mean([len(got[q] & {a for a, _ in want[q]}) / 10 for q in want]) >= 0.9


@pytest.mark.parametrize("shape", ["stray of a small table", "stray", "tight clusters", "two scales"])
def test_recall_whatever_the_scale(spark, shape):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900 if "small" in shape else 4000, 24))
    if "stray" in shape:
        x[7] = np.arange(24) == 3
        x[7] *= 1e30
    elif shape == "two scales":
        x[::2] *= 1e6
    else:
        x = x * 0.001 + rng.normal(size=(10, 24))[rng.integers(0, 10, len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in curves.search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(np.arange(len(x)), x, range(0, len(x), 100), 10)
    assert np.mean([len(got[q] & {a for a, _ in want[q]}) / 10 for q in want]) >= 0.9


def test_ties_of_many_vectors(spark):
    """In a table that is searched whole, the least ids of those at the tenth distance are returned."""
    x = np.random.default_rng(6).integers(0, 2, (900, 16)) + 1.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in curves.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute(np.arange(900), x, range(0, 900, 100), 10)
