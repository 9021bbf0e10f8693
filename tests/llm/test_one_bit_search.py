"""Nearest neighbours against brute force: results, recall, bounds, hot cells, odd input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallspark.llm import one_bit_search as search

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score double"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 0, 0.0) for i, v in rows], SCHEMA).repartition(4)


def brute(rows, wanted, k):
    """{(query id, its vector): [(vec_id, score)]}, by double sums over the components."""
    found = {}
    held = {(i, tuple(np.float32(x) for x in v)) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)}
    for i, v in held:
        if not wanted(i):
            continue
        scored = []
        for j, u in held:
            if (j, u) != (i, v) and len(u) == len(v):
                total = 0.0
                for a, b in zip(u, v):
                    total += float(a) * float(b)
                scored.append((-total, j))
        found[i, v] = [(j, -s) for s, j in sorted(scored)[:k]]
    return found


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def unit(rng, n, d=64):
    v = rng.standard_normal((n, d))
    return v / np.linalg.norm(v, axis=1)[:, None]


def recall(found, truth):
    return np.mean([len({j for j, _ in found.get(i, [])} & {j for j, _ in near}) / max(len(near), 1) for (i, _), near in truth.items()])


@pytest.mark.parametrize("kind", ["random", "clusters", "lengths", "odd size"])
def test_against_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    v = unit(rng, 1500, 50 if kind == "odd size" else 64)
    if kind == "clusters":
        v[500:] = v[rng.integers(0, 20, 1000)] + 0.02 * rng.standard_normal((1000, 64))
    if kind == "lengths":
        v *= rng.lognormal(0, 1, 1500)[:, None]
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(v, 1)]
    truth = brute(rows, lambda i: i % 20 == 0, 20)
    found = by_query(search.search(table(spark, rows), F.col("vec_id") % 20 == 0))
    assert set(found) == {i for i, _ in truth} and recall(found, truth) >= 0.99
    for (i, _), near in truth.items():
        scores = dict(near)
        assert len(found[i]) == 20 and all(scores.get(j, s) == s for j, s in found[i])
        assert found[i] == sorted(found[i], key=lambda x: (-x[1], x[0]))


def test_cells_blocks_and_shares(spark, monkeypatch):
    """Many cells, of which only some are visited; a third of the rows in one tight group, more than one block of it."""
    monkeypatch.setattr(search, "CELL", 60)
    monkeypatch.setattr(search, "BLOCK", 100)
    monkeypatch.setattr(search, "SHARE", 10)
    monkeypatch.setattr(search, "SIDE_BYTES", 90 * 64 * 8)
    rng = np.random.default_rng(2)
    centres = unit(rng, 30)
    v = centres[rng.integers(0, 30, 3000)] + 0.05 * rng.standard_normal((3000, 64))
    v[:1000] = centres[0] + 0.01 * rng.standard_normal((1000, 64))
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(v, 1)]
    truth = brute(rows, lambda i: i % 20 == 0, 20)
    visited = {}
    calibrate = search.calibrate
    monkeypatch.setattr(search, "calibrate", lambda *a: visited.setdefault("most", calibrate(*a)))
    found = by_query(search.search(table(spark, rows), F.col("vec_id") % 20 == 0))
    assert visited["most"][64] < 50 and recall(found, truth) >= 0.97


def test_equal_vectors_and_ties(spark):
    rng = np.random.default_rng(3)
    a, b = unit(rng, 2)
    # 60 copies of one vector, of which the smallest ids win; repeated rows; one id on two vectors.
    rows = [(i, a.tolist()) for i in range(1, 61)] + [(i, b.tolist()) for i in range(100, 110)]
    rows += [(20, a.tolist()), (40, b.tolist()), (300, [0.0, 1.0]), (320, [0.0, -1.0]), (340, [-0.0, 1.0])]
    truth = brute(rows, lambda i: i % 20 == 0, 5)
    found = by_query(search.search(table(spark, rows), F.col("vec_id") % 20 == 0, k=5))
    for (i, v), near in truth.items():
        if i != 40:
            assert found[i] == near
    assert found[20][:2] == [(1, found[20][0][1]), (2, found[20][0][1])]
    # Both vectors of one id ask, and each is a neighbour of the other.
    both = sorted(x for (i, _), near in truth.items() if i == 40 for x in near)
    assert sorted(found[40]) == both
    assert [j for j, _ in found[300]] == [340, 320]


def test_odd_rows(spark):
    good = [(20, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [-1.0, 0.0])]
    odd = [(None, [1.0, 1.0]), (40, None), (60, []), (80, [0.0, 0.0]), (100, [1.0, None]), (120, [float("nan"), 1.0]),
           (140, [float("inf"), 1.0]), (160, [1.0, 2.0, 3.0])]
    found = by_query(search.search(table(spark, good + odd), F.col("vec_id") % 20 == 0))
    assert found == {20: [(2, 0.5), (3, -1.0)]}
    assert search.search(table(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    assert search.search(table(spark, odd), F.col("vec_id") % 20 == 0).collect() == []


def test_bounds_hold():
    """Estimates are off by more than the bound about as seldom as three deviations say."""
    rng = np.random.default_rng(5)
    v = unit(rng, 4000)
    space = search.Space(0, v.mean(axis=0)[None, :], np.ones(1))
    code, length, overlap = search.encode(v - space.centroids[0], space.rotation)
    block = search.Block(v, code, length, overlap, space, 0)
    off = []
    for q in unit(rng, 20):
        estimate, error = block.estimates(q)
        off.append(np.mean(np.abs(estimate - v @ q) > error))
    assert np.mean(off) < 0.006 and code.shape == (4000, 1)
