import duckdb
import numpy as np
import pytest

import corpus
from compare import difference
from recallspark.llm import embedding_dedup, sql

COLUMNS = "vec_id long, embedding array<float>, label int, unit string, size int"


def test_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(1)
    rows = []
    for label in (0, 1, None):
        centres = rng.normal(size=(30, 16))
        for c in centres:
            rows += [((c + rng.normal(size=16) * s) * rng.uniform(0.1, 9), label) for s in (0.0, 0.1, 0.25, 0.3, 0.35)]
        rows += [(centres[0], label)] * 25
    rows = [(i, np.float32(v).tolist(), label, "x", 1) for i, (v, label) in enumerate(rows)]
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    rows += [(1000 + i, v, 0, "x", 1) for i, v in enumerate(odd)]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, COLUMNS).repartition(3), recall=1.0).collect()
    usable = [(i, np.array(v, dtype=np.float64), label) for i, v, label, *_ in rows
              if label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a, b) for a, x, p in usable for b, y, q in usable
             if a != b and p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93]
    component = corpus.component_of([r[0] for r in rows], links)
    counts = {i: sum(a == i for a, _ in links) for i in component}
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found}
    assert {i: x[:2] for i, x in got.items()} == {i: (counts[i], component[i]) for i in component}
    assert got[1006] == (1, 1006, True) and got[1007] == (1, 1006, False) and got[1000] == (0, 1000, True)


def planted(rng, base, n, cosines):
    """``n`` pairs of unit vectors of given cosines, spread over 64 dimensions."""
    a = rng.normal(size=(n, base))
    a /= np.linalg.norm(a, axis=1)[:, None]
    away = rng.normal(size=(n, base))
    away -= (away * a).sum(1)[:, None] * a
    away /= np.linalg.norm(away, axis=1)[:, None]
    c = np.resize(cosines, n)[:, None]
    return a, c * a + np.sqrt(1 - c * c) * away


@pytest.mark.parametrize("hot,seed", [(0, 1), (2000, 1), (2000, 2)])
def test_links_outside_a_hot_group(spark, hot, seed):
    """Of 1,500 links between 0.9301 and 0.99 beside a tight group at most one in a thousand is missed."""
    rng = np.random.default_rng(seed)
    a, b = planted(rng, 64, 1500, np.linspace(0.9301, 0.99, 30))
    centre = rng.normal(size=64)
    group = centre / np.linalg.norm(centre) + rng.normal(size=(hot, 64)) * 0.01
    rest = rng.normal(size=(1500, 64))
    vectors = np.concatenate([a, b, group, rest])
    rows = [(i, v.tolist(), 0, "x", 1) for i, v in enumerate(vectors.astype(np.float32))]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, COLUMNS).repartition(4))
    n = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found.collect()}
    assert sum(n[1500 + i][1] == i for i in range(1500)) >= 1498
    assert all(n[3000 + i][0] == hot - 1 for i in range(hot))


def test_same_as_sql_on_planted_links(spark, tmp_path):
    rng = np.random.default_rng(4)
    a, b = planted(rng, 64, 150, np.linspace(0.90, 0.999, 20))
    vectors = np.concatenate([a, b, rng.normal(size=(100, 64))])
    table = spark.createDataFrame([(int(i), v.tolist(), int(i) % 150 % 3) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    table.repartition(3).write.parquet(f"{tmp_path}/e")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    assert difference(embedding_dedup.near_duplicates(spark.read.parquet(f"{tmp_path}/e")), duck.sql(sql.EMBEDDING_DEDUP)) is None


def test_labels_are_compared_as_they_are(spark):
    rows = [(1, [1.0, 0.0], 1.2), (2, [1.0, 0.0], 1.7), (3, [1.0, 0.0], 1.7)]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label double"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0, 1, True), (2, 1, 2, True), (3, 1, 2, False)]


def test_null_ids_and_empty_table(spark):
    rows = [(None, [1.0, 0.0], 1, "x", 1), (1, [1.0, 0.0], 1, "x", 1), (2, [2.0, 0.0], 1, "x", 1), (None, None, None, "x", 1)]
    found = [tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, COLUMNS)).collect()]
    assert sorted(found, key=str) == sorted([(None, 0, None, False), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, False)], key=str)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], COLUMNS)).collect() == []


def test_traversal_is_in_order_and_complete():
    rng = np.random.default_rng(2)
    for _ in range(100):
        a, b = rng.random(5), rng.random(4)
        bounds = {i * 4 + j: a[i] + b[j] for i in range(5) for j in range(4)}
        found = embedding_dedup.visits(a, b, 1.0)
        assert sorted(found) == sorted(c for c, v in bounds.items() if v <= 1.0)
        assert [bounds[c] for c in found] == sorted(bounds[c] for c in found)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = embedding_dedup.MultiIndex(8, (embedding_dedup.codebook(x[:, :4], 6, 1), embedding_dedup.codebook(x[:, 4:], 6, 2)))
    (first, second), home = index.bounds(x)
    n = len(index.books[1])
    for i in range(0, 200, 7):
        for j in range(200):
            assert first[i, home[j] // n] + second[i, home[j] % n] <= ((x[i] - x[j]) ** 2).sum() + 1e-9
