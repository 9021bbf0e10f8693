import random
import re
import string

import duckdb
import numpy as np

import corpus
from compare import difference
from recallspark.llm import components, minhash_dedup, sql


def exact(rows, size):
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= minhash_dedup.PERCENT * len(sets[a] | sets[b])]
    return sets, corpus.component_of(sets, links)


def edited(words, share, rng):
    return " ".join(corpus.prose(1, rng.randrange(10**6)) if rng.random() < share else w for w in words)


def test_like_brute_force(spark, monkeypatch):
    """Groups of copies whose edits lie around the threshold, so that not all are linked to the most connected one."""
    monkeypatch.setattr(minhash_dedup, "ROW_BLOCK", 7)
    monkeypatch.setattr(minhash_dedup, "COLUMN_BLOCK", 11)
    rng = random.Random(2)
    rows = []
    for group in range(4):
        base = corpus.prose(120, 100 + group).split()
        rows += [edited(base, share, rng) for share in (0.0, 0.0, *[0.01 * (k % 15) for k in range(40)])]
        # A chain: each text drops the first words of the one before.
        rows += [" ".join(base[k:] + corpus.prose(k, 7).split()) for k in range(0, 60, 6)]
    rows += [corpus.prose(80, 500 + i) for i in range(30)] + ["One", "one", "one two", "ONE two", None, ""]
    rng.shuffle(rows)
    rows = list(enumerate(rows, 1))
    for size in (2, 5):
        sets, component = exact(rows, size)
        found = minhash_dedup.near_duplicates(corpus.documents(spark, rows), size).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == {
            i: (len(sets[i]), component[i], component[i] == i) for i in sets}


def test_one_id_on_several_texts(spark, tmp_path):
    """Links are of sets: whichever text an id stands on beside, both its links hold, and SQL says the same."""
    a, b, c = (corpus.prose(60, i) for i in (1, 2, 3))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, c), (5, c + " z"), (5, c + " z"), (6, ""), (6, a + " x w"), (7, None), (8, corpus.prose(9, 9))]
    docs = corpus.documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = minhash_dedup.near_duplicates(docs, 2)
    assert {(r["doc_id"], r["component_id"]) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 1), (6, 6), (7, 7), (8, 8)}
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert difference(found, duck.sql(sql.MINHASH_DEDUP)) is None


def test_blocks_are_bounded_by_shingles(spark, monkeypatch):
    """Large sets make more, smaller blocks; the links are the same."""
    rng = random.Random(3)
    base = corpus.prose(150, 1).split()
    rows = list(enumerate([edited(base, 0.01 * (k % 14), rng) for k in range(60)], 1))
    whole = sorted(minhash_dedup.near_duplicates(corpus.documents(spark, rows), 2).collect())
    monkeypatch.setattr(minhash_dedup, "ROW_SHINGLES", 800)
    monkeypatch.setattr(minhash_dedup, "COLUMN_SHINGLES", 1500)
    seen = {}
    edges = minhash_dedup._block_edges
    monkeypatch.setattr(minhash_dedup, "_block_edges", lambda blocks, *rest: seen.setdefault("blocks", blocks) is None or edges(blocks, *rest))
    assert sorted(minhash_dedup.near_duplicates(corpus.documents(spark, rows), 2).collect()) == whole
    assert seen["blocks"].agg({"row_block": "max"}).first()[0] > 0 and seen["blocks"].agg({"column_block": "max"}).first()[0] > 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 50, 1000):
        own = rng.integers(0, 2**63, n).astype(np.uint64)
        assert minhash_dedup.sketch(own, 150).max() < np.iinfo(np.uint64).max
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (600, 200, 200))
    first, second = (minhash_dedup.sketch(np.concatenate([common, x]), 2000) for x in (a, b))
    assert abs((first == second).mean() - 0.6) < 0.05


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(1, 40)]
    edges = chain + [(100, i) for i in range(101, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7), (7, 8)]
    rng.shuffle(edges)
    found = components.components(spark.createDataFrame(edges, "a long, b long"))
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    expected = corpus.component_of(nodes, [e for e in edges if e[0] != e[1]])
    assert {r["node"]: r["component"] for r in found.collect()} == expected
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_forest():
    rng = np.random.default_rng(4)
    for _ in range(50):
        rows, columns = rng.integers(0, 12, 6), rng.integers(0, 12, 7)
        links = rng.random((6, 7)) < 0.2
        pairs = [(int(rows[i]), int(columns[j])) for i, j in zip(*np.nonzero(links))]
        ids = set(rows.tolist()) | set(columns.tolist())
        edges = components.forest(links, rows, columns)
        assert corpus.component_of(ids, edges) == corpus.component_of(ids, pairs)
        assert len(edges) < len(ids)
