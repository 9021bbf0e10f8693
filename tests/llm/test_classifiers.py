"""Held-out accuracy of what is learned, on the given tables."""

import os

import numpy as np
import pytest

import corpus
from recallspark.llm import language_id, quality, queries, toxicity

FOLDER = os.environ.get("CORPUS_DIR", "/root/testdata/sf0.01")
LARGER = os.environ.get("CORPUS_LARGER_DIR", "/root/testdata/sf0.1")
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the parquet tables")


@needs_tables
def test_language_held_out(spark):
    rows = queries.op4_language_id(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 200 and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97


@needs_tables
def test_toxicity_held_out(spark):
    rows = queries.op1_toxicity(spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").where("held_out").collect()
    right = np.mean([r["predicted"] == r["toxic"] for r in rows])
    assert len(rows) > 500 and right > 0.95
    assert all((r["score"] >= 0.5) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 for r in rows)


@needs_tables
def test_quality_without_labels(spark):
    rows = queries.op9_quality(spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_codewords_differ():
    for n in (2, 3, 4, 6, 7, 12):
        m = language_id.codewords(n)
        distances = [(m[i] != m[j]).sum() for i in range(n) for j in range(i)]
        assert len(m) == n and min(distances) >= (1 if n < 3 else 2)


def test_label_model_finds_the_reliable_labellers():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.6, 0.9, 0.55, 0.8, 0.9, 0.85, 0.9])[:quality.LABELLERS]
    votes = np.where(rng.random((4000, quality.LABELLERS)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.2] = quality.NONE
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.estimate(patterns, counts.astype(float))
    assert np.abs(model.chance[:, quality.GOOD, quality.GOOD] - right).max() < 0.05
    assert np.mean((model.posterior(votes) >= 0.5) == truth) > 0.97


def test_threshold():
    logits, toxic = np.array([3.0, 2, 1, 0, -1]), np.array([1.0, 1, 0, 0, 0])
    assert toxicity.best_threshold(logits, toxic, np.ones(5)) == 1.5


def test_long_texts_are_scored_whole():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 2**63, 300).astype(np.uint64)
    texts = [rng.choice(words, 50) for _ in range(200)]
    bad = np.uint64(7)
    toxic = np.arange(200) % 2
    texts = [np.append(t, bad) if x else t for t, x in zip(texts, toxic)]
    net = toxicity.fit(texts, toxic.astype(float))
    tables = net.tables()
    long_text = np.tile(words, 1000)
    assert net.logit(tables, np.append(long_text, bad)) > net.logit(tables, long_text) + 1
    assert np.mean([(net.logit(tables, t) > 0) == x for t, x in zip(texts, toxic)]) > 0.95
    assert np.isfinite(net.logit(tables, words[:0]))


def test_short_and_long_texts_have_features():
    for text in ("", "a", corpus.prose(5000, 1)):
        assert np.isfinite(language_id.features(text.encode())).all()
