"""Nulls, empty and long texts, repeated rows, empty tables, other columns of clashing names: every operator."""

import public_tokenizers
import pytest

import corpus
from recallspark.llm import byte_bpe, decontamination, language_id, license_scan, minhash_dedup, quality, secret_scan, suffix_dedup, toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _benchmark(spark):
    return spark.createDataFrame([(1, corpus.prose(20, 50)), (None, "a b c d e"), (2, None), (3, "a b"), (3, "a b")], "item_id long, text string")


def _labels(spark):
    return spark.createDataFrame([(1, 1), (4, 0), (5, 0), (12, 1), (None, 1), (6, None)], "doc_id long, toxic int")


OPERATORS = {
    "language": lambda s, d: language_id.identify(d, language_id.train(d)),
    "toxicity": lambda s, d: toxicity.score_documents(d, toxicity.train(d, _labels(s))),
    "quality": lambda s, d: quality.score_documents(d, quality.train(d)),
    "licenses": lambda s, d: license_scan.scan(d),
    "secrets": lambda s, d: secret_scan.find_secrets(d, secret_scan.train(d), redact=True),
    "leaks": lambda s, d: decontamination.find_leaks(d, _benchmark(s)),
    "tokens": lambda s, d: byte_bpe.encode_documents(d, VOCABULARY, public_tokenizers.PATTERN, keep_ids=True),
    "near": lambda s, d: minhash_dedup.near_duplicates(d, size=2),
    "repeats": lambda s, d: suffix_dedup.remove_repeats(d, keep_text=True),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_per_row(spark, name):
    rows = OPERATORS[name](spark, corpus.odd_documents(spark)).collect()
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
    assert ids == sorted((r[0] is None, r[0] or 0) for r in corpus.odd_rows())
    twice = [r for r in rows if r["doc_id"] == 5]
    assert twice[0] == twice[1]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, corpus.no_documents(spark)).collect() == []


def test_defined_results(spark):
    docs = corpus.odd_documents(spark)
    languages = {r["doc_id"]: r for r in OPERATORS["language"](spark, docs).collect()}
    assert all(languages[i]["lang_pred"] == "und" and languages[i]["score"] == 0 for i in (2, 3, 7, 9))
    near = {r["doc_id"]: r for r in OPERATORS["near"](spark, docs).collect()}
    assert [near[i]["component_id"] for i in (2, 3, 5, 6, 9, 13, 14, 15)] == [2, 3, 5, 5, 9, 13, 13, 4]
    assert [near[i]["n_shingles"] for i in (2, 3, 9, 13)] == [0, 0, 0, 1]
    repeats = {r["doc_id"]: r for r in OPERATORS["repeats"](spark, docs).collect()}
    assert repeats[5]["n_removed"] == 0 and repeats[6]["n_removed"] == repeats[6]["n_bytes"]
    # A string of one letter holds itself many times over, but in one document only.
    assert repeats[8]["n_removed"] == 0 and repeats[2]["n_bytes"] == 0
    secrets = {r["doc_id"]: r for r in OPERATORS["secrets"](spark, docs).collect()}
    assert secrets[2]["redacted"] is None and secrets[3]["redacted"] == ""
    assert secrets[11]["redacted"].endswith('[SECRET]"') and secrets[11]["n_assign"] == secrets[11]["n_hex"] == 1
    licenses = {r["doc_id"]: r for r in OPERATORS["licenses"](spark, docs).collect()}
    assert licenses[12]["labels"] == "mit" and licenses[12]["score"] == 1 and licenses[1]["labels"] == ""


def test_untrained(spark):
    """Without a usable label nothing is judged, and nothing fails."""
    docs = corpus.documents(spark, ["abc", None])
    assert language_id.train(docs.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")) is None
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}
    assert toxicity.train(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int")) is None
    assert {r["predicted"] for r in toxicity.score_documents(docs, None).collect()} == {0}
    assert {r["kept"] for r in quality.score_documents(docs, None).collect()} == {True}
