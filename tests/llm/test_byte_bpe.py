import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

import corpus
from recallspark.llm import byte_bpe

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
with open(VOCABULARY, "rb") as file:
    RANKS = byte_bpe.load_ranks(file.read())
CODEC = byte_bpe.Codec(RANKS)
EXPECTED = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SPLIT = byte_bpe.splitter(public_tokenizers.PATTERN)
TEXT = st.one_of(st.text(max_size=80), st.text("ab", max_size=200), st.text("abcde éè\n'st1 ", max_size=120))


@settings(max_examples=300, deadline=None)
@given(TEXT, st.sampled_from([1, 2, 5, 48]))
def test_like_the_library(text, leaf):
    before, byte_bpe.LEAF_BYTES = byte_bpe.LEAF_BYTES, leaf
    try:
        ids = [i for piece in SPLIT(text) for i in CODEC.encode(piece.encode())]
    finally:
        byte_bpe.LEAF_BYTES = before
    assert ids == EXPECTED.encode_ordinary(text)
    assert CODEC.decode(ids).decode() == text


@pytest.mark.parametrize("data", [b"a" * 5000, b"ab" * 3000, "é".encode() * 2000, bytes(range(256)) * 10])
def test_long_pieces(data):
    ids = CODEC.encode(data)
    assert CODEC.decode(ids) == data
    assert ids == EXPECTED._core_bpe.encode_single_piece(data)


def test_documents(spark):
    texts = [corpus.prose(50, 1), None, "", "it's  \n 12 — <|endoftext|> 中文", "x" * 10_000]
    rows = byte_bpe.encode_documents(corpus.documents(spark, texts), VOCABULARY, public_tokenizers.PATTERN, keep_ids=True)
    for r in rows.collect():
        text = texts[r["doc_id"] - 1] or ""
        ids = EXPECTED.encode_ordinary(text)
        assert (r["ids"], r["n_tokens"]) == (ids, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in byte_bpe.decode_documents(rows, VOCABULARY).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts, 1)}
