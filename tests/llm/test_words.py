import random
import re

import numpy as np

from recallspark.llm import words


def test_words_and_places(monkeypatch):
    rng = random.Random(1)
    for _ in range(200):
        data = bytes(rng.choice(b"abAB  \n.1") for _ in range(rng.randint(0, 80)))
        whole = words.hashed_words(data, words.SPACED)
        found = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
        assert list(zip(whole[1].tolist(), whole[2].tolist())) == found
        by_word = {}
        for h, (a, b) in zip(whole[0].tolist(), found):
            assert by_word.setdefault(data[a:b].lower(), h) == h
        assert len(set(by_word.values())) == len(by_word)
        monkeypatch.setattr(words, "PIECE", 7)
        assert all((a == b).all() for a, b in zip(words.hashed_words(data, words.SPACED), whole))
        monkeypatch.undo()


def test_hash_set():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**63, 500, dtype=np.uint64)
    asked = np.concatenate([values[:100], rng.integers(0, 2**63, 500, dtype=np.uint64)])
    known = words.HashSet(values, bits=8)
    assert known.has(asked).tolist() == [int(v) in set(values.tolist()) for v in asked]
    assert not words.HashSet([]).has(asked).any()
