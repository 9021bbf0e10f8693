import hashlib
import random

import pytest

import corpus
from recallspark.llm import suffix_dedup


def exact(rows):
    seen, out = {}, {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 49):
            if seen.setdefault(data[k:k + 50], i) < i:
                gone[k:k + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [3, 100_000])
def test_like_brute_force(spark, hot):
    rng = random.Random(1)
    passages = [corpus.prose(rng.randint(6, 40), i) for i in range(8)] + ["ab" * 60, "a" * 120, "é" * 60, "=" * 49]
    rows = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else corpus.prose(rng.randint(1, 20), 1000 + i) for _ in range(rng.randint(0, 5))]
        text = rng.choice(["", " ", "\n"]).join(parts)
        rows.append((i, text[rng.randint(0, 3):] if rng.random() < 0.5 else text))
    rows += [(500, rows[3][1]), (501, None), (502, "")]
    found = suffix_dedup.remove_repeats(corpus.documents(spark, rows), True, hot, pack_bytes=1500, bucket_bytes=900).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found} == exact(rows)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in found)


def test_every_string_holds_a_sample():
    rng = random.Random(2)
    data = [bytes(rng.choice(b"abc ") for _ in range(n)) for n in (0, 49, 50, 51, 400, 3000)]
    pack = suffix_dedup.Pack(list(range(len(data))), data)
    places = set(pack.samples()[0].tolist())
    for start, end in zip(pack.starts, pack.ends):
        for k in range(start, end - 49):
            assert any(p in places for p in range(k, k + suffix_dedup.OFFSETS))
