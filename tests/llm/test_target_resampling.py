"""Bucket counts, weights and draws against plain Python with zlib."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus
from recallspark.llm import target_resampling as resampling
from recallspark.llm.common import ROW

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features(text, longest=1):
    words = WORD.findall((text or "").translate(LOWER))
    return [" ".join(words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, buckets, longest, percent, least, seed):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = (Counter(bucket(f) for text in texts for f in features(text, longest)) for texts in ([x for _, x in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        found = [gain[bucket(f)] for f in features(text, longest)]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(features(text))))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = {id(r): n for n, r in enumerate(able[:percent * len(able) // 100], 1)}
    return [(*r[:4], drawn.get(id(r))) for r in rows]


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("longest,percent,least,buckets", [(1, 10, 20, 10_000), (3, 35, 5, 97), (2, 100, 0, 1000)])
def test_equal_to_plain_python(spark, longest, percent, least, buckets):
    docs = [r[:2] for r in corpus.odd_rows()] + [(i, corpus.prose(random.Random(i).randint(0, 60), i)) for i in range(20, 120)]
    docs += [(200, "Straße ÄÖ 中文字 a1B2 under_score"), (201, corpus.prose(25, 30).upper()), (202, "x" * 255 + " " + "y" * 256 + " " + "z" * 257)]
    target = [corpus.prose(40, 25), None, "", "中文字 Straße", "Z" * 300]
    found = resampling.resample(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
        spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"),
        percent=percent, words_least=least, buckets=buckets, longest=longest)
    assert order(found.collect()) == order(plain(docs, target, buckets, longest, percent, least, 2024))


def test_crcs_of_all_lengths():
    rng = random.Random(4)
    parts = [bytes(rng.choice(b"abc\xc3\xa9") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 255, 256, 257, 900]))) for _ in range(3000)]
    buffer = np.frombuffer(b"".join(parts), dtype=np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    assert resampling.crcs(buffer, starts, ends).tolist() == [zlib.crc32(p) for p in parts]


def test_rows_of_one_hash_stay_apart(monkeypatch):
    """Longer features are told apart by their bytes, not by a hash of them."""
    first = np.zeros((2, 16), dtype=np.uint8)
    # Two rows of one key: what the first eight bytes add is taken back by the others.
    first[0, 0], key = 1, (1 * 0x9E3779B97F4A7C15) % (1 << 64)
    first[0, 8:] = np.frombuffer(((1 << 64) - key).to_bytes(8, "little"), dtype=np.uint8)
    distinct, back = resampling._distinct(first)
    assert len(distinct) == 2 and distinct[back].tolist() == first.tolist()


@pytest.mark.parametrize("longest", [1, 3])
def test_pieces_do_not_show(monkeypatch, longest):
    """A text cut into many pieces has the features of the whole one, also with a word longer than a piece."""
    text = (corpus.prose(700, 3) + " " + "q" * 5000 + " " + corpus.prose(50, 4)).encode()
    whole = Counter()
    for found, _, _ in resampling.Features(1000, longest).of([text]):
        whole.update(found.tolist())
    monkeypatch.setattr(resampling, "PIECE", 300)
    cut, pieces = Counter(), 0
    for found, numbers, _ in resampling.Features(1000, longest).of([b"a b", text, b"c"]):
        cut.update(f for f, n in zip(found.tolist(), numbers.tolist()) if n == 1)
        pieces += 1
    assert cut == whole and pieces > 10 * longest


def test_rows_come_along(spark):
    docs = corpus.odd_documents(spark)
    target = corpus.documents(spark, [corpus.prose(30, 9)])
    found = resampling.resample(docs, target, whole=True).select(f"{ROW}.*")
    assert order(map(str, r) for r in found.collect()) == order(map(str, r) for r in docs.collect())


def test_empty_tables(spark):
    none = corpus.no_documents(spark)
    some = corpus.documents(spark, [corpus.prose(30, i) for i in range(10)])
    assert resampling.resample(none, some).collect() == []
    rows = resampling.resample(some, none).collect()
    assert len(rows) == 10 and sorted(r["rank"] for r in rows if r["rank"]) == [1]
