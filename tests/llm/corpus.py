"""Small documents that hold the odd cases, and plain versions of what operators compute."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, score double, words array<string>, unit string, pack long, found int"

MIT = "Released under the MIT License."
SECRET = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    parts = "an the of er ing ion re at en es or te ti hi it is ou ar".split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_rows() -> list[tuple]:
    long_text = prose(30_000, 1)
    texts = [
        (1, prose(60, 2)), (2, None), (3, ""), (4, long_text), (None, prose(30, 3)), (None, None), (5, prose(40, 4)),
        (5, prose(40, 4)), (6, prose(40, 4)), (7, "12 345 --- 67"), (8, "x" * 300_000), (9, " \n\t "), (10, "éàü ñ ß 中文 😀"),
        (11, prose(60, 2) + " " + SECRET), (12, prose(60, 2) + " " + MIT), (13, "word"), (14, "word"), (15, long_text + " end"),
    ]
    return [(i, t, "en" if i is None or i % 2 else "fr", 0.5, ["a"], "u", 1, 2) for i, t in texts]


def odd_documents(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, texts):
    """Documents numbered from 1, or given as (id, text)."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def component_of(ids, links) -> dict:
    """The smallest id that links reach, for each id."""
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}
