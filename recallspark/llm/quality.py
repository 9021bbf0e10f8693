"""Quality of a text by weak labels: expectation-maximisation over heuristic labellers, a hashed linear scorer.

Labellers look at a whole text and vote good, bad or nothing. How often each vote falls on good
and on bad texts is estimated by expectation-maximisation over the counts of all vote patterns of
the corpus; that gives every text a posterior. A linear scorer on hashed words, word shapes and
binned statistics is trained on the posteriors of a bounded sample and scores every text.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import bounded_sample, broadcast_object, map_rows, ship, texts
from .toxicity import Languages
from .words import SPACED, hashed_words, mix

# Texts of each side of the posterior that train the scorer.
TRAINING_TEXTS = 1000
BUCKETS = 1 << 13
ROUNDS = 50
KEEP_FROM = 0.3
GOOD, BAD, NONE = 1, 0, 2

STATISTICS = ("words", "word_length", "signs", "capitals", "distinct", "repeated_lines", "function_words", "sentence_ends",
              "sign_words", "echoes")


# Bytes that neither letters, digits nor punctuation of prose are.
_SIGN = np.zeros(256, dtype=bool)
_SIGN[33:127] = True
_SIGN[[c for c in range(33, 127) if chr(c).isalnum() or chr(c) in ".,;:'\"()-?!"]] = False


def statistics(data: bytes, h: np.ndarray, starts: np.ndarray, ends: np.ndarray, languages: Languages) -> np.ndarray:
    """The numbers that labellers look at, in the order of STATISTICS; a text without words gives zeros."""
    n = len(h)
    if not n:
        return np.zeros(len(STATISTICS))
    b = np.frombuffer(data, dtype=np.uint8)
    counts = np.bincount(b, minlength=256)
    letters = counts[97:123].sum() + counts[65:91].sum() + counts[128:].sum()
    capitals = counts[65:91].sum()
    plain = sum(int(counts[c]) for c in b" \n\r\t.,;:'\"()-?")
    lines = [line for line in data.split(b"\n") if line.strip()]
    repeated = 1 - len(set(lines)) / len(lines) if lines else 0.0
    last = b[ends - 1]
    closing = np.isin(last, np.frombuffer(b".?!", dtype=np.uint8))
    bare = hashed_words(data)[0]
    frequent = float((languages.words.index(bare) >= 0).mean()) if len(bare) else 0.0
    return np.array([
        n, float((ends - starts).mean()), 1 - (letters + plain + counts[48:58].sum()) / len(data),
        capitals / max(1, letters), len(np.unique(h)) / n ** 0.9, repeated, frequent, float(closing.mean()),
        float(_SIGN[last].mean()), float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0])


def votes(s: np.ndarray) -> list[int]:
    """One vote per labeller."""
    n, length, signs, capitals, distinct, repeated, frequent, closing, sign_words, echoes = s
    return [
        NONE if n < 5 else GOOD,
        NONE if n < 5 else BAD if length > 12 or length < 2 else GOOD if 3 <= length <= 9 else NONE,
        BAD if signs > 0.02 else GOOD if signs < 0.005 else NONE,
        BAD if capitals > 0.3 else GOOD if capitals < 0.1 else NONE,
        NONE if n < 20 else BAD if distinct < 0.25 else GOOD if distinct > 0.5 else NONE,
        BAD if repeated > 0.3 else NONE if repeated > 0 else GOOD,
        NONE if n < 20 else BAD if frequent < 0.05 else GOOD if frequent > 0.1 else NONE,
        NONE if n < 20 else BAD if closing < 0.01 else GOOD if 0.02 < closing < 0.3 else NONE,
        BAD if sign_words > 0.1 else GOOD if sign_words < 0.02 else NONE,
        NONE if n < 5 else BAD if echoes > 0.2 else GOOD if echoes < 0.1 else NONE,
    ]


LABELLERS = len(votes(np.zeros(len(STATISTICS))))


@dataclass
class LabelModel:
    """How often labellers that vote say good on bad and on good texts, and how many texts are good."""

    share: float
    chance: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Per vote pattern the probability of a good text."""
        table = np.concatenate([np.log(self.chance), np.zeros((LABELLERS, 2, 1))], axis=2)
        side = table[np.arange(LABELLERS)[None, :], :, patterns].sum(1)
        odds = side[:, GOOD] - side[:, BAD] + np.log(self.share) - np.log1p(-self.share)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation from the number of bad votes; labellers are taken to be right more often than not."""
    bad = (patterns == BAD).sum(1)
    p = np.choose(np.minimum(bad, 2), [0.95, 0.4, 0.05])
    prior = np.zeros((LABELLERS, 2, 2))
    prior[:, GOOD, GOOD] = prior[:, BAD, BAD] = 2.0
    prior[:, GOOD, BAD] = prior[:, BAD, GOOD] = 0.5
    model = None
    for _ in range(rounds):
        chance = prior.copy()
        for side, weight in ((GOOD, counts * p), (BAD, counts * (1 - p))):
            for j in range(LABELLERS):
                chance[j, side] += np.bincount(patterns[:, j], weights=weight, minlength=3)[:2]
        chance /= chance.sum(2, keepdims=True)
        share = float(np.clip((counts * p).sum() / counts.sum(), 0.01, 0.99))
        model = LabelModel(share, chance)
        p = model.posterior(patterns)
    return model


_EDGES = {"words": [5, 20, 50, 200, 1000], "word_length": [2, 3, 4, 5, 6, 7, 9, 12], "signs": [.001, .01, .03, .05, .1, .2],
          "capitals": [.001, .01, .03, .06, .1, .2, .3, .6], "distinct": [.1, .25, .4, .55, .7, .85, 1.0],
          "repeated_lines": [1e-9, .05, .1, .3, .5], "function_words": [.02, .05, .1, .2, .3, .5], "sentence_ends": [.005, .02, .05, .1, .2, .3, .5],
          "sign_words": [.005, .02, .05, .1, .3, .6], "echoes": [.02, .05, .1, .2, .5]}


def features(data: bytes, h: np.ndarray, starts: np.ndarray, ends: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a text: hashed words and word shapes, each set of unit length, and binned statistics."""
    total = np.zeros(BUCKETS)
    if len(h):
        b = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
        kind = np.full(256, 4, dtype=np.uint64)
        kind[97:123], kind[65:91], kind[48:58], kind[128:] = 0, 1, 2, 3
        shape = (np.minimum(ends - starts, 20).astype(np.uint64) * np.uint64(8) + kind[b[starts]]) * np.uint64(8) + kind[b[ends - 1]]
        for keys in (h, mix(shape + np.uint64(1 << 40))):
            part = np.sqrt(np.bincount((keys >> np.uint64(51)).astype(np.int64), minlength=BUCKETS))
            total += part / np.linalg.norm(part)
    bins = [np.searchsorted(_EDGES[name], v, side="right") + 32 * i for i, (name, v) in enumerate(zip(STATISTICS, s))]
    np.add.at(total, (mix(np.array(bins, dtype=np.uint64) + np.uint64(1 << 41)) >> np.uint64(51)).astype(np.int64), 1.0)
    at = np.flatnonzero(total)
    return at, total[at]


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, weight: np.ndarray, epochs: int = 12, rate: float = 0.2) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by AdaGrad over a fixed order."""
    w, b = np.zeros(BUCKETS), 0.0
    seen, seen_b = np.full(BUCKETS, 1e-2), 1e-2
    order = np.random.default_rng(5).permutation(len(rows))
    for _ in range(epochs):
        for i in order:
            at, x = rows[i]
            g = weight[i] * (1 / (1 + np.exp(-np.clip(w[at] @ x + b, -30, 30))) - target[i])
            seen[at] += (g * x) ** 2
            seen_b += g * g
            w[at] -= rate * g * x / np.sqrt(seen[at])
            b -= rate * g / np.sqrt(seen_b)
    return w, b


@dataclass
class Scorer:
    labels: LabelModel
    weights: np.ndarray
    bias: float


def _looked_at(data: bytes, languages: Languages):
    h, starts, ends = hashed_words(data, SPACED)
    s = statistics(data, h, starts, ends, languages)
    return h, starts, ends, s


def train(docs: DataFrame, per_side: int = TRAINING_TEXTS) -> Scorer | None:
    """The label model from all of ``docs``, the scorer from at most ``per_side`` texts that look good and bad.

    None for an empty table.
    """
    ship(docs.sparkSession)

    def count():
        languages = Languages()

        def row(doc_id, data):
            return ("".join(map(str, votes(_looked_at(data, languages)[3]))),)

        return row

    # At most 3 to the power of LABELLERS patterns, whatever the corpus.
    counted = sorted((r["pattern"], r["count"]) for r in map_rows(texts(docs), count, "pattern string").groupBy("pattern").count().collect())
    if not counted:
        return None
    patterns = np.array([[int(c) for c in p] for p, _ in counted])
    model = estimate(patterns, np.array([n for _, n in counted], dtype=float))
    posterior = dict(zip((p for p, _ in counted), model.posterior(patterns).tolist()))
    sides = F.create_map(*[F.lit(x) for p, v in posterior.items() for x in (p, int(v >= 0.5))])

    def side():
        languages = Languages()

        def row(doc_id, data):
            h, starts, ends, s = _looked_at(data, languages)
            at, x = features(data, h, starts, ends, s)
            return doc_id, "".join(map(str, votes(s))), at.astype(np.int32).tobytes(), x.astype(np.float32).tobytes(), len(data)

        return row

    # A share of the texts that surely holds enough, as the counts say; then the exact number.
    n_side = [sum(n for p, n in counted if (posterior[p] >= 0.5) == s) for s in (False, True)]
    least = min([n for n in n_side if n] or [1])
    share = min(1.0, 2.0 * (per_side + 20) / least)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    looked = map_rows(texts(some), side, "doc_id long, pattern string, at binary, x binary, size long")
    sample = bounded_sample(looked.withColumn("side", F.element_at(sides, F.col("pattern"))), "side", per_side, key=("doc_id", "size"))
    got = sorted(sample.select("side", "_pick", "pattern", "at", "x").collect())
    rows = [(np.frombuffer(r["at"], dtype=np.int32), np.frombuffer(r["x"], dtype=np.float32)) for r in got]
    target = np.array([posterior[r["pattern"]] for r in got])
    sizes = np.bincount([r["side"] for r in got], minlength=2)
    weight = np.array([0.5 * len(got) / sizes[r["side"]] for r in got])
    return Scorer(model, *fit(rows, target, weight))


def score_documents(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """(doc_id, score, posterior, votes, kept) of every whole text of ``docs`` (doc_id, text).

    ``score`` and the label model's ``posterior`` are 0 to 1; ``votes`` has a digit per labeller
    (1 good, 0 bad, 2 none); ``kept`` is score >= KEEP_FROM. Null and empty texts are texts
    without words. Without a scorer nothing is judged: score and posterior 1. A null doc_id
    stays null, repeated rows give repeated results, other columns are not read.
    """
    ship(docs.sparkSession)
    shared = broadcast_object(docs.sparkSession, scorer)

    def start():
        fitted: Scorer | None = pickle.loads(shared.value)
        languages = Languages()

        def row(doc_id, data):
            h, starts, ends, s = _looked_at(data, languages)
            v = votes(s)
            if fitted is None:
                return doc_id, 1.0, 1.0, "".join(map(str, v)), True
            at, x = features(data, h, starts, ends, s)
            score = float(1 / (1 + np.exp(-np.clip(fitted.weights[at] @ x + fitted.bias, -500, 500))))
            return doc_id, score, float(fitted.labels.posterior(np.array([v]))[0]), "".join(map(str, v)), score >= KEEP_FROM

        return row

    return map_rows(texts(docs), start, "doc_id long, score double, posterior double, votes string, kept boolean")
