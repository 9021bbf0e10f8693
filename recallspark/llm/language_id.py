"""Language of a text by error-correcting output codes over byte n-grams.

Every language has a codeword of bits. One linear classifier per bit, on hashed n-grams of
the whole text, says how far the bit is on; the language whose codeword has the smallest
logistic loss against all bits, weighted by how well each bit was learned, wins. A small
distance to the runner-up marks the text as ambiguous.
"""

from __future__ import annotations

import itertools
import math
import pickle
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import bounded_sample, broadcast_object, map_rows, ship, texts

UNKNOWN = "und"
# The classifiers are fitted on so many texts of each language.
TRAINING_TEXTS = 600
BUCKETS = 4096
GRAM_SIZES = (2, 3)
PIECE = 1 << 18
# A lead, in weighted loss, below which the winner is marked as ambiguous.
AMBIGUOUS_LEAD = 0.5
# With more languages than this, codewords are drawn instead of enumerated.
ENUMERATED = 6

_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not (97 <= b <= 122 or 65 <= b <= 90)]] = 32


def gram_counts(data: bytes) -> np.ndarray:
    """Counts of the hashed byte n-grams of a text; ASCII case folded, other ASCII signs as blanks."""
    counts = np.zeros(BUCKETS)
    longest = max(GRAM_SIZES)
    for at in range(0, len(data), PIECE):
        b = _FOLD[np.frombuffer(data[at:at + PIECE + longest - 1], dtype=np.uint8)]
        for n in GRAM_SIZES:
            m = min(len(b) - n + 1, PIECE)
            if m <= 0:
                continue
            key = b[:m].copy()
            for i in range(1, n):
                key = key * np.uint64(257) + b[i:i + m]
            key = (key + np.uint64(n << 32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)
            counts += np.bincount(key.astype(np.int64), minlength=BUCKETS)
    return counts


def features(data: bytes) -> np.ndarray:
    x = np.sqrt(gram_counts(data))
    norm = np.linalg.norm(x)
    return (x / norm if norm else x).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """A matrix of +1 and -1, a row per language: all different splits of the languages, or drawn ones."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= ENUMERATED:
        return np.array([(1,) + bits for bits in itertools.product((1, -1), repeat=n - 1) if -1 in bits], dtype=float).T
    rng, length = np.random.default_rng(n), 4 * math.ceil(math.log2(n)) + 8
    drawn = [np.where(rng.random((n, length)) < 0.5, 1.0, -1.0) for _ in range(200)]
    return max(drawn, key=lambda m: min((a != b).sum() for a, b in itertools.combinations(m[:64], 2)))


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Per language the weighted logistic loss of its codeword."""
        z = x @ self.weights + self.bias
        return np.logaddexp(0, -self.codes * z) @ self.trust

    def predict(self, data: bytes) -> tuple[str, float, bool]:
        losses = self.losses(features(data))
        order = np.argsort(losses, kind="stable")
        best = losses[order[0]]
        lead = float(losses[order[1]] - best) if len(order) > 1 else math.inf
        return self.languages[order[0]], float(1 / np.exp(best - losses).sum()), lead < AMBIGUOUS_LEAD


def fit(x: np.ndarray, labels: list[str], steps: int = 100, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """One logistic classifier per codeword bit, by Adam over the whole (bounded) sample; languages weigh the same."""
    languages = sorted(set(labels))
    codes = codewords(len(languages))
    index = np.array([languages.index(v) for v in labels])
    weight = 1.0 / np.bincount(index, minlength=len(languages))[index] / max(len(languages), 1)
    target = codes[index]
    w, b = np.zeros((x.shape[1], codes.shape[1])), np.zeros(codes.shape[1])
    m, v = np.zeros((x.shape[1] + 1, codes.shape[1])), np.zeros((x.shape[1] + 1, codes.shape[1]))
    for t in range(1, steps + 1):
        z = x @ w.astype(x.dtype) + b
        g = -target * weight[:, None] / (1 + np.exp(np.clip(target * z, -30, 30)))
        grad = np.vstack([x.T @ g.astype(x.dtype) + decay * w, g.sum(0)])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    right = ((np.sign(x @ w + b) == target) * weight[:, None]).sum(0)
    trust = np.clip(2 * right - 1, 0.05, 1)
    return Model(languages, codes, w.astype(np.float32), b, trust / trust.sum() * len(trust))


def train(labelled: DataFrame, per_language: int = TRAINING_TEXTS) -> Model | None:
    """A model of the languages in ``labelled`` (doc_id, text, lang); None without a usable row.

    At most ``per_language`` whole texts of each language are used. Rows without language,
    without text or without a letter teach nothing.
    """
    ship(labelled.sparkSession)
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sample = bounded_sample(rows, "lang", per_language)

    def start():
        def row(lang, pick, text):
            return lang, pick, np.sqrt(gram_counts(text)).astype(np.float16).tobytes()

        return row

    found = map_rows(sample.select("lang", "_pick", F.col("text").cast("binary")), start, "lang string, pick long, grams binary")
    got = sorted(found.collect(), key=lambda r: (r["lang"], r["pick"]))
    if not got:
        return None
    x = np.stack([np.frombuffer(r["grams"], dtype=np.float16) for r in got]).astype(np.float32)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return fit(x / np.where(norm == 0, 1, norm), [r["lang"] for r in got])


def identify(docs: DataFrame, model: Model | None, whole: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every whole text.

    ``score`` is the softmax of the losses, 0 to 1. A null or empty text, one without a letter,
    or any text without a model is ``und`` with score 0 and not ambiguous. A null doc_id stays
    null, repeated rows give repeated results, other columns are not read; with ``whole`` a
    column ROW holds the input rows.
    """
    ship(docs.sparkSession)
    shared = broadcast_object(docs.sparkSession, model)
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))

    def start():
        fitted = pickle.loads(shared.value)

        def row(doc_id, text, letters):
            return (doc_id, *fitted.predict(text)) if letters and fitted else (doc_id, UNKNOWN, 0.0, False)

        return row

    return map_rows(texts(docs, has_letter.alias("letters"), whole=whole), start,
                    "doc_id long, lang_pred string, score double, ambiguous boolean")
