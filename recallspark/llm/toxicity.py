"""Toxicity by a convolutional text classifier: hashed word embeddings, filters of several widths, max pooling.

Words are hashed; words that enough training texts hold have an embedding, all others the
zero vector. Filters over one, two and three consecutive words are rectified, pooled by their
maximum over the whole text, and weighed into one logit. The network is trained in numpy on a
bounded sample. Thresholds are calibrated for each language, which is guessed from the text's
own function words, and the score is moved so that the threshold lies at 0.5.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import bounded_sample, broadcast_object, map_rows, ship, texts
from .words import ALNUM, HashSet, hashed_words

# Training texts of each label; longer texts than TRAINING_WORDS do not teach.
TRAINING_TEXTS, TRAINING_WORDS = 1500, 20_000
# Training texts that must hold a word for it to have an embedding.
WORD_LEAST = 3
DIMENSIONS, FILTERS, WIDTHS = 12, 8, (1, 2, 3)
EPOCHS, BATCH, RATE = 8, 64, 0.01
# Every so many training texts one is kept for the thresholds.
CALIBRATION_EVERY = 4
# Calibration texts of each label that a language needs for a threshold of its own.
LANGUAGE_LEAST = 15
# Words held at once when scoring.
WORDS_AT_ONCE = 1 << 16

# Frequent function words.
FUNCTION_WORDS = {
    "de": "der die und das nicht mit den ist ein eine von zu dem für auf sich auch im",
    "en": "the of and to in is that for it was with as on by this are be from",
    "es": "el los las del que una por con para es como más su al lo y en de",
    "fr": "le les des est dans pour qui que une sur au avec pas du et la ne ce",
    "it": "il gli della che di per non sono con una è nel alla dei",
    "pt": "o os da do que em um uma para com não por mais as",
}


@dataclass
class Network:
    words: HashSet
    embedding: np.ndarray
    filters: list[np.ndarray]
    filter_bias: list[np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.0

    def pooled(self, tables: list[list[np.ndarray]], h: np.ndarray) -> np.ndarray:
        """The maximum of every filter over all words, rectified; a text ends in blank words."""
        most = max(WIDTHS) - 1
        top = [np.full(FILTERS, -np.inf, dtype=np.float32) for _ in WIDTHS]
        ids = np.concatenate([self.words.index(h) + 1, np.zeros(most, dtype=np.int64)])
        n = max(len(h), 1)
        ids = np.concatenate([ids, np.zeros(max(0, n + most - len(ids)), dtype=np.int64)])
        for at in range(0, n, WORDS_AT_ONCE):
            m = min(WORDS_AT_ONCE, n - at)
            for i, width in enumerate(WIDTHS):
                total = tables[i][0][ids[at:at + m]]
                for k in range(1, width):
                    total = total + tables[i][k][ids[at + k:at + k + m]]
                np.maximum(top[i], total.max(0), out=top[i])
        return np.maximum(np.concatenate([t + b for t, b in zip(top, self.filter_bias)]), 0)

    def tables(self) -> list[list[np.ndarray]]:
        """Per width and place, every word's share of the filters."""
        return [[(self.embedding @ f[k]).astype(np.float32) for k in range(w)] for w, f in zip(WIDTHS, self.filters)]

    def logit(self, tables, h: np.ndarray) -> float:
        return float(self.pooled(tables, h) @ self.weights + self.bias)


class Languages:
    """Guesses a language by the function words of a text."""

    def __init__(self):
        self.names = sorted(FUNCTION_WORDS)
        pairs = {}
        for i, name in enumerate(self.names):
            for w in FUNCTION_WORDS[name].split():
                pairs.setdefault(int(hashed_words(w.encode(), ALNUM)[0][0]), []).append(i)
        self.words = HashSet(np.array(sorted(pairs), dtype=np.uint64), bits=16)
        self.votes = np.zeros((len(self.words.keys) + 1, len(self.names)))
        for at, key in enumerate(self.words.keys):
            self.votes[at + 1, pairs[int(key)]] = 1 / len(pairs[int(key)])

    def guess(self, h: np.ndarray) -> str:
        counts = np.bincount(self.words.index(h) + 1, minlength=len(self.votes)) @ self.votes
        return self.names[int(counts.argmax())] if counts.any() else ""


def fit(hashes: list[np.ndarray], toxic: np.ndarray, seed: int = 3) -> Network:
    """Trains the network on word hashes of texts and their labels."""
    rng = np.random.default_rng(seed)
    seen, inverse = np.unique(np.concatenate([np.unique(h) for h in hashes]), return_counts=True)
    kept = HashSet(seen[inverse >= WORD_LEAST])
    n_words = len(kept.keys)
    ids = [np.concatenate([kept.index(h) + 1, np.zeros(max(WIDTHS) - 1 if len(h) else max(WIDTHS), dtype=np.int64)]) for h in hashes]
    # The first dimension starts at each word's log-odds, the others at random.
    held = np.zeros((n_words + 1, 2))
    for i, label in zip(ids, toxic):
        held[np.unique(i), int(label)] += 1
    share = (held + 0.5) / (np.bincount(toxic.astype(int), minlength=2) + 1)
    odds = np.log(share[:, 1] / share[:, 0]) * np.minimum(1, held.sum(1) / 20)
    p = {"e": rng.normal(0, 0.05, (n_words + 1, DIMENSIONS)), "v": rng.normal(0, 0.3, len(WIDTHS) * FILTERS), "b": np.zeros(1)}
    p["e"][:, 0] = np.clip(odds, -2, 2)
    p["e"][0] = 0
    for i, w in enumerate(WIDTHS):
        p[f"f{i}"] = rng.normal(0, 0.3, (w, DIMENSIONS, FILTERS))
        p[f"f{i}"][:, 0, : FILTERS // 2] = 1
        p[f"c{i}"] = np.full(FILTERS, -0.1)
    p["v"].reshape(len(WIDTHS), FILTERS)[:, : FILTERS // 2] = 0.3
    m, s, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(ids)), max(1, len(ids) // BATCH)):
            g = _gradients(p, [ids[i] for i in batch], toxic[batch])
            t += 1
            for k, grad in g.items():
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.99 * s[k] + 0.01 * grad * grad
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)
            p["e"][0] = 0
    n = len(WIDTHS)
    return Network(kept, p["e"].astype(np.float32), [p[f"f{i}"] for i in range(n)],
                   [p[f"c{i}"].astype(np.float32) for i in range(n)], p["v"], float(p["b"][0]))


def _gradients(p: dict[str, np.ndarray], ids: list[np.ndarray], toxic: np.ndarray) -> dict[str, np.ndarray]:
    flat = np.concatenate(ids)
    ends = np.cumsum([len(i) for i in ids])
    starts = ends - [len(i) for i in ids]
    x = p["e"][flat]
    pooled, places = [], []
    for i, w in enumerate(WIDTHS):
        n = len(flat) - w + 1
        z = x[:n] @ p[f"f{i}"][0]
        for k in range(1, w):
            z += x[k:k + n] @ p[f"f{i}"][k]
        at = np.stack([a + z[a:b - max(WIDTHS) + 1].argmax(0) for a, b in zip(starts, ends)])
        places.append(at)
        pooled.append(np.take_along_axis(z, at, 0) + p[f"c{i}"])
    raw = np.concatenate(pooled, axis=1)
    out = np.maximum(raw, 0)
    err = (1 / (1 + np.exp(-np.clip(out @ p["v"] + p["b"], -30, 30))) - toxic) / len(ids)
    g = {"v": out.T @ err + 1e-4 * p["v"], "b": np.array([err.sum()]), "e": np.zeros_like(p["e"])}
    back = err[:, None] * p["v"] * (raw > 0)
    for i, w in enumerate(WIDTHS):
        d, at = back[:, i * FILTERS:(i + 1) * FILTERS], places[i]
        g[f"c{i}"] = d.sum(0)
        g[f"f{i}"] = np.empty_like(p[f"f{i}"])
        for k in range(w):
            g[f"f{i}"][k] = np.einsum("nfd,nf->df", x[at + k], d) + 1e-4 * p[f"f{i}"][k]
            np.add.at(g["e"], flat[at + k].ravel(), np.einsum("nf,df->nfd", d, p[f"f{i}"][k]).reshape(-1, DIMENSIONS))
    return g


def best_threshold(logits: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The logit that gives the best weighted F1, halfway to the next lower text."""
    order = np.argsort(-logits, kind="stable")
    hit = np.cumsum(weight[order] * toxic[order])
    taken = np.cumsum(weight[order])
    f1 = 2 * hit / (taken + (weight * toxic).sum())
    # Only between texts of different logits.
    f1[:-1][logits[order][:-1] == logits[order][1:]] = -1
    i = int(f1.argmax())
    below = logits[order][i + 1] if i + 1 < len(order) else logits[order][i] - 1
    return float((logits[order][i] + below) / 2)


def train(docs: DataFrame, labels: DataFrame, per_label: int = TRAINING_TEXTS) -> Network | None:
    """A network from at most ``per_label`` labelled texts of each label; None if a label has none.

    ``labels`` has doc_id and toxic (0 or 1; null teaches nothing; a document with both is toxic).
    """
    ship(docs.sparkSession)
    marked = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("toxic").cast("int").alias("toxic"))
    priors = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if set(priors) != {0, 1}:
        return None
    sample = bounded_sample(marked, "toxic", per_label, key=("doc_id",))

    def start():
        def row(doc_id, text, toxic, pick):
            h = hashed_words(text, ALNUM)[0]
            return toxic, pick, h.tobytes() if len(h) <= TRAINING_WORDS else None

        return row

    # The sample's size is bounded by its parameter.
    rows = texts(docs.join(F.broadcast(sample), "doc_id"), F.col("toxic"), F.col("_pick"))
    got = sorted({(r["pick"], r["toxic"], bytes(r["words"])) for r in map_rows(rows, start, "toxic int, pick long, words binary").collect() if r["words"] is not None})
    hashes = [np.frombuffer(w, dtype=np.uint64) for _, _, w in got]
    toxic = np.array([float(t) for _, t, _ in got])
    held = np.arange(len(got)) % CALIBRATION_EVERY == 0
    taught = np.flatnonzero(~held)
    if not {0.0, 1.0} <= set(toxic[taught]):
        return None
    network = fit([hashes[i] for i in taught], toxic[taught])
    tables, languages = network.tables(), Languages()
    checked = np.flatnonzero(held)
    logits = np.array([network.logit(tables, hashes[i]) for i in checked])
    guesses = np.array([languages.guess(hashes[i]) for i in checked])
    truth = toxic[checked]
    sizes = {label: max(1, (truth == label).sum()) for label in (0, 1)}
    weight = np.where(truth == 1, priors[1] / sizes[1], priors[0] / sizes[0])
    if 0 < truth.sum() < len(truth):
        network.threshold = best_threshold(logits, truth, weight)
        for name in sorted(set(guesses)):
            own = guesses == name
            if min((truth[own] == 1).sum(), (truth[own] == 0).sum()) >= LANGUAGE_LEAST:
                network.thresholds[str(name)] = best_threshold(logits[own], truth[own], weight[own])
    return network


def score_documents(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, score, predicted, language) of every whole text of ``docs`` (doc_id, text).

    ``score`` is 0 to 1, ``predicted`` 1 from 0.5 on; ``language`` is the guess that picked the
    threshold, '' without function words. Null and empty texts are scored as texts without
    words; without a network every score is 0. A null doc_id stays null, repeated rows give
    repeated results, other columns are not read.
    """
    ship(docs.sparkSession)
    shared = broadcast_object(docs.sparkSession, network)

    def start():
        net: Network | None = pickle.loads(shared.value)
        tables, languages = net and net.tables(), Languages()

        def row(doc_id, text):
            h = hashed_words(text, ALNUM)[0]
            language = languages.guess(h)
            if net is None:
                return doc_id, 0.0, 0, language
            z = net.logit(tables, h) - net.thresholds.get(language, net.threshold)
            score = float(1 / (1 + np.exp(-np.clip(z, -500, 500))))
            return doc_id, score, int(score >= 0.5), language

        return row

    return map_rows(texts(docs), start, "doc_id long, score double, predicted int, language string")
