"""Secrets in texts: patterns, and character Markov models of random strings and of identifiers.

Two Markov models over character classes' members, one of random strings (secrets), one of
ordinary words and identifiers, are trained from labelled samples of the corpus itself: the
values that the patterns find, and words beside them. A long token whose log-likelihood ratio
per character is high enough is a secret too.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import bounded_sample, broadcast_object, map_rows, ship, texts
from .words import byte_table, hashed_words

# The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "markov")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
# Tokens of at least this length are judged by the models.
TOKEN_LEAST = 20
# So many texts with a pattern's match, and so many without, teach the models.
TRAINING_TEXTS = 400
# What a text teaches: so many strings of each kind it holds, up to so many characters of each; or so many of its
# words, evenly spread over the whole text, up to so many characters of each.
STRINGS_PER_TEXT, STRING_CHARACTERS = 20, 256
WORDS_PER_TEXT, WORD_CHARACTERS = 200, 64
# Added strings of the random kind, so that the model knows every alphabet.
DRAWN = {"hex": "0123456789abcdef", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
         "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"}
DRAWN_STRINGS = 400
# Log-likelihood ratio per character from which a token is a secret.
RATIO_LEAST = 0.5

_TOKEN = byte_table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b in b"+/_=-", fold_case=False)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind as a number, end) of the base kinds, in code points, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST] if _may_assign(text) else []
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST] if "AKIA" in text else []
    # A run of hex digits is one match, so only runs that are long enough need to be found.
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


_SIGNS = re.compile(r"(?:pass|secret|token|api)", re.IGNORECASE | re.ASCII)


def _may_assign(text: str) -> bool:
    return (":" in text or "=" in text) and _SIGNS.search(text) is not None


def _codes(token: bytes) -> np.ndarray:
    return np.frombuffer(token, dtype=np.uint8).astype(np.int64) & 127


@dataclass
class Markov:
    """Log probabilities of a character given the one before; position 0 follows code 0."""

    table: np.ndarray

    @staticmethod
    def fit(strings: list[bytes], smoothing: float = 0.1) -> Markov:
        counts = np.full((128, 128), smoothing)
        for s in strings:
            c = _codes(s)
            np.add.at(counts, (np.concatenate([[0], c[:-1]]), c), 1.0)
        return Markov(np.log(counts / counts.sum(1, keepdims=True)))


def fit(secrets: list[bytes], ordinary: list[bytes], seed: int = 7) -> np.ndarray:
    """The table of log-likelihood ratios, random over ordinary, of a character after another."""
    rng = np.random.default_rng(seed)
    drawn = [bytes(rng.choice(list(letters.encode()), size=32).tolist()) for letters in DRAWN.values() for _ in range(DRAWN_STRINGS)]
    return Markov.fit(secrets + drawn).table - Markov.fit(ordinary or [b"a"]).table


def ratio(table: np.ndarray, token: bytes) -> float:
    c = _codes(token)
    return float(table[np.concatenate([[0], c[:-1]]), c].mean())


def train(docs: DataFrame, texts_per_class: int = TRAINING_TEXTS, strings_per_text: int = STRINGS_PER_TEXT,
          words_per_text: int = WORDS_PER_TEXT) -> np.ndarray:
    """The ratios, learned from at most ``texts_per_class`` texts with and without a base match.

    Each text teaches at most ``strings_per_text`` strings of each kind, or ``words_per_text`` words.
    """
    ship(docs.sparkSession)
    with_match = F.col("text").rlike(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}|(?-i)[0-9a-f]{24}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").withColumn("matched", with_match)
    sample = bounded_sample(rows, "matched", texts_per_class)

    def start():
        def row(matched, pick, text):
            if matched:
                found = [m[2].encode() for m in ASSIGN.finditer(text) if len(m[2]) >= TOKEN_LEAST][:strings_per_text]
                found += [m[0].encode() for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST][:strings_per_text]
                found += [m[0].encode() for m in HEX.finditer(text)][:strings_per_text]
            else:
                data = text.encode()
                _, s, e = hashed_words(data, _TOKEN)
                step = max(1, len(s) // words_per_text)
                found = [data[a:b][:WORD_CHARACTERS] for a, b in zip(s[::step], e[::step])][:words_per_text]
            return matched, pick, [f[:STRING_CHARACTERS] for f in found]

        return row

    got = sorted(map_rows(sample.select("matched", "_pick", "text"), start, "matched boolean, pick long, found array<binary>").collect())
    return fit([bytes(f) for r in got if r["matched"] for f in r["found"]], [bytes(f) for r in got if not r["matched"] for f in r["found"]])


def markov_spans(table: np.ndarray, text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Long tokens that look random and touch no span of ``taken``."""
    data = text.encode()
    _, starts, ends = hashed_words(data, _TOKEN)
    found = []
    for i in np.flatnonzero(ends - starts >= TOKEN_LEAST):
        token = data[starts[i]:ends[i]]
        if ratio(table, token) >= RATIO_LEAST:
            begin = len(data[:starts[i]].decode())
            span = (begin, 3, begin + len(token))
            if not any(s < span[2] and span[0] < e for s, _, e in taken):
                found.append(span)
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, table: np.ndarray, redact: bool = False, whole: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_assign, n_access, n_hex, n_markov, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, in order of start, then kind; base
    spans are those of the patterns. With ``redact`` also ``redacted``, the text with each
    covered stretch replaced by [SECRET]. A null or empty text has no spans (``redacted`` of a
    null text is null), a null doc_id stays null, repeated rows give repeated results, other
    columns are not read, but with ``whole`` come back in the column ROW. Token scores look at single tokens, so texts may be of any length.
    """
    ship(docs.sparkSession)
    shared = broadcast_object(docs.sparkSession, table)

    def start():
        ratios = pickle.loads(shared.value)

        def row(doc_id, text, *missing):
            base = base_spans(text)
            spans = sorted(base + markov_spans(ratios, text, base))
            counts = [sum(k == kind for _, k, _ in spans) for kind in range(len(KINDS))]
            out = (doc_id, *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans))
            return out + (None if missing[0] else covered(text, spans),) if missing else out

        return row

    more = [F.col("text").isNull().alias("missing")] if redact else []
    return map_rows(texts(docs, *more, binary=False, whole=whole), start,
                    "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string"
                    + (", redacted string" if redact else ""))


def covered(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every maximal stretch that spans cover replaced by ``mark``."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:] if spans else text
