"""Licence texts in documents: one suffix automaton of all templates' words, matching statistics, chains.

The automaton holds every run of words of every template, and knows for each run in which
templates it stands, and where. Streaming a text's words through it gives, after each word, the
longest run ending there; the templates of that run, and along the suffix links those of its
ends, have their own longest runs from the same state. Long runs of a template are chained in its
order into covered spans; a template covered well enough labels the text. Of spans that lie in
one another the one that covers more stands for the place.

Words outside all templates and places without any three template words in a row cannot be part
of a long run and are skipped over byte arrays.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .common import broadcast_object, map_rows, ship, texts
from .license_texts import TEMPLATES
from .words import ALNUM, HashSet, hashed_words, windows

# The phrases that always label a text.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Words a run must have to count, and how far apart runs of one chain may lie in the text.
RUN_LEAST, GAP_MOST = 4, 12
# A template labels a text if so much of it, or so many of its words, is covered by one chain.
SHARE_LEAST, WORDS_LEAST = 0.6, 20
# The score of a text that has no chain but a phrase.
PHRASE_SCORE = 0.5


@dataclass
class Automaton:
    """A generalised suffix automaton over words.

    ``held[state]`` tells, for every template that holds an end of the state's runs, how long the
    longest such end is and after how many words of the template it ends (ascending). Only
    ends of RUN_LEAST words or more are told.
    """

    follow: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[dict[int, set[int]]] = field(default_factory=lambda: [{}])
    held: list[dict[int, tuple[int, list[int]]]] = field(default_factory=list)

    def _state(self, follow, link, length) -> int:
        self.follow.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.link) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        clone = self._state(dict(self.follow[q]), self.link[q], self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.follow[p].get(word) == q:
            self.follow[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, template: int, words: list[int]) -> None:
        last = 0
        for end, word in enumerate(words, 1):
            known = self.follow[last].get(word)
            if known is not None:
                last = known if self.length[known] == self.length[last] + 1 else self._split(last, known, word)
            else:
                new = self._state({}, 0, self.length[last] + 1)
                p, last = last, new
                while p >= 0 and word not in self.follow[p]:
                    self.follow[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.follow[p][word]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
            self.ends[last].setdefault(template, set()).add(end)

    def close(self) -> Automaton:
        """After the last template: ends of longer runs are ends of their suffixes, and short suffixes have templates of their own."""
        by_length = sorted(range(1, len(self.link)), key=lambda v: -self.length[v])
        for v in by_length:
            if self.link[v] > 0 and self.length[self.link[v]] >= RUN_LEAST:
                for template, places in self.ends[v].items():
                    self.ends[self.link[v]].setdefault(template, set()).update(places)
        self.held = [{} for _ in self.link]
        for v in reversed(by_length):
            if self.length[v] >= RUN_LEAST:
                self.held[v] = dict(self.held[self.link[v]])
                self.held[v].update({t: (self.length[v], sorted(places)) for t, places in self.ends[v].items()})
        self.ends = []
        return self

    def runs(self, words, offset: int = 0) -> list[tuple[int, int, int, list[int]]]:
        """Maximal runs of each template (template, start, end, ends in the template) of at least RUN_LEAST words, by end."""
        found, state, length = [], 0, 0
        before: dict[int, tuple[int, list[int]]] = {}
        for i, word in enumerate([*words, -2]):
            while state and word not in self.follow[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.follow[state]:
                state, length = self.follow[state][word], length + 1
            else:
                state = length = 0
            now = {t: (min(n, length), places) for t, (n, places) in self.held[state].items()} if length >= RUN_LEAST else {}
            # The run that ended at the previous word could not be prolonged.
            found += [(t, offset + i - n, offset + i, places) for t, (n, places) in before.items() if now.get(t, (0,))[0] <= n]
            before = now
        return found


@dataclass
class Scanner:
    labels: list[str]
    sizes: list[int]
    automaton: Automaton
    vocabulary: HashSet
    triples: HashSet
    phrases: list[tuple[list[int], str]]

    def base(self, h: np.ndarray) -> list[tuple[int, str]]:
        """(word, label) of every place where a phrase's words stand."""
        found = []
        for words, label in self.phrases:
            n = len(h) - len(words) + 1
            if n > 0:
                hit = np.ones(n, dtype=bool)
                for i, word in enumerate(words):
                    hit &= h[i:i + n] == np.uint64(word)
                found += [(int(i), label) for i in np.flatnonzero(hit)]
        return found

    def chains(self, h: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(template, start, end, covered words) of chains of long runs in the text's words."""
        hits = np.flatnonzero(self.triples.has(windows(h, 3)))
        if not len(hits):
            return []
        breaks = np.flatnonzero(np.diff(hits) > 3)
        segments = []
        for a, b in zip(np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(hits) - 1]])):
            begin, end = int(hits[a]), int(hits[b]) + 3
            if end - begin >= RUN_LEAST:
                segments.append((begin, self.vocabulary.index(h[begin:end]).tolist()))
        runs: dict[int, list[tuple[int, int, list[int]]]] = {}
        for begin, words in segments:
            for template, start, end, places in self.automaton.runs(words, begin):
                runs.setdefault(template, []).append((start, end, places))
        return [chain for template, own in sorted(runs.items()) for chain in chained(template, own)]

    def labelled(self, chains: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, int]]:
        """(label, start, end, covered) of the chains that label.

        A chain that lies by more than half in one that covers more words is left out; of equal
        ones the larger share of its template counts, then the earlier template.
        """
        share = {c: c[3] / self.sizes[c[0]] for c in chains}
        good = sorted((c for c in chains if share[c] >= SHARE_LEAST or c[3] >= WORDS_LEAST), key=lambda c: (-c[3], -share[c], c[0], c[1]))
        kept: list[tuple[int, int, int, int]] = []
        for c in good:
            if not any(2 * (min(c[2], k[2]) - max(c[1], k[1])) > c[2] - c[1] for k in kept):
                kept.append(c)
        return sorted((self.labels[t], start, end, covered) for t, start, end, covered in kept)


def chained(template: int, runs: list[tuple[int, int, list[int]]]) -> list[tuple[int, int, int, int]]:
    """(template, start, end, covered) of chains of runs (start, end, places), in the order of the text.

    A run goes on where a chain ended, up to GAP_MOST words later, at its first place behind the
    chain's in the template; where it overlaps the chain only its further words count.
    """
    done, chain = [], []
    for start, end, places in sorted(runs, key=lambda r: (r[0], r[1])):
        if chain:
            new = min(end - start, end - chain[1])
            place = next((p for p in places if p - new >= chain[3]), None)
            if new > 0 and start - chain[1] <= GAP_MOST and place is not None:
                chain[1], chain[2], chain[3] = end, chain[2] + new, place
                continue
            if new <= 0:
                continue
            done.append((template, chain[0], chain[1], chain[2]))
        chain = [start, end, end - start, places[0]]
    if chain:
        done.append((template, chain[0], chain[1], chain[2]))
    return done


def scanner(templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> Scanner:
    hashed = [hashed_words(text.encode(), ALNUM)[0] for _, text in templates]
    vocabulary = HashSet(np.concatenate(hashed), bits=16)
    automaton = Automaton()
    for i, h in enumerate(hashed):
        automaton.add(i, vocabulary.index(h).tolist())
    automaton.close()
    triples = HashSet(np.concatenate([windows(h, 3) for h in hashed]))
    phrase_words = [(hashed_words(p.encode(), ALNUM)[0].tolist(), label) for p, label in phrases.items()]
    return Scanner([label for label, _ in templates], [len(h) for h in hashed], automaton, vocabulary, triples, phrase_words)


def scan(docs: DataFrame, built: Scanner | None = None) -> DataFrame:
    """Licence labels of every whole text of ``docs`` (doc_id, text).

    Returns doc_id, n_words, n_base, first_word, last_word (places of the phrases, null
    without one), base_labels, labels (distinct, sorted, comma-joined, '' without any), score
    (largest share of a template covered by a chain, at least PHRASE_SCORE with a phrase), and
    spans: array of (label, start, end, covered), word offsets of the chains that label. A null
    or empty text has no words, a null doc_id stays null, repeated rows give repeated results,
    other columns are not read.
    """
    ship(docs.sparkSession)
    shared = broadcast_object(docs.sparkSession, built or scanner())

    def start():
        tool: Scanner = pickle.loads(shared.value)

        def row(doc_id, text):
            h = hashed_words(text, ALNUM)[0]
            base = tool.base(h)
            chains = tool.chains(h)
            shares = [covered / tool.sizes[t] for t, _, _, covered in chains]
            spans = tool.labelled(chains)
            base_labels = {label for _, label in base}
            score = min(1.0, max([0.0, *shares, *([PHRASE_SCORE] if base else [])]))
            return (doc_id, len(h), len(base), min(base)[0] if base else None, max(base)[0] if base else None,
                    ",".join(sorted(base_labels)), ",".join(sorted(base_labels | {s[0] for s in spans})), score, spans)

        return row

    return map_rows(texts(docs), start,
                    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
                    "score double, spans array<struct<label: string, start: long, end: long, covered: long>>")
