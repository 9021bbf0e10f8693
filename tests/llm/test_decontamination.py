"""Benchmark passages against brute force over all pairs, and by hand."""

import random

import numpy as np
import pytest

import corpus
from recallspark.llm import decontamination as leaks
from recallspark.llm.common import ROW


def table(spark, items):
    return spark.createDataFrame([i if isinstance(i, tuple) else (n, i) for n, i in enumerate(items, 1)], "item_id long, text string")


def found(spark, items, texts):
    """Per text (items, items with the same values, short items, words that line up most)."""
    rows = leaks.find_leaks(corpus.documents(spark, texts), table(spark, items)).collect()
    return [(r["items"], r["n_exact"], r["short_items"], r["share"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def matches(t, own):
    """(words that line up, with the same values) of one item in one text: every shift, every window, word by word."""
    size = min(leaks.WINDOW, len(own.words))
    spots, exact = set(), set()
    for shift in range(-len(own.words), len(t.words)):
        places = []
        for p in range(len(own.words) - size + 1):
            d = p + shift
            if d < 0 or d + size > len(t.words):
                continue
            same = list(own.values[p:p + size]) == list(t.values[d:d + size])
            literal = sum(k == leaks.LITERAL for k in own.kinds[p:p + size])
            alike = len(own.words) >= leaks.ITEM_LEAST and list(own.words[p:p + size]) == list(t.words[d:d + size]) and size * leaks.LITERAL_SHARE <= literal < size
            if same or alike:
                places.append(p)
        words = sorted({w for p in places for w in range(p, p + size)})
        pairs = [(int(own.values[w]), int(t.values[w + shift])) for w in words if own.kinds[w] != leaks.LITERAL]
        left, right, kept = {}, {}, set()
        for a, b in sorted(dict.fromkeys(pairs), key=lambda x: -pairs.count(x)):
            if left.setdefault(a, b) == b and right.setdefault(b, a) == a:
                kept.add((a, b))
        for p in places:
            run = range(p, p + size)
            values = [(int(own.values[w]), int(t.values[w + shift])) for w in run]
            fits = all(own.kinds[w] == leaks.LITERAL or v in kept for w, v in zip(run, values))
            if fits or all(a == b for a, b in values):
                spots |= set(run)
        if words and all(own.values[w] == t.values[w + shift] for w in words):
            exact |= set(words)
    return len(spots), bool(spots) and spots <= exact


def brute(items, texts):
    canonical = leaks.Canonical()
    out = []
    for text in texts:
        t, rows = canonical.template((text or "").encode()), []
        for n, item in enumerate(items, 1):
            own = canonical.template((item or "").encode())
            words, same = matches(t, own)
            if words and (words >= leaks.WORDS_LEAST or words >= leaks.SHARE_LEAST * len(own.words)):
                rows.append((n, same, words / len(own.words), len(own.words) >= leaks.ITEM_LEAST))
        whole = [r for r in rows if r[3]]
        out.append(([r[0] for r in whole], sum(r[1] for r in whole), [r[0] for r in rows if not r[3] and r[1]], max([r[2] for r in whole], default=0.0)))
    return out


def test_like_brute_force(spark):
    rng = random.Random(1)
    words = "the sum of and price from box Anna Peter Maria 3 5 7 12 km kg dollars apples red how many left then".split()

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    items = [text(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 14, 25, 40])) for _ in range(40)] + ["a a a a a a a a a a", "", None]
    texts = [text(rng.randint(0, 60)) for _ in range(30)] + [None, "", "a " * 50]
    for _ in range(40):
        own = rng.choice([i for i in items if i and len(i.split()) > 3]).split()
        part = [rng.choice(words) if rng.random() < rng.choice([0, 0, 0.1]) else w for w in own[rng.randrange(len(own)) // 3:]]
        # Other values of the same kinds, now and then one for two.
        kinds = (["Anna", "Peter", "Maria", "Olaf"], ["3", "5", "7", "12", "8"], ["km", "kg", "dollars", "cm"])
        mapped = {w: rng.choice(kind) for kind in kinds for w in kind} if rng.random() < 0.7 else {}
        texts.append(f"{text(8)} {' '.join(mapped.get(w, w) for w in part)} {text(5)}")
    expected = brute(items, texts)
    assert found(spark, items, texts) == expected
    assert sum(bool(e[0]) for e in expected) > 20 and sum(e[1] < len(e[0]) for e in expected) > 5


def test_leaks(spark):
    item = "Maria bought 12 apples for 3.50 dollars and gave Peter half of the apples before lunch. How many apples remain with Maria?"
    other = "In the garden stood 7 old trees that carried sweet red fruit all summer long until the rain came."
    changed = item.replace("12", "18").replace("Maria", "Sandra").replace("Peter", "Olaf").replace("dollars", "euros").replace("3.50", "4,75")
    # One name of the item stands for two in the document.
    broken = item.replace("with Maria", "with Paula").replace("Maria", "Sandra")
    texts = [f"{corpus.prose(30, 1)} {item} {corpus.prose(30, 2)}", changed, item.upper(), corpus.prose(300, 3), "1 2 3 4 5 6 7 8 9 10", broken,
             " ".join(other.split()[:5]), other + " " + item]
    rows = found(spark, [(1, item), (2, other), (3, "1 2 3 4 5 6 7 8 9"), (4, None), (9, other), (9, other), (None, item)], texts)
    assert [r[0] for r in rows] == [[1], [1], [1], [], [3], [1], [], [1, 2, 9]]
    assert [r[1] for r in rows][:3] == [1, 0, 1]


def test_slots_map_one_to_one(spark):
    item = "the sum of 5 and 5 is taken from the sum of 7 and 9 today"
    same, partly = "the sum of 6 and 6 is taken from the sum of 2 and 4 today", "the sum of 6 and 8 is taken from the sum of 2 and 4 today"
    assert found(spark, [item], [same, partly]) == [([1], 0, [], 1.0), ([1], 0, [], 10 / 16)]
    kinds = leaks.Canonical().template(same.encode()).kinds
    assert np.count_nonzero(kinds == leaks.NUMBER) == 4


def test_broken_slots_cost_only_their_windows(spark):
    words = corpus.prose(50, 7).split()

    def text(a, b):
        return " ".join(words[:3] + [a] + words[3:25] + [b] + words[25:])

    # The first of two pairs that share a value stands, the second costs the windows that hold it.
    texts = [text("5", "7"), text("6", "6"), text("5", "5")]
    assert [r[1:] for r in found(spark, [text("5", "5")], texts)] == [(0, [], 51 / 52), (0, [], 1.0), (1, [], 1.0)]
    assert [r[1:] for r in found(spark, [text("3", "4").upper()], texts)] == [(0, [], 1.0), (0, [], 51 / 52), (0, [], 51 / 52)]


def test_word_for_word(spark):
    """Copies of items of few literal words or no spaces."""
    items = ["What is 12 + 7 * 3?", "Sort 9 km 4 cm 8 mm 2 inches 7 feet 5 yards by length", "玩具每个三元，买五个要多少钱？"]
    texts = [f"So it goes, {items[0]} and on", f"So it goes, {items[1]} and on", f"今天{items[2]}我们回家"]
    others = ["What is 13 + 8 * 4?", "Sort 9 km 5 cm 8 mm 3 inches 7 feet 6 yards by length", "今天我们回家"]
    rows = found(spark, items, texts + others)
    assert [r[:2] for r in rows] == [([1], 1), ([2], 1), ([3], 1), ([], 0), ([], 0), ([], 0)]


def test_items_of_few_words_do_not_contaminate(spark):
    """They are told apart: a text with the word "yes" is no leak of the item "yes"."""
    items = ["yes", "Name Peter", "3 5 8", "no way"]
    texts = ["I said yes to that", "now name Peter again, yes!", "3 5 8", "Name Paul", corpus.prose(50, 1)]
    rows = leaks.find_leaks(corpus.documents(spark, texts), table(spark, items)).orderBy("doc_id").collect()
    assert [r["short_items"] for r in rows] == [[1], [1, 2], [3], [], []]
    assert not any(r["contaminated"] or r["n_items"] or r["items"] for r in rows)


def test_repetition_is_cut_short(spark):
    """A long run of one word, or of a few in turn, meets an item of the same words without all its alignments."""
    item = "ha " * 30
    other = "tick tock " * 15
    texts = ["ha " * 20_000 + "end", "tick tock " * 10_000, "ha " * 5]
    assert [r[0] for r in found(spark, [item, other], texts)] == [[1], [2], []]
    values = np.array([1, 2] * 500 + [3] + [4] * 500)
    skipped = leaks.repeating(values, 50)
    assert not skipped[:52].any() and skipped[60:940].all() and not skipped[960:1040].any() and skipped[1060:1440].all() and not skipped[1460:].any()


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """With a bit map too small for the benchmark all windows travel, and the result is the same."""
    items = [corpus.prose(20, i) for i in range(60)]
    texts = [corpus.prose(20, 500 + i) + " " + items[i % 30] for i in range(20)] + [corpus.prose(100, 900)]
    whole = found(spark, items, texts)
    assert all(r[0] for r in whole[:20]) and not whole[20][0]
    monkeypatch.setattr(leaks, "BITS_LEAST", 15)
    monkeypatch.setattr(leaks, "BITS_MOST", 15)
    monkeypatch.setattr(leaks.Filter, "has", lambda self, keys: np.ones(len(keys), dtype=bool))
    assert found(spark, items, texts) == whole


@pytest.mark.parametrize("items", [[], [(None, "a b c d e")], [(1, None), (2, ""), (3, " ?! ")]])
def test_nothing_to_look_for(spark, items):
    rows = leaks.find_leaks(corpus.odd_documents(spark), table(spark, items), whole=True).collect()
    assert len(rows) == len(corpus.odd_rows()) and not any(r["contaminated"] for r in rows)
    assert sorted(str(r[ROW]) for r in rows) == sorted(map(str, corpus.odd_documents(spark).collect()))
