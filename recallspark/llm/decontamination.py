"""Benchmark passages in documents, also with other numbers, names and units.

Texts become templates: numbers, names and units are typed placeholders, everything else is a
literal word. Characters of scripts without spaces are words. Runs of template words (windows) of
the documents meet those of the benchmark in a hash join; so do runs of the words themselves,
whatever their kind, so that a word-for-word copy is found also where most words are placeholders.
Only document windows that pass a bit map of the benchmark's hashes, of bounded size, travel to
the join. The windows of one document that lie along an item in one shift are an alignment, which
is never larger than the item. In an alignment each value of the item must stand for one value of
the document and the other way round; windows that hold a value that breaks this do not count,
unless they are word for word the item's.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.sizing import small_side
from .common import ROW, broadcast_object, map_rows, record_batch, schema_of, ship, slices, stored, texts
from .words import ALNUM, HashSet, hashed_words, mix, windows

WINDOW = 8
# A shorter item is one window. Items of fewer words are reported apart: they stand in many clean texts.
ITEM_LEAST = 4
# Literal words a window must have to match with other values.
LITERAL_SHARE = 0.5
# An item is found if so many of its words, or this share of them, line up.
WORDS_LEAST, SHARE_LEAST = 13, 0.5
# Bits of the map of window hashes: so many per window, within these powers of two; and bits that stand for one hash.
BITS_PER_WINDOW, BITS_LEAST, BITS_MOST = 64, 20, 27
PROBES = 4
# A map of fewer bits than this is looked up in bytes.
SPREAD_BYTES = 1 << 22
# Window rows a task writes at a time.
ROWS_OUT = 4096

LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3
# Units and number words.
UNITS = ("mm cm m km inch inches foot feet ft yard yards mile miles mg g kg ton tons gram grams ounce ounces pound pounds lb "
         "ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month "
         "months year years dollar dollars cent cents euro euros usd eur percent degrees celsius fahrenheit mph kmh")
NUMBERS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
           "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion")

_CLASS = np.zeros(256, dtype=np.int8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 1, 2, 3, 3
_ENDS_SENTENCE = np.zeros(256, dtype=bool)
_ENDS_SENTENCE[[ord(c) for c in ".?!:;|\"\n"]] = True
# Characters of scripts without spaces, each a word, and their punctuation.
_UNSPACED = re.compile("[\u0e00-\u109f\u1780-\u17ff\u1950-\u19ff\u1a20-\u1aaf\u1b00-\u1b7f\u2e80-\ua4cf\ua980-\ua9df\uaa60-\uaadf"
                       "\uf900-\ufaff\uff10-\uffef\U00020000-\U0003ffff]+")
_MARKS = re.compile("[\u3000-\u3004\u3008-\u3020\u3030\u303d\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]+")


def _set(words: str) -> HashSet:
    return HashSet(np.array([hashed_words(w.encode(), ALNUM)[0][0] for w in words.split()], dtype=np.uint64), bits=16)


def _lower(data: bytes) -> bytes:
    """The text in lower case, unless that would move its bytes."""
    if data.isascii():
        return data
    lowered = data.decode().lower().encode()
    return lowered if len(lowered) == len(data) else data


def _spaced(data: bytes) -> bytes:
    """The text with spaces around every character of a script that has none."""
    if data.isascii():
        return data
    return _UNSPACED.sub(lambda m: f" {' '.join(m[0])} ", _MARKS.sub(" ", data.decode())).encode()


@dataclass
class Template:
    """The template words of a text: hashes, kinds, and the hashes of what stood there."""

    words: np.ndarray
    kinds: np.ndarray
    values: np.ndarray


class Canonical:
    def __init__(self):
        self.units, self.numbers = _set(UNITS), _set(NUMBERS)
        self.marks = mix(np.arange(1, 5, dtype=np.uint64) << np.uint64(32))

    def template(self, data: bytes) -> Template:
        data = _spaced(data)
        h, starts, ends = hashed_words(_lower(data), ALNUM)
        if not len(h):
            return Template(h, np.zeros(0, dtype=np.int8), h)
        b = np.frombuffer(data, dtype=np.uint8)
        kinds = np.zeros(len(h), dtype=np.int8)
        first, last = _CLASS[b[starts]], _CLASS[b[ends - 1]]
        capital = np.flatnonzero(first == 2)
        # A capital with a small letter after it, inside a sentence, begins a name.
        second = _CLASS[b[np.minimum(starts[capital] + 1, len(b) - 1)]]
        before = np.maximum(starts[capital] - 1, 0)
        earlier = np.maximum(starts[capital] - 2, 0)
        opens = (starts[capital] == 0) | _ENDS_SENTENCE[b[before]] | ((b[before] <= 32) & _ENDS_SENTENCE[b[earlier]]) | (starts[capital] == 1)
        kinds[capital[(second == 3) & ~opens]] = NAME
        number = (first == 1) & (last == 1)
        kinds[number] = NUMBER
        kinds[self.numbers.has(h)] = NUMBER
        kinds[self.units.has(h)] = UNIT
        # Digits around a point or comma are one number.
        tied = np.zeros(len(h), dtype=bool)
        at = np.flatnonzero(number[1:] & number[:-1] & (starts[1:] - ends[:-1] == 1))
        between = b[ends[at]]
        tied[at[(between == 44) | (between == 46)] + 1] = True
        values = h
        if tied.any():
            heads = np.flatnonzero(~tied)
            values = np.bitwise_xor.reduceat(np.where(tied, mix(h), h), heads)
            kinds = kinds[heads]
            h = h[heads]
        words = np.where(kinds == LITERAL, h, self.marks[kinds])
        return Template(words, kinds, values)


def window_keys(t: Template, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per window of so many words: the hash of its template, whether that may be used, and the hash of its own words.

    A template is used if enough of it is literal and something in it is not.
    """
    template, exact = windows(t.words, size), windows(t.values, size)
    if not len(template):
        return template, np.zeros(0, dtype=bool), exact
    literal = np.concatenate([[0], np.cumsum(t.kinds == LITERAL)])
    usable = (literal[size:] - literal[:-size] >= size * LITERAL_SHARE) & (template != exact)
    return template ^ _SALTS[size], usable, exact ^ _SALTS[size]


# Windows of different sizes have different hashes.
_SALTS = mix(np.arange(1, WINDOW + 2, dtype=np.uint64))


def _one_to_one(pairs: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """The pairs that map values one to one: of pairs that share a value the most frequent one, or the first."""
    counts: dict[tuple[int, int], int] = {}
    for pair in pairs:
        counts[pair] = counts.get(pair, 0) + 1
    left, right, kept = set(), set(), set()
    for a, b in sorted(counts, key=lambda pair: -counts[pair]):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            kept.add((a, b))
    return kept


def covered(values: np.ndarray, kinds: np.ndarray, size: int, places: list[int], found: list[list[int]]) -> tuple[list[int], bool]:
    """Words of an item that one alignment covers, and whether all of them have the item's values.

    ``places`` are starts of the item's windows that matched, ``found`` the document's values there.
    """
    theirs = dict(pair for p, own in zip(places, found) for pair in zip(range(p, p + size), own))
    spots = sorted(theirs)
    there = np.array(spots)
    mine, other = values[there], np.array([theirs[s] for s in spots], dtype=np.int64)
    if np.array_equal(mine, other):
        return spots, True
    slots = kinds[there] != LITERAL
    pairs = list(zip(mine[slots].tolist(), other[slots].tolist()))
    kept = _one_to_one(pairs)
    broken = {s for s, pair in zip(there[slots].tolist(), pairs) if pair not in kept}
    changed = set(there[mine != other].tolist())
    stands = (range(p, p + size) for p in places)
    return sorted({s for w in stands if broken.isdisjoint(w) or changed.isdisjoint(w) for s in w}), False


def _items(benchmark: DataFrame) -> DataFrame:
    """The distinct texts of a benchmark: (text_no, size, values, kinds, windows of (key, place))."""
    distinct = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("text").cast("binary").alias("text")).distinct()
    numbered = stored(distinct.withColumn("text_no", F.monotonically_increasing_id()))

    def start():
        canonical = Canonical()

        def row(text_no, text):
            t = canonical.template(text)
            size = min(WINDOW, len(t.words))
            if not size:
                return text_no, text, 0, [], [], []
            keys, usable, exact = window_keys(t, size)
            entries = [(int(k), i) for i, k in enumerate(exact.view(np.int64))]
            if len(t.words) >= ITEM_LEAST:
                entries += [(int(k), int(i)) for i, k in zip(np.flatnonzero(usable), keys.view(np.int64)[usable])]
            return text_no, text, size, t.values.view(np.int64).tolist(), t.kinds.tolist(), entries

        return row

    return stored(map_rows(numbered.select("text_no", "text"), start, "text_no long, text binary, size int, values array<long>, "
                           "kinds array<int>, windows array<struct<key: long, place: int>>"))


@dataclass
class Filter:
    """Bits at PROBES places of every window hash of a benchmark, the window sizes there are, and the words of its longest item."""

    bits: np.ndarray
    sizes: list[int]
    longest: int
    # A small map with a byte for each bit, made where it is used.
    spread: np.ndarray | None = None

    @staticmethod
    def of(items: DataFrame) -> Filter:
        told = items.agg(F.sum(F.size("windows")).alias("n"), F.max(F.size("values")).alias("longest"), F.collect_set("size").alias("sizes")).first()
        power = int(np.clip(np.ceil(np.log2(max(1, told["n"] or 0) * BITS_PER_WINDOW)), BITS_LEAST, BITS_MOST))
        size = F.lit(1 << power)
        step = F.pmod(F.shiftrightunsigned("key", 32), size).bitwiseOR(F.lit(1))
        keys = items.select(F.explode("windows.key").alias("key"))
        places = keys.select(F.explode(F.array(*[F.pmod(F.pmod("key", size) + step * i, size) + 1 for i in range(PROBES)])).alias("at"))
        maps = places.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
        bits = np.zeros((1 << power) // 8, dtype=np.uint8)
        for r in maps.collect():
            part = np.frombuffer(r["bits"], dtype=np.uint8)
            bits[(r["bucket"] - 1) * len(part):r["bucket"] * len(part)] = part
        return Filter(bits, sorted(s for s in told["sizes"] if s), told["longest"] or 0)

    def has(self, keys: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.bits) * 8 - 1)
        at = (keys & mask).astype(np.int64)
        out = self._bits(at) > 0
        may = np.flatnonzero(out)
        if len(may):
            step = ((keys[may] >> np.uint64(32)) & mask).astype(np.int64) | 1
            good = np.ones(len(may), dtype=bool)
            for i in range(1, PROBES):
                good &= self._bits((at[may] + step * i) & int(mask)) > 0
            out[may] = good
        return out

    def _bits(self, at: np.ndarray) -> np.ndarray:
        if len(self.bits) > SPREAD_BYTES // 8:
            return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        if self.spread is None:
            self.spread = np.unpackbits(self.bits, bitorder="little")
        return self.spread[at]

    def hits(self, t: Template) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, places, keys) of the windows of a text that may be the benchmark's."""
        for size in self.sizes:
            keys, usable, exact = window_keys(t, size)
            for own, may in ((exact, self.has(exact)), (keys, usable & self.has(keys))):
                at = np.flatnonzero(may)
                if len(at):
                    yield size, at, own[at]


def repeating(values: np.ndarray, margin: int) -> np.ndarray:
    """Words inside a stretch that repeats every few words, more than ``margin`` words from its ends.

    What lines up there lines up with the same values nearer the stretch's ends.
    """
    out = np.zeros(len(values), dtype=bool)
    for period in range(1, WINDOW + 1):
        if len(values) <= 2 * margin + period:
            break
        same = np.concatenate([np.zeros(period, dtype=bool), values[period:] == values[:-period], [False]])
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same]).astype(np.int8)))
        for begin, end in zip(edges[::2], edges[1::2]):
            out[begin + margin:max(begin + margin, end - margin)] = True
    return out


def _stretches(docs: DataFrame, shared) -> DataFrame:
    """Per document the stretches of words in windows that may be the benchmark's, as bytes of arrays."""
    def start():
        known, canonical = pickle.loads(shared.value), Canonical()

        def row(doc_id, text):
            t = canonical.template(text)
            found = [(size, at) for size, at, _ in known.hits(t)]
            if not found:
                return doc_id, []
            change = np.zeros(len(t.words) + 1, dtype=np.int64)
            for size, at in found:
                change[at] += 1
                np.subtract.at(change, at + size, 1)
            inside = np.cumsum(change)[:-1] > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
            return doc_id, [(int(a), t.words[a:b].tobytes(), t.values[a:b].tobytes(), t.kinds[a:b].tobytes())
                            for a, b in zip(edges[::2], edges[1::2])]

        return row

    return map_rows(docs, start, "doc_id long, stretches array<struct<start: long, words: binary, values: binary, kinds: binary>>")


def _windows(stretches: DataFrame, shared) -> DataFrame:
    """(number, key, at, values): the windows of stretches (number, start, words, values, kinds) that may be the benchmark's."""
    schema = schema_of("number long, key long, at long, values array<long>")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(shared.value)
        for batch in batches:
            for part in slices(batch):
                out = []
                for number, start, words, values, kinds in zip(*(c.to_pylist() for c in part.columns)):
                    t = Template(np.frombuffer(words, dtype=np.uint64), np.frombuffer(kinds, dtype=np.int8), np.frombuffer(values, dtype=np.uint64))
                    own, skip = t.values.view(np.int64), repeating(t.values, 2 * (known.longest + WINDOW))
                    for size, places, keys in known.hits(t):
                        for at, key in zip(places[~skip[places]].tolist(), keys.view(np.int64)[~skip[places]].tolist()):
                            out.append((number, key, start + at, own[at:at + size].tolist()))
                            if len(out) >= ROWS_OUT:
                                yield record_batch(out, arrow)
                                out = []
                yield record_batch(out, arrow)

    return stretches.mapInArrow(run, schema)


def _spots(aligned: DataFrame) -> DataFrame:
    """(number, text_no, spots, same) of every alignment."""
    def start():
        def row(number, text_no, size, values, kinds, lines):
            spots, same = covered(np.array(values, dtype=np.int64), np.array(kinds, dtype=np.int8), size,
                                  [x["place"] for x in lines], [x["values"] for x in lines])
            return number, text_no, spots, same

        return row

    return map_rows(aligned, start, "number long, text_no long, spots array<int>, same boolean")


def find_leaks(docs: DataFrame, benchmark: DataFrame, whole: bool = False) -> DataFrame:
    """Benchmark items in every whole text of ``docs`` (doc_id, text); ``benchmark`` has item_id and text.

    Returns doc_id, contaminated, n_items, n_exact (items found with the same values), items
    (sorted item_ids), share (the largest share of an item's words that lines up, 0 without
    any), and short_items: items of fewer than ITEM_LEAST words that stand in the text word for
    word, which say nothing about a leak and do not contaminate.

    No part of the benchmark but a bit map of at most 16 MB passes the driver. A null or empty text
    holds nothing; items that are null or without a word add nothing, those with the same text
    are looked for once; an empty benchmark finds nothing. A null doc_id stays null, repeated
    rows give repeated results, other columns are not read, but with ``whole`` come back in the
    column ROW. Words inside a long stretch of a document that repeats itself add nothing to what
    its ends show, and are left out.
    """
    ship(docs.sparkSession)
    items = _items(benchmark)
    shared = broadcast_object(docs.sparkSession, Filter.of(items))
    # The numbers of the rows are fixed when they are written.
    held = stored(_stretches(texts(docs, whole=whole), shared).withColumn("number", F.monotonically_increasing_id()))
    near = held.where(F.size("stretches") > 0).select("number", F.explode("stretches").alias("s")).select(
        "number", "s.start", "s.words", "s.values", "s.kinds")
    places = items.select("text_no", F.explode("windows").alias("w")).select("text_no", "w.key", "w.place")
    met = _windows(near, shared).join(small_side(places), "key").select(
        "number", "text_no", (F.col("at") - F.col("place")).alias("shift"), "place", "values")
    # At most one window of each place and kind of key: no list is longer than the item.
    lines = met.groupBy("number", "text_no", "shift").agg(F.array_sort(F.collect_set(F.struct("place", "values"))).alias("lines"))
    known = items.select("text_no", "size", F.col("values").alias("item_values"), "kinds")
    aligned = lines.join(small_side(known), "text_no").select("number", "text_no", "size", "item_values", "kinds", "lines")
    spots = _spots(aligned).select("number", "text_no", "same", F.explode("spots").alias("spot"))
    words = spots.groupBy("number", "text_no", "spot").agg(F.max("same").alias("same"))
    counted = words.groupBy("number", "text_no").agg(F.count("*").alias("words"), F.min("same").alias("same"))
    sized = items.select("text_no", F.size("values").alias("size"))
    enough = counted.join(small_side(sized), "text_no").where(
        (F.col("words") >= WORDS_LEAST) | (F.col("words") >= F.col("size") * SHARE_LEAST))
    of_text = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).distinct()
    named = items.select("text_no", "text").join(of_text, "text").select("text_no", "item_id")
    long_enough = F.col("size") >= ITEM_LEAST
    found = enough.join(small_side(stored(named)), "text_no").groupBy("number").agg(
        F.array_sort(F.collect_set(F.when(long_enough, F.col("item_id")))).alias("items"),
        F.array_sort(F.collect_set(F.when(long_enough & F.col("same"), F.col("item_id")))).alias("exact"),
        F.array_sort(F.collect_set(F.when(~long_enough & F.col("same"), F.col("item_id")))).alias("short_items"),
        F.max(F.when(long_enough, F.col("words") / F.col("size"))).alias("share"))
    none = F.expr("CAST(array() AS array<long>)")
    listed = {c: F.coalesce(c, none) for c in ("items", "exact", "short_items")}
    return held.join(small_side(stored(found)), "number", "left").select(
        "doc_id", (F.size(listed["items"]) > 0).alias("contaminated"), F.size(listed["items"]).cast("long").alias("n_items"),
        F.size(listed["exact"]).cast("long").alias("n_exact"), listed["items"].alias("items"),
        F.coalesce("share", F.lit(0.0)).alias("share"), listed["short_items"].alias("short_items"), *([ROW] if whole else []))
