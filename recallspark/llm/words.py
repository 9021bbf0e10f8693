"""Words of a text as hashes and places, worked out over byte arrays.

A word is a maximal run of bytes of one class. Its hash is a polynomial over a table
of random numbers, so runs of prefix sums give all hashes of a text at once. A text is
read in pieces of ``PIECE`` bytes; a word that crosses pieces is carried over, so memory
is bounded for texts and words of any length.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 18
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def mix_int(h: int) -> int:
    return int(mix(np.array([h & _MASK], dtype=np.uint64))[0])


def byte_table(is_word, fold_case: bool = True) -> np.ndarray:
    """Per byte value a random odd number, 0 for separators; A-Z like a-z if folded."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    if fold_case:
        table[65:91] = table[97:123]
    table[[b for b in range(256) if not is_word(b)]] = 0
    return table


# Words between ASCII white space.
SPACED = byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
# Letters, digits and everything beyond ASCII.
ALNUM = byte_table(lambda b: b >= 0x80 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)


def hashed_words(data: bytes, table: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (64 bits), starts and ends (byte offsets) of the words of ``data``."""
    if len(data) <= PIECE:
        h, s, e = _piece(data, table)
        return mix(h), s, e
    hashes, starts, ends = [], [], []
    carried, length, begin = 0, 0, 0
    for at in range(0, len(data), PIECE):
        h, s, e = _piece(data[at:at + PIECE], table)
        n = min(PIECE, len(data) - at)
        if length:
            if len(s) and s[0] == 0:
                carried = (carried + int(h[0]) * pow(_BASE, length, 1 << 64)) & _MASK
                length += int(e[0])
                whole = e[0] == n
                h, s, e = h[1:], s[1:], e[1:]
            else:
                whole = False
            if not whole:
                hashes.append(np.array([carried], dtype=np.uint64))
                starts.append(np.array([begin]))
                ends.append(np.array([begin + length]))
                length = 0
        if len(e) and e[-1] == n:
            carried, length, begin = int(h[-1]), int(e[-1] - s[-1]), at + int(s[-1])
            h, s, e = h[:-1], s[:-1], e[:-1]
        hashes.append(h)
        starts.append(s + at)
        ends.append(e + at)
    if length:
        hashes.append(np.array([carried], dtype=np.uint64))
        starts.append(np.array([begin]))
        ends.append(np.array([begin + length]))
    return mix(np.concatenate(hashes)), np.concatenate(starts), np.concatenate(ends)


def _piece(data: bytes, table: np.ndarray):
    if not data:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    values = table[np.frombuffer(data, dtype=np.uint8)]
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = values != 0
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values * _UP[:len(data)], out=sums[1:])
    return (sums[ends] - sums[starts]) * _DOWN[starts], starts, ends


def hash_of(word: str, table: np.ndarray = ALNUM) -> int:
    """The hash of one word, as ``hashed_words`` gives it."""
    return int(hashed_words(word.encode(), table)[0][0])


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive words."""
    if len(h) < size:
        return np.zeros(0, dtype=np.uint64)
    n = len(h) - size + 1
    out = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        out = out * np.uint64(0x100000001B3) + h[i:i + n]
    return mix(out)


class HashSet:
    """A fixed set of 64-bit hashes with a quick look-up: slots by low bits, then the full value."""

    def __init__(self, values, bits: int = 20):
        self.keys = np.unique(np.asarray(list(values) if not isinstance(values, np.ndarray) else values, dtype=np.uint64))
        self.low = np.uint64((1 << bits) - 1)
        self.seen = np.zeros(1 << bits, dtype=bool)
        self.seen[self.keys & self.low] = True

    def index(self, h: np.ndarray) -> np.ndarray:
        """Per hash its place in ``keys``, or -1."""
        out = np.full(len(h), -1, dtype=np.int64)
        maybe = np.flatnonzero(self.seen[h & self.low])
        if len(maybe) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
            good = self.keys[at] == h[maybe]
            out[maybe[good]] = at[good]
        return out

    def has(self, h: np.ndarray) -> np.ndarray:
        return self.index(h) >= 0
