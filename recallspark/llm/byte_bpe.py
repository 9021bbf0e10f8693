"""Byte-level BPE: encoding as a reduction over a tree of byte ranges, decoding up the same tree.

Token lists of adjacent byte ranges form a monoid: joining two of them re-encodes a window
around the seam and widens it until the tokens outside stay. They provably stay when, at both
rims of the window, the two tokens that meet there are the encoding of their own joined bytes:
a token list is the encoding of its bytes exactly if that holds for every neighbouring pair.
"""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import DataFrame, functions as F

from .common import map_rows, ship, texts

# Byte ranges up to this length are merged directly; longer ones are halved.
LEAF_BYTES = 48
# Encoded pieces a worker remembers, twice: the recent ones and those before them.
CACHED_PIECES = 200_000
CACHED_BYTES = 64
CACHED_PAIRS = 500_000
# Above every rank.
NONE = 1 << 40

# The classes of the vocabularies' pattern within Latin-1, where they are the same in all Unicode versions.
LATIN = {r"\p{L}": r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"\p{N}": r"0-9\xb2\xb3\xb9\xbc-\xbe",
         r"\s": r"\t-\r\x20\x85\xa0"}


def load_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a line holds a token in base64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Codec:
    """Encoding and decoding with one table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.size = max(self.bytes_of) + 1
        self._merged: dict[int, int] = {}
        self._pairs: dict[int, bool] = {}

    def merged(self, left: int, right: int) -> int:
        """The token of both tokens' bytes, or NONE."""
        key = left * self.size + right
        token = self._merged.get(key)
        if token is None:
            if len(self._merged) >= CACHED_PAIRS:
                self._merged.clear()
            token = self._merged[key] = self.ranks.get(self.bytes_of[left] + self.bytes_of[right], NONE)
        return token

    def leaf(self, data: bytes) -> list[int]:
        """Merges the lowest-ranked neighbouring pair, leftmost first, until none is in the table."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        ids = [self.single[b] for b in data]
        merged = self.merged
        scores = list(map(merged, ids, ids[1:]))
        while scores:
            best = min(scores)
            if best == NONE:
                break
            i = scores.index(best)
            ids[i:i + 2] = [best]
            del scores[i]
            if i < len(scores):
                scores[i] = merged(best, ids[i + 1])
            if i:
                scores[i - 1] = merged(ids[i - 1], best)
        return ids

    def stays(self, left: int, right: int) -> bool:
        """Whether the bytes of two tokens, encoded together, are these two tokens."""
        key = left * self.size + right
        known = self._pairs.get(key)
        if known is None:
            known = self.leaf(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            if len(self._pairs) >= CACHED_PAIRS:
                self._pairs.clear()
            self._pairs[key] = known
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both byte ranges together, from the encodings of each."""
        if not left or not right or self.stays(left[-1], right[0]):
            return left + right
        i = j = 2
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            middle = self.leaf(b"".join(map(self.bytes_of.__getitem__, left[len(left) - i:] + right[:j])))
            left_ok = i == len(left) or self.stays(left[len(left) - i - 1], middle[0])
            right_ok = j == len(right) or self.stays(middle[-1], right[j])
            if left_ok and right_ok:
                return left[:len(left) - i] + middle + right[j:]
            i, j = (i if left_ok else 2 * i), (j if right_ok else 2 * j)

    def encode(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.leaf(data) if data else []
        half = len(data) // 2
        return self.join(self.encode(data[:half]), self.encode(data[half:]))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 1024:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def splitter(pattern: str):
    """The function that splits a text into the matches of ``pattern``.

    White space is Unicode's White_Space. Texts of Latin-1 characters, the most, take an
    equal pattern with the classes spelled out, which the standard library matches faster.
    """
    import re

    import regex

    spaces = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
    general, latin = regex.compile(spaces).findall, pattern.replace(r"\S", r"[^\s]")
    for name, members in LATIN.items():
        latin = re.sub(r"(\[[^\]]*)" + re.escape(name), lambda m: m[1] + members, latin)
        latin = re.sub(r"(\[[^\]]*)" + re.escape(name), lambda m: m[1] + members, latin)
        latin = latin.replace(name, f"[{members}]")
    quick = re.compile(latin).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return general(text)
        return quick(text)

    return split


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, keep_ids: bool = False,
                     whole: bool = False) -> DataFrame:
    """Token ids of every whole text, and the check that they decode to it.

    Args: ``docs`` with doc_id and text; ``vocabulary``: path of a rank file readable by the
    driver (it travels to the tasks with the code: its size is that of the vocabulary);
    ``pattern``: the regular expression whose matches are encoded one by one.

    Returns (doc_id, n_tokens, ids_sha256, decoded_sha256), with ``keep_ids`` also ids
    (array of int), with ``whole`` also the input rows in the column ROW. A null or empty text has no tokens; a null
    doc_id stays null; repeated rows give repeated results; other columns are ignored.
    """
    ship(docs.sparkSession)
    with open(vocabulary, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def start():
        codec, find = Codec(load_ranks(shared.value)), splitter(pattern)
        recent: dict[str, tuple[int, str, bytes, list[int] | None]] = {}
        before: dict[str, tuple[int, str, bytes, list[int] | None]] = {}

        def piece(text: str):
            nonlocal recent, before
            found = before.get(text)
            if found is None:
                data = text.encode()
                ids = codec.encode(data)
                found = (len(ids), ",".join(map(str, ids)), codec.decode(ids), ids if keep_ids else None)
                if len(data) > CACHED_BYTES:
                    return found
            if len(recent) >= CACHED_PIECES:
                recent, before = {}, recent
            recent[text] = found
            return found

        def row(doc_id, text):
            get = recent.get
            found = [get(p) or piece(p) for p in find(text)]
            digest = hashlib.sha256(",".join([f[1] for f in found]).encode()).hexdigest()
            decoded = b"".join([f[2] for f in found])
            out = (doc_id, sum([f[0] for f in found]), digest, hashlib.sha256(decoded).hexdigest())
            return out + ([i for f in found for i in f[3]],) if keep_ids else out

        return row

    more = ", ids array<int>" if keep_ids else ""
    return map_rows(texts(docs, binary=False, whole=whole), start,
                    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + more)


def decode_documents(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) of ``tokens`` (doc_id, ids: array of int): the bytes of the ids, end to end, as UTF-8.

    Null ids are a null text, no ids an empty one; an id that the vocabulary lacks is an error;
    bytes that are not UTF-8 become U+FFFD.
    """
    ship(tokens.sparkSession)
    with open(vocabulary, "rb") as file:
        shared = tokens.sparkSession.sparkContext.broadcast(file.read())

    def start():
        codec = Codec(load_ranks(shared.value))

        def row(doc_id, ids):
            return doc_id, None if ids is None else codec.decode(ids).decode(errors="replace")

        return row

    return map_rows(tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), start,
                    "doc_id long, text string")
