"""Importance resampling of documents towards a target text collection.

Words of a text (runs of digits, letters a-z after lower-casing A-Z, and everything beyond
ASCII) give features: runs of up to ``longest`` consecutive words joined by one space. A feature
belongs to the bucket crc32(its UTF-8 bytes) modulo the number of buckets. What a bucket says for
the target is the logarithm of its smoothed shares; a document's weight is the floored mean over
its features, and Gumbel noise of its doc_id turns the largest scores into a sample drawn without
replacement by weight.

The checksums are worked out in length buckets: the features of a piece of text are grouped by
their number of bytes, the distinct ones of a group are a two-dimensional uint8 array, and all
their CRCs advance together, one column at a time; the results are scattered back to the places of
the features. A feature of more than ``WIDEST`` bytes is a group of its own and goes through zlib.

Edge cases. Null text: no features, weight 0. Null doc_id: the noise of an empty id; last among
ties. Repeated rows are rows like others, with equal scores and ranks of their own. Texts of any
length are read in pieces of about ``PIECE`` bytes, cut between words. Other columns are ignored.
Without rows the result is empty; without a target all features count alike.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.ranges import with_positions
from .common import ROW, broadcast_object, schema_of, ship, slices, stored, texts

BUCKETS = 10_000
# Bytes of text whose features are held at a time.
PIECE = 1 << 20
# Features of more bytes are no columns of an array.
WIDEST = 256
# Scores (thousandths, within some tens of thousands) are counted in bands of so many.
BAND = 256
SPACE = 0x20

# Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


_TABLE = _crc_table()
# What a byte of a word becomes; 0 for separators.
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_FOLDED[[b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)]] = 0
_SEPARATORS = bytes(int(b) for b in np.flatnonzero(_FOLDED == 0))


class Words:
    """The words of some texts in one buffer, each followed by a space, with the number of its text."""

    def __init__(self, parts: list[bytes], numbers: list[int]):
        """``numbers`` ascend; parts of one text stand beside each other."""
        raw = np.frombuffer(b"\n".join([*parts, b""]), dtype=np.uint8)
        folded = _FOLDED[raw]
        inside = folded != 0
        after = np.zeros(len(raw), dtype=bool)
        after[1:] = inside[:-1] & ~inside[1:]
        places = np.flatnonzero(after)
        folded[places] = SPACE
        self.buffer = folded[inside | after]
        self.ends = np.flatnonzero(self.buffer == SPACE)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if len(self.ends) else self.ends
        borders = np.cumsum([len(p) + 1 for p in parts])
        self.text = np.asarray(numbers, dtype=np.int64)[np.searchsorted(borders, places, side="right")] if len(places) else places

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and texts of all runs of ``size`` words of one text."""
        n = max(len(self.ends) - size + 1, 0)
        starts, ends, text = self.starts[:n], self.ends[size - 1:], self.text[:n]
        whole = text == self.text[size - 1:]
        return starts[whole], ends[whole], text[whole]


def crcs(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of the slices of ``buffer``, by groups of equal length."""
    out = np.zeros(len(starts), dtype=np.uint32)
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []
    for rows in groups:
        length = int(lengths[rows[0]])
        if length > WIDEST:
            out[rows] = [zlib.crc32(buffer[s:s + length].tobytes()) for s in starts[rows]]
            continue
        matrix = buffer[starts[rows][:, None] + np.arange(length)]
        distinct, back = _distinct(matrix)
        crc = np.full(len(distinct), 0xFFFFFFFF, dtype=np.uint32)
        for column in distinct.T:
            crc = _TABLE[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
        out[rows] = (~crc)[back]
    return out


def _distinct(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and for each row its place among them.

    Rows of up to 8 bytes are compared as numbers. Longer ones are sorted by a hash and then
    compared with the row that stands for it; should two rows share a hash, all rows stay.
    """
    n, width = matrix.shape
    words = -(-width // 8)
    padded = np.zeros((n, words * 8), dtype=np.uint8)
    padded[:, :width] = matrix
    keys = padded.view(np.uint64)
    key = keys[:, 0].copy()
    for column in keys.T[1:]:
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + column
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    if words > 1 and not np.array_equal(keys[first][back], keys):
        return matrix, np.arange(n)
    return matrix[first], back


def _pieces(data: bytes) -> Iterator[bytes]:
    """``data`` in pieces of about ``PIECE`` bytes that end between words."""
    at = 0
    while len(data) - at > PIECE:
        window = data[at:at + PIECE]
        cut = len(window.rstrip(_WORD_BYTES))
        end = at + PIECE
        if not cut:
            # A word longer than a piece stays whole.
            while end < len(data) and data[end] not in _SEPARATORS:
                end += 1
            cut = end - at
        yield data[at:at + cut]
        at += cut
    yield data[at:]


_WORD_BYTES = bytes(b for b in range(256) if b not in _SEPARATORS)


class Features:
    """Buckets of the features of texts, read in pieces."""

    def __init__(self, buckets: int, longest: int):
        self.buckets, self.longest = buckets, longest

    def _of(self, words: Words, skip: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(buckets, texts) per run length; of the first ``skip`` words only runs that reach beyond them."""
        for size in range(1, self.longest + 1):
            starts, ends, text = words.runs(size)
            if skip:
                fresh = ends > words.ends[skip - 1]
                starts, ends, text = starts[fresh], ends[fresh], text[fresh]
            yield crcs(words.buffer, starts, ends).astype(np.int64) % self.buckets, text

    def of(self, batch: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(buckets of features, numbers of their texts, run length), for all texts of a batch."""
        together, numbers, size = [], [], 0
        for number, data in enumerate(batch):
            if size + len(data) > PIECE and together:
                yield from self._sized(Words(together, numbers))
                together, numbers, size = [], [], 0
            if len(data) <= PIECE:
                together.append(data)
                numbers.append(number)
                size += len(data)
                continue
            tail = b""
            for piece in _pieces(data):
                words = Words([tail + b" " + piece], [number])
                skip = len(tail.split())
                yield from self._sized(words, skip)
                keep = self.longest - 1
                tail = bytes(words.buffer[words.starts[max(0, len(words.starts) - keep)]:]) if keep and len(words.starts) else b""
        if together:
            yield from self._sized(Words(together, numbers))

    def _sized(self, words: Words, skip: int = 0):
        for size, (buckets, text) in enumerate(self._of(words, skip), 1):
            yield buckets, text, size


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """(bucket, n) of all features of all texts; a task sends one row per bucket at most."""
    ship(docs.sparkSession)
    only = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(buckets, longest), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in slices(batch):
                for found, _, _ in features.of(part.column(0).to_pylist()):
                    total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(held, pa.int64()), "n": pa.array(total[held], pa.int64())})

    return only.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = 1) -> np.ndarray:
    """What a feature of each bucket says for the target, in thousandths, floored.

    The counts of both tables come in one small job: two numbers per bucket.
    """
    both = bucket_counts(docs, buckets, longest).withColumn("target", F.lit(0)).unionAll(
        bucket_counts(target, buckets, longest).withColumn("target", F.lit(1)))
    counts = np.zeros((2, buckets), dtype=np.int64)
    for row in both.collect():
        counts[row["target"], row["bucket"]] = row["n"]
    s_all, t_all = (int(n) for n in counts.sum(axis=1))
    return np.array([
        math.floor(1000 * math.log(((t + 1) * float(s_all + buckets)) / ((s + 1) * float(t_all + buckets))))
        for s, t in zip(*(counts.tolist()))
    ], dtype=np.int64)


def weigh(docs: DataFrame, table: np.ndarray, longest: int = 1, whole: bool = False) -> DataFrame:
    """(doc_id, n_features, n_words, weight) of every row of ``docs``, by the gains of ``gains``."""
    spark = docs.sparkSession
    ship(spark)
    shared = broadcast_object(spark, table)
    rows = texts(docs, whole=whole)
    schema = schema_of("doc_id long, n_features long, n_words long, weight long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = pickle.loads(shared.value)
        features = Features(len(gain), longest)
        for batch in batches:
            for part in slices(batch):
                n = part.num_rows
                total, count, words = (np.zeros(n, dtype=np.int64) for _ in range(3))
                for found, text, size in features.of(part.column(1).to_pylist()):
                    held = np.bincount(text, minlength=n)
                    count += held
                    words += held if size == 1 else 0
                    # Sums of whole numbers far below 2 to the 53rd are exact.
                    total += np.bincount(text, weights=gain[found], minlength=n).astype(np.int64)
                weight = total // np.maximum(count, 1)
                out = pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in (count, words, weight))], schema=arrow)
                yield out.append_column(ROW, part.column(2)) if whole else out

    return rows.mapInArrow(run, schema.add(ROW, rows.schema[ROW].dataType) if whole else schema)


def noise(seed: int):
    """Gumbel noise of a doc_id, in thousandths, floored: a column."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.left(F.sha2(key, 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024, words_least: int = 20,
             buckets: int = BUCKETS, longest: int = 1, whole: bool = False) -> DataFrame:
    """Every row of ``docs`` with its weight and score; of those with ``words_least`` words, the best ``percent`` % have a rank.

    (doc_id, n_features, weight, score, rank), and with ``whole`` the rows as they came. Only
    the rows above the score that bounds the draw are sorted, in ranges of the whole order.
    """
    weighed = weigh(docs, gains(docs, target, buckets, longest), longest, whole)
    scored = stored(weighed.withColumn("score", F.col("weight") + noise(seed)))
    able = F.col("n_words") >= words_least
    # Counts of whole bands of scores tell from which score on rows can be drawn.
    band = F.floor(F.col("score") / BAND)
    bands = scored.where(able).groupBy(band.alias("band")).agg(F.count("*").alias("n")).orderBy(F.desc("band")).collect()
    drawn = sum(r["n"] for r in bands) * percent // 100
    reached, lowest = 0, None
    for row in bands:
        if reached < drawn:
            reached, lowest = reached + row["n"], row["band"] * BAND
    unranked = F.lit(None).cast("long")
    if lowest is None:
        ranked = scored.withColumn("rank", unranked)
    else:
        near = able & (F.col("score") >= lowest)
        order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
        best = with_positions(scored.where(near), order, "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
        ranked = best.unionByName(scored.where(~near).withColumn("rank", unranked))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank", *([ROW] if whole else []))
