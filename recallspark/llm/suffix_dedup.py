"""Repeated byte strings across documents, by a blockwise suffix order over cover samples.

Wanted: every byte covered by a LENGTH-byte string that also starts in a document of a smaller
id. Sorting all suffixes of the corpus at once is out of the question; as in the blockwise
construction with difference covers, suffixes are sorted one bucket at a time, and only suffixes
at sample positions are ranked beforehand.

The sample is a cover: every string of LENGTH bytes holds a sample position, at the same offset
wherever the string stands (the smallest hash of its GRAM-byte substrings). Strings that share a
sample GRAM form a bucket. In a bucket the suffixes to the right of the sample positions, and the
reversed prefixes to the left, are sorted once with their common prefix lengths; that gives each
sample position a rank at any depth. A string that starts k bytes before a sample position is
then told from others by two ranks, to the left at depth k and to the right at depth LENGTH - k,
however long the tie, without its bytes being looked at again.

Buckets whose GRAM stands in one document only are dropped after a first exchange of hashes.
Memory is bounded by the number of buckets, which grows with the corpus. The cover chosen by
content has one position in 14; a difference cover of residues would need six in 31.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import record_batch, schema_of, ship, slices, stored, texts
from .words import mix

LENGTH, GRAM = 50, 24
OFFSETS = LENGTH - GRAM + 1
# Documents travel in packs of about this many bytes of text.
PACK_BYTES = 4 << 20
# Bytes of text for each bucket.
BUCKET_BYTES = 16 << 20
# A GRAM with more sample positions than this is hot: its strings are told apart by all their bytes.
HOT_POSITIONS = 100_000
# All that is shuffled is compressed text or hashes; more effort here is less disk.
COMPRESSION = 9
_SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_UP = np.full(_SEGMENT + 2 * LENGTH + 1, _BASE, dtype=np.uint64)
_UP[0] = 1
_UP = np.multiply.accumulate(_UP)
_DOWN = np.full(len(_UP), pow(_BASE, -1, 1 << 64), dtype=np.uint64)
_DOWN[0] = 1
_DOWN = np.multiply.accumulate(_DOWN)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
_NO_ID = np.iinfo(np.int64).max


def _compressed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", COMPRESSION).compress(raw, asbytes=True)


def _plain(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one or two dimensions in few bytes: a pack has little to say to each of many buckets."""
    heads = [f"{a.dtype.str}{':'.join(map(str, a.shape))}" for a in arrays]
    return _compressed(",".join(heads).encode() + b"\n" + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpacked(data: bytes) -> list[np.ndarray]:
    raw = _plain(data)
    at = raw.index(b"\n") + 1
    out = []
    for head in raw[:at - 1].decode().split(","):
        dtype, shape = np.dtype(head[:3]), tuple(map(int, head[3:].split(":")))
        n = int(np.prod(shape))
        out.append(np.frombuffer(raw, dtype=dtype, count=n, offset=at).reshape(shape))
        at += n * dtype.itemsize
    return out


class Pack:
    """Some documents: their ids and, end to end, their bytes."""

    def __init__(self, ids: list[int | None], data: list[bytes]):
        self.ids = ids
        self.numbers = np.array([_NO_ID if i is None else i for i in ids], dtype=np.int64)
        self.sizes = np.array([len(d) for d in data], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.bytes = np.frombuffer(b"".join(data), dtype=np.uint8)

    def payload(self) -> bytes:
        return _compressed(pickle.dumps((self.ids, self.sizes, self.bytes.tobytes()), protocol=5))

    @staticmethod
    def read(payload: bytes) -> Pack:
        ids, sizes, data = pickle.loads(_plain(payload))
        ends = np.cumsum(sizes)
        return Pack(ids, [data[e - n:e] for e, n in zip(ends, sizes)])

    def rows_of(self, places: np.ndarray) -> np.ndarray:
        """The document of each place."""
        return np.searchsorted(self.ends, places, side="right")

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the sample positions of all strings that lie within a document."""
        total = len(self.bytes)
        room = np.repeat(self.ends, self.sizes)
        # A document without an id neither covers nor is covered.
        room[np.repeat(self.numbers == _NO_ID, self.sizes)] = 0
        places, hashes = [], []
        for at in range(0, max(0, total - LENGTH + 1), _SEGMENT):
            part = self.bytes[at:at + _SEGMENT + LENGTH - 1]
            n = len(part) - LENGTH + 1
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_BYTES[part] * _UP[:len(part)], out=sums[1:])
            grams = mix((sums[GRAM:] - sums[:-GRAM]) * _DOWN[:len(part) - GRAM + 1]) | np.uint64(1)
            inside = room[at:at + n] - np.arange(at, at + n) >= LENGTH
            least = np.where(inside, _extreme(grams, OFFSETS, np.minimum), np.uint64(0))
            edge = np.zeros(OFFSETS - 1, dtype=np.uint64)
            hit = np.flatnonzero(_extreme(np.concatenate([edge, least, edge]), OFFSETS, np.maximum) == grams)
            places.append(hit + at)
            hashes.append(grams[hit])
        if not places:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        places, first = np.unique(np.concatenate(places), return_index=True)
        return places, np.concatenate(hashes)[first]


def _extreme(values: np.ndarray, size: int, function) -> np.ndarray:
    """The smallest or largest of every ``size`` consecutive values, by doubling."""
    width = 1
    out = values
    while 2 * width <= size:
        out = function(out[:-width], out[width:])
        width *= 2
    rest = size - width
    return function(out[:len(out) - rest], out[rest:]) if rest else out


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _keyed(pack: Pack, hashes: np.ndarray, places: np.ndarray, buckets: int):
    """The distinct hashes in order of bucket and hash, the place in that list of each sample, and its buckets."""
    order = _bucket(hashes, buckets).astype(np.uint64) << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF))
    keys, inverse, counts = np.unique(order, return_inverse=True, return_counts=True)
    rows = pack.numbers[pack.rows_of(places)]
    low, high = np.full(len(keys), _NO_ID), np.full(len(keys), np.iinfo(np.int64).min)
    np.minimum.at(low, inverse, rows)
    np.maximum.at(high, inverse, rows)
    return keys, inverse, counts, low != high


def _pack_documents(docs: DataFrame, pack_bytes: int) -> DataFrame:
    schema = schema_of("pack long, size long, payload binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        ids, data, size = [], [], 0
        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(*(c.to_pylist() for c in part.columns)):
                    ids.append(doc_id)
                    data.append(text)
                    size += len(text)
                    if size >= pack_bytes or len(ids) >= 1 << 16:
                        yield record_batch([((task << 32) + number, size, Pack(ids, data).payload())], arrow)
                        number, ids, data, size = number + 1, [], [], 0
        if ids:
            yield record_batch([((task << 32) + number, size, Pack(ids, data).payload())], arrow)

    return texts(docs).mapInArrow(run, schema)


def _rows(function, result: str):
    """A mapInArrow function that calls ``function`` with one row's values and writes the rows it yields."""
    arrow = to_arrow_schema(schema_of(result))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(function(*(c[i].as_py() for c in batch.columns)))
                if rows:
                    yield record_batch(rows, arrow)

    return run


def _hash_rows(buckets: int):
    """Per pack and bucket the hashes of its samples, how often they stand, and which stand in several documents."""

    def run(pack_id, payload):
        pack = Pack.read(payload)
        places, hashes = pack.samples()
        keys, _, counts, several = _keyed(pack, hashes, places, buckets)
        of = (keys >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(of)) + 1
        for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(of)]])):
            if b > a:
                yield int(of[a]), pack_id, _packed(keys[a:b].astype(np.uint32), np.minimum(counts[a:b], 65535).astype(np.uint16), several[a:b])

    return run


def _repeated(result: str, hot_positions: int):
    """Of one bucket's hashes those that stand in several documents, as a bit per hash of each pack; and the hot ones."""
    arrow = to_arrow_schema(schema_of(result))

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        packs = table.column("pack").to_pylist()
        parts = [_unpacked(v.as_py()) for v in table.column("hashes")]
        keys = np.concatenate([p[0] for p in parts])
        distinct, inverse = np.unique(keys, return_inverse=True)
        many = np.bincount(inverse, minlength=len(distinct)) > 1
        many[inverse[np.concatenate([p[2] for p in parts])]] = True
        hot = np.bincount(inverse, weights=np.concatenate([p[1] for p in parts]), minlength=len(distinct)) > hot_positions
        rows, at = [], 0
        for pack, part in zip(packs, parts):
            own = inverse[at:at + len(part[0])]
            at += len(own)
            if many[own].any():
                rows.append((pack, bucket, _packed(np.packbits(many[own]), np.packbits(hot[own]))))
        return pa.Table.from_batches([record_batch(rows, arrow)])

    return run


def _context_rows(buckets: int):
    """Per pack and bucket the bytes around its repeated sample positions, each distinct stretch once."""

    def run(pack_id, payload, marks):
        pack = Pack.read(payload)
        places, hashes = pack.samples()
        keys, inverse, _, _ = _keyed(pack, hashes, places, buckets)
        many, hot = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
        of = (keys >> np.uint64(32)).astype(np.int64)
        for mark in marks:
            bits, hot_bits = _unpacked(mark["marks"])
            a, n = (np.searchsorted(of, mark["bucket"], side) for side in ("left", "right"))
            n -= a
            many[a:a + n] = np.unpackbits(bits, count=n).astype(bool)
            hot[a:a + n] = np.unpackbits(hot_bits, count=n).astype(bool)
        # Cold samples are told apart within the bucket of their GRAM.
        cold = many[inverse] & ~hot[inverse]
        parts = [(places[cold], of[inverse[cold]], OFFSETS - 1, LENGTH)]
        # Every string around a hot sample goes to a bucket of its own bytes.
        begins = np.unique((places[many[inverse] & hot[inverse]][:, None] - np.arange(OFFSETS)[None, :]).ravel())
        begins = begins[begins >= 0]
        if len(begins):
            row = np.minimum(pack.rows_of(begins), len(pack.ids) - 1)
            begins = begins[begins + LENGTH <= pack.ends[row]]
            whole = _gather(pack, begins, 0, LENGTH)
            sums = np.zeros(len(begins), dtype=np.uint64)
            for i in range(LENGTH):
                sums = sums * np.uint64(_BASE) + _BYTES[whole[:, i]]
            parts.append((begins, _bucket(mix(sums), buckets), 0, LENGTH))
        for where, bucket, left, right in parts:
            order = np.argsort(bucket, kind="stable")
            where, bucket = where[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(bucket)]])):
                if b > a:
                    yield int(bucket[a]), pack_id, _packed(*_stretches(pack, where[a:b], left, right))

    return run


def _gather(pack: Pack, places: np.ndarray, left: int, right: int) -> np.ndarray:
    """A row of bytes around each place; beyond the pack's ends, zeros."""
    at = places[:, None] + np.arange(-left, right)[None, :]
    out = pack.bytes[np.clip(at, 0, max(len(pack.bytes) - 1, 0))]
    out[(at < 0) | (at >= len(pack.bytes))] = 0
    return out


def _stretches(pack: Pack, places: np.ndarray, left: int, right: int):
    """(bytes, room to the left, room to the right) of distinct stretches, and (stretch, id, row, place) of all samples."""
    rows = pack.rows_of(places)
    rooms = np.stack([np.minimum(places - pack.starts[rows], left), np.minimum(pack.ends[rows] - places, right)], 1).astype(np.uint8)
    data = np.zeros((len(places), OFFSETS - 1 + LENGTH + 2), dtype=np.uint8)
    data[:, OFFSETS - 1 - left:OFFSETS - 1 + right] = _gather(pack, places, left, right)
    columns = np.arange(data.shape[1] - 2)[None, :] - (OFFSETS - 1)
    data[:, :-2][(columns < -rooms[:, :1].astype(int)) | (columns >= rooms[:, 1:].astype(int))] = 0
    data[:, -2:] = rooms
    distinct, inverse = np.unique(data.view(f"V{data.shape[1]}").ravel(), return_inverse=True)
    return (distinct.view(np.uint8).reshape(len(distinct), -1), inverse.astype(np.uint32), pack.numbers[rows],
            rows.astype(np.uint32), (places - pack.starts[rows]).astype(np.uint32))


def _ranks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of rows of bytes, and how many bytes each has in common with the one before."""
    n, width = data.shape
    padded = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    padded[:, :width] = data
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort([words[:, i] for i in reversed(range(words.shape[1]))])
    ordered = data[order]
    common = np.zeros(n, dtype=np.int64)
    if n > 1:
        differ = ordered[1:] != ordered[:-1]
        common[1:] = np.where(differ.any(1), differ.argmax(1), width)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    return order, common, place


def covered_places(data: np.ndarray, stretch: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per sample the first and last offset to its left of a string that a smaller id holds; -1 if none.

    ``data`` has the distinct stretches with their rooms, ``stretch`` and ``ids`` the samples.
    """
    rooms, middle = data[:, -2:].astype(np.int64), OFFSETS - 1
    least = np.full(len(data), _NO_ID)
    np.minimum.at(least, stretch, ids)
    _, right_common, right_place = _ranks(data[:, middle:middle + LENGTH])
    _, left_common, left_place = _ranks(data[:, :middle][:, ::-1])
    first, last = np.full(len(ids), -1), np.full(len(ids), -1)
    for k in range(OFFSETS):
        ok = np.flatnonzero((rooms[:, 0] >= k) & (rooms[:, 1] >= LENGTH - k))
        if not len(ok):
            continue
        right = np.cumsum(right_common < LENGTH - k)[right_place[ok]]
        left = np.cumsum(left_common < k)[left_place[ok]] if k else np.zeros(len(ok), dtype=np.int64)
        _, group = np.unique(left * (len(data) + 1) + right, return_inverse=True)
        smallest = np.full(group.max() + 1, _NO_ID)
        np.minimum.at(smallest, group, least[ok])
        of = np.full(len(data), _NO_ID)
        of[ok] = smallest[group]
        hit = of[stretch] < ids
        last[hit] = k
        first[hit & (first < 0)] = k
    return first, last


def _covered(result: str):
    """Of one bucket the stretches of each pack's documents that smaller ids hold."""
    arrow = to_arrow_schema(schema_of(result))

    def run(table: pa.Table) -> pa.Table:
        packs = table.column("pack").to_pylist()
        parts = [_unpacked(v.as_py()) for v in table.column("stretches")]
        everything = np.concatenate([p[0] for p in parts])
        distinct, inverse = np.unique(np.ascontiguousarray(everything).view(f"V{everything.shape[1]}").ravel(), return_inverse=True)
        offsets = np.cumsum([0] + [len(p[0]) for p in parts])
        stretch = np.concatenate([inverse[o + p[1]] for o, p in zip(offsets, parts)])
        first, last = covered_places(distinct.view(np.uint8).reshape(len(distinct), -1), stretch, np.concatenate([p[2] for p in parts]))
        rows, at = [], 0
        for pack, (_, own, _, row, place) in zip(packs, parts):
            a, b = first[at:at + len(own)], last[at:at + len(own)]
            at += len(own)
            hit = np.flatnonzero(a >= 0)
            if len(hit):
                begin = place[hit].astype(np.int64) - b[hit]
                size = b[hit] - a[hit] + LENGTH
                rows.append((pack, _packed(row[hit], begin.astype(np.uint32), size.astype(np.uint8))))
        return pa.Table.from_batches([record_batch(rows, arrow)])

    return run


def _results(keep_text: bool):
    def run(payload, spans):
        pack = Pack.read(payload)
        edges = np.zeros(len(pack.bytes) + 1, dtype=np.int32)
        for span in spans or []:
            row, begin, size = _unpacked(span)
            at = pack.starts[row] + begin
            np.add.at(edges, at, 1)
            np.add.at(edges, at + size, -1)
        gone = np.cumsum(edges[:-1]) > 0
        for doc_id, a, b in zip(pack.ids, pack.starts.tolist(), pack.ends.tolist()):
            out = gone[a:b]
            runs = int(np.count_nonzero(out[1:] & ~out[:-1])) + int(b > a and out[0])
            left = pack.bytes[a:b][~out].tobytes() if runs else pack.bytes[a:b].tobytes()
            row = (doc_id, b - a, b - a - len(left), runs, hashlib.sha256(left).hexdigest())
            yield row + (left,) if keep_text else row

    return run


def remove_repeats(docs: DataFrame, keep_text: bool = False, hot_positions: int = HOT_POSITIONS,
                   pack_bytes: int = PACK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Documents without the LENGTH-byte strings that documents of smaller ids hold.

    ``docs`` has doc_id and text. Returns per row doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs) and kept_sha256 (of the bytes left), with ``keep_text`` also kept, those bytes.
    Strings are judged on the input. A null or empty text has no bytes; a row without doc_id
    loses nothing and takes nothing; rows of the same doc_id do not take from each other; other
    columns are not read. A task holds a pack of ``pack_bytes``, or the samples of
    ``bucket_bytes`` of text; a pack sends a row to each bucket, so let both grow with the
    corpus as memory allows (64 MB and 512 MB at many TB).
    """
    spark = docs.sparkSession
    ship(spark)
    packs = stored(_pack_documents(docs, pack_bytes))
    total = packs.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes), 1)
    payloads = packs.select("pack", "payload")
    hash_result = "bucket long, pack long, hashes binary"
    hashes = payloads.mapInArrow(_rows(_hash_rows(buckets), hash_result), hash_result)
    mark_result = "pack long, bucket long, marks binary"
    marks = hashes.groupBy("bucket").applyInArrow(_repeated(mark_result, hot_positions), mark_result)
    marked = payloads.join(marks.groupBy("pack").agg(F.collect_list(F.struct("bucket", "marks")).alias("marks")), "pack")
    context_result = "bucket long, pack long, stretches binary"
    contexts = marked.select("pack", "payload", "marks").mapInArrow(_rows(_context_rows(buckets), context_result), context_result)
    span_result = "pack long, spans binary"
    spans = contexts.groupBy("bucket").applyInArrow(_covered(span_result), span_result)
    per_pack = spans.groupBy("pack").agg(F.collect_list("spans").alias("spans"))
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    return payloads.join(per_pack, "pack", "left").select("payload", "spans").mapInArrow(_rows(_results(keep_text), result), result)
