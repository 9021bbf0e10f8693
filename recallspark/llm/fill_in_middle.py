"""Fill-in-the-middle documents out of a store of seekable compressed frames.

``frames`` stores each text once: independent zstandard frames of up to ``FRAME`` bytes, each with
the units (lines) and code points before it. ``transform`` draws two cuts per document from a hash
of its doc_id, decompresses only the frames that hold a cut, and assembles the result as a list of
frames again: marks, whole frames as they are, and the two sides of each cut frame. Digests and
texts are streamed from the ordered frames, one decompressed frame at a time. The original is
rebuilt from the result alone: its marks are found while it streams, and its parts are put back in
order.

A unit is a line with its line feed, or what follows the last one. Text that holds a mark, and
empty text, stays plain, so that marks in a result are never the text's own.

Edge cases. Null text: an empty one, plain. Null doc_id: cuts as of an empty id. Repeated rows give
equal results. A unit may span frames, and a code point or a mark may lie across two. Other columns
are ignored. Without rows the result is empty.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import zstandard
from pyspark.sql import DataFrame

from .common import map_rows, ship, texts

# Bytes of text in a frame.
FRAME = 1 << 18
LEVEL = 1
# The marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
_TAIL = max(map(len, _MARKS)) - 1

FRAMES = "array<struct<units: long, chars: long, size: long, data: binary>>"


def code_points(data: bytes) -> int:
    """Code points that begin in ``data``: its bytes without continuation bytes."""
    return len(data) if data.isascii() else len(data.translate(None, _CONTINUING))


_CONTINUING = bytes(range(0x80, 0xC0))


@dataclass(slots=True)
class Frame:
    """Line feeds, code points and bytes of one frame, and its compressed bytes."""

    units: int
    chars: int
    size: int
    data: bytes


class Codec:
    """Frames out of bytes and back; one per task."""

    def __init__(self, level: int = LEVEL):
        self._packer, self._unpacker = zstandard.ZstdCompressor(level=level), zstandard.ZstdDecompressor()

    def pack(self, data: bytes) -> Frame:
        return Frame(data.count(b"\n"), code_points(data), len(data), self._packer.compress(data))

    def split(self, data: bytes, size: int) -> list[Frame]:
        return [self.pack(data[at:at + size]) for at in range(0, len(data), size)]

    def read(self, frame: Frame) -> bytes:
        return self._unpacker.decompress(frame.data, max_output_size=frame.size)

    def stream(self, frames: list[Frame]) -> Iterator[bytes]:
        return map(self.read, frames)

    def parts(self, frames: list[Frame], cuts: list[int], place) -> list[list[Frame]]:
        """The frames between ascending cuts, given as (frame, offset) by ``place``; only cut frames are read."""
        out, rest, before = [], list(frames), 0
        for cut in cuts:
            at, offset = place(rest, cut - before)
            left = rest[:at]
            if offset:
                data = self.read(rest[at])
                left = [*left, *([self.pack(data[:offset])])]
                rest = [*([self.pack(data[offset:])] if offset < len(data) else []), *rest[at + 1:]]
            else:
                rest = rest[at:]
            out.append(left)
            before = cut
        return [*out, rest]


def _running(frames: list[Frame], field: str) -> list[int]:
    """Cumulative counts up to and including each frame."""
    total, out = 0, []
    for frame in frames:
        total += getattr(frame, field)
        out.append(total)
    return out


class Selector:
    """Places of cuts: after so many units, or so many bytes."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def after_units(self, frames: list[Frame], units: int) -> tuple[int, int]:
        """Frame and byte offset behind the given number of units; the end, if the last unit has no line feed."""
        if units <= 0:
            return 0, 0
        ends = _running(frames, "units")
        at = bisect_left(ends, units)
        if at == len(frames):
            return at, 0
        data, offset = self.codec.read(frames[at]), 0
        for _ in range(units - (ends[at] - frames[at].units)):
            offset = data.index(b"\n", offset) + 1
        return at, offset

    def after_bytes(self, frames: list[Frame], size: int) -> tuple[int, int]:
        ends = _running(frames, "size")
        at = bisect_left(ends, size)
        return (0, 0) if size <= 0 else (at, size - (ends[at] - frames[at].size))


class Marks:
    """Byte offsets of the marks in a stream of frames, also across two of them."""

    def __init__(self):
        self.found: dict[bytes, int] = {}
        self._tail, self._read = b"", 0

    def feed(self, data: bytes) -> None:
        window = self._tail + data
        start = self._read - len(self._tail)
        for mark in _MARKS:
            at = window.find(mark)
            if at >= 0:
                self.found.setdefault(mark, start + at)
        self._read += len(data)
        self._tail = window[-_TAIL:]


def frames(docs: DataFrame, frame: int = FRAME, level: int = LEVEL, whole: bool = False) -> DataFrame:
    """(doc_id, n_units, n_chars, marked, frames) of every row of ``docs``: the store that ``transform`` reads.

    ``marked`` says that the text holds a mark of its own. With ``whole`` the rows come along.
    """
    ship(docs.sparkSession)

    def start():
        codec = Codec(level)

        def one(doc_id, text):
            packed = codec.split(text, frame)
            units = sum(f.units for f in packed) + (not text.endswith(b"\n") and len(text) > 0)
            marked = any(m in text for m in _MARKS)
            return doc_id, units, sum(f.chars for f in packed), marked, [(f.units, f.chars, f.size, f.data) for f in packed]

        return one

    return map_rows(texts(docs, whole=whole), start, f"doc_id long, n_units long, n_chars long, marked boolean, frames {FRAMES}")


def draw(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def form_of(n: int, marked: bool, h: list[int], rate: int, spm_rate: int) -> str:
    if n == 0 or marked or h[2] % 100 >= rate:
        return "plain"
    return "spm" if h[3] % 100 < spm_rate else "psm"


def arranged(form: str, prefix: list, middle: list, suffix: list, mark) -> list:
    """The parts in the order of the form, each behind its mark."""
    p, s, m = mark(_MARKS[0]), mark(_MARKS[1]), mark(_MARKS[2])
    return [p, *prefix, s, *suffix, m, *middle] if form == "psm" else [s, *suffix, p, *prefix, m, *middle]


def transform(store: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, keep_output: bool = False) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row of a frame store.

    With ``keep_output`` also ``output``, the transformed text. Rows
    carried in the store (``whole``) come out again.
    """
    ship(store.sparkSession)

    def start():
        codec = Codec()
        select = Selector(codec)

        def one(doc_id, n, marked, packed):
            stored_frames = [Frame(**f) for f in packed]
            h = draw(doc_id, seed)
            form = form_of(n, marked, h, rate, spm_rate)
            if form == "plain":
                output, chars = stored_frames, (None, None)
            else:
                cuts = sorted(x % (n + 1) for x in h[:2])
                prefix, middle, suffix = codec.parts(stored_frames, cuts, select.after_units)
                chars = sum(f.chars for f in prefix), sum(f.chars for f in middle)
                output = arranged(form, prefix, middle, suffix, codec.pack)
            digest, marks, pieces = hashlib.sha256(), Marks(), []
            for data in codec.stream(output):
                digest.update(data)
                marks.feed(data)
                if keep_output:
                    pieces.append(data)
            restored = hashlib.sha256()
            for data in codec.stream(restore(codec, select, output, form, marks.found)):
                restored.update(data)
            shown = (b"".join(pieces).decode(),) if keep_output else ()
            return (doc_id, n, form, *chars, digest.hexdigest(), restored.hexdigest(), *shown)

        return one

    fields = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return map_rows(store.drop("n_chars"), start, fields + (", output string" if keep_output else ""))


def restore(codec: Codec, select: Selector, output: list[Frame], form: str, marks: dict[bytes, int]) -> list[Frame]:
    """The frames of the original text, in order, out of the frames of a result and its form.

    The marks stand at the offsets ``marks``; between them lie the parts.
    """
    if form == "plain":
        return output
    at = {m: marks[m] for m in _MARKS}
    cuts = sorted(x for place in at.values() for x in (place, place + len(_MARKS[0])))
    parts = codec.parts(output, cuts, select.after_bytes)
    # Before the first mark lies nothing; then mark, part, mark, part, mark, part.
    behind = dict(zip(sorted(at, key=at.get), parts[2::2]))
    return [f for mark in (_MARKS[0], _MARKS[2], _MARKS[1]) for f in behind[mark]]
