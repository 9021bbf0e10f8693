"""Fill-in-middle documents against plain Python; frames of any size; texts rebuilt."""

import hashlib
import re

import pytest

import corpus
from recallspark.llm import fill_in_middle as fim
from recallspark.llm.common import ROW

TEXTS = ["one line", "a\nb\nc\n", "\n\n\n", "", None, "ü\n中文\n😀 end", "has <P> mark\nx", "<S", "x<\nM>", "nearly <M >\n<P\n>", "\r\n\r\n", "a\n" * 500,
         "long " * 3000 + "\n" + "é" * 700 + "\nlast"]


def plain(i, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digest = len(units), hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        form, out, sizes = "plain", text, (None, None)
    else:
        form = "spm" if h[3] % 100 < spm else "psm"
        out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
        sizes = len(p), len(m)
    return i, n, form, *sizes, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), out


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("frame", [1, 3, 64, fim.FRAME])
@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 0)])
def test_equal_to_plain_python(spark, frame, rate, spm):
    docs = [(40 * k + i, t) for k in range(4 if frame > 1 else 1) for i, t in enumerate(TEXTS)] + [(None, "a\nb"), (3, "a\nb"), (3, "a\nb")]
    store = fim.frames(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), frame=frame)
    found = fim.transform(store, rate=rate, spm_rate=spm, keep_output=True).collect()
    assert order(found) == order(plain(i, t, rate=rate, spm=spm) for i, t in docs)
    forms = {r["form"] for r in found}
    assert forms == ({"plain", "spm", "psm"} if spm else {"plain", "psm"})


def test_only_cut_frames_are_read():
    codec = fim.Codec()
    packed = codec.split(b"0123456\n" * 100, 80)
    read = []
    codec.read = lambda frame, read_one=codec.read: read.append(frame) or read_one(frame)
    parts = codec.parts(packed, [13, 57], fim.Selector(codec).after_units)
    assert [sum(f.size for f in p) for p in parts] == [104, 352, 344]
    # A cut frame is read to find the place and once more to be split.
    assert len(packed) == 10 and len({id(f) for f in read}) == 2


def test_result_alone_gives_the_text():
    codec = fim.Codec()
    select = fim.Selector(codec)
    output = codec.split("<S>ends\n<P>begins ü\n<M>mid".encode(), 2)
    marks = fim.Marks()
    for data in codec.stream(output):
        marks.feed(data)
    assert b"".join(codec.stream(fim.restore(codec, select, output, "spm", marks.found))).decode() == "begins ü\nmidends\n"


def test_rows_come_along(spark):
    docs = corpus.odd_documents(spark)
    found = fim.transform(fim.frames(docs, whole=True))
    rows = found.select(f"{ROW}.*").collect()
    assert sorted(map(str, rows)) == sorted(map(str, docs.collect()))
    assert order(fim.transform(fim.frames(docs)).collect()) == order(found.drop(ROW).collect())


def test_empty_table(spark):
    assert fim.transform(fim.frames(corpus.no_documents(spark))).collect() == []
