import json
import math
import random
from collections import Counter
from datetime import datetime

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from recallspark.functions.completions import resolved_pairs, resolved_points
from recallspark.functions.text import decode_utf8, document_kind, float_text, strip_blanks, unfence
from recallspark.operators import cloze, documents, imports, prompts, segmentation
from recallspark.operators.ids import last_id, numbered
from recallspark.plans.document_import import document_texts, import_documents
from recallspark.schemas import CARDS, IMPORTED_FILES, SUBJECTS
from recallspark.sources.files import read_files
from test_dates_and_scores import card


def column(spark, values, expression, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in frame.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


# -- text ----------------------------------------------------------------------------------------------------------

@settings(max_examples=5, deadline=None)
@given(st.lists(st.binary(max_size=12) | st.text(alphabet="aé漢😀�", max_size=5).map(
    lambda t: t.encode()[1:] + b"\xff" + t.encode()), min_size=60, max_size=200))
def test_decoding_drops_what_is_not_utf8(spark, values):
    got = column(spark, [bytearray(v) for v in values], decode_utf8, "binary")
    assert got == [v.decode("utf-8", errors="ignore") for v in values]


def test_decoding_examples(spark):
    values = [b"\xff\x41", b"", "ok é".encode(), None]
    assert column(spark, values, decode_utf8, "binary") == ["A", "", "ok é", None]


def test_stripping_blanks_like_python(spark):
    values = [" a b ", "\t\n x ", "　y ", "\x1cz\x1f", "", "   ", "a\n"]
    assert column(spark, values, strip_blanks) == [v.strip() for v in values]


@pytest.mark.parametrize("name,mime,kind", [
    ("a.PDF", None, "pdf"), ("b.md", None, "text"), ("c", "application/pdf", "pdf"), (None, None, "text"),
    ("x.pdf.txt", "text/plain", "text"), ("", "", "text"), ("d.md", "APPLICATION/PDF", "text")])
def test_routing(spark, name, mime, kind):
    frame = spark.createDataFrame([(name, mime)], "n string, m string")
    assert frame.select(document_kind(F.col("n"), F.col("m"))).first()[0] == kind


def test_pages(spark):
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, ""), (2, 1, "x")], "doc_id long, page_no long, text string")
    assert {tuple(r) for r in documents.pages_to_text(pages).collect()} == {(1, "a\nb\n\n"), (2, "x\n")}


# -- model answers -------------------------------------------------------------------------------------------------

FENCED = {
    "a": "a", "```json\n{}\n```": "{}", "```json{}": "{}", "```\nx\n```": "x", "```": "", "```json```": "", "  ```json\n1\n```  ": "1",
    " plain ": " plain ", "x```": "x```", "": "",
}


def test_unfencing(spark):
    assert column(spark, list(FENCED), lambda x: unfence(x, strip_blanks(x))) == list(FENCED.values())


POINTS = [
    ('{"points":["a"," ","b "]}', ["a", "b"]), ('{"n":1,"zz":["x"],"aa":["q"]}', ["x"]), ('["top"]', []), ("nope", []),
    ('{"points":"[x","k":["v"]}', ["v"]), ('  {"points":[1,"s"]}', ["1", "s"]), ('```\n{"points":[]}\n```', []),
    ('{"points":{"a":[1]},"b":["deep"]}', ["deep"]), ('{"points":["s"]} more', []), (None, []), ("", []), ("{}", []), ("null", []),
    ('"points"', []), ('{"points":[null,true,false,"x"]}', ["None", "True", "False", "x"]), ("{'points':['single']}", []),
    ('{"points":["a"]}}', []), ('{"points":["a"]},{"points":["b"]}', []), ('{"points":["a"]}],[{"b":["c"]}', []),
    ('{"points":["first"],"points":["last"]}', ["last"]), ('{"b":["x"],"points":3,"c":["y"]}', ["x"]),
    ('{"points":["\\u00e9 \\n two"]}', ["é \n two"]), ('```json\n{"points":["fenced"]}\n```', ["fenced"]),
    ('{"points":[[],"x"]}', ["[]", "x"]), ('{"points":["{\\"a\\":1}"]}', ['{"a":1}']), ('{"a":[],"b":["x"]}', []), ('{"points":["a",]}', []),
    ('{"points":["a"]', []), ('{"points":[1.0,1.5e-7,1e22,2.50,1e16,123456789.25,0.001,1e-5,-0.5,100]}',
                             ["1.0", "1.5e-07", "1e+22", "2.5", "1e+16", "123456789.25", "0.001", "1e-05", "-0.5", "100"]),
]


@pytest.mark.parametrize("raw,points", POINTS)
def test_points(spark, raw, points):
    assert column(spark, [raw], resolved_points) == [points]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False).filter(lambda x: x != 0 and abs(x) > 1e-300), min_size=100, max_size=200))
def test_floats_are_spelled_alike(spark, values):
    got = column(spark, values, float_text, "double")
    # Another Java may spell a number with a digit more; it is the same number then.
    assert [float(g) for g in got] == values
    assert all(g == repr(v) for g, v in zip(got, values) if len(g) <= len(repr(v)))


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(st.text(alphabet=' ab"\\[é', max_size=4), max_size=4), min_size=30, max_size=60))
def test_points_are_kept_in_order_without_blanks(spark, values):
    raws = [json.dumps({"points": v}) for v in values]
    points = column(spark, raws, resolved_points)
    assert points == [[t.strip() for t in v if not t.isspace() and t] for v in values]
    assert column(spark, [f" \n{r}\t" for r in raws], resolved_points) == points
    assert column(spark, [f"```json\n{r}\n```" for r in raws], resolved_points) == points


def stored_half(value):
    if isinstance(value, (list, dict)):
        raise ValueError("not storable")
    return None if value is None else str(int(value) if isinstance(value, bool) else value)


def expected_pairs(answer):
    """All pairs of the answer, or none if one of them cannot be stored."""
    if not isinstance(answer, dict):
        return []
    chosen = answer.get("knowledge_points", next((v for v in answer.values() if isinstance(v, list)), []))
    if "knowledge_points" not in answer and not isinstance(chosen, list):
        return []
    try:
        return [(stored_half(item["q"]), stored_half(item["a"])) for item in chosen]
    except (TypeError, KeyError, ValueError):
        return []


PAIRS = [
    ('{"knowledge_points":[{"q":"Q ____","a":"A"}]}', [("Q ____", "A")]), ('{"knowledge_points":[{"q":"Q","a":"A"},{"q":"R"}]}', []),
    ('{"knowledge_points":[{"q":"Q","a":"A"},"bare"]}', []), ('{"knowledge_points":[]}', []),
    ('{"n":2,"cards":[{"q":"S","a":"C","x":1}]}', [("S", "C")]), ('{"knowledge_points":{"q":"Q","a":"A"},"other":[{"q":"Q","a":"A"}]}', []),
    ('{"knowledge_points":"text"}', []), ('{"knowledge_points":[{"q":null,"a":1},{"q":true,"a":false}]}', [(None, "1"), ("1", "0")]),
    ('{"knowledge_points":[{"q":["x"],"a":"A"}]}', []), ('{"knowledge_points":[{"q":"Q","a":{"x":1}}]}', []), ('[{"q":"Q","a":"A"}]', []),
    ("junk", []), (None, []), ('{"a":[1],"b":[{"q":"Q","a":"A"}]}', []), ('{"knowledge_points":[null]}', []),
    ('{"knowledge_points":[[{"q":"Q","a":"A"}]]}', []), ('{"x":"y"}', []), ('{"knowledge_points":[{"q":1.0,"a":2.50}]}', [("1.0", "2.5")]),
]


@pytest.mark.parametrize("raw,pairs", PAIRS)
def test_pairs(spark, raw, pairs):
    assert [(p.q, p.a) for p in column(spark, [raw], resolved_pairs)[0]] == pairs


@settings(max_examples=4, deadline=None)
@given(st.lists(st.recursive(
    st.none() | st.booleans() | st.integers(-5, 5) | st.sampled_from([1.0, 2.5, 1e22, 1.5e-7, -3.25]) | st.text(alphabet='ab" \\{[é', max_size=4),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(
        st.sampled_from(["points", "knowledge_points", "q", "a", "zz", "b"]), inner, max_size=4), max_leaves=12,
), min_size=60, max_size=150))
def test_answers_like_json(spark, values):
    pairs = column(spark, [json.dumps(v) for v in values], resolved_pairs)
    assert [[(p.q, p.a) for p in row] for row in pairs] == [expected_pairs(v) for v in values]


# -- prompts, model, import ----------------------------------------------------------------------------------------

def test_prompts_hold_the_whole_text(spark):
    texts = {1: "é" * 14_999 + "xy\nz", 2: "", 3: None, 4: "a" * 15_000, 5: "😀\n" * 20_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pieces = {}
    for r in prompts.point_prompts(docs).orderBy("doc_id", "part").collect():
        assert r.part == len(pieces.setdefault(r.doc_id, []))
        pieces[r.doc_id].append(r.user.removeprefix(prompts.POINTS_REQUEST))
    assert {i: "".join(p) for i, p in pieces.items()} == {i: t or "" for i, t in texts.items()}
    assert [len(pieces[i]) for i in texts] == [2, 1, 1, 1, 3]


def test_points_of_pieces_are_joined(spark):
    points = spark.createDataFrame([(1, 1, ["c"]), (1, 0, ["a", "b"]), (2, 0, [])], "doc_id long, part int, points array<string>")
    assert {r.doc_id: r.points for r in prompts.document_points(points).collect()} == {1: ["a", "b", "c"], 2: []}


def test_numbering_points(spark):
    points = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "doc_id long, points array<string>")
    assert [tuple(r) for r in prompts.numbered_points(points).collect()] == [(1, "1. a\n2. b")]


def flaky_model():
    calls = []

    def model(messages, json_mode):
        calls.append(json_mode)
        text = messages[1]["content"].removeprefix(prompts.POINTS_REQUEST)
        if text == "down" or (text == "no json mode" and json_mode):
            raise RuntimeError(text)
        return f"{text}|{json_mode}"

    return model


def test_model_is_retried_once_without_json_mode(spark):
    docs = spark.createDataFrame([(1, "fine"), (2, "no json mode"), (3, "down")], "doc_id long, text string")
    got = {r.doc_id: (r.raw, r.error) for r in prompts.complete(prompts.point_prompts(docs), flaky_model).collect()}
    assert got == {1: ("fine|True", None), 2: ("no json mode|False", None), 3: (None, "RuntimeError: down")}


def two_step_model():
    def model(messages, json_mode):
        request = messages[1]["content"]
        if request.startswith(prompts.POINTS_REQUEST):
            return json.dumps({"points": request.removeprefix(prompts.POINTS_REQUEST).split("; ")})
        lines = [line.split(". ", 1)[1] for line in request.removeprefix(prompts.PAIRS_REQUEST).split("\n")]
        return json.dumps({"knowledge_points": [
            {"q": "____"} if line == "spoiled" else {"q": f"{line} ____", "a": line.upper()} for line in lines]})

    return model


def test_import_is_all_or_nothing_per_document(spark, as_of):
    docs = spark.createDataFrame([
        (1, 7, "one.md", "a; b"), (2, 7, "two.md", "c; spoiled"), (3, 8, "three.md", ""), (4, 8, "four.md", "d")],
        "doc_id long, subject_id long, file_name string, text string")
    cards = spark.createDataFrame([card(40), card(12)], CARDS)
    files = spark.createDataFrame([], IMPORTED_FILES)
    done = import_documents(docs, cards, files, as_of, two_step_model)
    rows = done.card_rows.orderBy("id").collect()
    assert done.card_rows.dtypes == cards.dtypes
    assert [r.id for r in rows] == [41, 42, 43]
    assert sorted((r.subject_id, r.question, r.answer) for r in rows) == [(7, "a ____", "A"), (7, "b ____", "B"), (8, "d ____", "D")]
    assert {(r.created_at, r.last_reviewed_at, r.review_count, r.mastery_level, r.ignored) for r in rows} == {
        ("2024-01-15 10:00:00", "2024-01-15 10:00:00", 0, 0, 0)}
    a, b = (next(r.id for r in rows if r.answer == x) for x in "AB")
    assert b == a + 1
    assert sorted((r.id, r.file_name, r.imported_at) for r in done.import_rows.collect()) in (
        [(1, "one.md", "2024-01-15 10:00:00"), (2, "four.md", "2024-01-15 10:00:00")],
        [(1, "four.md", "2024-01-15 10:00:00"), (2, "one.md", "2024-01-15 10:00:00")])
    assert {tuple(r) for r in done.report.collect()} == {(1, 4, 2, None), (2, 10, 0, None), (3, 0, 0, None), (4, 1, 1, None)}


def test_errors_are_reported(spark, as_of):
    docs = spark.createDataFrame([(1, 7, "one.md", "fine"), (2, 7, "two.md", "down")], "doc_id long, subject_id long, file_name string, text string")
    done = import_documents(docs, spark.createDataFrame([], CARDS), spark.createDataFrame([], IMPORTED_FILES), as_of, flaky_model)
    errors = {r.doc_id: r.errors for r in done.report.collect()}
    assert errors[1] is None and [tuple(e) for e in errors[2]] == [(1, 0, "RuntimeError: down")]


def test_import_without_a_model(spark, as_of):
    docs = spark.createDataFrame([(1, 7, "one.md", "Alpha beta gamma. Beta delta!"), (2, 7, "two.md", "a b c")],
                                 "doc_id long, subject_id long, file_name string, text string")
    done = import_documents(docs, spark.createDataFrame([], CARDS), spark.createDataFrame([], IMPORTED_FILES), as_of)
    rows = done.card_rows.collect()
    assert sorted(r.id for r in rows) == [1, 2]
    assert {(r.subject_id, r.question, r.answer) for r in rows} == {(7, "____ beta gamma", "Alpha"), (7, "Beta ____", "delta!")}
    assert [(r.id, r.file_name) for r in done.import_rows.collect()] == [(1, "one.md")]
    assert {tuple(r) for r in done.report.collect()} == {(1, 29, 2), (2, 5, 0)}


def test_files_to_texts(spark, tmp_path):
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "notes.md").write_bytes(f"# Titel é {folder}".encode() + b"\xff")
    (tmp_path / "b.PDF").write_bytes(b"%PDF")
    (tmp_path / "empty.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.exe").write_bytes(b"MZ")
    files = read_files(spark, str(tmp_path))
    ids = {r.path.removeprefix(f"file:{tmp_path}/"): r.doc_id for r in files.collect()}
    assert set(ids) == {"x/notes.md", "y/notes.md", "b.PDF", "empty.pdf"} and len(set(ids.values())) == 4
    assert {r.doc_id for r in read_files(spark, str(tmp_path)).collect()} == set(ids.values())
    assert read_files(spark, str(tmp_path), types=None).count() == 5
    pages = spark.createDataFrame([(ids["b.PDF"], 1, "page")], "doc_id long, page_no long, text string")
    assert {r.doc_id: r.text for r in document_texts(files, pages).collect()} == {
        ids["x/notes.md"]: "# Titel é x", ids["y/notes.md"]: "# Titel é y", ids["b.PDF"]: "page\n", ids["empty.pdf"]: ""}
    declared = spark.createDataFrame([(f"file:{tmp_path}/x/notes.md", "application/pdf")] * 2, "path string, mime_type string")
    assert sorted(r.mime_type or "" for r in read_files(spark, str(tmp_path), declared).collect()) == ["", "", "", "application/pdf"]


def test_subjects_need_a_name(spark):
    entries = spark.createDataFrame([(1, "x", 1.0, 0.0), (2, "", 1.0, 1.0), (3, None, 1.0, 1.0)],
                                    "form_id long, name string, difficulty double, credits double")
    entries = entries.withColumn("ddl", F.lit("2024-03-01").cast("date"))
    rows = imports.new_subjects(entries, spark.createDataFrame([(5, "old", 1.0, 1.0, None)], SUBJECTS), "form_id").collect()
    assert [tuple(r) for r in rows] == [(6, "x", 1.0, 0.0, "2024-03-01")]


@pytest.mark.parametrize("digits", [1, 4])
def test_ids_are_dense_and_stable(spark, digits):
    rows = spark.range(500).withColumn("n", F.col("id") % 4).withColumnRenamed("id", "key")
    first = {r.key: r.id for r in numbered(rows, "key", 100, F.col("n"), bucket_digits=digits).collect()}
    claimed = sorted(first[k] + i for k in first for i in range(k % 4))
    assert claimed == list(range(101, 101 + len(claimed)))
    again = numbered(rows.repartition(13), "key", 100, F.col("n"), bucket_digits=digits)
    assert {r.key: r.id for r in again.collect()} == first
    assert spark.range(1).select(last_id(spark.createDataFrame([], "id long"))).first()[0] == 0


def test_ids_keep_rows_without_a_key(spark, as_of):
    rows = spark.createDataFrame([(None,), (7,), (None,), (9,)], "key long")
    assert sorted(r.id for r in numbered(rows, "key", 3).collect()) == [4, 5, 6, 7]
    files = spark.createDataFrame([(None, 1, "a.md"), (2, 1, "b.md")], "doc_id long, subject_id long, file_name string")
    assert imports.new_import_rows(files, spark.createDataFrame([], IMPORTED_FILES), as_of).count() == 2
    entries = spark.createDataFrame([(None, "x", 1.0, 1.0, None), (1, "y", 1.0, 1.0, None)],
                                    "form_id long, name string, difficulty double, credits double, ddl string")
    assert imports.new_subjects(entries, spark.createDataFrame([], SUBJECTS), "form_id").count() == 2
    pairs = spark.createDataFrame([(None, 1, [("q", "a"), ("r", "b")]), (3, 1, [("s", "c")])], "doc_id long, subject_id long, pairs array<struct<q:string,a:string>>")
    assert sorted(r.id for r in imports.new_cards(pairs, spark.createDataFrame([], CARDS), as_of).collect()) == [1, 2, 3]
    cards = spark.createDataFrame([(None, 0, 1, "q", "a"), (None, 1, 1, "r", "b")], "doc_id long, pos int, subject_id long, q string, a string")
    assert sorted(r.id for r in imports.new_cards_from_rows(cards, spark.createDataFrame([], CARDS), as_of).collect()) == [1, 2]


# -- cloze ---------------------------------------------------------------------------------------------------------

TEXTS = [
    "The cat sat. The dog sat, the Cat ran!  A an it.\nZebra zebra, ZEBRA runs", "the cat and the dog", "", "x y z", "the the the.", "Erste Zeile hier。Zweite Zeile！Dritte",
    "Ünïcode wörds: naïve façade. 12345 67 8! ",
]


def expected_cloze(texts):
    import re

    def key(word):
        return "".join(c for c in word if c.isalpha()).lower()

    points = [[p.strip(" ") for p in re.split(r"[.!?]+[ ]+|[。！？]+|\n+", t)] for t in texts]
    points = [[p for p in ps if p] for ps in points]
    df = {}
    for ps in points:
        for k in {key(w) for p in ps for w in p.split(" ")}:
            df[k] = df.get(k, 0) + 1
    rows = set()
    for doc, ps in enumerate(points):
        for pos, p in enumerate(ps):
            words = p.split(" ")
            keys = [k for k in map(key, words) if len(k) >= 3]
            if keys:
                best = min(keys, key=lambda k: (df[k], -len(k), k))
                if not {key(w) for w in words} - {"", best}:
                    continue
                rows.add((doc, pos, " ".join("____" if key(w) == best else w for w in words),
                          " ".join(w for w in words if key(w) == best)))
    return rows


@pytest.mark.parametrize("parts,head,max_bytes", [(1, 5, None), (5, 5, None), (5, 5, 0), (5, 0, 0), (1, 100, 0)])
def test_cloze(spark, parts, head, max_bytes):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(parts)
    rows = [tuple(r) for r in cloze.cloze_cards(docs, head, max_bytes).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected_cloze(TEXTS)


# -- scripts without spaces ----------------------------------------------------------------------------------------

HAN = "学习 记忆 卡片 复习 数据 引擎 计算 系统 的 是 和 在 老师 学生 每天 重点 知识点 考试 方法 时间".split()
THAI = "เรียน จำ บัตร ครู วัน สอบ คน มา ไป ดี บ้าน น้ำ".split()


def unspaced_texts(words, n, seed):
    rng = random.Random(seed)
    return ["。".join("".join(rng.choice(words) for _ in range(rng.randint(2, 9))) for _ in range(15)) for _ in range(n)]


def expected_segments(pieces):
    """Cuts of every piece: entropies by counting neighbours, the best of all cuts by recursion over its ends."""
    most, beside = segmentation.WORD_MOST, {}
    for piece in pieces:
        for i in range(len(piece)):
            for j in range(i + 1, min(len(piece), i + most) + 1):
                left, right = beside.setdefault(piece[i:j], ([], []))
                left.append(piece[i - 1] if i else object())
                right.append(piece[j] if j < len(piece) else object())

    def entropy(seen):
        return -sum(n / len(seen) * math.log(n / len(seen)) for n in Counter(seen).values())

    h = {g: (entropy(left), entropy(right)) for g, (left, right) in beside.items()}
    rise = {g: h[g][1] - (h[g[:-1]][1] if g[:-1] else 0) + h[g][0] - (h[g[1:]][0] if g[1:] else 0) for g in h}
    usual = {n: sum(r for g, r in rise.items() if len(g) == n) / sum(len(g) == n for g in rise) for n in range(1, most + 1) if any(len(g) == n for g in rise)}
    score = {g: round((r - usual[len(g)]) * len(g), segmentation.DIGITS) for g, r in rise.items()}

    def cut(piece):
        best = [(0.0, [])]
        for j in range(1, len(piece) + 1):
            best.append(max(((best[j - n][0] + score[piece[j - n:j]], n, best[j - n][1] + [piece[j - n:j]]) for n in range(1, min(j, most) + 1)),
                            key=lambda x: (x[0], x[1]))[::2])
        return best[-1][1]

    return {piece: cut(piece) for piece in pieces}


@pytest.mark.parametrize("words", [HAN, THAI])
def test_words_of_scripts_without_spaces(spark, words):
    """Equal to a cut by hand, and nearly all of it real words."""
    texts = unspaced_texts(words, 40, 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    several = segmentation.parts(cloze.statements(docs))
    found = segmentation.segments(several).collect()
    pieces = [s for t in texts for s in t.split("。")]
    expected = expected_segments(pieces)
    assert sorted(r.words for r in found) == sorted(expected[p] for p in pieces)
    if words is HAN:
        cuts = [w for r in found for w in r.words]
        assert sum(w in words for w in cuts) > 0.95 * len(cuts)


def test_cards_of_scripts_without_spaces(spark):
    """Every statement of two words or more gives a card that can be undone; mixed text keeps what is between."""
    texts = unspaced_texts(HAN, 30, 2) + ["Spark 是计算引擎, fast. 数据", "plain words here. and there", "学生每天学习abc记忆 12", "学"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    cards = cloze.cloze_cards(docs).collect()
    points = {(r.doc_id, r.pos): r.point for r in cloze.statements(docs).collect()}
    assert all(r.q.replace("____", r.a) == points[r.doc_id, r.pos] and "____" in r.q for r in cards)
    of = {(r.doc_id, r.pos): (r.q, r.a) for r in cards}
    assert len(of) == len(cards) and sum(i < 30 for i, _ in of) > 0.97 * sum(i < 30 for i, _ in points)
    # Rarity: of the words of a statement the one in the fewest documents, then the longest, then the first.
    cut = segmentation.segments(segmentation.parts(cloze.statements(docs))).collect()
    spread = {w: len({r.doc_id for r in cut if w in r.words}) for r in cut for w in r.words}
    words = {}
    for r in cut:
        words.setdefault((r.doc_id, r.pos), []).extend(w for w in r.words if len(w) >= 2)
    assert all(of[k][1] == min(words[k], key=lambda w: (spread[w], -len(w), w)) for k in of if k in words)
    assert of[30, 0][0].startswith("Spark ") and of[31, 0] == ("____ words here", "plain") and (33, 0) not in of


def test_long_runs_are_cut_in_pieces(spark):
    rng = random.Random(3)
    run = "".join(rng.choice(HAN) for _ in range(300))
    docs = spark.createDataFrame([(1, run)], "doc_id long, text string")
    several = segmentation.parts(cloze.statements(docs)).orderBy("part").collect()
    assert [len(r.text) for r in several[:-1]] == [segmentation.PIECE] * (len(several) - 1) and "".join(r.text for r in several) == run
    cut = segmentation.segments(segmentation.parts(cloze.statements(docs))).orderBy("part").collect()
    assert "".join(w for r in cut for w in r.words) == run
    card = cloze.cloze_cards(docs).first()
    assert card.q.replace("____", card.a) == run


def test_cloze_can_be_undone(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    points = {(r.doc_id, r.pos): r.point for r in cloze.statements(docs).collect()}
    for r in cloze.cloze_cards(docs).collect():
        removed = iter(r.a.split(" "))
        assert "____" in r.q
        assert " ".join(next(removed) if w == "____" else w for w in r.q.split(" ")) == points[(r.doc_id, r.pos)]
