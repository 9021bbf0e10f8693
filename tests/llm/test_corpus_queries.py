"""Registered queries against DuckDB where SQL can say them; the pipeline, stage by stage."""

import base64
import hashlib
import os
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus
import corpus_pipeline
from compare import connect, difference
from recallspark.llm import language_id, queries
from test_minhash_dedup import exact

FOLDER = os.environ.get("STUDY_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the parquet tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, name):
    assert difference(queries.QUERIES[name](spark, FOLDER), connect(FOLDER).sql(queries.SQL[name])) is None


def words_of(text):
    return re.findall(r"[a-z0-9]+|[^\x00-\x7f]+", text.lower())


def holds(text, items, run=13):
    """Does the text hold a whole item, or so many words of one in a row?"""
    words = words_of(text)
    joined = {n: {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} for n in {min(run, len(item)) for item in items}}
    return any(tuple(item[i:i + n]) in joined[n] for item in items if len(item) > 3 for n in [min(run, len(item))] for i in range(len(item) - n + 1))


# The patterns of the three kinds of secrets.
SECRETS = [re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]{6,})"),
           re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")]


def without_secrets(text):
    spans = sorted(m.span() for pattern in SECRETS for m in pattern.finditer(text))
    out, at = [], 0
    for i, (a, b) in enumerate(spans):
        if a >= at:
            out.append(text[at:a] + "[SECRET]")
        at = max(at, b)
    return "".join([*out, text[at:]])


def test_pipeline(spark):
    """Every stage once more in plain Python."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    spoken = {i: t for i, t in texts.items() if any(c.isalpha() for c in t)}
    _, component = exact(list(spoken.items()), 5)
    single = {i: t for i, t in spoken.items() if component[i] == i}
    items = [words_of(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = {i: t for i, t in single.items() if not holds(t, items)}
    assert len(texts) >= len(spoken) > len(single) > len(clean)
    with open(public_tokenizers.path(corpus_pipeline.VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(rows) == set(clean)
    for i, text in clean.items():
        hidden = without_secrets(text)
        assert rows[i]["decoded_sha256"] == hashlib.sha256(hidden.encode()).hexdigest()
        assert rows[i]["ids"] == encoding.encode_ordinary(hidden) and rows[i]["n_tokens"] == len(rows[i]["ids"])


ODD_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _number long, _rank string, number string, place int, _row string, component_id int"


def odd_rows():
    """Null and repeated ids, repeated rows, null texts, columns of names that the stages use themselves."""
    rows = [(i, t, lang, "s", len(t or ""), 7, "r", "n", 3, "w", 9) for i, t, lang, *_ in corpus.odd_rows()]
    return rows + [(None, corpus.prose(50, 70), "en", "s", 1, 1, "a", "b", 2, "c", 3), (5, corpus.prose(45, 71), "fr", "s", 1, 1, "a", "b", 2, "c", 3)]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_each_stage_on_odd_rows(spark, name, stage):
    """Rows come out as they went in, but for what the stage changes; only what it rejects goes."""
    rows = odd_rows()
    docs = spark.createDataFrame(rows, ODD_COLUMNS).repartition(3)
    left = [tuple(r) for r in stage(spark, docs, FOLDER).collect()]
    if name == "language":
        plain = Counter((*r[:2], *r[3:]) for r in rows if any(c.isalpha() for c in r[1] or ""))
        assert Counter((*r[:2], *r[3:]) for r in left) == plain and all(r[2] in ("en", "fr") for r in left)
    elif name == "near_duplicates":
        # Numbers stand for rows: each group keeps that of its smallest id, a null one last.
        numbered = dict(enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))))
        _, component = exact([(i, r[1]) for i, r in numbered.items()], 5)
        kept = [r for i, r in numbered.items() if component[i] == i]
        assert sorted((r[0] is None, r[0] or 0, *map(str, r[3:])) for r in left) == sorted((r[0] is None, r[0] or 0, *map(str, r[3:])) for r in kept)
        assert not Counter(left) - Counter(rows)
    elif name == "benchmark":
        assert Counter(left) == Counter(rows)
    else:
        assert Counter((r[0], r[2], r[3], *r[5:]) for r in left) == Counter((r[0], r[2], r[3], *r[5:]) for r in rows)
        assert all(r[4] == len(r[1] or "") for r in left) and not any(corpus.SECRET[9:-1] in (r[1] or "") for r in left)
        assert sum("[SECRET]" in (r[1] or "") for r in left) == 1


def test_language_that_cannot_be_told(spark):
    """A text without lang that fits two languages as well goes; with a lang it stays."""
    rows = [(i, corpus.prose(60, i), "en") for i in range(30)] + [(100 + i, "ŵŷ" * 3 + " " + " ".join(f"ç{w}ł" for w in corpus.prose(60, i).split()), "cy") for i in range(30)]
    half = " ".join(a if n % 2 else f"ç{a}ł" for n, a in enumerate(corpus.prose(4, 99).split()))
    rows += [(200, half, None), (201, half, "en"), (202, corpus.prose(60, 77), None), (203, None, None), (204, "12 34", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkey = {r["doc_id"]: r for r in language_id.identify(docs, language_id.train(docs)).collect()}
    kept = {r["doc_id"]: r["lang"] for r in corpus_pipeline.known_language(spark, docs, FOLDER).collect()}
    assert (200 in kept) == (not monkey[200]["ambiguous"]) and kept[201] == "en" and kept[202] == "en" and 203 not in kept and 204 not in kept


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.where("n_chars <> length(text)").count() == 0


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.collect() == []


def test_one_row_of_each_group(spark):
    """Null ids, repeated ids, and one id on different texts."""
    a, b, c = (corpus.prose(80, i) for i in (1, 2, 3))
    near = a + " end"
    rows = [(None, b), (None, b), (None, b + " end"), (7, a), (3, near), (None, a), (5, c), (5, c), (5, corpus.prose(80, 4)), (None, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = [tuple(r) for r in corpus_pipeline.without_near_duplicates(spark, docs, FOLDER).collect()]
    assert len(left) == 6 and {r for r in left if r[0] is not None} == {(3, near), (5, c), (5, corpus.prose(80, 4)), (9, "")}
    assert sum(r[0] is None and r[1] in (b, b + " end") for r in left) == 1 and (None, None) in left
