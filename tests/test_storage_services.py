"""What runs beside each other and again: reserved ids, kept answers, file intake, sums per part."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from compare import multiset
from recallspark.functions import clock
from recallspark.operators import candidates, dashboard, idsets, imports, prompts, sizing
from recallspark.plans.document_import import import_documents
from recallspark.schemas import CARDS, IMPORTED_FILES, RECOMMENDATION_LOGS, SUBJECTS
from recallspark.sources import intake, ledger, summaries, tables
from test_dates_and_scores import card


def same(left, right):
    a, b = (multiset(f.columns, [tuple(r) for r in f.collect()]) for f in (left, right))
    return sorted(left.columns) == sorted(right.columns) and a == b


# -- ids -----------------------------------------------------------------------------------------------------------

def test_reserved_ranges(spark, tmp_path):
    table = spark.createDataFrame([(7,), (40,)], "id long")
    assert [ledger.reserve_ids(table, str(tmp_path), "cards", n) for n in (5, 0, 3)] == [40, 45, 45]
    assert ledger.reserved_ids(spark, str(tmp_path), "cards") == [(41, 45), (46, 45), (46, 48)]
    # Rows appended past the ledger move it on; other tables have their own.
    grown = spark.createDataFrame([(90,)], "id long")
    assert ledger.reserve_ids(grown, str(tmp_path), "cards", 2) == 90 and ledger.reserve_ids(table.limit(0), str(tmp_path), "logs", 1) == 0


def test_a_reservation_gives_way(spark, tmp_path, monkeypatch):
    """Another writer creates the same entry first."""
    table = spark.createDataFrame([(1,)], "id long")
    create = ledger.create_entry
    raced = []

    def late(spark, folder, number, content):
        if not raced:
            raced.append(create(spark, folder, number, {"first": 2, "last": 101}))
        return create(spark, folder, number, content)

    monkeypatch.setattr(ledger, "create_entry", late)
    assert ledger.reserve_ids(table, str(tmp_path), "cards", 10) == 101 and raced == [True]


def test_imports_planned_at_the_same_time(spark, tmp_path, as_of):
    """Two imports planned before either is written take different ids, together without a gap."""
    folder = str(tmp_path)
    cards = spark.createDataFrame([card(i) for i in range(1, 6)], CARDS)
    files = spark.createDataFrame([], IMPORTED_FILES)
    texts = [[(1, 1, "a.md", "The cat sat here. The dog ran off."), (2, 1, "b.md", "Some birds sing loud.")], [(3, 2, "c.md", "Red apples fall down. Green pears rot.")]]
    made = [import_documents(spark.createDataFrame(t, "doc_id long, subject_id long, file_name string, text string"), cards, files, as_of, reserve_in=folder)
            for t in texts]
    ids = [[r.id for r in m.card_rows.collect()] for m in made]
    assert sorted(ids[0] + ids[1]) == list(range(6, 11)) and min(ids[1]) > max(ids[0])
    assert sorted(r.id for m in made for r in m.import_rows.collect()) == [1, 2, 3]


def test_rows_without_a_key_are_spread(spark):
    """Many rows of a NULL key take dense ids and lie in many buckets."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("key"), (F.col("id") * 7).alias("x"))
    found = imports.numbered(rows, "key", 10).collect()
    assert sorted(r.id for r in found) == list(range(11, 3011)) and {r.x for r in found} == {i * 7 for i in range(3000)}
    shared = [r.id for r in found if r.key is None]
    assert max(shared) - min(shared) > 2500


# -- answers -------------------------------------------------------------------------------------------------------

def asking(folder):
    """A model that counts its calls in files, and fails on texts with "bad" until told otherwise."""
    def open_model():
        def model(messages, json_mode):
            import os
            import uuid
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as call:
                call.write(messages[1]["content"])
            if "bad" in messages[1]["content"] and not os.path.exists(f"{folder}/../well"):
                raise RuntimeError("down")
            return f"answer to {messages[1]['content']}"
        return model
    return open_model


@pytest.mark.parametrize("concurrency", [1, 4])
def test_answers_are_kept(spark, tmp_path, concurrency):
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    asked = spark.createDataFrame([(i, 0, "s", t) for i, t in enumerate(["one", "two", "one", "bad", "bad too", ""])],
                                  "doc_id long, part int, system string, user string").repartition(3)

    def run():
        before = len(list(calls.iterdir()))
        rows = {r.doc_id: (r.raw, r.error) for r in prompts.complete_kept(asked, asking(str(calls)), store, concurrency).collect()}
        return rows, len(list(calls.iterdir())) - before

    rows, n = run()
    good = {0: "one", 1: "two", 2: "one", 5: ""}
    # Equal prompts once; a failure twice, with and without JSON mode.
    assert n == 3 + 4 and {i: r[0] for i, r in rows.items() if r[0] is not None} == {i: f"answer to {t}" for i, t in good.items()}
    assert rows[3] == rows[4] == (None, "RuntimeError: down")
    assert run() == (rows, 4)
    (tmp_path / "well").touch()
    rows, n = run()
    assert n == 2 and rows[3] == ("answer to bad", None) and all(r[1] is None for r in rows.values())
    assert run() == (rows, 0)


def test_a_run_that_broke_off(spark, tmp_path):
    """Files of a write without its end are not read; two runs' answers to one prompt count once."""
    store = str(tmp_path / "store")
    keyed = spark.createDataFrame([("k", "a"), ("j", "b")], prompts.ANSWERS)
    for run in ("run=1", "run=2"):
        keyed.write.parquet(f"{store}/{run}")
    keyed.write.parquet(f"{store}/run=3/_temporary/0")
    assert sorted(tuple(r) for r in prompts.kept_answers(spark, store).collect()) == [("j", "b"), ("k", "a")]


# -- intake --------------------------------------------------------------------------------------------------------

def test_each_content_is_taken_in_once(spark, tmp_path, as_of):
    """Three drops of overlapping files, one stream stopped and started again."""
    drop, out, checkpoint = tmp_path / "drop", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    drops = [{"a.md": b"The cat sat here.", "copy of a.md": b"The cat sat here.", "x.exe": b"no"},
             {"sub/a.md": b"The cat sat here.", "b.markdown": b"Dogs run far."},
             {"a2.md": b"The cat sat there.", "b again.MD": b"Dogs run far."}]
    for files in drops:
        for name, content in files.items():
            (drop / name).parent.mkdir(parents=True, exist_ok=True)
            (drop / name).write_bytes(content)
        intake.take_in(intake.file_stream(spark, str(drop)), out, checkpoint).awaitTermination()
    taken = intake.taken_in(spark, out).collect()
    assert sorted((r.file_name, bytes(r.content)) for r in taken) == [("a.md", b"The cat sat here."), ("a2.md", b"The cat sat there."), ("b.markdown", b"Dogs run far.")]
    assert len({r.doc_id for r in taken}) == 3
    rows = imports.new_import_rows(intake.taken_in(spark, out).withColumn("subject_id", F.lit(1)), spark.createDataFrame([], IMPORTED_FILES), as_of)
    assert sorted(r.id for r in rows.collect()) == [1, 2, 3]
    # A batch that is played again finds what it found before.
    again = spark.createDataFrame(taken, intake.TAKEN)
    assert intake.taken_in(spark, out, 1).count() == 1 and again.count() == 3


def test_nothing_taken_in(spark, tmp_path):
    assert intake.taken_in(spark, str(tmp_path / "none")).collect() == []


# -- ids that were recommended -------------------------------------------------------------------------------------

def logs_of(spark, n, day="2024-01-15"):
    return spark.range(n).select(F.col("id"), (F.col("id") * 3 - 50_000).alias("card_id"), F.lit(f"{day} 09:00:00").alias("recommended_at"))


def test_bit_maps_are_the_anti_join(spark, as_of, monkeypatch, capsys):
    cards = spark.range(-60_000, 140_000).select(
        F.when(F.col("id") % 1000 != 7, F.col("id")).alias("id"), (F.col("id") % 5).cast("int").alias("mastery_level"), F.lit(0).alias("ignored"))
    logs = logs_of(spark, 50_000).unionAll(logs_of(spark, 9, "2024-01-14")).unionAll(spark.createDataFrame([(1, None, "2024-01-15 10:00:00")], RECOMMENDATION_LOGS))
    rows = candidates.eligible_cards(cards, logs, as_of)
    monkeypatch.setattr(sizing, "BROADCAST_BYTES", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mapped = candidates.eligible_cards(cards, logs, as_of)
        capsys.readouterr()
        mapped.explain()
        shown = capsys.readouterr().out
        # Cards meet the bit maps where they are.
        assert "BroadcastHashJoin" in shown and "SortMergeJoin" not in shown and "Exchange hashpartitioning" not in shown
        assert same(rows, mapped) and mapped.count() < cards.count() - 40_000
        monkeypatch.setattr(idsets, "BITMAP_BYTES", 0)
        assert same(rows, candidates.eligible_cards(cards, logs, as_of))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# -- sums per part -------------------------------------------------------------------------------------------------

def test_named_day_is_on_day(spark):
    texts = ["2024-01-15", "2024-01-15 10:00", "2024-01-15T10:00:00Z", "2024-01-15 25:00", "never", None, "", "2024-1-5 10:00:00", "2024-01-15x", "2024-01-14 00:00:00.5"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", clock.named_day(F.col("t")).alias("day"), *[
        clock.on_day(F.col("t"), date(2024, 1, d)).alias(f"on{d}") for d in (14, 15)]).collect()
    assert all((r.day == f"2024-01-{d}") == r[f"on{d}"] for r in rows for d in (14, 15))


def test_sums_of_parts_are_the_dashboard(spark, tmp_path, as_of, monkeypatch):
    """After appends, a snapshot and a regrade; each look reads only parts it has not seen."""
    folder = str(tmp_path)
    subjects = spark.createDataFrame([(i, f"s{i}", 1.0, 1.0, None) for i in range(6)], SUBJECTS)
    read = []
    load = summaries.load_cards
    monkeypatch.setattr(summaries, "load_cards", lambda s, f, v, **o: read.append(v) or load(s, f, v, **o))

    def look(parts):
        read.clear()
        summary = summaries.stored_summary(spark, folder)
        assert sum(len(v.appended) + (v.snapshot is not None) for v in read) == parts
        cards = tables.load_table(spark, folder, "cards")
        assert same(dashboard.totals_of(summary, as_of), dashboard.dashboard_totals(cards, as_of))
        for count_missing in (True, False):
            assert same(dashboard.progress_of(summary, subjects, count_missing), dashboard.subject_progress(cards, subjects, count_missing))

    def rows(first, n, **more):
        return spark.createDataFrame([card(i, subject_id=i % 5, mastery=[None, 0, 3, 5][i % 4], ignored=[None, 0, 1][i % 3],
                                           last=["2024-01-15 08:00:00", "never", None, "2024-01-14 08:00:00"][i % 4], **more) for i in range(first, first + n)], CARDS)

    look(0)
    rows(0, 40).coalesce(1).write.parquet(f"{folder}/cards")
    rows(100, 10).drop("ignored").coalesce(1).write.mode("append").parquet(f"{folder}/cards")
    look(2)
    tables.append_rows(rows(200, 20).coalesce(1), folder, "cards")
    tables.append_rows(spark.createDataFrame([], CARDS).coalesce(1), folder, "cards")
    new = len(tables.card_version(spark, folder).appended) - 2
    look(new)
    look(0)
    now = tables.load_tables(spark, folder)
    tables.write_snapshot(now["cards"].withColumn("mastery_level", F.lit(4)), folder, "day", now.card_version)
    look(1)
    tables.append_rows(rows(300, 5).coalesce(1), folder, "cards")
    look(1)
    look(0)
