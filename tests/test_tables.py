from datetime import date

import pytest
from pyspark.sql import functions as F

from recallspark.operators.imports import new_log_rows
from recallspark.operators.queue import recommendations_on_day
from recallspark.operators.reviews import apply_reviews
from recallspark.plans.study_day import close_day, plan_day
from recallspark.schemas import CARDS, RECOMMENDATION_LOGS, SUBJECTS, TABLES
from recallspark.sources import tables as storage
from test_dates_and_scores import card
from test_reviews import REVIEWS, START


def test_tables_are_declared_once(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS study LOCATION '{tmp_path}/study'")
    try:
        storage.create_tables(spark, "study", card_buckets=4)
        spark.createDataFrame([(1, "s", 1.0, 1.0, None)], SUBJECTS).write.insertInto("study.subjects")
        storage.create_tables(spark, "study", card_buckets=4)
        assert spark.table("study.subjects").count() == 1
        assert {t.name for t in spark.catalog.listTables("study")} == set(TABLES)
        assert [(f.name, f.dataType) for f in spark.table("study.cards").schema] == [(f.name, f.dataType) for f in CARDS]
    finally:
        spark.sql("DROP DATABASE study CASCADE")


def test_old_files_lack_a_column(spark, tmp_path):
    folder = str(tmp_path)
    old = spark.createDataFrame([card(1)], CARDS).drop("ignored")
    old.write.parquet(f"{folder}/cards")
    assert storage.load_table(spark, folder, "cards").first().ignored == 0
    storage.append_rows(spark.createDataFrame([card(2, ignored=1)], CARDS), folder, "cards")
    loaded = {r.id: r.ignored for r in storage.load_table(spark, folder, "cards").collect()}
    assert loaded == {1: 0, 2: 1}
    # A value that is NULL stays NULL.
    storage.append_rows(spark.createDataFrame([card(3, ignored=None)], CARDS), folder, "cards")
    assert {r.id: r.ignored for r in storage.load_table(spark, folder, "cards").collect()} == {1: 0, 2: 1, 3: None}


def test_load_all(spark, tmp_path):
    for name, schema in TABLES.items():
        storage.append_rows(spark.createDataFrame([], schema), str(tmp_path), name)
    loaded = storage.load_tables(spark, str(tmp_path))
    assert {n: f.columns for n, f in loaded.items()} == {n: s.names for n, s in TABLES.items()}


def test_logs_are_read_by_day(spark, tmp_path, as_of, capsys):
    folder = str(tmp_path)
    rows = [(1, 5, "2024-01-14 09:00:00"), (2, 6, "2024-01-15 09:00:00"), (3, 7, "2024-01-15 09:30:00")]
    storage.append_logs(spark.createDataFrame(rows, RECOMMENDATION_LOGS), folder)
    today = storage.load_logs(spark, folder, date(2024, 1, 15))
    assert today.count() == 2 and storage.load_logs(spark, folder).count() == 3
    assert recommendations_on_day(today, as_of).first()[0] == 2
    capsys.readouterr()
    today.explain()
    assert "PartitionFilters: [isnotnull(day" in capsys.readouterr().out


def test_logs_have_one_layout(spark, tmp_path, as_of):
    folder = str(tmp_path)
    rows = [(1, 5, "2024-01-14 09:00:00"), (7, 6, "2024-01-15 09:00:00")]
    for i, append in enumerate((lambda r: storage.append_rows(r, folder, "recommendation_logs"), lambda r: storage.append_logs(r, folder))):
        append(spark.createDataFrame(rows[i:i + 1], RECOMMENDATION_LOGS))
    assert {r.id for r in storage.load_table(spark, folder, "recommendation_logs").collect()} == {1, 7}
    # The first queue of a day, from the day's logs alone: ids run on from all days'.
    queue = spark.createDataFrame([(1, 40), (2, 41)], "position int, id long")
    today = storage.load_logs(spark, folder, date(2024, 1, 16))
    new = new_log_rows(queue, today, as_of, storage.load_logs(spark, folder))
    assert sorted(r.id for r in new.collect()) == [8, 9]


def test_logs_of_any_text(spark, tmp_path, as_of, capsys):
    folder = str(tmp_path)
    texts = ["never", "2024-1-5 09:00:00", None, "", "2024-02-30 08:00:00", "2024-01-15", "2024-01-15T09:00:00Z", "2024-01-15 25:00", "a/b=c%d",
             "20240115", "2024-01-14 23:59:59"]
    rows = [(i, i, t) for i, t in enumerate(texts)]
    storage.append_logs(spark.createDataFrame(rows, RECOMMENDATION_LOGS), folder)
    assert sorted(tuple(r) for r in storage.load_logs(spark, folder).collect()) == rows
    today = storage.load_logs(spark, folder, as_of.date())
    assert sorted(r.id for r in today.collect()) == [5, 6, 7]
    assert recommendations_on_day(today, as_of).first()[0] == recommendations_on_day(storage.load_logs(spark, folder), as_of).first()[0] == 2
    # Folders of days that are none, as older appends left them, are readable too.
    spark.createDataFrame([(90, 1, "never")], RECOMMENDATION_LOGS).write.parquet(f"{folder}/recommendation_logs/day=never")
    assert storage.load_logs(spark, folder).count() == len(rows) + 1
    capsys.readouterr()
    today.explain()
    assert "PartitionFilters: [isnotnull(day" in capsys.readouterr().out


def test_files_of_different_columns_in_one_folder(spark, tmp_path):
    """Each file is read with its own columns, whichever comes first."""
    folder = str(tmp_path)
    frames = [spark.createDataFrame([card(1, ignored=1)], CARDS), spark.createDataFrame([card(2)], CARDS).drop("ignored"),
              spark.createDataFrame([card(3, ignored=None)], CARDS), spark.createDataFrame([card(4)], CARDS).drop("ignored", "review_count")]
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/cards")
    storage.append_rows(spark.createDataFrame([card(5, ignored=1)], CARDS), folder, "cards")
    loaded = {r.id: (r.ignored, r.review_count) for r in storage.load_table(spark, folder, "cards").collect()}
    assert {i: x[0] for i, x in loaded.items()} == {1: 1, 2: 0, 3: None, 4: 0, 5: 1} and loaded[4][1] == 0


def test_the_last_snapshot_is_the_card_table(spark, tmp_path):
    folder = str(tmp_path)
    storage.append_rows(spark.createDataFrame([card(1), card(2)], CARDS), folder, "cards")
    assert storage.current_snapshot(spark, folder) is None
    for run, mastery in (("day1", 3), ("day2", 4)):
        read = storage.load_tables(spark, folder)
        storage.write_snapshot(read["cards"].withColumn("mastery_level", F.lit(mastery)), folder, run, read.card_version)
        storage.append_rows(spark.createDataFrame([card(mastery * 10, mastery=0)], CARDS), folder, "cards")
    assert storage.current_snapshot(spark, folder) == "day2"
    loaded = {r.id: r.mastery_level for r in storage.load_tables(spark, folder)["cards"].collect()}
    assert loaded == {1: 4, 2: 4, 30: 4, 40: 0}
    assert {r.id: r.mastery_level for r in storage.load_snapshot(spark, folder, "day1").collect()} == {1: 3, 2: 3}


def _levels(spark, folder):
    return {r.id: r.mastery_level for r in storage.load_table(spark, folder, "cards").collect()}


def test_cards_appended_while_a_snapshot_is_made(spark, tmp_path):
    folder = str(tmp_path)
    storage.append_rows(spark.createDataFrame([card(1, mastery=1)], CARDS), folder, "cards")
    for late, run in ((2, "a"), (3, "b")):
        read = storage.load_tables(spark, folder)
        storage.append_rows(spark.createDataFrame([card(late, mastery=1)], CARDS), folder, "cards")
        storage.write_snapshot(read["cards"].withColumn("mastery_level", F.lit(5)), folder, run, read.card_version)
    assert _levels(spark, folder) == {1: 5, 2: 5, 3: 1}


def test_a_run_tried_again(spark, tmp_path):
    """A retried job changes nothing; a run of the same name on what is there now is a new version."""
    folder = str(tmp_path)
    storage.append_rows(spark.createDataFrame([card(1, mastery=1)], CARDS), folder, "cards")
    read = storage.load_tables(spark, folder)
    raised = read["cards"].withColumn("mastery_level", F.col("mastery_level") + 1)
    versions = [storage.write_snapshot(raised, folder, "day", read.card_version) for _ in range(2)]
    assert versions[0] == versions[1] and _levels(spark, folder) == {1: 2}
    for level in (3, 4):
        again = storage.load_tables(spark, folder)
        storage.write_snapshot(again["cards"].withColumn("mastery_level", F.col("mastery_level") + 1), folder, "day", again.card_version)
        assert _levels(spark, folder) == {1: level}
    assert {r.mastery_level for r in storage.load_snapshot(spark, folder, "day").collect()} == {4}


def test_two_writers(spark, tmp_path, monkeypatch):
    """Of two snapshots of the same read one is published, the other changes nothing; also if both pass the check."""
    folder = str(tmp_path)
    storage.append_rows(spark.createDataFrame([card(1, mastery=1)], CARDS), folder, "cards")
    read = storage.load_tables(spark, folder)
    cards = read["cards"]
    storage.write_snapshot(cards.withColumn("mastery_level", F.lit(2)), folder, "first", read.card_version)
    with pytest.raises(storage.SnapshotConflict):
        storage.write_snapshot(cards.withColumn("mastery_level", F.lit(3)), folder, "second", read.card_version)
    monkeypatch.setattr(storage, "_check", lambda *a: None)
    with pytest.raises(storage.SnapshotConflict):
        storage.write_snapshot(cards.withColumn("mastery_level", F.lit(4)), folder, "third", read.card_version)
    assert _levels(spark, folder) == {1: 2} and storage.current_snapshot(spark, folder) == "first"
    # What an earlier read holds can still be read.
    assert {r.mastery_level for r in storage.load_cards(spark, folder, read.card_version).collect()} == {1}


def test_a_version_without_content_is_none(spark, tmp_path):
    folder = str(tmp_path)
    storage.append_rows(spark.createDataFrame([card(1, mastery=1)], CARDS), folder, "cards")
    (tmp_path / "card_versions").mkdir()
    (tmp_path / "card_versions" / "000000000001").touch()
    assert storage.card_version(spark, folder).number == 0 and _levels(spark, folder) == {1: 1}


def test_a_day_on_storage(spark, tmp_path, as_of):
    """Queue, log, grade, snapshot; repeating a step changes nothing."""
    folder = str(tmp_path)
    storage.append_rows(spark.createDataFrame([card(i, mastery=i % 5) for i in range(1, 9)], CARDS), folder, "cards")
    subjects = spark.createDataFrame([(1, "s", 1.0, 1.0, "2024-01-20")], SUBJECTS)
    cards = storage.load_table(spark, folder, "cards")
    day = plan_day(cards, subjects, spark.createDataFrame([], RECOMMENDATION_LOGS), as_of, daily_limit=3)
    storage.append_logs(day.log_rows, folder)
    shown = [r.id for r in day.queue.orderBy("position").collect()]
    assert shown == [5, 1, 6]
    again = plan_day(cards, subjects, storage.load_logs(spark, folder), as_of, daily_limit=3)
    assert again.queue.isEmpty()
    more = plan_day(cards, subjects, storage.load_logs(spark, folder), as_of, daily_limit=4)
    assert [(r.position, r.id) for r in more.queue.collect()] == [(1, 2)]

    read = storage.card_version(spark, folder)
    reviews = spark.createDataFrame([(i, c, START, g) for i, (c, g) in enumerate(zip(shown, (2, 1, -1)))], REVIEWS)
    for _ in range(2):
        storage.write_snapshot(close_day(cards, reviews), folder, "2024-01-15", read)
    after = {r.id: (r.mastery_level, r.ignored) for r in storage.load_snapshot(spark, folder, "2024-01-15").collect()}
    assert after[5] == (5, 0) and after[1] == (2, 0) and after[6] == (1, 1) and after[2] == (2, 0) and len(after) == 8


def test_reviews_of_nothing(spark):
    cards = spark.createDataFrame([card(1)], CARDS)
    empty = spark.createDataFrame([], REVIEWS)
    assert [tuple(r) for r in apply_reviews(cards, empty).collect()] == [card(1)]
