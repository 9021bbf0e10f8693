"""Physical plans: what moves, what is sorted, what runs in Python, and hot keys."""

import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from recallspark.operators import candidates, cloze, dashboard, idsets, queue, reviews, sizing
from recallspark.schemas import CARDS, RECOMMENDATION_LOGS, SUBJECTS
from recallspark.session import work_dir
from recallspark.sources import star_schema as study, tables as storage
from test_dates_and_scores import card

FOLDER = "/root/testdata/sf0.001"


def plan(frame, capsys):
    capsys.readouterr()
    frame.explain()
    return capsys.readouterr().out


def ran(frame, capsys):
    """The plan as it was after adaptive execution."""
    frame.collect()
    return plan(frame, capsys)


class settings_of:
    def __init__(self, spark, **values):
        self.spark, self.values = spark, {k.replace("__", "."): v for k, v in values.items()}

    def __enter__(self):
        self.before = {k: self.spark.conf.get(k) for k in self.values}
        for k, v in self.values.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.before.items():
            self.spark.conf.set(k, v)


@pytest.fixture
def stored(spark, tmp_path):
    """Study tables on disk, as a user has them."""
    cards = spark.createDataFrame([card(i, subject_id=i % 7, mastery=i % 6) for i in range(300)], CARDS)
    subjects = spark.createDataFrame([(i, f"s{i}", 1.0, 1.0, None) for i in range(7)], SUBJECTS)
    logs = spark.createDataFrame([(1, 5, "2024-01-15 00:00:01")], RECOMMENDATION_LOGS)
    for frame, name in ((cards, "cards"), (subjects, "subjects"), (logs, "recommendation_logs")):
        storage.append_rows(frame, str(tmp_path), name)
    return tuple(spark.read.parquet(f"{tmp_path}/{n}") for n in ("cards", "subjects", "recommendation_logs"))


def test_top_cards_need_no_global_sort_and_no_shuffle_of_cards(stored, as_of, capsys):
    cards, subjects, logs = stored
    shown = plan(queue.top_priority_cards(candidates.priority_scores(*stored, as_of), logs, as_of), capsys)
    assert "TakeOrderedAndProject" in shown and "rangepartitioning" not in shown
    assert "LeftAnti" in shown and "NestedLoop" not in shown and "Cartesian" not in shown
    assert shown.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in shown


def test_filters_and_columns_reach_the_scan(stored, as_of, capsys):
    cards, subjects, logs = stored
    shown = plan(candidates.learning_cards(cards).select("id"), capsys)
    assert "Or(IsNull(ignored),EqualTo(ignored,0))" in shown and "LessThan(mastery_level,5)" in shown
    assert "StringStartsWith(recommended_at,2024-01-15)" in plan(queue.recommendations_on_day(logs, as_of), capsys)
    shown = plan(dashboard.dashboard_totals(cards, as_of), capsys)
    assert "ReadSchema: struct<last_reviewed_at:string,mastery_level:int,ignored:int>" in shown
    assert shown.count("FileScan") == 1


@pytest.mark.parametrize("map_bytes,shuffled", [(idsets.BITMAP_BYTES, 1), (0, 2)])
def test_large_sides_are_shuffled_with_the_same_result(stored, as_of, capsys, spark, monkeypatch, map_bytes, shuffled):
    """Subjects above the limit are shuffled; logged ids only if their bit maps are above theirs too."""
    small = candidates.priority_scores(*stored, as_of).collect()
    monkeypatch.setattr(sizing, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(idsets, "BITMAP_BYTES", map_bytes)
    with settings_of(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        frame = candidates.priority_scores(*stored, as_of)
        assert plan(frame, capsys).count("SortMergeJoin") == shuffled
        assert sorted(frame.collect()) == sorted(small)


def test_a_hot_subject_is_split(spark, as_of, capsys, monkeypatch):
    """A third of all cards on one subject, subjects too large to broadcast."""
    monkeypatch.setattr(sizing, "BROADCAST_BYTES", 0)
    subjects = spark.range(300).select(
        "id", F.concat(F.lit("s"), "id").alias("name"), F.lit(1.0).alias("difficulty"), F.lit(1.0).alias("credits"),
        F.lit(None).cast("string").alias("ddl"))
    owner = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 300)
    cards = spark.range(60_000, numPartitions=8).select(
        "id", owner.cast("long").alias("subject_id"), F.repeat(F.lit("q"), 40).alias("question"), F.lit("a").alias("answer"),
        F.lit("2024-01-01 00:00:00").alias("created_at"), F.lit(None).cast("string").alias("last_reviewed_at"),
        F.lit(0).alias("review_count"), F.lit(1).alias("mastery_level"), F.lit(0).alias("ignored"))
    logs = spark.createDataFrame([], RECOMMENDATION_LOGS)
    with settings_of(
        spark, spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="100KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="50KB",
    ):
        frame = candidates.priority_scores(cards, subjects, logs, as_of)
        shown = ran(frame, capsys)
        assert re.search(r"SortMergeJoin\(skew=true\)|skewed", shown)
        assert frame.count() == 60_000


def test_progress_aggregates_before_it_joins(stored, capsys):
    shown = plan(dashboard.subject_progress(stored[0], stored[1]), capsys)
    assert shown.index("Join") < shown.index("HashAggregate") and "partial_avg" in shown


def test_deltas_cut_hot_cards_before_the_shuffle(spark, capsys):
    shown = plan(reviews._gathered_deltas(study.reviews(spark, FOLDER)), capsys)
    assert re.search(r"WindowGroupLimit .*Final.*WindowGroupLimit .*Partial", shown, re.S)


def test_history_shuffles_each_side_once(spark, capsys):
    with settings_of(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        shown = plan(reviews.review_history(study.cards(spark, FOLDER), study.reviews(spark, FOLDER)), capsys)
        assert shown.count("Exchange hashpartitioning") == 2


def test_cloze_with_a_vocabulary_too_large_to_broadcast(spark, capsys, monkeypatch):
    docs = study.documents(spark, FOLDER)
    small = sorted(tuple(r) for r in cloze.cloze_cards(docs).collect())
    monkeypatch.setattr(sizing, "BROADCAST_BYTES", 0)
    with settings_of(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        frame = cloze.cloze_cards(docs, head_words=1000)
        shown = plan(frame, capsys)
        # Frequent words meet their ranks where they are; what is shuffled by word has lost them before.
        assert "BroadcastHashJoin" in shown and "ShuffledHashJoin" not in shown
        assert re.search(r"Exchange hashpartitioning\(key#\d+, \d+\), [^\n]*\n[^E]*BroadcastHashJoin \[key#\d+\], \[key#\d+\], LeftAnti", shown)
        assert sorted(tuple(r) for r in frame.collect()) == small


def test_nothing_runs_in_python(stored, as_of, spark, capsys):
    frames = [
        candidates.priority_scores(*stored, as_of), dashboard.subject_progress(*stored[:2]),
        reviews.apply_reviews(stored[0], study.reviews(spark, FOLDER)),
        reviews.review_history(stored[0], study.reviews(spark, FOLDER)),
        cloze.cloze_cards(study.documents(spark, FOLDER)),
    ]
    for frame in frames:
        assert not re.search("Python|InPandas", plan(frame, capsys))


def test_bucketed_cards_are_not_shuffled(spark, capsys, tmp_path):
    rows = spark.createDataFrame([card(i, mastery=1) for i in range(100)], CARDS)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS bucketed LOCATION '{tmp_path}/bucketed'")
    try:
        storage.save_cards(rows, "bucketed.cards", 16)
        cards = spark.table("bucketed.cards")
        graded = study.reviews(spark, FOLDER)
        with settings_of(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
            deltas = reviews.review_deltas(graded)
            shown = plan(cards.join(deltas, cards["id"] == deltas["card_id"], "left"), capsys)
            cards_side = shown.split("Join", 1)[1].split("FileScan parquet spark_catalog.bucketed.cards")[0]
            assert "Exchange" not in cards_side and "Bucketed: true" in shown
    finally:
        spark.sql("DROP DATABASE bucketed CASCADE")


def test_measured_sizes_cover_texts(spark):
    frame = spark.createDataFrame([("x" * 1000, 1), (None, 2)], "t string, n long")
    assert sizing.measured_bytes(frame, frame.limit(0)) == [2 * 80 + 1000, 0]


def test_few_files_are_spread_and_many_are_left(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/one")
    assert sizing.spread_over_cores(spark.read.parquet(f"{tmp_path}/one")).rdd.getNumPartitions() > 1
    spark.range(1000).repartition(64).write.parquet(f"{tmp_path}/many")
    many = spark.read.parquet(f"{tmp_path}/many")
    assert sizing.spread_over_cores(many) is many


def test_work_folder_comes_from_the_session():
    class Session:
        def __init__(self, folder, master):
            self.conf = {"spark.checkpoint.dir": folder}
            self.sparkContext = SimpleNamespace(master=master, getCheckpointDir=lambda: None)

    assert work_dir(Session("/shared/work", "spark://head:7077")) == "/shared/work"
    with pytest.raises(ValueError):
        work_dir(Session(None, "spark://head:7077"))
