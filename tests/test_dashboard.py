import pytest

from recallspark.operators.dashboard import (
    dashboard_totals, progress_lines, quota_line, subject_imports, subject_progress, subjects_view, total_lines,
)
from recallspark.plans.dashboard import dashboard
from recallspark.schemas import CARD_DEFAULTS, CARDS, IMPORTED_FILES, RECOMMENDATION_LOGS, SUBJECTS, with_defaults
from test_dates_and_scores import card


def cards_of(spark, rows):
    return spark.createDataFrame(rows, CARDS)


def test_totals(spark, as_of):
    rows = [
        card(1, mastery=1), card(2, mastery=4, ignored=None, last="2024-01-14 23:00:00"), card(3, mastery=5, ignored=1),
        card(4, subject_id=99, mastery=None), card(5, mastery=3, last="2024-01-15T00:00"),
    ]
    row = dashboard_totals(cards_of(spark, rows), as_of).first()
    assert (row.total_cards, row.today_reviews, row.avg_mastery) == (4, 3, 2.67)
    assert total_lines(dashboard_totals(cards_of(spark, rows), as_of)).first().mastery_line == "2.67 / 5.0"


@pytest.mark.parametrize("rows", [[], [card(1, mastery=None)], [card(1, mastery=0)], [card(1, ignored=1)]])
def test_mean_of_nothing_is_zero(spark, as_of, rows):
    assert dashboard_totals(cards_of(spark, rows), as_of).first().avg_mastery == 0.0


def test_progress(spark):
    subjects = spark.createDataFrame([(i, n, 1.0, 1.0, None) for i, n in ((1, "a"), (2, "b"), (3, "c"), (4, "a"))], SUBJECTS)
    cards = cards_of(spark, [
        card(1, 1, mastery=4), card(2, 1, mastery=1, ignored=1), card(3, 1, mastery=3), card(4, 2, mastery=2, ignored=1),
        card(5, 99, mastery=5), card(6, 4, mastery=7), card(7, 4, mastery=None),
    ])
    rows = {r.subject_id: r for r in subject_progress(cards, subjects).collect()}
    assert {i: (r.avg_mastery, r.card_count) for i, r in rows.items()} == {1: (3.5, 2), 2: (0.0, 0), 3: (0.0, 1), 4: (7.0, 2)}
    assert rows[1].progress == 0.7
    lines = {r.subject_id: (r.heading, r.bar) for r in progress_lines(subject_progress(cards, subjects)).collect()}
    assert lines[4] == ("a (2)", 1.0)
    strict = {r.subject_id: r.card_count for r in subject_progress(cards, subjects, count_missing=False).collect()}
    assert strict == {1: 2, 2: 0, 3: 0, 4: 2}


def test_imports(spark):
    files = spark.createDataFrame([
        (1, 1, "b.md", "t"), (2, 1, "a.md", "t"), (3, 1, "b.md", "t"), (4, 9, "z", "t")], IMPORTED_FILES)
    assert {tuple(r) for r in subject_imports(files).collect()} == {(1, "a.md,b.md"), (9, "z")}
    subjects = spark.createDataFrame([(1, "s", 1.0, 1.0, None), (2, "t", 1.0, 1.0, None)], SUBJECTS)
    assert {(r.id, r.imported_files) for r in subjects_view(subjects, files).collect()} == {(1, "a.md,b.md"), (2, "")}


def test_dashboard_together(spark, as_of):
    subjects = spark.createDataFrame([(1, "s", 1.0, 1.0, None)], SUBJECTS)
    logs = spark.createDataFrame([(1, 2, "2024-01-15 01:00:00")], RECOMMENDATION_LOGS)
    shown = dashboard(cards_of(spark, [card(1), card(2), card(3)]), subjects, logs, as_of, n=1)
    assert shown.totals.first().total_cards == 3
    assert [r.id for r in shown.top_cards.collect()] == [1]
    assert shown.quota.first().quota_line == quota_line(logs, as_of).first().quota_line == "1 / 100"


def test_missing_columns_get_defaults(spark):
    old = spark.createDataFrame([(1, 2, "q")], "id int, subject_id long, question string")
    new = with_defaults(old, CARDS, CARD_DEFAULTS)
    assert [(f.name, f.dataType) for f in new.schema] == [(f.name, f.dataType) for f in CARDS]
    assert (new.first().ignored, new.first().mastery_level, new.first().answer) == (0, 0, None)
    kept = with_defaults(cards_of(spark, [card(1, ignored=None)]), CARDS, CARD_DEFAULTS)
    assert kept.first().ignored is None
