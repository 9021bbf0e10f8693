from datetime import date, datetime, timedelta
from math import floor

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from recallspark.functions import clock, scoring
from recallspark.functions.text import round_to_cents
from recallspark.operators.candidates import priority_scores, review_candidates
from recallspark.operators.queue import (
    daily_queue, quota_status, random_card, recommended_card, top_priority_cards,
)
from recallspark.schemas import CARDS, RECOMMENDATION_LOGS, SUBJECTS
from recallspark.settings import ReasonLabels, ScoreWeights

DAY = date(2024, 1, 15)


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")


def python_days(form, text, as_of, ahead):
    try:
        moment = datetime.strptime(text, form)
    except (TypeError, ValueError):
        return None
    gap = moment - as_of if ahead else as_of - moment
    return floor(gap / timedelta(days=1))


DATES = [
    "2024-01-15", "2024-01-16", "2024-01-14", "2024-1-7", "2024-01-7", "2024-02-30", "2024-13-01", "24-01-15", "",
    "TBD", None, "2024-01-15 ", " 2024-01-15", "2024-01-15 10:00:00", "0000-01-01", "2023-12-31", "2024/01/15", "2025-01-15\n",
]
MOMENTS = [
    "2024-01-15 10:00:00", "2024-01-15 10:00:01", "2024-01-15 09:59:59", "2024-01-14 10:00:00", "2024-01-14 10:00:01",
    "2024-01-20 00:00:00", "2024-1-7 3:4:5", "2024-01-15T10:00:00", "2024-01-15", "never", "", None,
    "2024-01-15  10:00:00", "2024-01-15 24:00:00", "2024-01-15 10:00:60", "2024-01-15 10:00", "2024-01-15 10:00:00.5",
]


@pytest.mark.parametrize("hour", [0, 10])
def test_days_left_floors_from_midnight(spark, hour):
    now = datetime(2024, 1, 15, hour)
    rows = texts(spark, DATES).select("i", clock.days_until(clock.deadline_date(F.col("x")), now).alias("d")).collect()
    assert {DATES[r.i]: r.d for r in rows} == {t: python_days("%Y-%m-%d", t, now, True) for t in DATES}


def test_exam_day_is_overdue_and_tomorrow_is_zero(spark, as_of):
    rows = texts(spark, ["2024-01-15", "2024-01-16"]).select(
        clock.days_until(clock.deadline_date(F.col("x")), as_of).alias("d")).collect()
    assert [r.d for r in rows] == [-1, 0]


def test_days_since_review_floors(spark, as_of):
    rows = texts(spark, MOMENTS).select("i", clock.days_since(clock.review_moment(F.col("x")), as_of).alias("d")).collect()
    assert {MOMENTS[r.i]: r.d for r in rows} == {
        t: python_days("%Y-%m-%d %H:%M:%S", t, as_of, False) for t in MOMENTS}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="0123456789-: T", min_size=8, max_size=20)
                | st.datetimes(datetime(1990, 1, 1), datetime(2060, 1, 1)).map(lambda d: d.strftime("%Y-%m-%d %H:%M:%S")),
                min_size=50, max_size=200))
def test_days_since_like_strptime(spark, values):
    now = datetime(2024, 1, 15, 10)
    rows = texts(spark, values).select("i", clock.days_since(clock.review_moment(F.col("x")), now).alias("d")).collect()
    assert [r.d for r in sorted(rows)] == [python_days("%Y-%m-%d %H:%M:%S", v, now, False) for v in values]


def test_results_do_not_depend_on_the_session_zone(spark, as_of):
    frame = texts(spark, MOMENTS).select("i", clock.days_since(clock.review_moment(F.col("x")), as_of).alias("d"))
    before = frame.collect()
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert texts(spark, MOMENTS).select(
            "i", clock.days_since(clock.review_moment(F.col("x")), as_of).alias("d")).collect() == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("text,expected", [
    ("2024-01-15", True), ("2024-01-15 23:59:59", True), ("2024-01-15T10:00", True), ("2024-01-15 10:00:00.25", True),
    ("2024-01-15 10:00Z", True), ("2024-01-15 ", True), ("2024-1-15", False), ("2024-01-16 00:00:00", False),
    ("2024-01-15 25:00:00", False), ("2024-01-15 10", False), ("2024-01-15x", False), ("", False), (None, False),
])
def test_calendar_day_of_text(spark, text, expected):
    frame = texts(spark, [text])
    assert frame.select(clock.on_day(F.col("x"), DAY).alias("hit")).first().hit is expected
    assert frame.where(clock.on_day_filter(F.col("x"), DAY)).count() == int(expected)


def test_rounding_is_that_of_python(spark):
    values = [s / n for n in range(1, 130) for s in range(0, 5 * n + 1)] + [2.675, 0.125, 1.005, 4.995, 1234567.125]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", round_to_cents(F.col("v")).alias("r")).collect()
    assert [(r.v, r.r) for r in rows if r.r != round(r.v, 2)] == []


@pytest.mark.parametrize("credits,difficulty,expected", [
    (None, None, 1.0), (0.0, 3.0, 3.0), (2.0, 0.0, 2.0), (None, 4.0, 4.0), (2.5, 4.0, 10.0)])
def test_missing_or_zero_factors_count_as_one(spark, credits, difficulty, expected):
    row = spark.createDataFrame([(credits, difficulty)], "c double, d double")
    assert row.select(scoring.importance(F.col("c"), F.col("d"))).first()[0] == expected


# -- whole tables ------------------------------------------------------------------------------------------------

def card(id, subject_id=1, last="2024-01-15 09:00:00", mastery=2, ignored=0, count=0):
    return (id, subject_id, f"q{id}", f"a{id}", "2024-01-01 00:00:00", last, count, mastery, ignored)


def tables(spark, cards, subjects=None, logs=()):
    subjects = subjects or [(1, "S", 1.0, 1.0, None)]
    return (
        spark.createDataFrame(cards, CARDS), spark.createDataFrame(subjects, SUBJECTS),
        spark.createDataFrame(list(logs), RECOMMENDATION_LOGS),
    )


def by_id(frame):
    return {r.id: r for r in frame.collect()}


def test_eligibility(spark, as_of):
    frames = tables(
        spark,
        [card(1), card(2, mastery=None), card(3, mastery=5), card(4, ignored=1), card(5, ignored=None),
         card(6, subject_id=99), card(7), card(8), card(9, subject_id=None)],
        logs=[(1, 7, "2024-01-15 08:00:00"), (2, 8, "2024-01-14 23:59:59"), (3, 1, "2024-1-15 08:00:00")],
    )
    assert set(by_id(review_candidates(*frames, as_of))) == {1, 5, 8}
    assert set(by_id(priority_scores(*frames, as_of))) == {1, 5, 8}


def test_scores_and_reasons(spark, as_of):
    subjects = [
        (1, "today", 1.0, 1.0, "2024-01-15"), (2, "tomorrow", 1.0, 1.0, "2024-01-16"), (3, "in ten", 1.0, 1.0, "2024-01-25"),
        (4, "in eleven", 1.0, 1.0, "2024-01-26"), (5, "bad", 5.0, 2.5, "soon"), (6, "empty", None, 0.0, ""),
    ]
    frames = tables(spark, [card(i, subject_id=i) for i in range(1, 7)] + [
        card(11, 6, last=None, mastery=0), card(12, 6, last="2024-01-08 10:00:00"), card(13, 6, last="2024-01-07 10:00:00"),
        card(14, 6, last="2024-01-18 10:00:00"), card(15, 6, last="whenever", mastery=-1),
    ], subjects)
    rows = by_id(priority_scores(*frames, as_of))
    assert {i: rows[i].reason for i in rows} == {
        1: "已逾期", 2: "DDL 仅剩 0 天", 3: "DDL 临近", 4: "综合推荐", 5: "重点学科", 6: "综合推荐",
        11: "很久没复习 + 掌握度低", 12: "综合推荐", 13: "很久没复习", 14: "综合推荐", 15: "很久没复习 + 掌握度低",
    }
    assert [rows[i].days_left for i in range(1, 7)] == [-1, 0, 9, 10, 999, 999]
    assert [rows[i].urgency for i in range(1, 7)] == [2.0, 1.0, 0.1, 1 / 11, 0.0, 0.0]
    assert [rows[i].days_since_review for i in (11, 12, 13, 14, 15)] == [100, 7, 8, -3, 100]
    assert rows[3].priority_score == 0.1 * 100.0 + 1.0 * 5.0 + 0 * 1.0 + 3 * 6.0
    assert rows[14].priority_score == 0.0 + 5.0 - 3.0 + 18.0
    assert rows[15].mastery_gap == 6


def test_weights_and_labels_are_parameters(spark, as_of):
    frames = tables(spark, [card(1, last=None)], [(1, "S", 2.0, 3.0, "2024-01-10")])
    weights = ScoreWeights(urgency=1.0, importance=2.0, forgetting=0.5, mastery=0.0)
    row = priority_scores(*frames, as_of, weights, labels=ReasonLabels(overdue="late", long_unreviewed="old")).first()
    assert (row.priority_score, row.reason) == (2.0 + 12.0 + 50.0, "late + old")


def test_ties_go_to_the_smaller_id(spark, as_of):
    frames = tables(spark, [card(i) for i in (9, 3, 7, 1)])
    scored = priority_scores(*frames, as_of)
    assert [r.id for r in top_priority_cards(scored, frames[2], as_of, 3).orderBy("position").collect()] == [1, 3, 7]
    assert recommended_card(scored, frames[2], as_of).first().id == 1


def logged(n, start=1000):
    return [(i, start + i, "2024-01-15 07:00:00") for i in range(n)]


@pytest.mark.parametrize("used,remaining,reached", [(0, 3, False), (2, 1, False), (3, 0, True), (5, 0, True)])
def test_quota_counts_log_rows(spark, as_of, used, remaining, reached):
    frames = tables(spark, [card(i) for i in range(1, 6)], logs=logged(used))
    scored = priority_scores(*frames, as_of)
    status = quota_status(frames[2], as_of, 3).first()
    assert (status.remaining, status.daily_limit_reached) == (remaining, reached)
    assert daily_queue(scored, frames[2], as_of, 3)[0].count() == remaining
    assert recommended_card(scored, frames[2], as_of, 3).count() == (0 if reached else 1)
    # The top list is all or nothing.
    assert top_priority_cards(scored, frames[2], as_of, 5, 3).count() == (0 if reached else 5)


def test_queue_is_the_repeated_best_card(spark, as_of):
    cards = [card(i, last=f"2024-01-{1 + i % 13:02d} 08:00:00", mastery=i % 5) for i in range(1, 30)]
    logs = logged(2)
    frames = tables(spark, cards, logs=logs)
    queue, log_rows = daily_queue(priority_scores(*frames, as_of), frames[2], as_of, 8)
    expected = []
    for _ in range(6):
        frame = spark.createDataFrame(logs, RECOMMENDATION_LOGS)
        best = recommended_card(priority_scores(frames[0], frames[1], frame, as_of), frame, as_of, 8).first()
        expected.append(best.id)
        logs.append((max(r[0] for r in logs) + 1, best.id, "2024-01-15 10:00:00"))
    assert [r.id for r in queue.orderBy("position").collect()] == expected
    assert [tuple(r) for r in log_rows.orderBy("id").collect()] == logs[2:]
    rerun = spark.createDataFrame(logs, RECOMMENDATION_LOGS)
    assert daily_queue(priority_scores(frames[0], frames[1], rerun, as_of), rerun, as_of, 8)[0].isEmpty()


def test_random_card_is_seeded_and_eligible(spark):
    cards = spark.createDataFrame([card(i, subject_id=99, mastery=5 if i % 2 else 1) for i in range(50)], CARDS)
    picks = {seed: random_card(cards, seed).first().id for seed in range(8)}
    assert picks == {seed: random_card(cards.repartition(3), seed).first().id for seed in range(8)}
    assert len(set(picks.values())) > 1 and all(i % 2 == 0 for i in picks.values())


def test_empty_tables(spark, as_of):
    frames = tables(spark, [])
    scored = priority_scores(*frames, as_of)
    assert scored.isEmpty() and top_priority_cards(scored, frames[2], as_of).isEmpty()
    assert daily_queue(scored, frames[2], as_of)[1].isEmpty()
