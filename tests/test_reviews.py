"""Grade folding against a sequential fold."""

import random
from datetime import datetime, timedelta
from itertools import product

import pytest
from pyspark.sql import functions as F

from recallspark.operators import reviews as R
from recallspark.schemas import CARDS
from recallspark.streaming import card_state as S
from test_dates_and_scores import card

START = datetime(2024, 1, 1)
REVIEWS = "review_id long, card_id long, reviewed_at timestamp_ntz, grade int"


def step(mastery, ignored, grade):
    """One grade, as the rules say it in words."""
    mastery, ignored = mastery or 0, ignored or 0
    if grade == -1:
        return mastery, 1
    if grade == 2:
        return 5, 0
    if grade == 1:
        return min(5, mastery + 1), 0
    if grade == 0:
        return 0, 0
    return mastery, ignored


def fold(cards, reviews):
    """(end state per card, state after each review)."""
    state = {c[0]: (c[7], c[8], c[6], c[5]) for c in cards}
    after = {}
    for review_id, card_id, at, grade in sorted(reviews, key=lambda r: (r[2], r[0])):
        if card_id not in state:
            continue
        mastery, ignored, count, _ = state[card_id]
        mastery, ignored = step(mastery, ignored, grade)
        count = None if count is None else count + 1
        state[card_id] = (mastery, ignored, count, at.strftime("%Y-%m-%d %H:%M:%S"))
        after[review_id] = (mastery, ignored, count)
    return state, after


def random_case(seed, n=600, cards=12):
    rnd = random.Random(seed)
    rows = [
        card(i, mastery=rnd.choice([None, -1, 0, 1, 2, 3, 4, 5, 6]), ignored=rnd.choice([None, 0, 1]),
             count=rnd.choice([None, 0, 3]), last=None)
        for i in range(cards)
    ]
    reviews = [
        # Every third review is on card 0; times collide; some cards are unknown.
        (i, 0 if i % 3 == 0 else rnd.randrange(cards + 2), START + timedelta(minutes=rnd.randrange(n // 2)),
         rnd.choice([-1, 0, 1, 1, 1, 1, 2, 9]))
        for i in range(n)
    ]
    rnd.shuffle(reviews)
    return rows, reviews


def test_every_single_grade(spark):
    cases = list(product([None, -1, 0, 1, 2, 3, 4, 5, 6], [None, 0, 1], [-1, 0, 1, 2, 9]))
    cards = spark.createDataFrame([card(i, mastery=m, ignored=g) for i, (m, g, _) in enumerate(cases)], CARDS)
    reviews = spark.createDataFrame([(i, i, START, g) for i, (_, _, g) in enumerate(cases)], REVIEWS)
    rows = {r.review_id: (r.new_mastery, r.new_ignored) for r in R.grade_steps(cards, reviews).collect()}
    assert rows == {i: step(*case) for i, case in enumerate(cases)}


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("hot_reviews", [None, R.HOT_REVIEWS, 60, 7])
def test_history_is_the_sequential_fold(spark, seed, hot_reviews):
    rows, reviews = random_case(seed)
    history = R.review_history(
        spark.createDataFrame(rows, CARDS), spark.createDataFrame(reviews, REVIEWS), hot_reviews=hot_reviews)
    assert {r.review_id: (r.mastery_level, r.ignored, r.review_count) for r in history.collect()} == fold(rows, reviews)[1]


@pytest.mark.parametrize("seed", range(5))
def test_snapshot_is_the_end_of_the_fold(spark, seed):
    rows, reviews = random_case(seed)
    cards = R.apply_reviews(spark.createDataFrame(rows, CARDS), spark.createDataFrame(reviews, REVIEWS))
    assert cards.columns == CARDS.names
    got = {r.id: (r.mastery_level, r.ignored, r.review_count, r.last_reviewed_at) for r in cards.collect()}
    assert got == fold(rows, reviews)[0]


def test_any_split_into_batches_ends_the_same(spark):
    rows, reviews = random_case(11)
    reviews.sort(key=lambda r: (r[2], r[0]))
    cards = spark.createDataFrame(rows, CARDS)
    for part in (reviews[:70], reviews[70:71], reviews[71:400], reviews[400:]):
        cards = R.apply_reviews(cards, spark.createDataFrame(part, REVIEWS))
    got = {r.id: (r.mastery_level, r.ignored, r.review_count, r.last_reviewed_at) for r in cards.collect()}
    assert got == fold(rows, reviews)[0]


def test_hot_cards_found_by_a_sample(spark, monkeypatch):
    """20,000 reviews, two hot cards, one of them unknown; the sample holds a third of the reviews."""
    rng = random.Random(5)
    cards = [card(i, mastery=i % 5) for i in range(1, 60)]
    rows = [(i, rng.choice([1] * 6 + [99] * 6 + list(range(2, 60))[:8]), START + timedelta(seconds=rng.randrange(10**6)),
             rng.choice([-1, 0, 1, 1, 1, 2, 9])) for i in range(20_000)]
    reviews = spark.createDataFrame(rows, REVIEWS)
    known = spark.createDataFrame(cards, CARDS)
    assert R.HOT_SAMPLE < 3000
    hot = R.settled_hot_cards(reviews, 3000, known.select(F.col("id").alias("card_id")))
    assert [r.card_id for r in hot.collect()] == [1]
    even, ranged = (sorted(tuple(r) for r in R.review_history(known, reviews, hot_reviews=n).collect()) for n in (None, 3000))
    assert even == ranged and len(even) == sum(r[1] != 99 for r in rows)


def test_other_top_mastery(spark):
    cards = spark.createDataFrame([card(1, mastery=1, count=0)], CARDS)
    reviews = spark.createDataFrame([(i, 1, START + timedelta(hours=i), 1) for i in range(12)], REVIEWS)
    assert R.apply_reviews(cards, reviews, max_mastery=8).first().mastery_level == 8
    assert R.review_history(cards, reviews, max_mastery=8).agg(F.max("mastery_level")).first()[0] == 8


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("hot_reviews", [None, 7, 60])
def test_deltas_with_and_without_hot_cards(spark, seed, hot_reviews):
    """Hot cards are gathered, others ordered; reviews without a card change nothing."""
    rows, reviews = random_case(seed)
    reviews += [(10_000 + i, None, START, 2) for i in range(100)]
    cards = R.apply_reviews(spark.createDataFrame(rows, CARDS), spark.createDataFrame(reviews, REVIEWS), hot_reviews=hot_reviews)
    got = {r.id: (r.mastery_level, r.ignored, r.review_count, r.last_reviewed_at) for r in cards.collect()}
    assert got == fold(rows, reviews)[0]


def drained(spark, tmp_path, rows, reviews, batches, between=lambda out: None, **options):
    """``reviews`` in so many files, each streamed by a query of its own; gives the folder of deltas."""
    size = -(-len(reviews) // batches)
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(REVIEWS).option("maxFilesPerTrigger", 1).parquet(source)
    for i in range(batches):
        spark.createDataFrame(reviews[i * size:(i + 1) * size], REVIEWS).coalesce(1).write.mode("append").parquet(source)
        # A stopped and restarted query goes on where it was.
        S.write_deltas(stream, out, checkpoint, **options).awaitTermination()
        between(out)
    return out


def states(spark, out, cards):
    return {r.card_id: tuple(r)[1:] for r in S.latest_states(spark, out, cards).select(
        "card_id", "mastery_level", "ignored", "review_count", "last_reviewed_at").collect()}


@pytest.mark.parametrize("batches,compacted,hot_reviews", [(1, False, None), (5, False, None), (5, True, 20)])
def test_stream_is_the_fold(spark, tmp_path, batches, compacted, hot_reviews):
    rows, reviews = random_case(5)
    reviews.sort(key=lambda r: (r[2], r[0]))
    cards = spark.createDataFrame(rows, CARDS)
    out = drained(spark, tmp_path, rows, reviews, batches, (lambda o: S.compact_deltas(spark, o)) if compacted else (lambda o: None),
                  hot_reviews=hot_reviews)
    state, _ = fold(rows, reviews)
    reviewed = {r[1] for r in reviews}
    wanted = {i: x for i, x in state.items() if i in reviewed}
    assert states(spark, out, cards) == wanted
    for _ in range(2):
        S.compact_deltas(spark, out)
        assert states(spark, out, cards) == wanted
    updated = S.updated_cards(spark, out, cards)
    assert {r.id: (r.mastery_level, r.ignored, r.review_count, r.last_reviewed_at) for r in updated.collect()} == state


def test_late_reviews_count_when_they_come(spark, tmp_path):
    """A batch of older reviews comes after; it is applied after, as by hand."""
    rows = [card(1, mastery=3, count=0, last=None)]
    batches = [[(1, 1, START + timedelta(days=2), 0), (2, 1, START + timedelta(days=3), 1)], [(3, 1, START, 2), (4, 1, START, -1)]]
    out = drained(spark, tmp_path, rows, batches[0] + batches[1], 2)
    assert states(spark, out, spark.createDataFrame(rows, CARDS)) == {1: (5, 1, 4, "2024-01-01 00:00:00")}


def test_a_batch_reads_only_its_reviews(spark, tmp_path, capsys):
    """No Python, no cards, no aggregation by sorting: one scan, one shuffle."""
    spark.createDataFrame(random_case(1)[1], REVIEWS).write.parquet(f"{tmp_path}/r")
    capsys.readouterr()
    R.review_deltas(spark.read.parquet(f"{tmp_path}/r")).explain()
    shown = capsys.readouterr().out
    assert shown.count("FileScan") == shown.count("Exchange hashpartitioning") == 1
    assert "SortAggregate" not in shown and "Python" not in shown and "Pandas" not in shown


def test_stream_that_has_written_nothing(spark, tmp_path):
    cards = spark.createDataFrame([card(1)], CARDS)
    assert S.latest_states(spark, str(tmp_path / "none"), cards).isEmpty()
    assert [tuple(r) for r in S.updated_cards(spark, str(tmp_path / "none"), cards).collect()] == [card(1)]
