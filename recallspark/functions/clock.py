"""Text dates and whole-day arithmetic against an explicit "as of" time.

All times are wall-clock times without a zone, so results do not depend on the
session time zone. Two readings of text exist side by side: the scoring reading
(``deadline_date``, ``review_moment``) takes one- or two-digit fields, the
calendar-day reading (``on_day``) takes ISO text with an optional time.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, functions as F

# Accepted text forms.
DATE_FORM = r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}\z"
MOMENT_FORM = r"^(?!0000)\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\z"
MOMENT_FORM_ANY_BLANKS = r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}\z"
REST_OF_DAY_FORM = r"^.{10}[\sT]*(([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?)?\s*[zZ]?\s*\z"


def as_of_text(as_of: datetime) -> str:
    return as_of.strftime("%Y-%m-%d %H:%M:%S")


def time_of_day(as_of: datetime) -> timedelta:
    return as_of - datetime.combine(as_of.date(), datetime.min.time())


def deadline_date(text: Column) -> Column:
    """Deadline text as a date, NULL where it is not one."""
    return F.when(text.rlike(DATE_FORM), text).try_cast("date")


def review_moment(text: Column) -> Column:
    """Review-time text as a zone-less timestamp, NULL where it is not one."""
    one_blank = F.regexp_replace(text, r"\s+", " ")
    readable = F.when(text.rlike(MOMENT_FORM), text).when(text.rlike(MOMENT_FORM_ANY_BLANKS), one_blank)
    return readable.try_cast("timestamp_ntz")


def moment_text(moment: Column) -> Column:
    """A zone-less timestamp as text, cut to whole seconds."""
    return F.left(moment.cast("timestamp_ntz").cast("string"), F.lit(19))


def days_until(day: Column, as_of: datetime) -> Column:
    """floor(midnight of ``day`` - as_of), in days: the day itself is already -1 after 00:00."""
    started = 1 if time_of_day(as_of) > timedelta(0) else 0
    return F.datediff(day, F.lit(as_of.date())) - F.lit(started)


def days_since(moment: Column, as_of: datetime) -> Column:
    """floor(as_of - ``moment``), in days; negative for future moments."""
    day = moment.cast("date")
    later_in_day = (moment - day.cast("timestamp_ntz")) > F.lit(time_of_day(as_of))
    return F.datediff(F.lit(as_of.date()), day) - later_in_day.cast("int")


def on_day(text: Column, day: date) -> Column:
    """Does timestamp text fall on ``day``?

    The prefix test alone decides for nearly every row and reaches the parquet
    reader as a pushed filter; the pattern only runs on rows that pass it.
    """
    return F.coalesce(text.startswith(day.isoformat()) & text.rlike(REST_OF_DAY_FORM), F.lit(False))


def on_day_filter(text: Column, day: date) -> Column:
    """``on_day`` for use in ``where``, without the NULL guard that would block pushdown."""
    return text.startswith(day.isoformat()) & text.rlike(REST_OF_DAY_FORM)


def named_day(text: Column) -> Column:
    """The day on which timestamp text falls, as ISO text; NULL if on none. Equal to ``on_day`` for every day."""
    first = F.left(text, F.lit(10))
    return F.when(text.rlike(REST_OF_DAY_FORM) & first.rlike(r"^\d{4}-\d{2}-\d{2}\z"), first)
