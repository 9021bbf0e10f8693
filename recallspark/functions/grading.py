"""What one self-grade does to a card.

Grades 2 and 0 set mastery outright, 1 raises it by one up to the top, -1 sets
the card aside; any other value only counts as a review. Over a run of grades
this means: the last outright setting (or the start value) plus the number of
1-grades since then, capped. ``reviews`` builds on that form.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..settings import GRADE_AGAIN, GRADE_FORGOT, GRADE_IGNORE, GRADE_KNOWN, MAX_MASTERY


def reset_value(grade: Column, max_mastery: int = MAX_MASTERY) -> Column:
    """Mastery the grade sets outright, NULL if it does not."""
    return F.when(grade == GRADE_KNOWN, F.lit(max_mastery)).when(grade == GRADE_FORGOT, F.lit(0))


def ignored_value(grade: Column) -> Column:
    """The ignored flag the grade sets, NULL if it leaves it alone."""
    return (
        F.when(grade == GRADE_IGNORE, F.lit(1))
        .when(grade.isin(GRADE_FORGOT, GRADE_AGAIN, GRADE_KNOWN), F.lit(0))
    )


def raised(base: Column, raises: Column, max_mastery: int = MAX_MASTERY) -> Column:
    """Mastery after ``raises`` 1-grades from ``base``."""
    return F.when(raises > 0, F.least(F.lit(max_mastery), base + raises)).otherwise(base).cast("int")


def grade_step(mastery: Column, ignored: Column, grade: Column, max_mastery: int = MAX_MASTERY) -> tuple[Column, Column]:
    """(mastery, ignored) after one grade."""
    base = F.coalesce(reset_value(grade, max_mastery), mastery, F.lit(0))
    raises = F.when(grade == GRADE_AGAIN, F.lit(1)).otherwise(F.lit(0))
    return (
        raised(base, raises, max_mastery),
        F.coalesce(ignored_value(grade), ignored, F.lit(0)).cast("int"),
    )
