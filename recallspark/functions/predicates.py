"""Row conditions on cards."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..settings import MAX_MASTERY


def is_live(ignored: Column | None = None) -> Column:
    """Not set aside by the learner; written as an OR so that it is pushed into the scan."""
    ignored = F.col("ignored") if ignored is None else ignored
    return ignored.isNull() | (ignored == 0)


def is_learning(max_mastery: int = MAX_MASTERY, mastery: Column | None = None) -> Column:
    """Mastery below the top; cards of unknown mastery do not qualify."""
    mastery = F.col("mastery_level") if mastery is None else mastery
    return mastery < max_mastery
