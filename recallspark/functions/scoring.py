"""Score factors and the text that explains them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..settings import LABELS, LIMITS, NEVER_REVIEWED_DAYS, NO_DEADLINE_DAYS, OVERDUE_URGENCY, ReasonLabels, ReasonLimits


def urgency(days: Column) -> Column:
    """2.0 once overdue, 1/(days+1) before, 0 without a readable deadline."""
    return (
        F.when(days < 0, F.lit(OVERDUE_URGENCY))
        .when(days >= 0, F.lit(1.0) / (days + 1))
        .otherwise(F.lit(0.0))
    )


def days_left(days: Column) -> Column:
    return F.coalesce(days, F.lit(NO_DEADLINE_DAYS))


def importance(credits: Column, difficulty: Column) -> Column:
    """Credits x difficulty, where a missing or zero factor counts as 1."""
    def factor(value):
        return F.coalesce(F.nullif(value.cast("double"), F.lit(0.0)), F.lit(1.0))

    return factor(credits) * factor(difficulty)


def forgetting(days: Column) -> Column:
    return F.coalesce(days, F.lit(NEVER_REVIEWED_DAYS))


def deadline_label(urgency_value: Column, days: Column, labels: ReasonLabels = LABELS,
                   limits: ReasonLimits = LIMITS) -> Column:
    """The deadline's part of the reason, NULL while the deadline is far or unknown."""
    before, after = labels.days_left.split("{days}")
    label = (
        F.when(days < 0, F.lit(labels.overdue))
        .when(days < limits.last_days, F.concat(F.lit(before), days.cast("string"), F.lit(after)))
        .otherwise(F.lit(labels.deadline_near))
    )
    return F.when(urgency_value >= limits.urgency, label)


def importance_label(value: Column, labels: ReasonLabels = LABELS, limits: ReasonLimits = LIMITS) -> Column:
    return F.when(value > limits.importance, F.lit(labels.key_subject))


def reason(deadline: Column, days_unreviewed: Column, mastery: Column, key_subject: Column,
           labels: ReasonLabels = LABELS, limits: ReasonLimits = LIMITS) -> Column:
    """The labels that apply, in fixed order; the default label when none does."""
    found = F.concat_ws(
        labels.separator,
        deadline,
        F.when(days_unreviewed > limits.unreviewed_days, F.lit(labels.long_unreviewed)),
        F.when(mastery < limits.low_mastery, F.lit(labels.low_mastery)),
        key_subject,
    )
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(labels.default))
