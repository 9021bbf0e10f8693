"""Constants of the study data model.

Every one of them is also a parameter of the functions that use it.
"""

from __future__ import annotations

from dataclasses import dataclass

# Results depend on these numbers and texts.
DAILY_LIMIT = 100
TOP_CARDS = 5
MAX_MASTERY = 5
NEVER_REVIEWED_DAYS = 100
NO_DEADLINE_DAYS = 999
OVERDUE_URGENCY = 2.0
# Characters of a text that one prompt holds.
PROMPT_CHARS = 15000
BLANK = "____"

GRADE_IGNORE = -1
GRADE_FORGOT = 0
GRADE_AGAIN = 1
GRADE_KNOWN = 2


@dataclass(frozen=True)
class ScoreWeights:
    urgency: float = 100.0
    importance: float = 5.0
    forgetting: float = 1.0
    mastery: float = 6.0


@dataclass(frozen=True)
class ReasonLabels:
    overdue: str = "已逾期"
    days_left: str = "DDL 仅剩 {days} 天"
    deadline_near: str = "DDL 临近"
    long_unreviewed: str = "很久没复习"
    low_mastery: str = "掌握度低"
    key_subject: str = "重点学科"
    default: str = "综合推荐"
    separator: str = " + "


@dataclass(frozen=True)
class ReasonLimits:
    urgency: float = 0.1
    last_days: int = 3
    unreviewed_days: int = 7
    low_mastery: int = 2
    importance: float = 10.0


WEIGHTS = ScoreWeights()
LABELS = ReasonLabels()
LIMITS = ReasonLimits()
