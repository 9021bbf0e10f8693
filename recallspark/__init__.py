"""Spaced-review study data on Spark: scoring, queues, progress, grade folding, card making."""

from .operators.candidates import eligible_cards, live_cards, priority_scores, reason_counts, review_candidates
from .operators.dashboard import dashboard_totals, subject_imports, subject_names, subject_progress, subjects_view
from .operators.queue import (
    daily_queue, quota_status, random_card, recommendations_on_day, recommended_card, top_priority_cards,
)
from .operators.reviews import apply_reviews, grade_steps, review_history
from .operators.cloze import cloze_cards
from .plans.dashboard import dashboard
from .plans.document_import import import_documents
from .plans.study_day import close_day, plan_day
from .settings import ScoreWeights
from .streaming.card_state import compact_deltas, latest_states, updated_cards, write_deltas

__all__ = [
    "ScoreWeights", "apply_reviews", "compact_deltas", "close_day", "cloze_cards", "daily_queue", "dashboard",
    "dashboard_totals", "eligible_cards", "grade_steps", "import_documents", "latest_states", "live_cards",
    "plan_day", "priority_scores", "quota_status", "random_card", "reason_counts", "recommendations_on_day",
    "recommended_card", "review_candidates", "review_history", "subject_imports", "subject_names",
    "subject_progress", "subjects_view", "top_priority_cards", "updated_cards", "write_deltas",
]
