"""All registered queries of the library and their SQL."""

from __future__ import annotations

from rillmark.plans import batch_queries, dataset_queries, decision_queries, diagnostic_queries, meaning_queries, ordered_queries, rollout_queries, text_queries
from rillmark.plans.queries import QUERIES, SQL, training_step

__all__ = ["QUERIES", "SQL", "batch_queries", "dataset_queries", "decision_queries", "diagnostic_queries", "meaning_queries", "ordered_queries", "rollout_queries", "text_queries", "training_step"]
