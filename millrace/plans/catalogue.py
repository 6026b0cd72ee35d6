"""All registered queries of the library proper."""

from millrace.plans import curation, datasets, evaluation, scoring, texts, windows  # noqa: F401
from millrace.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
