"""All queries of the library and their SQL."""

from leaklens.plans import audits, generation, methods, replay, retrieval, verdicts  # noqa: F401  modules add their queries to the registry
from leaklens.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
