"""All queries of the engine and their SQL, by name."""

from leafmill.plans import answer_queries, ingest_queries  # noqa: F401  they enter their queries
from leafmill.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
