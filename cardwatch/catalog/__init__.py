"""All registered queries and their SQL twins."""

from cardwatch.catalog.base import ORACLE, QUERIES
from cardwatch.catalog import attempts, control, detection, incidents, ingest, learning, reports, streams  # noqa: F401  (they register their queries)

__all__ = ["ORACLE", "QUERIES"]
