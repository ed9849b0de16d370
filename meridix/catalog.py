"""All registered queries of the library and their SQL twins."""

from meridix.plans import accounts, claims, delivery, evidence, ingestion, intake, people, queue, records, reports, resolution, routing, snapshot  # noqa: F401  (they register their queries)
from meridix.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
