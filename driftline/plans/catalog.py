"""All queries of the point-cloud and trajectory operators."""

from driftline.plans import scan_queries, space_queries, stage_queries, stream_queries, trajectory_queries  # noqa: F401
from driftline.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
