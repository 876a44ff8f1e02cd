"""All registered core queries; importing this module fills the registry."""

from siltstone.plans import (  # noqa: F401
    analytics_queries,
    enrich_queries,
    graph_queries,
    hierarchy_queries,
    ingest_queries,
    more_queries,
    search_queries,
)
from siltstone.plans.registry import QUERIES, SQL  # noqa: F401
