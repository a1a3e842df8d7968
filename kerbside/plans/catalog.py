"""All registered queries and oracles; importing the modules fills the registry."""

from kerbside.plans import (  # noqa: F401
    queries_detection,
    queries_geometry,
    queries_grid,
    queries_maps,
    queries_rules,
    queries_sources,
    queries_streams,
    queries_tables,
    queries_text,
    queries_windows,
)
from kerbside.plans.registry import QUERIES, composed

ORACLES = composed()

__all__ = ["ORACLES", "QUERIES"]
