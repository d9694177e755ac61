"""All registered queries; importing the families fills the catalogue."""

from curveboard.plans import (  # noqa: F401
    board_queries,
    curve_queries,
    run_queries,
    sample_queries,
    similarity_queries,
)
from curveboard.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
