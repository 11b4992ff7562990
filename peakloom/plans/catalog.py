"""All registered queries; importing this module fills the registry."""

from peakloom.plans import (  # noqa: F401
    cluster_queries,
    hsqc_queries,
    library_queries,
    series_queries,
    spectrum_queries,
    structure_queries,
    text_queries,
    threshold_queries,
)
from peakloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
