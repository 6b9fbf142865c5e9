"""Every operator as a query over the test tables."""

from usageledger.catalog import (  # noqa: F401  (importing registers the queries)
    collectors,
    expressions,
    filters,
    reports,
    shapes,
    sinks,
    streams,
)
from usageledger.catalog.registry import ENTRIES

__all__ = ["ENTRIES"]
