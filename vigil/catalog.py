"""Import every catalog module so that the registry is complete."""
from __future__ import annotations

from .plans import (catalog_dashboard, catalog_logs, catalog_payments,  # noqa: F401
                    catalog_ingest, catalog_models, catalog_series, catalog_streaming,
                    catalog_traces)
from .plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
