"""All checked queries."""

from linkguard.plans import catalog_urls, catalog_scan, catalog_reports, catalog_intel, catalog_streams, catalog_ml  # noqa: F401
from linkguard.plans.registry import ORACLES, QUERIES  # noqa: F401
