"""Importing this module registers all queries."""

from fleetsig.plans import (  # noqa: F401
    catalogue_analytics,
    catalogue_operations,
    catalogue_panels,
    catalogue_refresh,
    catalogue_storage,
)
