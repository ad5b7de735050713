"""All queries of the library's own operators."""

from panelnet.plans import catalog_cluster, catalog_network, catalog_panel
from panelnet.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "catalog_cluster", "catalog_network", "catalog_panel"]
