"""All queries of the library, apart from those of removable subpackages."""

from pathloom.plans import export_queries, graph_queries, lifecycle_queries, link_queries, merge_queries, model_queries, name_queries, patch_queries, rewrite_queries, text_queries  # noqa: F401
from pathloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
