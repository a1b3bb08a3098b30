"""Registered queries over the driver's tables, each with an SQL twin where one can be written."""

from evalgrain.plans import discovery_queries, guide_queries, log_queries, part_queries, run_queries, text_queries
from evalgrain.plans.registry import QUERIES, SQL
from evalgrain.plans.run_queries import flagship

__all__ = ["QUERIES", "SQL", "discovery_queries", "flagship", "guide_queries", "log_queries", "part_queries", "run_queries", "text_queries"]
