"""Registered queries: each pairs a Spark plan with the SQL that checks it."""

from plumbline.plans.registry import QUERIES, SQL, load_all

__all__ = ["QUERIES", "SQL", "load_all"]
