"""Registered queries: what each operator does on the campaign's tables."""

from florascan.plans import catalogue, growing, jobs, pixels, shapes
from florascan.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "catalogue", "growing", "jobs", "pixels", "shapes"]
