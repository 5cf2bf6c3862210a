"""Registered queries over the driver's tables, and the SQL that must give the same rows."""

from skarn.plans.catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
