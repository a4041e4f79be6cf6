"""Queries over the driver tables, each with the operator ids it covers and (where SQL can say it) its oracle."""

from corpusloom.plans.registry import ORACLES, OPERATORS, QUERIES, load_all

__all__ = ["ORACLES", "OPERATORS", "QUERIES", "load_all"]
