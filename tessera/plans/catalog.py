"""Registered queries of the engine and the SQL that checks them."""

from tessera.plans import document_plans, evaluation_plans, relational_plans, retrieval_plans  # noqa: F401
from tessera.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
