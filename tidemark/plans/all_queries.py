"""All registered queries of the library proper."""

from tidemark.plans import analysis_queries, change_queries, evidence_queries, function_queries, history_queries, more_queries, policy_queries, state_queries  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
