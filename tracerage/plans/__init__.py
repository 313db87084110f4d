"""Registered queries with their SQL counterparts."""

from . import q_chronicle, q_clean, q_diagnostics, q_forward, q_posterior, q_sources, q_summaries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "q_chronicle", "q_clean", "q_diagnostics", "q_forward", "q_posterior", "q_sources", "q_summaries"]
