"""Every operator as a query over the given tables, next to its SQL where it has one."""

from faultgrain.queries import completion, contracts, corpus, ledger, lifecycle, streams, triage  # noqa: F401
from faultgrain.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
