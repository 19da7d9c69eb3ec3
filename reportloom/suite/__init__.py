"""The registered queries. Importing this package fills ``QUERIES`` and ``ORACLES``."""

from reportloom.suite.registry import ORACLES, QUERIES
from reportloom.suite import chat, content, costs, files, jobs, names, observations, reports, retrieval  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
