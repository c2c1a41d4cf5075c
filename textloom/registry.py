"""All queries of the engine."""

from textloom.plans import answers, corpus, evaluation, gateway, logs, retrieval, state, vectors, words  # noqa: F401
from textloom.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
