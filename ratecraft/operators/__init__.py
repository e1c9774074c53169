"""DataFrame operators: aggregates, splits, set operations, scoring, top-N, evaluation."""

from . import aggregates, evaluate, scoring, sets, splits, topn

__all__ = ["aggregates", "evaluate", "scoring", "sets", "splits", "topn"]
