"""Composed jobs: training, recommendation, refresh, and the query catalogue."""
