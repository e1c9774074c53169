"""Structured Streaming jobs: ingest of posted ratings, running item statistics."""

from .ingest import ingest_posted, posted_stream, read_posted_table
from .running import item_stats_snapshot, running_item_stats

__all__ = ["ingest_posted", "item_stats_snapshot", "posted_stream", "read_posted_table", "running_item_stats"]
