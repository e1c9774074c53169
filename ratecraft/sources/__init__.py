"""Sources and sinks: typed rating/item tables from text, fixtures, models, reports."""

from .text import (RATING_SCHEMA, ITEM_SCHEMA, read_lines, parse_ratings, parse_items,
                   parse_posted, load_positive_ratings)
from . import fixtures, models, sinks

__all__ = ["RATING_SCHEMA", "ITEM_SCHEMA", "read_lines", "parse_ratings", "parse_items",
           "parse_posted", "load_positive_ratings", "fixtures", "models", "sinks"]
