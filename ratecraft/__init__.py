"""ratecraft: collaborative-filtering analytics on Spark DataFrames.

Parse ``::``-delimited rating and item text, aggregate, split reproducibly,
train and select ALS models, score and rank recommendations, and refresh
them when new ratings arrive. Every operator takes and returns DataFrames so
Catalyst plans the whole job; only single-row results reach the driver.
"""

__all__ = ["session", "sources", "functions", "operators", "plans", "streaming"]
