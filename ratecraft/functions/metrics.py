"""Error metrics as aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rmse_of(prediction: Column | str, actual: Column | str) -> Column:
    """sqrt(mean(squared error)); NULL over no rows (not an exception)."""
    p = F.col(prediction) if isinstance(prediction, str) else prediction
    a = F.col(actual) if isinstance(actual, str) else actual
    return F.sqrt(F.avg(F.pow(p.cast("double") - a.cast("double"), 2)))
