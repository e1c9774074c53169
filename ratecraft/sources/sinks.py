"""Report sinks: ranked or scored recommendations as files, written by the
executors, each report a version of its own (:mod:`.versions`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .versions import current, publish

REPORT_COLUMNS = ["user_id", "rank", "item_id", "title", "score", "n_ratings"]


def write_report(recs: DataFrame, path: str, fmt: str = "parquet",
                 partition_cols: list[str] | None = None) -> str:
    """Write the ``REPORT_COLUMNS`` that ``recs`` has as the current version of
    ``path``; returns that version's folder."""
    rows = recs.select(*[c for c in REPORT_COLUMNS if c in recs.columns])

    def write(folder: str) -> None:
        w = rows.write
        if partition_cols:
            w = w.partitionBy(*partition_cols)
        w.format(fmt).save(folder)

    return publish(recs.sparkSession, path, write)


def read_report(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The current version of a report."""
    return spark.read.format(fmt).load(current(spark, path))


def peek(df: DataFrame, n: int = 2) -> list:
    """The first ``n`` rows for a look (``limit`` then collect: ``n`` rows reach
    the driver, never the table)."""
    return df.limit(n).collect()
