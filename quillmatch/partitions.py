"""Tasks of a bounded size: as many partitions as the rows need, whatever the session's setting or what their bytes shrink to."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: About as many rows as a task gets.
ROWS = 1 << 18


def by_key(df: DataFrame, *cols: str, rows: int | None = None) -> DataFrame:
    """df with rows of equal cols in one partition, of about ``ROWS`` rows each. What then groups by cols, or by more, needs
    no shuffle, and no table of groups where the rows come from. ``rows``: how many there are, if that is known."""
    n = df.count() if rows is None else rows
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS)), *cols)
