"""An extension: change counts over a stream, by event-time windows.  (The batch operators are in ``operators.volatility``.)"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.columns import volatility_level


def windowed_changes(changes: DataFrame, window: str = "30 days", late: str = "7 days", low: int = 2, high: int = 10) -> DataFrame:
    """(window, file, changes, level) of a stream or table of (commit_ts, file, status); rows later than ``late`` are left out."""
    kept = changes.where(F.upper(F.substring("status", 1, 1)).isin("A", "M", "R", "C")).withWatermark("commit_ts", late)
    counts = kept.groupBy(F.window("commit_ts", window), "file").agg(F.count("*").alias("changes"))
    return counts.withColumn("level", volatility_level(F.col("changes"), low, high))
