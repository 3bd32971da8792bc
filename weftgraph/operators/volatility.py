"""How often files change."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.columns import volatility_level


@dataclass(frozen=True)
class VolatilityConfig:
    months: int = 6
    low: int = 2
    high: int = 10


def change_counts(changes: DataFrame, config: VolatilityConfig = VolatilityConfig(), now: F.Column | None = None) -> DataFrame:
    """(file, changes) of the added, modified, renamed and copied files of the last months."""
    recent = changes.where(F.upper(F.substring("status", 1, 1)).isin("A", "M", "R", "C"))
    since = F.add_months(F.current_date() if now is None else now, -config.months)
    return recent.where(F.col("commit_ts") >= since).groupBy("file").agg(F.count("*").alias("changes"))


def scores(counts: DataFrame) -> DataFrame:
    """``counts`` with score, the share of the largest count; nothing when that is 0."""
    most = counts.agg(F.max("changes").alias("most"))  # one row
    return counts.crossJoin(F.broadcast(most)).where("most > 0").withColumn("score", F.col("changes") / F.col("most")).drop("most")


def statistics(counts: DataFrame, config: VolatilityConfig = VolatilityConfig()) -> DataFrame:
    """One row: files, total, max, min, avg, low, medium, high; zeros when there are no files."""
    level = volatility_level(F.col("changes"), config.low, config.high)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return counts.agg(
        F.count("*").alias("files"), zero(F.sum("changes")).alias("total"), zero(F.max("changes")).alias("max"), zero(F.min("changes")).alias("min"),
        F.coalesce(F.avg("changes"), F.lit(0.0)).alias("avg"), *[F.count_if(level == x).alias(x.lower()) for x in ("LOW", "MEDIUM", "HIGH")],
    )


def enrich(items: DataFrame, counts: DataFrame, config: VolatilityConfig = VolatilityConfig()) -> DataFrame:
    """``items`` (file, ...) with their changes and level; files that didn't change have 0 and LOW."""
    joined = items.join(counts, "file", "left").na.fill(0, ["changes"])
    return joined.withColumn("level", volatility_level(F.col("changes"), config.low, config.high))


def report(counts: DataFrame, config: VolatilityConfig = VolatilityConfig()) -> DataFrame:
    """(file, changes, score, level) by changes descending, then file."""
    return scores(counts).withColumn("level", volatility_level(F.col("changes"), config.low, config.high)).orderBy(F.desc("changes"), "file")
