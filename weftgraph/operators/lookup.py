"""Name lookups: cascades of equality joins, and the longest known prefix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cascade(rows: DataFrame, key: str, steps: list[tuple[Column, DataFrame, str]]) -> DataFrame:
    """``rows`` with node_id of the first step that knows the name.

    A step: how the name is changed before, a table (name, its column of ids), the id column.  Names are looked up
    by left joins; the tables are small dimensions, which Spark broadcasts by their size.
    """
    found: list[Column] = []
    out = rows
    for i, (changed, table, id_column) in enumerate(steps):
        one = table.groupBy("name").agg(F.min(id_column).alias(f"__id{i}")).withColumnRenamed("name", f"__name{i}")
        out = out.join(one, changed == F.col(f"__name{i}"), "left").drop(f"__name{i}")
        found.append(F.col(f"__id{i}"))
    return out.withColumn("node_id", F.coalesce(*found)).drop(*[f"__id{i}" for i in range(len(steps))])


def longest_prefix(rows: DataFrame, key: str, parts: str, known: DataFrame, sep: str = "::") -> DataFrame:
    """``rows`` with prefix (the longest run of first parts that ``known`` has as ``prefix``) and n (its parts); else the first part, 1."""
    each = rows.select(key, F.explode(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1)))).alias("n"), parts).select(key, "n", F.array_join(F.slice(parts, F.lit(1), F.col("n")), sep).alias("prefix"))
    best = each.join(known.select("prefix").distinct(), "prefix", "left_semi").groupBy(key).agg(F.max_by("prefix", "n").alias("prefix"), F.max("n").alias("n"))
    return rows.join(best, key, "left").withColumns({"prefix": F.coalesce("prefix", F.get(parts, F.lit(0))), "n": F.coalesce("n", F.lit(1))})


def first_tier(tiers: list[DataFrame], keys: list[str]) -> DataFrame:
    """Of the answers of several tiers (same columns) the first tier's for each key."""
    numbered = [t.withColumn("tier", F.lit(i)) for i, t in enumerate(tiers)]
    all_ = reduce(DataFrame.unionByName, numbered)
    rest = [c for c in all_.columns if c not in keys]
    return all_.groupBy(*keys).agg(F.min_by(F.struct(*rest), "tier").alias("x")).select(*keys, "x.*")
