"""Row numbers over whole tables, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.scratch import settle

#: Groups up to which their first places are sent to every task; more are joined.
FEW = 10_000
_LOCAL = (1 << 33) - 1  # monotonically_increasing_id: the partition stands above, the row's place in it below


def numbered(rows: DataFrame, order: list[str | Column], name: str = "position", parts: int | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with their place from 0, without gaps, in ascending ``order`` (nulls first): of all rows, or of those with equal columns ``within``.

    Rows are dealt out by ranges of (within, order) and of a running number, so that no range grows with a value that many
    rows share, and sorted within; each range's rows are counted, and a row's place is its place in its range plus the rows of the
    ranges before.  The counts (one row a range) are all that goes through the driver.  Places within a group are
    those less the group's first.  ``rows`` are read twice, to find the ranges and to deal them out, so settle what is dear.
    Rows that are equal in ``order`` stand in any order; an empty table stays empty.
    """
    spark = rows.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*within, *order]
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(n, *keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    done = settle(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).cast("int")
    sizes = {r["p"]: r["n"] for r in done.groupBy(part.alias("p")).count().withColumnRenamed("count", "n").collect()}  # a row a range
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    offsets = spark.createDataFrame(list(enumerate(before)), "_part int, _before long")
    placed = done.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(_LOCAL)).drop("_part", "_before", "_at")
    if not within:
        return placed
    first = settle(placed.groupBy(*within).agg(F.min(name).alias("_first")))
    if first.limit(FEW + 1).count() <= FEW:
        first = F.broadcast(first)
    same = [placed[c].eqNullSafe(first[c]) for c in within]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return placed.join(first, on).select(*(placed[c] for c in placed.columns if c != name), (F.col(name) - F.col("_first")).alias(name))
