"""Cutting the lineage of iterative queries with tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a new temporary folder only where it is unset and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="weftgraph-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``settle``, and numbers that are counted while the rows are written: ``n``, all rows, and those that ``counts`` name.

    Rounds that end by a number need no job of their own to find it.
    """
    seen = Observation()
    done = settle(df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(name) for name, c in counts.items())))
    return done, {k: v or 0 for k, v in seen.get.items()}


def discard(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing will read again."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


class Grown:
    """A table that rounds add to: each round writes its own rows only, and every ``fold`` rounds they are written as one."""

    def __init__(self, first: DataFrame, fold: int = 16):
        self.rows, self.fold, self.added = settle(first), fold, 0

    def add(self, rows: DataFrame) -> None:
        """``rows``: settled ones, in the same columns."""
        self.rows = self.rows.unionByName(rows)
        self.added += 1
        if self.added % self.fold == 0:
            self.rows = settle(self.rows)
