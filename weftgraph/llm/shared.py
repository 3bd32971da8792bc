"""Scratch tables in the folder that all executors share, and connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a new temporary one only where it is unset and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="weftgraph-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weftgraph-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have the cluster drop shuffle files that no table needs any more (those before a materialized one): they go when the driver's references do."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing will read again."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same nodes as those given: each node but the least of its component, with that least one."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    root = np.arange(len(ids))
    while (root[a] != root[b]).any():
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
    far = np.flatnonzero(root != np.arange(len(ids)))
    return ids[far], ids[root[far]]


def _contracted(edges: DataFrame, most: int = 1 << 19) -> DataFrame:
    """``edges`` (u, v) with those that a task reads together replaced by stars, ``most`` of them at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            far, near = stars(*(np.concatenate([np.asarray(x.column(c), np.int64) for x in held]) for c in ("u", "v")))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(far), pa.array(near)], ["u", "v"])

        for batch in batches:
            held.append(batch)
            if sum(len(x) for x in held) >= most:
                yield close()
        if held:
            yield close()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable id of each node that has an edge: ``(id long, component long)``.

    Edges that a task reads together are first replaced by stars.  Then large-star and small-star steps take
    turns (O(log n) rounds of joins on the edge list), each as a grouped minimum joined back, so that no
    neighbourhood is ever gathered into one row; they end when each node with a smaller
    neighbour has no other.  Self-loops and edges with a null end are ignored; repeated
    edges count once; an empty input gives an empty result.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    e = materialize(_contracted(e).distinct(), "edges")
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "low")  # so that the join can deal out a hot node
        if low.where("m < u and n > 1").isEmpty():
            break
        large = both.where("v > u").join(low.select("u", F.least("m", "u").alias("m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        before, e = e, materialize(_contracted(small.where("u <> v")).distinct(), "edges")
        discard(before)
        discard(low)
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
