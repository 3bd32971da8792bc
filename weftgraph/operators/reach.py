"""Reachability: breadth-first closures as joins of a frontier with the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.columns import is_production_crate_dep, is_test_crate_dep
from weftgraph.schema import CONTAINS, CRATE_DEP, DEV_DEP
from weftgraph.scratch import Grown, settle


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node_id): the seeds (node_id) and all that edges (src, dst) lead to from them.

    Each round joins only the nodes found last; what was found before leaves by anti join.  Lineage is
    cut every round by a table in the shared folder.
    """
    edges = edges.select("src", "dst").distinct().cache()
    seen = Grown(seeds.select("node_id").where("node_id is not null").distinct())
    frontier = seen.rows
    while True:
        step = edges.join(frontier.withColumnRenamed("node_id", "src"), "src").select(F.col("dst").alias("node_id")).distinct()
        frontier = settle(step.join(seen.rows, "node_id", "left_anti"))
        if frontier.isEmpty():
            break
        seen.add(frontier)
    edges.unpersist()
    return seen.rows


def entry_points(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id): crates nothing depends on that depend on a crate in production."""
    crates = nodes.where("kind = 'crate'").select("node_id")
    incoming = edges.where(F.col("edge_type").isin(CRATE_DEP, DEV_DEP)).select(F.col("dst").alias("node_id")).distinct()
    to_crate = edges.where(is_production_crate_dep()).join(crates.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    outgoing = to_crate.select(F.col("src").alias("node_id")).distinct()
    return crates.join(incoming, "node_id", "left_anti").join(outgoing, "node_id", "left_semi")


def production_reachable(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id): crates that production code reaches.

    All, if tests are part of the graph or no crate contains anything; else what crates with content and
    entry points lead to over production dependencies between crates.
    """
    crates = nodes.where("kind = 'crate'").select("node_id")
    if not edges.where(is_test_crate_dep()).isEmpty():
        return crates
    owners = edges.where(F.col("edge_type") == CONTAINS).select(F.col("src").alias("node_id")).distinct().join(crates, "node_id", "left_semi")
    if owners.isEmpty():
        return crates
    links = edges.where(is_production_crate_dep()).join(crates.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return reachable(links, owners.union(entry_points(edges, nodes)))


def feature_seeds(members: DataFrame, features: list[str], all_features: bool = False) -> DataFrame:
    """(node_id): members (node_id, name, features) that define a wanted feature, ``feature`` or ``crate/feature``; all, if nothing is asked."""
    if not features or all_features:
        return members.select("node_id")
    spark = members.sparkSession
    asked = [(f.split("/", 1)[0], f.split("/", 1)[1]) if "/" in f else (None, f) for f in features]
    want = spark.createDataFrame(asked, "crate string, feature string")
    has = members.select("node_id", "name", F.explode("features").alias("feature"))
    return has.join(F.broadcast(want), "feature").where("crate is null or crate = name").select("node_id").distinct()


def feature_reachable(members: DataFrame, deps: DataFrame, features: list[str], all_features: bool = False) -> DataFrame:
    """(node_id): the members that the wanted features need."""
    seeds = feature_seeds(members, features, all_features)
    return seeds if not features or all_features else reachable(deps, seeds)
