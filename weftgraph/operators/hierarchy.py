"""The containment hierarchy: paths, closure, selectors, and roll-up to visible nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.columns import stroke_width
from weftgraph.scratch import Grown, settle


def with_paths(nodes: DataFrame) -> DataFrame:
    """``nodes`` (node_id, parent_id, name, ...) with path, ancestors (root first), depth and qualified_name, level by level until there is none.

    Nodes on a parent cycle, and below one, get null paths.
    """
    plain = nodes.drop("path", "ancestors", "depth", "qualified_name")
    done = Grown(plain.where("parent_id is null").select("node_id", F.array("name").alias("path"), F.array().cast("array<long>").alias("ancestors")))
    links = plain.where("parent_id is not null").select("node_id", "parent_id", "name")
    level = done.rows
    while True:
        up = level.select(F.col("node_id").alias("parent_id"), F.col("path").alias("up_path"), F.col("ancestors").alias("up_ancestors"))
        level = settle(links.join(up, "parent_id").select("node_id", F.concat("up_path", F.array("name")).alias("path"), F.concat("up_ancestors", F.array("parent_id")).alias("ancestors")))
        if level.isEmpty():
            break
        done.add(level)
    return plain.join(done.rows, "node_id", "left").withColumns({"depth": F.size("ancestors"), "qualified_name": F.array_join("path", "::")})


def closure(nodes: DataFrame) -> DataFrame:
    """(ancestor, node_id) of all pairs, each node with itself."""
    return nodes.select("node_id", F.explode(F.concat("ancestors", F.array("node_id"))).alias("ancestor"))


def descendant_counts(nodes: DataFrame) -> DataFrame:
    """(node_id, children, descendants)."""
    pairs = closure(nodes).where("ancestor <> node_id")
    direct = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("children"))
    all_ = pairs.groupBy(F.col("ancestor").alias("node_id")).agg(F.count("*").alias("descendants"))
    return nodes.select("node_id").join(direct, "node_id", "left").join(all_, "node_id", "left").na.fill(0)


def select_nodes(nodes: DataFrame, pattern: str) -> DataFrame:
    """node_id of the nodes that a selector names.

    ``**``: all; ``X::**``: below X; ``X::*``: children of X; ``X``: the node, and all below it if it is
    a crate.  External nodes never match; a leading ``crate::`` is dropped; of nodes with one name the one with the largest id counts.
    """
    inner = nodes.where("kind <> 'external'")
    pattern = pattern.removeprefix("crate::")
    if pattern == "**":
        return inner.select("node_id")
    below, children = pattern.endswith("::**"), pattern.endswith("::*")
    base = pattern.removesuffix("::**") if below else pattern.removesuffix("::*")
    named = inner.where(F.col("qualified_name") == base).groupBy("qualified_name").agg(F.max_by(F.struct("node_id", "kind"), "node_id").alias("b")).select("b.node_id", F.col("b.kind").alias("base_kind"))
    one = F.broadcast(named.withColumnRenamed("node_id", "base"))  # one row at most
    inside = F.array_contains("ancestors", F.col("base"))
    if children:
        hit = F.col("parent_id") == F.col("base")
    elif below:
        hit = inside
    else:
        hit = (F.col("node_id") == F.col("base")) | ((F.col("base_kind") == "crate") & inside)
    return inner.join(one, hit).select("node_id")


def visible_ancestor(ancestors: Column, node_id: Column, collapsed: Column) -> Column:
    """The top-most collapsed ancestor, else the node itself; ``collapsed``: a predicate of an id."""
    return F.coalesce(F.get(F.filter(ancestors, lambda a: F.array_contains(collapsed, a)), F.lit(0)), node_id)


def visible_by_flag(nodes: DataFrame) -> DataFrame:
    """(node_id, visible): the same by the column ``collapsed`` of ``nodes``, by join, however many are collapsed."""
    shut = nodes.where("collapsed").select(F.col("node_id").alias("ancestor"), F.col("depth").alias("at"))
    top = closure(nodes).where("ancestor <> node_id").join(shut, "ancestor").groupBy("node_id").agg(F.min_by("ancestor", "at").alias("visible"))
    return nodes.select("node_id").join(top, "node_id", "left").withColumn("visible", F.coalesce("visible", "node_id"))


def roll_up(edges: DataFrame, visible: DataFrame) -> DataFrame:
    """Arcs between visible nodes for the edges with a hidden end: count, usages, the direction all agree on (else downward), stroke.

    ``edges``: src, dst, usages, direction.  Edges that fall into one node go.
    """
    ends = edges.join(visible.toDF("src", "vsrc"), "src").join(visible.toDF("dst", "vdst"), "dst")
    hidden = ends.where("(src <> vsrc or dst <> vdst) and vsrc <> vdst")
    both = hidden.groupBy(F.col("vsrc").alias("src"), F.col("vdst").alias("dst"))
    out = both.agg(F.count("*").alias("arcs"), F.sum("usages").alias("usages"), F.min("direction").alias("low"), F.max("direction").alias("high"))
    vote = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("downward")
    return out.select("src", "dst", "arcs", "usages", vote.alias("direction"), stroke_width(F.col("usages")).alias("stroke"))


def expand_level(nodes: DataFrame, level: int) -> DataFrame:
    """``nodes`` with visible (nesting up to ``level``) and collapsed (parents from there on)."""
    parents = nodes.where("parent_id is not null").select(F.col("parent_id").alias("node_id"), F.lit(True).alias("is_parent")).distinct()
    return nodes.join(parents, "node_id", "left").withColumns({"visible": F.col("depth") <= level, "collapsed": F.coalesce(F.col("is_parent") & (F.col("depth") >= level), F.lit(False))}).drop("is_parent")
