"""From graph to diagram: order, places, arcs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import columns as C
from weftgraph.operators.cycles import cycle_arcs, minimal_cycles, strong_components
from weftgraph.operators.edges import crate_weights, cycle_subgraph, edge_weights, sibling_weights, suppress_implied_crate_deps
from weftgraph.operators.numbering import numbered
from weftgraph.operators.order import order_siblings, tree_order
from weftgraph.operators.reach import production_reachable
from weftgraph.schema import CONTAINS, CRATE_DEP, DEV_DEP, MODULE_DEP, PropertyGraph
from weftgraph.scratch import settle


def place(items: DataFrame) -> DataFrame:
    """``items`` (position from 0, nesting, ...) with x, y and height."""
    return items.withColumns({"x": F.lit(C.MARGIN) + C.INDENT * F.col("nesting"), "y": F.lit(C.MARGIN + C.TOOLBAR) + C.ROW_HEIGHT * F.col("position"), "height": F.when(F.col("nesting") == 0, 24).otherwise(20)})


def layout_items(graph: PropertyGraph) -> DataFrame:
    """The crates that production reaches, each before its modules, in dependency order; then modules of the other crates."""
    nodes = graph.nodes.where("kind <> 'external'")
    weights = crate_weights(graph.edges, graph.nodes).union(sibling_weights(graph.edges, nodes).where("parent is not null").select("src", "dst", "weight"))
    order = tree_order(nodes, order_siblings(nodes, weights.groupBy("src", "dst").agg(F.max("weight").alias("weight"))))
    kept = production_reachable(graph.edges, graph.nodes).withColumn("reached", F.lit(True))
    owner = F.coalesce("crate_id", "node_id")
    rows = nodes.withColumn("owner", owner).join(kept.withColumnRenamed("node_id", "owner"), "owner", "left").where("reached or kind <> 'crate'").join(order, "node_id")
    rows = settle(rows.select("node_id", "kind", "name", "qualified_name", F.col("depth").alias("nesting"), F.col("reached").isNull().alias("unreached"), "rank_path"))
    return place(numbered(rows, ["unreached", "rank_path"]).drop("unreached", "rank_path"))


def layout_edges(graph: PropertyGraph, items: DataFrame, include_reexports: bool = False) -> DataFrame:
    """Arcs between items: direction, cycle ids and kind, symbols, z-order, stroke and path."""
    deps = suppress_implied_crate_deps(graph.edges.where(~F.col("edge_type").isin(CONTAINS, DEV_DEP)), graph.nodes)
    at = items.select("node_id", "position", "x", "y")
    arcs = deps.join(at.toDF("src", "from", "x1", "y1"), "src").join(at.toDF("dst", "to", "x2", "y2"), "dst")
    logic = cycle_subgraph(graph.edges, include_reexports)
    components = strong_components(logic)
    ids = cycle_arcs(minimal_cycles(logic, components)).groupBy("src", "dst").agg(F.sort_array(F.collect_set("cycle_id")).alias("cycle_ids"))
    back = graph.edges.where(F.col("edge_type") == MODULE_DEP).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("back")).distinct()
    arcs = arcs.join(ids, ["src", "dst"], "left").join(back, ["src", "dst"], "left").join(edge_weights(graph.edges), ["src", "dst"], "left")
    cyclic, down = F.col("cycle_ids").isNotNull(), F.col("from") < F.col("to")
    uses = F.when(F.col("edge_type") == CRATE_DEP, 1).otherwise(F.size("locations"))
    return arcs.select(
        "src", "dst", "edge_type", "ctx_kind", F.when(down, "downward").otherwise("upward").alias("direction"), "cycle_ids",
        F.when(cyclic & F.col("back"), "direct").when(cyclic, "transitive").alias("cycle_kind"), F.coalesce("refs", F.lit(0)).alias("refs"), uses.alias("usages"),
        C.z_order(F.col("ctx_kind"), cyclic, down).alias("z"), C.stroke_width(uses).alias("stroke"), C.arc_path(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("path"), "locations",
    )


def canvas(items: DataFrame) -> DataFrame:
    """One row: the widest label's box, and the size of the drawing without arcs."""
    return items.agg(F.max(C.text_width(F.col("name"))).alias("label"), F.max(F.col("x") + C.text_width(F.col("name"))).alias("width"), F.max(F.col("y") + F.col("height")).alias("height"))
