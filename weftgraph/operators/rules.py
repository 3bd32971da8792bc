"""Architecture rules: selectors to node sets, edges to violations."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.columns import is_production_crate_dep, is_production_module_dep
from weftgraph.operators.cycles import minimal_cycles
from weftgraph.operators.edges import cycle_subgraph
from weftgraph.operators.hierarchy import select_nodes
from weftgraph.schema import MODULE_DEP, PropertyGraph

VIOLATIONS = "ord int, rule_type string, rule_name string, severity string, message string, locations array<struct<file:string,line:int>>"


@dataclass(frozen=True)
class Rule:
    type: str  # forbidden-dependency, no-cycles or layers
    name: str
    severity: str = "error"
    source: str = ""
    target: str = ""
    scope: str = "**"
    layers: tuple[str, ...] = field(default_factory=tuple)
    direction: str = "top-down"


def production_edges(edges: DataFrame) -> DataFrame:
    return edges.where(is_production_module_dep() | is_production_crate_dep())


def _between(graph: PropertyGraph, edges: DataFrame, rule: Rule, ord_: int) -> DataFrame:
    """One violation for each edge, with its locations if it is a module dependency."""
    names = graph.nodes.select("node_id", "qualified_name")
    named = edges.join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst")
    places = F.when(F.col("edge_type") == MODULE_DEP, F.transform("locations", lambda x: F.struct(x["file"].alias("file"), x["line"].alias("line"))))
    return named.select(F.lit(ord_).alias("ord"), F.lit(rule.type).alias("rule_type"), F.lit(rule.name).alias("rule_name"), F.lit(rule.severity).alias("severity"), F.concat("a", F.lit(" → "), "b").alias("message"), F.coalesce(places, F.array().cast("array<struct<file:string,line:int>>")).alias("locations"))


def forbidden(graph: PropertyGraph, rule: Rule, ord_: int = 0) -> DataFrame:
    """Production edges from one set of nodes to another."""
    a, b = select_nodes(graph.nodes, rule.source), select_nodes(graph.nodes, rule.target)
    hits = production_edges(graph.edges).join(a.withColumnRenamed("node_id", "src"), "src", "left_semi").join(b.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return _between(graph, hits, rule, ord_)


def layer_of(graph: PropertyGraph, layers: tuple[str, ...]) -> DataFrame:
    """(node_id, layer): of the layers that a node matches, the one listed last."""
    parts = [select_nodes(graph.nodes, f"{p}").withColumn("layer", F.lit(i)) for i, p in enumerate(layers)]
    return reduce(DataFrame.union, parts).groupBy("node_id").agg(F.max("layer").alias("layer"))


def layered(graph: PropertyGraph, rule: Rule, ord_: int = 0) -> DataFrame:
    """Production edges against the layers' direction; skipping layers and staying in one is allowed."""
    of = layer_of(graph, rule.layers)
    both = production_edges(graph.edges).join(of.toDF("src", "from"), "src").join(of.toDF("dst", "to"), "dst")
    wrong = F.col("from") > F.col("to") if rule.direction == "top-down" else F.col("from") < F.col("to")
    return _between(graph, both.where(wrong), rule, ord_)


def no_cycles(graph: PropertyGraph, rule: Rule, ord_: int = 0, include_reexports: bool = False) -> DataFrame:
    """Each minimal cycle among the production module dependencies inside the scope."""
    scope = select_nodes(graph.nodes, rule.scope)
    inner = cycle_subgraph(graph.edges, include_reexports).join(scope.withColumnRenamed("node_id", "src"), "src", "left_semi").join(scope.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    rows = minimal_cycles(inner).select("path", F.posexplode(F.concat("path", F.slice("path", 1, 1))).alias("i", "node_id"))
    named = rows.join(graph.nodes.select("node_id", "qualified_name"), "node_id").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("i", "qualified_name"))).alias("x"))
    message = F.array_join(F.transform("x", lambda s: s["qualified_name"]), " → ")
    return named.select(F.lit(ord_).alias("ord"), F.lit(rule.type).alias("rule_type"), F.lit(rule.name).alias("rule_name"), F.lit(rule.severity).alias("severity"), message.alias("message"), F.array().cast("array<struct<file:string,line:int>>").alias("locations"))


def violations(graph: PropertyGraph, rules: list[Rule], include_reexports: bool = False) -> DataFrame:
    """What all rules but the ignored ones find; ``ord`` is the rule's place in the file."""
    made = {"forbidden-dependency": forbidden, "layers": layered, "no-cycles": lambda g, r, i: no_cycles(g, r, i, include_reexports)}
    parts = [made[r.type](graph, r, i) for i, r in enumerate(rules) if r.severity != "ignore"]
    spark = graph.nodes.sparkSession
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], VIOLATIONS)


def summary(found: DataFrame) -> DataFrame:
    return found.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"))
