"""Checking a graph: by rules, or for cycles where there are no rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.cycles import minimal_cycles, strong_components, with_cycle_ids
from weftgraph.operators.edges import cycle_subgraph, edge_weights
from weftgraph.operators.feedback import cluster_report, feedback_edges, ranked_edges, removal_bias
from weftgraph.operators.rules import violations
from weftgraph.plans.sinks import clusters_text, violations_text
from weftgraph.schema import MODULE_DEP, PropertyGraph
from weftgraph.scratch import settle
from weftgraph.sources.rules_file import RulesError, RulesNotFound, load_rules


def check(graph: PropertyGraph, rules_path: str | None, explicit: bool = False, include_reexports: bool = False) -> tuple[str, int]:
    """(report, exit code): 0 nothing found, 1 violations or cycles, 2 the rules can't be read.

    Without a rules file, unless one was asked for, all cycles are reported.
    """
    try:
        rules = load_rules(rules_path) if rules_path else None
    except RulesNotFound as e:
        if explicit:
            return f"error: {e}\n", 2
        rules = None
    except RulesError as e:
        return f"error: {e}\n", 2
    if rules is None:
        text = cycles_text(graph, include_reexports)
        return text, 1 if text else 0
    found = violations(graph, rules, include_reexports).cache()
    return violations_text(found), 0 if found.isEmpty() else 1


def tangles(graph: PropertyGraph, include_reexports: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cycles, cluster report, ranked edges) of a graph's production logic; all empty where nothing is cyclic."""
    logic = cycle_subgraph(graph.edges, include_reexports).cache()
    components = settle(strong_components(logic))
    weights = edge_weights(graph.edges.where(F.col("edge_type") == MODULE_DEP))
    cycles = settle(minimal_cycles(logic, components))
    found = feedback_edges(logic, components, weights, graph.nodes.select("node_id", "qualified_name"), removal_bias(graph.edges, graph.nodes), cycles).cache()
    return with_cycle_ids(cycles), cluster_report(found, cycles, components, graph.nodes), ranked_edges(found, graph.nodes)


def cycles_text(graph: PropertyGraph, include_reexports: bool = False) -> str:
    _, clusters, edges = tangles(graph, include_reexports)
    return clusters_text(clusters, edges, graph.nodes)
