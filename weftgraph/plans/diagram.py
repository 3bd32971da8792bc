"""The diagram of a graph, the volatility report, and the state that a reader of a diagram changes."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import hierarchy, importers, layout, volatility
from weftgraph.operators.views import visible_arcs
from weftgraph.plans import sinks
from weftgraph.plans.check import tangles
from weftgraph.schema import PropertyGraph


def diagram(graph: PropertyGraph, form: str = "svg", expand_level: int | None = None, include_reexports: bool = False, changes: DataFrame | None = None, root: str = "", config: volatility.VolatilityConfig = volatility.VolatilityConfig()) -> str:
    """SVG or JSON of a graph, with its cycles, its tangles and how far its symbols' uses reach; with ``expand_level`` only nodes nested up to it.

    ``changes`` (file, changes) add levels by the files of the graph's nodes, as seen from the folder ``root``.
    """
    items = layout.layout_items(graph).cache()
    edges = layout.layout_edges(graph, items, include_reexports)
    if expand_level is not None:
        items = items.where(F.col("nesting") <= expand_level)
        shown = items.select("node_id")
        edges = edges.join(shown.toDF("src"), "src", "left_semi").join(shown.toDF("dst"), "dst", "left_semi")
    if changes is not None:
        inside = root.rstrip("/") + "/" if root else ""
        file = F.when(F.col("file").startswith(inside), F.substring("file", len(inside) + 1, 1 << 20)).otherwise(F.col("file"))
        items = volatility.enrich(items.join(graph.nodes.select("node_id", file.alias("file")), "node_id", "left"), changes, config).drop("file")
    cycles, clusters, ranked = tangles(graph, include_reexports)
    scopes = importers.consumer_scopes(importers.symbol_clusters(importers.importer_partition(importers.symbol_uses(graph.edges))), graph.nodes)
    sink = sinks.diagram_svg if form == "svg" else sinks.diagram_json
    return sink(items, edges, cycles, clusters, ranked, scopes)


def volatility_report(changes: DataFrame, config: volatility.VolatilityConfig = volatility.VolatilityConfig(), now: F.Column | None = None) -> str:
    return sinks.volatility_text(volatility.report(volatility.change_counts(changes, config, now), config), config.months)


@dataclass(frozen=True)
class ViewState:
    """What a reader has collapsed, selected and hidden.  Changes give new states.

    One thing is pinned at a time, a node (``selected``) or an arc (``arc``); ``hovered`` is the arc under the pointer.  ``cluster`` is the component that is
    looked at, around the arc that is pinned inside it.
    """

    collapsed: frozenset[int] = frozenset()
    selected: int | None = None
    layers: frozenset[str] = frozenset({"crate", "module", "reexport", "cycle"})
    cluster: int | None = None
    arc: str | None = None
    hovered: str | None = None

    def toggle(self, node: int) -> ViewState:
        return replace(self, collapsed=self.collapsed ^ {node})

    def select(self, node: int) -> ViewState:
        """Selecting the selected node clears the selection."""
        return replace(self, selected=None if self.selected == node else node, arc=None)

    def pin(self, arc: str) -> ViewState:
        """Pinning the pinned arc lets it go."""
        return replace(self, arc=None if self.arc == arc else arc, selected=None)

    def hover(self, arc: str | None) -> ViewState:
        return replace(self, hovered=arc)

    def layer(self, name: str) -> ViewState:
        return replace(self, layers=self.layers ^ {name})

    def click_arc(self, arc: str, scc: int | None = None) -> ViewState:
        """A click on an arc, in a component (``scc``) or in none.

        The first click on a component's arc selects the component; further ones pin arcs inside it.  A click into another component
        goes there and drops the pin; one on an arc outside all components leaves the component and pins that arc.
        """
        if scc is None:
            return replace(self, cluster=None).pin(arc)
        if self.cluster is None:
            return replace(self, cluster=scc, hovered=None)
        if self.cluster != scc:
            return replace(self, cluster=scc, selected=None, arc=None, hovered=None)
        done = self.pin(arc)
        return done if done.arc else done.hover(None)

    def click_row(self, arc: str, scc: int | None, expandable: bool, expanded: bool) -> tuple[ViewState, bool]:
        """A click on an arc's row in the list of a component: the new state, and whether the row is open then.

        Row and pin go together, but a row that was closed while its arc stayed pinned only opens again.
        """
        if expandable and not expanded and self.arc == arc:
            return self, True
        done = self.click_arc(arc, scc)
        return done, done.arc == arc

    def click_empty(self) -> ViewState:
        return replace(self, cluster=None, selected=None, arc=None, hovered=None)


def view(graph: PropertyGraph, arcs: DataFrame, state: ViewState) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(visible nodes, visible arcs, arcs rolled up for what is collapsed) in a state.

    ``arcs``: src, dst, edge_type, reexport, cyclic, usages, direction.
    """
    nodes = graph.nodes.withColumn("collapsed", F.col("node_id").isin(*state.collapsed) if state.collapsed else F.lit(False))
    visible = hierarchy.visible_by_flag(nodes)
    shown = visible_arcs(arcs, visible, set(state.layers))
    rolled = hierarchy.roll_up(arcs, visible) if "module" in state.layers else hierarchy.roll_up(arcs.limit(0), visible)
    return visible.where("node_id = visible").select("node_id"), shown, rolled
