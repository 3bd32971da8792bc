"""Tables of the property graph.

One graph holds the containment hierarchy and the dependencies: ``nodes``, one row each, and ``edges``,
told apart by ``edge_type``.  ``refs`` are single references, before they are summed up to edges; ``ord`` is their
order of arrival, which "the first one wins" rules go by.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

LOCATION = "struct<file:string,line:int,symbols:array<string>,module_path:string,via_reexport:boolean>"
NODES = (
    "node_id long, kind string, name string, crate_id long, parent_id long, path array<string>, ancestors array<long>, "
    "depth int, qualified_name string, version string, package_id string, is_direct boolean"
)
EDGES = f"src long, dst long, edge_type string, ctx_kind string, ctx_sub_kind string, features array<string>, locations array<{LOCATION}>"
REFS = (
    "src_path string, target_crate string, target_module string, target_item string, source_file string, line int, "
    "ctx_kind string, ctx_sub_kind string, features array<string>, via_reexport boolean, ord long"
)
CONTAINS, CRATE_DEP, MODULE_DEP, DEV_DEP = "contains", "crate_dep", "module_dep", "dev_dep"
PRODUCTION, TEST, BUILD = "production", "test", "build"


@dataclass(frozen=True)
class PropertyGraph:
    """Lazy tables of one graph."""

    nodes: DataFrame
    edges: DataFrame

    def cache(self) -> PropertyGraph:
        return PropertyGraph(self.nodes.cache(), self.edges.cache())
