"""Questions a reader of the diagram asks: relations of a node, search, highlighting, the edge's and cluster's panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.columns import elide_cycle
from weftgraph.operators.edges import usage_groups
from weftgraph.scratch import Grown, settle


def relations(edges: DataFrame, node: int, position: DataFrame | None = None) -> DataFrame:
    """(direction, other, weight) of all edges (src, dst, weight) of a node, in the order of the others' positions, missing ones last."""
    out = edges.where(F.col("src") == node).select(F.lit("out").alias("direction"), F.col("dst").alias("other"), "weight")
    into = edges.where(F.col("dst") == node).select(F.lit("in").alias("direction"), F.col("src").alias("other"), "weight")
    both = into.union(out)
    if position is None:
        return both.orderBy("direction", "other")
    at = position.select(F.col("node_id").alias("other"), "position")
    return both.join(at, "other", "left").orderBy("direction", F.asc_nulls_last("position"), "other").select("direction", "other", "weight")


def search_nodes(nodes: DataFrame, text: str, kinds: tuple[str, ...] = ("crate", "module", "external")) -> DataFrame:
    """node_id whose name holds the text, case aside; an empty text finds nothing."""
    text = text.strip().lower()
    return nodes.where(F.col("kind").isin(*kinds) & F.lower("name").contains(text) & F.lit(bool(text))).select("node_id")


def search_symbols(edges: DataFrame, text: str) -> DataFrame:
    """node_id of both ends of edges that use a symbol that holds the text."""
    text = text.strip().lower()
    named = edges.where(F.exists("locations", lambda x: F.exists(x["symbols"], lambda s: F.lower(s).contains(text))) & F.lit(bool(text)))
    return named.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()


def search_refs(refs: DataFrame, text: str) -> DataFrame:
    """``search_symbols`` from single references (src, dst, symbol), before they are summed up to edges."""
    text = text.strip().lower()
    named = refs.where((F.col("src") != F.col("dst")) & F.lower("symbol").contains(text) & F.lit(bool(text)))
    return named.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()


def search(nodes: DataFrame, edges: DataFrame, visible: DataFrame, text: str, scope: str = "all") -> DataFrame:
    """(node_id, match): visible nodes that match or hide a match; match: direct or inside."""
    kinds = {"all": ("crate", "module", "external"), "crate": ("crate",), "module": ("module",)}.get(scope, ())
    hits = search_nodes(nodes, text, kinds) if kinds else nodes.select("node_id").limit(0)
    if scope in ("all", "symbol"):
        hits = hits.union(search_symbols(edges, text)).distinct()
    shown = hits.join(visible, "node_id")
    return shown.groupBy(F.col("visible").alias("node_id")).agg(F.bool_or(F.col("node_id") == F.col("visible")).alias("direct")).select("node_id", F.when(F.col("direct"), "direct").otherwise("inside").alias("match"))


def touching_arcs(edges: DataFrame, matches: DataFrame) -> DataFrame:
    """Arcs with an end among the matches."""
    m = matches.select("node_id")
    return edges.join(m.withColumnRenamed("node_id", "src"), "src", "left_semi").unionByName(edges.join(m.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(*edges.columns)).distinct()


def visible_arcs(arcs: DataFrame, visible: DataFrame, layers: set[str], hidden: DataFrame | None = None) -> DataFrame:
    """Arcs in an active layer whose both ends are visible nodes and not filtered out.

    Layers: crate, module, reexport (pure re-exports), and cycle beside one of these for cyclic arcs.  Arcs: with columns
    edge_type, reexport, cyclic.
    """
    own = visible.where("node_id = visible").select("node_id")
    if hidden is not None:
        own = own.join(hidden, "node_id", "left_anti")
    active = lambda name: F.lit(name in layers)
    of = F.when(F.col("edge_type") == "crate_dep", active("crate")).when(F.col("reexport"), active("reexport")).otherwise(active("module"))
    kept = arcs.where(of | (F.col("cyclic") & active("cycle")))
    return kept.join(own.withColumnRenamed("node_id", "src"), "src", "left_semi").join(own.withColumnRenamed("node_id", "dst"), "dst", "left_semi")


def highlight_roles(edges: DataFrame, node: int, cyclic: DataFrame | None = None) -> DataFrame:
    """(node_id, role) around a selected node: current, then what it depends on and what depends on it, production first, then members of its cycles."""
    mine = edges.where((F.col("src") == node) | (F.col("dst") == node))
    other = F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src"))
    role = F.when(F.col("src") == node, "dependency").otherwise("dependent")
    ranked = mine.select(other.alias("node_id"), F.struct(F.when(F.col("ctx_kind") == "production", 1).otherwise(2).alias("p"), role.alias("role")).alias("r"))
    rows = ranked.union(edges.sparkSession.range(1).select(F.lit(node).cast("long"), F.struct(F.lit(0).alias("p"), F.lit("current").alias("role"))))
    if cyclic is not None:
        group = cyclic.join(cyclic.where(F.col("node_id") == node).select("scc_id"), "scc_id", "left_semi")
        rows = rows.union(group.select("node_id", F.struct(F.lit(3).alias("p"), F.lit("cycle-member").alias("role"))))
    return rows.groupBy("node_id").agg(F.min("r").alias("r")).select("node_id", "r.role")


def pinned_group(edges: DataFrame, nodes: DataFrame, node: int) -> DataFrame:
    """(node_id): a pinned node and its descendants that arcs among them connect to it; rounds are bounded by the subtree's size."""
    inside = nodes.where((F.col("node_id") == node) | F.array_contains("ancestors", F.lit(node))).select("node_id")
    e = edges.select("src", "dst").join(inside.withColumnRenamed("node_id", "src"), "src", "left_semi").join(inside.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    e = settle(e.union(e.select("dst", "src")).distinct())
    seen = Grown(inside.where(F.col("node_id") == node))
    frontier = seen.rows
    while not frontier.isEmpty():
        frontier = settle(e.join(frontier.withColumnRenamed("node_id", "src"), "src").select(F.col("dst").alias("node_id")).distinct().join(seen.rows, "node_id", "left_anti"))
        seen.add(frontier)
    return seen.rows


def edge_panel(edges: DataFrame, src: int, dst: int) -> DataFrame:
    """Usage groups of one relation, most locations first; a manifest dependency where there are none."""
    groups = usage_groups(edges.where((F.col("src") == src) & (F.col("dst") == dst)))
    return groups.select("symbol", "module_path", F.size("locations").alias("n"), "locations", "via_reexport").orderBy(F.desc("n"), "symbol")


def panel_totals(groups: DataFrame) -> DataFrame:
    """One row of an edge panel's head: symbols that are named, and locations, each (file, line) once."""
    return groups.agg(F.count_if(F.col("symbol") != "").alias("symbols"), F.size(F.array_distinct(F.flatten(F.collect_list("locations")))).alias("locations"))  # the groups of one relation


def merged_groups(groups: DataFrame) -> DataFrame:
    """Groups of several relations as one: locations once a (file, line), the first module path."""
    return groups.groupBy("symbol").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("locations")))).alias("locations"), F.min("module_path").alias("module_path"))


def node_panel(edges: DataFrame, nodes: DataFrame, node: int) -> DataFrame:
    """Relations of a node with the others' names and number of locations, incoming first; width: the longest name."""
    use = edges.withColumn("weight", F.coalesce(F.size("locations"), F.lit(0)))
    rel = relations(use.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), node)
    named = rel.join(nodes.select(F.col("node_id").alias("other"), "qualified_name"), "other", "left")
    return named.withColumn("width", F.max(F.length("qualified_name")).over(Window.partitionBy("direction"))).orderBy("direction", F.desc("weight"), "other")


def node_usage(edges: DataFrame, node: int) -> DataFrame:
    """(direction, other, symbol, n): usage groups of all relations of a node, counted."""
    of = F.when(F.col("dst") == node, F.struct(F.lit("in").alias("direction"), F.col("src").alias("other"))).otherwise(F.struct(F.lit("out").alias("direction"), F.col("dst").alias("other")))
    groups = usage_groups(edges.where((F.col("src") == node) | (F.col("dst") == node)))
    return groups.select(of.alias("of"), "symbol", F.size("locations").alias("n")).select("of.*", "symbol", "n")


def short_labels(names: DataFrame) -> DataFrame:
    """(scc_id, node_id, label): the shortest trailing part of a qualified name that is unique in its component."""
    parts = names.select("scc_id", "node_id", F.split("qualified_name", "::").alias("p"))
    tails = parts.select("scc_id", "node_id", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("n"), "p").withColumn("label", F.array_join(F.slice("p", F.size("p") - F.col("n") + 1, F.col("n")), "::"))
    unique = tails.withColumn("k", F.count("*").over(Window.partitionBy("scc_id", "label"))).where((F.col("k") == 1) | (F.col("n") == F.size("p")))
    return unique.groupBy("scc_id", "node_id").agg(F.min_by("label", "n").alias("label"))


def cluster_panel(blocks: DataFrame, labels: DataFrame, weights: DataFrame) -> DataFrame:
    """Rows of the cluster panel: each cycle's arcs in order, with symbols, whether the arc closes the ring and whether it was listed before."""
    names = blocks.select("scc_id", "block", F.posexplode("path").alias("i", "node_id")).join(labels, ["scc_id", "node_id"])
    title = names.groupBy("scc_id", "block").agg(elide_cycle(F.transform(F.sort_array(F.collect_list(F.struct("i", "label"))), lambda x: x["label"])).alias("title"))
    turned = F.concat(F.slice("path", F.lit(2), F.size("path")), F.slice("path", F.lit(1), F.lit(1)))
    arcs = blocks.select("scc_id", "block", F.size("path").alias("n"), F.posexplode(F.arrays_zip(F.col("path").alias("src"), turned.alias("dst"))).alias("i", "x")).select("scc_id", "block", "n", "i", "x.src", "x.dst")
    before = F.row_number().over(Window.partitionBy("scc_id", "src", "dst").orderBy("block", "i")) > 1
    rows = arcs.withColumn("repeated", before).withColumn("closing", F.col("i") == F.col("n") - 1)
    return rows.join(weights, ["src", "dst"], "left").join(title, ["scc_id", "block"]).select("scc_id", "block", "title", "i", "src", "dst", "refs", "repeated", "closing")


def multi_version_groups(nodes: DataFrame) -> DataFrame:
    """(name, versions): external names with more than one node."""
    return nodes.where("kind = 'external'").groupBy("name").agg(F.count("*").alias("versions")).where("versions > 1")
