"""Edges to remove so that no cycle is left, and the report on each tangle."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.columns import is_pure_reexport
from weftgraph.operators.cycles import cycle_arcs, edge_cycle_counts, inner_edges, minimal_cycles, scc_kernel
from weftgraph.operators.numbering import numbered
from weftgraph.scratch import Grown, settle, settle_counted

#: Nodes times edges of a component up to which its choices are made one after the other, in a task that holds no other component.
KERNEL_STEPS = 2_000_000
#: Cycles of an edge up to which a task looks at all of them together.
MOST_OF_AN_EDGE = 1_000_000
#: Order in which edges are given up among equals: last those that a hierarchy needs.
PREFERRED, NEUTRAL, STRUCTURAL = 0, 1, 2


def cycles_kernel(edges: list[tuple[int, int]]) -> list[list[int]]:
    """The shortest cycle through each edge of one component: by levels from its head, each node's parent the least one of the level before."""
    out: dict[int, list[int]] = defaultdict(list)
    into: dict[int, list[int]] = defaultdict(list)
    for a, b in sorted(set(edges)):
        if a != b:
            out[a].append(b)
            into[b].append(a)
    seen: set[tuple[tuple[int, int], ...]] = set()
    found: list[list[int]] = []
    for v in sorted(into):
        parent = {v: v}
        level = [v]
        while level:
            new: dict[int, int] = {}
            for u in level:
                for w in out[u]:
                    if w not in parent and (w not in new or u < new[w]):
                        new[w] = u
            parent.update(new)
            level = sorted(new)
        for u in into[v]:
            path = [u]
            while path[-1] != v:
                path.append(parent[path[-1]])
            path.reverse()
            arcs = tuple(sorted(zip(path, path[1:] + path[:1], strict=True)))
            if arcs not in seen:
                seen.add(arcs)
                at = path.index(min(path))
                found.append(path[at:] + path[:at])
    return found


def cover(edges: list[tuple[int, int]], key: dict[tuple[int, int], tuple]) -> list[tuple[int, int]]:
    """Greedy cover of the minimal cycles; what cycles the cut leaves are covered in turn, until there are none.

    ``key``: of edges that cover equally many cycles the one with the least key goes first.
    """
    chosen: list[tuple[int, int]] = []
    left = sorted(set(edges))
    while True:
        inside = scc_kernel(left)
        core = [(a, b) for a, b in left if inside.get(a) is not None and inside.get(a) == inside.get(b) and a != b]
        if not core:
            return chosen
        groups: dict[int, list[tuple[int, int]]] = {}
        for e in core:
            groups.setdefault(inside[e[0]], []).append(e)
        for group in groups.values():
            cycles = [list(zip(p, p[1:] + p[:1], strict=True)) for p in cycles_kernel(group)]
            of: dict[tuple[int, int], list[int]] = {}
            for i, c in enumerate(cycles):
                for e in c:
                    of.setdefault(e, []).append(i)
            count = {e: len(x) for e, x in of.items()}
            queue = [(-n, key[e], e) for e, n in count.items()]
            heapq.heapify(queue)
            covered = [False] * len(cycles)
            while queue:
                n, _, best = heapq.heappop(queue)
                if -n != count[best]:  # counts only fall: back with what is left
                    if count[best]:
                        heapq.heappush(queue, (-count[best], key[best], best))
                    continue
                chosen.append(best)
                for i in of[best]:
                    if not covered[i]:
                        covered[i] = True
                        for e in cycles[i]:
                            count[e] -= 1
        gone = set(chosen)
        left = [e for e in left if e not in gone]


def removal_bias(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, bias): from a parent to its child is structural; from a child to its parent preferred, unless it only re-exports."""
    plain = edges.groupBy("src", "dst").agg(F.bool_or(is_pure_reexport()).alias("reexport"))
    up = nodes.select("node_id", "parent_id")
    both = plain.join(up.toDF("src", "sp"), "src").join(up.toDF("dst", "dp"), "dst")
    child_to_parent = F.col("sp").eqNullSafe(F.col("dst"))
    bias = F.when(F.col("dp").eqNullSafe(F.col("src")) | (child_to_parent & F.coalesce("reexport", F.lit(False))), STRUCTURAL).when(child_to_parent, PREFERRED)
    return both.select("src", "dst", bias.otherwise(NEUTRAL).alias("bias"))


def cover_by_dominance(cycles: DataFrame, ranks: DataFrame) -> DataFrame:
    """(src, dst): a greedy cover of cycles (scc_id, path), the same as one choice after the other would make.

    ``ranks`` (src, dst, rank): of edges on equally many uncovered cycles the one of least rank goes first.  An edge that comes before all edges
    that it shares an uncovered cycle with is chosen by the one-by-one cover too, whatever happens elsewhere: counts only fall, and its own stays
    until one of those is chosen.  So a round takes all such edges, in all components, and the cycles on them leave.
    """
    left, seen = settle_counted(cycle_arcs(cycles).select("cycle_id", "src", "dst").distinct().join(ranks, ["src", "dst"]))
    hottest = left.groupBy("src", "dst").count().agg(F.max("count")).first()[0] if seen["n"] else 0
    flagged = _flag_by_windows if hottest <= MOST_OF_AN_EDGE else _flag_by_joins
    chosen: Grown | None = None
    while seen["n"]:
        done, seen = settle_counted(flagged(left), left=F.count_if(~F.col("covered")))
        seen["n"] = seen["left"]
        won = done.where("won").select("src", "dst").distinct()
        if chosen is None:
            chosen = Grown(won)
        else:
            chosen.add(won)
        left = done.where("not covered").select("cycle_id", "src", "dst", "rank")
    return chosen.rows if chosen else cycles.sparkSession.createDataFrame([], "src long, dst long")


def _flag_by_windows(left: DataFrame) -> DataFrame:
    """``left`` with won (its edge is chosen) and covered (an edge of its cycle is): four sorts, where no edge has more rows than a task can look at."""
    edge, cycle = Window.partitionBy("src", "dst"), Window.partitionBy("cycle_id")
    keyed = left.withColumn("key", F.struct((-F.count("*").over(edge)).alias("less"), "rank"))
    first = keyed.withColumn("first", F.min("key").over(cycle) == F.col("key")).withColumn("won", F.bool_and("first").over(edge))
    return first.select("cycle_id", "src", "dst", "rank", "won", F.bool_or("won").over(cycle).alias("covered"))


def _flag_by_joins(left: DataFrame) -> DataFrame:
    """The same by sums that are joined back, so that an edge on very many cycles is dealt out."""
    counts = left.groupBy("src", "dst").agg(F.count("*").alias("n"))
    keyed = settle(left.join(counts, ["src", "dst"]).select("cycle_id", "src", "dst", "rank", F.struct((-F.col("n")).alias("less"), "rank").alias("key")))
    best = keyed.groupBy("cycle_id").agg(F.min("key").alias("best"))
    won = settle(keyed.join(best, "cycle_id").groupBy("src", "dst").agg(F.bool_and(F.col("key") == F.col("best")).alias("won")))
    marked = keyed.join(won, ["src", "dst"])
    covered = marked.groupBy("cycle_id").agg(F.bool_or("won").alias("covered"))
    return marked.join(covered, "cycle_id").select("cycle_id", "src", "dst", "rank", "won", "covered")


def feedback_edges(edges: DataFrame, components: DataFrame, weights: DataFrame, names: DataFrame, bias: DataFrame | None = None, cycles: DataFrame | None = None, kernel_steps: int = KERNEL_STEPS) -> DataFrame:
    """All edges inside components, with their minimal cycles and symbols, and whether they are to go.

    The minimal cycles are covered; what cycles the cut leaves are covered in turn, until there are none.  Components of few nodes and edges are
    groups of a kernel, many side by side; larger ones are covered by dominance, in joins, all at once.  Both choose the same edges.
    """
    inner = inner_edges(edges, components).join(weights.select("src", "dst", "refs"), ["src", "dst"], "left").na.fill(0, ["refs"])
    inner = inner.join(names.toDF("src", "src_name"), "src").join(names.toDF("dst", "dst_name"), "dst")
    inner = inner.withColumn("bias", F.lit(NEUTRAL)) if bias is None else inner.join(bias, ["src", "dst"], "left").na.fill(NEUTRAL, ["bias"])
    inner = settle(inner)
    cycles = minimal_cycles(inner, components) if cycles is None else cycles
    counts = edge_cycle_counts(cycles).select("src", "dst", "cycles")
    nodes = components.groupBy("scc_id").agg(F.count("*").alias("n"))
    sizes, seen = settle_counted(inner.groupBy("scc_id").agg(F.count("*").alias("m")).join(nodes, "scc_id").select("scc_id", (F.col("n") * F.col("m") <= kernel_steps).alias("small")), small=F.count_if("small"))

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        order = {(a, b): (k, refs, s, d) for a, b, k, refs, s, d in zip(*(pdf[c].tolist() for c in ("src", "dst", "bias", "refs", "src_name", "dst_name")), strict=True)}
        return pd.DataFrame(cover(list(order), order), columns=["src", "dst"])

    gone = inner.join(sizes.where("small"), "scc_id", "left_semi").groupBy("scc_id").applyInPandas(kernel, "src long, dst long")
    if seen["n"] > seen["small"]:
        large = sizes.where("not small")
        gone = gone.union(_cut(settle(inner.join(large, "scc_id", "left_semi")), cycles.join(large, "scc_id", "left_semi")))
    marked = inner.join(counts, ["src", "dst"], "left").na.fill(0, ["cycles"]).join(gone.withColumn("feedback", F.lit(True)), ["src", "dst"], "left")
    return marked.select("scc_id", "src", "dst", "cycles", "refs", F.coalesce("feedback", F.lit(False)).alias("feedback"))


def _cut(inner: DataFrame, cycles: DataFrame) -> DataFrame:
    """(src, dst): covers by dominance, until no cycle is left."""
    ranks = numbered(inner, ["bias", "refs", "src_name", "dst_name"], "rank").select("src", "dst", "rank")
    cycles, seen = settle_counted(cycles)
    left, gone = inner.select("src", "dst"), inner.select("src", "dst").limit(0)
    while seen["n"]:
        cut = settle(cover_by_dominance(cycles, ranks))
        gone = settle(gone.union(cut))
        left = settle(left.join(cut, ["src", "dst"], "left_anti"))
        cycles, seen = settle_counted(minimal_cycles(left))
    return gone


def ranked_edges(feedback: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges of each component in order: most cycles first, then fewest symbols, then names; ``place`` from 0."""
    names = nodes.select("node_id", "qualified_name")
    named = feedback.join(names.toDF("src", "src_name"), "src").join(names.toDF("dst", "dst_name"), "dst")
    return numbered(settle(named.withColumn("less", -F.col("cycles"))), ["less", "refs", "src_name", "dst_name"], "place", within=("scc_id",))


def cluster_report(feedback: DataFrame, cycles: DataFrame, components: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row a component, in order: edges to remove, cycles, nodes, least node; with its crate and its first cycle.  Its edges: ``ranked_edges``."""
    per = feedback.groupBy("scc_id").agg(F.count_if("feedback").alias("n_feedback"))
    per = per.join(cycles.groupBy("scc_id").agg(F.count("*").alias("n_cycles"), F.min("path").alias("first_cycle")), "scc_id")
    per = per.join(components.groupBy("scc_id").agg(F.count("*").alias("n_nodes")), "scc_id")
    crate = nodes.select(F.col("node_id").alias("scc_id"), F.get("path", F.lit(0)).alias("crate"))
    rows = settle(per.join(crate, "scc_id", "left"))
    return numbered(rows, ["n_feedback", "n_cycles", "n_nodes", "scc_id"]).withColumn("position", F.col("position") + 1)
