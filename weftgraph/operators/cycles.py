"""Strongly connected components by joins at every size, and the shortest cycle through every cyclic edge."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.cycle_search import SIDE, shortest_ways
from weftgraph.scratch import Grown, discard, settle, settle_counted

#: Edges that a task contracts together.
CHUNK = 1 << 19
SCC_SCHEMA = "node_id long, scc_id long"
CYCLE_SCHEMA = "scc_id long, path array<long>"


def scc_kernel(edges: list[tuple[int, int]]) -> dict[int, int]:
    """Node -> least node of its component, for components of two nodes or more (iterative Tarjan)."""
    out: dict[int, list[int]] = defaultdict(list)
    nodes = sorted({x for e in edges for x in e})
    for a, b in sorted(set(edges)):
        out[a].append(b)
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    on: set[int] = set()
    stack: list[int] = []
    result: dict[int, int] = {}
    for root in nodes:
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    group = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        group.append(w)
                        if w == v:
                            break
                    if len(group) > 1:
                        least = min(group)
                        result.update(dict.fromkeys(group, least))
    return result


def _merged_here(edges: DataFrame, chunk: int) -> DataFrame:
    """(node_id, rep): nodes that the edges which a task reads together connect both ways, ``chunk`` edges at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []

        def close() -> pa.RecordBatch:
            found = {n: r for n, r in scc_kernel(held).items() if n != r}
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["node_id", "rep"])

        for batch in batches:
            for at in range(0, len(batch), chunk):
                part = batch.slice(at, chunk)
                if held and len(held) + len(part) > chunk:
                    yield close()
                held += zip(part.column("src").to_pylist(), part.column("dst").to_pylist(), strict=True)
        if held:
            yield close()

    return edges.select("src", "dst").mapInArrow(run, "node_id long, rep long")


def _jumped(to: DataFrame) -> DataFrame:
    """(node_id, rep) with each rep followed to the end: pointers double, so that n steps take log n rounds."""
    while True:
        far = to.select(F.col("node_id").alias("rep"), F.col("rep").alias("far"))
        to, seen = settle_counted(to.join(far, "rep", "left").select("node_id", F.coalesce("far", "rep").alias("rep"), F.col("far").isNotNull().alias("moved")), moved=F.count_if("moved"))
        to = to.select("node_id", "rep")
        if not seen["moved"]:
            return to


def _relabelled(edges: DataFrame, to: DataFrame) -> DataFrame:
    a, b = to.toDF("src", "a"), to.toDF("dst", "b")
    return edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"))


def _contract(left: DataFrame, n: int, events: list[tuple[str, DataFrame]], chunk: int) -> tuple[DataFrame, int]:
    """Merges what tasks find to be connected both ways, until none finds anything.

    Where two tasks put a node under different representatives, the edges between those, both ways, stay to be merged later.
    """
    while n:
        pairs, seen = settle_counted(_merged_here(left, chunk).distinct())
        if not seen["n"]:
            break
        to = _jumped(pairs.groupBy("node_id").agg(F.min("rep").alias("rep")))
        events.append(("merge", to))
        apart = _relabelled(pairs.select(F.col("node_id").alias("src"), F.col("rep").alias("dst")), to)
        both = apart.union(apart.select("dst", "src"))
        left, seen = settle_counted(_relabelled(left, to).union(both).where("src <> dst").distinct())
        n = seen["n"]
    return left, n


def _trimmed(left: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Without nodes that have no edge in or none out, as long as a round takes a tenth of the edges."""
    while n:
        left, seen = settle_counted(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        was, n = n, seen["n"]
        if was - n < was / 10:
            break
    return left, n


def _unchained(left: DataFrame, edges: int, events: list[tuple[str, DataFrame]]) -> tuple[DataFrame, int]:
    """Without nodes that have one edge in and one out: an edge leads from what is before such a chain to what is after it.

    Pointers double along the chains, both ways, so that a chain of n nodes takes log n rounds.  Where chains are less than a tenth of the nodes nothing is done.
    """
    into = left.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("n_in"), F.min("src").alias("before"))
    out = left.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("n_out"), F.min("dst").alias("after"))
    one = F.coalesce((F.col("n_in") == 1) & (F.col("n_out") == 1), F.lit(False))
    degrees, seen = settle_counted(into.join(out, "node_id", "full"), one=F.count_if(one))
    n = seen["one"]
    if n * 10 < seen["n"] or not n:
        return left, edges
    inner = degrees.where(one).select("node_id", "before", "after")
    chain = settle(inner.withColumns({"first": F.col("before"), "last": F.col("after"), "low": F.col("node_id")}))
    step = 1
    while True:
        back = chain.select(F.col("node_id").alias("first"), F.col("first").alias("first2"))
        on = chain.select(F.col("node_id").alias("last"), F.col("last").alias("last2"), F.col("low").alias("low2"))
        both = chain.join(back, "first", "left").join(on, "last", "left")
        chain, seen = settle_counted(both.select("node_id", "before", "after", F.coalesce("first2", "first").alias("first"), F.coalesce("last2", "last").alias("last"), F.least("low", F.coalesce("low2", "low")).alias("low"), (F.col("first2").isNotNull() | F.col("last2").isNotNull()).alias("moved")), moved=F.count_if("moved"))
        chain, step = chain.select("node_id", "before", "after", "first", "last", "low"), 2 * step
        if step > 2 * n or not seen["moved"]:
            break
    members = chain.select(F.col("node_id").alias("last"), F.lit(True).alias("ring"))
    chain = settle(chain.join(members, "last", "left"))
    rings = chain.where("ring")  # chains that end in themselves
    events.append(("merge", settle(rings.where("node_id <> low").select("node_id", F.col("low").alias("rep")))))
    open_ = chain.where("ring is null")
    events.append(("chain", open_.select("node_id", "first", "last")))
    inside = chain.select("node_id")
    rest = left.join(inside.toDF("src"), "src", "left_anti").join(inside.toDF("dst"), "dst", "left_anti")
    over = open_.where("first = before").select(F.col("first").alias("src"), F.col("last").alias("dst"))
    left, seen = settle_counted(rest.select("src", "dst").union(over).where("src <> dst").distinct())
    return left, seen["n"]


def _rooted(left: DataFrame, events: list[tuple[str, DataFrame]]) -> tuple[DataFrame, int]:
    """Every node takes the least node that leads to it (its colour); what leads back to that node inside the colour is its component, and leaves.

    A round joins the nodes whose colour has just changed, and no others.
    """
    nodes = left.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct().withColumn("colour", F.col("node_id"))
    colours = Grown(nodes)
    moved = colours.rows
    while True:
        came = left.join(moved.toDF("src", "from"), "src").groupBy(F.col("dst").alias("node_id")).agg(F.min("from").alias("best"))
        now = colours.rows.join(came.select("node_id"), "node_id", "left_semi").groupBy("node_id").agg(F.min("colour").alias("colour"))
        moved, seen = settle_counted(came.join(now, "node_id").where("best < colour").select("node_id", F.col("best").alias("colour")))
        if not seen["n"]:
            break
        colours.add(moved)
    colour = settle(colours.rows.groupBy("node_id").agg(F.min("colour").alias("colour")))
    inside = settle(left.join(colour.toDF("src", "a"), "src").join(colour.toDF("dst", "b"), "dst").where("a = b").select("src", "dst", F.col("a").alias("colour")))
    back = Grown(colour.where("node_id = colour"))
    frontier = back.rows
    while True:  # who leads back to the root
        step = inside.join(frontier.select(F.col("node_id").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node_id"), "colour").distinct()
        frontier, seen = settle_counted(step.join(back.rows, ["node_id", "colour"], "left_anti"))
        if not seen["n"]:
            break
        back.add(frontier)
    events.append(("merge", settle(back.rows.where("node_id <> colour").select("node_id", F.col("colour").alias("rep")))))
    gone = settle(back.rows.select("node_id"))
    left, seen = settle_counted(left.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select("src", "dst"))
    return left, seen["n"]


def strong_components(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(node_id, scc_id): nodes of components of two nodes or more; scc_id is the least node.

    Tasks first merge what their own edges connect both ways; then nodes without an edge in or out leave, and chains shrink to an edge; of what is left each
    round finds the components of many roots at once.  Each step only notes what it merged; the notes are
    read backwards at the end, when it is known what became of the nodes that others were put under.
    Edges with a null end and loops are ignored; an empty table gives no rows.
    """
    events: list[tuple[str, DataFrame]] = []
    left, seen = settle_counted(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src <> dst").distinct())
    n = seen["n"]
    while n:
        left, n = _trimmed(*_contract(left, n, events, chunk))
        if n:
            left, n = _trimmed(*_unchained(left, n, events))
        if n:
            left, n = _rooted(left, events)
    spark = edges.sparkSession
    known = None  # (node_id, root) of nodes in components
    for kind, table in reversed(events):
        if kind == "merge":
            at = table if known is None else table.join(known.toDF("rep", "root"), "rep", "left").select("node_id", F.coalesce("root", "rep").alias("rep"))
            new = at.toDF("node_id", "root").union(at.select(F.col("rep").alias("node_id"), F.col("rep").alias("root")))
        else:
            ends = table.withColumns({"u": F.col("first"), "w": F.col("last")})
            if known is not None:
                ends = ends.join(known.toDF("first", "ru"), "first", "left").join(known.toDF("last", "rw"), "last", "left").withColumns({"u": F.coalesce("ru", "first"), "w": F.coalesce("rw", "last")})
            same = ends.where("u = w").select("node_id", F.col("u").alias("root"))
            new = same.union(same.select(F.col("root").alias("node_id"), "root"))
        known = settle((new if known is None else known.union(new)).distinct())
    if known is None:
        return spark.createDataFrame([], SCC_SCHEMA)
    least = known.groupBy("root").agg(F.min("node_id").alias("scc_id"))
    return known.join(least, "root").select("node_id", "scc_id")


def inner_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(scc_id, src, dst): edges inside a component."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    return e.join(components.toDF("src", "scc_id"), "src").join(components.toDF("dst", "to_scc"), "dst").where("scc_id = to_scc").select("scc_id", "src", "dst")


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """(src, dst): edges that lie on a cycle, once each.

    They are the edges inside components: such an edge has a way back, so it is an arc of its own minimal cycle, and no cycle leaves a component.  All arcs of
    ``minimal_cycles`` are found so without a path being written.
    """
    return inner_edges(edges, settle(strong_components(edges))).select("src", "dst")


def arcs_of(inner: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The edges inside components (scc_id, src, dst) with chains as single arcs: (scc_id, a, b, len, pred), and the chains (pred, inside) where there are any.

    A node with one edge in and one out lies inside a chain, but for the least node of a component, so that no ring is without an end.  ``len``: the
    arc's edges; ``pred``: the node before b; ``inside``: the nodes between a and b.  Pointers double along the chains.
    """
    into = inner.groupBy("scc_id", F.col("dst").alias("node_id")).agg(F.count("*").alias("n_in"), F.min("src").alias("before"))
    out = inner.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("n_out"), F.min("dst").alias("after"))
    chained, seen = settle_counted(into.join(out, "node_id").where("n_in = 1 and n_out = 1 and node_id <> scc_id").select("scc_id", "node_id", "before", "after"))
    plain = inner.select("scc_id", F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).alias("len"), F.col("src").alias("pred"))
    if not seen["n"]:
        return plain, None
    inside = chained.select("node_id")
    starts = chained.join(inside.select(F.col("node_id").alias("before"), F.lit(True).alias("on")), "before", "left")
    to = settle(starts.select("node_id", F.when(F.col("on"), F.col("before")).otherwise(F.col("node_id")).alias("head"), F.when(F.col("on"), 1).otherwise(0).alias("steps")))
    while True:
        far = to.select(F.col("node_id").alias("head"), F.col("head").alias("far"), F.col("steps").alias("more"))
        to, moved = settle_counted(to.join(far, "head").select("node_id", F.col("far").alias("head"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("more") > 0).alias("moved")), moved=F.count_if("moved"))
        to = to.drop("moved")
        if not moved["moved"]:
            break
    rows = chained.join(to, "node_id").groupBy("scc_id", "head").agg(F.min_by("before", "steps").alias("a"), F.max_by("after", "steps").alias("b"), F.max_by("node_id", "steps").alias("pred"), F.sort_array(F.collect_list(F.struct("steps", "node_id"))).alias("x"))
    chains = settle(rows.select("scc_id", "a", "b", (F.size("x") + 1).alias("len"), "pred", F.col("x.node_id").alias("inside")))
    open_ = plain.join(inside.toDF("a"), "a", "left_anti").join(inside.toDF("b"), "b", "left_anti").select("scc_id", "a", "b", "len", "pred")
    return settle(open_.union(chains.drop("inside"))), chains.select("pred", "inside")


def minimal_cycles(edges: DataFrame, components: DataFrame | None = None, side: int = SIDE) -> DataFrame:
    """(scc_id, path): the shortest cycle through each cyclic edge, once each, from its least node on.

    All edges of a chain lie on the same cycles, so chains are searched as single arcs (``arcs_of``), and only the nodes that are left are sources and places.
    ``shortest_ways`` searches from blocks of them at once and writes nothing but the cycles that it found, as arcs; chains are put in when each cycle is there once.
    """
    once = None
    if components is None:  # both steps read the edges
        edges = once = settle(edges.select("src", "dst"))
        components = strong_components(edges)
    inner = settle(inner_edges(edges, settle(components)))
    if once is not None:
        discard(once)
    arcs, chains = arcs_of(inner)
    lens = [r["len"] for r in arcs.select("len").distinct().collect()]  # their sum is below the number of nodes
    if not lens:
        return edges.sparkSession.createDataFrame([], CYCLE_SCHEMA)
    found = settle(shortest_ways(arcs, lens, side).distinct())
    if chains is None:
        return found  # every pred is a node of the path
    inside = arcs.where("len > 1").select("pred", "a").join(chains, "pred").select("pred", F.concat(F.array("a"), "inside").alias("nodes"))
    each = found.select("scc_id", "path", F.posexplode("path").alias("at", "pred")).join(inside, "pred", "left")
    nodes = F.struct("at", F.coalesce("nodes", F.array("pred")).alias("nodes"))
    whole = each.groupBy("scc_id", "path").agg(F.sort_array(F.collect_list(nodes)).alias("x")).select("scc_id", F.flatten("x.nodes").alias("path"))
    least = F.array_position("path", F.array_min("path")).cast("int")
    return whole.select("scc_id", F.concat(F.slice("path", least, F.size("path")), F.slice("path", F.lit(1), least - 1)).alias("path"))


def with_cycle_ids(cycles: DataFrame) -> DataFrame:
    """Cycles with cycle_id (a hash of the path, the same in every run)."""
    return cycles.withColumn("cycle_id", F.xxhash64("path"))


def cycle_arcs(cycles: DataFrame) -> DataFrame:
    """(scc_id, cycle_id, src, dst): the arcs of each cycle."""
    turned = F.concat(F.slice("path", F.lit(2), F.size("path")), F.slice("path", F.lit(1), F.lit(1)))
    pairs = F.explode(F.arrays_zip(F.col("path").alias("src"), turned.alias("dst")))
    return with_cycle_ids(cycles).select("scc_id", "cycle_id", pairs.alias("x")).select("scc_id", "cycle_id", "x.src", "x.dst")


def edge_cycle_counts(cycles: DataFrame) -> DataFrame:
    """(scc_id, src, dst, cycles)."""
    return cycle_arcs(cycles).groupBy("scc_id", "src", "dst").agg(F.countDistinct("cycle_id").alias("cycles"))


def ranked_cycle_edges(counts: DataFrame, weights: DataFrame, names: DataFrame) -> DataFrame:
    """Cyclic edges by rank in their component: cycles descending, symbols, then names."""
    named = counts.join(weights, ["src", "dst"], "left").na.fill(0, ["refs"])
    named = named.join(names.toDF("src", "src_name"), "src").join(names.toDF("dst", "dst_name"), "dst")
    order = Window.partitionBy("scc_id").orderBy(F.desc("cycles"), "refs", "src_name", "dst_name")
    return named.withColumn("rank", F.row_number().over(order)).select("scc_id", "src", "dst", "cycles", "refs", "rank")
