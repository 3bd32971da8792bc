"""Deterministic orders of siblings and of whole trees."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.cycles import scc_kernel
from weftgraph.scratch import settle

MOST_PERMUTED = 8
Weights = dict[tuple[int, int], int]


def by_priority(nodes: list[int], edges: set[tuple[int, int]], priority) -> list[int]:
    """Kahn's order; of the ready nodes the one with the least ``priority(node, places so far)`` at the time it became ready."""
    waiting = dict.fromkeys(nodes, 0)
    out: dict[int, list[int]] = defaultdict(list)
    for a, b in sorted(edges):
        waiting[b] += 1
        out[a].append(b)
    place: dict[int, int] = {}
    ready = [(priority(n, place), n) for n in nodes if waiting[n] == 0]
    heapq.heapify(ready)
    while ready:
        _, n = heapq.heappop(ready)
        place[n] = len(place)
        for b in out[n]:
            waiting[b] -= 1
            if waiting[b] == 0:
                heapq.heappush(ready, (priority(b, place), b))
    return list(place)


def within_component(members: list[int], weights: Weights, name: dict[int, str]) -> list[int]:
    """The order with the least weight that points back; of equals, and beyond ``MOST_PERMUTED`` members, by name.

    By sets of members already placed, of which there are 2^n, instead of n! orders.
    """
    if len(members) > MOST_PERMUTED:
        return sorted(members, key=lambda n: (name[n], n))

    ms = sorted(members, key=lambda n: (name[n], n))
    all_ = (1 << len(ms)) - 1
    back = [[weights.get((late, early), 0) for early in ms] for late in ms]

    def added(placed: int, i: int) -> int:
        """What points back if the i-th member comes after those placed."""
        return sum(w for j, w in enumerate(back[i]) if placed >> j & 1)

    rest = [0] * (all_ + 1)  # the least that what is not placed yet will point back, by the set of those placed
    for placed in range(all_ - 1, -1, -1):
        rest[placed] = min(added(placed, i) + rest[placed | 1 << i] for i in range(len(ms)) if not placed >> i & 1)
    order, placed = [], 0
    while placed != all_:  # of equals the first by name
        i = next(i for i in range(len(ms)) if not placed >> i & 1 and added(placed, i) + rest[placed | 1 << i] == rest[placed])
        order.append(ms[i])
        placed |= 1 << i
    return order


def sibling_order(name: dict[int, str], weights: Weights) -> list[int]:
    """Dependents first; ready nodes by the mean place of what depends on them, then name. Cycles are condensed and ordered inside."""
    nodes = sorted(name)
    edges = {e for e in weights if e[0] != e[1] and e[0] in name and e[1] in name}
    users: dict[int, list[int]] = defaultdict(list)
    for a, b in edges:
        users[b].append(a)

    def centre(n: int, place: dict[int, int]) -> tuple[float, str]:
        at = [place[u] for u in users[n] if u in place]
        return (sum(at) / len(at) if at else float("inf"), name[n])

    order = by_priority(nodes, edges, centre)
    if len(order) == len(nodes):
        return order
    group = {n: n for n in nodes} | scc_kernel(list(edges))
    members: dict[int, list[int]] = defaultdict(list)
    for n in nodes:
        members[group[n]].append(n)
    outer = {(group[a], group[b]) for a, b in edges if group[a] != group[b]}
    least = {g: min(name[n] for n in ms) for g, ms in members.items()}
    return [n for g in by_priority(sorted(members), outer, lambda g, _: least[g]) for n in within_component(members[g], weights, name)]


def order_siblings(nodes: DataFrame, weights: DataFrame) -> DataFrame:
    """(parent_id, node_id, position): the order of each parent's children, one grouped kernel a parent.

    ``nodes``: node_id, parent_id, name; ``weights``: src, dst, weight between siblings.
    """
    kids = nodes.select(F.coalesce("parent_id", F.lit(-1).cast("long")).alias("parent"), "node_id", "name")
    both = weights.join(kids.select("parent", F.col("node_id").alias("src")), "src").join(kids.select(F.col("parent").alias("other"), F.col("node_id").alias("dst")), "dst").where("parent = other")

    def kernel(key: tuple, mine: pd.DataFrame, deps: pd.DataFrame) -> pd.DataFrame:
        name = dict(zip(mine["node_id"].tolist(), mine["name"].fillna("").tolist(), strict=True))
        weight = {(a, b): w for a, b, w in zip(deps["src"].tolist(), deps["dst"].tolist(), deps["weight"].tolist(), strict=True)}
        order = sibling_order(name, weight)
        return pd.DataFrame({"parent": key[0], "node_id": order, "position": range(len(order))}).astype("int64")

    deps = both.select(F.col("other").alias("of"), "src", "dst", "weight")
    done = kids.groupBy("parent").cogroup(deps.groupBy("of")).applyInPandas(kernel, "parent long, node_id long, position long")
    return done.select(F.nullif("parent", F.lit(-1)).alias("parent_id"), "node_id", "position")


def tree_order(nodes: DataFrame, siblings: DataFrame) -> DataFrame:
    """(node_id, rank_path): depth-first order of the whole forest is the order of ``rank_path`` (arrays compare from the left)."""
    rank = siblings.select(F.col("node_id").alias("anc"), F.col("position"))
    line = nodes.select("node_id", F.posexplode(F.concat("ancestors", F.array("node_id"))).alias("level", "anc"))
    ranked = line.join(rank, "anc").groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("level", "position"))).alias("x"))
    return ranked.select("node_id", F.transform("x", lambda s: s["position"]).alias("rank_path"))


def external_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, position) of external nodes: those that most depend on first, then by name."""
    outside = nodes.where("kind = 'external'").select("node_id", "name", F.lit(None).cast("long").alias("parent_id"))
    incoming = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("n"))
    keyed = outside.join(incoming, "node_id", "left").select("node_id", "parent_id", F.concat(F.lpad((F.lit(10**9) - F.coalesce("n", F.lit(0))).cast("string"), 10, "0"), F.col("name")).alias("name"))
    links = edges.where("ctx_kind = 'production'").groupBy("src", "dst").agg(F.count("*").alias("weight"))
    return order_siblings(keyed, links).select("node_id", "position")


def topo_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, level) of an acyclic graph: the longest way from a node without edges in, by peeling a level a round."""
    level, left, out = 0, settle(nodes.select("node_id").distinct()), None
    links = settle(edges.select("src", "dst").where("src <> dst").distinct())
    while True:
        ready = settle(left.join(links.select(F.col("dst").alias("node_id")).distinct(), "node_id", "left_anti"))
        if ready.isEmpty():
            break
        done = ready.withColumn("level", F.lit(level))
        out = done if out is None else out.union(done)
        left = settle(left.join(ready, "node_id", "left_anti"))
        links = settle(links.join(ready.withColumnRenamed("node_id", "src"), "src", "left_anti").select("src", "dst"))
        level += 1
    return out if out is not None else nodes.select("node_id", F.lit(0).alias("level")).limit(0)


def cycle_blocks(cycles: DataFrame, rank: DataFrame) -> DataFrame:
    """Cycles of each component in order: turned to the member of least rank, then by that rank, length and the other ranks.

    ``rank``: node_id, rank; a missing rank comes last.
    """
    far = F.lit(2**62)
    numbered = cycles.withColumn("c", F.xxhash64("path")).select("scc_id", "path", "c", F.posexplode("path").alias("i", "node_id"))
    ranked = numbered.join(rank, "node_id", "left").groupBy("scc_id", "path", "c").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("rank", far).alias("r")))).alias("x"))
    rs = F.transform("x", lambda s: s["r"])
    at = F.array_position(rs, F.array_min(rs)).cast("int")
    turn = lambda a: F.concat(F.slice(a, at, F.size(a)), F.slice(a, F.lit(1), at - 1))
    turned = ranked.select("scc_id", turn(F.col("path")).alias("path"), turn(rs).alias("ranks"))
    order = Window.partitionBy("scc_id").orderBy(F.get("ranks", F.lit(0)), F.size("path"), "ranks", "path")
    return turned.withColumn("block", F.row_number().over(order)).select("scc_id", "block", "path")
