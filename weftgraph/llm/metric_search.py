"""Exact top-k search by inner product: best-first search in M-trees.

Vectors are integers, compared by Euclidean distance.  Inner products follow distances by the triangle inequality:
|<q, x> - <q, o>| <= |q| d(x, o), so a node with routing object o and covering radius r holds no score above
<q, o> + |q| r, and what lies at distance e from a parent p no score above <q, p> + |q| e.

Rows belong to the nearest of some pivots (seeded draws, ``most_pivots`` of them at most), which are the top of the
tree: a pivot's node has a covering radius of its own.  Rows of a pivot
fill trees of about ``tree_size`` rows, by hash.  A tree is built from the top: each node's routing objects
are seeded draws, every vector goes to the nearest, and groups that fit a page become leaves.  A node stores its routing
object, its covering radius and its distance to the parent's routing object; a leaf's entries store their distance
to its routing object.  The search keeps nodes in a queue by their upper bound and leaves out each computation that the
stored distances already bound away: <q, p> + |q| (d(p, o) + r) below the k-th best score.  Bounds are widened by a
relative margin above float error, and the scores returned are exact integers.

A query (a row of the table itself) first meets the tree that holds it.  Its k-th best score there is its floor in all others: it is
sent to the trees of those pivots only that may hold something as good, and starts there with that floor.  A tree that many
queries ask meets them in blocks, a copy of it each.

How much is pruned depends on the vectors: clustered ones leave most trees and pages out; where all distances are
about alike (random vectors of many dimensions), every exact search looks at nearly everything, and so does this.

Defined results: vectors that are null, empty, of another length than the most common one, or hold null
or non-finite components take no part; a query's own row (by id) isn't its candidate; equal scores
go to the smaller id; of rows with equal ids the one with the higher score counts once, and those that ask are
one query; null ids take no part; extra columns don't matter.
Components beyond 2**20 after scaling raise an error, since scores must fit a long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.shared import materialize

LARGEST = 1 << 20
MARGIN = 1e-9


def far_from(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(1))


class Node:
    """A routing object and what is around it: children (their routing objects, radii and distances to this one), or rows in order of distance."""

    __slots__ = ("radius", "children", "centres", "radii", "to_parent", "rows", "entry")

    def __init__(self, radius: float):
        self.radius = radius
        self.children: list[Node] = []
        self.centres = self.radii = self.to_parent = self.rows = self.entry = None


class MTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = 256, fan: int = 16, seed: int = 9):
        self.ids, self.points = ids, vectors.astype(np.float64)
        self.largest = float(np.sqrt((self.points**2).sum(1).max(initial=0.0)))
        self.rng, self.page, self.fan = np.random.default_rng(seed), page, fan
        self.distances = 0
        self.centre = self.points.mean(0) if len(ids) else np.zeros(self.points.shape[1])
        self.root = self._build(np.arange(len(ids)), self.centre)

    def _build(self, rows: np.ndarray, centre: np.ndarray) -> Node:
        far = far_from(self.points[rows], centre)
        node = Node(float(far.max(initial=0.0)))
        if len(rows) > self.page and node.radius > 0:
            picks = self.points[self.rng.choice(rows, min(self.fan, len(rows)), replace=False)]
            nearest = np.stack([far_from(self.points[rows], p) for p in picks]).argmin(0)
            if np.bincount(nearest).max() < len(rows):
                used = np.unique(nearest)
                node.children = [self._build(rows[nearest == k], picks[k]) for k in used.tolist()]
                node.centres, node.radii = picks[used], np.array([c.radius for c in node.children])
                node.to_parent = far_from(node.centres, centre)
                return node
        order = np.argsort(far, kind="stable")
        node.rows, node.entry = rows[order], far[order]
        return node

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """(score, id) of the k best candidates with scores of ``floor`` or more, best first; an id counts once, with its best score."""
        q = query.astype(np.float64)
        size = float(np.sqrt((q**2).sum()))
        slack = MARGIN * (1 + size * self.largest)
        best: list[tuple[int, int]] = []  # (score, -id), the best last
        need = float("-inf") if floor is None else floor
        score = float(self.centre @ q)
        queue = [(-(score + size * self.root.radius), 0, score, self.root)]
        made = 0
        while queue:
            bound, _, score, node = heapq.heappop(queue)
            if -bound < need - slack:
                break
            if node.rows is None:
                open_ = np.flatnonzero(score + size * (node.to_parent + node.radii) >= need - slack)  # the others are bounded away by stored distances alone
                self.distances += len(open_)
                own_scores = node.centres[open_] @ q
                bounds = own_scores + size * node.radii[open_]
                for x in np.flatnonzero(bounds >= need - slack).tolist():
                    made += 1
                    heapq.heappush(queue, (-float(bounds[x]), made, float(own_scores[x]), node.children[open_[x]]))
                continue
            rows = node.rows[np.searchsorted(node.entry, (need - slack - score) / size) if size else 0 :]
            self.distances += len(rows)
            scores = (self.points[rows] @ q).astype(np.int64)
            rows, scores = rows[scores >= need], scores[scores >= need]
            ids = self.ids[rows]
            for x in np.lexsort((ids, -scores)).tolist():
                found = int(scores[x]), -int(ids[x])
                if len(best) == k and found <= best[0]:
                    break
                if found[1] == -own:
                    continue
                same = next((b for b in best if b[1] == found[1]), None)
                if same is not None:
                    if same >= found:
                        continue
                    best.remove(same)
                elif len(best) == k:
                    best.pop(0)
                best.append(found)
                best.sort()
            if len(best) == k:
                need = max(need, best[0][0])
        return [(s, -i) for s, i in reversed(best)]


def usable(vectors: DataFrame, scale: int = 256, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, v): integer vectors of the rows that take part."""
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    whole = vectors.where(F.col(key).isNotNull() & x.isNotNull() & (F.size(x) > 0)).where(~bad)
    return whole.select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long")).alias("v"))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    out = np.asarray(column.flatten(), np.int64).reshape(len(column), dim)
    if np.abs(out).max(initial=0) > LARGEST:
        raise ValueError(f"components beyond {LARGEST} after scaling")
    return out


def _placed(vectors: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    """``vectors`` with pivot, the nearest one, and far, the distance to it."""
    sent = vectors.sparkSession.sparkContext.broadcast(pivots.astype(np.float64))  # most_pivots rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                points = _matrix(part.column("v"), dim).astype(np.float64)
                pivot = ((sent.value**2).sum(1) - 2 * points @ sent.value.T).argmin(1)
                far = np.sqrt(((points - sent.value[pivot]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pivot, pa.int32()), pa.array(far)], [*part.schema.names, "pivot", "far"])

    return vectors.mapInArrow(run, "vec_id long, v array<long>, asks boolean, pivot int, far double")


def _asked(queries: DataFrame, pivots: np.ndarray, balls: dict[int, tuple[int, float]], dim: int) -> DataFrame:
    """(vec_id, v, floor, pivot, part): each query for each tree that may hold a score of its floor or more, but for the one that holds it."""
    order = np.array(sorted(balls), np.int64)
    sent = queries.sparkSession.sparkContext.broadcast((pivots[order].astype(np.float64), order, *(np.array([balls[p][x] for p in order.tolist()]) for x in range(2))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, order, parts, far = sent.value
        largest = np.sqrt((points**2).sum(1)) + far
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                q = _matrix(part.column("v"), dim).astype(np.float64)
                size = np.sqrt((q**2).sum(1))[:, None]
                floor = np.asarray(part.column("floor").cast(pa.float64()).fill_null(float("-inf")))[:, None]
                which, place = np.nonzero(q @ points.T + size * far + MARGIN * (1 + size * largest) >= floor)
                many = parts[place]
                which, place, number = np.repeat(which, many), np.repeat(place, many), np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                home = (order[place] == np.asarray(part.column("pivot"))[which]) & (number == np.asarray(part.column("part"))[which])
                take = pa.array(which[~home])
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in ("vec_id", "v", "floor")), pa.array(order[place][~home], pa.int32()), pa.array(number[~home], pa.int32())], ["vec_id", "v", "floor", "pivot", "part"])

    return queries.select("vec_id", "v", "floor", "pivot", "part").mapInArrow(run, "vec_id long, v array<long>, floor long, pivot int, part int")


def _searched(members: DataFrame, asked: DataFrame, dim: int, k: int, block: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each asked tree; ``asked``: (vec_id, v, floor, pivot, part)."""
    tree = ["pivot", "part"]
    blocks = asked.groupBy(*tree).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    held = members.join(blocks, tree).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"floor": F.lit(None).cast("long"), "asks": F.lit(0)})
    asking = asked.join(blocks, tree).withColumns({"block": F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"), "asks": F.lit(1)})
    columns = [*tree, "block", "asks", "vec_id", "v", "floor"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        last = built = None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)) for c in (*tree, "block", "asks")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                if begin == end:
                    continue
                part = batch.slice(begin, end - begin)
                *key, asks = keys[begin].tolist()
                if key != last:
                    kept, built, last = [], None, key
                if not asks:
                    kept.append(part)
                    continue
                if built is None:
                    ids = np.concatenate([np.asarray(x.column("vec_id"), np.int64) for x in kept]) if kept else np.zeros(0, np.int64)
                    built = MTree(ids, np.concatenate([_matrix(x.column("v"), dim) for x in kept]) if kept else np.zeros((0, dim)))
                    kept = []
                out = []
                for own, q, floor in zip(part.column("vec_id").to_pylist(), _matrix(part.column("v"), dim), part.column("floor").to_pylist(), strict=True):
                    out += [(own, i, s) for s, i in built.search(q, own, k, floor)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 3)], ["query_id", "vec_id", "score"])

    rows = held.select(columns).union(asking.select(columns))
    return rows.repartition(*tree, "block").sortWithinPartitions(*columns[:4]).mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 5, tree_size: int = 16_384, most_pivots: int = 1024, block: int = 20_000) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for each row of ``vectors`` (vec_id, v) where ``is_query``."""
    common = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dim = common["n"] if common else 1
    rows = vectors.where(F.size("v") == dim).select("vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("asks"))
    drawn = rows.orderBy(F.xxhash64(F.lit("pivot"), "vec_id"), "vec_id", "v").limit(min(most_pivots, -(-(common["count"] if common else 1) // tree_size))).collect()
    pivots = np.array([r["v"] for r in drawn], np.int64).reshape(-1, dim) if drawn else np.zeros((1, dim), np.int64)
    placed = materialize(_placed(rows, pivots, dim), "placed")
    balls = {r["pivot"]: (-(-r["n"] // tree_size), r["far"]) for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    parts = placed.sparkSession.createDataFrame([(p, n) for p, (n, _) in balls.items()], "pivot int, parts int")  # most_pivots rows at most
    members = placed.join(F.broadcast(parts), "pivot").withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "vec_id"), "parts").cast("int"))
    queries = members.where("asks").select("vec_id", "v", F.lit(None).cast("long").alias("floor"), "pivot", "part")
    members = members.select("pivot", "part", "vec_id", "v")
    home = materialize(_searched(members, queries, dim, k, block), "home")
    floors = home.groupBy("query_id").agg(F.min("score").alias("floor"), F.count_distinct("vec_id").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "floor")
    reaching = queries.drop("floor").join(floors, "vec_id", "left")
    others = _searched(members, _asked(reaching, pivots, balls, dim), dim, k, block)
    near = home.union(others).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
