"""The shortest cycle through every arc, from many sources at once: bits in numpy, over arcs that Spark deals out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.numbering import numbered
from weftgraph.scratch import settle, settle_counted

SIDE = 1 << 12  # nodes of components that are searched together; larger ones are cut into blocks of sources
DENSE = 1 << 20  # arcs from which a smaller component is cut into blocks as well
BITS = 1 << 29  # nodes times sources of a block
CHUNK = 1 << 14  # arcs in a row of packed ones
PAIRS = 1 << 20  # arcs times paths that are looked at together
FOUND = "scc_id long, path array<long>"
_ARROW = pa.schema([("scc_id", pa.int64()), ("path", pa.list_(pa.int64()))])


class Block:
    """Some sources of one component, or all nodes of small ones; ``rows`` and ``sources`` are ranges of node numbers.

    All arcs are given to ``take``, in any number of parts, then ``turn`` is called, again and again until it says that all is done.  No arc is kept but those into the
    sources.  A turn outwards finds what is first reached at the next distance; a turn back finds the nodes before, and of those the least.  At which distance
    a source reached a node stands in as many bits as the number of distances has.
    """

    def __init__(self, rows: tuple[int, int], sources: tuple[int, int], lens: list[int]):
        self.lo, self.hi = rows
        self.first, self.last, self.lens = sources[0], sources[1], np.array(sorted(lens), np.int64)
        n, k = self.hi - self.lo, self.last - self.first
        self.words = -(-k // 64)
        each = np.arange(k)
        self.front = np.zeros((n, self.words), np.uint64)
        self.front[each + self.first - self.lo, each >> 6] = np.uint64(1) << (each & 63).astype(np.uint64)
        self.seen, self.planes, self.at = self.front.copy(), [self.front.copy()], [0]  # plane p: bit p of the number of the distance, from 1 on
        self.onward = np.zeros((n, -(-len(lens) // 64)), np.uint64)  # the lengths of a node's arcs
        self.phase, self.closing, self.next = "start", [], {0}
        self.parents = tuple(np.zeros(0, np.int64) for _ in range(3))  # key, node before, its pred

    def take(self, a: np.ndarray, b: np.ndarray, pred: np.ndarray, length: np.ndarray, scc: tuple[np.ndarray, np.ndarray]) -> None:
        """Arcs by b, then pred; ``scc``: where a component begins among them, and which."""
        x, y = np.searchsorted(b, (self.lo, self.hi))
        a, b, pred, length = a[x:y].astype(np.int64) - self.lo, b[x:y].astype(np.int64) - self.lo, pred[x:y], length[x:y].astype(np.int64)
        if self.phase == "start":
            u, v = np.searchsorted(b, (self.first - self.lo, self.last - self.lo))
            of = scc[1][np.searchsorted(scc[0], np.arange(x + u, x + v), "right") - 1]
            self.closing.append((a[u:v], b[u:v] - (self.first - self.lo), pred[u:v], of))
            nth = np.searchsorted(self.lens, length)
            np.bitwise_or.at(self.onward, (a, nth >> 6), np.uint64(1) << (nth & 63).astype(np.uint64))
        elif self.phase == "out":
            self._spread(a, b, length)
        else:
            self._before(a, b, pred, length)

    def turn(self) -> bool:
        return {"start": self._started, "out": self._spread_all, "back": self._before_all}[self.phase]()

    def _started(self) -> bool:
        self.a, self.s, self.pred, self.scc = (np.concatenate(c) for c in zip(*self.closing, strict=True))
        self.open = np.arange(len(self.a))
        self.phase = "out"
        return self._closed()

    def _closed(self) -> bool:
        """What the last distance closes; then the next one that something can be reached at, or the way back."""
        a, s = self.a[self.open], self.s[self.open]
        self.open = self.open[self.seen[a, s >> 6] >> (s & 63).astype(np.uint64) & np.uint64(1) == 0]
        if len(self.open):
            lens = np.bitwise_or.reduce(self.onward[self.front.any(axis=1)], axis=0) if self.at[-1] in self.next else np.zeros_like(self.onward[0])
            nth = np.arange(len(self.lens))
            self.next |= {self.at[-1] + int(n) for n in self.lens[lens[nth >> 6] >> (nth & 63).astype(np.uint64) & np.uint64(1) > 0]}
            self.next = {d for d in self.next if d > self.distance}
            if not self.next:
                raise RuntimeError("an arc inside a component has no way back")
            self.distance = min(self.next)
            self.new = np.zeros_like(self.front)
            self.alive = self.front.any(axis=1)
            return False
        self.phase, self.front, self.seen, self.new = "back", None, None, None
        self.levels = np.array([-1, *self.at])
        return self._ask(self.a, self.s)

    distance = 0

    def _spread(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> None:
        step = max(256, (1 << 21) // (8 * self.words))
        for n in self.lens:
            if self.distance - n not in self.at:
                continue
            number = self.at.index(self.distance - n) + 1
            mine = length == n
            if number == len(self.at):
                mine &= self.alive[a]
            src, dst = a[mine], b[mine]
            for i in range(0, len(src), step):
                rows, to = src[i : i + step], dst[i : i + step]
                bits = self.front[rows] if number == len(self.at) else self._reached(rows, number)
                starts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
                self.new[to[starts]] |= np.bitwise_or.reduceat(bits, starts, axis=0)

    def _reached(self, rows: np.ndarray, number: int) -> np.ndarray:
        out = None
        for p, plane in enumerate(self.planes):
            bits = plane[rows] if number >> p & 1 else ~plane[rows]
            out = bits if out is None else out & bits
        return out

    def _spread_all(self) -> bool:
        self.new &= ~self.seen
        if self.new.any():
            self.at.append(self.distance)
            self.next.add(self.distance)
            while len(self.at) >> len(self.planes):
                self.planes.append(np.zeros_like(self.new))
            for p, plane in enumerate(self.planes):
                if len(self.at) >> p & 1:
                    plane |= self.new
            self.seen |= self.new
            self.front = self.new
        return self._closed()

    def _number(self, node: np.ndarray, s: np.ndarray) -> np.ndarray:
        word, shift = s >> 6, (s & 63).astype(np.uint64)
        return sum((plane[node, word] >> shift & np.uint64(1)).astype(np.int64) << p for p, plane in enumerate(self.planes))

    def _ask(self, node: np.ndarray, s: np.ndarray) -> bool:
        """Asks for the nodes before ``node``, on the ways from ``s``; done, if nothing is to be asked."""
        k = self.last - self.first
        key = np.unique(node[node != s + self.first - self.lo] * k + s[node != s + self.first - self.lo])
        known = self.parents[0]
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        self.key = key[known[at] != key] if len(known) else key
        self.node, self.of = self.key // k, self.key % k
        self.goal = self.levels[self._number(self.node, self.of)]
        self.best, self.via = np.full(len(self.key), np.iinfo(np.int64).max), np.full(len(self.key), -1)
        return not len(self.key)

    def _before(self, a: np.ndarray, b: np.ndarray, pred: np.ndarray, length: np.ndarray) -> None:
        low, high = np.searchsorted(self.node, b), np.searchsorted(self.node, b, "right")
        some = np.flatnonzero(high > low)
        many = (high - low)[some]
        upto = np.cumsum(many)
        x = 0
        while x < len(some):
            y = max(x + 1, int(np.searchsorted(upto, (upto[x - 1] if x else 0) + PAIRS, "right")))
            arcs, n = some[x:y], many[x:y]
            arc = np.repeat(arcs, n)
            ask = np.arange(len(arc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[arcs], n)
            number = self._number(a[arc], self.of[ask])
            hit = (number > 0) & (self.levels[number] + length[arc] == self.goal[ask])
            ask, first = np.unique(ask[hit], return_index=True)  # arcs come by b and pred: the first is the least
            arc = arc[hit][first]
            less = (pred[arc] < self.best[ask]) | (self.via[ask] < 0)
            self.best[ask[less]], self.via[ask[less]] = pred[arc[less]], a[arc[less]]
            x = y

    def _before_all(self) -> bool:
        if (self.via < 0).any():
            raise RuntimeError("a node that was reached has none before it")
        came, s = self.via, self.of
        both = [np.concatenate(c) for c in zip(self.parents, (self.key, self.via, self.best), strict=True)]
        order = np.argsort(both[0], kind="stable")
        self.parents = tuple(c[order] for c in both)
        return self._ask(came, s)

    def cycles(self, part: int = CHUNK) -> Iterator[pa.RecordBatch]:
        """(scc_id, path): for each arc into a source the preds of its cycle's arcs, in order, from the least on."""
        k, (key, via, pred) = self.last - self.first, self.parents
        for i in range(0, len(self.a), part):
            cur, s, scc = self.a[i : i + part].copy(), self.s[i : i + part], self.scc[i : i + part]
            steps, size = [self.pred[i : i + part]], np.ones(len(cur), np.int64)
            while True:
                on = np.flatnonzero(cur != s + self.first - self.lo)
                if not len(on):
                    break
                at = np.searchsorted(key, cur[on] * k + s[on])
                step = np.zeros(len(cur), np.int64)
                step[on] = pred[at]
                cur[on] = via[at]
                size[on] += 1
                steps.append(step)
            whole = np.stack(steps[::-1], axis=1)
            for n in np.unique(size):
                same = whole[size == n][:, len(steps) - n :]
                turned = np.take_along_axis(same, (np.argmin(same, axis=1)[:, None] + np.arange(n)) % n, axis=1)
                ends = pa.array(np.arange(0, turned.size + 1, n), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(scc[size == n]), pa.ListArray.from_arrays(ends, pa.array(turned.ravel()))], schema=_ARROW)


def _packed(arcs: DataFrame) -> DataFrame:
    """Arcs (a, b, pred, len, scc_id; node numbers for a and b) by b and pred, ``CHUNK`` to a row: low and high (of b), and the columns as bytes."""

    def pack(batch: pa.Table) -> pa.RecordBatch:
        a, b, pred, length, scc = (batch.column(c).to_numpy() for c in ("a", "b", "pred", "len", "scc_id"))
        begins = np.flatnonzero(np.concatenate(([True], scc[1:] != scc[:-1])))
        parts = [a.astype(np.int32), b.astype(np.int32), pred.astype(np.int64), length.astype(np.int32), begins.astype(np.int32), scc[begins].astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array([int(b[0])], pa.int64()), pa.array([int(b[-1])], pa.int64()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], ["low", "high", "a", "b", "pred", "len", "begins", "scc"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            while len(batch):
                held.append(batch.slice(0, CHUNK - n))
                n += len(held[-1])
                batch = batch.slice(len(held[-1]))
                if n == CHUNK:
                    yield pack(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield pack(pa.Table.from_batches(held))

    parts = int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = arcs.repartitionByRange(parts, "b", "pred").sortWithinPartitions("b", "pred")
    return settle(dealt.mapInArrow(run, "low long, high long, a binary, b binary, pred binary, len binary, begins binary, scc binary"))


def _in_blocks(arcs: DataFrame, blocks: DataFrame, count: int, lens: list[int]) -> DataFrame:
    """Components in blocks of sources: a task holds a block's bits, and the packed arcs stream by, once a turn.

    The arcs come from a nested-loop join of the block's turns with all arcs, so nothing is shuffled.  There are more turns than any block needs; it stops reading when it is done.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = None, 0
        for batch in batches:
            for row in batch.select(["turn", "row_lo", "row_hi", "src_lo", "src_hi"]).to_pylist():
                if block is None:
                    block = Block((row["row_lo"], row["row_hi"]), (row["src_lo"], row["src_hi"]), lens)
                elif row["turn"] != at:
                    if row["turn"] < at:
                        raise RuntimeError("the turns of a block are out of order")
                    if block.turn():
                        yield from block.cycles()
                        return
                at = row["turn"]
                packed = {c: batch.column(c)[0].as_buffer() for c in ("a", "b", "pred", "len", "begins", "scc")}
                batch = batch.slice(1)
                of = lambda c, t: np.frombuffer(packed[c], t)  # noqa: B023, E731
                block.take(of("a", np.int32), of("b", np.int32), of("pred", np.int64), of("len", np.int32), (of("begins", np.int32), of("scc", np.int64)))
        if block is not None:
            raise RuntimeError("a block has no turn left")

    spark = arcs.sparkSession
    most = 1 << 31  # turns
    turns = spark.range(0, count * most, 1, count).select(F.shiftright("id", 31).alias("block"), F.col("id").bitwiseAND(most - 1).alias("turn"))
    mine = turns.join(F.broadcast(blocks), "block")
    chunks = _packed(arcs).coalesce(1).hint("shuffle_replicate_nl")
    return mine.join(chunks, (F.col("high") >= F.col("row_lo")) & (F.col("low") < F.col("row_hi"))).mapInArrow(run, FOUND)


def _together(arcs: DataFrame, lens: list[int]) -> DataFrame:
    """Small components: those of a window are one group."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("b", "ascending"), ("pred", "ascending")])
        a, b, pred, length, scc = (table.column(c).to_numpy() for c in ("a", "b", "pred", "len", "scc_id"))
        rows = int(min(a.min(), b[0])), int(max(a.max(), b[-1])) + 1
        block, begins = Block(rows, rows, lens), np.flatnonzero(np.concatenate(([True], scc[1:] != scc[:-1])))
        while True:
            block.take(a, b, pred, length, (begins, scc[begins]))
            if block.turn():
                return pa.Table.from_batches(block.cycles(), _ARROW)

    return arcs.groupBy("window").applyInArrow(run, FOUND)


def shortest_ways(arcs: DataFrame, lens: list[int], side: int = SIDE, dense: int = DENSE) -> DataFrame:
    """(scc_id, path): of ``arcs`` (scc_id, a, b, len, pred) the shortest cycle through each, once each, as the preds of its arcs.

    Nodes are numbered by component, so that a component is a range.  A cycle goes from the arc's end back to its start by
    the least pred at every node.  Components below ``side`` nodes and ``dense`` arcs go in windows to a task each; of the others tasks take blocks of sources.
    """
    ends = settle(arcs.select("scc_id", F.explode(F.array("a", "b")).alias("node_id")).distinct())
    nodes = settle(numbered(ends, ["scc_id", "node_id"], "nth"))
    size = arcs.groupBy("scc_id").agg(F.count("*").alias("arcs"))
    groups = settle(nodes.groupBy("scc_id").agg(F.min("nth").alias("row_lo"), (F.max("nth") + 1).alias("row_hi")).join(size, "scc_id").withColumn("n", F.col("row_hi") - F.col("row_lo")))
    small = (F.col("n") < side) & (F.col("arcs") < dense)
    of = nodes.select("node_id", "nth")  # a node is in one component
    placed = arcs.join(of.toDF("a", "a_nth"), "a").join(of.toDF("b", "b_nth"), "b").select("scc_id", F.col("a_nth").alias("a"), F.col("b_nth").alias("b"), "len", "pred")
    windows = groups.where(small).select("scc_id", F.expr(f"row_lo div {side}").alias("window"))
    found = _together(placed.join(windows, "scc_id"), lens)
    k = F.greatest(F.lit(64), F.expr(f"least({BITS} div n, n div 32) div 64 * 64"))
    cut = groups.where(~small).select("scc_id", "row_lo", "row_hi", k.alias("k"))
    blocks, seen = settle_counted(cut.select("row_lo", "row_hi", "k", F.explode(F.expr("sequence(row_lo, row_hi - 1, k)")).alias("src_lo")).withColumn("src_hi", F.least(F.col("src_lo") + F.col("k"), F.col("row_hi"))).drop("k"))
    if not seen["n"]:
        return found
    blocks = settle(numbered(blocks, ["src_lo"], "block"))
    large = settle(placed.join(cut.select("scc_id"), "scc_id", "left_semi"))
    return found.union(_in_blocks(large, blocks, seen["n"], lens))
