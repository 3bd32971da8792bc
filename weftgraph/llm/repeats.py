"""Where windows of a fixed width repeat across all texts: what the two substring operators share.

Every window start belongs to the run of one anchor (``kernel.owners``), and equal windows have
equal anchors at equal offsets.  So the corpus falls into groups by anchor hash, and no repeat
crosses groups:

* an anchor that occurs once has no repeats; one aggregation with map-side sums finds these;
* where all runs of an anchor have the same content, the hash of that content says all
  (thousands of copies of a text never meet in a task, they are counted);
* only anchors with differing contents are looked into: one run for each content is sent to its
  anchor's shard and solved there.  An anchor whose runs hold more than ``most_bytes`` is sent window
  by window to several shards of about ``most_bytes``, by the window's hash, so that no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.kernel import BYTE_VALUE, PrefixHash, Texts, as_long, owners, texts
from weftgraph.llm.shared import discard, materialize, release


@dataclass(frozen=True)
class Unit:
    """What windows are made of: bytes, or words (by their hashes)."""

    words: bool
    width: int
    gram: int

    def items(self, part: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The items of all texts, end to end, and where each text begins."""
        if self.words:
            return part.word_hashes(), part.word_offsets
        return part.data, part.offsets

    @property
    def size(self) -> int:
        """Bytes of an item."""
        return 8 if self.words else 1

    def hashes(self, items: np.ndarray) -> PrefixHash:
        return PrefixHash(items if self.words else BYTE_VALUE[items])


def with_key(docs: DataFrame) -> DataFrame:
    """(doc_key, doc_id, text): repeated rows have one key."""
    return docs.select(F.xxhash64("doc_id", "text").alias("doc_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def runs(docs: DataFrame, unit: Unit) -> DataFrame:
    """(doc_key, doc_id, start, n, anchor, content) of every run: n windows from ``start`` on, and the hash of what they cover."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in texts(batches):
            items, offsets = unit.items(part)
            values = unit.hashes(items)
            start, n, anchor = owners(values, offsets, unit.width, unit.gram)
            doc = np.searchsorted(offsets, start, "right") - 1
            # texts without items share an offset with the next; the last of them is the owner
            content = values.of(start, start + n - 1 + unit.width)
            take = pa.array(doc)
            cols = [part.rows.column(c).take(take) for c in ("doc_key", "doc_id")]
            cols += [pa.array((start - offsets[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(as_long(anchor)), pa.array(as_long(content))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_key", "doc_id", "start", "n", "anchor", "content"])

    return docs.mapInArrow(find, "doc_key long, doc_id long, start int, n int, anchor long, content long")


def shared_runs(found: DataFrame) -> DataFrame:
    """``runs`` whose anchor occurs twice or more: with mixed (the anchor has differing contents) and first_doc (its least doc_id)."""
    found = materialize(found, "runs")
    anchors = found.groupBy("anchor").agg(F.count("*").alias("c"), F.min("content").alias("low"), F.max("content").alias("high"), F.min("doc_id").alias("first_doc"))
    shared = materialize(anchors.where("c > 1").select("anchor", (F.col("low") != F.col("high")).alias("mixed"), "first_doc"), "anchors")  # so that the join can deal out a hot anchor
    out = materialize(found.join(shared, "anchor"), "shared")
    discard(found)
    release(found.sparkSession)
    return out


def contents(shared: DataFrame) -> DataFrame:
    """For each content of a mixed anchor: copies, first_doc, and one run that has it."""
    return (
        shared.where("mixed")
        .groupBy("anchor", "content")
        .agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"), F.min(F.struct("doc_key", "start", "n")).alias("at"))
        .select("anchor", "content", "copies", "first_doc", "at.*")
    )


def shipped(docs: DataFrame, wanted: DataFrame, unit: Unit, most_bytes: int) -> DataFrame:
    """(anchor, shard, content, first_doc, offset, n, align, items): the items of the wanted runs, ready for their shards."""
    whole, single = F.sum(F.col("n") - 1 + unit.width) * unit.size, F.sum("n") * unit.width * unit.size
    crowded = wanted.groupBy("anchor").agg(whole.alias("whole"), single.alias("single")).where(F.col("whole") > most_bytes).select("anchor", F.ceil(F.col("single") / most_bytes).cast("int").alias("shards"))
    each = wanted.join(crowded, "anchor", "left").groupBy("doc_key").agg(F.collect_list(F.struct("anchor", "content", "first_doc", "start", "n", F.coalesce("shards", F.lit(1)).alias("shards"))).alias("runs"))
    fields = ["anchor", "content", "first_doc", "start", "n", "shards"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in texts(batches):
            items, offsets = unit.items(part)
            values = unit.hashes(items)
            lists = part.rows.column("runs")
            doc = np.repeat(np.arange(part.n), np.diff(np.append(0, np.cumsum([len(x) for x in lists]))))
            flat = lists.flatten()
            anchor, content, first, start, n, shards = (flat.field(f).to_pylist() for f in fields)
            out: list[tuple] = []
            for k, d in enumerate(doc.tolist()):
                begin = int(offsets[d]) + start[k]
                if shards[k] == 1:
                    out.append((anchor[k], 0, content[k], first[k], 0, n[k], start[k], items[begin : begin + n[k] - 1 + unit.width].tobytes()))
                    continue
                at = np.arange(begin, begin + n[k])
                for j, h in enumerate((values.of(at, at + unit.width) % np.uint64(shards[k])).tolist()):
                    out.append((anchor[k], h, content[k], first[k], j, 1, start[k] + j, items[begin + j : begin + j + unit.width].tobytes()))
                    if len(out) >= 4096:
                        yield _shipped_batch(out)
                        out = []
            if out:
                yield _shipped_batch(out)

    joined = docs.select("doc_key", "text").join(each, "doc_key").select("text", "runs")
    return joined.mapInArrow(cut, "anchor long, shard int, content long, first_doc long, offset int, n int, align int, items binary")


def _shipped_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    names = ["anchor", "shard", "content", "first_doc", "offset", "n", "align", "items"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


Solver = Callable[[pa.Table], Iterator[pa.RecordBatch]]


def solve(sent: DataFrame, solver: Solver, schema: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """Runs ``solver`` over whole groups of (anchor, shard), several of them at once up to ``batch_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            keys = list(zip(batch.column("anchor").to_pylist(), batch.column("shard").to_pylist(), strict=True))
            begin = 0
            for i, key in enumerate(keys):
                if key != last and last is not None and size >= batch_bytes:
                    held.append(batch.slice(begin, i - begin))
                    yield from solver(pa.Table.from_batches(held))
                    held, begin, size = [], i, 0
                last = key
                size += len(batch.column("items")[i].as_buffer())
            held.append(batch.slice(begin))
        if held:
            yield from solver(pa.Table.from_batches(held))

    return sent.repartition("anchor", "shard").sortWithinPartitions("anchor", "shard").mapInArrow(run, schema)


def joined_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` (doc_key, doc_id, text) with begins and ends: the windows' spans to remove (null: none)."""
    spans = materialize(spans, "spans")
    release(docs.sparkSession)  # what shipped the runs isn't needed for the rest
    per = spans.groupBy("doc_key").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))  # copies of a row bring the same spans
    return docs.join(per.select("doc_key", F.col("spans.begin").alias("begins"), F.col("spans.end").alias("ends")), "doc_key", "left")


def covered(part: Texts, offsets: np.ndarray) -> np.ndarray:
    """Which items lie in the spans of their text."""
    steps = np.zeros(int(offsets[-1]) + 1, np.int32)
    for name, by in (("begins", 1), ("ends", -1)):
        lists = part.rows.column(name)
        counts = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
        flat = np.asarray(lists.flatten(), np.int64)
        np.add.at(steps, np.repeat(offsets[:-1], counts) + flat, by)
    return np.cumsum(steps[:-1]) > 0
