"""Removal of long repeated byte strings, by suffix order.

A byte goes when a string of ``width`` bytes that covers it also starts anywhere else in the corpus, the same
text included.  ``repeats`` narrows the corpus to runs of windows whose anchor occurs twice; runs with one
content are settled by count.  For the rest, each shard's runs are put end to end, a separator between
them, and sorted by external induced sorting (``suffix_sort``): a window repeats just when its suffix shares
``width`` bytes with a neighbour in the order.

Defined results: a null text is empty; matches don't cross texts; repeated rows are texts of
their own, so each removes the other's long strings; texts shorter than ``width`` stay whole; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.kernel import texts
from weftgraph.llm.repeats import Unit, contents, covered, joined_spans, runs, shared_runs, shipped, solve, with_key
from weftgraph.llm.shared import materialize
from weftgraph.llm.suffix_sort import suffix_order

SHARD_BYTES = 1 << 20  # contents sorted at once, but for single larger groups
SOLVED = "anchor long, content long, begin int, end int"


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end places of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def solved_batch(table: pa.Table, sizes: np.ndarray, n: np.ndarray, mask: np.ndarray) -> pa.RecordBatch:
    """Runs of marked window starts: ``mask`` is over all rows' items end to end, ``sizes`` items each, of which the first ``n`` are starts."""
    bases = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    mask = mask & (np.arange(len(row)) - bases[row] < n[row])
    begin, end = runs_of(mask)
    # the last item of a row is never a start, so a run lies in one row
    r = row[begin]
    offset = np.asarray(table.column("offset").combine_chunks(), np.int64)[r] - bases[r]
    take = pa.array(r)
    return pa.RecordBatch.from_arrays(
        [table.column("anchor").combine_chunks().take(take), table.column("content").combine_chunks().take(take), pa.array((begin + offset).astype(np.int32)), pa.array((end + offset).astype(np.int32))],
        ["anchor", "content", "begin", "end"],
    )


def suffix_solver(width: int, budget: int = 1 << 22):
    def solver(table: pa.Table) -> Iterator[pa.RecordBatch]:
        items = table.column("items").to_pylist()
        sizes = np.array([len(x) + 1 for x in items])
        flat = np.empty(sizes.sum(), np.int16)
        end = 0
        for x, size in zip(items, sizes.tolist(), strict=True):
            flat[end : end + size - 1] = np.frombuffer(x, np.uint8)
            end += size
            flat[end - 1] = 256
        del items
        order, lcp = suffix_order(flat, width, budget=budget)
        mask = np.zeros(len(flat), bool)
        hit = np.flatnonzero(lcp >= width)
        mask[order[hit]] = mask[order[hit - 1]] = True
        yield solved_batch(table, sizes, np.asarray(table.column("n").combine_chunks(), np.int64), mask)

    return solver


def repeated_spans(docs: DataFrame, width: int, gram: int = 40, most_bytes: int = 32 << 20) -> DataFrame:
    """(doc_key, begin, end): byte spans of the repeated windows of ``docs`` (doc_key, doc_id, text)."""
    unit = Unit(words=False, width=width, gram=min(gram, width))
    shared = shared_runs(runs(docs, unit))
    classes = materialize(contents(shared), "contents")
    whole = shared.where("not mixed").select("doc_key", F.col("start").alias("begin"), (F.col("start") + F.col("n") - 1 + width).alias("end"))
    mixed = shared.where("mixed").join(classes.select("anchor", "content", "copies"), ["anchor", "content"])
    copied = mixed.where("copies > 1").select("doc_key", F.col("start").alias("begin"), (F.col("start") + F.col("n") - 1 + width).alias("end"))
    solved = solve(shipped(docs, classes, unit, most_bytes), suffix_solver(width), SOLVED, SHARD_BYTES)
    single = classes.where("copies = 1").join(solved, ["anchor", "content"])
    looked = single.select("doc_key", (F.col("start") + F.col("begin")).alias("begin"), (F.col("start") + F.col("end") - 1 + width).alias("end"))
    return whole.union(copied).union(looked)


def remove_repeats(docs: DataFrame, width: int = 400, **options: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, begins, ends) of every row of ``docs`` (doc_id, text); kept: the bytes left."""
    keyed = with_key(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in texts(batches):
            gone = covered(part, part.offsets)
            rows = [(gone[a:b], part.data[a:b]) for a, b in zip(part.offsets[:-1], part.offsets[1:], strict=True)]
            spans = [runs_of(g) for g, _ in rows]
            cols = [
                part.rows.column("doc_id"), pa.array([len(g) for g, _ in rows], pa.int64()), pa.array([int(g.sum()) for g, _ in rows], pa.int64()),
                pa.array([len(b) for b, _ in spans], pa.int64()), pa.array([d[~g].tobytes() for g, d in rows], pa.binary()),
                pa.array([b.tolist() for b, _ in spans], pa.list_(pa.int64())), pa.array([e.tolist() for _, e in spans], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "begins", "ends"])

    joined = joined_spans(keyed, repeated_spans(keyed, width, **options))
    return joined.select("doc_id", "text", "begins", "ends").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, begins array<long>, ends array<long>")


