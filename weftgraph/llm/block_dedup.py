"""Removal of repeated word sequences, by fixed-block anchors.

A word goes when a window of ``width`` consecutive words that covers it also starts in a text with a smaller id.
``repeats`` narrows the corpus to runs of windows whose anchor occurs twice; runs with one content are
settled by the least id that has it.  For the rest, within a shard:

* index: every text's non-overlapping blocks of ``(width + 1) // 2`` words (by their place in the text); a window of ``width`` words
  holds a whole block wherever it lies.  Of blocks that stand in the same surroundings (a window's length to both sides) the one with
  the least id is kept, since what can be said by one of them can be said by this one;
* probe: every rolling window of a block's length, against the blocks of smaller ids;
* extend: each hit grows to both sides, as far as the two texts agree, to the maximal exact repeat; lengths come from hashes of
  word sequences and are confirmed word by word.  Repeats of ``width`` words or more mark the windows that lie in them.

A block that stands in very many surroundings (``most_pairs`` hits times places) isn't compared pair by pair: there, the windows around its hits are looked up
among the windows around its places.

Defined results: a null text has no words; a null id is never smaller or larger, so its text neither removes nor
loses anything; rows with equal ids don't remove each other's words; texts shorter than a window stay whole; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.kernel import PrefixHash, texts, window_starts
from weftgraph.llm.repeats import Unit, contents, covered, joined_spans, runs, shared_runs, shipped, solve, with_key
from weftgraph.llm.shared import materialize
from weftgraph.llm.suffix_dedup import SOLVED, solved_batch

NEVER = np.iinfo(np.int64).max


def common(values: PrefixHash, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
    """How many items, ``most`` at most, agree from places a and b on (``back``: before them), by bisection over hashes."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = values.of(a - mid, a) == values.of(b - mid, b) if back else values.of(a, a + mid) == values.of(b, b + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, end to end."""
    end = np.cumsum(length)
    return np.repeat(start - end + length, length) + np.arange(int(end[-1]) if len(end) else 0)


def block_solver(width: int, most_pairs: int = 1 << 16):
    block = (width + 1) // 2

    def solver(table: pa.Table) -> Iterator[pa.RecordBatch]:
        items = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
        sizes = np.array([len(x) for x in items])
        ends = np.cumsum(sizes)
        offsets = np.append(0, ends)
        flat = np.concatenate(items)
        values = PrefixHash(flat)
        row = np.repeat(np.arange(len(sizes)), sizes)
        ids = np.asarray(table.column("first_doc").combine_chunks().fill_null(NEVER), np.int64)[row]
        place = np.arange(len(row)) - offsets[row] + np.asarray(table.column("align").combine_chunks(), np.int64)[row]
        rolling = window_starts(offsets, block)
        hashes = values.of(rolling, rolling + block)
        # index: aligned blocks, the least id of each in the same surroundings
        whole = np.flatnonzero(place[rolling] % block == 0)
        at, key = rolling[whole], hashes[whole]
        around = values.of(np.maximum(at - width, offsets[row[at]]), np.minimum(at + block + width, ends[row[at]])) + (at - np.maximum(at - width, offsets[row[at]])).astype(np.uint64)
        order = np.lexsort((ids[at], around, key))
        at, key, around = at[order], key[order], around[order]
        first = np.append(True, (key[1:] != key[:-1]) | (around[1:] != around[:-1])) if len(at) else np.zeros(0, bool)
        at, key = at[first], key[first]
        order = np.lexsort((ids[at], key))
        at, key = at[order], key[order]
        # probe: how many places of a block with smaller ids each rolling window hits
        begin, end = np.searchsorted(key, hashes, "left"), np.searchsorted(key, hashes, "right")
        hit = np.flatnonzero(end > begin)
        hit = hit[ids[at[begin[hit]]] < ids[rolling[hit]]]
        starts_there, many, group = begin[hit], end[hit] - begin[hit], hashes[hit]
        mask = np.zeros(len(row), bool)
        if len(hit):
            _, which, times = np.unique(group, return_inverse=True, return_counts=True)
            crowded = times[which] * many > most_pairs
            marks = np.zeros(len(row) + 1, np.int32)
            plain = np.flatnonzero(~crowded)
            step = np.cumsum(many[plain]) // (1 << 20)  # pairs at once
            for part in np.split(plain, np.flatnonzero(np.diff(step)) + 1) if len(plain) else []:
                n = many[part]
                mine, other = np.repeat(rolling[hit[part]], n), at[ranges(starts_there[part], n)]
                smaller = ids[other] < ids[mine]
                mine, other = mine[smaller], other[smaller]
                left = common(values, mine, other, np.minimum(mine - offsets[row[mine]], other - offsets[row[other]]), back=True)
                right = common(values, mine, other, np.minimum(ends[row[mine]] - mine, ends[row[other]] - other))
                long = left + right >= width
                a, b, length = (mine - left)[long], (other - left)[long], (left + right)[long]
                _, once = np.unique(np.stack([a, b]), axis=1, return_index=True)  # a repeat is hit once a block
                a, b, length = a[once], b[once], length[once]
                wrong = flat[ranges(a, length)] != flat[ranges(b, length)]
                if wrong.any():
                    raise ValueError("two word sequences share a hash")
                np.add.at(marks, a, 1)
                np.add.at(marks, a + length - width + 1, -1)
            mask = np.cumsum(marks[:-1]) > 0
            far = np.flatnonzero(crowded)
            if len(far):
                lost = np.zeros(len(key), bool)
                lost[np.unique(ranges(*_distinct(starts_there[far], many[far])))] = True
                mask |= _among_windows(values, offsets, ids, rolling[hit[far]], at[lost], block, width)
        yield solved_batch(table, sizes, np.asarray(table.column("n").combine_chunks(), np.int64), mask)

    return solver


def _distinct(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, first = np.unique(start, return_index=True)
    return start, length[first]


def _around(starts: np.ndarray, places: np.ndarray, block: int, width: int, n: int) -> np.ndarray:
    """Which of ``starts`` begin a window that holds a block at one of ``places``."""
    near = np.zeros(n + 1, np.int32)
    np.add.at(near, np.maximum(places + block - width, 0), 1)
    np.add.at(near, places + 1, -1)
    return (np.cumsum(near[:-1]) > 0)[starts]


def _among_windows(values: PrefixHash, offsets: np.ndarray, ids: np.ndarray, hits: np.ndarray, places: np.ndarray, block: int, width: int) -> np.ndarray:
    """Window starts around ``hits`` whose window also stands, with a smaller id, around one of ``places``."""
    starts = window_starts(offsets, width)
    known, asked = starts[_around(starts, places, block, width, len(ids))], starts[_around(starts, hits, block, width, len(ids))]
    h = values.of(known, known + width)
    order = np.lexsort((ids[known], h))
    h, least = h[order], ids[known][order]
    mask = np.zeros(len(ids), bool)
    if len(h):
        wanted = values.of(asked, asked + width)
        at = np.minimum(np.searchsorted(h, wanted), len(h) - 1)
        mask[asked] = (h[at] == wanted) & (least[at] < ids[asked])
    return mask


def repeated_spans(docs: DataFrame, width: int, gram: int = 8, most_bytes: int = 32 << 20, most_pairs: int = 1 << 16) -> DataFrame:
    """(doc_key, begin, end): word spans of ``docs`` (doc_key, doc_id, text) whose windows a smaller id has."""
    unit = Unit(words=True, width=width, gram=min(gram, width))
    shared = shared_runs(runs(docs, unit))
    classes = materialize(contents(shared), "contents")
    span = (F.col("start").alias("begin"), (F.col("start") + F.col("n") - 1 + width).alias("end"))
    whole = shared.where("not mixed and doc_id > first_doc").select("doc_key", *span)
    mixed = shared.where("mixed").drop("first_doc").join(classes.select("anchor", "content", "first_doc"), ["anchor", "content"])
    later = mixed.where("doc_id > first_doc").select("doc_key", *span)
    solved = solve(shipped(docs, classes, unit, most_bytes), block_solver(width, most_pairs), SOLVED)
    first = mixed.where("doc_id = first_doc").join(solved, ["anchor", "content"])
    looked = first.select("doc_key", (F.col("start") + F.col("begin")).alias("begin"), (F.col("start") + F.col("end") - 1 + width).alias("end"))
    return whole.union(later).union(looked)


def remove_repeats(docs: DataFrame, width: int = 50, **options: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row of ``docs`` (doc_id, text); kept: the words left, joined by one space."""
    keyed = with_key(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in texts(batches):
            part.words()
            gone = covered(part, part.word_offsets)
            per = np.diff(np.append(0, np.cumsum(gone))[part.word_offsets])
            kept = []
            for i, (a, b) in enumerate(zip(part.word_offsets[:-1], part.word_offsets[1:], strict=True)):
                ws = part.data[part.offsets[i] : part.offsets[i + 1]].tobytes().split()
                kept.append(b" ".join(ws if not per[i] else [w for w, g in zip(ws, gone[a:b].tolist(), strict=True) if not g]))
            cols = [part.rows.column("doc_id"), pa.array(np.diff(part.word_offsets), pa.int64()), pa.array(per, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept"])

    joined = joined_spans(keyed, repeated_spans(keyed, width, **options))
    return joined.select("doc_id", "text", "begins", "ends").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
