"""Ranked lexical search: compressed postings by shard, and document-at-a-time search over them.

Indexing.  A task cuts its documents into shards of a bounded number of bytes.  Within a shard documents are sorted by id
and numbered; each term's postings are the gaps between the numbers of the documents that hold it, and how often each does, in
variable-length bytes.  A row of the index is (shard, term, n_docs, postings); the shard's row without a term holds its
documents' ids and lengths.  Nothing is shuffled to build it, and it is written once.

Search.  The postings of the queries' terms come together by shard.  In a shard, a query's lists are merged document at a time by a
heap of cursors; a bounded heap, keyed score then document id, keeps the k best.  Lists whose greatest scores can't lift a
document above the k-th best any more leave the cursors' heap (rarest terms drive it) and are only looked up.  The
shards' best are merged by rank.  Queries are worked on in blocks, so that a task holds a bounded number of them.

Defined results: a null or empty text has no terms, and is in no result; repeated rows are documents of their own; a null id comes
last among equal scores; terms are compared by their bytes; an empty table gives no rows; extra columns don't matter.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.kernel import Texts, U64, fold_ascii, give_back, mix, texts
from weftgraph.llm.shared import materialize

#: Bytes that stand between terms ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+``: ASCII but for letters and digits.
BETWEEN = np.zeros(256, bool)
BETWEEN[:128] = True
BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Text of a shard; and queries that a task holds at once.
SHARD_BYTES, BLOCK = 8 << 20, 2000
NAMES = ["shard", "term", "n_docs", "postings"]
INDEX = "shard long, term binary, n_docs long, postings binary"


def pack_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, lowest first, the top bit set where more follow; and how many bytes each number has."""
    values = values.astype(U64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= U64(1) << U64(7 * k)
    end = np.cumsum(size)
    which = np.repeat(np.arange(len(values)), size)
    k = np.arange(int(end[-1]) if len(end) else 0) - (end - size)[which]
    out = ((values[which] >> (U64(7) * k.astype(U64))) & U64(127)).astype(np.uint8)
    return out | ((k < size[which] - 1).astype(np.uint8) << 7), size


def unpack_numbers(data: np.ndarray) -> np.ndarray:
    """The numbers that ``pack_numbers`` wrote."""
    last = np.flatnonzero(data < 128)
    if len(last) == len(data):
        return data.astype(np.int64)
    start = np.append(0, last[:-1] + 1)
    k = np.arange(len(data)) - np.repeat(start, last - start + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * k), start) if len(last) else np.zeros(0, np.int64)


def term_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each term: its bytes, eight at a time, each mixed into what came before."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at8 = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    length = ends - starts
    mask = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
    h = mix(length.astype(U64))
    left, at = np.arange(len(starts)), starts
    while len(left):
        rest = ends[left] - at
        h[left] = mix(h[left] ^ (at8[at] & mask[np.minimum(rest, 8)]))
        more = rest > 8
        left, at = left[more], at[more] + 8
    return h


def postings_of(part: Texts, order: np.ndarray) -> tuple[list[bytes], np.ndarray, list[bytes], np.ndarray]:
    """(terms, documents that hold each, packed postings of each, terms of each document) of some texts, numbered in ``order``."""
    part.words(between=BETWEEN)
    data = fold_ascii(part.data)
    starts, ends = part.starts, part.ends
    place = np.empty(part.n, np.int64)
    place[order] = np.arange(part.n)
    per_text = np.diff(part.word_offsets)
    lengths = np.zeros(part.n, np.int64)
    lengths[place] = per_text
    if not len(starts):
        return [], np.zeros(0, np.int64), [], lengths
    doc = np.repeat(place, per_text)
    h = term_keys(data, starts, ends)
    by = np.lexsort((doc, h))
    h, doc = h[by], doc[by]
    head = np.append(True, h[1:] != h[:-1])
    first = by[np.flatnonzero(head)]  # an occurrence of each term
    own = first[np.cumsum(head) - 1]
    if not _same_bytes(data, starts, ends, by, own):  # two terms share a hash: told apart by their bytes
        raw = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        number = {w: i for i, w in enumerate(sorted(set(raw)))}
        h = np.array([number[w] for w in raw])
        doc = np.repeat(place, per_text)
        by = np.lexsort((doc, h))
        h, doc = h[by], doc[by]
        head = np.append(True, h[1:] != h[:-1])
        first = by[np.flatnonzero(head)]
    new = head | np.append(True, doc[1:] != doc[:-1])  # a posting's first occurrence
    at = np.flatnonzero(new)
    times, docs, opens = np.diff(np.append(at, len(doc))), doc[at], head[at]
    gap = docs - np.append(0, docs[:-1])
    gap[opens] = docs[opens]
    many = times > 1
    # a posting is 2 * gap, or 2 * gap + 1 and then how often beyond twice
    values = np.zeros(len(docs) + int(many.sum()), np.int64)
    where = np.arange(len(docs)) + np.cumsum(many) - many
    values[where] = 2 * gap + many
    values[where[many] + 1] = times[many] - 2
    packed, size = pack_numbers(values)
    upto = np.append(0, np.cumsum(size))
    begins = upto[where[opens]]
    blob, edges = packed.tobytes(), np.append(begins, len(packed)).tolist()
    n_docs = np.diff(np.append(np.flatnonzero(opens), len(docs)))
    terms = [data[a:b].tobytes() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    return terms, n_docs, [blob[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], lengths


def _same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Are the terms at ``a`` those at ``b``, byte by byte?"""
    length = ends[a] - starts[a]
    if (length != ends[b] - starts[b]).any():
        return False
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at8 = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    mask = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
    x, y = starts[a], starts[b]
    while len(x):
        if ((at8[x] ^ at8[y]) & mask[np.minimum(length, 8)]).any():
            return False
        more = length > 8
        x, y, length = x[more] + 8, y[more] + 8, length[more] - 8
    return True


def unpack_postings(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(document numbers, how often each) of one term."""
    values = unpack_numbers(np.frombuffer(data, np.uint8))
    odd = values & 1
    if not odd.any():
        return np.cumsum(values >> 1), np.ones(len(values), np.int64)
    at = np.flatnonzero(odd)
    runs = np.flatnonzero(np.append(True, np.diff(at) != 1))
    within = np.arange(len(at)) - np.repeat(runs, np.diff(np.append(runs, len(at))))
    opens = at[within % 2 == 0]  # an odd number tells that a count follows, so in a run of odd ones every second is a count
    is_posting = np.ones(len(values), bool)
    is_posting[opens + 1] = False
    times = np.ones(len(values), np.int64)
    times[opens] = values[opens + 1] + 2
    return np.cumsum(values[is_posting] >> 1), times[is_posting]


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of all rows of ``docs``, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        for part in texts(batches, text, shard_bytes):
            ids = part.rows.column(key).cast(pa.int64())
            known = np.asarray(ids.is_valid())
            ids = np.asarray(ids.fill_null(0))
            order = np.lexsort((ids, ~known))
            terms, n_docs, postings, lengths = postings_of(part, order)
            head = ids[order].astype("<i8").tobytes() + known[order].astype(np.uint8).tobytes() + lengths.astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([None], pa.binary()), pa.array([part.n], pa.int64()), pa.array([head], pa.binary())], NAMES)
            for at in range(0, len(terms), 10_000):
                some = slice(at, at + 10_000)
                cols = [pa.array(np.full(len(terms[some]), shard)), pa.array(terms[some], pa.binary()), pa.array(n_docs[some], pa.int64()), pa.array(postings[some], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, NAMES)
            shard += 1
        give_back()

    return materialize(docs.select(key, text).mapInArrow(run, INDEX), "postings")


def lengths_of(index: DataFrame) -> DataFrame:
    """(docs, terms): documents with a term, and all terms with repeats, of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_head(x, n)[2] for x, n in zip(batch.column("postings").to_pylist(), batch.column("n_docs").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([int((x > 0).sum()) for x in found], pa.int64()), pa.array([int(x.sum()) for x in found], pa.int64())], ["docs", "terms"])

    return index.where("term is null").select("n_docs", "postings").mapInArrow(run, "docs long, terms long")


def _head(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, which are known, terms of each) of a shard's documents."""
    return np.frombuffer(data, "<i8", n), np.frombuffer(data, np.uint8, n, 8 * n) > 0, np.frombuffer(data, "<i8", n, 9 * n)


def best_documents(lists: list[tuple[int, list[int], list[int]]], k: int) -> list[tuple[int, int]]:
    """The k best (score, document number), score descending, number ascending, of lists (greatest score, documents, scores of each).

    Only scores above 0 count.  Documents come in ascending order off the heap of cursors, so that one with the k-th best score comes too late to matter.
    """
    lists = sorted((x for x in lists if x[0] > 0), key=lambda x: x[0])
    bound = np.cumsum([x[0] for x in lists]).tolist()
    docs, scores, sizes = [x[1] for x in lists], [x[2] for x in lists], [len(x[1]) for x in lists]
    at = [0] * len(lists)
    cursors = [(d[0], j) for j, d in enumerate(docs)]
    heapq.heapify(cursors)
    best: list[tuple[int, int]] = []
    least, optional = 0, 0  # lists below ``optional`` can't lift a document above ``least`` by themselves
    while cursors:
        d = cursors[0][0]
        score = 0
        while cursors and cursors[0][0] == d:
            j = cursors[0][1]
            i = at[j]
            score += scores[j][i]
            at[j] = i = i + 1
            if i < sizes[j]:
                heapq.heapreplace(cursors, (docs[j][i], j))
            else:
                heapq.heappop(cursors)
        for j in range(optional - 1, -1, -1):
            if score + bound[j] <= least:
                break
            at[j] = i = bisect_left(docs[j], d, at[j])
            if i < sizes[j] and docs[j][i] == d:
                score += scores[j][i]
        if score > least:
            if len(best) < k:
                heapq.heappush(best, (score, -d))
            else:
                heapq.heapreplace(best, (score, -d))
            if len(best) == k and best[0][0] > least:
                least = best[0][0]
                was = optional
                while optional < len(lists) and bound[optional] <= least:
                    optional += 1
                if optional > was:
                    cursors = [x for x in cursors if x[1] >= optional]
                    heapq.heapify(cursors)
    return [(s, -d) for s, d in sorted(best, reverse=True)]


def term_table(queries: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(key, term): the distinct terms of each query."""
    folded = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return queries.select(key, F.explode(F.array_distinct(F.regexp_extract_all(folded, F.lit(f"({TERM})")))).alias("term")).select(key, F.col("term").cast("binary").alias("term"))


def weight(n: Column, df: Column) -> Column:
    return F.floor(1000 * F.ln((2 * n + 2).cast("double") / (2 * df + 1).cast("double"))).cast("long")


def search(index: DataFrame, queries: DataFrame, k: int = 10, key: str = "item_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(key, rank, doc_id, score): each query's k best documents.

    Of the corpus the driver holds two sums; of the queries one block's terms and weights at a time.  A query's id is a whole number; rows with a null one are left out.
    """
    spark = index.sparkSession
    n, total = (int(x or 0) for x in lengths_of(index).agg(F.sum("docs"), F.sum("terms")).first())
    terms = materialize(term_table(queries.where(F.col(key).isNotNull()), key, text), "terms")
    counts = index.where("term is not null").select("term", "n_docs").join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n_docs").alias("df"))
    weighted = materialize(terms.join(counts, "term").select(F.col(key).cast("long").alias("item"), "term", weight(F.lit(n), F.col("df")).alias("w")).where("w > 0"), "weights")
    found = []
    for low, high in _blocks(spark, weighted, block):
        some = weighted.where(F.col("item").between(low, high))
        found.append(_search_block(index, some, k, n, total))
    if not found:
        return spark.createDataFrame([], f"{key} long, rank int, doc_id long, score long")
    best = found[0]
    for x in found[1:]:
        best = best.union(x)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(key), "rank", "doc_id", "score")


def _blocks(spark: SparkSession, weighted: DataFrame, block: int) -> list[tuple[int, int]]:
    """Ranges of query ids that hold about ``block`` of them each."""
    n = weighted.select(F.approx_count_distinct("item")).first()[0]
    if not n:
        return []
    parts = -(-n // block)
    edges = weighted.select("item").distinct().agg(F.percentile_approx("item", [(i + 1) / parts for i in range(parts)], 10_000)).first()[0]
    edges = sorted({*edges[:-1], 2**63 - 1})
    return list(zip([-(2**63), *(e + 1 for e in edges[:-1])], edges, strict=True))


def _search_block(index: DataFrame, weighted: DataFrame, k: int, n: int, total: int) -> DataFrame:
    """(item, doc_id, score): each shard's best for the queries of a block."""
    rows = weighted.collect()  # a block of queries
    weights = {bytes(r["term"]): r["w"] for r in rows}
    items: dict[int, list[bytes]] = {}
    for r in rows:
        items.setdefault(r["item"], []).append(bytes(r["term"]))
    sent = index.sparkSession.sparkContext.broadcast((weights, items))

    def run(table: pa.Table) -> pa.Table:
        weights, items = sent.value
        terms, sizes, data = table.column("term").to_pylist(), table.column("n_docs").to_pylist(), table.column("postings")
        at = terms.index(None)
        ids, known, lengths = _head(data[at].as_py(), sizes[at])
        m = 10 + (90 * lengths * n) // max(total, 1)
        lists = {}
        for i, term in enumerate(terms):
            if term is not None:
                docs, times = unpack_postings(data[i].as_py())
                scores = weights[term] * ((1_000_000_000 * times) // (1000 * times + 8 * m[docs]))
                lists[term] = (int(scores.max()), docs.tolist(), scores.tolist())
        out: list[tuple[int, int | None, int]] = []
        for item, own in items.items():
            best = best_documents([lists[t] for t in own if t in lists], k)
            out += [(item, int(ids[d]) if known[d] else None, s) for s, d in best]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], []))], ["item", "doc_id", "score"])

    needed = F.broadcast(weighted.select("term").distinct())  # the terms of a block of queries
    matched = index.join(needed, "term", "left_semi").select(*index.columns).union(index.where("term is null"))
    return matched.groupBy("shard").applyInArrow(run, "item long, doc_id long, score long")
