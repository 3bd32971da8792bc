"""Near-duplicate classes: an exact Jaccard join of word n-gram sets.

Exact, without a cap, in four steps:

1. Every text becomes a set of n-gram hashes; equal sets are one from here on (``fp``, its fingerprint).
2. Candidates come from size-banded tiles.  A band covers sizes [L, R]; two similar sets always
   share a band, and there they differ in k = 2 R (1 - t) / (1 + t) elements at most.  The hash
   range is cut into m > k slices, so at least m - k slices have equal content in both sets.  A set
   sends the hash of each slice's content; sets that agree in one slice are candidates.
   Empty slices say nothing and aren't sent: a set with fewer than m - k of them is sure to
   agree with any similar set in another slice.  A set with more (rare) is sliced again by other
   hash functions, and after the last it sends its empty slices too.
3. Each set has a bitmap of the parities of its hashed elements: the bits in which two differ bound from below the
   elements in which the sets differ, and so the overlap from above.  All sets that agree in a slice meet in the
   block of the least of them; within a block, bitmaps that allow the threshold are joined.  A large block is dealt to
   parts of a bounded size, and every two parts meet in a task of their own.
   Components of these are groups, in which texts that merely share a passage don't meet.
   A group's texts form tiles of similar sizes, a bounded number of elements each; within tiles, and between
   those of similar sizes, what the bitmaps allow is settled by intersecting the sorted arrays.
   Pairs that earlier links already join aren't looked at again, unless all links are asked for.
4. The links' components, spread to equal sets.

Defined results: A-Z is folded, nothing else; null, empty and wordless texts have the empty set, size 0, and are linked with
nothing; a text with fewer words than n has one element, its whole sequence; repeated rows are equal sets; a null id
takes part with its text but can't name a class unless all ids of its class are null; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.kernel import U64, PrefixHash, Texts, as_long, fold_ascii, mix, texts
from weftgraph.llm.shared import connected_components, materialize, release

SALTS = 4
MOST_BITS = 1 << 12
BAND = 1.6  # sizes in a band: R / L


def ngram_sets(part: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, end to end, and where each text's begin."""
    h = part.word_hashes(fold_ascii(part.data))
    values, count = PrefixHash(h), np.diff(part.word_offsets)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(part.n), grams)
    start = part.word_offsets[:-1][doc] + np.arange(len(doc)) - (np.cumsum(grams) - grams)[doc]
    out = values.of(start, np.minimum(start + n, part.word_offsets[1:][doc]))
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    if len(out):
        new = np.append(True, (out[1:] != out[:-1]) | (doc[1:] != doc[:-1]))
        out, doc = out[new], doc[new]
    return out, np.searchsorted(doc, np.arange(part.n + 1))


def fingerprints(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.append(U64(0), np.cumsum(mix(sets ^ U64(0x5851F42D4C957F2D)), dtype=U64))
    return mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(U64) * U64(0x14057B7EF767814F))


def bands(t: Fraction, largest: int) -> list[tuple[int, int, int, int]]:
    """(L, R, k, m) of all size bands that a set of ``largest`` or fewer is in; sets below the first can only be similar when equal."""
    out: list[tuple[int, int, int, int]] = []
    apart = (1 - t) / (1 + t)
    right = 1
    while int(2 * (right + 1) * apart) == 0:
        right += 1
    while (left := int(t * right) + 1) <= largest:
        right = max(right + 1, int(left * BAND))
        k = int(2 * right * apart)
        out.append((left, right, k, k + 1 + -(-3 * k // 20)))
    return out


def slice_hashes(sets: np.ndarray, offsets: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(set number, hash of band, slice and content) of all that the sets send."""
    size = np.diff(offsets)
    who: list[np.ndarray] = []
    what: list[np.ndarray] = []
    for band, (left, right, k, m) in enumerate(bands(t, int(size.max(initial=0)))):
        left_over = np.flatnonzero((size >= left) & (size <= right))
        for salt in range(SALTS):
            if not len(left_over):
                break
            count = size[left_over]
            row = np.repeat(np.arange(len(left_over)), count)
            x = sets[offsets[:-1][left_over][row] + np.arange(len(row)) - (np.cumsum(count) - count)[row]]
            if salt:
                x = mix(x ^ U64(0x9E3779B97F4A7C15 * salt % 2**64))
            place = row * m + ((x >> U64(32)) * U64(m) >> U64(32)).astype(np.int64)
            if salt:
                order = np.argsort(place, kind="stable")
                x, place = x[order], place[order]
            edge = np.searchsorted(place, np.arange(len(left_over) * m + 1))
            sums = np.append(U64(0), np.cumsum(mix(x + U64(0xA0761D6478BD642F)), dtype=U64))
            filled = np.diff(edge)
            empty = (filled == 0).reshape(-1, m).sum(1)
            lacking = empty >= m - k
            send = np.flatnonzero(filled > 0) if salt < SALTS - 1 else np.flatnonzero((filled > 0) | np.repeat(lacking, m))
            content = sums[edge[send + 1]] - sums[edge[send]] + filled[send].astype(U64)
            tag = ((band * SALTS + salt) * (m + 1) + send % m).astype(U64) + U64(1)
            who.append(left_over[send // m])
            what.append(mix(content ^ mix(tag * U64(0xE7037ED1A0B428DB) + U64(band))))
            left_over = left_over[lacking]
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    return np.concatenate(who), np.concatenate(what)


def parity_bitmap(elements: np.ndarray) -> bytes:
    """Parities of the elements by their low bits: about as many bits as elements, a power of two from 64 to ``MOST_BITS``."""
    width = 64
    while width < min(len(elements), MOST_BITS):
        width *= 2
    return np.packbits((np.bincount((elements & U64(width - 1)).astype(np.int64), minlength=width) & 1).astype(bool), bitorder="little").tobytes()


def same_width(bitmaps: list[bytes], width: int | None = None) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, all folded (half upon half) to the width of the least."""
    width = width or min(map(len, bitmaps))
    out = np.empty((len(bitmaps), width // 8), U64)
    for i, b in enumerate(bitmaps):
        x = np.frombuffer(b, U64)
        while len(x) > width // 8:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[i] = x
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_key, doc_id, text): repeated rows have one key."""
    return docs.select(F.xxhash64("doc_id", "text").alias("doc_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def measured(docs: DataFrame, n: int) -> DataFrame:
    """(doc_key, doc_id, n_shingles, fp, bitmap) of every row."""
    names = ["doc_key", "doc_id", "n_shingles", "fp", "bitmap"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in texts(batches):
            sets, offsets = ngram_sets(part, n)
            bitmaps = [parity_bitmap(sets[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.rows.column("doc_key"), part.rows.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(as_long(fingerprints(sets, offsets))), pa.array(bitmaps, pa.binary())], names)

    return keyed(docs).mapInArrow(run, "doc_key long, doc_id long, n_shingles long, fp long, bitmap binary")


def agreeing(docs: DataFrame, n: int, t: Fraction, remember: int = 200_000) -> DataFrame:
    """(a, b): fingerprints that agree in a slice, each with the least one of the slice's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # equal sets of a task send once, as far as it remembers
        for part in texts(batches):
            sets, offsets = ngram_sets(part, n)
            fp = as_long(fingerprints(sets, offsets))
            fresh = np.zeros(part.n, bool)
            if len(sent) > remember:
                sent.clear()
            for i, f in enumerate(fp.tolist()):
                if f not in sent:
                    sent.add(f)
                    fresh[i] = True
            who, what = slice_hashes(sets, offsets, t)
            keep = fresh[who]
            yield pa.RecordBatch.from_arrays([pa.array(as_long(what[keep])), pa.array(fp[who[keep]])], ["slice", "fp"])

    rows = docs.select("text").mapInArrow(run, "slice long, fp long")
    least = rows.withColumn("low", F.min("fp").over(Window.partitionBy("slice")))
    return least.where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def joinable(size: np.ndarray, bitmap: np.ndarray, t: Fraction, settle: Callable[[int, int], bool] | None = None, side: np.ndarray | None = None, every: bool = False) -> list[tuple[int, int]]:
    """Pairs of rows (in order of ``size``) whose bitmaps allow a similarity of ``t`` and that ``settle`` confirms.

    Only a spanning forest of them, unless ``every``: rows that pairs already join aren't compared again.
    ``side``: 0, or rows of 1 are paired with rows of 2 only.
    """
    top, bottom = t.numerator, t.denominator
    begin = np.searchsorted(size * bottom, size * top, "left")  # bottom * a >= top * b
    root, parts, out = np.arange(len(size)), len(size), []
    for i in range(1, len(size)):
        for low in (max(int(begin[i]), i - 8), int(begin[i])):  # neighbours in size first: copies mostly are
            if low >= i or (not every and parts == len(size) - i):
                continue  # all before are joined with this one
            total = size[low:i] + size[i]
            apart = np.bitwise_count(bitmap[low:i] ^ bitmap[i]).sum(1, dtype=np.int64)
            # overlap <= (total - apart) / 2; similar: (bottom + top) * overlap >= top * total
            able = (bottom + top) * (total - apart) >= 2 * top * total
            if side is not None and side[i]:
                able &= side[low:i] != side[i]
            if every:
                able &= low == begin[i]
            else:
                able &= root[low:i] != root[i]
            for j in (np.flatnonzero(able)[::-1] + low).tolist():
                if not every and root[j] == root[i]:
                    continue
                if settle is None or settle(i, j):
                    out.append((i, j))
                    if not every:
                        root[root == root[j]] = root[i]
                        parts -= 1
            if every and low == begin[i]:
                break
    return out


def crowded(rows: DataFrame, key: str, most: int) -> DataFrame:
    """``rows`` (fp, ``key``, ...) with i, j and side: the part of its group, or the two parts, that a row is compared in.

    A group of more than ``most`` rows is dealt to parts of about ``most``, by hash, and every two parts meet once:
    side 0 is compared with all of its part, 1 with 2 only.
    """
    parts = rows.groupBy(key).agg(F.count("*").alias("count")).where(F.col("count") > most).select(key, F.ceil(F.col("count") / most).cast("int").alias("parts"))
    dealt = rows.join(materialize(parts, "parts"), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64(F.lit(17), "fp"), "parts").cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return met.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": side}).drop("parts", "own", "other")


def compatible(agreed: DataFrame, sizes: DataFrame, t: Fraction, most: int = 8192) -> DataFrame:
    """(a, b): fingerprints of a block (all that agree with its least one) whose bitmaps allow the threshold; a forest of each part's of a block."""
    one = sizes.groupBy("fp").agg(F.max("n_shingles").alias("n"), F.max("bitmap").alias("bitmap"))
    rows = agreed.select(F.col("a").alias("fp"), F.col("b").alias("block")).union(agreed.select("b", F.col("b").alias("block")).distinct())
    placed = crowded(rows, "block", most).join(one, "fp").select("block", "i", "j", "side", "fp", "n", "bitmap")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def close() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            held.clear()
            if len(rows) > 1:
                ids, size, side = (np.asarray(rows.column(c).combine_chunks()).astype(np.int64) for c in ("fp", "n", "side"))
                found = np.array(joinable(size, same_width(rows.column("bitmap").to_pylist()), t, side=side), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids[found[:, x]]) for x in (0, 1)], ["a", "b"])

        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("block", "i", "j")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                if begin == end:
                    continue
                if (key := tuple(keys[begin].tolist())) != last and held:
                    yield from close()
                last = key
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from close()

    return placed.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "n", "fp").mapInArrow(run, "a long, b long").distinct()


def set_links(docs: DataFrame, sizes: DataFrame, n: int, t: Fraction, every: bool = False, tile: int = 1_000_000, most: int = 8192) -> DataFrame:
    """(a, b, overlap, union): links between different sets, by their fingerprints; a spanning forest of them unless ``every``.

    ``sizes``: what ``measured`` gives, without empty sets.  ``tile``: about the elements in a tile, but for single larger sets.
    """
    agreed = materialize(agreeing(docs, n, t), "agreeing")
    release(docs.sparkSession)  # the slices' shuffle is the largest
    near_maps = materialize(compatible(agreed, sizes, t, most), "compatible")
    release(docs.sparkSession)
    groups = connected_components(near_maps)
    members = sizes.groupBy("fp", "n_shingles").agg(F.min("doc_key").alias("doc_key")).join(groups.withColumnRenamed("id", "fp"), "fp")
    members = materialize(members, "members")
    # tiles in order of size: from sums over equal sizes, of which large ones are dealt to several tiles by hash
    sums = members.groupBy("component", "n_shingles").agg(F.sum("n_shingles").alias("total"))
    before = F.sum("total").over(Window.partitionBy("component").orderBy("n_shingles")) - F.col("total")
    first = sums.select("component", "n_shingles", F.floor(before / tile).cast("int").alias("first"), F.ceil(F.col("total") / tile).cast("int").alias("over"))
    tiled = members.join(first, ["component", "n_shingles"]).withColumn("tile", (F.col("first") + F.pmod(F.xxhash64("fp"), "over")).cast("int")).drop("first", "over")
    ranges = tiled.groupBy("component", "tile").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    left, right = ranges.alias("l"), ranges.alias("r")
    near = (F.col("l.component") == F.col("r.component")) & (F.col("l.tile") <= F.col("r.tile")) & (t.denominator * F.col("l.high") >= t.numerator * F.col("r.low")) & (t.denominator * F.col("r.high") >= t.numerator * F.col("l.low"))
    pairs = left.join(right, near).select(F.col("l.component").alias("component"), F.col("l.tile").alias("i"), F.col("r.tile").alias("j"))
    one = pairs.where("i = j").select("component", "i", "j", F.col("i").alias("tile"), F.lit(0).alias("side"))
    two = pairs.where("i < j").select("component", "i", "j", F.explode(F.array(F.struct(F.col("i").alias("tile"), F.lit(1).alias("side")), F.struct(F.col("j").alias("tile"), F.lit(2).alias("side")))).alias("x")).select("component", "i", "j", "x.*")
    placed = tiled.join(one.union(two), ["component", "tile"]).select("component", "i", "j", "side", "doc_key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, int]] = {}
        last = None

        def close() -> pa.RecordBatch:
            rows = sorted(held.items(), key=lambda r: (len(r[1][0]), r[0]))
            sets = [x for _, (x, _) in rows]
            overlap: dict[tuple[int, int], int] = {}

            def similar(i: int, j: int) -> bool:
                both = overlap[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                return t.denominator * both >= t.numerator * (len(sets[i]) + len(sets[j]) - both)

            found = joinable(np.array([len(x) for x in sets]), same_width([parity_bitmap(x) for x in sets]), t, similar, np.array([y for _, (_, y) in rows]), every)
            out = [(rows[i][0], rows[j][0], overlap[i, j], len(sets[i]) + len(sets[j]) - overlap[i, j]) for i, j in found]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], ["a", "b", "overlap", "union"])

        for part in texts(batches):
            sets, offsets = ngram_sets(part, n)
            fp = as_long(fingerprints(sets, offsets)).tolist()
            columns = [part.rows.column(c).to_pylist() for c in ("component", "i", "j", "side", "fp")]
            for k, (c, i, j, side, wanted) in enumerate(zip(*columns, strict=True)):
                if (c, i, j) != last:
                    if len(held) > 1:
                        yield close()
                    held.clear()
                    last = (c, i, j)
                if fp[k] == wanted:
                    held[wanted] = sets[offsets[k] : offsets[k + 1]].copy(), side
        if len(held) > 1:
            yield close()

    rows = keyed(docs).select("doc_key", "text").join(placed, "doc_key")
    tiles = rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "doc_key")
    return tiles.mapInArrow(run, "a long, b long, overlap long, union long")


def links(docs: DataFrame, sizes: DataFrame, n: int, t: Fraction, every: bool = False, tile: int = 1_000_000) -> DataFrame:
    """(a, b, overlap, union): links between the least ids of different sets (null: a set without ids)."""
    found = set_links(docs, sizes, n, t, every, tile)
    least = sizes.groupBy("fp").agg(F.min("doc_id").alias("id"))
    named = found.join(least.select(F.col("fp").alias("a"), F.col("id").alias("a_id")), "a").join(least.select(F.col("fp").alias("b"), F.col("id").alias("b_id")), "b")
    return named.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "overlap", "union")


def near_duplicates(docs: DataFrame, n: int = 5, threshold: str = "0.8", most: int = 8192) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text): the least id reachable by links.

    ``most``: sets of a block that are compared in one part; parts of larger blocks meet two by two.
    """
    t = Fraction(threshold)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = materialize(measured(docs, n), "sizes")
    full = sizes.where("n_shingles > 0")
    linked = materialize(set_links(docs, full, n, t, most=most), "links")
    release(docs.sparkSession)
    classes = materialize(connected_components(linked).withColumnRenamed("id", "fp"), "classes")
    least = full.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = classes.join(least, "fp").groupBy("component").agg(F.min("least").alias("component_id"))
    named = least.join(classes.join(named, "component"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    named = materialize(named, "named")  # so that the join can deal out a set that many rows have
    return full.join(named, "fp").select("doc_id", "n_shingles", "component_id").union(sizes.where("n_shingles = 0").select("doc_id", "n_shingles", "doc_id"))
