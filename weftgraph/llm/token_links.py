"""Links between the tokens that two tokenizers make of the same text.

Python only tokenises: texts are cut before spaces (segments), each segment of a slice of texts is encoded once by both tokenizers, and a row
holds the slice's distinct segments (ids of both), the distinct shapes that they have (byte ends of both; ids don't matter to the cuts), and its texts as
numbers of segments.  All that follows is Spark's higher-order functions: of each shape, ``array_intersect`` of the end arrays gives the cuts, and ``sort_array``,
``sequence`` and ``transform`` find each cut's place among either's tokens, and from these which places are linked and in which order groups name them;
``transform`` puts each segment's ids there, and ``aggregate`` sums up over a text's segments.

A pair of ids counts in how many documents hold it linked.  The counts of the commonest pairs (at most ``most_hot``, a bound that is checked) are
broadcast, and each document sums up what it holds of them without a shuffle; all other pairs are joined by shuffle, so none is left out.

Segments are a saving, not a change: neither tokenizer's tokens reach across a cut before a space that follows no white space, which is checked of the
files when they are loaded; where they might, a whole text is one segment.

Defined results: a null or empty text, and one whose tokens' bytes aren't a space and the text, has no tokens: its numbers are zero and its groups
the empty string; repeated rows are documents of their own, each counted; extra columns don't matter; an empty table stays empty.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.kernel import U64, Texts, give_back, texts
from weftgraph.llm.sentencepieces import MARK, PieceModel
from weftgraph.llm.shared import materialize
from weftgraph.llm.word_table import WordTable

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Text of a slice: its segments are encoded and aligned once each.
SLICE_BYTES = 1 << 20
#: How byte-level BPE of this kind splits a text, and the first byte of characters from U+0240 on.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FAR = bytes(range(0xC9, 0x100))
#: Pairs whose counts are broadcast, at most.
MOST_HOT = 250_000


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others, in order, from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE file of the tokenizers library; special tokens' strings are plain text to it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = byte_of()
        added = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        vocabulary = {i: bytes(byte[c] for c in token) for token, i in spec["model"]["vocab"].items() if i not in added} | added
        self.size = max(vocabulary, default=-1) + 1
        self.tokens = [vocabulary.get(i, b"") for i in range(self.size)]
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        steps = spec.get("pre_tokenizer") or {}
        #: its split never puts what follows white space and what stands before it into one token
        self.by_segment = bool(
            spec.get("normalizer") is None and steps.get("type") == "ByteLevel" and steps.get("use_regex", True) and not steps.get("add_prefix_space")
            and all(t.get("special") for t in spec.get("added_tokens", []))
        )

        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"].get("merges", [])]
        ranked = self.by_segment and len(byte) == 256 and all(spec["model"]["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and self.size - len(added) == 256 + len(merges)
        self.fast = None
        if ranked:  # ids ascend as merges do, so another library makes the same tokens, several times faster
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks={t: i for i, t in vocabulary.items() if i not in added}, special_tokens={})

    def encode(self, data: bytes, plain: bool = False) -> list[int]:
        """``plain``: no letters that the libraries' tables of characters may not agree on."""
        if plain and self.fast:
            return self.fast.encode_ordinary(data.decode("utf-8"))
        return self.library.encode_batch_fast([data.decode("utf-8")], add_special_tokens=False)[0].ids


class Pieces:
    """A SentencePiece model as bytes: U+2581 is a space, a byte piece its byte."""

    def __init__(self, path: str):
        model = PieceModel(path)
        self.library = library = model.library
        self.size = library.get_piece_size()
        self.tokens = [bytes([int(library.id_to_piece(i)[3:5], 16)]) if library.is_byte(i) else library.id_to_piece(i).replace(MARK, " ").encode() for i in range(self.size)]
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.by_segment = model.by_segment
        #: the library makes nothing of an empty text, not even its space, which stands before a line feed's byte piece
        self.lone = len(library.encode("\n")) - 1

    def encode(self, data: bytes, plain: bool = False) -> list[int]:
        """Of a text that begins with a space: the one that the library adds."""
        return self.library.encode(data[1:].decode("utf-8"), num_threads=1) if len(data) > 1 else self.library.encode("\n")[: self.lone]


class Aligner:
    """Both tokenizers, and what they made of the segments seen lately."""

    _made: dict[tuple[str, str], Aligner] = {}

    def __init__(self, first: str, second: str):
        self.pair = ByteLevel(first), Pieces(second)
        self.by_segment = all(t.by_segment for t in self.pair)
        self.table = WordTable(self._number, bits=19)
        self._forget()

    @classmethod
    def shared(cls, first: str, second: str) -> Aligner:
        """One for each worker process and pair of files."""
        if (first, second) not in cls._made:
            cls._made[first, second] = cls(first, second)
        return cls._made[first, second]

    def _forget(self) -> None:
        self.good: list[np.ndarray] = []
        self.ids: list[list[np.ndarray]] = [[], []]
        self.ends: list[list[np.ndarray]] = [[], []]
        self.counts: list[list[np.ndarray]] = [[], []]
        self.numbered = 0

    def _number(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the table: each new segment's number stands for it; its tokens are kept aside.

        Segments go to the libraries end to end, some thousand bytes at once, and the tokens are told apart by their bytes.  A run whose tokens
        don't end where its segments do is halved: where a segment ends in white space, or the library makes other bytes of it.
        """
        good = np.zeros(len(segments), bool)
        found: list[tuple[list[np.ndarray], ...]] = [([], [], []), ([], [], [])]
        none = np.zeros(0, np.int32)
        most = 2048 if self.by_segment else 1
        runs = [(i, min(i + most, len(segments))) for i in range(0, len(segments), most)][::-1]
        while runs:
            low, high = runs.pop()
            done = self._encoded(segments[low:high])
            if done is None and high - low > 1:  # what went wrong is in one half, or where they meet
                runs += [((low + high) // 2, high), (low, (low + high) // 2)]
                continue
            good[low:high] = done is not None
            for side in (0, 1):
                for kept, x in zip(found[side], done[side] if done else (none, none, np.zeros(1, np.int64)), strict=True):
                    kept.append(x)
        for side in (0, 1):
            for pool, new in zip((self.ids, self.ends, self.counts), found[side], strict=True):
                pool[side] += new
        self.good.append(good)
        numbers = np.arange(self.numbered, self.numbered + len(segments))
        self.numbered += len(segments)
        return numbers.astype(np.int32), np.arange(len(segments)), np.ones(len(segments), np.int64)

    def _encoded(self, segments: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None:
        """Each tokenizer's (ids, ends within their segment, tokens of each segment); None if tokens don't spell the segments and end with them."""
        data = b"".join(segments)
        close = np.cumsum([len(s) for s in segments])
        plain = len(data.translate(None, FAR)) == len(data)
        out = []
        for tokenizer in self.pair:
            ids = np.array(tokenizer.encode(data, plain), np.int32)
            if b"".join(map(tokenizer.tokens.__getitem__, ids.tolist())) != data:
                return None
            ends = np.cumsum(tokenizer.sizes[ids])
            last = np.searchsorted(ends, close)
            if (ends[last] != close).any():
                return None
            count = np.diff(np.append(-1, last))
            begin = np.append(0, close[:-1])
            out.append((ids, (ends - np.repeat(begin, count)).astype(np.int32), count))
        return out

    def __call__(self, part: Texts) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """([a ids, a ends, a counts, b ids, b ends, b counts] of the segments that occur, segments of each text end to end, how many each text has).

        A text without tokens has no segments.
        """
        if self.numbered > 1 << 19 or self.table.words > 1 << 18:
            self.table.clear()
        if self.table.words == 0 and not self.table.long:
            self._forget()
        some = np.diff(part.offsets) > 0
        data = np.insert(part.data, part.offsets[:-1][some], 32)  # the space before each text
        offsets = part.offsets + np.append(0, np.cumsum(some))
        opens = np.zeros(len(data), bool)
        opens[offsets[:-1][some]] = True
        if self.by_segment:
            opens |= cuts_before_spaces(data)
        starts = np.flatnonzero(opens)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        number = self.table.ids(*self.table.look_up(data, starts, ends))
        edges = np.searchsorted(starts, offsets)
        good = np.concatenate(self.good)[number] if self.good else np.zeros(0, bool)
        bad = np.append(0, np.cumsum(~good))
        whole = bad[edges[1:]] == bad[edges[:-1]]  # texts all of whose segments are theirs
        size = np.where(whole, np.diff(edges), 0)
        number = number[np.repeat(whole, np.diff(edges))]
        used, place = np.unique(number, return_inverse=True)
        out = []
        for side in (0, 1):
            ids, ends_, counts = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (self.ids[side], self.ends[side], self.counts[side]))
            self.ids[side], self.ends[side], self.counts[side] = [ids], [ends_], [counts]
            n = counts[used]
            at = (np.cumsum(counts) - counts)[used]
            pick = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out += [ids[pick], ends_[pick], n]
        self.good = [np.concatenate(self.good)] if self.good else []
        return out, place.astype(np.int32), size


def cuts_before_spaces(data: np.ndarray) -> np.ndarray:
    """Where a space stands after what is surely no white space of any kind."""
    at = np.flatnonzero(data == 32)
    a, b, c = (np.where(at >= k, data[np.maximum(at - k, 0)], 0) for k in (3, 2, 1))
    two = (b == 0xC2) & ((c == 0x85) | (c == 0xA0))
    three = ((a == 0xE1) & (((b == 0x9A) & (c == 0x80)) | ((b == 0xA0) & (c == 0x8E)))) | ((a == 0xE2) & (((b == 0x80) & ((c <= 0x8D) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    out = np.zeros(len(data), bool)
    out[at] = (c > 32) & (c != 127) & ~two & ~three
    return out


def _nested(values: list[tuple[np.ndarray, np.ndarray]], names: list[str]) -> pa.StructArray:
    """A struct of lists: (values end to end, how many each)."""
    lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(v, pa.int32())) for v, n in values]
    return pa.StructArray.from_arrays(lists, names)


def _list(of: T.DataType) -> T.ArrayType:
    """Without nulls: Spark has faster code for such lists."""
    return T.ArrayType(of, containsNull=False)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable=name == "doc_id") for name, kind in fields.items()])


INTS = _list(T.IntegerType())
#: ids: a's, then b's
SLICES = _struct(
    shapes=_list(_struct(a_ends=INTS, b_ends=INTS)),
    segments=_list(_struct(shape=T.IntegerType(), ids=INTS)),
    docs=_list(_struct(doc_id=T.LongType(), n_a=T.LongType(), n_b=T.LongType(), at=INTS)),
)


def picked(values: np.ndarray, n: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Of lists end to end, ``n`` values each: those at the places ``which``."""
    at, size = (np.cumsum(n) - n)[which], n[which]
    return values[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def shapes(a_ends: np.ndarray, a_n: np.ndarray, b_ends: np.ndarray, b_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a segment of each shape, the shape of each segment).  Ends within 64 bytes are the bits of a number; a longer segment is a shape of its own."""
    if not len(a_n):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    masks = [np.add.reduceat(U64(1) << ((ends - 1) & 63).astype(U64), np.cumsum(n) - n) for ends, n in ((a_ends, a_n), (b_ends, b_n))]
    a, b = (np.unique(m, return_inverse=True)[1].astype(np.int64) for m in masks)
    both = a * (b.max() + 1) + b
    long = np.flatnonzero(a_ends[np.cumsum(a_n) - 1] > 64)
    both[long] = -1 - long
    return np.unique(both, return_index=True, return_inverse=True)[1:]


def tokenize(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """A row a slice of texts: the tokens of its segments, their shapes, and its texts as segments.  The only Python of this operator."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = Aligner.shared(first, second)
        for part in texts(batches, text, slice_bytes):
            (a_ids, a_ends, a_n, b_ids, b_ends, b_n), place, size = align(part)
            one, shape = shapes(a_ends, a_n, b_ends, b_n)
            forms = _nested([(picked(ends, n, one), n[one]) for ends, n in ((a_ends, a_n), (b_ends, b_n))], ["a_ends", "b_ends"])
            ids, both = np.zeros(len(a_ids) + len(b_ids), np.int32), a_n + b_n
            of_a = np.arange(len(ids)) - np.repeat(np.cumsum(both) - both, both) < np.repeat(a_n, both)
            ids[of_a], ids[~of_a] = a_ids, b_ids
            segments = pa.StructArray.from_arrays([pa.array(shape, pa.int32()), _nested([(ids, both)], ["ids"]).field(0)], ["shape", "ids"])
            edges = np.append(0, np.cumsum(size))
            n_a, n_b = (np.diff(np.append(0, np.cumsum(n[place]))[edges]) for n in (a_n, b_n))
            at = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(place, pa.int32()))
            rows = pa.StructArray.from_arrays([part.rows.column(key).cast(pa.int64()), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), at], ["doc_id", "n_a", "n_b", "at"])
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (forms, segments, rows)], ["shapes", "segments", "docs"])
        give_back()

    return docs.select(F.col(key).alias(key), F.col(text).alias(text)).mapInArrow(run, SLICES)


def _both(ends: Column, cuts: Column) -> Column:
    """The ascending ``ends``, with those among ``cuts`` twice."""
    return F.sort_array(F.concat(ends, cuts))


def align_shapes(shapes: Column) -> Column:
    """Of each shape: n_groups; links, the places (i, j) among the ids that share a group; steps, the places in the order in which groups name them, each with what follows it.

    A step hands a struct to the next, so that nothing is worked out again for each element.
    """
    cut = F.transform(shapes, lambda s: F.struct(s["a_ends"].alias("a_ends"), s["b_ends"].alias("b_ends"), F.array_intersect(s["a_ends"], s["b_ends"]).alias("cuts")))
    both = F.transform(cut, lambda s: F.struct(F.size(s["a_ends"]).alias("n_a"), _both(s["a_ends"], s["cuts"]).alias("a_both"), _both(s["b_ends"], s["cuts"]).alias("b_both")))
    upto = F.transform(both, lambda s: F.struct(s["n_a"].alias("n_a"), _upto(s["a_both"]).alias("a_upto"), _upto(s["b_both"]).alias("b_upto")))
    groups = F.transform(upto, lambda s: F.transform(s["a_upto"], lambda _, j: F.struct(_places(s["a_upto"], j, F.lit(0)).alias("a"), _places(s["b_upto"], j, s["n_a"]).alias("b"), (j == F.size(s["a_upto"]) - 1).alias("last"))))

    def links(g: Column) -> Column:
        return F.flatten(F.transform(g["a"], lambda i: F.transform(g["b"], lambda j: F.struct(i.alias("i"), j.alias("j")))))

    def steps(g: Column) -> Column:
        def named(places: Column, end: Column) -> Column:
            return F.transform(places, lambda i, k: F.struct(i.alias("at"), F.when(k == F.size(places) - 1, end).otherwise(",").alias("then")))

        return F.concat(named(g["a"], F.lit("|")), named(g["b"], F.when(g["last"], "").otherwise(";")))

    return F.transform(groups, lambda x: F.struct(F.size(x).alias("n_groups"), F.flatten(F.transform(x, links)).alias("links"), F.flatten(F.transform(x, steps)).alias("steps")))


def _upto(both: Column) -> Column:
    """For the j-th cut (from 0), its second place among both is that of its token and j earlier cuts."""
    twice = F.filter(F.sequence(F.lit(1), F.size(both) - 1), lambda p: both[p] == both[p - 1])
    return F.when(F.size(both) > 1, F.transform(twice, lambda p, j: p - j)).otherwise(F.array().cast("array<int>"))


def _places(upto: Column, j: Column, first: Column) -> Column:
    """The places of the j-th group's tokens, from ``first`` on; each group has one at least."""
    return F.sequence(first + F.when(j == 0, 0).otherwise(upto[j - 1]), first + upto[j] - 1)


def align(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a text: key, n_a, n_b, n_groups, groups, links.

    groups: ``a1,a2|b1;a3|b2,b3`` in decimal ids, in order.  links: a number for each pair of token occurrences that share a group: a's id
    times the size of b's vocabulary, and b's id; ascending.
    """
    base = _sizes(first, second)
    number = "int" if base[0] * base[1] < 1 << 31 else "bigint"

    def of_segment(s: Column) -> Column:
        form, ids = F.col("forms")[s["shape"]], s["ids"]
        groups = F.array_join(F.transform(form["steps"], lambda p: F.concat(ids[p["at"]].cast("string"), p["then"])), "")
        links = F.transform(form["links"], lambda p: ids[p["i"]].cast(number) * F.lit(base[1]).cast(number) + ids[p["j"]])
        return F.struct(form["n_groups"].alias("n_groups"), groups.alias("groups"), links.alias("links"))

    def of_text(d: Column) -> Column:
        at = d["at"]
        n_groups = F.aggregate(at, F.lit(0).cast("long"), lambda n, i: n + F.col("done")[i]["n_groups"])
        texts = F.array_join(F.transform(at, lambda i: F.col("done")[i]["groups"]), ";")
        pairs = F.flatten(F.transform(at, lambda i: F.col("done")[i]["links"]))
        return F.struct(d["doc_id"].alias(key), d["n_a"].alias("n_a"), d["n_b"].alias("n_b"), n_groups.alias("n_groups"), texts.alias("groups"), pairs.alias("links"))

    formed = tokenize(docs, first, second, key, text).select("docs", "segments", align_shapes(F.col("shapes")).alias("forms"))
    rows = formed.select("docs", F.transform("segments", of_segment).alias("done")).select(F.inline(F.transform("docs", of_text)))
    return rows.withColumn("links", F.sort_array("links"))


def _sizes(first: str, second: str) -> tuple[int, int]:
    """Ids of both vocabularies."""
    return tuple(t.size for t in Aligner.shared(first, second).pair)


def link_statistics(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text", most_hot: int = MOST_HOT) -> DataFrame:
    """One row a text: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A pair's count: the texts that hold it linked.  n_best: links whose count is the highest that their a id has; count_sum: the sum of all links' counts.
    """
    b_size = _sizes(first, second)[1]
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    rows = align(docs, first, second, key, text).select(key, "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), digest.alias("groups_sha256"), "links")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "links")

    counts = rows.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).withColumn("a", F.floor(F.col("pair") / b_size).cast("int"))
    counts = materialize(counts, "pairs")
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row an id of a's vocabulary
    counts = counts.join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best"), _level("n").alias("level"))
    levels = sorted(((r["level"], r["rows"]) for r in counts.groupBy("level").agg(F.count("*").alias("rows")).collect()), reverse=True)  # some hundreds
    hot, total = None, 0
    for level, n in levels:
        total += n
        if total > most_hot:
            break
        hot = level
    hot = levels[0][0] + 1 if hot is None and levels else hot or 0
    each = rows.select("row", F.explode("links").alias("pair"))
    common = F.broadcast(counts.where(F.col("level") >= hot).select("pair", "n", "best"))

    def summed(joined: DataFrame) -> DataFrame:
        return joined.groupBy("row").agg(F.sum("n").alias("count_sum"), F.sum("best").alias("n_best"))

    sums = summed(each.join(common, "pair"))
    if any(level < hot for level, _ in levels):
        rare = counts.where(F.col("level") < hot).select("pair", "n", "best")
        sums = sums.union(summed(each.join(common.select("pair"), "pair", "left_anti").join(rare, "pair"))).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    out = rows.drop("links").join(sums, "row", "left")
    return out.select(key, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")


def _level(n: str) -> Column:
    """A number that ascends with a count, four steps to each doubling."""
    return F.floor(4 * F.log2(F.col(n).cast("double"))).cast("int")
