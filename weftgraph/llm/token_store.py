"""Token ids in binary files: frequency-ranked, byte-aligned variable-length codes.

A file holds the ids of consecutive documents.  Each id is replaced by its rank in the
corpus (0: most frequent) and written in 1 to 4 bytes, little-endian, without leading
zero bytes; the lengths stand apart, two bits an id, in the control bytes.  Layout of a file::

    8 bytes   magic WFTIDS01
    4 x u64   documents, ids, control bytes, data bytes
    i64[documents]   document ids (valid where the next array says so)
    u8[documents]    1: the document id is not null
    u32[documents]   ids of each document
    control bytes, data bytes

A reader turns four lengths at once from a control byte into numbers by table lookup, sums
them up to the places of the ids, and gathers the data bytes in numpy; no loop runs over ids.
The rank table (rank -> id) is a file of its own beside the data files: ``ranks.bin`` (u32: how many, then the ids).

Files lie in a shared folder.  Each is written under a name of its own attempt and then
renamed, so that a repeated task leaves the same files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.kernel import list_array, texts
from weftgraph.llm.shared import materialize, scratch_path
from weftgraph.llm.word_tokens import WordTokenizer

MAGIC = b"WFTIDS01"
FIELDS = ["doc_id", "ids", "n", "used", "times"]
#: Lengths (1 to 4 bytes) of the four ids that a control byte describes.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    ranks = np.asarray(ranks, np.uint32)
    size = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    most = int(size.max(initial=1))  # columns of bytes beyond the longest code aren't looked at
    wide = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :most]
    return control, wide[np.arange(most) < size[:, None]] if most > 1 else wide.reshape(-1)


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The numbers that ``encode_ranks`` wrote."""
    size = LENGTHS[control].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(size) - size
    padded = np.append(data, np.zeros(4, np.uint8))
    out = padded[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        longer = np.flatnonzero(size > k)
        out[longer] |= padded[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def pack(doc_ids: list[int | None], counts: np.ndarray, ranks: np.ndarray) -> bytes:
    """One file's bytes."""
    control, data = encode_ranks(ranks)
    head = np.array([len(doc_ids), len(ranks), len(control), len(data)], "<u8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([MAGIC, head.tobytes(), numbers.tobytes(), known.tobytes(), np.asarray(counts, "<u4").tobytes(), control.tobytes(), data.tobytes()])


def unpack(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, ids of each, ranks) of a file's bytes."""
    if content[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, n, n_control, n_data = np.frombuffer(content, "<u8", 4, 8).astype(int)
    at = 40
    numbers = np.frombuffer(content, "<i8", docs, at)
    known = np.frombuffer(content, np.uint8, docs, at := at + 8 * docs)
    counts = np.frombuffer(content, "<u4", docs, at := at + docs)
    control = np.frombuffer(content, np.uint8, n_control, at := at + 4 * docs)
    data = np.frombuffer(content, np.uint8, n_data, at + n_control)
    return [int(d) if k else None for d, k in zip(numbers, known, strict=True)], counts.astype(np.int64), decode_ranks(control, data, n)


def _bytes_of(column: pa.Array) -> pa.Buffer:
    """The values of a binary column without nulls, end to end."""
    column = column.cast(pa.large_binary())
    offsets, values = column.buffers()[1:]
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return values.slice(int(at[0]), int(at[-1] - at[0])) if values is not None else pa.py_buffer(b"")


def _put(folder: str, name: str, content: bytes) -> None:
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    own = f"{path}/_{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        f.write(content)
    fs.move(own, f"{path}/{name}")


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text") -> DataFrame:
    """(doc_id, ids, n, used, times) of every row, in the order of the rows; ids: n little-endian numbers of 2 or 4 bytes, the end id last.

    Each task adds one row without ids, that tells how many times it used which ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordTokenizer.shared(tokenizer)
        size = encode.dtype.itemsize
        total = np.zeros(0, np.int64)
        for part in texts(batches, text):
            flat, count = encode(part)
            ends = np.cumsum(count + 1)
            ids = np.insert(flat, ends - np.arange(1, part.n + 1), end_id).astype(encode.dtype)
            seen = np.bincount(ids)
            total = np.pad(total, (0, max(0, len(seen) - len(total))))
            total[: len(seen)] += seen
            packed = pa.Array.from_buffers(pa.large_binary(), part.n, [None, pa.py_buffer(np.append(0, ends * size)), pa.py_buffer(ids)])
            none = pa.nulls(part.n, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.rows.column("doc_id"), packed.cast(pa.binary()), pa.array(count + 1), none, none], FIELDS)
        used = np.flatnonzero(total)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), *(list_array(x, [len(used)], pa.int64()) for x in (used, total[used]))], FIELDS)

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, ids binary, n long, used array<long>, times array<long>")


def write_ids(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2, ids_per_file: int = 4_000_000) -> str:
    """Encode all texts and write them, in ascending doc_id order, to token files; returns the folder.

    File names ascend with the ids they hold.  A null text has the end id alone; null
    ids come first; rows with equal ids stand in the order of their texts' hashes.  Of the
    corpus the driver holds one number per vocabulary entry, and two sums.

    The texts are range-partitioned and sorted before they are encoded, so that sampling
    the ranges doesn't encode anything; the encoded rows are kept once, and each later pass
    reads them in the order in which they were written.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "ids")
    parts = max(1, -(-int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (2 * ids_per_file)))
    ranged = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    done = materialize(tokenize(ranged, tokenizer, end_id).withColumn("seq", F.monotonically_increasing_id()), "ids")
    kind = WordTokenizer.shared(tokenizer).dtype

    counts = done.where("used is not null").select(F.explode(F.arrays_zip("used", "times")).alias("x")).groupBy(F.col("x.used").alias("id")).agg(F.sum("x.times").alias("n"))
    ranked = [r["id"] for r in counts.orderBy(F.desc("n"), "id").collect()]  # at most the vocabulary
    _put(folder, "ranks.bin", np.array([len(ranked), *ranked], "<u4").tobytes())
    rank_of = np.zeros(max(ranked, default=0) + 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    sent = spark.sparkContext.broadcast(rank_of)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A file for each run of consecutive rows, named by the place of its first row."""
        held: list[pa.RecordBatch] = []
        first, rows, size = 0, 0, 0

        def flush() -> pa.RecordBatch:
            flat = np.concatenate([np.frombuffer(x, kind) for part in held for x in [_bytes_of(part.column("ids"))]])
            name = f"ids-{first:020d}.bin"
            counts = np.concatenate([np.asarray(part.column("n")) for part in held])
            _put(folder, name, pack([d for part in held for d in part.column("doc_id").to_pylist()], counts, sent.value[flat]))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(flat)], pa.int64())], ["file", "n"])

        for batch in batches:
            seq, n = np.asarray(batch.column("seq")), np.asarray(batch.column("n"))
            at = 0
            while at < len(seq):
                if held and (seq[at] != first + rows or size + n[at] > ids_per_file):
                    yield flush()
                    held, rows, size = [], 0, 0
                if not held:
                    first = int(seq[at])
                follows = np.flatnonzero(np.diff(seq[at:]) != 1)
                end = at + int(follows[0]) + 1 if len(follows) else len(seq)
                room = int(np.searchsorted(size + np.cumsum(n[at:end]), ids_per_file, "right"))
                end = at + max(room, 0 if held else 1)
                if end == at:  # the next row doesn't fit
                    continue
                held.append(batch.slice(at, end - at))
                rows, size, at = rows + end - at, size + int(n[at:end].sum()), end
        if held:
            yield flush()

    done.where("n is not null").select("seq", "doc_id", "ids", "n").mapInArrow(write, "file string, n long").agg(F.sum("n")).collect()
    return folder


def read_ids(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, file, place, before, n_tokens, ids_crc32, ids) of every document in the files of ``folder``.

    place and before: the documents and ids before it in its file.  Without ``with_ids`` the ids are
    decoded and summed up all the same, but not returned.
    """
    ranks = spark.read.format("binaryFile").load(f"{folder}/ranks.bin").select("content").first()[0]  # the vocabulary at most
    sent = spark.sparkContext.broadcast(np.frombuffer(ranks or b"", "<u4")[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                doc_ids, counts, got = unpack(content)
                flat = sent.value[got].astype("<u4") if len(got) else np.zeros(0, "<u4")
                ends = np.cumsum(counts)
                for at in range(0, len(doc_ids), 512):
                    to = min(at + 512, len(doc_ids))
                    a = ends[at - 1] if at else 0
                    crc = [zlib.crc32(flat[e - c : e].tobytes()) for e, c in zip(ends[at:to], counts[at:to], strict=True)]
                    cols = [pa.array(doc_ids[at:to], pa.int64()), pa.array([path.rsplit("/", 1)[1]] * (to - at)), pa.array(range(at, to), pa.int64()), pa.array(ends[at:to] - counts[at:to], pa.int64()), pa.array(counts[at:to], pa.int64()), pa.array(crc, pa.int64()), list_array(flat[a : ends[to - 1]].astype(np.int64), counts[at:to], pa.int64()) if with_ids else pa.nulls(to - at, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "file", "place", "before", "n_tokens", "ids_crc32", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.bin").load(folder)
    return files.select("path", "content").mapInArrow(run, "doc_id long, file string, place long, before long, n_tokens long, ids_crc32 long, ids array<long>")


def positions(read: DataFrame) -> DataFrame:
    """``read_ids`` without the ids, with ``start``: the ids of all documents before each, over all files in order."""
    read = materialize(read.drop("ids"), "read")
    totals = read.groupBy("file").agg(F.sum("n_tokens").alias("n"))  # one row per file
    starts = totals.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("file_start"))
    return read.join(F.broadcast(starts), "file").withColumn("start", F.col("file_start") + F.col("before")).drop("file_start")
