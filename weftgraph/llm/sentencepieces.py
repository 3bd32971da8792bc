"""SentencePiece encoding that keeps offsets, and decoding.

The text is normalised by longest-prefix matches in the model's compiled character map
(a double-array trie, followed by the replacements), and the source byte of every
normalised byte is recorded on the way.  The pieces of the normalised text are then
projected to byte spans of the original text.

Pieces come from the library, one call a new segment: a segment is a line feed, or a run of word
separators and what follows, and no piece of the vocabulary reaches across a segment's
start (checked when the model is loaded; otherwise whole texts go to the library).
Known segments come from a bounded table, many at once.

Defined results: a null text is an empty one and has the end id alone; the end id's span is empty and lies at the
text's end; repeated rows are encoded each; extra columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from weftgraph.llm.kernel import Texts, give_back, list_array, texts
from weftgraph.llm.word_table import WordTable

MARK = "▁"  # stands for a space in pieces


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if key & 7 == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n


class CharacterMap:
    """Longest-prefix replacement by a compiled map: a double-array trie of 32-bit units, then NUL-ended replacements."""

    def __init__(self, blob: bytes):
        n = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist() if n else []
        self.replacements = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes matched from ``at`` and what replaces them, for the longest key there."""
        units, found = self.units, None
        if not units:
            return None
        node = self._child(0, units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node = self._child(node, unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.replacements[start : self.replacements.index(b"\0", start)]
        return found

    @staticmethod
    def _child(node: int, unit: int) -> int:
        return node ^ (unit >> 10) << ((unit & 0x200) >> 6)


class PieceModel:
    """A model file: its library processor, its normaliser, and its pieces' lengths."""

    _made: dict[str, PieceModel] = {}

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        pieces = [dict(_fields(v)) for k, v in fields if k == 1]
        spec = dict(_fields(next((v for k, v in fields if k == 3), b"")))
        self.map = CharacterMap(spec.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        trainer = dict(_fields(next((v for k, v in fields if k == 2), b"")))
        self.suffix = bool(trainer.get(24, 0))
        surface = [p.get(1, b"").decode("utf-8", "replace") for p in pieces]
        kinds = [p.get(3, 1) for p in pieces]
        #: bytes of the normalised text that a piece covers; an unknown piece's are told by the library
        self.size = np.array([1 if k == 6 else 0 if k == 3 else len(s.encode()) for s, k in zip(surface, kinds, strict=True)], np.int64)
        self.unknown = next((i for i, k in enumerate(kinds) if k == 2), -1)
        bytes_known = sum(k == 6 for k in kinds) == 256
        inside = [s for s, k in zip(surface, kinds, strict=True) if k in (1, 4, 5)]
        self.by_segment = bool(
            self.escape and self.dummy and not self.squeeze and not self.suffix and bytes_known and not self.map.units
            and not any(re.search(f"[^{MARK}]{MARK}", s) for s in inside) and not any(k == 4 for k in kinds)
        )
        self.line_alone = self.by_segment and not any("\n" in s for s in inside)
        self.table = WordTable(self._segments, bits=18)

    @classmethod
    def shared(cls, path: str) -> PieceModel:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def normalize(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised text (spaces are marks) and, for each of its bytes and its end, the byte of ``text`` it comes from."""
        data, space = text.encode("utf-8"), (MARK if self.escape else " ").encode()
        if not self.map.units and not self.squeeze:  # nothing is replaced but spaces
            raw = np.frombuffer(data, np.uint8)
            width = np.where(raw == 32, len(space), 1)
            if self.dummy and data and not self.suffix:
                data, width, source = b" " + data, np.append(len(space), width), np.append(0, np.arange(len(raw)))
            else:
                source = np.arange(len(raw))
            return data.replace(b" ", space), np.append(np.repeat(source, width), len(raw))
        out, source, at = bytearray(), [], 0
        parts: list[tuple[bytes, int, int]] = []
        while at < len(data):
            hit = self.map.longest(data, at)
            if hit:
                n, new = hit
            else:
                n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                new = data[at : at + n]
            parts.append((new, at, n))
            at += n
        end = len(data)
        if self.squeeze:
            while parts and parts[0][0].strip(b" ") == b"":
                parts.pop(0)
            while parts and parts[-1][0].strip(b" ") == b"":
                end = parts.pop()[1]
        if not parts:
            return b"", np.array([len(data)])
        if self.dummy and not self.suffix:
            out += space
            source += [parts[0][1]] * len(space)
        last_space = self.squeeze
        for new, begin, _ in parts:
            if self.squeeze and last_space:
                new = new.lstrip(b" ")
            for b in new:
                piece = space if b == 32 else bytes([b])
                out += piece
                source += [begin] * len(piece)
            if new:
                last_space = new.endswith(b" ")
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :], source[-len(space) :]
        if self.dummy and self.suffix:
            out += space
            source += [end] * len(space)
        return bytes(out), np.array([*source, end])

    def _segments(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of segments, where each one's begin, how many it has: the library's dummy prefix stands for the first space."""
        texts = [s.decode("utf-8") for s in segments]
        plain = len(self.library.encode("\n"))
        lone = self.library.encode("\n")[:-1]  # of a space alone: the library makes nothing of an empty text, not even its prefix
        ids = self.library.encode([s[1:] if s[0] == " " else "\n" + s for s in texts], num_threads=1)
        own = [lone if s == " " else x if s[0] == " " else x[plain:] for s, x in zip(texts, ids, strict=True)]
        count = np.array([len(x) for x in own], np.int64)
        return np.array([i for x in own for i in x], np.int32), np.cumsum(count) - count, count

    def encode(self, part: Texts) -> list[np.ndarray]:
        """Ids of each text (null: none)."""
        if not self.by_segment or not self.line_alone:
            return [np.array(x, np.int32) for x in self.library.encode([part.text(i) for i in range(part.n)], num_threads=1)]
        some = np.diff(part.offsets) > 0
        data = np.insert(part.data, part.offsets[:-1][some], 32)  # a dummy space goes before each text
        offsets = part.offsets + np.append(0, np.cumsum(some))
        line, space = data == 10, data == 32
        opens = line.copy()
        opens[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        opens[offsets[:-1][some]] = True
        starts = np.flatnonzero(opens)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        first, count = self.table.look_up(data, starts, ends)
        ids = self.table.ids(first, count)
        edges = np.append(0, np.cumsum(count))[np.searchsorted(starts, offsets)]
        out = np.split(ids, edges[1:-1])
        mark = MARK.encode()
        at = np.flatnonzero((part.data[:-2] == mark[0]) & (part.data[1:-1] == mark[1]) & (part.data[2:] == mark[2]))
        for i in np.unique(np.searchsorted(part.offsets, at, "right") - 1).tolist():  # a mark of the text itself may join the space before it
            out[i] = np.array(self.library.encode(part.text(i)), np.int32)
        return out

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end byte in ``text`` of each piece."""
        normal, source = self.normalize(text)
        size = self.size[ids]
        if (ids == self.unknown).any():
            pieces = self.library.encode(text, out_type="immutable_proto").pieces
            size = np.array([len(p.piece.encode()) for p in pieces], np.int64)
        ends = np.cumsum(size)
        if len(ends) and ends[-1] != len(normal):
            raise ValueError("pieces don't cover the normalised text")
        return source[ends - size], source[ends]


def encode(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, then ids, begins, ends, decoded: ids with the end id last, byte spans of the original text, and the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceModel.shared(model)
        end_id = pieces.library.eos_id()
        for part in texts(batches, text, 1 << 20):
            values = [v or "" for v in part.rows.column(text).to_pylist()]
            ids = pieces.encode(part)
            spans = [pieces.spans(v, i) for v, i in zip(values, ids, strict=True)]
            size = [len(v.encode()) for v in values]
            ids = [np.append(i, end_id) for i in ids]
            decoded = pieces.library.decode([i.tolist() for i in ids])
            counts = np.array([len(i) for i in ids])
            flat = [np.concatenate(x) for x in (ids, [np.append(b, n) for (b, _), n in zip(spans, size, strict=True)], [np.append(e, n) for (_, e), n in zip(spans, size, strict=True)])]
            yield pa.RecordBatch.from_arrays([*(part.rows.column(c) for c in keep), *(list_array(x.astype(np.int32), counts, pa.int32()) for x in flat), pa.array(decoded, pa.string())], [*keep, "ids", "begins", "ends", "decoded"])

        pieces.table.clear()  # other tasks' workers need the room more than this one needs the words
        give_back()

    ints = ArrayType(IntegerType())
    added = [StructField("ids", ints), StructField("begins", ints), StructField("ends", ints), StructField("decoded", StringType())]
    schema = StructType([*(docs.schema[c] for c in keep), *added])
    return docs.select(*keep, F.col(text).alias(text)).mapInArrow(run, schema)
