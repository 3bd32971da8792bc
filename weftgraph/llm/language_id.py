"""Language identification by hyperdimensional profiles.

Each letter has a random +-1 vector (seeded by its code point).  A letter
n-gram is the element-wise product (binding) of its letters' vectors, each permuted
(rotated) by its place; a text is the sum (bundling) of its n-grams' vectors.  A
language's prototype bundles all its training texts; the prediction is the prototype
with the largest cosine.

Bundling is linear, so training only counts n-grams by language (one bounded-memory
pass, summed in Spark) and bundles the counts.  What the driver holds and
sends to the tasks is one vector of ``dim`` floats per language.  Vectors of n-grams are made
from their letters a chunk at a time and never kept, so that memory doesn't grow with the scripts there are.

Defined results: a null, empty or letterless text gives language ``und`` and score 0;
without any usable training row every text is ``und``; ties go to the alphabetically
first language; rows with a null language or a null id aren't learned from; extra
columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from weftgraph.llm.kernel import U64, list_array, mix, texts

UNDETERMINED = "und"
POINT = 21  # bits of a code point; 0 stands for anything that isn't a letter
WORDS = 64  # signs in a number


class NgramSpace:
    """Vectors of letter trigrams: signs as bits (0: +1), made from the letters' code points, ``CHUNK`` at once and never kept."""

    CHUNK = 1024

    def __init__(self, dim: int, seed: int):
        if dim % WORDS:
            raise ValueError(f"dim must be a multiple of {WORDS}")
        self.dim, self.seed = dim, U64(seed * 0x9E3779B97F4A7C15 % 2**64)

    def _letters(self, points: np.ndarray) -> np.ndarray:
        """Random bits of letters: a row of numbers each."""
        at = points.astype(U64)[:, None] * U64(1 << 16) + np.arange(self.dim // WORDS, dtype=U64)
        return mix(mix(at ^ self.seed) + U64(0xA0761D6478BD642F))

    def chunk(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of +-1 of some trigram codes: letters permuted (rotated) by their place, then bound (signs multiplied)."""
        mask = (1 << POINT) - 1
        a, b, c = (self._letters(x) for x in (codes >> 2 * POINT, codes >> POINT & mask, codes & mask))
        bits = np.roll(a, 2, axis=1) ^ np.roll(b, 1, axis=1) ^ c
        return 1 - 2 * np.unpackbits(bits.view(np.uint8), axis=1).astype(np.float32)

    def bundles(self, counts: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """For every row of ``counts``: the sum of the vectors of ``codes``, each as often as it says; exact for sums below 2**24 in a chunk."""
        out = np.zeros((len(counts), self.dim), np.float64)
        for at in range(0, len(codes), self.CHUNK):
            out += counts[:, at : at + self.CHUNK].astype(np.float32) @ self.chunk(codes[at : at + self.CHUNK])
        return out


_LOWER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> the letter in lower case, or 0."""
    if not _LOWER:
        table = np.zeros(0x110000, np.int32)
        points = np.array([c for c in range(0x110000) if chr(c).isalpha()])
        table[points] = [ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in points]
        _LOWER.append(table)
    return _LOWER[0]


def trigrams(values: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place in the list of codes) of all texts' trigrams, words padded by one non-letter; the codes; letters of each text."""
    values = [f"\n{v}\n" if v else "\n\n" for v in values]
    lengths = np.array([len(v) for v in values])
    point = _letters()[np.frombuffer("".join(values).encode("utf-32-le", "replace"), np.uint32)]
    doc = np.repeat(np.arange(len(values), dtype=np.int32), lengths)
    letters = np.bincount(doc[point > 0], minlength=len(values))
    keep = (point > 0) | np.append(True, (point[:-1] > 0) | (doc[1:] != doc[:-1]))  # runs of non-letters count as one, and each text begins with one
    point, doc = point[keep], doc[keep]
    seen = np.zeros(0x110000, bool)
    seen[point] = seen[0] = True
    alphabet = np.flatnonzero(seen)  # 0 is the first
    number = np.zeros(0x110000, np.int32)
    number[alphabet] = np.arange(len(alphabet))
    point, base = number[point].astype(np.int64), len(alphabet)
    ok = (doc[:-2] == doc[2:]) & (point[1:-1] > 0)
    codes = ((point[:-2] * base + point[1:-1]) * base + point[2:])[ok]
    if base**3 <= 1 << 22:
        seen = np.zeros(base**3, bool)
        seen[codes] = True
        distinct = np.flatnonzero(seen)
        number = np.zeros(base**3, np.int32)
        number[distinct] = np.arange(len(distinct))
        place = number[codes]
    else:
        distinct, place = np.unique(codes, return_inverse=True)
    a, b, c = alphabet[distinct // base**2], alphabet[distinct // base % base], alphabet[distinct % base]
    return doc[:-2][ok], place, a << 2 * POINT | b << POINT | c, letters


def counted(row: np.ndarray, place: np.ndarray, n: int, m: int) -> np.ndarray:
    """How often each place is in each of n rows."""
    return np.bincount(row * np.int64(m) + place, minlength=n * m).reshape(n, m)


def learn(train: DataFrame, text: str = "text", lang: str = "lang", dim: int = 2048, seed: int = 8, most_counts: int = 200_000) -> tuple[list[str], np.ndarray]:
    """Prototypes of the languages, from all given rows: names in order, unit vectors.  A task bundles what it has counted whenever it holds ``most_counts``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, dict[int, int]] = {}
        space = NgramSpace(dim, seed)

        def bundled() -> Iterator[pa.RecordBatch]:
            for name, n in total.items():
                codes, weights = np.array(list(n), np.int64), np.array(list(n.values()), np.int64)
                bundle = np.zeros(dim)
                for bits in range(0, int(weights.max(initial=0)).bit_length(), 13):  # so that a chunk's sums stay exact
                    bundle += space.bundles((weights >> bits & 0x1FFF)[None], codes)[0] * float(1 << bits)
                yield pa.RecordBatch.from_arrays([pa.array([name]), list_array(bundle.astype(np.int64), [dim], pa.int64())], ["lang", "bundle"])
            total.clear()

        for part in texts(batches, text):
            names, of = np.unique(np.array(part.rows.column(lang).to_pylist(), dtype=object).astype(str), return_inverse=True)
            doc, place, codes, _ = trigrams(part.rows.column(text).to_pylist())
            for i, name in enumerate(names.tolist()):
                n = np.bincount(place[of[doc] == i], minlength=len(codes))
                some, mine = np.flatnonzero(n), total.setdefault(name, {})
                for code, v in zip(codes[some].tolist(), n[some].tolist(), strict=True):
                    mine[code] = mine.get(code, 0) + v
            if sum(map(len, total.values())) > most_counts:
                yield from bundled()
        yield from bundled()

    parts = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(text, lang).mapInArrow(count, "lang string, bundle array<long>")
    sums = parts.select("lang", F.posexplode("bundle").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    found: dict[str, np.ndarray] = {}
    for r in sums.collect():  # languages x dim numbers
        found.setdefault(r["lang"], np.zeros(dim))[r["i"]] = r["v"]
    names = sorted(found)
    if not names:
        return [], np.zeros((0, dim), np.float32)
    proto = np.stack([found[n] for n in names])
    return names, (proto / np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray, text: str = "text", seed: int = 8) -> DataFrame:
    """``docs`` with the columns lang_pred and score (cosine with the chosen prototype, 0 to 1) added; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    dim = prototypes.shape[1]
    sent = docs.sparkSession.sparkContext.broadcast(prototypes)  # languages x dim floats

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, proto = NgramSpace(dim, seed), sent.value
        for part in texts(batches, text, 1 << 20):
            doc, place, codes, letters = trigrams(part.rows.column(text).to_pylist())
            best, value = np.full(part.n, -1), np.zeros(part.n)
            step = max(1, min(256, (1 << 21) // max(1, len(codes))))  # texts at once
            for at in range(0, part.n if len(codes) and len(names) else 0, step):
                n = min(step, part.n - at)
                a, b = np.searchsorted(doc, (at, at + n))
                bundle = space.bundles(counted(doc[a:b] - at, place[a:b], n, len(codes)), codes)
                cosine = bundle @ proto.T / np.maximum(np.linalg.norm(bundle, axis=1, keepdims=True), 1e-6)
                best[at : at + n], value[at : at + n] = cosine.argmax(1), cosine.max(1)
            best[(letters == 0) | part.null] = -1
            value = np.where(best < 0, 0.0, np.clip(value, 0.0, 1.0))
            chosen = np.array([*names, UNDETERMINED], dtype=object)[best]
            yield pa.RecordBatch.from_arrays([*part.rows.columns, pa.array(chosen, pa.string()), pa.array(value, pa.float64())], [*part.rows.schema.names, "lang_pred", "score"])

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(score, schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that are never learned from: crc32 of the id's decimal text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(True))


def identify(docs: DataFrame, dim: int = 2048, seed: int = 8) -> DataFrame:
    """``docs`` (doc_id, text, lang, ...) with held_out, lang_pred and score; learns from the rows that aren't held out."""
    docs = docs.drop("held_out")
    names, proto = learn(docs.where(~held_out()), dim=dim, seed=seed)
    return predict(docs.select("*", held_out().alias("held_out")), names, proto, seed=seed)
