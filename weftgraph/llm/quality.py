"""Quality rules and a hashed n-gram likelihood ratio.

Two multinomials over hashed word uni- and bigrams are estimated: one of trusted texts, one of the
whole raw corpus.  A document's score is the mean over its n-grams of log p_trusted - log p_raw;
it is kept when no base rule fails and the score reaches a threshold.  The threshold is the grid point that
separates the labelled texts best (the lowest that is within ``SLACK`` of it), so the same input always gets the same verdicts.

Raw counts cover every document, trusted counts and the threshold all labelled rows; they are joined
by id, and one weight per bucket is all that is sent to the tasks.  Half of the trusted rows give the
counts, the other half the threshold, so that no text is judged by its own words when the threshold
is set.  Both multinomials are smoothed by the same ``prior`` of raw n-grams a bucket: a bucket that
was hardly seen says nothing.

Defined results: a null or empty text has no words and fails the base rules; without trusted labels
the score is 0 and only base rules decide; without rejected labels the threshold is the
least score of a trusted text; null labels are ignored, and of repeated labels the least holds;
repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.kernel import U64, PrefixHash, Texts, mix, texts, window_starts
from weftgraph.llm.shared import materialize

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
GRID = 0.005  # width of a step of the threshold
SLACK = 0.01  # shares of either class that a lower threshold may lose together: clean texts come first


def ngram_buckets(part: Texts, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every word and every pair of neighbouring words."""
    h = part.word_hashes()
    doc = np.repeat(np.arange(part.n), np.diff(part.word_offsets))
    pair = mix(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:])
    same = doc[1:] == doc[:-1]
    return np.concatenate([doc, doc[1:][same]]), (np.concatenate([h, pair[same]]) % U64(buckets)).astype(np.int64)


def repeated_words(part: Texts, hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """For each text, its words in windows of ``width`` words that the text has twice or more."""
    starts = window_starts(part.word_offsets, width)
    doc = np.repeat(np.arange(part.n), np.diff(part.word_offsets))
    if not len(starts):
        return np.zeros(part.n, np.int64)
    key = mix(PrefixHash(hashes).of(starts, starts + width) + doc[starts].astype(U64) * U64(0xD1B54A32D192ED03))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = starts[order[np.append(same, False) | np.append(False, same)]]
    steps = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(steps, twice, 1)
    np.add.at(steps, twice + width, -1)
    return np.bincount(doc[np.cumsum(steps[:-1]) > 0], minlength=part.n)


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, quality, counted) of every labelled row; counted: gives trusted counts."""
    one = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    return one.withColumn("counted", (F.col("quality") == 1) & (F.xxhash64(F.lit("half"), "doc_id") % 2 == 0))


def bucket_weights(docs: DataFrame, known: DataFrame, buckets: int, prior: float) -> np.ndarray:
    """log p_trusted - log p_raw of every bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for part in texts(batches):
            doc, bucket = ngram_buckets(part, buckets)
            trusted = np.array(part.rows.column("counted").fill_null(False).to_pylist(), bool)
            total[0] += np.bincount(bucket, minlength=buckets)
            total[1] += np.bincount(bucket[trusted[doc]], minlength=buckets)
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (used, total[0][used], total[1][used])], ["bucket", "raw", "trusted"])

    flagged = docs.select("doc_id", "text").join(known.where("counted").select("doc_id", "counted"), "doc_id", "left").select("text", "counted")
    rows = flagged.mapInArrow(count, "bucket long, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).collect()
    raw, trusted = np.zeros(buckets), np.zeros(buckets)
    for r in rows:
        raw[r["bucket"]], trusted[r["bucket"]] = r["raw"], r["trusted"]
    if not trusted.sum():
        return np.zeros(buckets)
    part = trusted.sum() / raw.sum()
    return np.log(trusted + prior * part) - np.log(part * (raw + prior))


def measure(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score) of every row."""
    sent, buckets = docs.sparkSession.sparkContext.broadcast(weights), len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in texts(batches):
            doc, bucket = ngram_buckets(part, buckets)
            n = np.bincount(doc, minlength=part.n)
            score = np.bincount(doc, sent.value[bucket], part.n) / np.maximum(n, 1)
            words = np.diff(part.word_offsets)
            solid = np.zeros(len(part.data) + 1, np.int8)
            solid[part.starts] += 1
            solid[part.ends] -= 1
            point = (np.cumsum(solid[:-1]) > 0) & ((part.data & 0xC0) != 0x80)
            per = lambda mask: np.diff(np.append(0, np.cumsum(mask))[part.offsets])
            lines = [duplicate_lines(part.data[a:b].tobytes()) for a, b in zip(part.offsets[:-1], part.offsets[1:], strict=True)]
            again = repeated_words(part, part.word_hashes())
            cols = [words, per(point), per(SYMBOLS[part.data]), lines, again]
            yield pa.RecordBatch.from_arrays([part.rows.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols), pa.array(score, pa.float64())], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double")


def base_failed() -> F.Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def best_threshold(measured: DataFrame, known: DataFrame) -> float:
    """The step of the grid at which kept and rejected labels are told apart best."""
    bins = measured.where(~base_failed()).join(known.where("not counted"), "doc_id").groupBy(F.floor(F.col("score") / GRID).alias("step"), "quality").count().collect()
    steps = sorted({r["step"] for r in bins})
    good, bad = ({r["step"]: r["count"] for r in bins if r["quality"] == q} for q in (1, 0))
    if not good:
        return float("-inf")
    if not bad:
        return min(good) * GRID
    all_good, all_bad = sum(good.values()), sum(bad.values())

    def apart(at: int) -> float:
        return sum(n for s, n in good.items() if s >= at) / all_good + sum(n for s, n in bad.items() if s < at) / all_bad

    best = max(map(apart, steps))
    return min(at for at in steps if apart(at) >= best - SLACK) * GRID


def judge(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 16, prior: float = 8.0) -> DataFrame:
    """Measures and verdicts (base_failed, kept) of every document."""
    known = materialize(labelled(labels), "labels")
    measured = materialize(measure(docs, bucket_weights(docs, known, buckets, prior)), "quality")
    threshold = best_threshold(measured, known)
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))
