import hashlib
import random
import sys
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from weftgraph.llm import block_dedup, language_id, ngram_join, quality, suffix_dedup, suffix_sort
from weftgraph.llm.shared import connected_components
from weftgraph.llm.suffix_sort import suffix_order

DOCS = "doc_id long, text string, lang string, source string, n_chars long, begin string"


def corpus(seed=1, n=40):
    """Texts with copies, near copies, shared passages and odd cases; the last column has a name that operators use inside."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(30)]
    out = ["", None, " \n\t ", "one", "One", "a b c", "x" * 700, "ab " * 200, "same line\nsame line\nother\n\n\n", " x  y"]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3 and len(out) > 12:
            ws = (rng.choice(out[10:]) or "").split(" ")
            for _ in range(rng.randint(0, 3)):
                ws[rng.randrange(len(ws))] = word()
            out.append(" ".join(ws))
        else:
            ws = [word() for _ in range(rng.randint(1, 80))]
            if kind > 0.7:
                at = rng.randrange(len(ws))
                a = rng.randint(0, 8)
                ws[at:at] = passage[a : rng.randint(20, 30)]
            out.append(rng.choice([" ", "  "]).join(ws))
    out += [rng.choice(out), out[-1]]
    return [(i * 3, t, "en", "s", 0, "z") for i, t in enumerate(out)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.mark.parametrize(("budget", "large"), [(8, 10**6), (10**6, 10**6), (10**6, 4)])
def test_suffix_order(monkeypatch, budget, large):
    monkeypatch.setattr(suffix_sort, "LARGE", large)
    rng = random.Random(3)
    for _ in range(400):
        t = [rng.randint(0, rng.randint(1, 3)) for _ in range(rng.randint(1, 50))] * rng.choice([1, 1, 2])
        order, lcp = suffix_order(np.array(t), 9, alphabet=5, budget=budget)
        expected = sorted(range(len(t)), key=lambda i: t[i:])
        assert order.tolist() == expected
        for a, b, k in zip(expected, expected[1:], lcp[1:].tolist(), strict=False):
            m = 0
            while m < 9 and max(a, b) + m < len(t) and t[a + m] == t[b + m]:
                m += 1
            assert k == m


@pytest.mark.parametrize("most_bytes", [64, 1 << 20])
def test_suffix_dedup(spark, docs, most_bytes):
    got = suffix_dedup.remove_repeats(docs, width=24, most_bytes=most_bytes)
    mine = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got.collect()}
    assert mine == brute.repeated_bytes([r[:2] for r in corpus()], 24)
    assert any(v[1] for v in mine.values())


@pytest.mark.parametrize(("most_bytes", "most_pairs"), [(256, 1 << 16), (1 << 20, 1 << 16), (1 << 20, 1)])
def test_block_dedup(spark, docs, most_bytes, most_pairs):
    got = block_dedup.remove_repeats(docs, width=9, most_bytes=most_bytes, most_pairs=most_pairs)
    mine = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()}
    assert mine == brute.repeated_words([r[:2] for r in corpus()], 9)


@pytest.mark.parametrize(("n", "t"), [(2, "0.85"), (3, "0.5"), (1, "0.7")])
def test_ngram_join(spark, docs, n, t):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs, n, t).collect()}
    f = Fraction(t)
    assert got == brute.near_classes([r[:2] for r in corpus()], n, f.numerator, f.denominator)


def test_slices_find_every_similar_pair():
    """Any two sets at or above the threshold agree in something that they send."""
    rng = np.random.default_rng(4)
    t = Fraction(4, 5)
    for _ in range(300):
        size = int(rng.integers(2, 60))
        a = rng.integers(0, 2**63, size, dtype=np.uint64)
        b = np.concatenate([a[int(rng.integers(0, size // 4 + 1)) :], rng.integers(0, 2**63, int(rng.integers(0, size // 4 + 1)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if set(a) == set(b) or 5 * both < 4 * (len(a) + len(b) - both):
            continue
        who, what = ngram_join.slice_hashes(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), t)
        assert set(what[who == 0]) & set(what[who == 1])


@pytest.mark.parametrize("t", ["0.85", "0.8", "0.7"])
def test_what_a_set_sends_does_not_depend_on_its_slice(t):
    """A set and one that has an element more agree in what they send, each the largest of its own slice; the larger set's company changes nothing."""
    t = Fraction(t)
    x = np.unique(np.random.default_rng(5).integers(0, 2**63, 400, dtype=np.uint64))
    sent = lambda *sets: ngram_join.slice_hashes(np.concatenate(sets), np.append(0, np.cumsum([len(s) for s in sets])), t)
    for size in range(2, 170):
        a = set(sent(x[:size])[1])
        if size >= t * (size + 1):
            assert a & set(sent(x[: size + 1])[1])
        who, what = sent(x[:size], x)
        assert set(what[who == 0]) == a


def test_tiles_of_bounded_size_lose_no_link(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, base.replace(f"w{i} ", f"v{i} ")) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = ngram_join.measured(docs, 1)
    links = ngram_join.links(docs, sizes, 1, Fraction("0.9"), every=True, tile=200).collect()
    assert len({(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in links}) == 30 * 29 // 2
    assert all(r["overlap"] == 58 and r["union"] == 62 for r in links)


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "x"), (None, None)], "doc_id long, text string")
    near = ngram_join.near_duplicates(docs, 2, "0.8").collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in near) == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 2)]
    assert sorted(r["n_removed"] for r in block_dedup.remove_repeats(docs, width=9).collect()) == [0, 0, 0, 0, 0]
    assert sorted(r["n_removed"] for r in suffix_dedup.remove_repeats(docs, width=20).collect()) == [0, 0] + [len(text)] * 3


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert ngram_join.near_duplicates(none).count() == 0
    assert block_dedup.remove_repeats(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert language_id.identify(none).count() == 0
    assert quality.judge(none, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_quality(spark, docs):
    labels = spark.createDataFrame([(30 + 3 * i, i % 2) for i in range(20)] + [(30, None), (33, 0), (None, 1)], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    for doc_id, text, *_ in corpus():
        r = rows[doc_id]
        measures = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert measures == brute.base_measures(text)
        assert r["base_failed"] == (measures[0] < 10 or 100 * measures[4] > 20 * measures[0])
        assert not (r["base_failed"] and r["kept"])
    again = {r["doc_id"]: r["kept"] for r in quality.judge(docs.repartition(7), labels).collect()}
    assert again == {d: r["kept"] for d, r in rows.items()}


def test_quality_against_a_plain_version(spark, docs):
    """Scores, threshold and verdicts by plain counts; only the buckets of n-grams come from the operator."""
    from collections import Counter
    from math import floor, log

    import pyarrow as pa

    from weftgraph.llm.kernel import texts

    labels = [(30 + 3 * i, i % 2) for i in range(20)]
    got = {r["doc_id"]: r for r in quality.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int"), buckets=256).collect()}
    sample = spark.createDataFrame(labels, "doc_id long, quality int").select("*", (F.xxhash64(F.lit("half"), "doc_id") % 2 == 0).alias("half")).collect()
    counted = {r["doc_id"] for r in sample if r["quality"] == 1 and r["half"]}
    judged = {r["doc_id"]: r["quality"] for r in sample if r["doc_id"] not in counted}
    grams = {}
    for doc_id, text, *_ in corpus():
        part = next(texts(iter([pa.RecordBatch.from_arrays([pa.array([text], pa.string())], ["text"])])))
        grams[doc_id] = Counter(quality.ngram_buckets(part, 256)[1].tolist())
    raw, trusted = Counter(), Counter()
    for d, c in grams.items():
        raw.update(c)
        if d in counted:
            trusted.update(c)
    share = sum(trusted.values()) / sum(raw.values())
    weight = lambda b: log(trusted[b] + 8.0 * share) - log(share * (raw[b] + 8.0))
    score = {d: sum(n * weight(b) for b, n in c.items()) / max(sum(c.values()), 1) for d, c in grams.items()}
    assert all(abs(got[d]["score"] - score[d]) < 1e-9 for d in score)
    usable = [(floor(got[d]["score"] / quality.GRID), q) for d, q in judged.items() if not got[d]["base_failed"]]
    good, bad = ([s for s, q in usable if q == k] for k in (1, 0))
    apart = {at: sum(s >= at for s in good) / len(good) + sum(s < at for s in bad) / len(bad) for at in {s for s, _ in usable}}
    at = min(a for a, v in apart.items() if v >= max(apart.values()) - quality.SLACK) * quality.GRID
    assert all(got[d]["kept"] == (not got[d]["base_failed"] and got[d]["score"] >= at) for d in score)


def test_quality_tells_labelled_texts_apart(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(docs, labels).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r["quality"]: r["kept"] for r in rows}
    assert share[1] > 0.95 and share[0] < 0.1


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "", "en", "s", 0), (-3, "12 34 !!", None, "s", 0), (None, "the thing", None, "s", 0)], docs.schema)
    rows = language_id.identify(docs.union(odd)).collect()
    held = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"] and r["lang"]]
    assert sum(held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert [by_id[i]["lang_pred"] for i in (-1, -2, -3)] == ["und"] * 3
    assert by_id[None]["held_out"] and by_id[None]["lang_pred"] == "en"


def plain_mix(h):
    m = 2**64 - 1
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & m
    h = (h ^ h >> 27) * 0x94D049BB133111EB & m
    return h ^ h >> 31


def plain_profile(text, dim=128, seed=8):
    """Sum of the trigrams' vectors, by Python numbers: words of letters in lower case, a non-letter (0) at both ends."""
    def letter(p):
        words = [plain_mix((plain_mix((p * 65536 + i) ^ (seed * 0x9E3779B97F4A7C15 % 2**64)) + 0xA0761D6478BD642F) % 2**64) for i in range(dim // 64)]
        return [w >> (8 * (b // 8) + 7 - b % 8) & 1 for w in words for b in range(64)]

    total = [0] * dim
    word = [0]
    for c in f"{text}\n":
        if c.isalpha():
            word.append(ord(c.lower()) if len(c.lower()) == 1 else ord(c))
        elif len(word) > 1:
            word.append(0)
            for i in range(1, len(word) - 1):
                bits = zip(np.roll(letter(word[i - 1]), 128), np.roll(letter(word[i]), 64), letter(word[i + 1]), strict=True)
                total = [t + 1 - 2 * int(a ^ b ^ c) for t, (a, b, c) in zip(total, bits, strict=True)]
            word = [0]
    return np.array(total, float)


def test_language_against_a_plain_version(spark):
    rng = random.Random(21)
    scripts = {"la": "abcdeé", "cy": "абвгдж", "el": "αβγδες", "he": "אבגדהו", "zh": [chr(0x4E00 + i) for i in range(3000)], "und-like": "xyz"}
    rows = []
    for i in range(120):
        lang = rng.choice(sorted(scripts))
        text = " ".join("".join(rng.choice(scripts[lang]) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 12)))
        rows.append((i, rng.choice([text, text.upper(), f"12 {text}!"]), lang if i % 9 else None))
    rows += [(500, "", "la"), (501, "1 2", "cy"), (None, "abc", "la")]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), dim=128).collect()}
    import zlib

    proto = {}
    for i, text, lang in rows:
        if i is not None and lang and zlib.crc32(str(i).encode()) % 4 != 2:
            proto[lang] = proto.get(lang, 0) + plain_profile(text)
    for i, text, _ in rows:
        mine = plain_profile(text)
        assert got[i]["held_out"] == (i is None or zlib.crc32(str(i).encode()) % 4 == 2)
        if not any(c.isalpha() for c in text):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        cosine = {n: float(mine @ p / (np.linalg.norm(mine) * np.linalg.norm(p) + 1e-12)) for n, p in proto.items()}
        best = max(cosine.values())
        assert abs(got[i]["score"] - max(best, 0)) < 1e-4 and cosine[got[i]["lang_pred"]] > best - 1e-4


def test_language_memory_is_bounded():
    """Texts of very many distinct trigrams are profiled a chunk at a time."""
    import tracemalloc

    rng = random.Random(2)
    text = "".join(chr(0x4E00 + rng.randrange(20_000)) for _ in range(60_000))
    tracemalloc.start()
    doc, place, codes, _ = language_id.trigrams([text])
    space = language_id.NgramSpace(2048, 8)
    space.bundles(language_id.counted(doc, place, 1, len(codes)), codes)
    assert len(codes) > 50_000 and tracemalloc.get_traced_memory()[1] < 120 << 20
    tracemalloc.stop()


def test_language_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "more", None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.identify(docs).collect()} == {"und"}


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(None, 3), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in list(root)}


def test_quality_takes_all_labels(spark):
    labels = spark.range(41_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    docs = spark.range(41_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three four five six seven eight nine ten w"), "id").alias("text"))
    known = quality.labelled(labels)
    assert {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()} == {0: 20_500, 1: 20_500}
    measured = docs.select("doc_id", F.lit(50).alias("n_words"), F.lit(0).alias("n_repeat_words"), (F.col("doc_id") % 2 - F.lit(0.5)).alias("score"))
    assert quality.best_threshold(measured, known) == 0.5
    weights = quality.bucket_weights(docs, known, 1, 8.0)
    total, counted = 41_000 * 21, known.where("counted").count() * 21
    assert abs(weights[0] - np.log((counted + 8.0 * counted / total) / (counted / total * (total + 8.0)))) < 1e-12
