import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))

from weftgraph.llm import lexical_search, sharding, token_links

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "  a  b ", "\n\n", "a\tb\r\nc", "▁x ▁", "<s> </s>", "<0x0A> b", "漢字 é́ 😀", "a　 b\xa0 c  d\x85 e", "\x00\x1c\x85 a", "İ ΣΑΣ ß", "x" * 5000, "don't. IT'S 3.5, a.. b., c", "<|endoftext|> a<|endoftext|>", "same words here", "same words here"]


def values(seed, n=120):
    rng = random.Random(seed)
    alpha = " \n\taAßÉΣσ.,'#%漢😀́\xa0 c09<|"
    return ODD + ["".join(rng.choice(alpha) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def rows(spark, texts):
    return spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, shard string")


# --- sharding


def test_shards_take_their_share_and_only_the_new_one_gains(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "k")
    weights = {"a": 1.0, "b": 2.0, "c": 5.0}
    got = sharding.assign(keys, F.col("k"), weights, {"d": 2.0})
    share = {r["shard"]: r["n"] for r in got.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    for s, w in weights.items():
        assert abs(share[s] - 20_000 * w / 8) < 4 * math.sqrt(20_000 * w / 8)
    moved = {r["to_shard"]: r["rows"] for r in sharding.moves(keys, F.col("k"), weights, weights | {"d": 2.0}).groupBy("to_shard").agg(F.sum("rows").alias("rows")).collect()}
    assert set(moved) == {"d"} and abs(moved["d"] - 4000) < 300
    assert got.where("grown_shard <> shard and grown_shard <> 'd'").isEmpty()
    assert sharding.moves(keys, F.col("k"), weights, {"a": 1.0, "b": 2.0}).where("from_shard <> 'c'").isEmpty()
    heavier = sharding.moves(keys, F.col("k"), weights, weights | {"a": 3.0}).where("to_shard <> 'a'")
    assert heavier.isEmpty()


def test_shard_table_on_odd_rows(spark):
    texts = values(1)
    docs = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string").withColumn("slot", F.lit("clash"))
    got = sharding.shard_table(docs, 8).collect()
    assert len(got) == 2 * len(texts)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
        assert r["grown_shard"] in (r["shard"], 8) and r["law"] == "key" and 0 <= r["shard"] < 8
    for some in by.values():
        assert sorted(r["slot"] for r in some) == list(range(len(some)))
        ordered = [(r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"]) for r in sorted(some, key=lambda r: r["slot"])]
        assert ordered == sorted(ordered)
    want = Counter((i if i % 7 else None, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in enumerate(texts))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want + want
    assert sharding.shard_table(docs.limit(0), 8).collect() == []
    with pytest.raises(ValueError):
        sharding.best_shard(F.lit(1), {"a": 0.0})


def test_written_shards_read_back_whole(spark, tmp_path):
    import json

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    weights = {"x": 1.0, "y": 3.0}
    folder = sharding.write_shards(docs, weights, folder=f"file://{tmp_path}/out")
    back = spark.read.parquet(folder)
    assert back.count() == back.select("doc_id").distinct().count() == 3000
    manifest = json.loads((tmp_path / "out" / "_manifest.json").read_text())
    assert {s["name"]: s["rows"] for s in manifest["shards"]} == {r["shard"]: r["n"] for r in back.groupBy("shard").agg(F.count("*").alias("n")).collect()}


# --- links between tokenizers


def plain_links(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    byte = token_links.byte_of()
    b_lib = SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))

    def piece(i):
        return bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode()

    docs = []
    for t in texts:
        t = t or ""
        a = a_lib.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_lib.encode(t) if t else []
        a_bytes, b_bytes = [bytes(byte[c] for c in a_lib.id_to_token(i)) for i in a], [piece(i) for i in b]
        if not (b"".join(a_bytes) == b"".join(b_bytes) == (" " + t).encode()):
            a, b, a_bytes, b_bytes = [], [], [], []
        groups, x, y, left = [], [], [], list(zip(b, b_bytes, strict=True))
        n = m = 0
        for i, s in zip(a, a_bytes, strict=True):
            x.append(i)
            n += len(s)
            while m < n:
                j, s = left.pop(0)
                y.append(j)
                m += len(s)
            if n == m:
                groups.append((x, y))
                x, y = [], []
        docs.append((len(a), len(b), groups))
    count = Counter(p for _, _, groups in docs for p in {(i, j) for x, y in groups for i in x for j in y})
    most = {}
    for (i, _), n in count.items():
        most[i] = max(most.get(i, 0), n)
    out = []
    for na, nb, groups in docs:
        links = [(i, j) for x, y in groups for i in x for j in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((na, nb, len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if na else ""))
    return out


@pytest.mark.parametrize("most_hot", [0, 40, 250_000])
def test_links_are_those_of_a_plain_version(spark, most_hot):
    texts = values(5)
    done = token_links.link_statistics(rows(spark, texts).withColumn("links", F.lit(1)), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), most_hot=most_hot)
    got = {r["doc_id"]: tuple(r)[1:] for r in done.collect()}
    assert [got[i] for i in range(len(texts))] == plain_links(texts)


def test_links_of_the_table(spark):
    from weftgraph.llm.queries import op12_token_links

    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in op12_token_links(spark, SF).collect()}
    assert [got[d["doc_id"]] for d in docs] == plain_links([d["text"] for d in docs])


def test_links_of_nothing_and_of_a_long_word(spark):
    files = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    assert token_links.link_statistics(rows(spark, ["a"]).limit(0), *files).collect() == []
    long = "".join(random.Random(1).choice("abcé") for _ in range(30_000))
    [r] = token_links.link_statistics(rows(spark, [long]), *files).collect()
    assert tuple(r)[1:] == plain_links([long])[0]
    null = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_a"]) for r in token_links.link_statistics(null, *files).collect()) == [(0, 2), (0, 2), (3, 0)]


def test_segments_of_one_shape_are_aligned_once(spark):
    files = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    rng = random.Random(2)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(3, 6))) for _ in range(1500)] + [c * n for c in ("x", "é", "qz") for n in (31, 32, 63, 64, 65, 130)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)] + [" ".join(words)]
    [[shapes, segments]] = token_links.tokenize(rows(spark, texts).coalesce(1), *files).selectExpr("size(shapes)", "size(segments)").collect()
    assert segments >= 300 and shapes < segments / 3
    got = {r["doc_id"]: tuple(r)[1:] for r in token_links.link_statistics(rows(spark, texts), *files).collect()}
    assert [got[i] for i in range(len(texts))] == plain_links(texts)


def test_a_table_of_segments_that_begins_anew(spark):
    align = token_links.Aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    align.table = token_links.WordTable(align._number, bits=5)
    from weftgraph.llm.kernel import Texts
    import pyarrow as pa

    fresh = token_links.Aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    for k in range(6):
        batch = pa.RecordBatch.from_pydict({"text": pa.array(values(k, 40), pa.string())})
        results = []
        for one in (align, fresh):
            (a, ae, an, b, be, bn), place, size = one(Texts(batch, batch.column("text")))
            starts = [np.cumsum(n) - n for n in (an, bn)]
            results.append(([(a[s : s + n].tolist(), b[t : t + m].tolist()) for s, n, t, m in zip(starts[0][place], an[place], starts[1][place], bn[place], strict=True)], size.tolist()))
        assert results[0] == results[1]


# --- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, k):
    tf = [(d, Counter(TERM.findall((t or "").translate(FOLD)))) for d, t in docs]
    df = Counter(w for _, c in tf for w in c)
    n_docs, total = sum(bool(c) for _, c in tf), sum(sum(c.values()) for _, c in tf)
    out = []
    for item, t in items:
        found = []
        for d, c in tf:
            n = sum(c.values())
            m = 10 + (90 * n * n_docs) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(TERM.findall((t or "").translate(FOLD))) if c[w])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k", [1, 3, 10])
@pytest.mark.parametrize("shard_bytes", [1, 300, 1 << 20])
def test_search_is_that_of_a_plain_version(spark, k, shard_bytes):
    rng = random.Random(k)
    words = ["aa", "Bb", "c", "É", "d9", "漢", "long" * 20, "long" * 20 + "x", *(f"w{i}" for i in range(30))]
    docs = [(i if i % 11 else None, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(150)] + [(500 + i, t) for i, t in enumerate(ODD)] + [(7, "aa c c"), (7, "aa c c")]
    items = [(i, ", ".join(rng.choices([*words, "nowhere"], k=rng.randint(0, 9)))) for i in range(12)] + [(50, None), (51, "c" * 3)]
    index = lexical_search.build_index(spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit(1)), shard_bytes=shard_bytes)
    queries = spark.createDataFrame([*items, (None, "aa")], "item_id long, text string")
    for block in (2000, 3):
        got = [tuple(r) for r in lexical_search.search(index, queries, k, block=block).collect()]
        assert sorted(got, key=repr) == plain_search(docs, items, k)


def test_search_in_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(lexical_search.build_index(none), items).collect() == []
    some = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert lexical_search.search(lexical_search.build_index(some), items.limit(0)).collect() == []
    assert lexical_search.search(lexical_search.build_index(some.select("doc_id", F.lit(None).cast("string").alias("text"))), items).collect() == []


def test_numbers_and_postings_read_back():
    rng = np.random.default_rng(3)
    for high in (2, 200, 1 << 20, 1 << 62):
        x = rng.integers(0, high, 500)
        packed, size = lexical_search.pack_numbers(x)
        assert len(packed) == size.sum() and (lexical_search.unpack_numbers(packed) == x).all()
    from weftgraph.llm.kernel import Texts
    import pyarrow as pa

    texts = [" ".join(rng.choice(["a", "b", "c"], rng.integers(0, 300)).tolist()) for _ in range(200)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    terms, n, postings, lengths = lexical_search.postings_of(Texts(batch, batch.column("text")), np.arange(200))
    for term, size, data in zip(terms, n.tolist(), postings, strict=True):
        docs, times = lexical_search.unpack_postings(data)
        want = [(i, t.split().count(term.decode())) for i, t in enumerate(texts) if term.decode() in t]
        assert list(zip(docs.tolist(), times.tolist(), strict=True)) == want and size == len(want)


def test_terms_that_share_a_hash_stay_apart(monkeypatch):
    from weftgraph.llm.kernel import Texts
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": pa.array(["b a a", "a", "c"])})
    monkeypatch.setattr(lexical_search, "term_keys", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    terms, n, postings, _ = lexical_search.postings_of(Texts(batch, batch.column("text")), np.arange(3))
    got = {t: [x.tolist() for x in lexical_search.unpack_postings(p)] for t, p in zip(terms, postings, strict=True)}
    assert got == {b"a": [[0, 1], [2, 1]], b"b": [[0], [1]], b"c": [[2], [1]]}
