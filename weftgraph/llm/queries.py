"""The numbered operators as queries over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.pii import pseudonymize, session_key

    return pseudonymize(_table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))


#: Production weights of the mixing query and the pipeline.
WEIGHTS = {("web",): 4, ("news",): 2, ("books",): 3, ("forum",): 1, ("*", "en"): 4, ("*", "de"): 2, ("*", "fr"): 2, ("*", "es"): 2}


def source_domain(source: Column) -> Column:
    """Domain of a numbered source."""
    n = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    number = F.when(n != "", n.cast("int"))
    return F.when(number < 5, "web").when(number < 10, "news").when(number < 15, "books").when(number.isNotNull(), "forum").otherwise("unknown")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.mixing import MixPlan, mix

    done = mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), MixPlan(WEIGHTS), source_domain(F.col("source")))
    return done.select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_epoch").alias("epoch"), "n_tokens", "take_tokens", F.length("text").cast("long").alias("n_chars"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.language_id import identify

    return identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op9_metric_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.metric_search import top_k, usable

    return top_k(usable(_table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, k=5)


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weftgraph.llm.token_store import positions, read_ids, write_ids

    folder = write_ids(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return positions(read_ids(spark, folder, with_ids=False)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.quality import judge

    done = judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.suffix_dedup import remove_repeats

    done = remove_repeats(_table(spark, sf_dir, "documents"), width=400)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.ngram_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), n=4, threshold="0.85")


OP3_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 3], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
r AS (SELECT a AS doc_id, b AS c FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, coalesce((SELECT min(c) FROM r WHERE r.doc_id = d.doc_id), d.doc_id)) AS BIGINT) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""


def op4_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.block_dedup import remove_repeats

    done = remove_repeats(_table(spark, sf_dir, "documents"), width=50)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
low AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN low USING (h) WHERE m < doc_id),
per AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, len(ws) AS n, coalesce(len(ps), 0) AS r,
                CASE WHEN ps IS NULL THEN array_to_string(ws, ' ')
                     ELSE array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(ps, i)), lambda i: ws[i]), ' ') END AS t
         FROM d LEFT JOIN per USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM kept
"""


def op5_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weftgraph.llm.sentencepieces import encode

    done = encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    # the byte spans of the pieces: all first bytes, then all ends
    spans = F.sha2(F.concat_ws(" ", F.col("begins").cast("array<string>"), F.col("ends").cast("array<string>")), 256)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), spans.alias("spans_sha256"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.sharding import shard_table

    return shard_table(_table(spark, sf_dir, "documents"), 8).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


OP11_SQL = """
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(list_concat([4294967295], bytes), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, crc),
s AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '~' || text_crc32) AS k FROM c),
t AS (SELECT *, list_transform(range(9), lambda j: {'score': -1 / ln((CAST('0x' || substr(md5(k || ':' || j), 1, 13) AS BIGINT) + 0.5) / 4503599627370496), 'shard': j}) AS scores FROM s),
b AS (SELECT doc_id, size, text_crc32, list_max(scores[:8]) AS best, list_max(scores) AS grown FROM t)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(best.shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY best.shard ORDER BY doc_id NULLS FIRST, text_crc32) - 1 AS slot, CAST(grown.shard AS INTEGER) AS grown_shard
FROM b
"""


def op12_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weftgraph.llm.token_links import link_statistics

    return link_statistics(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.lexical_search import build_index, search

    return search(build_index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"), k=10)


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) GROUP BY ALL),
st AS (SELECT count(*) FILTER (len(ws) > 0) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM d),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, st GROUP BY term, n_docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
m AS (SELECT r, doc_id, 10 + (90 * len(ws) * n_docs) // n_terms AS m FROM d, st),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_ngram_join": op3_ngram_join,
    "op4_block_dedup": op4_block_dedup,
    "op5_sentencepieces": op5_sentencepieces,
    "op6_pseudonyms": op6_pseudonyms,
    "op7_mixing": op7_mixing,
    "op8_language_id": op8_language_id,
    "op9_metric_search": op9_metric_search,
    "op10_token_store": op10_token_store,
    "op11_sharding": op11_sharding,
    "op12_token_links": op12_token_links,
    "op13_lexical_search": op13_lexical_search,
}
ORACLES: dict[str, str] = {
    "op3_ngram_join": OP3_SQL,
    "op4_block_dedup": OP4_SQL,
    "op9_metric_search": OP9_SQL,
    "op11_sharding": OP11_SQL,
    "op13_lexical_search": OP13_SQL,
}
