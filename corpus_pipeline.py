"""From documents to token ids: five stages, each on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.language_id import UNDETERMINED, held_out, identify
from weftgraph.llm.mixing import MixPlan, mix
from weftgraph.llm.ngram_join import near_duplicates
from weftgraph.llm.pii import pseudonymize, session_key
from weftgraph.llm.queries import WEIGHTS, source_domain
from weftgraph.llm.sentencepieces import encode
from weftgraph.llm.shared import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Below this cosine with every language's prototype a text is in none of them, however short.
LEAST_SCORE = 0.02
#: Else the least cosine is this share of a quantile of the scores that training rows of about the same length have with their own language.
SHARE, QUANTILE = 0.35, 0.01
#: A quantile of fewer training rows says nothing.
LEAST_ROWS = 30
#: One pass over the texts at most, and nine tenths of the tokens: no text is repeated.
PLAN = MixPlan(WEIGHTS, share=0.9, max_epochs=1)


#: Rows that Spark hands to a Python worker at once: texts may be long, and workers share an executor's memory with its heap.
ROWS_AT_ONCE = 1000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE)


def least_scores(done: DataFrame, band: Column) -> Column:
    """The least score that a text may have, by its band of length: from the training rows of this band and those beside it, or of the next shorter."""
    rows = done.where(~held_out() & (F.col("lang") == F.col("lang_pred"))).select("score", F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    found = {r["band"]: SHARE * r["q"] for r in rows.groupBy("band").agg(F.percentile_approx("score", QUANTILE, 10_000).alias("q"), F.count("*").alias("n")).where(F.col("n") >= LEAST_ROWS).collect()}  # a row a power of two
    out = F.lit(LEAST_SCORE)
    for at, least in sorted(found.items()):
        out = F.when(band >= at, max(least, LEAST_SCORE)).otherwise(out)
    return out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what is in a known language, and sets lang to it.

    Null, empty and letterless texts are in none; a null id isn't learned from but is judged like any other; repeated rows are judged alike;
    without rows to learn from nothing is kept.
    """
    small_batches(spark)
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    done = identify(docs.select(*COLUMNS)).withColumn("band", F.floor(F.log2(F.greatest(letters, F.lit(1)))).cast("int"))
    done = materialize(done, "scored")
    kept = done.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_scores(done, F.col("band"))))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one text of each class of near duplicates (five words, 0.8): the one with the least id; rows without an id stay."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    classes = near_duplicates(docs, n=5, threshold="0.8")
    first = classes.where("doc_id = component_id").select("doc_id").distinct()
    once = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("source"))
    kept = docs.join(first, "doc_id", "left_semi").withColumn("copy", once).where("copy = 1")
    return kept.select(*COLUMNS).union(docs.where("doc_id is null").select(*COLUMNS))


def private_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces private values in the texts: every row stays, null and empty texts as they are; n_chars follows the text, null where that is."""
    small_batches(spark)
    return pseudonymize(docs.select(*COLUMNS), session_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes from each domain, language and source what the plan gives it; the last text of each is cut to that, and n_chars follows.

    Null and empty texts have no tokens and go with the documents around them; repeated rows are taken together; an empty table stays empty.
    """
    small_batches(spark)
    return mix(docs.select(*COLUMNS), PLAN, source_domain(F.col("source"))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text; its pieces' spans and the decoded text stand beside the ids.  A null text is an empty one: the end id alone."""
    small_batches(spark)
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", "lang", "source"))


STAGES = [("language ID", language), ("n-gram Jaccard join", near_copies), ("PII", private_values), ("mixing", mixture), ("SentencePiece", pieces)]
#: Learned prototypes and a tokenizer: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
