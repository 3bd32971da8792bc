"""Weighted rendezvous sharding: every record goes to the shard that its key likes best.

Shard s of weight w scores -w / ln(u) with a record, where u in (0, 1) comes from a hash of the record's key and the shard's name; the
highest score wins (the larger name among equals).  A shard's share of the keys is its weight's share, and a score depends on nothing but the key and
that shard: one more shard takes records only into itself, one less gives up only its own, and a shard whose weight grows only gains.

All of it is column expressions: choosing shards neither shuffles nor leaves the JVM.  Slots (places within a shard, without gaps) are numbered by
ranges of (shard, key) with prefix sums, so that neither a shard nor a key that a third of the rows share is ever one task's.

Defined results: a null key is hashed as if its text (or what ``fallback`` gives) were the key, so that rows without one spread out; a null text has no bytes;
repeated rows go to the same shard and take slots of their own; extra columns are kept, but for those that are added, which are replaced; an empty
table stays empty.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.shared import materialize, scratch_path
from weftgraph.operators.numbering import numbered

_DIGITS = 13  # hexadecimal digits of the hash that make up u: 52 bits, which a double holds


def draw(key: Column, shard: str) -> Column:
    """A number in (0, 1) for a record's key and a shard's name."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(":" + shard)))
    return (F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") + 0.5) / float(1 << 4 * _DIGITS)


def best_shard(key: Column, weights: dict[str, float]) -> Column:
    """(score, name) of the shard that a key goes to."""
    if not weights or any(not (w > 0 and math.isfinite(w)) for w in weights.values()):
        raise ValueError("shards need finite weights above 0")
    scored = [F.struct((-float(w) / F.ln(draw(key, s))).alias("score"), F.lit(s).alias("name")) for s, w in weights.items()]
    return F.greatest(*scored) if len(scored) > 1 else scored[0]


def assign(rows: DataFrame, key: Column, weights: dict[str, float], more: dict[str, float] | None = None) -> DataFrame:
    """``rows`` with ``shard``, and with ``grown_shard`` where ``more`` names shards that are added to the others."""
    rows = rows.withColumn("_best", best_shard(key, weights))
    out = rows.withColumn("shard", F.col("_best.name"))
    if more:
        out = out.withColumn("grown_shard", F.greatest("_best", best_shard(key, more))["name"])
    return out.drop("_best")


def stable_key(key: Column, fallback: Column) -> Column:
    """The key as text; where it is null what stands in for it, marked so that no key equals it."""
    return F.coalesce(key.cast("string"), F.concat(F.lit("~"), F.coalesce(fallback.cast("string"), F.lit(""))))


def shard_table(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text", weights: dict[int, float] | None = None) -> DataFrame:
    """One narrow row a document: key, size, text_crc32, law, shard, slot, grown_shard, for shards 0 to n - 1 and one more.

    Texts are read once and never shuffled; what is ranged and numbered is the narrow table.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    narrow = docs.select(F.col(key).alias("_key"), size.alias("size"), crc.alias("text_crc32"))
    share = {str(s): (weights or {}).get(s, 1.0) for s in range(n + 1)}
    last = {str(n): share.pop(str(n))}
    chosen = assign(narrow, stable_key(F.col("_key"), F.col("text_crc32")), share, last)
    chosen = chosen.select(F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), F.col("grown_shard").cast("int"))
    return numbered(materialize(chosen, "sharded"), [key, "text_crc32"], "slot", within=("shard",))


def write_shards(docs: DataFrame, weights: dict[str, float], key: str = "doc_id", folder: str | None = None, rows_per_file: int = 1_000_000, files: int | None = None) -> str:
    """Writes ``docs`` as Parquet, a folder ``shard=NAME`` each, and ``_manifest.json`` (shards, weights, rows); returns the folder.

    Rows are dealt out by shard and by a hash of the whole row, so that large shards are written by many tasks.
    """
    spark = docs.sparkSession
    folder = folder or f"{scratch_path(spark, 'shards')}-{uuid.uuid4().hex[:8]}"
    spread = F.xxhash64(*docs.columns)
    out = assign(docs, stable_key(F.col(key), spread), weights)
    files = files or max(len(weights), int(spark.conf.get("spark.sql.shuffle.partitions")))
    out.repartitionByRange(files, "shard", spread, F.monotonically_increasing_id()).write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(folder)
    counts = {str(r["shard"]): r["n"] for r in spark.read.schema(out.schema).parquet(folder).groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row a shard
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/_manifest.json")
    stream = path.getFileSystem(conf).create(path, True)
    stream.write(bytearray(json.dumps({"shards": [{"name": s, "weight": w, "rows": counts.get(s, 0)} for s, w in weights.items()]}).encode()))
    stream.close()
    return folder


def moves(rows: DataFrame, key: Column, before: dict[str, float], after: dict[str, float]) -> DataFrame:
    """(from_shard, to_shard, rows): what changes its shard when the shards or their weights change."""
    both = rows.select(best_shard(key, before)["name"].alias("from_shard"), best_shard(key, after)["name"].alias("to_shard"))
    return both.where("from_shard <> to_shard").groupBy("from_shard", "to_shard").agg(F.count("*").alias("rows"))
