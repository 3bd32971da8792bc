"""A workspace of sources written from the star-schema tables, so that the workspace source can be queried over them.

A region is a crate, its nations are modules, and their customers modules of these.  A nation's file defines its port, which the crate's
root re-exports; a customer's file uses the ports of all nations whose suppliers the customer buys from: by path inside
the crate, through the other crate's root elsewhere.  Nations use an external crate as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.sources import tables as t
from weftgraph.sources.workspace import Workspace, WorkspaceOptions

ROOT = "/market"


def _lines(items: str, *more: F.Column) -> F.Column:
    return F.concat_ws("\n", *more, F.sort_array(F.collect_set(items)))


def market_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, text): a file a region, nation and customer."""
    crate = F.replace(F.lower("r_name"), F.lit(" "), F.lit("-"))
    nations = t.table(spark, sf_dir, "nation").join(t.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", crate.alias("crate"), F.lower("n_name").alias("nation")).cache()
    port = F.concat(F.lit("Port"), F.col("n_nationkey"))
    root = nations.withColumn("item", F.concat(F.lit("pub mod "), "nation", F.lit(";\npub use "), "nation", F.lit("::"), port, F.lit(";")))
    roots = root.groupBy("crate").agg(_lines("item").alias("text")).select(F.concat(F.lit(f"{ROOT}/"), "crate", F.lit("/src/lib.rs")).alias("file"), "text")
    customers = t.table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    own = customers.select("n_nationkey", F.concat(F.lit("mod c"), "c_custkey", F.lit(";")).alias("item"))
    first = F.concat_ws("\n", F.lit("use serde::Serialize;"), F.concat(F.lit("pub struct Port"), F.col("n_nationkey"), F.lit(";")))
    inner = nations.join(own.groupBy("n_nationkey").agg(_lines("item").alias("mods")), "n_nationkey", "left")
    middle = inner.select(F.concat(F.lit(f"{ROOT}/"), "crate", F.lit("/src/"), "nation", F.lit(".rs")).alias("file"), F.concat_ws("\n", first, "mods").alias("text"))
    bought = t.trade(spark, sf_dir).select("c_custkey", "s_nationkey").distinct()
    seller = nations.select(F.col("n_nationkey").alias("s_nationkey"), F.col("crate").alias("s_crate"), F.col("nation").alias("s_nation"))
    goods = F.concat(F.lit("Port"), F.col("s_nationkey"), F.lit(";"))
    by = F.when(F.col("crate") == F.col("s_crate"), F.concat(F.lit("use crate::"), "s_nation", F.lit("::"), goods)).otherwise(F.concat(F.lit("use "), F.replace("s_crate", F.lit("-"), F.lit("_")), F.lit("::"), goods))
    uses = customers.join(bought, "c_custkey").join(seller, "s_nationkey").withColumn("item", by).groupBy("c_custkey").agg(_lines("item").alias("text"))
    leaves = customers.join(uses, "c_custkey", "left").select(F.concat(F.lit(f"{ROOT}/"), "crate", F.lit("/src/"), "nation", F.lit("/c"), F.col("c_custkey"), F.lit(".rs")).alias("file"), F.coalesce("text", F.lit("")).alias("text"))
    return roots.union(middle).union(leaves)


def market_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metadata document: every crate needs every other and the external one."""
    crate = F.replace(F.lower("r_name"), F.lit(" "), F.lit("-"))
    regions = t.table(spark, sf_dir, "region").select(crate.alias("name")).agg(F.sort_array(F.collect_list("name")).alias("names"))  # five names
    package = lambda n: F.struct(
        n.alias("name"), F.lit("0.1.0").alias("version"), F.concat(F.lit("id-"), n).alias("id"), F.lit(None).cast("string").alias("source"), F.concat(F.lit(f"{ROOT}/"), n, F.lit("/Cargo.toml")).alias("manifest_path"),
        F.create_map().cast("map<string,array<string>>").alias("features"),
        F.array(F.struct(F.array(F.lit("lib")).alias("kind"), n.alias("name"), F.concat(F.lit(f"{ROOT}/"), n, F.lit("/src/lib.rs")).alias("src_path"))).alias("targets"))
    outside = F.struct(F.lit("serde").alias("name"), F.lit("1.0.0").alias("version"), F.lit("id-serde").alias("id"), F.lit("registry").alias("source"), F.lit("/registry/serde/Cargo.toml").alias("manifest_path"),
        F.create_map().cast("map<string,array<string>>").alias("features"), F.array().cast("array<struct<kind:array<string>,name:string,src_path:string>>").alias("targets"))
    plain = F.array(F.struct(F.lit(None).cast("string").alias("kind")))
    dep = lambda n: F.struct(F.replace(n, F.lit("-"), F.lit("_")).alias("name"), F.concat(F.lit("id-"), n).alias("pkg"), plain.alias("dep_kinds"))
    node = lambda n: F.struct(F.concat(F.lit("id-"), n).alias("id"), F.transform(F.concat(F.filter("names", lambda m: m != n), F.array(F.lit("serde"))), dep).alias("deps"))
    doc = regions.select(
        F.concat(F.transform("names", package), F.array(outside)).alias("packages"), F.transform("names", lambda n: F.concat(F.lit("id-"), n)).alias("workspace_members"),
        F.lit(ROOT).alias("workspace_root"), F.struct(F.transform("names", node).alias("nodes")).alias("resolve"),
    )
    return doc


def market(spark: SparkSession, sf_dir: str, options: WorkspaceOptions = WorkspaceOptions(externals=True)) -> Workspace:
    return Workspace(spark, market_metadata(spark, sf_dir), market_sources(spark, sf_dir), options)
