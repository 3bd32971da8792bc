"""Property graphs derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.operators.hierarchy import with_paths
from weftgraph.schema import MODULE_DEP, PRODUCTION, PropertyGraph

NATION, CUSTOMER, SUPPLIER, ORDER = 100, 1_000_000, 2_000_000_000, 1_000_000_000_000  # first ids of the levels
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def brand_id() -> F.Column:
    return F.substring("p_brand", 7, 10).cast("long")


def net(pairs: DataFrame) -> DataFrame:
    """A report: the pairs (src, dst, weight) that outweigh their way back."""
    back = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("back"))
    return pairs.join(back, ["src", "dst"], "left").where(F.col("weight") > F.coalesce("back", F.lit(0))).drop("back")


def brand_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight): which brand follows which within an order, all pairs both ways."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), brand_id().alias("brand"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER).join(parts, "l_partkey")
    following = lines.select(F.col("brand").alias("src"), F.lead("brand").over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)).alias("dst"))
    return following.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with customer, supplier and their nations."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return table(spark, sf_dir, "lineitem").join(orders, "l_orderkey").join(customers, "c_custkey").join(suppliers, "l_suppkey")


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight): customers' nation to suppliers' nation, all pairs that trade."""
    pairs = trade(spark, sf_dir).where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst"))
    return pairs.agg(F.count("*").alias("weight"))


def purchase_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): customers to the suppliers that they bought from."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") + CUSTOMER).alias("src"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") + SUPPLIER).alias("dst")).join(orders, "l_orderkey").select("src", "dst").distinct()


def user_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight): whose event follows whose, over all events in order.

    Days are windows of their own; the last event of a day is followed by the first of the next day that has
    any, which is found among one row a day.
    """
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.to_date("ts").alias("day"))
    order = ["ts", "event_id"]
    inside = events.select("day", F.col("user_id").alias("src"), F.lead("user_id").over(Window.partitionBy("day").orderBy(*order)).alias("dst"))
    ends = events.groupBy("day").agg(F.min_by("user_id", F.struct(*order)).alias("first"), F.max_by("user_id", F.struct(*order)).alias("last"))
    across = ends.select("day", F.col("last").alias("src"), F.lead("first").over(Window.orderBy("day")).alias("dst"))
    both = inside.where("dst is not null").union(across)
    return both.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def place_nodes(spark: SparkSession, sf_dir: str, levels: int = 4, suppliers: bool = False) -> DataFrame:
    """Regions (crates), nations, customers and orders (modules) as a hierarchy with paths."""
    none = F.lit(None).cast("long")
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    crate_of = nation.select(F.col("n_nationkey").alias("nk"), F.col("n_regionkey").cast("long").alias("crate_id"))
    parts = [
        region.select(F.col("r_regionkey").cast("long").alias("node_id"), F.lit("crate").alias("kind"), F.col("r_name").alias("name"), none.alias("crate_id"), none.alias("parent_id")),
        nation.select((F.col("n_nationkey") + NATION).cast("long").alias("node_id"), F.lit("module").alias("kind"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("crate_id"), F.col("n_regionkey").cast("long").alias("parent_id")),
    ]
    customers = table(spark, sf_dir, "customer").join(crate_of, F.col("c_nationkey") == F.col("nk"))
    if levels > 2:
        parts.append(customers.select((F.col("c_custkey") + CUSTOMER).alias("node_id"), F.lit("module").alias("kind"), F.concat(F.lit("c"), F.col("c_custkey")).alias("name"), "crate_id", (F.col("c_nationkey") + NATION).cast("long").alias("parent_id")))
    if levels > 3:
        orders = table(spark, sf_dir, "orders").join(customers.select("c_custkey", "crate_id"), F.col("o_custkey") == F.col("c_custkey"))
        parts.append(orders.select((F.col("o_orderkey") + ORDER).alias("node_id"), F.lit("module").alias("kind"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("name"), "crate_id", (F.col("o_custkey") + CUSTOMER).alias("parent_id")))
    if suppliers:
        s = table(spark, sf_dir, "supplier").join(crate_of, F.col("s_nationkey") == F.col("nk"))
        parts.append(s.select((F.col("s_suppkey") + SUPPLIER).alias("node_id"), F.lit("module").alias("kind"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("name"), "crate_id", (F.col("s_nationkey") + NATION).cast("long").alias("parent_id")))
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.unionByName(p)
    return with_paths(nodes)


def trade_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved references: a customer uses a supplier's nation; a symbol is a part's type, a file a part."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    t = trade(spark, sf_dir).join(parts, "l_partkey")
    return t.select(
        (F.col("c_custkey") + CUSTOMER).alias("src"), (F.col("s_nationkey") + NATION).cast("long").alias("dst"),
        F.concat(F.lit("part"), F.col("l_partkey")).alias("source_file"), F.col("l_linenumber").alias("line"), F.col("p_type").alias("symbol"), F.col("p_brand").alias("module_path"),
        (F.col("l_returnflag") == "R").alias("via_reexport"), F.when(F.col("o_orderstatus") == "F", PRODUCTION).otherwise("test").alias("ctx_kind"),
        F.when(F.col("o_orderstatus") != "F", "unit").alias("ctx_sub_kind"), F.array(F.col("l_linestatus")).alias("features"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("ord"),
    )


def as_edges(pairs: DataFrame, edge_type: str = MODULE_DEP, shift: int = 0) -> DataFrame:
    """Production edges without locations from (src, dst)."""
    places = F.array().cast("array<struct<file:string,line:int,symbols:array<string>,module_path:string,via_reexport:boolean>>")
    return pairs.select((F.col("src") + shift).alias("src"), (F.col("dst") + shift).alias("dst"), F.lit(edge_type).alias("edge_type"), F.lit(PRODUCTION).alias("ctx_kind"), F.lit(None).cast("string").alias("ctx_sub_kind"), F.array().cast("array<string>").alias("features"), places.alias("locations"))


def nation_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions and nations; every pair of nations that trade is a module dependency."""
    return PropertyGraph(place_nodes(spark, sf_dir, levels=2), as_edges(nation_edges(spark, sf_dir), shift=NATION)).cache()


def brand_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """One crate whose modules are the brands."""
    brands = table(spark, sf_dir, "part").select(brand_id().alias("node_id"), F.col("p_brand").alias("name")).distinct()
    root = spark.createDataFrame([(0, "crate", "shop", None, None)], "node_id long, kind string, name string, crate_id long, parent_id long")
    nodes = root.unionByName(brands.select("node_id", F.lit("module").alias("kind"), "name", F.lit(0).cast("long").alias("crate_id"), F.lit(0).cast("long").alias("parent_id")))
    return PropertyGraph(with_paths(nodes), as_edges(brand_edges(spark, sf_dir))).cache()


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as changes of files (parts)."""
    status = F.when(F.col("l_returnflag") == "N", "D").otherwise(F.col("l_returnflag"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("commit_ts"), F.concat(F.lit("part"), F.col("l_partkey")).alias("file"), status.alias("status"))


