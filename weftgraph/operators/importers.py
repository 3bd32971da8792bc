"""Who uses which symbol: symbols with one and the same set of consumers, and how far that set reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.columns import is_production_module_dep
from weftgraph.scratch import settle


def symbol_uses(edges: DataFrame) -> DataFrame:
    """(provider, symbol, consumer) of production module dependencies, re-exports left out."""
    at = edges.where(is_production_module_dep()).select("src", "dst", F.explode("locations").alias("x")).where("not x.via_reexport")
    return at.select(F.col("dst").alias("provider"), F.explode("x.symbols").alias("symbol"), F.col("src").alias("consumer")).distinct()


def importer_partition(uses: DataFrame) -> DataFrame:
    """(provider, symbol, consumers): the sorted consumer set of each symbol."""
    return uses.groupBy("provider", "symbol").agg(F.sort_array(F.collect_set("consumer")).alias("consumers"))


def set_id() -> Column:
    """A consumer set's id: two independent hashes of its members in order."""
    return F.struct(F.xxhash64("consumers").alias("a"), F.xxhash64(F.lit("second"), F.reverse("consumers")).alias("b"))


def symbol_clusters(partition: DataFrame) -> DataFrame:
    """(provider, consumers, symbols): symbols that have the same consumer set."""
    return partition.groupBy("provider", "consumers").agg(F.sort_array(F.collect_list("symbol")).alias("symbols"))


def deepest_common(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(set_id, common): the deepest module that all of a set lie in (or are); none where they share a crate only.

    Relational division: ancestors are counted for each set, and one that all members have stays.  ``sets``: set_id, consumers.
    """
    crate = nodes.where("kind = 'module'").select(F.col("node_id").alias("anc"), "depth")
    line = nodes.select(F.col("node_id").alias("member"), F.explode(F.concat("ancestors", F.array("node_id"))).alias("anc"))
    whole = sets.dropDuplicates(["set_id"])
    each = whole.select("set_id", F.size("consumers").alias("n"), F.explode("consumers").alias("member"))
    shared = each.join(line, "member").join(crate, "anc").groupBy("set_id", "n", "anc", "depth").agg(F.count("*").alias("have")).where("have = n")
    return shared.groupBy("set_id").agg(F.max_by("anc", "depth").alias("common"))


def consumer_scopes(clusters: DataFrame, nodes: DataFrame) -> DataFrame:
    """``clusters`` with scope and scope_node: the single consumer, or the common ancestor that the provider lies outside of, else crate-wide."""
    above = nodes.select(F.col("node_id").alias("provider"), F.concat("ancestors", F.array("node_id")).alias("line"))
    clusters = settle(clusters.withColumn("set_id", F.when(F.size("consumers") > 1, set_id())))  # read twice
    several = clusters.where("set_id is not null")
    found = several.join(deepest_common(several.select("set_id", "consumers"), nodes), "set_id", "left").join(above, "provider", "left")
    alone = clusters.where("set_id is null").withColumns({"common": F.lit(None).cast("long"), "line": F.lit(None).cast("array<long>")})  # no ancestor is asked for
    if not nodes.groupBy("node_id").count().where("count > 1").isEmpty():
        alone = alone.join(above.select("provider"), "provider", "left")  # a cluster comes once for each node that its provider's id has
    joined = found.unionByName(alone)
    one, outside = F.size("consumers") == 1, F.col("common").isNotNull() & ~F.coalesce(F.array_contains("line", F.col("common")), F.lit(False))
    scope = F.when(one, "single_consumer").when(outside, "common_ancestor").otherwise("crate_wide")
    node = F.when(one, F.get("consumers", F.lit(0))).when(outside, F.col("common"))
    return joined.select("provider", "consumers", "symbols", scope.alias("scope"), node.alias("scope_node"))
