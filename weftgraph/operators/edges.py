"""From references to edges, and what is read off single edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.columns import is_production_crate_dep, is_production_module_dep, is_pure_reexport, symbol_weight
from weftgraph.schema import CRATE_DEP, MODULE_DEP, PRODUCTION


def dedup_first_wins(refs: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The first row of each key: its ``keep`` columns, all features one after the other, and whether all rows are re-exports."""
    first = F.min_by(F.struct(*keep), F.struct(*order))
    features = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(*order, "features"))), lambda x: x["features"]))
    return refs.groupBy(*keys).agg(first.alias("first"), features.alias("features"), F.bool_and("via_reexport").alias("via_reexport")).select(*keys, "first.*", "features", "via_reexport")


def aggregate_edges(refs: DataFrame) -> DataFrame:
    """One module dependency for each (src, dst) of resolved refs (src, dst, source_file, line, symbol, module_path, via_reexport, ctx_kind, ctx_sub_kind, features, ord).

    Self-references go.  Any production reference makes the edge production, without features; else the
    first one's context holds.  Locations are one a (file, line), in order, with their symbols in order of arrival.
    """
    production = F.col("ctx_kind") == PRODUCTION
    context = F.when(~F.coalesce(production, F.lit(False)), F.struct("ord", "ctx_kind", "ctx_sub_kind", "features"))  # asked for only where no reference is production
    place = ["source_file", "line", "ord", "symbol", "module_path", "via_reexport"]
    slim = refs.where("src <> dst").select("src", "dst", *place, production.alias("production"), context.alias("context"))
    edges = slim.repartition("src", "dst").groupBy("src", "dst").agg(  # the one shuffle and grouping: lines are told apart in an edge's sorted references
        F.sort_array(F.collect_list(F.struct(*place))).alias("refs"), F.bool_or("production").alias("production"), F.min("context").alias("first"))
    return edges.select(
        "src", "dst", F.lit(MODULE_DEP).alias("edge_type"),
        F.when(F.col("production"), PRODUCTION).otherwise(F.col("first.ctx_kind")).alias("ctx_kind"),
        F.when(~F.col("production"), F.col("first.ctx_sub_kind")).alias("ctx_sub_kind"),
        F.when(F.col("production"), F.array().cast("array<string>")).otherwise(F.col("first.features")).alias("features"),
        _locations("refs").alias("locations"),
    )


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _locations(refs: str) -> Column:
    """One location a (file, line) of the references in column ``refs``, which are sorted by file, line and ord."""
    same = lambda i, name: F.equal_null(F.get(refs, i)[name], F.get(refs, i - 1)[name])
    begins = F.filter(F.sequence(F.lit(0), F.size(refs) - 1), lambda i: (i == 0) | ~(same(i, "source_file") & same(i, "line")))
    location = lambda own: F.struct(
        own[0]["source_file"].alias("file"), own[0]["line"].alias("line"),
        F.transform(F.filter(own, lambda x: x["symbol"].isNotNull()), lambda x: x["symbol"]).alias("symbols"),
        F.get(F.filter(own, lambda x: x["ord"].isNotNull()), F.lit(0))["module_path"].alias("module_path"),
        F.array_min(F.transform(own, lambda x: x["via_reexport"])).alias("via_reexport"),
    )
    return _once(begins, lambda b: F.transform(b, lambda i, k: _once(F.slice(refs, i + 1, F.coalesce(F.get(b, k + 1), F.size(refs)) - i), location)))


def edge_facts(refs: DataFrame) -> DataFrame:
    """What ``aggregate_edges`` knows of each edge but its locations: src, dst, edge_type, ctx_kind, ctx_sub_kind, n_locations, reexport.

    Counts and flags only: no list of an edge's references is ever gathered.  reexport: a production edge all of whose locations re-export.
    """
    refs = refs.where("src <> dst")
    lines = refs.groupBy("src", "dst", "source_file", "line").agg(
        F.bool_and("via_reexport").alias("reexport"), F.bool_or(F.col("ctx_kind") == PRODUCTION).alias("production"),
        F.min(F.struct("ord", "ctx_kind", "ctx_sub_kind")).alias("first"),
    )
    whole = lines.groupBy("src", "dst").agg(F.count("*").alias("n_locations"), F.bool_and("reexport").alias("reexport"), F.bool_or("production").alias("production"), F.min("first").alias("first"))
    return whole.select(
        "src", "dst", F.lit(MODULE_DEP).alias("edge_type"), F.when(F.col("production"), PRODUCTION).otherwise(F.col("first.ctx_kind")).alias("ctx_kind"),
        F.when(~F.col("production"), F.col("first.ctx_sub_kind")).alias("ctx_sub_kind"), "n_locations", (F.col("production") & F.col("reexport")).alias("reexport"),
    )


def ref_weights(refs: DataFrame) -> DataFrame:
    """``edge_weights`` of single references: an edge's distinct symbols, and one more if some location names none."""
    refs = refs.where("src <> dst")
    symbols = refs.where("symbol is not null").groupBy("src", "dst").agg(F.count_distinct("symbol").alias("named"))
    bare = refs.groupBy("src", "dst", "source_file", "line").agg(F.count("symbol").alias("n")).groupBy("src", "dst").agg(F.max((F.col("n") == 0).cast("int")).alias("bare"))
    return bare.join(symbols, ["src", "dst"], "left").select("src", "dst", (F.coalesce("named", F.lit(0)) + F.col("bare")).alias("refs"))


def usage_counts(refs: DataFrame) -> DataFrame:
    """(src, dst, symbol, n, via_reexport): what ``usage_groups`` lists, counted; only a line's own symbols are gathered."""
    refs = refs.where("src <> dst")
    lines = refs.groupBy("src", "dst", "source_file", "line").agg(F.collect_set("symbol").alias("symbols"), F.bool_and("via_reexport").alias("via_reexport"))
    named = lines.select("src", "dst", "via_reexport", F.explode_outer("symbols").alias("symbol")).na.fill("", ["symbol"])
    return named.groupBy("src", "dst", "symbol").agg(F.count("*").alias("n"), F.bool_and("via_reexport").alias("via_reexport"))


def production_subgraph(edges: DataFrame) -> DataFrame:
    return edges.where(is_production_module_dep()).select("src", "dst").distinct()


def logic_subgraph(edges: DataFrame) -> DataFrame:
    """Production module dependencies but those that only re-export."""
    return edges.where(is_production_module_dep() & ~is_pure_reexport()).select("src", "dst").distinct()


def cycle_subgraph(edges: DataFrame, include_reexports: bool = False) -> DataFrame:
    return production_subgraph(edges) if include_reexports else logic_subgraph(edges)


def edge_weights(edges: DataFrame) -> DataFrame:
    """(src, dst, refs): the symbols of each module dependency; 0 where there is none."""
    named = F.when(F.col("edge_type") == MODULE_DEP, symbol_weight(F.col("locations"))).otherwise(0)
    return edges.groupBy("src", "dst").agg(F.max(named).alias("refs"))


def suppress_implied_crate_deps(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Without crate dependencies between crates of which module dependencies already tell (the same way round)."""
    of = nodes.select("node_id", F.coalesce("crate_id", "node_id").alias("crate"))
    crates = edges.join(of.toDF("src", "src_crate"), "src").join(of.toDF("dst", "dst_crate"), "dst")
    told = crates.where(F.col("edge_type") == MODULE_DEP).select("src_crate", "dst_crate").distinct()
    kept = crates.where(F.col("edge_type") == CRATE_DEP).join(told, ["src_crate", "dst_crate"], "left_anti")
    return crates.where(F.col("edge_type") != CRATE_DEP).unionByName(kept).drop("src_crate", "dst_crate").select(*edges.columns)


def cycle_kind(cyclic: DataFrame, edges: DataFrame) -> DataFrame:
    """``cyclic`` edges with kind: direct if a module dependency leads straight back, else transitive."""
    back = edges.where(F.col("edge_type") == MODULE_DEP).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("back")).distinct()
    kind = F.when((F.col("edge_type") == MODULE_DEP) & F.col("back"), "direct").otherwise("transitive")
    return cyclic.join(back, ["src", "dst"], "left").withColumn("kind", kind).drop("back")


def crate_weights(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, weight): production edges between different crates."""
    of = nodes.where("kind <> 'external'").select("node_id", F.coalesce("crate_id", "node_id").alias("crate"))
    kept = edges.where(is_production_module_dep() | is_production_crate_dep())
    pairs = kept.join(of.toDF("src", "a"), "src").join(of.toDF("dst", "b"), "dst").where("a <> b")
    return pairs.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").alias("weight"))


def sibling_weights(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(parent, src, dst, weight): production module dependencies from the subtree of one sibling into another's."""
    up = nodes.select("node_id", F.concat("ancestors", F.array("node_id")).alias("line"))
    both = edges.where(is_production_module_dep()).join(up.toDF("src", "a"), "src").join(up.toDF("dst", "b"), "dst")
    split = F.array_min(F.filter(F.sequence(F.lit(0), F.least(F.size("a"), F.size("b")) - 1), lambda i: F.get(F.col("a"), i) != F.get(F.col("b"), i)))
    placed = both.withColumn("at", split).where(F.col("at").isNotNull())
    parent = F.when(F.col("at") > 0, F.get("a", F.col("at") - 1))
    return placed.groupBy(parent.alias("parent"), F.get("a", F.col("at")).alias("src"), F.get("b", F.col("at")).alias("dst")).agg(F.count("*").alias("weight"))


def incoming_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("incoming"))


def usage_groups(edges: DataFrame) -> DataFrame:
    """(src, dst, symbol, locations, via_reexport): locations by symbol, those without a symbol under ''."""
    x = edges.select("src", "dst", F.explode("locations").alias("x")).select("src", "dst", "x.*")
    named = x.withColumn("symbol", F.explode_outer("symbols")).withColumn("symbol", F.coalesce("symbol", F.lit("")))
    return named.groupBy("src", "dst", "symbol").agg(F.sort_array(F.collect_set(F.struct("file", "line"))).alias("locations"), F.min("module_path").alias("module_path"), F.bool_and("via_reexport").alias("via_reexport"))


def pick_top(edges: DataFrame, n: int) -> DataFrame:
    """The ``n`` heaviest edges of each source; of equals the smaller target."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return edges.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")
