"""The graph operators as queries over the star-schema tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import columns as C
from weftgraph.operators import cycles as cy
from weftgraph.operators import edges as ed
from weftgraph.operators import feedback as fb
from weftgraph.operators import hierarchy as hi
from weftgraph.operators import importers as im
from weftgraph.operators import layout as la
from weftgraph.operators import lookup as lo
from weftgraph.operators import order as od
from weftgraph.operators import reach as re_
from weftgraph.operators import rules as ru
from weftgraph.operators import views as vi
from weftgraph.operators import volatility as vo
from weftgraph.operators.numbering import numbered
from weftgraph.schema import CONTAINS, CRATE_DEP, MODULE_DEP, PropertyGraph
from weftgraph.scratch import settle, shared_dir
from weftgraph.sources import tables as t
from weftgraph.sources.history import RECORD, change_log
from weftgraph.sources.table_workspace import market

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


LINE = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
BRAND_ALL = f"""follow AS (SELECT CAST(substr(p_brand, 7) AS BIGINT) AS src, lead(CAST(substr(p_brand, 7) AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY {LINE}) AS dst
  FROM lineitem JOIN part ON l_partkey = p_partkey),
brand_all AS (SELECT src, dst, count(*) AS weight FROM follow WHERE src <> dst GROUP BY ALL)"""
NET = "SELECT x.src, x.dst, x.weight FROM {0} x LEFT JOIN {0} y ON x.src = y.dst AND x.dst = y.src WHERE x.weight > coalesce(y.weight, 0)"
BRAND = BRAND_ALL + ",\ng AS (SELECT * FROM brand_all)"
NATION_ALL = """nation_all AS (SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, count(*) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY ALL)"""
NATION = NATION_ALL + ",\ng AS (SELECT * FROM nation_all)"
PURCHASE = "g AS (SELECT DISTINCT o_custkey + 1000000 AS src, l_suppkey + 2000000000 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
USER = """follow AS (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events),
g AS (SELECT src, dst, count(*) AS weight FROM follow WHERE src <> dst GROUP BY ALL)"""
#: SCC by closure, cyclic edges, breadth-first distances with the least predecessor as parent, paths, turned to their least node.
CYCLES = """r AS (SELECT src AS a, dst AS b FROM g UNION SELECT r.a, g.dst FROM r JOIN g ON r.b = g.src),
scc AS (SELECT x.a AS node_id, min(x.b) AS scc_id FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
multi AS (SELECT node_id, scc_id FROM scc WHERE scc_id IN (SELECT scc_id FROM scc GROUP BY scc_id HAVING count(*) > 1)),
e AS (SELECT g.src, g.dst, x.scc_id FROM g JOIN multi x ON g.src = x.node_id JOIN multi y ON g.dst = y.node_id AND x.scc_id = y.scc_id),
dist(v, w, d) USING KEY (v, w) AS (SELECT DISTINCT dst, dst, 0 FROM e
  UNION SELECT dist.v, e.dst, min(dist.d) + 1 FROM dist JOIN e ON e.src = dist.w LEFT JOIN recurring.dist k ON k.v = dist.v AND k.w = e.dst WHERE k.v IS NULL GROUP BY dist.v, e.dst),
parent AS (SELECT x.v, e.dst AS w, min(e.src) AS p FROM dist x JOIN e ON e.src = x.w JOIN dist y ON y.v = x.v AND y.w = e.dst AND y.d = x.d + 1 GROUP BY x.v, e.dst),
path AS (SELECT v, v AS w, [v] AS ns FROM (SELECT DISTINCT v FROM dist) UNION ALL SELECT path.v, p.w, list_append(path.ns, p.w) FROM path JOIN parent p ON p.v = path.v AND p.p = path.w),
ring AS (SELECT e.scc_id, e.src, e.dst, path.ns AS ns FROM e JOIN path ON path.v = e.dst AND path.w = e.src),
turned AS (SELECT scc_id, src, dst, ns[list_position(ns, list_min(ns)):] || ns[:list_position(ns, list_min(ns)) - 1] AS ns FROM ring),
cycle AS (SELECT DISTINCT scc_id, ns FROM turned),
arcs AS (SELECT scc_id, ns, unnest(ns) AS src, unnest(ns[2:] || ns[:1]) AS dst FROM cycle)"""
PLACES = """nodes AS (SELECT CAST(r_regionkey AS BIGINT) AS node_id, r_name AS qualified_name, r_name AS name, 0 AS depth, NULL AS parent_id, CAST(r_regionkey AS BIGINT) AS region, 'crate' AS kind FROM region
UNION ALL SELECT n_nationkey + 100, r_name || '::' || n_name, n_name, 1, n_regionkey, n_regionkey, 'module' FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT c_custkey + 1000000, r_name || '::' || n_name || '::c' || c_custkey, 'c' || c_custkey, 2, c_nationkey + 100, n_regionkey, 'module' FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT o_orderkey + 1000000000000, r_name || '::' || n_name || '::c' || c_custkey || '::o' || o_orderkey, 'o' || o_orderkey, 3, c_custkey + 1000000, n_regionkey, 'module' FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
REFS = """refs AS (SELECT c_custkey + 1000000 AS src, CAST(s_nationkey + 100 AS BIGINT) AS dst, 'part' || l_partkey AS file, l_linenumber AS line, p_type AS symbol, p_brand AS module_path,
  l_returnflag = 'R' AS reexport, o_orderstatus = 'F' AS production, (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS ord
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
loc AS (SELECT src, dst, file, line, bool_and(reexport) AS reexport, bool_or(production) AS production FROM refs GROUP BY ALL),
edge AS (SELECT src, dst, count(*) AS n_locations, bool_and(reexport) AS all_reexport, bool_or(production) AS production FROM loc GROUP BY ALL),
refsum AS (SELECT src, dst, count(DISTINCT symbol) AS refs FROM refs GROUP BY ALL)"""


# --- edges


@query(f"WITH {BRAND} SELECT * FROM g")
def dep_edges_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.brand_edges(spark, sf_dir)


@query(f"WITH {NATION} SELECT * FROM g")
def dep_edges_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.nation_edges(spark, sf_dir)


@query(f"WITH {USER} SELECT * FROM g")
def dep_edges_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.user_edges(spark, sf_dir)


@query(f"WITH {BRAND_ALL} SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM brand_all) WHERE k <= 2")
def top_targets_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report: the two brands that follow each brand most."""
    return ed.pick_top(t.brand_edges(spark, sf_dir), 2)


@query(f"WITH {BRAND_ALL} {NET.format('brand_all')}")
def net_edges_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report: which brand mostly follows which."""
    return t.net(t.brand_edges(spark, sf_dir))


@query(f"WITH {NATION_ALL} {NET.format('nation_all')}")
def net_edges_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report: the way that more is traded."""
    return t.net(t.nation_edges(spark, sf_dir))


@query("""SELECT l_suppkey, l_partkey, arg_min(l_orderkey, (l_shipdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice)) AS l_orderkey,
  string_agg(l_linestatus, ',' ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_linestatus) AS features, bool_and(l_returnflag = 'R') AS via_reexport FROM lineitem GROUP BY l_suppkey, l_partkey""")
def edge_dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]
    refs = t.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", *order, F.array("l_linestatus").alias("features"), (F.col("l_returnflag") == "R").alias("via_reexport"))
    done = ed.dedup_first_wins(refs, ["l_suppkey", "l_partkey"], order, ["l_orderkey"])
    return done.withColumn("features", F.array_join("features", ","))


@query(f"WITH {REFS} SELECT src, dst, CASE WHEN production THEN 'production' ELSE 'test' END AS ctx_kind, CASE WHEN NOT production THEN 'unit' END AS ctx_sub_kind, n_locations FROM edge")
def edge_context_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.edge_facts(t.trade_refs(spark, sf_dir)).select("src", "dst", "ctx_kind", "ctx_sub_kind", "n_locations")


@query(f"WITH {REFS} SELECT src, dst, refs FROM refsum")
def edge_symbol_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.ref_weights(t.trade_refs(spark, sf_dir)).select("src", "dst", F.col("refs").cast("long").alias("refs"))


@query(f"WITH {REFS} SELECT src, dst, production AND all_reexport AS reexport FROM edge")
def reexport_edge_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.edge_facts(t.trade_refs(spark, sf_dir)).select("src", "dst", "reexport")


@query(f"WITH {REFS} SELECT src, dst FROM edge WHERE production AND NOT all_reexport")
def logic_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.edge_facts(t.trade_refs(spark, sf_dir)).where(C.is_production_module_dep() & ~F.col("reexport")).select("src", "dst")


@query("""WITH c AS (SELECT o_custkey + 1000000 AS src, l_suppkey + 2000000000 AS dst, bool_or(l_returnflag = 'R') AS told FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT src, dst FROM c WHERE NOT told""")
def crate_dep_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers are crates, orders modules of their customers; what was returned is a module dependency."""
    none = F.lit(None).cast("long")
    makers = t.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + t.SUPPLIER).alias("node_id"), none.alias("crate_id"))
    customers = t.table(spark, sf_dir, "customer").select((F.col("c_custkey") + t.CUSTOMER).alias("node_id"), none.alias("crate_id"))
    orders = t.table(spark, sf_dir, "orders").select((F.col("o_orderkey") + t.ORDER).alias("node_id"), (F.col("o_custkey") + t.CUSTOMER).alias("crate_id"))
    lines = t.table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") + t.SUPPLIER).alias("dst"), "l_returnflag").join(t.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    crates = t.as_edges(lines.select((F.col("o_custkey") + t.CUSTOMER).alias("src"), "dst").distinct(), CRATE_DEP)
    modules = t.as_edges(lines.where("l_returnflag = 'R'").select((F.col("l_orderkey") + t.ORDER).alias("src"), "dst").distinct())
    kept = ed.suppress_implied_crate_deps(crates.unionByName(modules), makers.union(customers).union(orders))
    return kept.where(F.col("edge_type") == CRATE_DEP).select("src", "dst")


@query("""WITH c AS (SELECT r.r_regionkey AS a, q.r_regionkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation n ON c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey JOIN nation m ON s_nationkey = m.n_nationkey JOIN region q ON m.n_regionkey = q.r_regionkey WHERE c_nationkey <> s_nationkey GROUP BY n.n_nationkey, m.n_nationkey, a, b)
SELECT CAST(a AS BIGINT) AS src, CAST(b AS BIGINT) AS dst, count(*) AS weight FROM c WHERE a <> b GROUP BY ALL""")
def crate_edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = t.nation_graph(spark, sf_dir)
    return ed.crate_weights(g.edges, g.nodes)


@query(f"""WITH {NATION_ALL}, s AS (SELECT CASE WHEN a.n_regionkey = b.n_regionkey THEN a.n_regionkey END AS parent, CASE WHEN a.n_regionkey = b.n_regionkey THEN src + 100 ELSE a.n_regionkey END AS src, CASE WHEN a.n_regionkey = b.n_regionkey THEN dst + 100 ELSE b.n_regionkey END AS dst
  FROM nation_all JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey)
SELECT CAST(parent AS BIGINT) AS parent, CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, count(*) AS weight FROM s GROUP BY ALL""")
def sibling_edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = t.nation_graph(spark, sf_dir)
    return ed.sibling_weights(g.edges, g.nodes)


@query(f"WITH {NATION} SELECT dst AS node_id, count(*) AS incoming FROM g GROUP BY dst")
def incoming_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.incoming_counts(t.nation_edges(spark, sf_dir))


@query(f"WITH {REFS} SELECT src, dst, symbol, count(DISTINCT (file, line)) AS n, bool_and(l.reexport) AS via_reexport FROM refs JOIN loc l USING (src, dst, file, line) GROUP BY ALL")
def usage_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.usage_counts(t.trade_refs(spark, sf_dir))


# --- hierarchy


@query(f"WITH {PLACES} SELECT node_id, qualified_name FROM nodes")
def hierarchy_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.place_nodes(spark, sf_dir).select("node_id", "qualified_name")


@query(f"WITH {PLACES} SELECT node_id, CAST(depth AS INTEGER) AS depth FROM nodes")
def hierarchy_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.place_nodes(spark, sf_dir).select("node_id", "depth")


@query(f"""WITH {PLACES}, c AS (SELECT parent_id AS node_id, count(*) AS children FROM nodes WHERE parent_id IS NOT NULL GROUP BY 1),
d AS (SELECT a.node_id, count(*) AS descendants FROM nodes a JOIN nodes b ON starts_with(b.qualified_name, a.qualified_name || '::') WHERE a.depth < 2 GROUP BY 1)
SELECT n.node_id, coalesce(children, 0) AS children, coalesce(descendants, CASE WHEN depth = 2 THEN children END, 0) AS descendants FROM nodes n LEFT JOIN c USING (node_id) LEFT JOIN d USING (node_id)""")
def descendant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hi.descendant_counts(t.place_nodes(spark, sf_dir))


@query(f"WITH {PLACES} SELECT node_id FROM nodes WHERE parent_id = (SELECT r_regionkey FROM region WHERE r_name = 'AMERICA') AND depth = 1")
def select_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hi.select_nodes(t.place_nodes(spark, sf_dir), "AMERICA::*")


@query(f"WITH {PLACES} SELECT node_id FROM nodes WHERE starts_with(qualified_name, 'AMERICA::NATION_1::')")
def select_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hi.select_nodes(t.place_nodes(spark, sf_dir), "crate::AMERICA::NATION_1::**")


@query(f"WITH {PLACES} SELECT node_id FROM nodes WHERE qualified_name = 'ASIA' OR starts_with(qualified_name, 'ASIA::')")
def select_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hi.select_nodes(t.place_nodes(spark, sf_dir), "ASIA")


@query(f"WITH {PLACES} SELECT node_id, depth <= 1 AS visible, depth >= 1 AND EXISTS (SELECT 1 FROM nodes k WHERE k.parent_id = nodes.node_id) AS collapsed FROM nodes")
def expand_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hi.expand_level(t.place_nodes(spark, sf_dir), 1).select("node_id", "visible", "collapsed")


@query(f"WITH {PLACES} SELECT node_id, CASE WHEN depth = 0 THEN node_id ELSE region END AS visible FROM nodes")
def visible_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hi.visible_by_flag(t.place_nodes(spark, sf_dir).withColumn("collapsed", F.col("depth") < 2))


ROLLED = """seen AS (SELECT src, dst, n_locations AS usages, CASE WHEN src < dst THEN 'downward' ELSE 'upward' END AS direction FROM edge),
ends AS (SELECT {a} AS a, {b} AS b, src, dst, usages, direction FROM seen JOIN customer ON src = c_custkey + 1000000 JOIN nation n ON c_nationkey = n.n_nationkey JOIN nation m ON dst = m.n_nationkey + 100)
SELECT CAST(a AS BIGINT) AS src, CAST(b AS BIGINT) AS dst, count(*) AS arcs, CAST(sum(usages) AS BIGINT) AS usages, CASE WHEN min(direction) = max(direction) THEN min(direction) ELSE 'downward' END AS direction,
  round(0.5 + 2.0 * ln(least(sum(usages), 50)) / ln(50), 6) AS stroke FROM ends WHERE a <> b AND (a <> src OR b <> dst) GROUP BY a, b"""


def _rolled(spark: SparkSession, sf_dir: str, collapsed: F.Column) -> DataFrame:
    edges = ed.edge_facts(t.trade_refs(spark, sf_dir)).select("src", "dst", F.col("n_locations").alias("usages"), F.when(F.col("src") < F.col("dst"), "downward").otherwise("upward").alias("direction"))
    visible = hi.visible_by_flag(t.place_nodes(spark, sf_dir, levels=3).withColumn("collapsed", collapsed))
    return hi.roll_up(edges, visible).withColumn("stroke", F.round("stroke", 6))


@query(f"WITH {REFS}, " + ROLLED.format(a="n.n_regionkey", b="m.n_regionkey"))
def collapse_rollup_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(spark, sf_dir, F.col("depth") == 0)


@query(f"WITH {REFS}, " + ROLLED.format(a="CASE WHEN n.n_regionkey = 0 THEN 0 WHEN n.n_nationkey % 2 = 1 THEN n.n_nationkey + 100 ELSE src END", b="CASE WHEN m.n_regionkey = 0 THEN 0 ELSE dst END"))
def collapse_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(spark, sf_dir, (F.col("node_id") == 0) | ((F.col("depth") == 1) & (F.col("node_id") % 2 == 1)))


# --- reachability


@query(f"WITH RECURSIVE {BRAND}, r AS (SELECT CAST(1 AS BIGINT) AS node_id UNION SELECT g.dst FROM r JOIN g ON g.src = r.node_id) SELECT node_id FROM r")
def reach_from_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return re_.reachable(t.brand_edges(spark, sf_dir), spark.range(1, 2).toDF("node_id"))


FEATURES = "SELECT CAST(substr(p_brand, 7) AS BIGINT) AS node_id, p_brand AS name, p_type || p_size AS feature FROM part"


@query(f"""WITH RECURSIVE {BRAND}, m AS ({FEATURES}), r AS (SELECT DISTINCT node_id FROM m WHERE feature = 'PROMO7' OR (name = 'Brand#3' AND feature = 'ECONOMY1')
UNION SELECT g.dst FROM r JOIN g ON g.src = r.node_id) SELECT node_id FROM r""")
def feature_seed_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = t.table(spark, sf_dir, "part")
    members = parts.groupBy(t.brand_id().alias("node_id"), F.col("p_brand").alias("name")).agg(F.collect_set(F.concat("p_type", "p_size")).alias("features"))
    return re_.feature_reachable(members, t.brand_edges(spark, sf_dir), ["PROMO7", "Brand#3/ECONOMY1"])


def _crates(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Customers and suppliers are crates; customers contain their orders and depend on the suppliers that they bought from."""
    crate = F.lit("crate").alias("kind")
    customers = t.table(spark, sf_dir, "customer").select((F.col("c_custkey") + t.CUSTOMER).alias("node_id"), crate)
    suppliers = t.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + t.SUPPLIER).alias("node_id"), crate)
    orders = t.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select((F.col("o_custkey") + t.CUSTOMER).alias("src"), (F.col("o_orderkey") + t.ORDER).alias("dst"))
    return PropertyGraph(customers.union(suppliers), t.as_edges(t.purchase_edges(spark, sf_dir), CRATE_DEP).unionByName(t.as_edges(orders, CONTAINS)))


ENTRY = "entry AS (SELECT DISTINCT src AS node_id FROM g WHERE src NOT IN (SELECT dst FROM g))"


@query(f"WITH {PURCHASE}, {ENTRY} SELECT node_id FROM entry")
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _crates(spark, sf_dir)
    return re_.entry_points(g.edges, g.nodes)


@query(f"WITH RECURSIVE {PURCHASE}, {ENTRY}, s AS (SELECT node_id FROM entry UNION SELECT o_custkey + 1000000 FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT node_id FROM s UNION SELECT g.dst FROM r JOIN g ON g.src = r.node_id) SELECT node_id FROM r")
def production_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _crates(spark, sf_dir)
    return re_.production_reachable(g.edges, g.nodes)


# --- cycles


@query(f"WITH RECURSIVE {BRAND}, {CYCLES} SELECT node_id, scc_id FROM multi")
def scc_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cy.strong_components(t.brand_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {USER}, {CYCLES} SELECT node_id, scc_id FROM multi")
def scc_membership_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cy.strong_components(t.user_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {BRAND}, {CYCLES} SELECT scc_id, array_to_string(ns, ',') AS path FROM cycle")
def minimal_cycles_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cy.minimal_cycles(t.brand_edges(spark, sf_dir)).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ","))


@query(f"WITH RECURSIVE {NATION}, {CYCLES} SELECT scc_id, array_to_string(ns, ',') AS path FROM cycle")
def minimal_cycles_by_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cy.minimal_cycles(t.nation_edges(spark, sf_dir)).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ","))


@query(f"WITH RECURSIVE {USER}, {CYCLES} SELECT scc_id, array_to_string(ns, ',') AS path FROM cycle")
def minimal_cycles_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of longer cycles beside those of two."""
    return cy.minimal_cycles(t.user_edges(spark, sf_dir)).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ","))


@query(f"WITH RECURSIVE {BRAND}, {CYCLES} SELECT src, dst, CAST(min(len(ns)) AS INTEGER) AS length FROM arcs GROUP BY src, dst")
def minimal_cycle_length_per_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = cy.minimal_cycles(t.brand_edges(spark, sf_dir))
    size = cy.with_cycle_ids(cycles).select("cycle_id", F.size("path").alias("length"))
    return cy.cycle_arcs(cycles).join(size, "cycle_id").groupBy("src", "dst").agg(F.min("length").alias("length"))


@query(f"WITH RECURSIVE {BRAND}, {CYCLES} SELECT scc_id, src, dst, count(DISTINCT ns) AS cycles FROM arcs GROUP BY ALL")
def edge_cycle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cy.edge_cycle_counts(cy.minimal_cycles(t.brand_edges(spark, sf_dir)))


@query(f"""WITH RECURSIVE {BRAND}, {CYCLES}, c AS (SELECT scc_id, src, dst, count(DISTINCT ns) AS cycles FROM arcs GROUP BY ALL)
SELECT scc_id, c.src, c.dst, cycles, g.weight AS refs, CAST(row_number() OVER (PARTITION BY scc_id ORDER BY cycles DESC, g.weight, 'Brand#' || c.src, 'Brand#' || c.dst) AS INTEGER) AS rank FROM c JOIN g ON g.src = c.src AND g.dst = c.dst""")
def ranked_cycle_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = t.brand_edges(spark, sf_dir).cache()
    names = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct().withColumn("name", F.concat(F.lit("Brand#"), "node_id"))
    return cy.ranked_cycle_edges(cy.edge_cycle_counts(cy.minimal_cycles(edges)), edges.select("src", "dst", F.col("weight").alias("refs")), names)


@query(f"WITH RECURSIVE {BRAND}, {CYCLES} SELECT DISTINCT a.src, a.dst, CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.src = a.dst AND g.dst = a.src) THEN 'direct' ELSE 'transitive' END AS kind FROM arcs a")
def cycle_kind_direct_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cycle_kinds(t.brand_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {USER}, {CYCLES} SELECT DISTINCT a.src, a.dst, CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.src = a.dst AND g.dst = a.src) THEN 'direct' ELSE 'transitive' END AS kind FROM arcs a")
def cycle_kind_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds: pairs that follow each other, and longer ways round."""
    return _cycle_kinds(t.user_edges(spark, sf_dir))


def _cycle_kinds(pairs: DataFrame) -> DataFrame:
    edges = t.as_edges(pairs).cache()
    cyclic = cy.cyclic_edges(edges).withColumn("edge_type", F.lit(MODULE_DEP))
    return ed.cycle_kind(cyclic, edges).select("src", "dst", "kind")


@query()
def feedback_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = t.brand_graph(spark, sf_dir)
    weights = t.brand_edges(spark, sf_dir).select("src", "dst", F.col("weight").alias("refs"))
    return fb.feedback_edges(g.edges, cy.strong_components(g.edges), weights, g.nodes.select("node_id", "qualified_name"), fb.removal_bias(g.edges, g.nodes))


@query()
def cluster_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = t.brand_graph(spark, sf_dir).cache()
    components = cy.strong_components(g.edges).cache()
    weights = t.brand_edges(spark, sf_dir).select("src", "dst", F.col("weight").alias("refs"))
    cycles = cy.minimal_cycles(g.edges, components).cache()
    found = fb.feedback_edges(g.edges, components, weights, g.nodes.select("node_id", "qualified_name"), fb.removal_bias(g.edges, g.nodes), cycles)
    return fb.cluster_report(found, cycles, components, g.nodes)


# --- importers

USES = """uses AS (SELECT DISTINCT l_suppkey + 2000000000 AS provider, 'part' || l_partkey AS symbol, c_custkey + 1000000 AS consumer, c_nationkey, s_nationkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
part_sets AS (SELECT provider, symbol, array_to_string(list_sort(list(consumer)), ',') AS consumers, count(*) AS n, min(consumer) AS one, min(c_nationkey) AS low, max(c_nationkey) AS high, min(s_nationkey) AS home FROM uses GROUP BY provider, symbol),
clusters AS (SELECT provider, consumers, array_to_string(list_sort(list(symbol)), ',') AS symbols, min(n) AS n, min(one) AS one, min(low) AS low, max(high) AS high, min(home) AS home FROM part_sets GROUP BY provider, consumers)"""


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses with repeats, which the consumer sets leave out."""
    return t.trade(spark, sf_dir).select((F.col("l_suppkey") + t.SUPPLIER).alias("provider"), F.concat(F.lit("part"), "l_partkey").alias("symbol"), (F.col("c_custkey") + t.CUSTOMER).alias("consumer"))


@query(f"WITH {USES} SELECT provider, symbol, consumers FROM part_sets")
def importer_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.importer_partition(_uses(spark, sf_dir)).withColumn("consumers", F.array_join(F.col("consumers").cast("array<string>"), ","))


@query(f"WITH {USES} SELECT provider, consumers, symbols FROM clusters")
def symbol_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = im.symbol_clusters(im.importer_partition(_uses(spark, sf_dir)))
    return done.select("provider", F.array_join(F.col("consumers").cast("array<string>"), ",").alias("consumers"), F.array_join("symbols", ",").alias("symbols"))


@query(f"""WITH {USES} SELECT provider, consumers, symbols, CASE WHEN n = 1 THEN 'single_consumer' WHEN low = high AND low <> home THEN 'common_ancestor' ELSE 'crate_wide' END AS scope,
  CASE WHEN n = 1 THEN one WHEN low = high AND low <> home THEN low + 100 END AS scope_node FROM clusters""")
def consumer_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = t.place_nodes(spark, sf_dir, levels=3, suppliers=True)
    done = im.consumer_scopes(im.symbol_clusters(im.importer_partition(_uses(spark, sf_dir))), nodes)
    return done.select("provider", F.array_join(F.col("consumers").cast("array<string>"), ",").alias("consumers"), F.array_join("symbols", ",").alias("symbols"), "scope", "scope_node")


# --- rules

NAMED = "named AS (SELECT a.n_regionkey AS ra, b.n_regionkey AS rb, x.r_name || '::' || a.n_name AS a, y.r_name || '::' || b.n_name AS b FROM nation_all JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey JOIN region x ON a.n_regionkey = x.r_regionkey JOIN region y ON b.n_regionkey = y.r_regionkey)"
FORBIDDEN = ru.Rule("forbidden-dependency", "africa-asia", source="AFRICA::**", target="ASIA::**")
LAYERS = ru.Rule("layers", "regions", "warn", layers=("ASIA", "AMERICA", "AFRICA"))
NO_CYCLES = ru.Rule("no-cycles", "brands", scope="shop::**")


@query(f"WITH {NATION_ALL}, {NAMED} SELECT 'africa-asia' AS rule_name, 'error' AS severity, a || ' → ' || b AS message FROM named WHERE starts_with(a, 'AFRICA::') AND starts_with(b, 'ASIA::')")
def rule_forbidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ru.forbidden(t.nation_graph(spark, sf_dir), FORBIDDEN).select("rule_name", "severity", "message")


LAYER_SQL = f"WITH {NATION_ALL}, {NAMED}, l AS (SELECT a, b, CASE split_part(a, '::', 1) WHEN 'ASIA' THEN 0 WHEN 'AMERICA' THEN 1 WHEN 'AFRICA' THEN 2 END AS la, CASE split_part(b, '::', 1) WHEN 'ASIA' THEN 0 WHEN 'AMERICA' THEN 1 WHEN 'AFRICA' THEN 2 END AS lb FROM named)"


@query(LAYER_SQL + " SELECT 'regions' AS rule_name, 'warn' AS severity, a || ' → ' || b AS message FROM l WHERE la > lb")
def rule_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ru.layered(t.nation_graph(spark, sf_dir), LAYERS).select("rule_name", "severity", "message")


@query(f"WITH RECURSIVE {BRAND}, {CYCLES} SELECT 'brands' AS rule_name, 'error' AS severity, array_to_string(list_transform(ns || ns[:1], lambda x: 'shop::Brand#' || x), ' → ') AS message FROM cycle")
def rule_no_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ru.no_cycles(t.brand_graph(spark, sf_dir), NO_CYCLES).select("rule_name", "severity", "message")


@query(LAYER_SQL + " SELECT (SELECT count(*) FROM l WHERE starts_with(a, 'AFRICA::') AND starts_with(b, 'ASIA::')) AS errors, (SELECT count(*) FROM l WHERE la > lb) AS warnings")
def violation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ru.summary(ru.violations(t.nation_graph(spark, sf_dir), [FORBIDDEN, LAYERS, ru.Rule("layers", "off", "ignore", layers=("ASIA", "AFRICA"))]))


# --- volatility

CHANGES = "counts AS (SELECT 'part' || l_partkey AS file, count(*) AS changes FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_shipdate >= (SELECT date_trunc('day', max(l_shipdate)) - INTERVAL 6 MONTH FROM lineitem) GROUP BY 1)"
LEVEL = "CASE WHEN changes <= 2 THEN 'LOW' WHEN changes <= 10 THEN 'MEDIUM' ELSE 'HIGH' END"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = t.changes(spark, sf_dir)
    last = changes.agg(F.to_date(F.max("commit_ts")).alias("d")).first()["d"]
    return vo.change_counts(changes, now=F.lit(last))


@query(f"WITH {CHANGES} SELECT file, changes FROM counts")
def volatility_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


@query(f"WITH {CHANGES} SELECT file, changes, round(changes / (SELECT max(changes) FROM counts), 6) AS score FROM counts")
def volatility_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vo.scores(_counts(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"WITH {CHANGES} SELECT count(*) AS files, CAST(sum(changes) AS BIGINT) AS total, max(changes) AS max, min(changes) AS min, round(avg(changes), 6) AS avg, count(*) FILTER ({LEVEL} = 'LOW') AS low, count(*) FILTER ({LEVEL} = 'MEDIUM') AS medium, count(*) FILTER ({LEVEL} = 'HIGH') AS high FROM counts")
def volatility_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vo.statistics(_counts(spark, sf_dir)).withColumn("avg", F.round("avg", 6))


@query(f"WITH {CHANGES} SELECT file, changes, round(changes / (SELECT max(changes) FROM counts), 6) AS score, {LEVEL} AS level FROM counts")
def volatility_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vo.report(_counts(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"WITH {CHANGES} SELECT 'part' || p_partkey AS file, coalesce(changes, 0) AS changes, CASE WHEN coalesce(changes, 0) <= 2 THEN 'LOW' WHEN changes <= 10 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM part LEFT JOIN counts ON file = 'part' || p_partkey")
def volatility_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vo.enrich(t.table(spark, sf_dir, "part").select(F.concat(F.lit("part"), "p_partkey").alias("file")), _counts(spark, sf_dir))


# --- views, order, layout


@query(f"WITH {BRAND} SELECT 'in' AS direction, src AS other, weight FROM g WHERE dst = 1 UNION ALL SELECT 'out', dst, weight FROM g WHERE src = 1")
def node_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vi.relations(t.brand_edges(spark, sf_dir), 1)


@query(f"WITH {PLACES} SELECT node_id FROM nodes WHERE contains(lower(name), 'nation_1')")
def search_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vi.search_nodes(t.place_nodes(spark, sf_dir), "  Nation_1 ")


@query(f"WITH {REFS} SELECT src, dst, n_locations, all_reexport AND production AS reexport, l.first_file FROM edge JOIN (SELECT src, dst, min(file || ':' || line) AS first_file FROM refs GROUP BY ALL) l USING (src, dst)")
def edge_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges with all their locations, of which the sinks make use; here their number and the least of them."""
    edges = ed.aggregate_edges(t.trade_refs(spark, sf_dir))
    least = F.array_min(F.transform("locations", lambda x: F.concat_ws(":", x["file"], x["line"].cast("string"))))
    return edges.select("src", "dst", F.size("locations").cast("long").alias("n_locations"), C.is_pure_reexport().alias("reexport"), least.alias("first_file"))


@query(f"WITH {REFS}, hit AS (SELECT DISTINCT src, dst FROM refs WHERE contains(lower(symbol), 'promo')) SELECT src AS node_id FROM hit UNION SELECT dst FROM hit")
def search_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vi.search_refs(t.trade_refs(spark, sf_dir), "promo")


@query("SELECT p_name AS name, count(*) AS versions FROM part GROUP BY p_name HAVING count(*) > 1")
def multi_version_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vi.multi_version_groups(t.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.lit("external").alias("kind")))


@query(f"""WITH RECURSIVE {BRAND}, {CYCLES} SELECT CAST(1 AS BIGINT) AS node_id, 'current' AS role UNION ALL SELECT node_id, min(role) FROM (SELECT dst AS node_id, 'dependency' AS role FROM g WHERE src = 1 UNION ALL SELECT src, 'dependent' FROM g WHERE dst = 1) WHERE node_id <> 1 GROUP BY node_id
UNION ALL SELECT node_id, 'cycle-member' FROM multi WHERE scc_id = (SELECT scc_id FROM multi WHERE node_id = 1) AND node_id <> 1 AND node_id NOT IN (SELECT dst FROM g WHERE src = 1 UNION SELECT src FROM g WHERE dst = 1)""")
def highlight_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = t.as_edges(t.brand_edges(spark, sf_dir)).cache()
    return vi.highlight_roles(edges, 1, cy.strong_components(edges))


@query("""WITH n AS (SELECT CAST(r_regionkey AS BIGINT) AS node_id, 0 AS nesting, r_name AS a, '' AS b FROM region UNION ALL SELECT n_nationkey + 100, 1, r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT *, row_number() OVER (ORDER BY a, b) - 1 AS position FROM n)
SELECT node_id, 20 + 20 * nesting AS x, 60 + 30 * position AS y, CASE WHEN nesting = 0 THEN 24 ELSE 20 END AS height FROM p""")
def layout_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = t.place_nodes(spark, sf_dir, levels=2)
    none = spark.createDataFrame([], "src long, dst long, weight long")
    rank = od.tree_order(nodes, od.order_siblings(nodes, none))
    items = settle(nodes.join(rank, "node_id").select("node_id", F.col("depth").alias("nesting"), "rank_path"))
    return la.place(numbered(items, ["rank_path"])).select("node_id", "x", "y", "height")


@query(f"WITH {BRAND} SELECT src, dst, CASE WHEN 'Brand#' || src < 'Brand#' || dst THEN 'downward' ELSE 'upward' END AS direction, CAST(20 + 15 * greatest(1, abs(src - dst)) AS INTEGER) AS reach FROM g")
def edge_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("Brand#"), c)
    return t.brand_edges(spark, sf_dir).select("src", "dst", F.when(name("src") < name("dst"), "downward").otherwise("upward").alias("direction"), C.arc_offset(F.col("src") * C.ROW_HEIGHT, F.col("dst") * C.ROW_HEIGHT).alias("reach"))


@query(f"""WITH RECURSIVE {BRAND}, e AS (SELECT src, dst FROM g WHERE src < dst), n AS (SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS node_id FROM part),
w AS (SELECT node_id, 0 AS level FROM n WHERE node_id NOT IN (SELECT dst FROM e) UNION SELECT e.dst, level + 1 FROM w JOIN e ON e.src = w.node_id)
SELECT node_id, CAST(max(level) AS INTEGER) AS level FROM w GROUP BY node_id""")
def topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels are of acyclic graphs, so each pair of brands counts from the smaller on."""
    nodes = t.table(spark, sf_dir, "part").select(t.brand_id().alias("node_id")).distinct()
    return od.topo_levels(t.brand_edges(spark, sf_dir).where("src < dst"), nodes)


@query()
def barycenter_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = t.brand_graph(spark, sf_dir)
    return od.order_siblings(g.nodes, t.brand_edges(spark, sf_dir))


@query()
def layout_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return la.layout_items(t.nation_graph(spark, sf_dir))


@query()
def layout_arcs_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = PropertyGraph(t.place_nodes(spark, sf_dir, levels=2), t.as_edges(t.nation_edges(spark, sf_dir), shift=t.NATION)).cache()
    return la.layout_edges(g, la.layout_items(g)).drop("locations")


@query("""WITH s AS (SELECT page_id, string_split(regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^https?://', ''), '/') AS ps FROM pages),
k AS (SELECT array_to_string(ps[:n], '/') AS prefix FROM s, (SELECT unnest(range(1, (SELECT max(len(ps)) FROM s) + 1)) AS n) WHERE n <= len(ps) GROUP BY 1 HAVING count(*) > 1),
c AS (SELECT page_id, ps, unnest(range(1, len(ps) + 1)) AS n FROM s),
b AS (SELECT page_id, max(n) AS n FROM c JOIN k ON array_to_string(ps[:n], '/') = prefix GROUP BY page_id)
SELECT s.page_id, CASE WHEN b.n IS NULL THEN ps[1] ELSE array_to_string(ps[:b.n], '/') END AS prefix, CAST(coalesce(b.n, 1) AS INTEGER) AS n FROM s LEFT JOIN b USING (page_id)""")
def longest_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known prefixes: those that two pages or more share, of any number of parts."""
    path = F.regexp_replace(F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), "^https?://", "")
    pages = t.table(spark, sf_dir, "pages").select("page_id", F.split(path, "/").alias("ps"))
    some = pages.select("ps", F.explode(F.sequence(F.lit(1), F.size("ps"))).alias("n"))
    known = some.groupBy(F.array_join(F.slice("ps", F.lit(1), F.col("n")), "/").alias("prefix")).agg(F.count("*").alias("pages")).where("pages > 1").select("prefix")
    return lo.longest_prefix(pages, "page_id", "ps", known, "/").select("page_id", "prefix", "n")


@query(f"""WITH {NATION}, s AS (SELECT src, dst, 0.5 + 2.0 * ln(least(weight, 50)) / ln(50) AS w FROM g)
SELECT src, dst, round(w / 1.5, 6) AS scale, round(w * 1.3, 6) AS highlight, round(w * 4, 6) AS shadow, round(1.5 * w, 6) AS overhang, round(greatest(0.0, 100 - 3 * w), 6) AS visible, round(-1.5 * w, 6) AS dash FROM s""")
def arc_shadows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrow scale, highlight and shadow of the nations' arcs, for paths of 100 units."""
    arcs = t.nation_edges(spark, sf_dir).withColumn("stroke", C.stroke_width(F.col("weight")))
    x = C.shadow(F.col("stroke"), F.lit(100.0))
    r = lambda c: F.round(c, 6)
    return arcs.select("src", "dst", r(C.arrow_scale(F.col("stroke"))).alias("scale"), r(C.highlight_width(F.col("stroke"))).alias("highlight"), r(x["width"]).alias("shadow"), r(x["overhang"]).alias("overhang"), r(x["visible"]).alias("visible"), r(x["offset"]).alias("dash"))


@query(f"WITH {PLACES} SELECT node_id, CASE WHEN depth > 0 THEN split_part(qualified_name, '::', 1) END AS crate, CASE WHEN depth > 0 THEN substr(qualified_name, length(split_part(qualified_name, '::', 1)) + 3) ELSE qualified_name END AS path FROM nodes")
def qualified_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.place_nodes(spark, sf_dir).select("node_id", C.qualified_parts(F.col("path"), F.col("kind")).alias("x")).select("node_id", "x.crate", "x.path")


@query(f"""WITH {REFS} SELECT src, dst, CASE WHEN c_nationkey + 100 = dst THEN 'upward' ELSE 'downward' END AS direction FROM edge JOIN customer ON src = c_custkey + 1000000""")
def hierarchy_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' use of nations: upward in their own."""
    nodes = t.place_nodes(spark, sf_dir, levels=3).select(F.col("node_id").alias("src"), "ancestors")
    return ed.edge_facts(t.trade_refs(spark, sf_dir)).join(nodes, "src").select("src", "dst", C.hierarchy_direction(F.col("src"), F.col("dst"), F.col("ancestors")).alias("direction"))


# --- the workspace source, over sources that the tables spell out

MARKET = """places AS (SELECT n_nationkey AS k, replace(lower(r_name), ' ', '-') AS crate, replace(lower(r_name), ' ', '_') AS code, lower(n_name) AS nation FROM nation JOIN region ON n_regionkey = r_regionkey),
bought AS (SELECT DISTINCT o_custkey AS c, s_nationkey AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey),
module AS (SELECT DISTINCT code, code AS module, '/market/' || crate || '/src/lib.rs' AS file FROM places
  UNION ALL SELECT code, code || '::' || nation, '/market/' || crate || '/src/' || nation || '.rs' FROM places
  UNION ALL SELECT code, code || '::' || nation || '::c' || c_custkey, '/market/' || crate || '/src/' || nation || '/c' || c_custkey || '.rs' FROM customer JOIN places ON c_nationkey = k),
uses AS (SELECT b.code || '::' || b.nation || '::c' || c AS module, s.code || '::' || s.nation AS target, 'Port' || s.k AS item, b.code AS code, s.code AS to_code FROM bought JOIN customer ON c = c_custkey JOIN places b ON c_nationkey = b.k JOIN places s ON bought.k = s.k)"""


@query(f"""WITH {MARKET}, f AS (SELECT '/market/' || crate || '/src/lib.rs' AS file, 'mod' AS fact FROM places UNION ALL SELECT '/market/' || crate || '/src/lib.rs', 'use' FROM places
UNION ALL SELECT '/market/' || crate || '/src/' || nation || '.rs', 'mod' FROM customer JOIN places ON c_nationkey = k UNION ALL SELECT '/market/' || crate || '/src/' || nation || '.rs', unnest(['use', 'def']) FROM places
UNION ALL SELECT m.file, 'use' FROM uses JOIN module m USING (module))
SELECT file, fact, count(*) AS n FROM f GROUP BY ALL""")
def workspace_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scanner finds in each file."""
    return market(spark, sf_dir).facts.groupBy("file", "fact").agg(F.count("*").alias("n"))


@query(f"WITH {MARKET} SELECT code AS crate, module, file, false AS test FROM module")
def workspace_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The module tree, from the roots on by declarations and the files there are."""
    return market(spark, sf_dir).tree.select("crate", "module", "file", "test")


@query(f"""WITH {MARKET}, c AS (SELECT DISTINCT crate, code FROM places)
SELECT a.crate AS name, a.code AS code_name, '/market/' || a.crate || '/src/lib.rs' AS lib_root, (SELECT string_agg(b.crate, ',' ORDER BY b.crate) FROM c b WHERE b.crate <> a.crate) AS dependencies, 'serde 1.0.0' AS externals FROM c a""")
def workspace_crates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members with their roots, their dependencies inside the workspace, and the externals."""
    w = market(spark, sf_dir)
    outside = w.metadata.external_links().join(w.externals.withColumnRenamed("id", "to_id"), "to_id").groupBy(F.col("from_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(" ", "name", "version"))), ",").alias("externals"))
    return w.crates.join(outside, "id").select("name", "code_name", "lib_root", F.array_join("dependencies", ",").alias("dependencies"), "externals")


@query(f"WITH {MARKET} SELECT code || '::' || nation AS module, 'Port' || k AS name, 'definition' AS kind, NULL AS to_module FROM places UNION ALL SELECT code, 'Port' || k, 're-export', code || '::' || nation FROM places")
def workspace_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that modules define, and those that they re-export from others."""
    found = market(spark, sf_dir).exports
    own = found["definitions"].select("module", "name", F.lit("definition").alias("kind"), F.lit(None).cast("string").alias("to_module"))
    return own.union(found["reexports"].select("module", "name", F.lit("re-export"), "to_module"))


@query(f"""WITH {MARKET} SELECT module, target AS target_module, NULL AS external, item, false AS via_reexport FROM uses
UNION ALL SELECT code, code || '::' || nation, NULL, 'Port' || k, true FROM places UNION ALL SELECT code || '::' || nation, NULL, 'id-serde', NULL, false FROM places""")
def workspace_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References, resolved and followed through re-exports to where the names are defined."""
    return market(spark, sf_dir).refs.select("module", "target_module", "external", "item", "via_reexport")


@query(f"""WITH {MARKET}, n AS (SELECT module, replace(module, code, c.crate) AS name FROM module JOIN (SELECT DISTINCT crate, code FROM places) c USING (code) WHERE starts_with(module, code))
SELECT x.name AS src, y.name AS dst, 'module_dep' AS edge_type, 1 AS n_locations FROM uses JOIN n x USING (module) JOIN n y ON y.module = target
UNION ALL SELECT DISTINCT x.name, y.name, 'module_dep', (SELECT count(*) FROM places z WHERE z.k = p.k) FROM places p JOIN n x ON x.module = p.code JOIN n y ON y.module = p.code || '::' || p.nation
UNION ALL SELECT p.crate || '::' || p.nation, 'serde', 'module_dep', 1 FROM places p
UNION ALL SELECT DISTINCT a.crate, b.crate, 'crate_dep', 0 FROM places a JOIN places b ON a.crate <> b.crate UNION ALL SELECT DISTINCT crate, 'serde', 'crate_dep', 0 FROM places
UNION ALL SELECT crate, crate || '::' || nation, 'contains', 0 FROM places UNION ALL SELECT crate || '::' || nation, crate || '::' || nation || '::c' || c_custkey, 'contains', 0 FROM customer JOIN places ON c_nationkey = k""")
def workspace_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges of the workspace's graph, by the names of their ends."""
    g = market(spark, sf_dir).graph()
    name = g.nodes.select("node_id", F.col("qualified_name").alias("name"))
    return g.edges.join(name.toDF("src", "s"), "src").join(name.toDF("dst", "d"), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "edge_type", F.size("locations").cast("long").alias("n_locations"))


@query("SELECT 'crates/part' || l_partkey || '.rs' AS file, count(*) AS changes FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_shipdate >= (SELECT date_trunc('day', max(l_shipdate)) - INTERVAL 6 MONTH FROM lineitem) GROUP BY 1")
def history_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log reader: order lines written as records of a log, read back and counted."""
    lines = t.table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "N", "D").when(F.col("l_returnflag") == "R", F.concat(F.lit("R100\told"), "l_partkey", F.lit(".rs"))).otherwise("A")
    line = F.concat_ws("\t", status, F.concat(F.lit("crates/part"), "l_partkey", F.lit(".rs")))
    record = F.concat(F.lit(RECORD), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit("\n"), line, F.lit("\nM\tREADME.md\n"))
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    lines.select(record.alias("value")).write.text(path)
    last = lines.agg(F.to_date(F.max("l_shipdate")).alias("d")).first()["d"]
    return vo.change_counts(change_log(spark, path), now=F.lit(last))
