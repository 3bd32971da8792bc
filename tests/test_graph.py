import os
import random

import pytest

from weftgraph.operators import cycles as cy
from weftgraph.operators import feedback as fb
from weftgraph.operators.feedback import cover, cycles_kernel
from weftgraph.operators import hierarchy as hi
from weftgraph.operators import importers as im
from weftgraph.operators import order as od
from weftgraph.operators import reach as re_
from weftgraph.operators import rules as ru
from weftgraph.operators import edges as ed
from weftgraph.plans.table_queries import _cycle_kinds
from weftgraph.schema import EDGES, PropertyGraph

PATHS = "node_id long, kind string, name string, crate_id long, parent_id long"


def pairs(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def naive_scc(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    while True:
        grown = {n: set().union(*[reach[b] for a, b in edges if a in r]) | r for n, r in reach.items()}
        if grown == reach:
            break
        reach = grown
    groups = {n: frozenset(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    return {n: min(g) for n, g in groups.items() if len(g) > 1}


@pytest.mark.parametrize(
    ("edges", "expected"),
    [
        ([(0, 1), (1, 2)], []),
        ([(0, 1), (1, 0)], [[0, 1]]),
        ([(0, 1), (1, 2), (2, 0)], [[0, 1, 2]]),
        ([(0, 1), (1, 0), (0, 2), (2, 0)], [[0, 1], [0, 2]]),
        ([(0, 1), (1, 0), (2, 3), (3, 2)], [[0, 1], [2, 3]]),
        ([(0, 1), (1, 2), (2, 0), (0, 2)], [[0, 1, 2], [0, 2]]),
        ([(0, 1), (1, 2), (2, 0), (1, 3), (3, 0)], [[0, 1, 2], [0, 1, 3]]),
        ([(5, 5)], []),
    ],
)
def test_minimal_cycles(spark, edges, expected):
    got = cy.minimal_cycles(pairs(spark, edges)).collect()
    assert sorted(r["path"] for r in got) == expected


def test_kernels_against_naive():
    rng = random.Random(11)
    for _ in range(300):
        n = rng.randint(2, 8)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 18))]
        scc = cy.scc_kernel(edges)
        assert scc == naive_scc(edges)
        for root in set(scc.values()):
            inner = [(a, b) for a, b in edges if scc.get(a) == scc.get(b) == root and a != b]
            found = cycles_kernel(inner)
            arcs = [set(zip(p, p[1:] + p[:1], strict=True)) for p in found]
            assert all(a <= set(inner) for a in arcs)
            for a, b in inner:  # the shortest way back, plus the edge
                dist, level = {b: 0}, [b]
                while level:
                    level = sorted({y for x in level for u, y in inner if u == x and y not in dist})
                    dist.update({y: max(dist.values()) + 1 for y in level})
                assert min(len(c) for c in arcs if (a, b) in c) <= dist[a] + 1
        key = {e: (0, 0, str(e)) for e in edges}
        gone = set(cover(edges, key))
        assert not cy.scc_kernel([e for e in edges if e not in gone])


def plain_cycles(edges):
    scc = cy.scc_kernel(edges)
    return sorted(p for root in set(scc.values()) for p in cycles_kernel([(a, b) for a, b in edges if scc.get(a) == scc.get(b) == root and a != b]))


@pytest.mark.parametrize("chunk", [3, 1 << 19])
def test_components_by_joins(spark, chunk):
    """Many random graphs at once, as parts of one: sparse, dense, with tails and chains."""
    rng = random.Random(chunk)
    edges = []
    for k in range(60):
        n = rng.randint(2, 12)
        edges += [(100 * k + rng.randrange(n), 100 * k + rng.randrange(n)) for _ in range(rng.randint(1, 20))]
        if k % 3 == 0:  # a chain beside, that may close a ring
            chain = [100 * k + rng.randrange(n), *range(100 * k + 20, 100 * k + 20 + rng.randint(1, 30)), 100 * k + rng.randrange(n)]
            edges += zip(chain[:-1], chain[1:], strict=True)
    ring = list(range(99_000, 99_040))
    rng.shuffle(ring)
    edges += zip(ring, ring[1:] + ring[:1], strict=True)
    got = {r["node_id"]: r["scc_id"] for r in cy.strong_components(pairs(spark, [*edges, (None, 1), (7, None)]), chunk).collect()}
    assert got == cy.scc_kernel(edges)


def test_components_of_a_long_path_and_of_nothing(spark):
    n = 100_000
    path = spark.range(n).selectExpr("(id * 48271) % 100003 as src", "((id + 1) * 48271) % 100003 as dst")
    assert cy.strong_components(path).isEmpty()
    assert cy.strong_components(path.limit(0)).collect() == []


def test_cycles_of_bits_are_those_of_a_plain_search(spark):
    rng = random.Random(5)
    edges = []
    for k in range(60):
        n = rng.randint(2, 14)
        edges += [(100 * k + rng.randrange(n), 100 * k + rng.randrange(n)) for _ in range(rng.randint(1, 30))]
    edges += [(9000 + i, 9000 + (i + 1) % 90) for i in range(90)] + [(9010, 9003), (9050, 9000)]  # more than 64 sources, long ways round
    got = sorted(r["path"] for r in cy.minimal_cycles(pairs(spark, edges)).collect())
    assert got == plain_cycles(edges)
    assert cy.minimal_cycles(pairs(spark, [(1, 2)])).collect() == []


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_feedback_is_that_of_one_choice_after_the_other(spark, monkeypatch, most):
    """Random graphs as components of one: the same picks as the one-by-one cover."""
    monkeypatch.setattr(fb, "MOST_OF_AN_EDGE", most)
    rng = random.Random(8)
    edges, refs = [], {}
    for k in range(50 if most else 20):
        n = rng.randint(2, 8)
        some = {(100 * k + rng.randrange(n), 100 * k + rng.randrange(n)) for _ in range(rng.randint(2, 24))}
        edges += sorted(e for e in some if e[0] != e[1])
    refs = {e: rng.randint(0, 3) for e in edges}
    bias = {e: rng.choice([0, 1, 1, 1, 2]) for e in edges}
    df = spark.createDataFrame([(a, b, refs[a, b]) for a, b in edges], "src long, dst long, refs long")
    names = df.selectExpr("explode(array(src, dst)) as node_id").distinct().selectExpr("node_id", "concat('n', node_id) as name")
    kinds = spark.createDataFrame([(a, b, k) for (a, b), k in bias.items()], "src long, dst long, bias int")
    got = {(r["src"], r["dst"]) for r in fb.feedback_edges(df, cy.strong_components(df), df, names, kinds, kernel_steps=0).where("feedback").collect()}
    one_by_one = {(r["src"], r["dst"]) for r in fb.feedback_edges(df, cy.strong_components(df), df, names, kinds).where("feedback").collect()}
    assert got == one_by_one == set(cover(edges, {e: (bias[e], refs[e], f"n{e[0]}", f"n{e[1]}") for e in edges}))


def feedback(spark, weighted, bias=None):
    df = spark.createDataFrame(weighted, "a string, b string, refs long")
    ids = {n: i for i, n in enumerate(sorted({x for w in weighted for x in w[:2]}))}
    names = spark.createDataFrame([(i, n) for n, i in ids.items()], "node_id long, name string")
    edges = spark.createDataFrame([(ids[a], ids[b], r) for a, b, r in weighted], "src long, dst long, refs long")
    b = None if bias is None else spark.createDataFrame([(ids[x], ids[y], k) for x, y, k in bias], "src long, dst long, bias int")
    assert df.count() == edges.count()
    rows = fb.feedback_edges(edges, cy.strong_components(edges), edges, names, b).collect()
    back = {i: n for n, i in ids.items()}
    return {(back[r["src"]], back[r["dst"]]): r["cycles"] for r in rows if r["feedback"]}


def test_feedback(spark):
    assert feedback(spark, [("a", "b", 2), ("b", "a", 5)]) == {("a", "b"): 1}
    two = [("m0", "m1", 1), ("m1", "m2", 1), ("m2", "m0", 1), ("m1", "m3", 1), ("m3", "m0", 1)]
    assert feedback(spark, two) == {("m0", "m1"): 2}
    four = feedback(spark, [("a", "b", 5), ("b", "a", 1), ("a", "c", 3), ("c", "a", 2)])
    assert set(four) == {("b", "a"), ("c", "a")}
    assert feedback(spark, [("a", "b", 2), ("b", "a", 5)], [("a", "b", fb.STRUCTURAL), ("b", "a", fb.PREFERRED)]) == {("b", "a"): 1}


def test_order_inside_a_component_is_that_of_all_permutations():
    from itertools import permutations

    rng = random.Random(4)
    for _ in range(150):
        n = rng.randint(2, 6)
        name = {i: rng.choice("abc") + str(i) for i in range(n)}  # siblings have names of their own
        weights = {(i, j): rng.randint(0, 3) for i in range(n) for j in range(n) if i != j and rng.random() < 0.6}
        cost = lambda o: sum(weights.get((late, early), 0) for i, late in enumerate(o) for early in o[:i])  # noqa: E731, B023
        want = min(permutations(sorted(range(n), key=lambda x: (name[x], x))), key=lambda o: (cost(o), [name[x] for x in o]))  # noqa: B023
        assert od.within_component(list(range(n)), weights, name) == list(want)


@pytest.mark.parametrize(
    ("names", "weights", "expected"),
    [
        ("ab", {("a", "b"): 1, ("b", "a"): 1}, "ab"),
        ("abc", {("a", "b"): 1, ("b", "c"): 1, ("c", "a"): 1}, "abc"),
        ("abc", {("a", "b"): 1, ("b", "a"): 1, ("c", "a"): 1}, "cab"),
        ("abcd", {("d", "b"): 2, ("b", "d"): 1, ("d", "c"): 1, ("b", "c"): 1, ("c", "b"): 1}, "adbc"),
        ("zba", {("z", "b"): 1, ("b", "a"): 1}, "zba"),
    ],
)
def test_sibling_order(names, weights, expected):
    ids = {n: i for i, n in enumerate(names)}
    order = od.sibling_order({i: n for n, i in ids.items()}, {(ids[a], ids[b]): w for (a, b), w in weights.items()})
    assert "".join(names[i] for i in order) == expected


def test_barycenter():
    ids = {n: i for i, n in enumerate("abcd")}
    order = od.sibling_order({i: n for n, i in ids.items()}, {(ids["a"], ids["d"]): 1, (ids["b"], ids["c"]): 1})
    assert order.index(ids["d"]) < order.index(ids["c"])


def test_cycle_blocks(spark):
    cycles = spark.createDataFrame([(0, [0, 1, 2, 3]), (0, [0, 1, 3]), (0, [0, 1, 2])], "scc_id long, path array<long>")
    rank = spark.createDataFrame([(i, i) for i in range(4)], "node_id long, rank long")
    got = od.cycle_blocks(cycles, rank).orderBy("block").collect()
    assert [r["path"] for r in got] == [[0, 1, 2], [0, 1, 3], [0, 1, 2, 3]]


def tree(spark):
    rows = [(0, "crate", "app", None, None), (1, "module", "analyze", 0, 0), (2, "module", "parser", 0, 1), (3, "module", "reexport", 0, 1), (4, "module", "model", 0, 0), (5, "module", "user", 0, 0), (6, "module", "admin", 0, 0), (7, "external", "serde", None, None)]
    return hi.with_paths(spark.createDataFrame(rows, PATHS))


def edge(src, dst, symbols, kind="production", edge_type="module_dep", reexport=False):
    return (src, dst, edge_type, kind, None, [], [("f.rs", i + 1, [s], "m", reexport) for i, s in enumerate(symbols)])


def scopes(spark, edges):
    uses = im.symbol_uses(spark.createDataFrame(edges, EDGES))
    rows = im.consumer_scopes(im.symbol_clusters(im.importer_partition(uses)), tree(spark)).collect()
    return sorted((r["consumers"], r["symbols"], r["scope"], r["scope_node"]) for r in rows)


def test_importers(spark):
    assert scopes(spark, [edge(5, 4, ["Foo"])]) == [([5], ["Foo"], "single_consumer", 5)]
    assert scopes(spark, [edge(5, 4, ["Foo", "Bar"]), edge(6, 4, ["Baz"])]) == [([5], ["Bar", "Foo"], "single_consumer", 5), ([6], ["Baz"], "single_consumer", 6)]
    assert scopes(spark, [edge(5, 4, ["Foo"], reexport=True), edge(6, 4, ["Foo"], kind="test")]) == []
    assert scopes(spark, [edge(2, 4, ["Foo"]), edge(3, 4, ["Foo"])]) == [([2, 3], ["Foo"], "common_ancestor", 1)]
    assert scopes(spark, [edge(5, 4, ["Foo"]), edge(6, 4, ["Foo"])]) == [([5, 6], ["Foo"], "crate_wide", None)]
    assert scopes(spark, [edge(2, 1, ["Foo"]), edge(3, 1, ["Foo"])]) == [([2, 3], ["Foo"], "crate_wide", None)]


def test_selectors(spark):
    nodes = tree(spark).cache()
    pick = lambda p: sorted(r["node_id"] for r in hi.select_nodes(nodes, p).collect())
    assert pick("**") == [0, 1, 2, 3, 4, 5, 6]
    assert pick("app::analyze::**") == [2, 3]
    assert pick("app::*") == [1, 4, 5, 6]
    assert pick("app") == [0, 1, 2, 3, 4, 5, 6]
    assert pick("crate::app::analyze") == [1]
    assert pick("nowhere") == [] and pick("serde") == []


def test_rules(spark):
    g = PropertyGraph(tree(spark).cache(), spark.createDataFrame([edge(5, 4, ["Foo"]), edge(4, 5, ["Bar"]), edge(2, 3, ["X"], kind="test")], EDGES).cache())
    rules = [ru.Rule("forbidden-dependency", "f", source="app::user", target="app::model"), ru.Rule("layers", "l", "warn", layers=("app::model", "app::user")), ru.Rule("no-cycles", "c", scope="app::**"), ru.Rule("no-cycles", "off", "ignore")]
    got = ru.violations(g, rules).orderBy("ord").collect()
    assert [(r["rule_name"], r["message"]) for r in got] == [("f", "app::user → app::model"), ("l", "app::user → app::model"), ("c", "app::model → app::user → app::model")]
    assert ru.summary(ru.violations(g, rules)).first() == (2, 1)


def test_reachability(spark):
    nodes = spark.createDataFrame([(i, "crate") for i in range(3)], "node_id long, kind string")
    both = spark.createDataFrame([edge(0, 1, [], edge_type="crate_dep")], EDGES)
    assert sorted(r[0] for r in re_.production_reachable(both, nodes).collect()) == [0, 1, 2]
    lib, binary, helper = 0, 1, 2
    edges = [edge(lib, 10, [], edge_type="contains"), edge(binary, lib, [], edge_type="crate_dep"), edge(helper, lib, [], edge_type="crate_dep"), edge(binary, helper, [], edge_type="dev_dep")]
    assert sorted(r[0] for r in re_.production_reachable(spark.createDataFrame(edges, EDGES), nodes).collect()) == [lib, binary]


def test_symbol_weight_counts_unnamed_once(spark):
    row = (0, 1, "module_dep", "production", None, [], [("a", 1, ["X", "Y"], "m", False), ("a", 2, [], "m", False), ("b", 3, [], "m", False), ("b", 4, ["X"], "m", True)])
    assert ed.edge_weights(spark.createDataFrame([row], EDGES)).first()["refs"] == 3


def test_clusters_with_one_consumer_are_not_joined_with_ancestors(spark):
    nodes = tree(spark)
    uses = spark.createDataFrame([(4, "A", 2), (4, "B", 2), (4, "B", 2), (4, "C", 2), (4, "C", 3), (4, "D", None), (None, "E", 2), (4, None, 3), (77, "F", 5)], "provider long, symbol string, consumer long")
    clusters = im.symbol_clusters(im.importer_partition(uses))
    plan = clusters._jdf.queryExecution().sparkPlan().toString()
    assert "xxhash64" not in plan and "any_value" not in plan  # before: hashes and a second copy of the set went through the shuffle

    def rows(nodes):
        found = im.consumer_scopes(clusters, nodes)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        return sorted(((r["provider"], r["consumers"], r["symbols"], r["scope"], r["scope_node"]) for r in found.collect()), key=str), plan

    once, plan = rows(nodes)
    alone = [(4, [], ["D"], "crate_wide", None), (4, [2], ["A", "B"], "single_consumer", 2), (4, [3], [], "single_consumer", 3), (77, [5], ["F"], "single_consumer", 5), (None, [2], ["E"], "single_consumer", 2)]
    assert [r for r in once if len(r[1]) < 2] == sorted(alone, key=str) and len(once) == 6
    assert plan.index("Union") < plan.index("Join")  # before: all clusters met the ancestors, above the union
    twice, _ = rows(nodes.union(nodes.where("node_id = 4")))  # a repeated id repeats its clusters
    assert [r for r in twice if len(r[1]) < 2] == sorted([r for r in alone for _ in range(1 + (r[0] == 4))], key=str)


def test_edges_of_references_take_one_shuffle(spark):
    schema = "src long, dst long, source_file string, line int, symbol string, module_path string, via_reexport boolean, ctx_kind string, ctx_sub_kind string, features array<string>, ord long"
    row = lambda a, b, line, symbol, o: (a, b, "f", line, symbol, "m", False, "production", None, [], o)
    refs = spark.createDataFrame([row(1, 2, 9, "B", 5), row(1, 2, 3, "A", 4), row(1, 2, 9, "A", 2), row(2, 2, 1, "A", 1), row(2, 1, 1, None, 3)], schema)
    edges = ed.aggregate_edges(refs)
    got = {(r["src"], r["dst"]): [(x["line"], x["symbols"]) for x in r["locations"]] for r in edges.collect()}
    assert got == {(1, 2): [(3, ["A"]), (9, ["A", "B"])], (2, 1): [(1, [])]}
    plan = ed.aggregate_edges(refs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # before: by line, then by edge


def test_edges_of_references_are_grouped_once_and_keep_odd_rows(spark):
    schema = "src long, dst long, source_file string, line int, symbol string, module_path string, via_reexport boolean, ctx_kind string, ctx_sub_kind string, features array<string>, ord long"
    rng = random.Random(8)
    pick = lambda *x: rng.choice(x)
    rows = [(pick(1, 2, None), pick(1, 3, 4), pick("f", "g", None), pick(1, 2, None), pick("A", "B", None), pick("m", None), pick(True, False, None), pick("test", "test", "test", None, "production"), pick("unit", None), pick(["x"], [], None), pick(None, *range(50))) for _ in range(150)]
    rows = [(*r[:5], None if r[10] is None or r[10] % 3 == 0 else f"m{r[10]}", *r[6:]) for r in rows] * 2  # modules follow ord, so that no tie is open
    rows += [(9, 8, "f", 1, None, None, None, None, None, None, None)]
    low = lambda v: (v is not None, v if v is not None else 0)
    texts = lambda v: (v is not None, v or [])
    all_of = lambda vs: None if not [v for v in vs if v is not None] else all(v for v in vs if v is not None)
    want = {}
    for edge in {r[:2] for r in rows if r[0] is not None and r[0] != r[1]}:
        own = [r for r in rows if r[:2] == edge]
        places = []
        for file, line in {r[2:4] for r in own}:
            here = sorted((r for r in own if r[2:4] == (file, line)), key=lambda r: (low(r[10]), r[4] or ""))
            places.append((file, line, [r[4] for r in here if r[4] is not None], next((r[5] for r in here if r[10] is not None), None), all_of([r[6] for r in here])))
        places.sort(key=lambda x: (x[0] is not None, x[0] or "", low(x[1])))
        kinds = [r[7] for r in own]
        first = min(own, key=lambda r: (low(r[10]), (r[7] is not None, r[7] or ""), (r[8] is not None, r[8] or ""), texts(r[9])))
        context = ("production", None, []) if "production" in kinds else (first[7], first[8] if any(kinds) else None, first[9])
        want[edge] = (*context, places)
    assert {w[0] for w in want.values()} == {"production", "test", None}
    edges = ed.aggregate_edges(spark.createDataFrame(rows, schema).repartition(5))
    got = {(r["src"], r["dst"]): (r["ctx_kind"], r["ctx_sub_kind"], r["features"], [tuple(x) for x in r["locations"]]) for r in edges.collect()}
    assert got == want
    plan = edges._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ObjectHashAggregate") == 2  # before: 4, for lines and then for edges


def test_chains_are_searched_as_arcs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(26)]
    long, new = [], 100
    for a, b in sorted({(a, b) for a, b in edges if a != b}):  # most edges become chains of up to four nodes, with ids in any order
        inside = rng.sample(range(new, new + 50), rng.randrange(4))
        new += 50
        long += zip([a, *inside], [*inside, b], strict=True)
    long += [(9000 + i, 9000 + (i + 1) % 5) for i in range(5)] + [(0, 8001), (8001, 8002), (8002, 0)]  # a ring, and a chain from a node to itself
    got = sorted(r["path"] for r in cy.minimal_cycles(pairs(spark, long)).collect())
    assert got == plain_cycles(long)
    arcs, chains = cy.arcs_of(cy.inner_edges(pairs(spark, long), cy.strong_components(pairs(spark, long))))
    hubs = {r["node_id"] for r in arcs.selectExpr("explode(array(a, b)) as node_id").collect()}
    assert max(hubs - {9000}) < 12 and arcs.where("len > 1").count() == chains.count()


def written(spark):
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(root) for f in files if f.endswith(".parquet"))


def test_cycles_of_a_large_component_are_searched_in_blocks_that_write_no_levels(spark):
    """Who reached whom at a distance are nodes times nodes; before, every distance was written."""
    rng = random.Random(3)
    edges = sorted({(rng.randrange(2500), rng.randrange(2500)) for _ in range(10_000)} | {(3000 + i, 3000 + (i + 1) % 3) for i in range(3)})
    before = written(spark)
    got = sorted(r["path"] for r in cy.minimal_cycles(pairs(spark, edges), side=256).collect())
    assert written(spark) - before < 3_000_000
    assert got == plain_cycles(edges)


@pytest.mark.parametrize("side", [2, 40])
def test_blocks_of_sources_and_windows_give_the_same_cycles(spark, side):
    """Chains of many lengths, and more sources than a block has."""
    rng = random.Random(side)
    edges = [(-500 + rng.randrange(150), -500 + rng.randrange(150)) for _ in range(330)]
    new = 1000
    for a, b in edges[::7]:
        inside = list(range(new, new + rng.randrange(1, 9)))
        new += 9
        edges += zip([a, *inside], [*inside, b], strict=True)
    for k in range(10):
        edges += [(5000 + 10 * k + rng.randrange(6), 5000 + 10 * k + rng.randrange(6)) for _ in range(12)]
    got = sorted(r["path"] for r in cy.minimal_cycles(pairs(spark, edges), side=side).collect())
    assert got == plain_cycles(edges)


def test_kinds_of_a_long_ring_take_few_rounds(spark, monkeypatch):
    made = []
    for name in ("settle", "settle_counted"):
        monkeypatch.setattr(cy, name, lambda df, _f=getattr(cy, name), **k: made.append(1) or _f(df, **k))
    ring = [(i, (i + 1) % 300) for i in range(300)]
    kinds = {(r["src"], r["dst"]): r["kind"] for r in _cycle_kinds(pairs(spark, [*ring, (5, 4)])).collect()}
    assert kinds == {e: "direct" if set(e) == {4, 5} else "transitive" for e in [*ring, (5, 4)]}
    assert len(made) < 60  # a table or two a node before


def test_kinds_are_those_of_the_arcs_of_all_cycles_without_a_path(spark, monkeypatch):
    """The paths of many cycles over one long chain hold its nodes again and again."""
    rng = random.Random(12)
    edges = [(7000 + i, 7000 + (i + 1) % 50) for i in range(50)] + [(7000 + i, 7000) for i in range(20, 49)]
    for k in range(40):
        n = rng.randint(2, 9)
        edges += [(100 * k + rng.randrange(n), 100 * k + rng.randrange(n)) for _ in range(rng.randint(1, 20))]
    arcs = {a for p in plain_cycles(edges) for a in zip(p, p[1:] + p[:1], strict=True)}
    monkeypatch.setattr(cy, "minimal_cycles", None)
    got = sorted((r["src"], r["dst"], r["kind"]) for r in _cycle_kinds(pairs(spark, [*edges, (9, None)])).collect())
    assert got == sorted((a, b, "direct" if (b, a) in edges else "transitive") for a, b in arcs)
    assert _cycle_kinds(pairs(spark, [(1, 2), (3, 3)])).collect() == []


def test_scopes_make_the_clusters_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    uses = spark.createDataFrame([(9, "x", 3), (9, "x", 3), (9, "x", 2), (9, "y", 2)], "provider long, symbol string, consumer long").localCheckpoint()
    clusters = im.symbol_clusters(im.importer_partition(uses)).coalesce(1)
    counted = clusters.mapInArrow(lambda batches: (seen(b) for b in batches), clusters.schema)
    rows = im.consumer_scopes(counted, tree(spark)).collect()
    assert sorted((r["consumers"], r["symbols"], r["scope"]) for r in rows) == [([2], ["y"], "single_consumer"), ([2, 3], ["x"], "common_ancestor")]
    assert made.value == 1
