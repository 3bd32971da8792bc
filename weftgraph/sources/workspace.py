"""A Rust workspace as a property graph: module tree, name resolution, re-exports, edges.

Files are scanned once (``rust_text.facts``); the tree grows level by level by joining what files
declare with the files there are; names are resolved by cascades of joins with the small tables of modules,
crates and externals; re-exports are followed by pointer jumping until nothing moves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.columns import normalize_crate_name, resolve_relative
from weftgraph.operators.edges import aggregate_edges
from weftgraph.operators.hierarchy import with_paths
from weftgraph.operators.lookup import longest_prefix
from weftgraph.operators.numbering import numbered
from weftgraph.operators.reach import feature_reachable
from weftgraph.schema import CONTAINS, CRATE_DEP, DEV_DEP, PRODUCTION, TEST, PropertyGraph
from weftgraph.scratch import Grown, settle, settle_counted
from weftgraph.sources.metadata import Metadata, source_files
from weftgraph.sources.rust_text import facts

EXPORTED = ("pub", "pub(crate)", "pub(super)")


@dataclass(frozen=True)
class WorkspaceOptions:
    features: tuple[str, ...] = ()
    all_features: bool = False
    include_tests: bool = False
    externals: bool = False
    transitive: bool = False


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def module_tree(crates: DataFrame, declared: DataFrame, files: DataFrame, include_tests: bool) -> DataFrame:
    """(crate, module, file, test): every module of every crate; one file may serve several roots, a module is listed once.

    ``declared``: mod facts.  A declaration without a file is left out, and so is one whose file is being read already further up.
    """
    roots = crates.select(F.col("code_name").alias("crate"), F.col("code_name").alias("module"), F.explode(F.filter(F.concat(F.array("lib_root"), "bin_roots"), lambda x: x.isNotNull())).alias("file"), F.lit(False).alias("test"), F.lit(True).alias("root")).withColumn("above", F.array("file"))
    known = files.select(F.col("file"), F.lit(True).alias("there"))
    mods = declared.where(F.lit(include_tests) | ~F.col("is_test")).select(F.col("file"), "name", F.col("detail").alias("set_path"), "is_test")
    out = Grown(roots)
    level = out.rows
    while True:
        child = level.join(mods, "file").withColumn("folder", _folder(F.col("file")))
        inner = F.when(F.col("root") | F.col("file").rlike("/(mod|lib|main)\\.rs$"), F.col("folder")).otherwise(F.regexp_replace("file", "\\.rs$", ""))
        options = F.when(F.col("set_path").isNotNull(), F.array(F.concat_ws("/", "folder", "set_path"))).otherwise(F.array(F.concat(inner, F.lit("/"), "name", F.lit(".rs")), F.concat(inner, F.lit("/"), "name", F.lit("/mod.rs"))))
        tried = child.select("crate", F.concat_ws("::", "module", "name").alias("module"), (F.col("test") | F.col("is_test")).alias("test"), "above", F.posexplode(options).alias("nth", "file"))
        found = tried.join(known, "file").groupBy("crate", "module").agg(F.min_by(F.struct("file", "test", "above"), "nth").alias("x"))
        new = found.select("crate", "module", "x.file", "x.test", F.lit(False).alias("root"), F.col("x.above").alias("above")).where(~F.array_contains("above", F.col("file")))
        level = settle(new.withColumn("above", F.concat("above", F.array("file"))))
        if level.isEmpty():
            break
        out.add(level)
    return settle(out.rows.select("crate", "module", "file", "test").distinct())


def integration_tests(crates: DataFrame, files: DataFrame) -> DataFrame:
    """(crate, module, file, test): each file right under a package's ``tests`` folder, as crate::tests::stem."""
    root = F.coalesce("lib_root", F.get("bin_roots", F.lit(0)))
    packages = crates.select(F.col("code_name").alias("crate"), F.coalesce(_folder(F.col("manifest_path")), F.regexp_replace(_folder(root), "/src(/.*)?$", "")).alias("package"))
    found = files.select("file", F.regexp_replace(_folder(F.col("file")), "/tests$", "").alias("package")).where(F.col("file").rlike("/tests/[^/]+\\.rs$"))
    stem = F.regexp_extract("file", "([^/]+)\\.rs$", 1)
    return found.join(packages, "package").select("crate", F.concat_ws("::", "crate", F.lit("tests"), stem).alias("module"), "file", F.lit(True).alias("test"))


def absolute(rows: DataFrame, modules: DataFrame, crates: DataFrame, externals: DataFrame) -> DataFrame:
    """``rows`` (crate, module, segments, inline) with abs: the segments from the crate's name on; and external: the id of an external crate.

    In order: crate, self and super; a child module of the place; a module at the crate's top; a crate of the workspace; an external.
    """
    first = F.get("segments", F.lit(0))
    rest = F.slice("segments", F.lit(2), F.size("segments"))
    base = F.split("module", "::")
    has = modules.select("module").distinct()
    child = has.select(F.col("module").alias("__child"))
    top = has.select(F.col("module").alias("__top"))
    crate = crates.select(F.col("code_name").alias("__crate")).distinct()
    outside = externals.groupBy(normalize_crate_name(F.col("name")).alias("__name")).agg(F.min("node_key").alias("external"))
    out = rows.join(child, F.concat_ws("::", "module", first) == F.col("__child"), "left").join(top, F.concat_ws("::", "crate", first) == F.col("__top"), "left")
    out = out.join(crate, normalize_crate_name(first) == F.col("__crate"), "left").join(outside, normalize_crate_name(first) == F.col("__name"), "left")
    relative = resolve_relative(F.col("segments"), base, F.size("inline"))
    own = first.isin("self", "super", "crate")
    full = (
        F.when(first == "crate", F.concat(F.array("crate"), rest)).when(own, relative)
        .when(F.col("__child").isNotNull(), F.concat(base, F.col("segments"))).when(F.col("__top").isNotNull(), F.concat(F.array("crate"), F.col("segments")))
        .when(F.col("__crate").isNotNull(), F.concat(F.array("__crate"), rest))
    )
    out = out.withColumn("abs", full).withColumn("external", F.when(F.col("abs").isNull() & ~own, F.col("external")))
    return out.drop("__child", "__top", "__crate", "__name").where("abs is not null or external is not null")


def split_target(rows: DataFrame, modules: DataFrame) -> DataFrame:
    """``rows`` (rid, abs, ...) with target_module (the longest part that is a module) and item (what follows, if anything)."""
    known = modules.select(F.col("module").alias("prefix"))
    done = longest_prefix(rows, "rid", "abs", known)
    return done.withColumn("target_module", F.col("prefix")).withColumn("item", F.get("abs", F.col("n"))).drop("prefix", "n")


def follow_reexports(rows: DataFrame, exports: dict[str, DataFrame]) -> DataFrame:
    """``rows`` with target_module moved to where the item is defined.

    At each module: stop where it defines the name; else an explicit re-export; else a private ``use``, for importers inside that
    module; else a glob whose source exports the name.  Only within one crate; the item keeps the name it was imported by.
    """
    defined = exports["definitions"].select(F.col("module").alias("target_module"), F.col("name").alias("look"), F.lit(True).alias("defined")).distinct()
    step = lambda df, tag: df.groupBy("module", "name").agg(F.min(F.struct("to_module", "to_name")).alias(tag)).withColumnsRenamed({"module": "target_module", "name": "look"})
    explicit, private, glob = step(exports["reexports"], "one"), step(exports["private_uses"], "two"), step(exports["glob_exports"], "three")
    state = settle(rows.select("rid", F.col("module").alias("importer"), "target_module", F.col("item").alias("look"), F.array("target_module").alias("visited")))
    while True:  # no module is visited twice
        joined = state.join(defined, ["target_module", "look"], "left").join(explicit, ["target_module", "look"], "left").join(private, ["target_module", "look"], "left").join(glob, ["target_module", "look"], "left")
        inside = (F.col("importer") == F.col("target_module")) | F.col("importer").startswith(F.concat("target_module", F.lit("::")))
        to = F.when(F.col("defined"), None).otherwise(F.coalesce("one", F.when(inside, F.col("two")), "three"))
        moves = joined.withColumn("to", to)
        same = F.split(F.col("to.to_module"), "::")[0] == F.split("target_module", "::")[0]
        fresh = F.col("to").isNotNull() & same & ~F.array_contains("visited", F.col("to.to_module"))
        new = settle(moves.select("rid", "importer", F.when(fresh, F.col("to.to_module")).otherwise(F.col("target_module")).alias("target_module"), F.when(fresh, F.col("to.to_name")).otherwise(F.col("look")).alias("look"), F.when(fresh, F.concat("visited", F.array("to.to_module"))).otherwise(F.col("visited")).alias("visited"), fresh.alias("moved")))
        state = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    return rows.drop("target_module").join(state.select("rid", "target_module"), "rid")


class Exports(dict[str, DataFrame]):
    """Tables by name, each made when it is first asked for."""

    def __init__(self, **makers: Callable[[], DataFrame]):
        self.makers = makers

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.makers[name]()
        return self[name]

    def seen_from(self, private_uses: DataFrame) -> Exports:
        """The same, with these private uses."""
        made = Exports(**{name: lambda name=name: self[name] for name in self.makers})
        made["private_uses"] = private_uses
        return made


class Workspace:
    """The tables of a workspace, each made when it is first asked for.

    ``metadata``: the path of a metadata document, or documents read already; ``sources``: a folder of sources, or their (file, text).
    """

    def __init__(self, spark: SparkSession, metadata: str | DataFrame, sources: str | DataFrame, options: WorkspaceOptions = WorkspaceOptions()):
        self.spark, self.options = spark, options
        self.metadata = Metadata(spark, metadata)
        self.sources = source_files(spark, sources) if isinstance(sources, str) else sources

    @cached_property
    def crates(self) -> DataFrame:
        return settle(self._chosen())

    @cached_property
    def _tests(self) -> DataFrame:
        return integration_tests(self.crates, self.sources)

    @cached_property
    def files(self) -> DataFrame:
        """The files of the crates that were chosen: these come first, so that others are never scanned."""
        folders = self.crates.select(F.explode(F.filter(F.concat(F.array("lib_root"), "bin_roots"), lambda x: x.isNotNull())).alias("r")).select(_folder(F.col("r")).alias("folder")).distinct()
        mine = self.sources.join(folders, F.col("file").startswith(F.concat("folder", F.lit("/"))), "left_semi")
        if self.options.include_tests:
            mine = mine.union(self.sources.join(self._tests.select("file").distinct(), "file", "left_semi").select("file", "text")).dropDuplicates(["file"])
        return settle(mine.withColumn("crate", F.lit("")))

    @cached_property
    def facts(self) -> DataFrame:
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 4 * self.spark.sparkContext.defaultParallelism)
        return settle(facts(self.files.repartition(parts, "file")))  # long files don't stay in the task that wrote them

    @property
    def errors(self) -> DataFrame:
        return self.facts.where("fact = 'error'")

    @cached_property
    def tree(self) -> DataFrame:
        tree = module_tree(self.crates, self.facts.where("fact = 'mod'"), self.files, self.options.include_tests)
        return settle(tree.union(self._tests.select("crate", "module", "file", "test"))) if self.options.include_tests else tree

    @cached_property
    def externals(self) -> DataFrame:
        if self.options.externals:
            return settle(self.metadata.externals(self.options.transitive).withColumn("node_key", F.col("id")))
        return self.spark.createDataFrame([], "id string, name string, version string, is_direct boolean, node_key string")

    @cached_property
    def exports(self) -> Exports:
        """definitions, reexports, private_uses (module, name, to_module, to_name) and glob_exports: what globs make visible, transitively."""
        return Exports(definitions=self._definitions, reexports=self._reexports, private_uses=self._private_uses, globs=self._globs, glob_exports=self._glob_exports)

    @cached_property
    def refs(self) -> DataFrame:
        return settle(self._refs())

    def _chosen(self) -> DataFrame:
        """Members that the wanted features need (all, if nothing is asked or no member has such a feature)."""
        crates = self.metadata.crates()
        o = self.options
        if not o.features or o.all_features:
            return crates
        keyed = crates.withColumn("node_id", F.xxhash64("name"))
        links = keyed.select(F.col("node_id").alias("src"), F.explode("dependencies").alias("d")).select("src", F.xxhash64("d").alias("dst"))
        kept = feature_reachable(keyed.select("node_id", "name", "features"), links, list(o.features))
        return crates if kept.isEmpty() else keyed.join(kept, "node_id", "left_semi").drop("node_id")

    def _located(self, *kinds: str) -> DataFrame:
        f = self.facts.where(F.col("fact").isin(*kinds)).drop("crate", "alias" if kinds == ("def",) else "name")
        rows = f.join(self.tree, "file")
        test = F.col("is_test") | F.col("test")
        return rows.withColumn("is_test", test) if self.options.include_tests else rows.where(~test)

    def _definitions(self) -> DataFrame:
        inner = F.concat_ws("::", "module", F.array_join("inline", "::"))
        place = F.when(F.size("inline") > 0, inner).otherwise(F.col("module"))
        return settle(self._located("def").where(F.col("visibility").isin(*EXPORTED)).select(place.alias("module"), "name").distinct())

    def _item_uses(self, *visibility: str, within: DataFrame | None = None) -> DataFrame:
        """(module, name, to_module, to_name) of the items' ``use`` of one of these visibilities, of all modules or those ``within`` (module)."""
        uses = self._located("use")
        if within is not None:
            uses = uses.join(within, "module", "left_semi")
        uses = uses.where(F.col("visibility").isin(*visibility) & (F.col("detail") == "item") & ~F.col("is_test")).withColumn("rid", F.xxhash64("file", "module", "line", "segments", F.coalesce("alias", F.lit("")))).dropDuplicates(["rid"])
        found = split_target(absolute(uses, self.tree, self.crates, self.externals).where("abs is not null"), self.tree).where("item is not null")
        return found.select("module", F.coalesce("alias", "item").alias("name"), F.col("target_module").alias("to_module"), F.col("item").alias("to_name"))

    @cached_property
    def _exported_uses(self) -> DataFrame:
        return settle(self._item_uses(*EXPORTED))

    def _reexports(self) -> DataFrame:
        return settle(self._exported_uses.where("to_name <> '*'").distinct())

    def _private_uses(self) -> DataFrame:
        return settle(self._item_uses("").where("to_name <> '*'").distinct())

    def _private_uses_in(self, modules: DataFrame) -> DataFrame:
        """Of ``private_uses`` those of some modules: a re-export is followed through modules that something refers to, and no others."""
        return settle(self._item_uses("", within=modules).where("to_name <> '*'").distinct())

    def _globs(self) -> DataFrame:
        return settle(self._exported_uses.where("to_name = '*'").select("module", "to_module").distinct())

    def _glob_exports(self) -> DataFrame:
        globs = self.exports["globs"]
        named = self.exports["definitions"].union(self.exports["reexports"].select("module", "name")).distinct()
        out = Grown(globs.join(named.withColumnRenamed("module", "to_module"), "to_module").select("module", "name", "to_module", F.col("name").alias("to_name")))
        frontier = out.rows
        while not frontier.isEmpty():
            step = globs.join(frontier.select(F.col("module").alias("to_module"), "name").distinct(), "to_module").select("module", "name", "to_module", F.col("name").alias("to_name"))
            frontier = settle(step.join(out.rows.select("module", "name"), ["module", "name"], "left_anti").distinct())
            out.add(frontier)
        return out.rows

    def _refs(self) -> DataFrame:
        """Resolved references: crate, module, target_module (or external), item, file, line, is_test, via_reexport, ord.

        What a reference means depends on its crate and segments, and on its module only if it starts with ``self``, ``super`` or a child of the module.  So each
        distinct such text is resolved once, and the references look it up.
        """
        both = settle(self._located("use", "path").select("fact", "file", "crate", "module", "line", "is_test", "visibility", "segments", "alias", F.get("segments", F.lit(0)).alias("first"), F.size("inline").alias("deep")))
        modules = self.tree.select("module").distinct()
        parents = modules.select(F.regexp_replace("module", "::[^:]*$", "").alias("module")).distinct()
        near = both.join(parents, "module", "left_semi").select("module", "first").distinct()
        children = settle(near.join(modules.withColumnRenamed("module", "child"), F.concat_ws("::", "module", "first") == F.col("child"), "left_semi").withColumn("is_child", F.lit(True)))
        own = F.col("first").isin("self", "super")
        place = F.when(own | F.col("is_child"), F.col("module")).otherwise("")
        scoped = both.join(children, ["module", "first"], "left").withColumns({"scope": place, "deep": F.when(own, F.col("deep")).otherwise(0)}).drop("is_child")
        key = ["crate", "scope", "segments", "deep"]
        texts = settle(scoped.select(*key).distinct().withColumn("rid", F.monotonically_increasing_id()))
        found = absolute(texts.select("rid", "crate", F.col("scope").alias("module"), "segments", F.array_repeat(F.lit(""), F.col("deep")).alias("inline")), self.tree, self.crates, self.externals)
        known = settle(texts.join(found.select("rid", "abs", "external"), "rid").drop("rid"))
        scoped, rewritten = self._through_bound(scoped, known, key, modules)
        heads = known.where("abs is not null").select("abs")
        heads = settle((heads if rewritten is None else heads.union(rewritten.select("abs"))).distinct().withColumn("rid", F.monotonically_increasing_id()))
        targets = settle(split_target(heads, self.tree))
        exports = self.exports.seen_from(self._private_uses_in(targets.select(F.col("target_module").alias("module")).distinct()))
        holders, seen = settle_counted(exports["private_uses"].select(F.col("module").alias("prefix")).distinct())
        if seen["n"]:  # which private uses a module sees is told by the innermost module around it that has any
            inside = longest_prefix(modules.withColumn("parts", F.split("module", "::")), "module", "parts", holders).join(holders, "prefix").select("module", F.col("prefix").alias("holder"))
            inside = settle(inside)
            within = lambda df: df.join(inside, "module", "left").na.fill("", ["holder"])
        else:
            within = lambda df: df.withColumn("holder", F.lit(""))
        scoped = within(scoped)
        asked = scoped.join(known.where("abs is not null"), key).select("abs", "holder").distinct() if seen["n"] else known.where("abs is not null").select("abs", F.lit("").alias("holder")).distinct()
        if rewritten is not None:
            rewritten = within(rewritten)
            asked = asked.union(rewritten.select("abs", "holder")).distinct()
        sources = exports["definitions"].union(exports["reexports"].select("module", "name")).distinct().select(F.col("module").alias("target_module"), F.col("name").alias("exported"))
        globs = targets.where("item = '*'").join(sources, "target_module", "left").withColumn("item", F.coalesce("exported", "item")).drop("exported")
        expanded = targets.where("item is null or item <> '*'").unionByName(globs.select(*targets.columns))
        starts = settle(expanded.drop("rid").join(asked, "abs").select("abs", F.col("holder").alias("module"), "target_module", "item").withColumn("rid", F.monotonically_increasing_id()))
        ends = settle(follow_reexports(starts, exports).select("abs", F.col("module").alias("holder"), "target_module", "item"))
        via = (F.col("fact") == "use") & F.col("visibility").isin(*EXPORTED)
        columns = ["crate", "module", "target_module", "external", "item", "file", "line", "is_test", "via_reexport", "fact"]
        inner = scoped.join(known.where("abs is not null").select(*key, "abs").join(ends, "abs").drop("abs"), [*key, "holder"])
        if rewritten is not None:
            inner = inner.select("crate", "module", "target_module", "item", "file", "line", "is_test", "fact", "visibility").unionByName(rewritten.join(ends, ["abs", "holder"]).select("crate", "module", "target_module", "item", "file", "line", "is_test", "fact", "visibility"))
        inner = inner.withColumns({"via_reexport": via, "external": F.lit(None).cast("string")}).select(*columns)
        outer = scoped.join(known.where("abs is null"), key).withColumns({"via_reexport": via, "target_module": F.lit(None).cast("string"), "item": F.lit(None).cast("string")}).select(*columns)
        kept = inner.unionByName(outer)
        # the first reference to a target of a kind stands for all of a module's
        first = F.min(F.struct(F.when(F.col("fact") == "use", 0).otherwise(1).alias("o"), "line", "file"))
        return kept.groupBy("crate", "module", "target_module", "external", "item", "is_test").agg(first.alias("x"), F.bool_and("via_reexport").alias("via_reexport")).select(
            "crate", "module", "target_module", "external", "item", "is_test", "via_reexport", "x.line", "x.file", (F.col("x.o") * 10**9 + F.col("x.line")).cast("long").alias("ord"))

    def _through_bound(self, scoped: DataFrame, known: DataFrame, key: list[str], modules: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The references but paths that start with a name which a ``use`` of the same module binds to a module; and these, with abs, if there are paths at all."""
        spots = ["file", "module", "bound"]
        wanted, seen = settle_counted(scoped.where("fact = 'path'").select("file", "module", F.col("first").alias("bound")).distinct())
        if not seen["n"]:
            return scoped, None
        names = scoped.where("fact = 'use'").withColumn("bound", F.coalesce("alias", F.element_at("segments", -1))).join(wanted, spots, "left_semi")
        named = names.join(known.where("abs is not null"), key).select(*spots, F.array_join("abs", "::").alias("path"))
        bound = settle(named.join(modules.withColumnRenamed("module", "path"), "path", "left_semi").groupBy(*spots).agg(F.min("path").alias("bound_path")))
        paths = settle(scoped.where("fact = 'path'").withColumn("bound", F.col("first")).join(bound, spots, "left").drop("bound"))
        whole = F.concat(F.split("bound_path", "::"), F.slice("segments", F.lit(2), F.size("segments")))
        plain = scoped.where("fact <> 'path'").unionByName(paths.where("bound_path is null").drop("bound_path"))
        return plain, paths.where("bound_path is not null").withColumn("abs", whole).drop("bound_path")

    def graph(self) -> PropertyGraph:
        """Nodes (with the file of each crate and module) and edges.  Ids: crates by name, then modules by path, then externals by name and version."""
        none = F.lit(None)
        crates = self.crates.select(F.lit(0).alias("t"), F.col("code_name").alias("key"), F.lit("crate").alias("kind"), "name", F.col("code_name").alias("crate"), none.cast("string").alias("parent"), none.cast("string").alias("version"), none.cast("string").alias("package_id"), none.cast("boolean").alias("is_direct"))
        groups = self.tree.where(F.col("module").startswith(F.concat("crate", F.lit("::tests::")))).select(F.concat("crate", F.lit("::tests")).alias("module"), "crate")  # the folder of integration tests
        mods = self.tree.where("module <> crate").select("module", "crate").union(groups).distinct()
        modules = mods.select(F.lit(1).alias("t"), F.col("module").alias("key"), F.lit("module").alias("kind"), F.element_at(F.split("module", "::"), -1).alias("name"), "crate", F.regexp_replace("module", "::[^:]*$", "").alias("parent"), none.cast("string").alias("version"), none.cast("string").alias("package_id"), none.cast("boolean").alias("is_direct"))
        outside = self.externals.select(F.lit(2).alias("t"), F.col("node_key").alias("key"), F.lit("external").alias("kind"), "name", none.cast("string").alias("crate"), none.cast("string").alias("parent"), "version", F.col("id").alias("package_id"), "is_direct")
        keyed = settle(numbered(settle(crates.union(modules).union(outside)), ["t", "key", "name"], "node_id"))
        ids = keyed.where("t < 2").select("key", "node_id")
        up = keyed.join(ids.toDF("parent", "parent_id"), "parent", "left").join(keyed.where("t = 0").select(F.col("key").alias("crate"), F.col("node_id").alias("owner")), "crate", "left")
        nodes = with_paths(up.select("node_id", "kind", "name", F.when(F.col("kind") == "module", F.col("owner")).alias("crate_id"), "parent_id", "version", "package_id", "is_direct"))
        kind, sub = F.when(F.col("is_test"), TEST).otherwise(PRODUCTION), F.when(F.col("is_test") & F.col("file").rlike("/tests/[^/]+\\.rs$"), "integration").when(F.col("is_test"), "unit")
        to = F.coalesce(F.col("target_module"), F.col("external"))
        refs = self.refs.join(ids.toDF("module", "src"), "module").withColumn("to", to).join(keyed.select(F.col("key").alias("to"), F.col("node_id").alias("dst")), "to")
        refs = refs.select("src", "dst", F.col("file").alias("source_file"), "line", F.col("item").alias("symbol"), F.col("target_module").alias("module_path"), "via_reexport", kind.alias("ctx_kind"), sub.alias("ctx_sub_kind"), F.array().cast("array<string>").alias("features"), "ord")
        edges = aggregate_edges(refs)
        code = F.transform("dependencies", lambda d: normalize_crate_name(d)), F.transform("dev_dependencies", lambda d: normalize_crate_name(d))
        own = self.crates.select(F.col("code_name").alias("a"), code[0].alias("prod"), code[1].alias("dev"))
        dev_kind = CRATE_DEP if self.options.include_tests else DEV_DEP
        links = own.select("a", F.explode("prod").alias("b"), F.lit(CRATE_DEP).alias("edge_type"), F.lit(PRODUCTION).alias("k")).union(own.select("a", F.explode("dev").alias("b"), F.lit(dev_kind).alias("edge_type"), F.lit(TEST).alias("k")))
        crate_edges = self._plain(links.join(ids.toDF("a", "src"), "a").join(ids.toDF("b", "dst"), "b"), edges)
        contains = nodes.where("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("node_id").alias("dst"), F.lit(CONTAINS).alias("edge_type"), F.lit(None).cast("string").alias("k"))
        all_edges = edges.unionByName(crate_edges).unionByName(self._plain(contains, edges))
        if self.options.externals:
            node_of = self.metadata.crates().select("id", F.col("code_name").alias("key")).join(ids, "key").select("id", "node_id").union(keyed.where("t = 2").select(F.col("key").alias("id"), "node_id"))
            ext = self.metadata.external_links(self.options.transitive).join(node_of.toDF("from_id", "src"), "from_id").join(node_of.toDF("to_id", "dst"), "to_id")
            per = ext.groupBy("src", "dst").agg(F.bool_or(F.col("kind") == "normal").alias("n")).select("src", "dst", F.lit(CRATE_DEP).alias("edge_type"), F.when(F.col("n"), PRODUCTION).otherwise(TEST).alias("k"))
            all_edges = all_edges.unionByName(self._plain(per, edges))
        files = self.tree.groupBy(F.col("module").alias("key")).agg(F.min("file").alias("file"))
        nodes = nodes.join(keyed.where("t < 2").join(files, "key").select("node_id", "file"), "node_id", "left")
        return PropertyGraph(settle(nodes), settle(all_edges))

    @staticmethod
    def _plain(rows: DataFrame, like: DataFrame) -> DataFrame:
        """Edges (src, dst, edge_type, k) without locations, in the columns of ``like``."""
        return rows.select("src", "dst", "edge_type", F.col("k").alias("ctx_kind"), F.when(F.col("k") == TEST, "unit").alias("ctx_sub_kind"), F.array().cast("array<string>").alias("features"), F.array().cast(like.schema["locations"].dataType).alias("locations"))
