"""Package metadata (the package manager's JSON document) to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.columns import normalize_crate_name
from weftgraph.scratch import Grown, settle

SCHEMA = (
    "packages array<struct<name:string,version:string,id:string,source:string,manifest_path:string,features:map<string,array<string>>,"
    "targets:array<struct<kind:array<string>,name:string,src_path:string>>>>, workspace_members array<string>, workspace_root string, "
    "resolve struct<nodes:array<struct<id:string,deps:array<struct<name:string,pkg:string,dep_kinds:array<struct<kind:string>>>>>>>"
)
LIBRARY_KINDS = ("lib", "rlib", "dylib", "cdylib", "staticlib", "proc-macro")


class Metadata:
    """The tables of one metadata document."""

    def __init__(self, spark: SparkSession, source: str | DataFrame):
        """``source``: the path of a document, or documents of ``SCHEMA`` read already."""
        doc = spark.read.schema(SCHEMA).json(source, multiLine=True) if isinstance(source, str) else source
        if doc.where("resolve is not null").isEmpty():
            raise ValueError("the metadata has no resolve section")
        self.packages = doc.select(F.explode("packages").alias("p")).select("p.*")
        self.members = doc.select(F.explode("workspace_members").alias("id"))
        node = doc.select(F.explode("resolve.nodes").alias("n")).select(F.col("n.id").alias("from_id"), F.explode("n.deps").alias("d"))
        kinds = F.transform("d.dep_kinds", lambda k: F.coalesce(k["kind"], F.lit("normal")))
        # the package is looked up by id: a dependency's own name is what the source code calls it
        named = self.packages.select(F.col("id").alias("to_id"), F.col("name").alias("to_name"), F.col("version").alias("to_version"), F.col("source").alias("to_source"))
        member = self.members.select(F.col("id").alias("to_id"), F.lit(True).alias("to_member"))
        deps = node.select("from_id", F.col("d.pkg").alias("to_id"), F.col("d.name").alias("code_name"), kinds.alias("kinds")).join(named, "to_id").join(member, "to_id", "left")
        kind = F.when(F.array_contains("kinds", "normal"), "normal").when(F.array_contains("kinds", "dev"), "dev").when(F.array_contains("kinds", "build"), "build").otherwise("unknown")
        self.deps = deps.select("from_id", "to_id", "to_name", "to_version", "to_source", "code_name", kind.alias("kind"), F.coalesce("to_member", F.lit(False)).alias("in_workspace"))

    def crates(self) -> DataFrame:
        """Members: id, name, code_name, roots (library first, then binaries), features, dependencies, dev_dependencies."""
        target = lambda ks: F.filter("targets", lambda t: F.arrays_overlap(t["kind"], F.array(*map(F.lit, ks))))
        path = lambda ts: F.transform(ts, lambda t: t["src_path"])
        own = self.packages.join(self.members, "id", "left_semi")
        own = own.select("id", "name", normalize_crate_name(F.col("name")).alias("code_name"), F.get(path(target(LIBRARY_KINDS)), F.lit(0)).alias("lib_root"), path(target(("bin",))).alias("bin_roots"), "manifest_path", F.map_keys("features").alias("features"))
        per = self.deps.where("in_workspace").groupBy(F.col("from_id").alias("id")).agg(
            F.sort_array(F.collect_set(F.when(F.col("kind") == "normal", F.col("to_name")))).alias("dependencies"), F.sort_array(F.collect_set(F.when(F.col("kind") == "dev", F.col("to_name")))).alias("dev_dependencies"))
        none = F.array().cast("array<string>")
        return own.join(per, "id", "left").withColumns({"dependencies": F.coalesce("dependencies", none), "dev_dependencies": F.coalesce("dev_dependencies", none)})

    def external_links(self, transitive: bool = False) -> DataFrame:
        """(from_id, to_id, kind): members to packages with a source (normal and dev), and with ``transitive`` what these need in turn."""
        direct = self.deps.where("to_source is not null and kind in ('normal', 'dev')").join(self.members.withColumnRenamed("id", "from_id"), "from_id", "left_semi").select("from_id", "to_id", "kind")
        if not transitive:
            return direct
        onward = self.deps.where("to_source is not null and kind = 'normal'").select("from_id", "to_id", "kind")
        out, seen = Grown(direct), Grown(direct.select(F.col("to_id").alias("id")).distinct())
        frontier = seen.rows
        while not frontier.isEmpty():
            step = settle(onward.join(frontier.withColumnRenamed("id", "from_id"), "from_id", "left_semi"))
            out.add(step)
            frontier = settle(step.select(F.col("to_id").alias("id")).distinct().join(seen.rows, "id", "left_anti"))
            seen.add(frontier)
        return out.rows.distinct()

    def externals(self, transitive: bool = False) -> DataFrame:
        """(id, name, version, is_direct) of the external packages in use."""
        direct = self.external_links().select(F.col("to_id").alias("id"), F.lit(True).alias("is_direct")).distinct()
        used = self.external_links(transitive).select(F.col("to_id").alias("id")).distinct()
        return self.packages.join(used, "id").join(direct, "id", "left").select("id", "name", "version", F.coalesce("is_direct", F.lit(False)).alias("is_direct"))


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """(file, text) of all Rust files below a folder; ``file`` is the path without scheme."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.rs").text(root, wholetext=True)
    return found.select(F.regexp_replace(F.col("_metadata.file_path"), "^[a-z]+:/*(?=/)", "").alias("file"), F.col("value").alias("text"))
