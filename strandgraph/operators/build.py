"""Files and facts become nodes and edges.

Everything is a join over facts, so building after an edit is the same plan as
building from nothing: facts of unchanged files are taken from the last
snapshot, and only changed files are parsed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandgraph import schema as s
from strandgraph.extract.files import KINDS, extracted, facts
from strandgraph.functions import paths
from strandgraph.operators import graph, resolve

BUCKETS = 4096


@dataclass
class Graph:
    """The frames of one snapshot."""

    files: DataFrame
    extracts: DataFrame
    nodes: DataFrame
    edges: DataFrame
    manifests: dict = field(default_factory=dict)

    def facts(self, kind: str) -> DataFrame:
        return facts(self.extracts, kind)


def identified(rows: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """``rows`` with ids from 1, the same for the same rows: counts by bucket of
    the first column of ``order``, then numbers within the bucket."""
    r = rows.withColumn("bucket", F.pmod(F.xxhash64(order[0]), F.lit(BUCKETS)))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = r.groupBy("bucket").agg(F.count("*").alias("c")).select("bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy(*order))
    return r.join(base, "bucket").withColumn(name, F.col("base") + nth).drop("bucket", "base")


def parse(files: DataFrame) -> DataFrame:
    """Extraction results of the files that can be parsed."""
    return extracted(files.where("status = 'indexed'"))


def coverage(files: DataFrame, extracts: DataFrame) -> DataFrame:
    """``files`` with parse_partial where the parser met errors; ``detail``
    names the line ranges, twenty at most."""
    bad = extracts.where(F.size("errors") > 0).select("path", F.array_join(F.transform(F.slice("errors", 1, 20), lambda e: F.concat_ws("-", e["first_line"].cast("string"), e["last_line"].cast("string"))), ",").alias("ranges"))
    j = files.join(bad, "path", "left")
    partial = F.col("ranges").isNotNull() & (F.col("status") == "indexed")
    return j.withColumns({"status": F.when(partial, "parse_partial").otherwise(F.col("status")), "reason": F.when(partial, "parse_error").otherwise(F.col("reason")), "detail": F.coalesce("ranges", "detail")}).drop("ranges")


def make_nodes(files: DataFrame, extracts: DataFrame, modules: DataFrame | None) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    p = F.col("path")
    module = paths.module_prefix(p)
    lines = F.when(F.col("text").isNull() | (F.col("text") == ""), 1).otherwise(F.greatest(F.size(F.split(F.regexp_replace("text", r"\r?\n$", ""), "\n")), F.lit(1)))
    own = files.where("status in ('indexed', 'parse_partial')")
    file_nodes = own.select(F.lit("File").alias("label"), paths.basename(p).alias("name"), F.when(module == "", p).otherwise(module).alias("qualified_name"), p.alias("file_path"), F.lit(1).alias("start_line"), lines.cast("int").alias("end_line"), "language", none("string").alias("signature"), none("map<string,string>").alias("extra"))
    d = facts(extracts, "definitions").select("label", "name", "qualified_name", "file_path", "start_line", "end_line", "language", "signature", none("map<string,string>").alias("extra"))
    r = facts(extracts, "routes").dropDuplicates(["file_path", "method", "path", "line"])
    extra = F.create_map(F.lit("method"), "method", F.lit("path"), "path", F.lit("framework"), "framework")
    routes = r.select(F.lit("Route").alias("label"), F.col("path").alias("name"), F.concat(F.lit("route:"), "method", F.lit(" "), "path").alias("qualified_name"), "file_path", F.col("line").alias("start_line"), "end_line", "language", none("string").alias("signature"), extra.alias("extra"))
    out = file_nodes.unionByName(d).unionByName(routes)
    if modules is not None:
        g = resolve.go_packages(own, modules)
        out = out.unionByName(g.select(F.lit("Package").alias("label"), "name", F.col("import_path").alias("qualified_name"), F.col("dir").alias("file_path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("go").alias("language"), none("string").alias("signature"), none("map<string,string>").alias("extra")))
    out = out.withColumns({"source": F.lit("ast"), "confidence": F.lit(1.0).cast("float")})
    return identified(out, ["file_path", "start_line", "end_line", "label", "qualified_name", "signature"])


def make_edges(nodes: DataFrame, extracts: DataFrame, manifests: dict) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    file_nodes = nodes.where("label = 'File'")
    inner = nodes.where(~F.col("label").isin("File", "Package"))
    parents = graph.containment(inner.where("label <> 'Route'"), file_nodes)
    held = inner.where("label = 'Route'").select(F.col("id").alias("dst"), "file_path").join(file_nodes.select("file_path", F.col("id").alias("src")), "file_path").select("src", "dst", F.lit("DEFINES").alias("edge_type"))
    columns = ["src", "dst", "edge_type", "confidence", "target_name", "detail", "line"]
    blank = {"confidence": F.lit(1.0), "target_name": none("string"), "detail": none("string"), "line": none("int")}
    out = parents.unionByName(held).withColumns(blank).select(*columns)

    symbols = resolve.callables(nodes)
    returns = facts(extracts, "definitions").where("label = 'Function'").select("name", "returns")
    types = resolve.receiver_types(facts(extracts, "bindings"), returns)
    calls = facts(extracts, "calls")
    sites = resolve.call_sites(calls.select("from_qualified_name", "callee_name", "receiver", "line", "character", "file_path"), nodes)
    called = resolve.resolve_calls(sites, symbols, types)
    out = out.unionByName(called.select(F.col("caller_id").alias("src"), "dst", "edge_type", "confidence", F.col("callee_name").alias("target_name"), "detail", "line"))

    imports = facts(extracts, "imports").select(F.col("file_path").alias("from_file"), "target", "line")
    at = file_nodes.select("id", F.col("file_path").alias("path"))
    packages = nodes.where("label = 'Package'").select("id", F.col("file_path").alias("dir"))
    imported = resolve.resolve_imports(imports, at, packages, **manifests)
    out = out.unionByName(imported.select("src", "dst", F.lit("IMPORTS").alias("edge_type"), F.lit(1.0).alias("confidence"), F.col("target").alias("target_name"), F.col("target").alias("detail"), "line"))

    place = F.struct("file_path", "start_line", "id")
    by_name = nodes.groupBy("qualified_name").agg(F.max_by("id", place).alias("src"))
    rel = facts(extracts, "relations").join(by_name.withColumnRenamed("qualified_name", "subtype_qualified_name"), "subtype_qualified_name")
    typed = resolve.resolve_types(rel.select("src", "supertype_name", "edge_type", "line"), nodes).where((F.col("dst") != s.UNRESOLVED) & (F.col("dst") != F.col("src")))
    out = out.unionByName(typed.select("src", "dst", "edge_type", F.lit(1.0).alias("confidence"), F.col("supertype_name").alias("target_name"), none("string").alias("detail"), "line"))

    routes = facts(extracts, "routes").where("handler_name is not null").withColumn("qualified_name", F.concat(F.lit("route:"), "method", F.lit(" "), "path"))
    own = nodes.where("label = 'Route'").select("qualified_name", "file_path", F.col("start_line").alias("line"), F.col("id").alias("caller_id"))
    scope = F.concat(paths.module_prefix(F.col("file_path")), F.lit(".route"))
    asked = routes.join(own, ["qualified_name", "file_path", "line"]).select("caller_id", scope.alias("caller_qn"), F.col("handler_name").alias("callee_name"), F.col("handler_receiver").alias("receiver"), "file_path", "line").distinct()
    handled = resolve.resolve_calls(asked, symbols, types).where("edge_type = 'CALLS'")
    out = out.unionByName(handled.select(F.col("caller_id").alias("src"), "dst", F.lit("ROUTES_TO").alias("edge_type"), "confidence", F.col("callee_name").alias("target_name"), "detail", "line"))
    out = out.withColumns({"confidence": F.col("confidence").cast("float"), "source": F.lit("ast")})
    return identified(out, ["src", "edge_type", "line", "dst", "target_name", "detail", "confidence"])


def build(files: DataFrame, extracts: DataFrame, manifests: dict, keep=lambda name, df: df) -> Graph:
    """The graph of files and their extracts. ``keep(name, frame)`` stores a
    frame and gives it back, so that what many joins read is computed once."""
    files = keep("files", coverage(files, extracts))
    nodes = keep("nodes", make_nodes(files, extracts, manifests.get("go")))
    return Graph(files, extracts, nodes, keep("edges", make_edges(nodes, extracts, manifests)), manifests)


def refreshed(files: DataFrame, before_files: DataFrame, before_extracts: DataFrame) -> DataFrame:
    """Extracts for ``files``: those of unchanged files as they were, the others
    parsed now."""
    same = files.where("status = 'indexed'").join(before_files.select("path", "hash", F.col("language").alias("was")), ["path", "hash"]).where(F.col("language").eqNullSafe(F.col("was"))).select("path")
    kept = before_extracts.join(same, "path", "left_semi")
    return kept.unionByName(parse(files.join(kept.select("path"), "path", "left_anti")))


def fingerprint(g: Graph) -> DataFrame:
    """The graph by meaning, without ids: what must be equal after any way of
    building it."""
    n = g.nodes.select("id", F.concat_ws("|", "label", "qualified_name", "file_path", F.col("start_line").cast("string"), F.col("end_line").cast("string")).alias("k"))
    a, b = n.select(F.col("id").alias("src"), F.col("k").alias("a")), n.select(F.col("id").alias("dst"), F.col("k").alias("b"))
    e = g.edges.join(a, "src").join(b, "dst", "left")
    edge = F.concat_ws(" ", "a", "edge_type", F.coalesce("b", F.lit("?")), F.coalesce("target_name", F.lit("")), F.coalesce("detail", F.lit("")), F.coalesce(F.col("line").cast("string"), F.lit("")))
    return n.select("k").unionByName(e.select(edge.alias("k")))


__all__ = ["KINDS", "Graph", "build", "coverage", "fingerprint", "identified", "make_edges", "make_nodes", "parse", "refreshed"]
