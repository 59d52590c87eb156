"""Resolution: call sites, type relations, imports and routes meet symbols.

The rule throughout is that a reference is resolved only where exactly one
candidate is eligible; else it stays, labelled with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph import schema as s
from strandgraph.functions import paths
from strandgraph.operators import graph


def owner_of(qualified_name: Column) -> Column:
    """The segment before the last, as a method's owner."""
    parts = F.split(qualified_name, "\\.")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2))


def scope_of(qualified_name: Column) -> Column:
    """All but the last segment; null without a dot."""
    return F.when(qualified_name.contains("."), F.regexp_extract(qualified_name, r"^(.*)\.[^.]*$", 1))


def callables(nodes: DataFrame) -> DataFrame:
    n = nodes.where(F.col("label").isin(*s.CALLABLES))
    return n.select("id", "name", "qualified_name", "file_path", (F.col("label") == "Method").alias("method"))


def _unique(symbols: DataFrame, prefix: str, *keys: str) -> DataFrame:
    """Per key, how many callables and methods there are, and one of each."""
    only = F.when(F.col("method"), F.col("id"))
    return symbols.groupBy(*keys).agg(
        F.count("*").alias(f"{prefix}_n"), F.min("id").alias(f"{prefix}_id"), F.count(only).alias(f"{prefix}_nm"), F.min(only).alias(f"{prefix}_idm")
    )


def receiver_types(bindings: DataFrame, returns: DataFrame) -> DataFrame:
    """(file_path, variable, owner): types of variables that a constructor with
    one known return type fills. ``returns`` has name and returns."""
    known = returns.groupBy("name").agg(F.count_distinct(F.coalesce("returns", F.lit("\0"))).alias("kinds"), F.min("returns").alias("owner"))
    known = known.where("kinds = 1 and owner is not null").select(F.col("name").alias("constructor"), "owner")
    typed = bindings.join(known, "constructor").select("file_path", "variable", "owner").distinct()
    return typed.groupBy("file_path", "variable").agg(F.count("*").alias("n"), F.min("owner").alias("owner")).where("n = 1").drop("n")


def resolve_calls(sites: DataFrame, symbols: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """``sites(caller_id, caller_qn, callee_name, receiver, file_path, ...)`` with
    dst, edge_type, confidence, detail. ``symbols`` as from ``callables``;
    ``types(file_path, variable, owner)`` as from ``receiver_types``.

    Levels, each with its key and only if one candidate is eligible there:
    the receiver's type, the same file, the same module, the whole project.
    With a receiver other than self or this, only methods are eligible.
    Uniqueness is aggregated before the joins, so every level is one lookup."""
    symbols = symbols.withColumn("scope", scope_of(F.col("qualified_name"))).withColumn("owner", owner_of(F.col("qualified_name")))
    in_file = _unique(symbols, "f", "file_path", "name").withColumnRenamed("name", "callee_name")
    in_scope = _unique(symbols.where("scope is not null"), "m", "scope", "name").withColumnRenamed("name", "callee_name")
    in_all = _unique(symbols, "p", "name").withColumnRenamed("name", "callee_name")
    out = sites.withColumn("scope", scope_of(F.col("caller_qn")))
    out = out.join(in_file, ["file_path", "callee_name"], "left").join(in_scope, ["scope", "callee_name"], "left").join(in_all, "callee_name", "left")
    typed = F.lit(None).cast("bigint")
    if types is not None:
        owned = _unique(symbols.where("method and owner is not null"), "r", "owner", "name").withColumnRenamed("name", "callee_name")
        bound = types.withColumnRenamed("variable", "receiver").withColumnRenamed("owner", "receiver_type")
        out = out.join(bound, ["file_path", "receiver"], "left").join(owned.withColumnRenamed("owner", "receiver_type"), ["receiver_type", "callee_name"], "left")
        typed = F.when(F.col("r_nm") == 1, F.col("r_idm"))
    other = F.col("receiver").isNotNull() & ~F.col("receiver").isin(*s.SELF_RECEIVERS)
    one = lambda p: F.when(F.when(other, F.col(f"{p}_nm")).otherwise(F.col(f"{p}_n")) == 1, F.when(other, F.col(f"{p}_idm")).otherwise(F.col(f"{p}_id")))
    levels = [(typed, s.RECEIVER_TYPE, 1.0), (one("f"), s.SAME_FILE, 1.0), (one("m"), s.SAME_MODULE, 0.9), (one("p"), s.UNIQUE_NAME, 0.7)]
    dst, detail, confidence = F.coalesce(*[x for x, _, _ in levels]), F.lit(None).cast("string"), F.lit(None).cast("double")
    for found, name, value in reversed(levels):
        detail, confidence = F.when(found.isNotNull(), name).otherwise(detail), F.when(found.isNotNull(), value).otherwise(confidence)
    n = F.coalesce("p_n", F.lit(0))
    reason = F.when(n > 1, s.AMBIGUOUS).when((n == 1) & other, s.NO_METHOD).when(n == 1, s.SCOPE_MISMATCH).otherwise(s.NO_DEFINITION)
    recursive = dst == F.col("caller_id")
    return out.select(
        *sites.columns,
        F.coalesce(dst, F.lit(s.UNRESOLVED)).cast("bigint").alias("dst"),
        F.when(dst.isNull(), "CALL_UNRESOLVED").otherwise("CALLS").alias("edge_type"),
        F.when(dst.isNull(), 0.0).when(recursive, 1.0).otherwise(confidence).alias("confidence"),
        F.when(dst.isNull(), reason).when(recursive, s.RECURSIVE).otherwise(detail).alias("detail"),
    )


def call_sites(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls whose caller is an indexed symbol, with its id. Of several symbols
    with one name the last by place counts."""
    w = F.struct("file_path", "start_line", "id")
    callers = nodes.groupBy("qualified_name").agg(F.max_by("id", w).alias("caller_id"))
    c = calls.withColumnRenamed("from_qualified_name", "caller_qn")
    return c.join(callers.withColumnRenamed("qualified_name", "caller_qn"), "caller_qn")


def resolve_types(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """``relations(subtype_qualified_name, supertype_name, ...)`` with dst: the
    exact qualified name, else the only one that ends in ".name"; or 0. Suffixes
    are exploded once, so the match is an equi-join."""
    names = nodes.select("id", "qualified_name").where("qualified_name is not null")
    exact = names.groupBy(F.col("qualified_name").alias("supertype_name")).agg(F.max("id").alias("exact_id"))
    parts = F.split("qualified_name", "\\.")
    at = F.explode(F.sequence(F.lit(2), F.size(parts)))
    suffix = names.where(F.col("qualified_name").contains(".")).select("id", parts.alias("p"), at.alias("at"))
    suffix = suffix.select("id", F.array_join(F.slice("p", F.col("at"), F.size("p")), ".").alias("supertype_name")).join(relations.select("supertype_name").distinct(), "supertype_name", "left_semi")
    suffix = suffix.groupBy("supertype_name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("suffix_id")).where("n = 1").drop("n")
    out = relations.join(exact, "supertype_name", "left").join(suffix, "supertype_name", "left")
    return out.select(*relations.columns, F.coalesce("exact_id", "suffix_id", F.lit(s.UNRESOLVED)).cast("bigint").alias("dst"))


def spelled(files: DataFrame) -> DataFrame:
    """(spelling, dst): what an import may write for each file; the least rank
    wins, then the path. ``files`` has id and path."""
    each = files.select("id", "path", F.explode(paths.spellings(F.col("path"))).alias("w")).select("id", "path", "w.*")
    return each.groupBy("spelling").agg(F.min_by("id", F.struct("rank", "path", "id")).alias("dst"))


def import_candidates(imports: DataFrame, aliases: DataFrame | None = None, dart: DataFrame | None = None, go: DataFrame | None = None) -> DataFrame:
    """(import columns, ord, candidate): repository paths that an import may
    mean, best first. ``aliases(dir, prefix, suffix, wildcard, alias_target, alias_ord)``,
    ``dart(name, lib_dir)`` and ``go(path, dir)`` come from manifests; they are
    joined by prefix keys that are exploded from the imports, not compared.
    Manifests have passed the driver, so their folders are few."""
    base = imports.columns
    target, folder = F.col("target"), paths.parent_dir(F.col("from_file"))
    relative = target.startswith("./") | target.startswith("../")
    out = imports.where(relative).select(*base, F.lit(0).alias("ord"), paths.join_path(folder, target).alias("candidate"))
    rest = imports.where(~relative)
    if dart is not None:
        part = rest.where(target.startswith("package:")).withColumn("name", F.regexp_extract("target", "^package:([^/]*)/", 1))
        inner = F.regexp_extract("target", "^package:[^/]*/(.*)$", 1)
        out = out.unionByName(part.join(dart, "name").select(*base, F.lit(0).alias("ord"), paths.join_path(F.col("lib_dir"), inner).alias("candidate")))
    rest = rest.where(~target.startswith("package:"))
    if aliases is not None:
        steps = F.split(folder, "/")
        above = F.when(folder == "", F.array(F.lit(""))).otherwise(F.concat(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/")), F.array(F.lit(""))))
        # only folders and prefix lengths that some manifest has are tried; both are few
        most = aliases.agg(F.collect_set("dir").alias("dirs"), F.collect_set(F.length("prefix")).alias("sizes"))
        cut = F.transform(F.filter("sizes", lambda n: n <= F.length("target")), lambda n: F.col("target").substr(F.lit(1), n))
        near = rest.crossJoin(F.broadcast(most)).withColumn("dir", F.explode(F.array_intersect(above, "dirs"))).withColumn("prefix", F.explode(cut))
        keyed = near.drop("dirs", "sizes").join(aliases, ["dir", "prefix"])
        middle = F.col("target").substr(F.length("prefix") + 1, F.length("target") - F.length("prefix") - F.length("suffix"))
        fits = F.when(F.col("wildcard"), F.expr("endswith(substring(target, length(prefix) + 1), suffix)") & ((middle != "") | (F.col("suffix") == ""))).otherwise(F.col("prefix") == F.col("target"))
        at = F.instr("alias_target", "*")
        filled = F.when(F.col("wildcard") & (at > 0), F.concat(F.col("alias_target").substr(F.lit(1), at - 1), middle, F.col("alias_target").substr(at + 1, F.length("alias_target")))).otherwise(F.col("alias_target"))
        hits = keyed.withColumnRenamed("alias_ord", "ord").where(fits).select(*base, "dir", "ord", paths.join_path(F.col("dir"), filled).alias("candidate")).where("candidate is not null")
        nearest = hits.groupBy(*base).agg(F.max(F.length("dir")).alias("deep"))
        hits = hits.join(nearest, base).where(F.length("dir") == F.col("deep")).select(*base, "ord", "candidate")
        out = out.unionByName(hits)
        rest = rest.join(hits.select(*base).distinct(), base, "left_anti")
    if go is not None:
        steps = F.split("target", "/")
        cut = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
        hits = rest.withColumn("path", F.explode(cut)).join(go, "path")
        tail = F.regexp_replace(F.col("target").substr(F.length("path") + 1, F.length("target")), "^/", "")
        out = out.unionByName(hits.select(*base, F.lit(0).alias("ord"), paths.join_path(F.col("dir"), tail).alias("candidate")))
    return out.where("candidate is not null")


def resolve_imports(imports: DataFrame, files: DataFrame, packages: DataFrame | None = None, **manifests) -> DataFrame:
    """``imports(from_file, target, line)`` with dst, for those that land on an
    indexed file or package other than their own. The dotted module of the
    target is the last resort. ``files`` has id, path; ``packages`` id, dir."""
    keyed = imports.select("from_file", "target").distinct()
    at = spelled(files).withColumnRenamed("spelling", "candidate")
    if packages is not None:
        own = packages.select(F.col("dir").alias("candidate"), F.col("id").alias("package"))
        at = at.join(own, "candidate", "full").select("candidate", F.coalesce("dst", "package").alias("dst"))
    hits = import_candidates(keyed, **manifests).join(at, "candidate")
    first = hits.groupBy("from_file", "target").agg(F.min_by("dst", F.struct("ord", "candidate")).alias("by_path"))
    module = files.select(F.col("id"), paths.module_prefix(F.col("path")).alias("module"), "path").groupBy("module").agg(F.max_by("id", F.struct("path", "id")).alias("by_module"))
    both = keyed.join(first, ["from_file", "target"], "left").withColumn("module", paths.module_of_target(F.col("target"))).join(module, "module", "left")
    both = both.select("from_file", "target", F.coalesce("by_path", "by_module").alias("dst")).where("dst is not null")
    own = files.select(F.col("path").alias("from_file"), F.col("id").alias("src"))
    return imports.join(both, ["from_file", "target"]).join(own, "from_file").where("src <> dst")


def go_packages(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(dir, import_path, name): one package for each folder with Go files in a
    module; the innermost module owns the folder."""
    dirs = files.where("language = 'go'").select(paths.parent_dir(F.col("path")).alias("dir")).distinct()
    steps = F.split("dir", "/")
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/")), F.array(F.lit(""))))
    m = modules.select(F.col("dir").alias("root"), F.col("path").alias("module"))
    held = dirs.withColumn("root", F.explode(above)).join(m, "root").groupBy("dir").agg(F.max_by(F.struct("root", "module"), F.length("root")).alias("m"))
    rest = F.regexp_replace(F.col("dir").substr(F.length("m.root") + 1, F.length("dir")), "^/", "")
    path = F.concat_ws("/", "m.module", F.when(rest != "", rest))
    return held.select("dir", path.alias("import_path"), F.element_at(F.split(path, "/"), -1).alias("name"))


def apply_answers(edges: DataFrame, answers: DataFrame, nodes: DataFrame) -> DataFrame:
    """CALLS edges that a language server's answers add for unresolved calls:
    the shortest callable or class around the answered line. The unresolved
    edge stays. ``answers(edge_id, file_path, line)``."""
    open_ = edges.where("edge_type = 'CALL_UNRESOLVED'").select(F.col("id").alias("edge_id"), "src", "target_name", F.col("line").alias("at_line"))
    spans = nodes.where(F.col("label").isin(*s.CALLABLES, "Class"))
    hit = answers.select("edge_id", "file_path", "line").join(graph.narrowest(answers, spans), ["file_path", "line"])
    best = hit.groupBy("edge_id").agg(F.min(F.struct("size", F.col("span_id").alias("id"))).alias("b"))
    best = open_.join(best, "edge_id").dropDuplicates(["edge_id", "src", "target_name", "at_line"])
    return best.select("edge_id", "src", F.col("b.id").alias("dst"), F.lit("CALLS").alias("edge_type"), F.lit("lsp").alias("source"), F.lit(1.0).cast("float").alias("confidence"), "target_name", F.col("at_line").alias("line"))


def link_traces(observed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``observed(caller, callee, count)`` with src, dst (null where an end is
    not exactly one symbol) and the edge's detail."""
    exact = nodes.groupBy(F.col("qualified_name").alias("symbol")).agg(F.count("*").alias("n"), F.min("id").alias("id"))
    loose = nodes.groupBy(F.lower("name").alias("symbol")).agg(F.count("*").alias("ln"), F.min("id").alias("lid"))
    ends = observed.select(F.explode(F.array("caller", "callee")).alias("symbol")).distinct()
    ends = ends.join(exact, "symbol", "left").join(loose.withColumnRenamed("symbol", "low"), F.lower(ends["symbol"]) == F.col("low"), "left")
    ends = ends.select("symbol", F.when(F.col("n") == 1, F.col("id")).when(F.col("n").isNull() & (F.col("ln") == 1), F.col("lid")).alias("id"))
    out = observed
    for side, name in (("caller", "src"), ("callee", "dst")):
        out = out.join(ends.select(F.col("symbol").alias(side), F.col("id").alias(name)), side, "left")
    n = F.coalesce("count", F.lit(1))
    return out.select(*observed.columns, "src", "dst", F.concat(F.lit("observed "), n.cast("string"), F.lit(" time(s)")).alias("detail"))
