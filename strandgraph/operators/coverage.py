"""Coverage of files, and changes between a tree and what was recorded."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.functions.paths import parent_dir, under

MAX_SYMBOLS = 50


def summary(files: DataFrame) -> DataFrame:
    """One row: indexed, parse_partial, skipped, total."""
    return files.agg(*[F.count_if(F.col("status") == x).alias(x) for x in ("indexed", "parse_partial", "skipped")], F.count("*").alias("total"))


def sample(files: DataFrame, cap: int = 25) -> DataFrame:
    """One file for each (folder, reason), with how many are like it; the
    largest groups first."""
    g = files.groupBy(parent_dir(F.col("path")).alias("dir"), F.coalesce("reason", F.lit("")).alias("reason")).agg(F.min("path").alias("path"), (F.count("*") - 1).alias("others_like_it"))
    return g.select("path", "reason", "others_like_it").orderBy(F.desc("others_like_it"), "path").limit(cap)


def in_scope(files: DataFrame, scope: str) -> DataFrame:
    """Files of a folder; "." and "" mean all."""
    scope = scope.rstrip("/")
    return files if scope in ("", ".") else files.where(under(F.col("path"), scope))


def classify_paths(asked: DataFrame, files: DataFrame) -> DataFrame:
    """``asked(path, excluded, present)`` with status and reason: as recorded,
    else excluded, else unknown to the index."""
    known = files.select("path", F.col("status").alias("s"), F.col("reason").alias("r"), "detail", "language")
    status = F.coalesce("s", F.when(F.col("excluded"), "excluded").when(F.col("present"), "skipped").otherwise("skipped"))
    reason = F.when(F.col("s").isNull(), F.when(F.col("excluded"), "gitignore").when(F.col("present"), "not_indexed_yet").otherwise("not_found")).otherwise(F.col("r"))
    return asked.join(known, "path", "left").select("path", status.alias("status"), reason.alias("reason"), "detail", "language")


def changes(tree: DataFrame, recorded: DataFrame) -> DataFrame:
    """(path, change) of a full outer join by path: ``tree(path, hash)`` as it is,
    ``recorded(path, hash)`` as indexed. An empty or null hash is unreadable, so
    modified."""
    t = tree.select("path", F.lit(True).alias("here"), F.col("hash").alias("new"))
    r = recorded.select("path", F.lit(True).alias("there"), F.col("hash").alias("old"))
    same = (F.coalesce("new", F.lit("")) != "") & F.col("new").eqNullSafe(F.col("old"))
    change = F.when(F.col("there").isNull(), "added").when(F.col("here").isNull(), "removed").when(same, "unchanged").otherwise("modified")
    return t.join(r, "path", "full").select("path", change.alias("change"))


def change_counts(changed: DataFrame) -> DataFrame:
    return changed.agg(*[F.count_if(F.col("change") == x).alias(x) for x in ("added", "modified", "removed", "unchanged")])


def changed_symbols(changed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Changed files with up to ``MAX_SYMBOLS`` of their recorded symbols. The
    names are ranked before they are gathered, so a row stays small."""
    n = nodes.where("label <> 'File'").select(F.col("file_path").alias("path"), "qualified_name").distinct()
    nth = F.row_number().over(Window.partitionBy("path").orderBy("qualified_name"))
    n = n.join(changed.where("change <> 'unchanged'").select("path"), "path", "left_semi").withColumn("nth", nth).where(F.col("nth") <= MAX_SYMBOLS)
    n = n.groupBy("path").agg(F.sort_array(F.collect_list("qualified_name")).alias("symbols"))
    return changed.where("change <> 'unchanged'").join(n, "path", "left").withColumn("symbols", F.coalesce("symbols", F.array().cast("array<string>")))


def stale(stats: DataFrame, recorded: DataFrame) -> DataFrame:
    """Paths whose size or time differ, or that one side lacks."""
    t = stats.select("path", F.col("size").alias("s1"), F.col("mtime_ns").alias("m1"))
    r = recorded.select("path", F.col("size").alias("s2"), F.col("mtime_ns").alias("m2"))
    return t.join(r, "path", "full").where(~(F.col("s1").eqNullSafe(F.col("s2")) & F.col("m1").eqNullSafe(F.col("m2")))).select("path")


def affected(changed_paths: DataFrame, calls: DataFrame, imports: DataFrame, relations: DataFrame, touched_names: DataFrame, touched_spellings: DataFrame) -> DataFrame:
    """Files whose resolved edges may change: those changed, and those that call
    or extend a touched name or import a touched spelling."""
    last = F.element_at(F.split("supertype_name", "\\."), -1)
    names = touched_names.select("name").distinct()
    spelled = touched_spellings.select("spelling").distinct()
    a = calls.select("file_path", F.col("callee_name").alias("name")).join(names, "name", "left_semi").select("file_path")
    b = relations.select("file_path", last.alias("name")).join(names, "name", "left_semi").select("file_path")
    c = imports.select(F.col("from_file").alias("file_path"), F.col("candidate").alias("spelling")).join(spelled, "spelling", "left_semi").select("file_path")
    return changed_paths.select(F.col("path").alias("file_path")).unionByName(a).unionByName(b).unionByName(c).distinct()
