"""Edits of a graph as new frames: every edit is an anti-join, a filter or a
join, and a snapshot is written from its result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.operators.graph import of_types
from strandgraph.schema import RESOLVED_TYPES


def remove_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes of ``ids(id)`` and without edges at them."""
    gone = ids.select("id").distinct()
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), left.select(edges.columns)


def remove_files(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without what the files of ``gone(path)`` define."""
    own = nodes.join(gone.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    return remove_nodes(nodes, edges, own)


def remove_facts(facts: DataFrame, gone: DataFrame, column: str = "file_path") -> DataFrame:
    return facts.join(gone.select(F.col("path").alias(column)), column, "left_anti").select(facts.columns)


def clear_types(edges: DataFrame, types) -> DataFrame:
    """Edges without those of ``types``."""
    of_types(edges, types)
    return edges.where(~F.col("edge_type").isin(*types)) if types else edges


def clear_resolved(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges without the resolved ones that leave the files of ``files(path)``;
    observed edges stay."""
    own = nodes.join(files.select(F.col("path").alias("file_path")), "file_path", "left_semi").select(F.col("id").alias("src"))
    stay = edges.where(~F.col("edge_type").isin(*RESOLVED_TYPES))
    rest = edges.where(F.col("edge_type").isin(*RESOLVED_TYPES)).join(own, "src", "left_anti")
    return stay.unionByName(rest.select(edges.columns))


def set_times(files: DataFrame, times: DataFrame) -> DataFrame:
    """``files`` with the times of ``times(path, mtime_ns)`` where it has them."""
    t = times.select("path", F.col("mtime_ns").alias("new"))
    return files.join(t, "path", "left").withColumn("mtime_ns", F.coalesce("new", "mtime_ns")).select(files.columns)


def touched_names(before: DataFrame, after: DataFrame, changed: DataFrame) -> DataFrame:
    """Names that changed files defined before or define now."""
    both = before.select("file_path", "name").unionByName(after.select("file_path", "name"))
    return both.join(changed.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("name").distinct()


def upsert(rows: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with ``new`` in the place of rows with the same keys."""
    return rows.join(new.select(*keys), list(keys), "left_anti").select(rows.columns).unionByName(new.select(rows.columns))
