"""Symbol search, text search and snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.functions.paths import under
from strandgraph.functions.patterns import checked, literal_prefix, pushable_prefix
from strandgraph.schema import NODE_LABELS, GraphError

SEARCH_ORDER = ["qualified_name", "file_path", "start_line", "id"]
MAX_TEXT = 400
PREFIX_CAP = 20_000
MAX_CONTEXT = 50


def matches(column: Column, pattern: str) -> Column:
    """``pattern`` anywhere in ``column``, with its literal prefix as a filter
    that the scan can use where the pattern is anchored."""
    found = column.rlike(checked(pattern))
    prefix = pushable_prefix(pattern)
    return column.startswith(prefix) & found if prefix else found


def name_key(nodes: DataFrame) -> Column:
    """The lower-case name: a stored column where a snapshot is sorted by it."""
    return F.col("name_key") if "name_key" in nodes.columns else F.lower("name")


def search(nodes: DataFrame, *, name=None, qualified_name=None, name_pattern=None, label=None, file_pattern=None, scope=None, prefix_compat=False) -> DataFrame:
    """Nodes that meet every criterion given. Names compare without case,
    patterns with case. ``prefix_compat`` makes a name pattern match only names
    that begin with its literal prefix, in any case."""
    if label is not None and label not in NODE_LABELS:
        raise GraphError("invalid_argument", f"unknown label '{label}'")
    out = nodes
    if label is not None:
        out = out.where(F.col("label") == label)
    if qualified_name is not None:
        out = out.where(F.col("qualified_name") == qualified_name)
    if name is not None:
        out = out.where(name_key(out) == name.lower())
    if name_pattern is not None:
        out = out.where(matches(F.col("name"), name_pattern))
        if prefix_compat and (prefix := literal_prefix(name_pattern)):
            out = out.where(name_key(out).startswith(prefix.lower()))
    if file_pattern is not None:
        out = out.where(matches(F.col("file_path"), file_pattern))
    if scope is not None:
        out = out.where(under(F.col("file_path"), scope))
    return out


def by_name_prefix(nodes: DataFrame, prefix: str, cap: int = PREFIX_CAP) -> DataFrame:
    """The first ``cap`` nodes whose name begins with ``prefix`` in any case."""
    key = name_key(nodes)
    return nodes.where(key.startswith(prefix.lower())).orderBy(key, "id").limit(cap)


def resolve_symbol(nodes: DataFrame, symbol: str) -> DataFrame:
    """Candidates for a symbol that a user wrote: exact qualified names, or
    else names without case; by qualified name."""
    exact = nodes.where(F.col("qualified_name") == symbol).withColumn("tier", F.lit(0))
    loose = nodes.where((name_key(nodes) == symbol.lower()) & (F.col("qualified_name") != symbol)).withColumn("tier", F.lit(1))
    both = exact.unionByName(loose)
    first = both.agg(F.min("tier").alias("tier"))
    return both.join(F.broadcast(first), "tier").drop("tier").orderBy("qualified_name", "file_path", "start_line")


def lines_of(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line, text): lines from 1; a last line feed ends the last line."""
    body = F.regexp_replace(F.col(text), r"\r?\n$", "")
    each = files.where(F.length(text) > 0).select(F.col(path).alias("path"), F.posexplode(F.split(body, r"\r?\n")).alias("line", "text"))
    return each.select("path", (F.col("line") + 1).alias("line"), "text")


def search_files(files: DataFrame, pattern: str, *, regex=False, case_sensitive=True, file_pattern=None) -> DataFrame:
    """``search_lines`` over the lines of ``files``. Files that cannot hold the
    pattern are left out before any text is split."""
    if file_pattern is not None:
        files = files.where(matches(F.col("path"), file_pattern))
    if not regex and "\n" not in pattern and "\r" not in pattern:
        text = F.col("text") if case_sensitive else F.lower("text")
        files = files.where(text.contains(pattern if case_sensitive else pattern.lower()))
    return search_lines(lines_of(files), pattern, regex=regex, case_sensitive=case_sensitive)


def search_lines(lines: DataFrame, pattern: str, *, regex=False, case_sensitive=True, file_pattern=None) -> DataFrame:
    """Lines that hold ``pattern``; text without trailing space, at most
    ``MAX_TEXT`` characters of it."""
    text = F.col("text")
    if regex:
        hit = text.rlike(checked(pattern if case_sensitive else f"(?i){pattern}"))
    elif case_sensitive:
        hit = text.contains(pattern)
    else:
        hit = F.lower(text).contains(pattern.lower())
    out = lines.where(hit)
    if file_pattern is not None:
        out = out.where(matches(F.col("path"), file_pattern))
    return out.select("path", "line", F.substring(F.regexp_replace(text, r"\s+$", ""), 1, MAX_TEXT).alias("text"))


def snippet(files: DataFrame, nodes: DataFrame, context: int = 0) -> DataFrame:
    """Source of each node with ``context`` lines around it."""
    context = max(0, min(MAX_CONTEXT, context))
    n = nodes.select("id", "qualified_name", "file_path", "start_line", "end_line")
    body = F.split(F.regexp_replace("text", r"\r?\n$", ""), r"\r?\n")
    j = n.join(files.select(F.col("path").alias("file_path"), body.alias("body")), "file_path")
    first = F.greatest(F.col("start_line") - context, F.lit(1))
    last = F.least(F.col("end_line") + context, F.size("body"))
    source = F.array_join(F.slice("body", first, F.greatest(last - first + 1, F.lit(0))), "\n")
    return j.select("id", "qualified_name", "file_path", first.alias("from_line"), last.alias("to_line"), source.alias("source"))
