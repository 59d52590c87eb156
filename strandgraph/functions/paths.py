"""Columns on repository paths; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes and entry names that an import may leave off, in order.
IMPLICIT_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "dart", "vue", "py", "go", "d.ts")
DIRECTORY_ENTRIES = ("index", "mod", "main", "__init__")
MODULE_SUFFIXES = (".js", ".mjs", ".cjs", ".jsx", ".tsx", ".ts", ".dart", ".sh", ".mk", ".cmake")
SOURCE_ROOTS = ("src/", "crates/", "lib/", "services/", "app/", "internal/")
SOURCE_SUFFIXES = (".rs", ".go", ".ts", ".tsx", ".py", ".js", ".jsx")


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"\.([^.]*)$", 1)


def module_prefix(path: Column) -> Column:
    """The dotted module of a file: without suffix, package entry and dots."""
    stem = F.regexp_replace(path, r"\.[^.]*$", "")
    parts = F.filter(F.split(stem, "/"), lambda s: (s != "") & (s != "."))
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    return F.array_join(F.when(last.isin("__init__", "index", "mod"), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts), ".")


def normalise(path: Column) -> Column:
    """Collapses "." and ".."; null if the path leaves the root or is empty."""
    start = F.array().cast("array<string>")

    def step(seen, part):
        up = F.when(F.size(seen) > 0, F.slice(seen, 1, F.size(seen) - 1))
        return F.when((part == "") | (part == "."), seen).when(part == "..", up).otherwise(F.concat(seen, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), start, step)
    return F.when(F.size(parts) > 0, F.array_join(parts, "/"))


def join_path(directory: Column, target: Column) -> Column:
    return normalise(F.when(directory == "", target).otherwise(F.concat_ws("/", directory, target)))


def under(path: Column, scope: Column | str) -> Column:
    """Whether ``path`` is ``scope`` or lies in it; an empty scope holds all."""
    scope = F.lit(scope) if isinstance(scope, str) else scope
    return (scope == "") | (path == scope) | path.startswith(F.concat(scope, F.lit("/")))


def module_of_target(target: Column) -> Column:
    """An import target as a dotted module: no leading "./", no known suffix."""
    out = F.regexp_replace(target, r"^(\./)+", "")
    for suffix in MODULE_SUFFIXES:
        out = F.regexp_replace(out, f"(\\{suffix})+$", "")
    return F.translate(out, "/\\", "..")


def spellings(path: Column) -> Column:
    """Ways to write an import of ``path``: array of (rank, spelling); the lower
    rank wins where two files share a spelling."""
    row = lambda rank, s: F.struct(rank.cast("int").alias("rank"), s.alias("spelling"))
    order = sorted(enumerate(IMPLICIT_EXTENSIONS, 1), key=lambda x: -len(x[1]))
    rank, stem = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, ext in reversed(order):
        has = path.endswith("." + ext)
        rank = F.when(has, F.lit(i)).otherwise(rank)
        stem = F.when(has, path.substr(F.lit(1), F.length(path) - len(ext) - 1)).otherwise(stem)
    parent, base = parent_dir(stem), basename(stem)
    entry = F.array_position(F.array(*map(F.lit, DIRECTORY_ENTRIES)), base).cast("int") - 1
    rows = F.array(row(F.lit(0), path), F.when(stem.isNotNull(), row(rank, stem)), F.when((entry >= 0) & (parent != ""), row(100 + entry * 20 + rank, parent)))
    return F.filter(rows, lambda r: r.isNotNull())


def source_score(path: Column) -> Column:
    """How much a path looks like source rather than tests."""
    p = F.lower(path)
    out = F.lit(0)
    for part in SOURCE_ROOTS:
        out = out + F.when(p.contains(part), 2).otherwise(0)
    for ext in SOURCE_SUFFIXES:
        out = out + F.when(p.endswith(ext), 1).otherwise(0)
    return out - F.when(p.contains("test") | p.contains("fixture"), 1).otherwise(0)


def shipped_asset(target: Column) -> Column:
    """The local file that a markup reference names, or null for templates,
    fragments and other hosts."""
    t = F.trim(target)
    bad = t.contains("{{") | t.startswith("#") | t.startswith("//") | t.contains("://") | t.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (t == "")
    path = F.regexp_replace(F.regexp_extract(t, "^[^?#]*", 0), "^/+", "")
    return F.when(~bad & (path != ""), path)
