"""Manifests that give imports a meaning: path aliases, package names, modules."""

from __future__ import annotations

import json
import posixpath
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.functions.paths import basename

NAMES = ("tsconfig.json", "jsconfig.json", "pubspec.yaml", "go.mod")
MAX_DEPTH = 6
MAX_EXTENDS = 8
ALIASES_DDL = "dir string, prefix string, suffix string, wildcard boolean, alias_target string, alias_ord int"


def strip_jsonc(text: str) -> str:
    """JSON with comments as JSON; what is removed becomes spaces, so places in
    the text stay the same."""
    blank = lambda m: m[0] if m[0].startswith('"') else re.sub(r"[^\n]", " ", m[0])
    text = re.sub(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?(?:\*/|\Z)', blank, text, flags=re.S)
    comma = lambda m: m[0] if m[0].startswith('"') else " " + m[0][1:]
    return re.sub(r'"(?:\\.|[^"\\])*"|,(?=\s*[}\]])', comma, text)


def ts_options(path: str, texts: dict[str, str], depth: int = 0) -> dict:
    """compilerOptions of a file and what it extends; the child's win. Paths of
    baseUrl are taken from the file that states it."""
    if depth > MAX_EXTENDS or path not in texts:
        return {}
    try:
        data = json.loads(strip_jsonc(texts[path]))
    except ValueError:
        return {}
    if not isinstance(data, dict):
        return {}
    here, out = posixpath.dirname(path), {}
    parents = data.get("extends") or []
    for parent in [parents] if isinstance(parents, str) else parents:
        if isinstance(parent, str) and parent.startswith("."):
            target = posixpath.normpath(posixpath.join(here, parent))
            for p in (target, target + ".json"):
                out.update(ts_options(p, texts, depth + 1))
    own = data.get("compilerOptions")
    if isinstance(own, dict):
        out.update(own)
    return out


def ts_aliases(path: str, texts: dict[str, str]) -> list[tuple]:
    """Rows of ``ALIASES_DDL``: the longest literal prefix first."""
    options = ts_options(path, texts)
    paths, base = options.get("paths"), options.get("baseUrl", ".")
    if not isinstance(paths, dict) or not isinstance(base, str):
        return []
    rows = []
    for pattern, targets in paths.items():
        wild = "*" in pattern
        prefix, _, suffix = pattern.partition("*")
        for t in targets if isinstance(targets, list) else []:
            rows.append((prefix, suffix, wild, posixpath.normpath(posixpath.join(base, t)) if t else t))
    rows.sort(key=lambda r: -len(r[0]))
    return [(posixpath.dirname(path), *r, i) for i, r in enumerate(rows)]


def wanted():
    """Whether a path may name a manifest, or a file that one extends."""
    name = basename(F.col("path"))
    return (F.size(F.split("path", "/")) <= MAX_DEPTH) & (name.isin(*NAMES) | name.rlike(r"^[tj]sconfig\..*\.json$|^tsconfig.*\.json$"))


def discover(spark: SparkSession, tree: DataFrame) -> dict[str, DataFrame]:
    """Frames ``aliases``, ``dart`` and ``go`` of the manifests of a tree of
    (path, content). Only manifests, small files near the root, reach the
    driver; extended files need the name of a manifest or end in .json."""
    rows = tree.where(wanted() & (F.length("content") < 1 << 20)).select("path", F.col("content").cast("string").alias("t")).collect()
    texts = {r["path"]: r["t"] for r in rows}
    aliases, dart, go = [], [], []
    for path, text in sorted(texts.items()):
        base, here = posixpath.basename(path), posixpath.dirname(path)
        if base in NAMES[:2]:
            aliases += ts_aliases(path, texts)
        elif base == "pubspec.yaml":
            if m := re.search(r"(?m)^name:\s*['\"]?([\w.-]+)", text):
                dart.append((m[1], posixpath.join(here, "lib")))
        elif base == "go.mod":
            if m := re.search(r"(?m)^module\s+\"?([^\s\"]+)", text):
                go.append((m[1], here))
    frame = spark.createDataFrame
    return {"aliases": frame(aliases, ALIASES_DDL), "dart": frame(dart, "name string, lib_dir string"), "go": frame(go, "path string, dir string")}
