"""Extraction over a frame of files: one row per file in, facts out.

A file is parsed in one Python call, in Arrow batches; Catalyst does the rest.
Rows carry all kinds of facts in arrays and ``facts`` explodes one kind, so a
kind that is not asked for is pruned after the parse."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.extract import code, formats, python_source
from strandgraph.extract.facts import Facts

BY_LANGUAGE = {"python": python_source.extract, "toml": formats.toml, "yaml": formats.yaml, "ini": formats.ini, "bash": formats.bash, "make": formats.make, "cmake": formats.cmake, "html": formats.html}

KINDS = {
    "definitions": "label string, name string, qualified_name string, start_line int, end_line int, signature string, returns string",
    "calls": "from_qualified_name string, callee_name string, receiver string, line int, character int",
    "imports": "target string, line int",
    "relations": "subtype_qualified_name string, supertype_name string, edge_type string, line int",
    "routes": "method string, path string, handler_name string, handler_receiver string, line int, end_line int, framework string",
    "bindings": "variable string, constructor string",
    "errors": "first_line int, last_line int",
}
_ARROW = {"string": pa.string(), "int": pa.int32()}


def extract(language: str, path: str, text: str) -> Facts:
    """The facts of one file. Headers are read as C++ where that fits better."""
    if language in BY_LANGUAGE:
        return BY_LANGUAGE[language](path, text)
    out = code.extract(language, path, text)
    if language == "c" and path.endswith(".h") and any(w in text for w in ("class ", "namespace ", "template", "public:", "::")):
        other = code.extract("cpp", path, text)
        if len(other.errors) <= len(out.errors):
            return other
    return out


def _fields(kind: str) -> list[tuple[str, str]]:
    return [tuple(f.split()) for f in KINDS[kind].split(", ")]


def extracted(files: DataFrame) -> DataFrame:
    """``files(path, language, text)`` -> path, language, and an array a kind."""
    types = {k: pa.list_(pa.struct([(n, _ARROW[t]) for n, t in _fields(k)])) for k in KINDS}
    schema = "path string, language string, " + ", ".join(f"{k} array<struct<{', '.join(f'{n}: {t}' for n, t in _fields(k))}>>" for k in KINDS)

    def run(batches):
        for b in batches:
            rows = []
            for path, language, text in zip(*(b.column(c).to_pylist() for c in ("path", "language", "text"))):
                try:
                    rows.append(extract(language, path, text or ""))
                except Exception:  # one bad file must not fail the job; it is reported
                    rows.append(Facts(errors=[(1, (text or "").count("\n") + 1)]))
            names = {k: [n for n, _ in _fields(k)] for k in KINDS}
            cells = {k: pa.array([[dict(zip(names[k], x)) for x in getattr(r, k)] for r in rows], types[k]) for k in KINDS}
            yield pa.RecordBatch.from_pydict({"path": b.column("path"), "language": b.column("language"), **cells})

    return files.select("path", "language", "text").mapInArrow(run, schema)


def facts(rows: DataFrame, kind: str) -> DataFrame:
    """The facts of one kind, a row each, with file_path and language."""
    return rows.select(F.col("path").alias("file_path"), "language", F.explode(kind).alias("f")).select("file_path", "language", "f.*")
