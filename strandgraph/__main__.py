"""Command line: python -m strandgraph --home DIR CALL [name=value ...], or one of
the short forms index, status, query, changes and delete."""

from __future__ import annotations

import argparse
import json
import sys

CALLS = (
    "list_projects", "index_repository", "delete_project", "index_status", "check_index_coverage", "detect_changes", "search_graph", "query_graph", "trace_path",
    "get_code_snippet", "get_graph_schema", "get_architecture", "search_code", "manage_adr", "ingest_traces", "atlas", "usage",
)


def value(text: str):
    """JSON where it is JSON, else the text; cursors stay text."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandgraph", description=__doc__)
    p.add_argument("--home", required=True, help="folder of snapshots, records and journal")
    verbs = p.add_subparsers(dest="call", required=True, metavar="CALL")
    for name in CALLS:
        verbs.add_parser(name).add_argument("arguments", nargs="*", metavar="name=value")
    index = verbs.add_parser("index", help="index a repository")
    index.add_argument("path")
    index.add_argument("--name")
    index.add_argument("--full", action="store_true", help="read and parse every file")
    status = verbs.add_parser("status", help="what is indexed; every project without a name")
    status.add_argument("project", nargs="?")
    status.add_argument("--agent-usage", action="store_true", help="how the calls have been used")
    query = verbs.add_parser("query", help="search for symbols")
    query.add_argument("--project", required=True)
    for name in ("name", "pattern", "label", "file"):
        query.add_argument(f"--{name}")
    query.add_argument("--limit", type=int, default=25)
    changes = verbs.add_parser("changes", help="files that changed since the last run")
    changes.add_argument("project")
    changes.add_argument("--limit", type=int, default=50)
    verbs.add_parser("delete", help="delete a project's graph").add_argument("project")
    return p


def asked(a: argparse.Namespace) -> tuple[str, dict]:
    """The engine's call and its arguments."""
    if a.call == "index":
        return "index_repository", {"repo_path": a.path, "name": a.name, "full": a.full}
    if a.call == "status":
        return ("usage", {}) if a.agent_usage else ("index_status", {"project": a.project}) if a.project else ("list_projects", {})
    if a.call == "query":
        given = {"name": a.name, "name_pattern": a.pattern, "label": a.label, "file_pattern": a.file}
        return "search_graph", {"project": a.project, "limit": a.limit, **{k: v for k, v in given.items() if v is not None}}
    if a.call == "changes":
        return "detect_changes", {"project": a.project, "limit": a.limit}
    if a.call == "delete":
        return "delete_project", {"project": a.project}
    pairs = dict(x.partition("=")[::2] for x in a.arguments)
    return a.call, {k: v if k == "cursor" else value(v) for k, v in pairs.items()}


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    name, arguments = asked(a)

    from pyspark.sql import SparkSession

    from strandgraph.api import Engine
    from strandgraph.schema import GraphError

    engine = Engine(SparkSession.builder.appName("strandgraph").getOrCreate(), a.home)
    try:
        out = getattr(engine, name)(**arguments)
    except GraphError as e:
        print(json.dumps({"error": e.code, "message": str(e)}), file=sys.stderr)
        return 1
    print(json.dumps(out, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
