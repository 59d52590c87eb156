"""The engine's calls: index, search, trace, coverage, changes, records, usage.

Each call answers with a dict of plain values; lists are pages of at most 1000
rows, so what reaches the driver is bounded. A call is journalled with the names
of its arguments, never their values. Errors have a code."""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph import schema as s
from strandgraph.extract.files import KINDS
from strandgraph.functions.patterns import checked
from strandgraph.operators import build, coverage, graph, journal, mutate, paging, resolve, search
from strandgraph.schema import GraphError
from strandgraph.sources import manifests, repo
from strandgraph.storage import Store, Version, checkpoint_folder

ROUTES, ENTRY_POINTS, LARGEST, EXAMPLES = 50, 50, 15, 25
MAX_PATHS, MAX_SCOPES = 128, 32
ATLAS = (20, 220, 600)
#: Characters that make a query a pattern.
PATTERN_SIGNS = set("^$*+?[](){}|\\")


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _first(key: str, df: DataFrame, order) -> dict:
    """The first rows of a list, how many there are, and whether that is all."""
    rows, total = _rows(df.orderBy(*order).limit(paging.MOST)), df.count()
    return {key: rows, f"{key}_total": total, f"{key}_cut": total > len(rows)}


class Phases:
    """Milliseconds of each phase of a run."""

    def __init__(self):
        self.ms, self.began = {}, time.time()
        self.last = self.began

    def __call__(self, name: str):
        now = time.time()
        self.ms[name] = self.ms.get(name, 0) + int((now - self.last) * 1000)
        self.last = now

    def report(self) -> dict:
        return {"duration_ms": int((time.time() - self.began) * 1000), "phase_ms": {k: self.ms.get(k, 0) for k in ("walk", "hash", "parse", "load_facts", "resolve_edges", "answers", "report")}}


def hinted(name: str, out):
    """Says how to go on where an answer is one page of several."""
    if isinstance(out, dict) and out.get("has_more") and out.get("cursor"):
        out["next_step"] = f"more rows: call {name} again with cursor='{out['cursor']}' and the same arguments"
    return out


def call(f):
    """Times and journals a call."""

    def run(self, **arguments):
        began, code, out = time.time(), None, None
        try:
            out = hinted(f.__name__, f(self, **arguments))
            return out
        except GraphError as e:
            code = e.code
            raise
        finally:
            self._log(f.__name__, arguments, int((time.time() - began) * 1000), code, out)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


class Engine:
    def __init__(self, spark: SparkSession, home: str, clock=time.time, journalled: bool = True):
        self.spark, self.home, self.clock, self.journalled = spark, home.rstrip("/"), clock, journalled
        self.store = Store(spark, f"{self.home}/projects")
        self.records = Store(spark, f"{self.home}/records")
        checkpoint_folder(spark, f"{self.home}/checkpoints")

    # journal

    def _log(self, tool, arguments, took, code, out):
        if not self.journalled:
            return
        total = out.get("total") if isinstance(out, dict) else None
        more = out.get("has_more") if isinstance(out, dict) else None
        row = (int(self.clock()), tool, sorted(arguments), arguments.get("project"), took, code is None, code, total, more)
        names = [c.split()[0] for c in s.JOURNAL.split(", ")]
        line = json.dumps({k: v for k, v in zip(names, row) if v is not None}) + "\n"
        # a small file by the file system itself: no job a call
        path, fs = self.store._fs(f"{self.home}/journal/{time.time_ns():020d}-{uuid.uuid4().hex}.json")
        out = fs.create(path)
        out.write(bytearray(line.encode()))
        out.close()

    def journal(self) -> DataFrame:
        """Journal rows in file order; malformed lines are skipped."""
        if not self.store.exists(f"{self.home}/journal"):
            return self.spark.createDataFrame([], s.JOURNAL).withColumn("seq", F.lit(""))
        df = self.spark.read.schema(s.JOURNAL).option("mode", "DROPMALFORMED").json(f"{self.home}/journal")
        return df.withColumn("seq", F.concat(F.col("_metadata.file_modification_time").cast("string"), F.col("_metadata.file_name")))

    def usage(self, window: str = "all") -> dict:
        """Summary of the journal: totals, tools, projects, pairs and sessions."""
        j = journal.window(self.journal(), window, int(self.clock()))
        out = _rows(journal.totals(j))[0]
        out |= {"by_tool": {r["tool"]: r["n"] for r in _rows(journal.counts(j, "tool"))}, "by_error_code": {r["error_code"]: r["n"] for r in _rows(journal.counts(j, "error_code"))}}
        out["by_tool_stats"] = {r.pop("tool"): r for r in _rows(journal.tool_stats(j))}
        aliases = self._aliases()
        out["common_sequences"] = [(r["sequence"], r["n"]) for r in _rows(journal.sequences(j))]
        for key, df, order in (("by_project", journal.projects(j, aliases), [F.desc("calls"), F.asc_nulls_first("project")]), ("sessions", journal.sessions(j, aliases), ["session"])):
            out |= _first(key, df, order)
        out["window"] = window
        return out

    # catalog

    def catalog(self) -> DataFrame:
        v = self.records.current("catalog")
        return v.get("projects") if v else self.spark.createDataFrame([], s.PROJECTS)

    def _aliases(self) -> DataFrame:
        """Names that mean a project: its name, or its root's last part, where
        only one project has it."""
        c = self.catalog()
        named = c.select("id", F.explode(F.array("name", F.element_at(F.split("root", "/"), -1))).alias("alias")).distinct()
        only = named.groupBy("alias").agg(F.count("*").alias("n"), F.min("id").alias("canonical")).where("n = 1")
        return only.join(c.select(F.col("id").alias("alias")), "alias", "left_anti").select("alias", "canonical")

    def _save_catalog(self, df: DataFrame):
        self.records.write("catalog", projects=df.coalesce(1))

    def _project(self, name: str) -> str:
        ids = {r["id"] for r in self.catalog().where(F.col("id") == name).collect()}
        found = ids or {r["canonical"] for r in self._aliases().where(F.col("alias") == name).collect()}
        if len(found) != 1:
            raise GraphError("project_not_found", f"no project '{name}'")
        return found.pop()

    def _allocate(self, root: str, name: str | None) -> str:
        known = {r["root"]: r["id"] for r in self.catalog().select("root", "id").collect()}
        if root in known:
            return known[root]
        clean = re.sub(r"[^A-Za-z0-9._-]", "-", name or root.rsplit("/", 1)[-1]).strip("-.") or "project"
        return f"{clean}-{hashlib.sha256(root.encode()).hexdigest()[:8]}" if clean in known.values() else clean

    def open(self, project: str) -> build.Graph:
        """The frames of a project's current snapshot."""
        v = self.store.current(self._project(project))
        if v is None:
            raise GraphError("index_missing", f"'{project}' has no complete index")
        return build.Graph(self._files(v), v.get("extracts"), v.get("nodes"), self._edges(v))

    def _files(self, v: Version) -> DataFrame:
        """Files, with the times that were noted since where contents stayed the same."""
        if not v.has("times"):
            return v.get("files")
        times = v.get("times").groupBy("path").agg(F.max_by("mtime_ns", "noted_at").alias("mtime_ns"))
        return mutate.set_times(v.get("files"), times)

    def _edges(self, v: Version) -> DataFrame:
        """Edges, with those observed since."""
        edges = v.get("edges")
        return edges.unionByName(v.get("traces").select(edges.columns)) if v.has("traces") else edges

    def views(self, project: str) -> list[str]:
        """Registers the snapshot as temporary views nodes, edges, files, and one
        for each kind of fact, for SQL."""
        g = self.open(project)
        frames = {"nodes": g.nodes, "edges": g.edges, "files": g.files, **{k: g.facts(k) for k in KINDS}}
        for name, df in frames.items():
            df.createOrReplaceTempView(name)
        return list(frames)

    @call
    def list_projects(self, limit=None, cursor=None):
        n, at = paging.clamp(limit, 50), paging.offset_of(cursor)
        c = self.catalog()
        rows = _rows(paging.page(c.withColumnRenamed("id", "project"), ["project"], n, at))
        for r in rows:
            r["graph_present"] = self.store.current(r["project"]) is not None
        return {"projects": rows, **paging.page_info(c.count(), len(rows), at, n)}

    @call
    def index_repository(self, repo_path, name=None, full=False, answers: DataFrame | None = None):
        """Indexes a tree; files that did not change keep their facts.
        ``answers(file_path, line, target_file, target_line)`` of language
        servers upgrade unresolved calls."""
        took = Phases()
        root = repo_path.rstrip("/")
        project = self._allocate(root, name)
        tree = repo.listing(self.spark, root)
        tree = repo.candidates(tree, repo.ignore_rules(tree, root)).checkpoint()
        before = None if full else self.store.current(project)
        took("walk")
        if before is None:
            files = removed = None
        else:
            # size and time decide what is read; contents decide what is parsed
            known = self._files(before)
            differs = coverage.stale(tree, known).checkpoint()
            read = repo.classified(repo.with_content(tree.join(differs, "path", "left_semi"))).checkpoint()
            recorded = known.join(differs, "path", "left_semi")
            change = {r["change"]: r["n"] for r in _rows(coverage.changes(read, recorded).groupBy("change").agg(F.count("*").alias("n")))}
            removed = change.get("removed", 0)
            took("hash")
            if not set(change) - {"unchanged"} and answers is None:
                if change:
                    before.append("times", read.select("path", "mtime_ns", F.lit(time.time_ns()).alias("noted_at")))
                return self._report(project, root, before, {"files_reparsed": 0, "files_removed": 0}, took)
            same = known.join(differs, "path", "left_anti")
            partial = F.col("status") == "parse_partial"
            same = same.withColumns({"reason": F.when(~partial, F.col("reason")), "detail": F.when(~partial, F.col("detail"))}).withColumn("status", F.when(partial, "indexed").otherwise(F.col("status")))
            files = read.unionByName(same.select(read.columns))
        v = self.store.begin(project)
        if files is None:
            files = repo.classified(repo.with_content(tree))
        files = v.put("raw", repo.dealt(files, F.xxhash64("path")))
        found = manifests.discover(self.spark, repo.with_content(tree.where(manifests.wanted())))
        took("hash")
        extracts = v.put("extracts", build.parse(files) if before is None else build.refreshed(files, known, before.get("extracts")))
        parsed = files if before is None else files.join(known.select("path", "hash"), ["path", "hash"], "left_anti")
        counts = {"files_reparsed": parsed.where("status = 'indexed'").count(), "files_removed": removed or 0}
        took("parse")
        g = build.build(files, extracts, found, lambda table, df: v.put(table, df) if table != "edges" else df)
        took("load_facts")
        edges = g.edges
        if answers is not None:
            edges = self._answered(g.nodes, edges, answers)
            took("answers")
        if before is not None:
            edges = self._kept_traces(before, g.nodes, edges)
        v.put("edges", edges)
        took("resolve_edges")
        self.store.delete(f"{v.path}/raw")
        v.commit()
        now = int(self.clock())
        entry = self.spark.createDataFrame([(project, name or root.rsplit("/", 1)[-1], root, v.path, now)], s.PROJECTS)
        self._save_catalog(self.catalog().where(F.col("id") != project).unionByName(entry))
        return self._report(project, root, v, counts, took)

    def _report(self, project, root, v: Version, counts: dict, took: Phases) -> dict:
        files, nodes = self._files(v), v.get("nodes")
        c = _rows(coverage.summary(files))[0]
        census = {r["key"]: r["n"] for r in _rows(graph.edge_census(self._edges(v))) if r["kind"] == "type"}
        partial = files.where("status = 'parse_partial'").orderBy("path").limit(EXAMPLES).select("path")
        out = {
            "project": project, "root": root, "store_path": v.path, "nodes": nodes.count(), "edges": sum(census.values()), "edge_types": census,
            "files_seen": c["total"], "files_indexed": c["indexed"], "files_parse_partial": c["parse_partial"], "files_skipped": c["skipped"], **counts,
            "files_unchanged": c["indexed"] + c["parse_partial"] - counts["files_reparsed"], "languages": {r["language"]: r["n"] for r in _rows(graph.language_counts(nodes))},
            "parse_partial_examples": [r["path"] for r in partial.collect()], "skipped_examples": _rows(coverage.sample(files.where("status = 'skipped'"), EXAMPLES)), "bundled_languages": list(s.LANGUAGES),
        }
        took("report")
        return {**out, **took.report()}

    def _answered(self, nodes, edges, answers):
        own = nodes.select(F.col("id").alias("src"), F.col("file_path").alias("from_file"))
        at = edges.where("edge_type = 'CALL_UNRESOLVED'").join(own, "src").select(F.col("id").alias("edge_id"), "from_file", F.col("line").alias("from_line"))
        a = answers.join(at, (answers["file_path"] == at["from_file"]) & (answers["line"] == at["from_line"])).select("edge_id", F.col("target_file").alias("file_path"), F.col("target_line").alias("line"))
        more = resolve.apply_answers(edges, a, nodes).withColumns({"id": -F.col("edge_id"), "detail": F.lit(None).cast("string")}).drop("edge_id")
        return edges.unionByName(more.select(edges.columns))

    def _kept_traces(self, before, nodes, edges):
        """Observed edges outlive a rebuild while both ends do."""
        old = before.get("nodes").select("id", "qualified_name", "file_path")
        now = nodes.groupBy("qualified_name", "file_path").agg(F.min("id").alias("new"))
        to = old.join(now, ["qualified_name", "file_path"]).select("id", "new")
        t = self._edges(before).where("edge_type = 'IMPACTS'")
        t = t.join(to.select(F.col("id").alias("src"), F.col("new").alias("s2")), "src").join(to.select(F.col("id").alias("dst"), F.col("new").alias("d2")), "dst")
        t = t.withColumns({"src": F.col("s2"), "dst": F.col("d2"), "id": -F.xxhash64("s2", "d2", "detail")})
        return edges.unionByName(t.select(edges.columns))

    @call
    def delete_project(self, project):
        row = self.catalog().where(F.col("id") == project).collect()
        if not row:
            raise GraphError("project_not_found", f"no project '{project}'")
        gone = self.store.delete(self.store.base(project))
        self._save_catalog(self.catalog().where(F.col("id") != project))
        return {"deleted": project, "root": row[0]["root"], "store_path_removed": gone}

    @call
    def index_status(self, project):
        g = self.open(project)
        c = _rows(coverage.summary(g.files))[0]
        c["examples"] = _rows(coverage.sample(g.files.where("status <> 'indexed'"), EXAMPLES))
        named = lambda df, k: {r[k]: r["n"] for r in _rows(df)}
        return {"project": self._project(project), "nodes": g.nodes.count(), "edges": g.edges.count(), "files": c["total"], "languages": named(graph.language_counts(g.nodes), "language"), "labels": named(graph.label_counts(g.nodes), "label"), "coverage": c}

    @call
    def check_index_coverage(self, project, paths=None, scopes=None, limit=None, cursor=None):
        g, n, at = self.open(project), paging.clamp(limit, 200), paging.offset_of(cursor)
        if len(paths or ()) > MAX_PATHS or len(scopes or ()) > MAX_SCOPES:
            raise GraphError("invalid_argument", f"at most {MAX_PATHS} paths and {MAX_SCOPES} scopes")
        root = self.catalog().where(F.col("id") == self._project(project)).first()["root"]
        out = {"paths": [], "scopes": []}
        if paths:
            tree = repo.listing(self.spark, root)
            rules, there = repo.ignore_rules(tree, root), {r["path"] for r in tree.where(F.col("path").isin(*paths)).select("path").collect()}
            asked = self.spark.createDataFrame([(repo.safe_relative(p, root), rules.excluded(p), p in there) for p in paths], "path string, excluded boolean, present boolean")
            out["paths"] = _rows(coverage.classify_paths(asked, g.files).orderBy("path"))
        more, total = False, 0
        for scope in scopes or ([] if paths else ["."]):
            f = coverage.in_scope(g.files, scope).select("path", "status", "reason", "detail", "language")
            rows, count = _rows(paging.page(f, ["path"], n, at)), f.count()
            info = paging.page_info(count, len(rows), at, n)
            out["scopes"].append({"scope": scope, "files": rows, "total": count, "has_more": info["has_more"]})
            more, total = more or info["has_more"], total + count
        return {**out, "total": total, "has_more": more, "cursor": str(at + n) if more else None}

    @call
    def detect_changes(self, project, limit=None, cursor=None):
        g, n, at = self.open(project), paging.clamp(limit, 200), paging.offset_of(cursor)
        root = self.catalog().where(F.col("id") == self._project(project)).first()["root"]
        tree = repo.listing(self.spark, root)
        tree = repo.candidates(tree, repo.ignore_rules(tree, root))
        # only files whose size or time differ are read
        differs = coverage.stale(tree, g.files)
        read = repo.classified(repo.with_content(tree.join(differs, "path", "left_semi"))).select("path", "hash")
        same = tree.join(differs, "path", "left_anti").join(g.files.select("path", "hash"), "path").select("path", "hash")
        changed = coverage.changes(read.unionByName(same), g.files).checkpoint()
        rows = coverage.changed_symbols(changed, g.nodes)
        page = _rows(paging.page(rows, ["path"], n, at))
        counts = _rows(coverage.change_counts(changed))[0]
        return {**counts, "files": page, **paging.page_info(counts["added"] + counts["modified"] + counts["removed"], len(page), at, n)}

    # graph

    @call
    def search_graph(self, project, name=None, query=None, qualified_name=None, name_pattern=None, label=None, file_pattern=None, limit=None, cursor=None):
        if query is not None and name is None and name_pattern is None:
            name, name_pattern = (None, query) if set(query) & PATTERN_SIGNS else (query, None)
        g, n, at = self.open(project), paging.clamp(limit, 50), paging.offset_of(cursor)
        hits = search.search(g.nodes, name=name, qualified_name=qualified_name, name_pattern=name_pattern, label=label, file_pattern=file_pattern)
        page = paging.page(hits, search.SEARCH_ORDER, n, at)
        rows = _rows(graph.degrees(page, g.edges, few=True).orderBy(*search.SEARCH_ORDER).select("qualified_name", "name", "label", "file_path", "start_line", "end_line", "language", "signature", "in_degree", "out_degree"))
        out = {"results": rows, **paging.page_info(hits.count(), len(rows), at, n, exact=True)}
        return out if rows else {**out, "note": "no symbol matches; coverage may explain why"}

    @call
    def query_graph(self, project, start, hops=(), limit=None, cursor=None):
        g, n, at = self.open(project), paging.clamp(limit, 50), paging.offset_of(cursor)
        start = dict({"qualified_name": start} if isinstance(start, str) else start)
        asked = start.pop("query", None)
        if asked is not None and not start.keys() & {"name", "name_pattern", "qualified_name"}:
            start["name_pattern" if set(asked) & PATTERN_SIGNS else "name"] = asked
        starts = search.search(g.nodes, **start).orderBy(*search.SEARCH_ORDER).limit(paging.MOST)
        hops = [{"edge": h} if isinstance(h, str) else {**h, "edge": h.get("edge") or h.get("edge_type")} for h in hops]
        paths = graph.pattern(starts, g.nodes, g.edges, hops)
        keys = [f"n{i}.qualified_name" for i in range(len(hops) + 1)]
        rows = [{"path": list(r.values())} for r in _rows(paging.page(paths, keys, n, at))]
        return {"rows": rows, **paging.page_info(paths.count(), len(rows), at, n)}

    def _symbol(self, g, name: str) -> DataFrame:
        found = search.resolve_symbol(g.nodes, name)
        rows = found.select("id", "qualified_name").limit(10).collect()
        if not rows:
            raise GraphError("symbol_not_found", f"no symbol '{name}'")
        if len(rows) > 1:
            raise GraphError("ambiguous_symbol", f"'{name}' is one of: {', '.join(r['qualified_name'] for r in rows)}")
        return g.nodes.where(F.col("id") == rows[0]["id"])

    @call
    def trace_path(self, project, qualified_name=None, name=None, direction="both", depth=3, limit=None, cursor=None, **also):
        """Callers and callees; ``from`` is another word for ``name``."""
        name = name or also.pop("from", None)
        if also:
            raise GraphError("invalid_argument", f"unknown argument '{min(also)}'")
        g, n, at = self.open(project), paging.clamp(limit, 100), paging.offset_of(cursor)
        root = self._symbol(g, qualified_name or name or "")
        way = graph.direction(direction)
        rows = graph.trace(root, g.nodes, g.edges, way, depth).checkpoint()
        out, more = {"root": root.first()["qualified_name"]}, False
        for side in ("callers", "callees"):
            part = rows.where(F.col("side") == side).drop("side")
            page, total = _rows(paging.page(part, ["hop", "qualified_name", "file_path", "start_line"], n, at)), part.count()
            out |= {side: page, f"{side}_total": total}
            more = more or at + len(page) < total
        un = graph.unresolved_of(root, g.nodes, g.edges) if way != graph.IN else None
        out |= _first("unresolved", un, ["callee_name", "line"]) if un is not None else {"unresolved": [], "unresolved_total": 0, "unresolved_cut": False}
        return {**out, "has_more": more, "cursor": str(at + n) if more else None}

    @call
    def get_code_snippet(self, project, qualified_name=None, name=None, context_lines=0):
        g = self.open(project)
        node = self._symbol(g, qualified_name or name or "")
        row, file = node.first(), g.files.where(F.col("path") == node.first()["file_path"]).first()
        rows = _rows(search.snippet(g.files.where("text is not null"), node, context_lines))
        if not rows:
            raise GraphError("source_unavailable", f"{row['file_path']} has no text")
        note = None if file["status"] == "indexed" else f"{file['status']}: {file['reason']}"
        return {**rows[0], "signature": row["signature"], "coverage_note": note}

    @call
    def get_graph_schema(self):
        return {"node_labels": list(s.NODE_LABELS), "edge_types": list(s.EDGE_TYPES), "evidence_values": list(s.EVIDENCE), "coverage_statuses": list(s.STATUSES), "coverage_reasons": list(s.REASONS), "bundled_languages": list(s.LANGUAGES)}

    @call
    def get_architecture(self, project, path=""):
        g = self.open(project)
        n = search.search(g.nodes, scope=path)
        routes = graph.route_handlers(n, g.edges.where("edge_type = 'ROUTES_TO'")) if not path else graph.route_handlers(g.nodes, g.edges).join(n.select("id"), "id", "left_semi")
        routes = routes.select(F.col("extra")["method"].alias("method"), F.col("name").alias("path"), "handler", "file_path", F.col("start_line").alias("line"))
        named = lambda df, k: {r[k]: r["n"] for r in _rows(df)}
        entry = graph.entry_points(n, g.edges).select("qualified_name", "file_path", "start_line")
        return {
            "languages": named(graph.language_counts(g.nodes, path), "language"), "labels": named(graph.label_counts(g.nodes, path), "label"),
            "routes": _rows(routes.orderBy("path", "method", "file_path", "line").limit(ROUTES)), "entry_points": _rows(entry.orderBy("qualified_name", "file_path", "start_line").limit(ENTRY_POINTS)),
            "largest_files": _rows(graph.largest_files(g.nodes, path, LARGEST)),
        }

    @call
    def search_code(self, project, pattern=None, query=None, regex=False, case_sensitive=True, file_pattern=None, path=None, limit=None, cursor=None):
        pattern, file_pattern = pattern if pattern is not None else query, file_pattern if file_pattern is not None else path
        if not pattern:
            raise GraphError("invalid_argument", "a pattern is needed")
        if regex:
            checked(pattern)
        g, n, at = self.open(project), paging.clamp(limit, 50), paging.offset_of(cursor)
        hits = search.search_files(g.files.where("status <> 'skipped'"), pattern, regex=regex, case_sensitive=case_sensitive, file_pattern=file_pattern).withColumnRenamed("path", "file_path")
        page = paging.page(hits, ["file_path", "line"], n, at).withColumn("id", F.concat_ws(":", "file_path", "line"))
        inner = graph.innermost(page, g.nodes.where("label not in ('File', 'Package')"))
        name = g.nodes.select(F.col("id").alias("span_id"), F.col("qualified_name").alias("in_symbol"))
        rows = _rows(inner.join(name, "span_id", "left").orderBy("file_path", "line").select("file_path", "line", "text", "in_symbol"))
        return {"matches": rows, **paging.page_info(hits.count(), len(rows), at, n)}

    @call
    def atlas(self, project, view="overview", seed=None, depth=2, limit=0):
        """Nodes and edges around a symbol, or around the hubs of a view."""
        if view not in graph.VIEW_EDGES:
            raise GraphError("invalid_argument", f"unknown view '{view}'")
        g, low, usual, high = self.open(project), *ATLAS
        limit = usual if not limit else max(low, min(high, limit))
        types, labels = graph.VIEW_EDGES[view], graph.VIEW_LABELS[view]
        starts = self._symbol(g, seed) if seed else graph.hubs(g.nodes, g.edges, labels, types, max(limit // 5, 12))
        nodes, edges = graph.walk(starts, g.nodes, g.edges, types, labels, max(1, min(6, depth)) if seed else 2, limit)
        shown = nodes.join(g.nodes, "id").select("id", "hop", "label", "qualified_name", "file_path", "start_line")
        rows = _rows(shown.orderBy("hop", "qualified_name", "id").limit(high))
        return {"view": view, "nodes": rows, "edges": _rows(edges.orderBy("src", "dst", "edge_type").limit(high * high)), "truncated": len(rows) >= limit}

    # records

    def _adrs(self, project) -> DataFrame:
        v = self.records.current(f"adr-{project}")
        return v.get("adrs") if v else self.spark.createDataFrame([], s.ADRS)

    @call
    def manage_adr(self, project, mode="list", id=None, title=None, status="proposed", body="", related_qualified_names=()):
        key = self._project(project)
        have = self._adrs(key)
        if mode == "list":
            return _first("adrs", have, ["id"])
        if not id:
            raise GraphError("invalid_argument", "an id is needed")
        row = have.where(F.col("id") == id).first()
        if mode == "get":
            if row is None:
                raise GraphError("adr_not_found", f"no record '{id}'")
            return {"adr": row.asDict(recursive=True)}
        rest = have.where(F.col("id") != id)
        if mode == "delete":
            self.records.write(f"adr-{key}", adrs=rest.coalesce(1))
            return {"deleted": row is not None}
        if mode != "save":
            raise GraphError("invalid_argument", f"unknown mode '{mode}'")
        names = list(dict.fromkeys(related_qualified_names))
        n = self.open(project).nodes
        linked = {}
        for x in names:
            hits = _rows(graph.ranked_by_name(search.resolve_symbol(n, x)).select("qualified_name", "file_path", "start_line").limit(2))
            if len(hits) == 1:  # a name that several symbols have links none
                linked[x] = hits[0]
        entry = (id, title or (row["title"] if row else id), status, body, [linked[x] for x in names if x in linked], int(self.clock()))
        self.records.write(f"adr-{key}", adrs=rest.unionByName(self.spark.createDataFrame([entry], s.ADRS)).coalesce(1))
        return {"saved": id, "related": [linked[x] for x in names if x in linked], "unresolved": [x for x in names if x not in linked]}

    @call
    def ingest_traces(self, project, traces):
        """Observed calls become IMPACTS edges where both ends are one symbol."""
        key = self._project(project)
        v = self.store.current(key)
        seen = traces if isinstance(traces, DataFrame) else self.spark.createDataFrame([(t["caller"], t["callee"], int(t.get("count", 1))) for t in traces], "caller string, callee string, count long")
        linked = resolve.link_traces(seen, v.get("nodes")).checkpoint()
        good = linked.where("src is not null and dst is not null")
        blank = {"edge_type": F.lit("IMPACTS"), "source": F.lit("trace"), "confidence": F.lit(1.0).cast("float"), "target_name": F.col("callee"), "line": F.lit(None).cast("int")}
        fresh = good.withColumns(blank).withColumn("id", -F.xxhash64("src", "dst", "detail", F.lit(self.clock())))
        v.append("traces", fresh.select(v.get("edges").columns))
        bad = linked.where("src is null or dst is null")
        return {"linked": good.count(), **_first("unmatched", bad.select("caller", "callee"), ["caller", "callee"])}
