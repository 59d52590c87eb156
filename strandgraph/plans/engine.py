"""Registered queries of the engine's calls, over a source tree made from all
documents: one module each, with a function that calls another one's."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from strandgraph.api import Engine
from strandgraph.sources import repo, views
from strandgraph.storage import checkpoint_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}
FOLDERS, STEP, SHIFT = 10, 7, 3
_engines: dict = {}

TREE = f"""n AS (SELECT count(*) AS c FROM documents), f AS (SELECT doc_id AS i, (doc_id * {STEP} + {SHIFT}) % c AS j, 'p' || (doc_id % {FOLDERS}) || '/m' || doc_id || '.py' AS path, 'p' || (doc_id % {FOLDERS}) || '.m' || doc_id || '.f_' || doc_id AS qn FROM documents, n)"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _put(engine: Engine, path: str, text: str):
    at, fs = engine.store._fs(path)
    out = fs.create(at)
    out.write(bytearray(text.encode()))
    out.close()


def _write_modules(spark, engine: Engine, d: str, tree: str):
    """One module for each document, written by the executors side by side."""
    for k in range(FOLDERS):
        at, fs = engine.store._fs(f"{tree}/p{k}")
        fs.mkdirs(at)
    ids = views.load(spark, d, "documents").select("doc_id")
    n, top = ids.count(), fs.makeQualified(at).getParent().toString()

    def run(batches):
        from pyarrow import fs

        system, base = (fs.LocalFileSystem(), re.sub("^file:/+", "/", top)) if top.startswith("file:") else fs.FileSystem.from_uri(top)
        for b in batches:
            for i in b.column("doc_id").to_pylist():
                with system.open_output_stream(f"{base}/p{i % FOLDERS}/m{i}.py") as out:
                    out.write(f"def f_{i}():\n    return f_{(i * STEP + SHIFT) % n}()\n".encode())
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    repo.dealt(ids, "doc_id").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def _built(spark, d, own: bool = False) -> tuple[Engine, str]:
    """An engine with the tree of ``d`` indexed, and the tree's folder; one for all
    calls that only ask, or one of its own."""
    key = (spark.sparkContext.applicationId, d)
    if own or key not in _engines:
        base = f"{checkpoint_folder(spark)}/engine-{uuid.uuid4().hex}"
        engine = Engine(spark, f"{base}/home", clock=lambda: 1_000_000)
        _write_modules(spark, engine, d, f"{base}/tree")
        _put(engine, f"{base}/tree/notes.txt", "plain\n")
        engine.report = engine.index_repository(repo_path=f"{base}/tree", name="t")
        if own:
            return engine, f"{base}/tree"
        _engines[key] = (engine, f"{base}/tree")
    return _engines[key]


def _frame(spark, rows, ddl):
    names = [c.split()[0] for c in ddl.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ddl)


@query(f"""WITH {TREE} SELECT 't' AS project, CAST(2 * c AS BIGINT) AS nodes, CAST(2 * c AS BIGINT) AS edges, CAST(c AS BIGINT) AS calls, CAST(c AS BIGINT) AS files_indexed, CAST(1 AS BIGINT) AS files_skipped, CAST(c AS BIGINT) AS files_reparsed,
CAST(c AS BIGINT) AS python FROM n""")
def api_index_repository(spark, d):
    r = _built(spark, d)[0].report
    return _frame(spark, [{**r, "calls": r["edge_types"]["CALLS"], "python": r["languages"]["python"]}], "project string, nodes long, edges long, calls long, files_indexed long, files_skipped long, files_reparsed long, python long")


@query(f"WITH {TREE} SELECT 'unchanged' AS run, CAST(0 AS BIGINT) AS files_reparsed, CAST(c AS BIGINT) AS files_unchanged, CAST(0 AS BIGINT) AS files_removed FROM n UNION ALL SELECT 'edited', 1, c - 1, 1 FROM n")
def api_reindex(spark, d):
    """Nothing changed, then one file edited and one removed."""
    engine, tree = _built(spark, d, own=True)
    _, fs = engine.store._fs(tree)
    runs = [{"run": "unchanged", **engine.index_repository(repo_path=tree)}]
    _put(engine, f"{tree}/p0/m0.py", "def f_0():\n    return 12345\n")
    engine.store.delete(f"{tree}/notes.txt")
    runs.append({"run": "edited", **engine.index_repository(repo_path=tree)})
    return _frame(spark, runs, "run string, files_reparsed long, files_unchanged long, files_removed long")


@query("SELECT 't' AS project, true AS graph_present")
def api_list_projects(spark, d):
    return _frame(spark, _built(spark, d)[0].list_projects()["projects"], "project string, graph_present boolean")


@query(f"""WITH {TREE}, i AS (SELECT j, count(*) AS n FROM f GROUP BY 1) SELECT qn AS qualified_name, path AS file_path, CAST(1 AS INTEGER) AS start_line, CAST(2 AS INTEGER) AS end_line, CAST(coalesce(n, 0) + 1 AS BIGINT) AS in_degree, CAST(1 AS BIGINT) AS out_degree,
(SELECT count(*) FROM f WHERE i % 10 = 7) AS total FROM f LEFT JOIN i ON i.j = f.i WHERE f.i % 10 = 7 ORDER BY qn LIMIT 40 OFFSET 10""")
def api_search_graph(spark, d):
    """A page of symbols with their degrees, and the total."""
    r = _built(spark, d)[0].search_graph(project="t", query="^f_[0-9]*7$", label="Function", limit=40, cursor="10")
    return _frame(spark, [{**x, "total": r["total"]} for x in r["results"]], "qualified_name string, file_path string, start_line int, end_line int, in_degree long, out_degree long, total long")


@query(f"WITH {TREE} SELECT a.qn AS q0, b.qn AS q1, c.qn AS q2 FROM f a JOIN f b ON b.i = a.j JOIN f c ON c.i = b.j WHERE a.i BETWEEN 10 AND 19")
def api_query_graph(spark, d):
    r = _built(spark, d)[0].query_graph(project="t", start={"query": "^f_1[0-9]$"}, hops=["CALLS", {"edge_type": "CALLS", "direction": "outbound"}], limit=1000)
    return spark.createDataFrame([tuple(c["qualified_name"] for c in x["path"]) for x in r["rows"]], "q0 string, q1 string, q2 string")


@query(f"""WITH RECURSIVE {TREE}, down AS (SELECT j AS x, 1 AS hop FROM f WHERE i = 5 UNION SELECT f.j, hop + 1 FROM down JOIN f ON f.i = down.x WHERE hop < 4), up AS (SELECT i AS x, 1 AS hop FROM f WHERE j = 5 UNION SELECT f.i, hop + 1 FROM up JOIN f ON f.j = up.x WHERE hop < 4)
SELECT 'callees' AS side, CAST(min(hop) AS INTEGER) AS hop, qn AS qualified_name FROM down JOIN f ON f.i = x WHERE x <> 5 GROUP BY qn UNION ALL SELECT 'callers', CAST(min(hop) AS INTEGER), qn FROM up JOIN f ON f.i = x WHERE x <> 5 GROUP BY qn""")
def api_trace_path(spark, d):
    r = _built(spark, d)[0].trace_path(project="t", **{"from": "f_5"}, depth=4, limit=1000)
    return _frame(spark, [{"side": side, **x} for side in ("callees", "callers") for x in r[side]], "side string, hop int, qualified_name string")


@query(f"WITH {TREE} SELECT path AS file, CAST(1 AS INTEGER) AS from_line, CAST(2 AS INTEGER) AS to_line, 'def f_9():' || chr(10) || '    return f_' || j || '()' AS source FROM f WHERE i = 9")
def api_get_code_snippet(spark, d):
    r = _built(spark, d)[0].get_code_snippet(project="t", name="f_9", context_lines=1)
    return _frame(spark, [{**r, "file": r["file_path"]}], "file string, from_line int, to_line int, source string")


@query("SELECT * FROM (VALUES ('node_labels', CAST(16 AS BIGINT)), ('edge_types', 13), ('bundled_languages', 21), ('coverage_statuses', 4)) AS v(kind, n)")
def api_get_graph_schema(spark, d):
    r = _built(spark, d)[0].get_graph_schema()
    return spark.createDataFrame([(k, len(r[k])) for k in ("node_labels", "edge_types", "bundled_languages", "coverage_statuses")], "kind string, n long")


@query(f"""WITH {TREE} SELECT 'language' AS kind, 'python' AS name, CAST(count(*) AS BIGINT) AS n FROM f WHERE path LIKE 'p3/%' UNION ALL SELECT 'label', u.l, count(*) FROM f, (VALUES ('File'), ('Function')) AS u(l) WHERE path LIKE 'p3/%' GROUP BY u.l
UNION ALL (SELECT 'entry', qn, 0 FROM f WHERE path LIKE 'p3/%' AND i NOT IN (SELECT j FROM f) ORDER BY qn LIMIT 50) UNION ALL (SELECT 'largest', path, 1 FROM f WHERE path LIKE 'p3/%' ORDER BY path LIMIT 15)""")
def api_get_architecture(spark, d):
    r = _built(spark, d)[0].get_architecture(project="t", path="p3")
    rows = [("language", k, n) for k, n in r["languages"].items()] + [("label", k, n) for k, n in r["labels"].items()]
    rows += [("entry", x["qualified_name"], 0) for x in r["entry_points"]] + [("largest", x["file_path"], x["symbols"]) for x in r["largest_files"]]
    return spark.createDataFrame(rows, "kind string, name string, n long")


@query(f"WITH {TREE} SELECT path AS file_path, CAST(2 AS INTEGER) AS line, '    return f_' || j || '()' AS text, qn AS in_symbol, (SELECT count(*) FROM f WHERE starts_with(CAST(j AS VARCHAR), '1')) AS total FROM f WHERE starts_with(CAST(j AS VARCHAR), '1') ORDER BY path LIMIT 60")
def api_search_code(spark, d):
    r = _built(spark, d)[0].search_code(project="t", pattern="RETURN F_1", case_sensitive=False, limit=60)
    return _frame(spark, [{**x, "total": r["total"]} for x in r["matches"]], "file_path string, line int, text string, in_symbol string, total long")


@query(f"WITH {TREE} SELECT CAST(2 * c AS BIGINT) AS nodes, CAST(c + 1 AS BIGINT) AS files, CAST(c AS BIGINT) AS indexed, CAST(1 AS BIGINT) AS skipped, 'notes.txt' AS example FROM n")
def api_index_status(spark, d):
    r = _built(spark, d)[0].index_status(project="t")
    c = r["coverage"]
    return spark.createDataFrame([(r["nodes"], r["files"], c["indexed"], c["skipped"], c["examples"][0]["path"])], "nodes long, files long, indexed long, skipped long, example string")


@query(f"""WITH {TREE} SELECT path, 'indexed' AS status, CAST(NULL AS VARCHAR) AS reason FROM f WHERE path LIKE 'p4/%' UNION ALL SELECT 'notes.txt', 'skipped', 'unsupported_language' UNION ALL SELECT 'gone.py', 'skipped', 'not_found'""")
def api_check_index_coverage(spark, d):
    """Paths, and all pages of a folder."""
    engine, asked = _built(spark, d)[0], {"project": "t", "scopes": ["p4"], "limit": 1000}
    r = engine.check_index_coverage(paths=["notes.txt", "gone.py"], **asked)
    rows = [*r["paths"], *r["scopes"][0]["files"]]
    while r["has_more"]:
        r = engine.check_index_coverage(**asked, cursor=r["cursor"])
        rows += r["scopes"][0]["files"]
    return _frame(spark, rows, "path string, status string, reason string")


@query("SELECT * FROM (VALUES ('new.py', 'added', ''), ('p1/m1.py', 'modified', 'p1.m1.f_1'), ('notes.txt', 'removed', '')) AS v(path, change, symbols)")
def api_detect_changes(spark, d):
    engine, tree = _built(spark, d, own=True)
    _put(engine, f"{tree}/new.py", "x = 1\n")
    _put(engine, f"{tree}/p1/m1.py", "def f_1():\n    return 1\n")
    engine.store.delete(f"{tree}/notes.txt")
    r = engine.detect_changes(project="t")
    return spark.createDataFrame([(x["path"], x["change"], "|".join(x["symbols"])) for x in r["files"]], "path string, change string, symbols string")


@query("SELECT * FROM (VALUES ('a', 'A title', 'p7.m7.f_7', 'gone'), ('b', 'b', '', '')) AS v(id, title, linked, unresolved)")
def api_manage_adr(spark, d):
    """Records: saved, replaced, deleted and listed, with links to symbols."""
    engine = _built(spark, d)[0]
    engine.manage_adr(project="t", mode="save", id="a", title="first")
    saved = engine.manage_adr(project="t", mode="save", id="a", title="A title", related_qualified_names=["F_7", "gone"])
    engine.manage_adr(project="t", mode="save", id="b")
    engine.manage_adr(project="t", mode="save", id="c")
    engine.manage_adr(project="t", mode="delete", id="c")
    rows = [(a["id"], a["title"], "|".join(x["qualified_name"] for x in a["related"]), "|".join(saved["unresolved"]) if a["id"] == "a" else "") for a in engine.manage_adr(project="t")["adrs"]]
    return spark.createDataFrame(rows, "id string, title string, linked string, unresolved string")


@query(f"WITH {TREE} SELECT 'linked' AS kind, CAST(c AS BIGINT) AS n FROM n UNION ALL SELECT 'unmatched', c FROM n UNION ALL SELECT 'IMPACTS', c FROM n")
def api_ingest_traces(spark, d):
    """Observed calls, half of them of unknown symbols."""
    engine = _built(spark, d, own=True)[0]
    k = F.col("doc_id").cast("string")
    seen = views.load(spark, d, "documents").select(F.concat(F.lit("f_"), k).alias("caller"), F.lit("f_0").alias("callee"), F.lit(2).cast("bigint").alias("count"))
    seen = seen.unionByName(seen.withColumn("caller", F.concat(F.lit("unknown_"), "caller")))
    r = engine.ingest_traces(project="t", traces=seen)
    census = engine.open("t").edges.where("edge_type = 'IMPACTS'").count()
    return spark.createDataFrame([("linked", r["linked"]), ("unmatched", r["unmatched_total"]), ("IMPACTS", census)], "kind string, n long")


@query("SELECT * FROM (VALUES ('total_calls', CAST(4 AS BIGINT)), ('fail', 1), ('project_not_found', 1), ('list_projects', 2), ('sessions_total', 1)) AS v(kind, n)")
def api_usage(spark, d):
    engine = Engine(spark, f"{checkpoint_folder(spark)}/usage-{uuid.uuid4().hex}", clock=lambda: 1_000_000)
    engine.list_projects()
    engine.list_projects(limit=3)
    engine.get_graph_schema()
    try:
        engine.index_status(project="none")
    except ValueError:
        pass
    u = engine.usage()
    rows = [("total_calls", u["total_calls"]), ("fail", u["fail"]), ("project_not_found", u["project_not_found"]), ("list_projects", u["by_tool"]["list_projects"]), ("sessions_total", u["sessions_total"])]
    return spark.createDataFrame(rows, "kind string, n long")


@query(f"""WITH {TREE}, b AS (SELECT i AS x, j AS y FROM f UNION SELECT j, i FROM f), one AS (SELECT DISTINCT y AS x FROM b WHERE x = 5 AND y <> 5), two AS (SELECT DISTINCT b.y AS x FROM b JOIN one USING (x) WHERE b.y <> 5 AND b.y NOT IN (SELECT x FROM one)),
a AS (SELECT 5 AS x, 0 AS hop UNION ALL SELECT x, 1 FROM one UNION ALL SELECT x, 2 FROM two) SELECT CAST(hop AS INTEGER) AS hop, 'Function' AS label, qn AS qualified_name FROM a JOIN f ON f.i = a.x""")
def api_atlas(spark, d):
    r = _built(spark, d)[0].atlas(project="t", view="calls", seed="f_5", depth=2)
    return _frame(spark, r["nodes"], "hop int, label string, qualified_name string")


@query("SELECT 't' AS deleted, CAST(0 AS BIGINT) AS left_over")
def api_delete_project(spark, d):
    engine, tree = _built(spark, d, own=True)
    out = engine.delete_project(project="t")
    return spark.createDataFrame([(out["deleted"], len(engine.list_projects()["projects"]))], "deleted string, left_over long")
