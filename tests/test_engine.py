"""The engine's calls on a small tree, and the streams."""

import json

import pytest

from strandgraph.api import Engine
from strandgraph.schema import GraphError
from strandgraph.streaming import usage
from test_index import TREE, few_partitions, write  # noqa: F401


@pytest.fixture(scope="module")
def home(tmp_path_factory):
    return str(tmp_path_factory.mktemp("home"))


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("shop"))
    write(root, TREE)
    return root


@pytest.fixture(scope="module")
def engine(spark, home, tree):
    ticks = iter(range(1_000_000, 2_000_000, 10))
    e = Engine(spark, home, clock=lambda: next(ticks))
    e.report = e.index_repository(repo_path=tree, name="shop")
    return e


def test_index_report(engine):
    assert engine.report["project"] == "shop" and engine.report["edge_types"]["CALLS"] >= 6 and engine.report["files_removed"] == 0
    p = engine.list_projects()
    assert [x["project"] for x in p["projects"]] == ["shop"] and p["projects"][0]["graph_present"]


def test_search_and_paging(engine):
    r = engine.search_graph(project="shop", name_pattern="order", limit=2)
    assert r["total"] >= 3 and r["has_more"] and r["cursor"] == "2" and "cursor='2'" in r["next_step"]
    again = engine.search_graph(project="shop", query="order.*", limit=2, cursor="2")
    assert not {x["qualified_name"] for x in r["results"]} & {x["qualified_name"] for x in again["results"]}
    assert engine.search_graph(project="shop", query="nothing_here")["note"]
    for bad in ({"cursor": "x"}, {"label": "Nope"}, {"name_pattern": "(?=a)"}):
        with pytest.raises(GraphError):
            engine.search_graph(project="shop", **bad)


def test_trace_query_snippet(engine):
    t = engine.trace_path(project="shop", name="save_order", direction="in", depth=4)
    assert {(r["qualified_name"], r["hop"]) for r in t["callers"]} >= {("orders.app.service.OrderService.create_order", 1), ("orders.app.main.create_order", 2)}
    q = engine.query_graph(project="shop", start={"label": "Route"}, hops=[{"edge_type": "ROUTES_TO"}])
    assert q["total"] >= 4 and all(len(r["path"]) == 2 for r in q["rows"])
    c = engine.get_code_snippet(project="shop", qualified_name="orders.app.repository.save_order", context_lines=1)
    assert c["source"] == "\ndef save_order(order):\n    return helper(order)\n" and (c["from_line"], c["to_line"]) == (4, 7)
    with pytest.raises(GraphError, match="ambiguous"):
        engine.trace_path(project="shop", name="create_order")
    with pytest.raises(GraphError, match="symbol_not_found"):
        engine.get_code_snippet(project="shop", name="zzz")


def test_architecture_code_coverage(engine):
    a = engine.get_architecture(project="shop")
    assert {"method": "POST", "path": "/v1/auth/login", "handler": "inv.main.login"}.items() <= next(r for r in a["routes"] if r["path"] == "/v1/auth/login").items()
    assert a["languages"]["python"] == 4 and any(e["qualified_name"] == "bin.run.start" for e in a["entry_points"]) is False
    m = engine.search_code(project="shop", pattern="RETURN HELPER", case_sensitive=False)
    assert [(x["file_path"], x["line"], x["in_symbol"]) for x in m["matches"]] == [("orders/app/repository.py", 6, "orders.app.repository.save_order")]
    s = engine.index_status(project="shop")
    assert s["coverage"]["parse_partial"] == 1 and s["labels"]["Route"] >= 4
    c = engine.check_index_coverage(project="shop", paths=["notes.txt", "skip/me.py", "no.py"], scopes=["orders/"])
    assert {x["path"]: (x["status"], x["reason"]) for x in c["paths"]} == {"notes.txt": ("skipped", "unsupported_language"), "skip/me.py": ("excluded", "gitignore"), "no.py": ("skipped", "not_found")}
    assert c["scopes"][0]["total"] == 3
    g = engine.atlas(project="shop", view="calls")
    assert g["nodes"] and all({e["src"], e["dst"]} <= {n["id"] for n in g["nodes"]} for e in g["edges"])


def test_sql_views(engine, spark):
    assert {"nodes", "edges", "calls"} <= set(engine.views("shop"))
    q = "SELECT n.qualified_name FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.edge_type = 'CALLS' AND e.detail = 'recursive_self_call'"
    assert [r[0] for r in spark.sql(q).collect()] == ["orders.app.repository.walk"]


def test_changes_refresh_traces_records(engine, tree):
    assert engine.detect_changes(project="shop")["modified"] == 0
    write(tree, {"orders/app/extra.py": "def helper(x):\n    return x\n"})
    d = engine.detect_changes(project="shop")
    assert (d["added"], [f["path"] for f in d["files"]]) == (1, ["orders/app/extra.py"])
    assert engine.ingest_traces(project="shop", traces=[{"caller": "orders.app.repository.walk", "callee": "list", "count": 3}, {"caller": "x", "callee": "y"}]) == {"linked": 1, "unmatched": [{"caller": "x", "callee": "y"}], "unmatched_total": 1, "unmatched_cut": False}
    r = engine.index_repository(repo_path=tree)
    assert (r["project"], r["files_reparsed"], r["edge_types"]["IMPACTS"]) == ("shop", 1, 1)
    t = engine.trace_path(project="shop", name="save_order", direction="out")
    assert [x["qualified_name"] for x in t["callees"]] == ["orders.app.extra.helper"] and t["unresolved"] == []
    out = engine.manage_adr(project="shop", mode="save", id="1", title="Use it", related_qualified_names=["orders.app.extra.helper", "gone"])
    assert out["unresolved"] == ["gone"] and engine.manage_adr(project="shop")["adrs"][0]["related"][0]["start_line"] == 1
    assert engine.manage_adr(project="shop", mode="delete", id="1") == {"deleted": True} and engine.manage_adr(project="shop")["adrs"] == []


def test_unchanged_trees_are_not_read(engine, tree, monkeypatch):
    """Nothing changed: no file is read; a touched file is read but not parsed."""
    import os

    from strandgraph.sources import repo

    asked = []
    plain = repo.with_content
    monkeypatch.setattr(repo, "with_content", lambda t: asked.append(t.where("path like '%.py'").count()) or plain(t))
    before = engine.store.versions("shop")
    r = engine.index_repository(repo_path=tree)
    assert (r["files_reparsed"], r["files_removed"]) == (0, 0) and r["files_unchanged"] >= 5 and sum(asked) == 0
    assert set(r["phase_ms"]) >= {"walk", "hash", "parse", "resolve_edges"} and r["languages"]["python"] >= 4 and r["skipped_examples"]
    os.utime(f"{tree}/orders/app/extra.py", (1, 1))
    assert engine.index_repository(repo_path=tree)["files_reparsed"] == 0 and sum(asked) == 1
    assert engine.index_repository(repo_path=tree)["files_reparsed"] == 0 and sum(asked) == 1
    assert engine.store.versions("shop") == before and engine.detect_changes(project="shop")["unchanged"] >= 5


def test_forms_of_arguments(engine):
    q = engine.query_graph(project="shop", start={"query": "^save_"}, hops=["CALLS"])
    assert q["total"] >= 1 and engine.query_graph(project="shop", start={"query": "save_order"}, hops=["CALLS"])["total"] >= 1
    assert engine.trace_path(project="shop", **{"from": "save_order"})["callees_total"] >= 1
    with pytest.raises(GraphError):
        engine.trace_path(project="shop", name="save_order", nonsense=1)
    assert engine.search_code(project="shop", pattern="helper", path="repository")["total"] >= 1
    out = engine.manage_adr(project="shop", mode="save", id="2", related_qualified_names=["SAVE_ORDER", "create_order"])
    assert [x["qualified_name"] for x in out["related"]] == ["orders.app.repository.save_order"] and out["unresolved"] == ["create_order"]


def test_command_line():
    from strandgraph.__main__ import asked, parser

    of = lambda *a: asked(parser().parse_args(["--home", "h", *a]))
    assert of("index", "/r", "--full") == ("index_repository", {"repo_path": "/r", "name": None, "full": True})
    assert of("status") == ("list_projects", {}) and of("status", "p") == ("index_status", {"project": "p"}) and of("status", "--agent-usage") == ("usage", {})
    assert of("query", "--project", "p", "--pattern", "^a") == ("search_graph", {"project": "p", "limit": 25, "name_pattern": "^a"})
    assert of("changes", "p") == ("detect_changes", {"project": "p", "limit": 50}) and of("delete", "p") == ("delete_project", {"project": "p"})
    assert of("trace_path", "project=p", "depth=2", "cursor=3") == ("trace_path", {"project": "p", "depth": 2, "cursor": "3"})


def test_usage_and_streams(engine, home, spark, tmp_path, tree):
    u = engine.usage()
    assert u["total_calls"] == sum(u["by_tool"].values()) and u["fail"] == sum(u["by_error_code"].values()) >= 5 and u["graph_calls"] > 5
    assert len(u["sessions"]) == 1 and u["by_project"][0]["project"] == "shop"
    s = usage.journal_stream(spark, f"{home}/journal")
    for name, df, mode in (("rates", usage.tool_rates(s), "complete"), ("sess", usage.sessions(s), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("rates").agg({"calls": "sum"}).first()[0] == u["total_calls"]
    (tmp_path / "notices").mkdir()
    (tmp_path / "notices/a.json").write_text(json.dumps({"repo_path": tree}) + "\n")
    q = usage.refresh_on_change(engine, str(tmp_path / "notices"), f"{tmp_path}/c")
    q.awaitTermination(180)
    assert len(engine.store.versions("shop")) == 2


def test_delete(engine):
    with pytest.raises(GraphError, match="project_not_found"):
        engine.delete_project(project="none")
    assert engine.delete_project(project="shop")["deleted"] == "shop" and engine.list_projects()["projects"] == []


def test_the_tree_of_the_queries_is_written_and_read_in_many_tasks(spark, monkeypatch):
    from strandgraph.operators import paging
    from strandgraph.plans import engine
    from strandgraph.sources import repo

    d, put = "/root/testdata/sf0.001", []
    monkeypatch.setattr(engine, "_engines", {})
    monkeypatch.setattr(engine, "_put", lambda e, path, text, real=engine._put: (put.append(path), real(e, path, text)))
    e, tree = engine._built(spark, d)
    # the driver writes one file however many documents there are
    assert [p.rpartition("/")[2] for p in put] == ["notes.txt"] and e.report["files_indexed"] == spark.read.parquet(f"{d}/documents.parquet").count()
    seen = []
    monkeypatch.setattr(spark, "createDataFrame", lambda rows, *a, real=spark.createDataFrame: (seen.extend(rows), real(rows, *a))[1])
    listed = repo.listing(spark, tree)
    # the driver has names of folders, not of files
    assert len(seen) == 1 + engine.FOLDERS and listed.count() == 1 + e.report["files_indexed"]
    monkeypatch.undo()
    monkeypatch.setattr(engine, "_engines", {(spark.sparkContext.applicationId, d): (e, tree)})
    assert repo.with_content(listed).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    # a folder of more files than a page has
    monkeypatch.setattr(paging, "clamp", lambda limit, default, most=7: min(most, limit or default))
    got = engine.api_check_index_coverage(spark, d)
    assert sorted(r.path for r in got.collect()) == sorted([r.path for r in listed.where("path like 'p4/%'").collect()] + ["gone.py", "notes.txt"])
