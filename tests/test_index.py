"""Source trees end to end: extraction, building, and refresh equals rebuild."""

import os

import pytest
from pyspark.sql import functions as F

from strandgraph.operators import build, coverage, graph
from strandgraph.sources import manifests, repo

TREE = {
    "orders/app/main.py": 'from fastapi import FastAPI\nfrom app.service import OrderService\n\napp = FastAPI()\nservice = OrderService()\n\n\n@app.get("/health")\ndef health():\n    return 1\n\n\n@app.post("/orders")\ndef create_order(payload):\n    return service.create_order(payload)\n',
    "orders/app/service.py": "from app.repository import save_order\n\n\nclass OrderError(Exception):\n    pass\n\n\nclass OrderService(Base):\n    def create_order(self, payload):\n        self.check(payload)\n        return save_order(payload)\n\n    def check(self, payload):\n        raise OrderError('x')\n",
    "orders/app/repository.py": "class Base:\n    pass\n\n\ndef save_order(order):\n    return helper(order)\n\n\ndef walk(n):\n    return walk(n - 1)\n",
    "web/tsconfig.json": '{ // paths\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["./src/*"],}},\n}',
    "web/src/server.ts": 'import { build } from "./orders";\nimport api from "@/lib/axios";\nimport React from "react";\nexport function healthHandler(_req: any) { return build(1); }\napp.get("/health", healthHandler);\n',
    "web/src/orders.ts": "export interface Order { id: number; }\nexport function build(x: number): Order { return { id: x }; }\nclass Impl extends Basis implements Order { run(): void { this.go(); } go() {} }\n",
    "web/src/lib/axios.tsx": "export const api = (x) => { return x; };\n",
    "inv/go.mod": "module example.com/inv\n\ngo 1.20\n",
    "inv/main.go": 'package main\n\nimport "example.com/inv/store"\n\nfunc register(r *Engine) {\n\tv1 := r.Group("/v1")\n\tauth := v1.Group("/auth")\n\tauth.POST("/login", login)\n\tv1.GET("", list)\n}\n\nfunc login() { s := NewStore(); s.Get() }\nfunc list() {}\n',
    "inv/store/store.go": "package store\n\ntype Store struct { n int }\n\nfunc NewStore() *Store { return &Store{} }\n\nfunc (s *Store) Get() int { return s.n }\n\ntype Other struct{}\n\nfunc (o Other) Get() int { return 0 }\n",
    "bin/run": "#!/usr/bin/env bash\nsource ./lib.sh\nstart() {\n  helper_fn x\n}\nstart\n",
    "bin/lib.sh": "helper_fn() { echo; }\n",
    "broken.py": "def ok():\n    pass\n\nclass A(:\n  def m(self):\n    pass\n",
    "data.bin": b"\x00\x01\x02",
    "notes.txt": "plain",
    ".github/ci.yml": "jobs:\n  test:\n    steps: run\n",
    ".venv/x.py": "x = 1\n",
    "skip/me.py": "def gone(): pass\n",
    ".gitignore": "skip/\n*.log\n",
    "a.log": "x",
    "page.html": '<a href="x.css"></a><link href="style/site.css?v=1"><script src="https://x/y.js"></script><div id="main">',
}


def write(root, tree):
    for path, text in tree.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())


def indexed(spark, root, before=None):
    tree = repo.listing(spark, root)
    tree = repo.with_content(repo.candidates(tree, repo.ignore_rules(tree))).coalesce(2).checkpoint()
    files = repo.classified(tree).coalesce(2).checkpoint()
    known = build.parse(files) if before is None else build.refreshed(files, before.files, before.extracts)
    return build.build(files, known.coalesce(2).checkpoint(), manifests.discover(spark, tree), lambda _, df: df.coalesce(2).checkpoint())


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tree"))
    write(root, TREE)
    return root


@pytest.fixture(scope="module")
def g(spark, tree):
    return indexed(spark, tree)


def edges(g, kind):
    a = g.nodes.select(F.col("id").alias("src"), F.col("qualified_name").alias("a"))
    b = g.nodes.select(F.col("id").alias("dst"), F.col("qualified_name").alias("b"))
    return {(r.a, r.b, r.detail) for r in g.edges.where(F.col("edge_type") == kind).join(a, "src").join(b, "dst", "left").collect()}


def test_files_are_classified(g):
    got = {r.path: (r.language, r.status, r.reason) for r in g.files.collect()}
    assert "skip/me.py" not in got and "a.log" not in got and ".venv/x.py" not in got and ".gitignore" not in got
    assert got["bin/run"] == ("bash", "indexed", None) and got[".github/ci.yml"][0] == "yaml"
    assert got["data.bin"] == (None, "skipped", "binary") and got["notes.txt"] == (None, "skipped", "unsupported_language")
    assert got["broken.py"] == ("python", "parse_partial", "parse_error")


def test_calls(g):
    calls = edges(g, "CALLS")
    assert ("orders.app.main.create_order", "orders.app.service.OrderService.create_order", "unique_callable_name_in_project") in calls
    assert ("orders.app.service.OrderService.create_order", "orders.app.service.OrderService.check", "same_file_name_match") in calls
    assert ("orders.app.repository.walk", "orders.app.repository.walk", "recursive_self_call") in calls
    assert ("web.src.server.healthHandler", "web.src.orders.build", "unique_callable_name_in_project") in calls
    assert ("inv.main.login", "inv.store.store.Store.Get", "receiver_type_match") in calls
    assert ("bin.run.start", "bin.lib.helper_fn", "unique_callable_name_in_project") in calls
    open_ = edges(g, "CALL_UNRESOLVED")
    assert ("orders.app.repository.save_order", None, "no_definition_in_index") in open_


def test_imports_types_routes(g):
    imports = {(a, b) for a, b, _ in edges(g, "IMPORTS")}
    assert {("web.src.server", "web.src.orders"), ("web.src.server", "web.src.lib.axios"), ("inv.main", "example.com/inv/store"), ("bin.run", "bin.lib")} <= imports
    assert not any("react" in (b or "") for _, b in imports)
    assert ("orders.app.service.OrderService", "orders.app.repository.Base", None) in edges(g, "INHERITS")
    assert ("web.src.orders.Impl", "web.src.orders.Order", None) in edges(g, "IMPLEMENTS")
    routes = {(a, b) for a, b, _ in edges(g, "ROUTES_TO")}
    assert {("route:GET /health", "orders.app.main.health"), ("route:GET /health", "web.src.server.healthHandler"), ("route:POST /v1/auth/login", "inv.main.login"), ("route:GET /v1", "inv.main.list")} <= routes


def test_no_orphans(g):
    assert graph.orphans(g.nodes, g.edges).count() == 0
    assert g.nodes.select("id").distinct().count() == g.nodes.count() and g.nodes.agg(F.min("id")).first()[0] == 1


STEPS = [
    {"orders/app/extra.py": "def helper(x):\n    return x\n\n\ndef save_order(x):\n    pass\n"},
    {"orders/app/extra.py": None, "orders/app/repository.py": "class Base:\n    pass\n\n\ndef save_order(order):\n    return helper(order)\n"},
    {"web/src/orders.ts": None, "web/src/orders.js": "export function build(x) { return x; }\n", "inv/go.mod": None},
]


def test_refresh_equals_rebuild(spark, tmp_path):
    root = str(tmp_path)
    write(root, TREE)
    now = indexed(spark, root)
    seen = []
    for step in STEPS:
        for path, text in step.items():
            os.remove(os.path.join(root, path)) if text is None else write(root, {path: text})
        later, whole = indexed(spark, root, now), indexed(spark, root)
        a, b = (sorted(r.k for r in build.fingerprint(x).collect()) for x in (later, whole))
        assert a == b and a not in seen
        seen.append(a)
        now = later


def test_changes_and_symbols(g, spark):
    recorded = g.files.select("path", "hash")
    tree = recorded.where("path <> 'notes.txt'").withColumn("hash", F.when(F.col("path") == "broken.py", "").otherwise(F.col("hash")))
    tree = tree.unionByName(spark.createDataFrame([("new.py", "h")], "path string, hash string"))
    changed = coverage.changes(tree, recorded)
    assert coverage.change_counts(changed).first().asDict() == {"added": 1, "modified": 1, "removed": 1, "unchanged": recorded.count() - 2}
    rows = {r.path: (r.change, r.symbols) for r in coverage.changed_symbols(changed, g.nodes).collect()}
    assert rows["broken.py"] == ("modified", ["broken.A", "broken.A.m", "broken.ok"]) and rows["new.py"] == ("added", [])
