"""Literal-row cases of single operators."""

import itertools
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from strandgraph.extract.facts import module_prefix
from strandgraph.extract.files import extract
from strandgraph.functions import paths
from strandgraph.functions.patterns import Ignore, checked, literal_prefix, pushable_prefix
from strandgraph.operators import coverage, graph, journal, paging, resolve
from strandgraph.schema import GraphError
from strandgraph.sources import manifests, repo


def sites(spark, rows):
    return spark.createDataFrame(rows, "caller_id long, caller_qn string, callee_name string, receiver string, file_path string")


def symbols(spark, rows):
    return spark.createDataFrame([(i, q.rsplit(".", 1)[-1], q, f, m) for i, q, f, m in rows], "id long, name string, qualified_name string, file_path string, method boolean")


CASES = {
    "same file": ([(1, "m.caller", "m.py", False), (2, "m.callee", "m.py", False)], (1, "m.caller", "callee", None, "m.py"), (2, "same_file_name_match", 1.0)),
    "unique in project": ([(1, "a.caller", "a.py", False), (2, "b.helper", "b.py", False)], (1, "a.caller", "helper", None, "a.py"), (2, "unique_callable_name_in_project", 0.7)),
    "ambiguous": ([(1, "a.caller", "a.py", False), (2, "b.helper", "b.py", False), (3, "c.helper", "c.py", False)], (1, "a.caller", "helper", None, "a.py"), (0, "ambiguous_name_in_project", 0.0)),
    "unknown": ([(1, "a.caller", "a.py", False)], (1, "a.caller", "gone", None, "a.py"), (0, "no_definition_in_index", 0.0)),
    "local wins": ([(1, "a.caller", "a.py", False), (2, "a.helper", "a.py", False), (3, "b.helper", "b.py", False)], (1, "a.caller", "helper", None, "a.py"), (2, "same_file_name_match", 1.0)),
    "same module": ([(1, "m.caller", "m1.py", False), (2, "m.helper", "m2.py", False), (3, "b.helper", "b.py", False)], (1, "m.caller", "helper", None, "m1.py"), (2, "same_module_name_match", 0.9)),
    "receiver prefers method": ([(1, "main.run", "main.py", False), (2, "main.create_order", "main.py", False), (3, "svc.OrderService.create_order", "svc.py", True)], (1, "main.run", "create_order", "service", "main.py"), (3, "unique_callable_name_in_project", 0.7)),
    "self receiver": ([(1, "m.A.create", "m.py", True), (2, "m.A.validate", "m.py", True)], (1, "m.A.create", "validate", "self", "m.py"), (2, "same_file_name_match", 1.0)),
    "unknown receiver": ([(1, "m.run", "m.py", False), (2, "m.helper", "m.py", False)], (1, "m.run", "helper", "client", "m.py"), (0, "receiver_type_unknown_no_matching_method", 0.0)),
    "recursion": ([(1, "m.walk", "m.py", False)], (1, "m.walk", "walk", None, "m.py"), (1, "recursive_self_call", 1.0)),
}


@pytest.mark.parametrize("name", CASES)
def test_cascade(spark, name):
    rows, site, want = CASES[name]
    r = resolve.resolve_calls(sites(spark, [site]), symbols(spark, rows)).first()
    assert (r.dst, r.detail, r.confidence) == want
    assert r.edge_type == ("CALLS" if want[0] else "CALL_UNRESOLVED")


def test_receiver_types(spark):
    b = spark.createDataFrame([("s", "NewStore", "a.go"), ("t", "Make", "a.go"), ("u", "Both", "a.go")], "variable string, constructor string, file_path string")
    r = spark.createDataFrame([("NewStore", "Store"), ("Make", None), ("Both", "A"), ("Both", "B")], "name string, returns string")
    types = resolve.receiver_types(b, r)
    assert [(x.variable, x.owner) for x in types.collect()] == [("s", "Store")]
    sym = symbols(spark, [(1, "a.run", "a.go", False), (2, "b.Store.Get", "b.go", True), (3, "b.Other.Get", "b.go", True)])
    got = resolve.resolve_calls(sites(spark, [(1, "a.run", "Get", "s", "a.go")]), sym, types).first()
    assert (got.dst, got.detail) == (2, "receiver_type_match")


def test_cascade_equals_a_model(spark):
    r = random.Random(4)
    rows = [(i, f"m{r.randint(0, 3)}.{'T.' if (m := r.random() < 0.4) else ''}f{r.randint(0, 12)}", f"x{r.randint(0, 4)}.py", m) for i in range(1, 50)]
    asked = [(c[0], c[1], f"f{r.randint(0, 14)}", r.choice([None, "self", "obj"]), c[2]) for c in (r.choice(rows) for _ in range(300))]
    got = {(x.caller_id, x.callee_name, x.receiver): (x.dst, x.detail) for x in resolve.resolve_calls(sites(spark, asked), symbols(spark, rows)).collect()}
    for cid, cqn, callee, receiver, path in asked:
        ok = [x for x in rows if x[1].rsplit(".", 1)[-1] == callee and (receiver in (None, "self") or x[3])]
        scope = cqn.rsplit(".", 1)[0]
        want = None
        for level, pick in (("same_file_name_match", lambda x: x[2] == path), ("same_module_name_match", lambda x: x[1].rsplit(".", 1)[0] == scope), ("unique_callable_name_in_project", lambda x: True)):
            one = [x[0] for x in ok if pick(x)]
            if len(one) == 1:
                want = (one[0], "recursive_self_call" if one[0] == cid else level)
                break
        if want is None:
            n = sum(x[1].rsplit(".", 1)[-1] == callee for x in rows)
            want = (0, "ambiguous_name_in_project" if n > 1 else "no_definition_in_index" if n == 0 else "receiver_type_unknown_no_matching_method")
        assert got[cid, callee, receiver] == want


def test_import_candidates(spark):
    i = spark.createDataFrame([("web/src/a.ts", "./b", 1), ("web/src/a.ts", "../../../x", 2), ("web/src/a.ts", "@/lib/q", 3), ("web/src/a.ts", "react", 4), ("app/x.dart", "package:shop/m.dart", 5), ("inv/m.go", "ex.com/inv/store", 6), ("inv/m.go", "ex.com/inv", 7), ("app/x.dart", "package:other/m.dart", 8)], "from_file string, target string, line int")
    aliases = spark.createDataFrame([("web", "@/", "", True, "src/*", 0)], manifests.ALIASES_DDL)
    dart = spark.createDataFrame([("shop", "app/lib")], "name string, lib_dir string")
    go = spark.createDataFrame([("ex.com/inv", "inv")], "path string, dir string")
    got = {r.line: r.candidate for r in resolve.import_candidates(i, aliases, dart, go).collect()}
    assert got == {1: "web/src/b", 3: "web/src/lib/q", 5: "app/lib/m.dart", 6: "inv/store", 7: "inv"}


def test_manifests():
    text = '{ "a": "http://x", // c\n "b": [1,2,], /* d */ }'
    assert len(manifests.strip_jsonc(text)) == len(text) and '"http://x"' in manifests.strip_jsonc(text)
    texts = {"tsconfig.base.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"x": ["y"]}}}', "web/tsconfig.json": '{"extends": "../tsconfig.base", "compilerOptions": {"paths": {"@/*": ["./src/*"], "@/deep/*": ["d/*"]}}}'}
    assert [r[1:5] for r in manifests.ts_aliases("web/tsconfig.json", texts)] == [("@/deep/", "", True, "d/*"), ("@/", "", True, "src/*")]


def test_patterns():
    assert [literal_prefix(p) for p in ("handle.*", "^get_user$", ".*thing", "ab?c")] == ["handle", "get_user", "", "a"]
    assert pushable_prefix("^ab|c") == "" and pushable_prefix("^abc.*") == "abc" and pushable_prefix("abc") == ""
    for bad in ("(?=a)", r"(a)\1", "("):
        with pytest.raises(GraphError):
            checked(bad)
    i = Ignore().add("*.log\n!keep.log\nbuild/\n/top.txt\ndocs/**/x.md\n").add("local", "sub")
    assert i.excluded("a/b.log") and not i.excluded("keep.log") and i.excluded("build/x.py") and not i.excluded("build") and i.excluded("top.txt") and not i.excluded("a/top.txt")
    assert i.excluded("docs/a/b/x.md") and i.excluded("sub/local") and not i.excluded("local") and i.excluded(".git/config")


def test_paths(spark):
    rows = [("a/b/c.py",), ("a/__init__.py",), ("index.ts",), ("x.d.ts",), ("w/index.tsx",), ("../q",), ("a/./b/../c.go",), ("",)]
    p = F.col("p")
    got = {r.p: r for r in spark.createDataFrame(rows, "p string").select("p", paths.module_prefix(p).alias("m"), paths.normalise(p).alias("n"), paths.spellings(p).alias("s"), paths.module_of_target(p).alias("t")).collect()}
    assert [got[x].m for x in ("a/b/c.py", "a/__init__.py", "index.ts")] == ["a.b.c", "a", ""] == [module_prefix(x) for x in ("a/b/c.py", "a/__init__.py", "index.ts")]
    assert (got["../q"].n, got["a/./b/../c.go"].n, got[""].n) == (None, "a/c.go", None)
    assert [tuple(x) for x in got["x.d.ts"].s] == [(0, "x.d.ts"), (11, "x")] and [tuple(x) for x in got["w/index.tsx"].s] == [(0, "w/index.tsx"), (2, "w/index"), (102, "w")]
    with pytest.raises(GraphError):
        repo.safe_relative("../x")


def test_sampling(spark):
    rows = [(f"img/{i:02}.png", "unsupported_language") for i in range(20)] + [(f"lib/{i:03}.dart", None) for i in range(202)] + [("z/a.bin", "binary"), ("y/a.bin", "binary")]
    got = [tuple(r) for r in coverage.sample(spark.createDataFrame(rows, "path string, reason string"), 3).collect()]
    assert got == [("lib/000.dart", "", 201), ("img/00.png", "unsupported_language", 19), ("y/a.bin", "binary", 0)]


def test_paging():
    assert paging.offset_of(None) == 0 and paging.offset_of("12") == 12 and paging.clamp(5000, 50) == 1000 and paging.clamp(None, 50) == 50
    for bad in ("x", 3, "-1", "１"):
        with pytest.raises(GraphError, match="bad_cursor"):
            paging.offset_of(bad)
    assert paging.page_info(10, 3, 0, 5) == {"total": 10, "has_more": True, "cursor": "5"} and paging.page_info(10, 3, 0, 5, exact=True)["cursor"] == "3"


JOURNAL = [  # at, tool, keys, project, ms, ok, code, more
    (100, "list_projects", [], None, 5, True, None, None), (101, "search_graph", ["project"], "p", 10, True, None, True), (102, "search_graph", ["cursor"], "p", 20, True, None, False),
    (103, "trace_path", [], "p", 30, False, "symbol_not_found", None), (2000, "search_graph", [], "p", 40, True, None, True), (2001, "search_code", [], "q", 50, True, None, None),
]


def test_journal(spark, monkeypatch):
    monkeypatch.setattr(journal, "CHUNK", 2)  # every question looks over chunk ends
    monkeypatch.setattr(journal, "SLICE_SECONDS", 50)
    j = spark.createDataFrame([(*r[:7], None, r[7], i) for i, r in enumerate(JOURNAL)], "at_unix long, tool string, argument_keys array<string>, project string, duration_ms long, ok boolean, error_code string, result_total long, has_more boolean, seq int")
    t = journal.totals(j).first()
    assert (t.total_calls, t.ok, t.fail, t.graph_calls, t.truncated_responses, t.paged_followthrough, t.walk_failures) == (6, 5, 1, 4, 2, 1, 1)
    assert [(s.calls, s.first_tool, s.list_projects_first, s.projects) for s in journal.sessions(j).orderBy("session").collect()] == [(4, "list_projects", True, ["p"]), (2, "search_graph", False, ["p", "q"])]
    assert {r.sequence: r.n for r in journal.sequences(j).collect()} == {"list_projects -> search_graph": 1, "search_graph -> search_graph": 1, "search_graph -> trace_path": 1, "trace_path -> search_graph": 1, "search_graph -> search_code": 1}
    s = {r.tool: r for r in journal.tool_stats(j).collect()}["search_graph"]
    assert (s.duration_p50_ms, s.duration_p95_ms, s.duration_max_ms) == (20, 40, 40)
    assert journal.window(j, "day", 1500 + journal.DAY).count() == 2


def test_follow_up_equals_a_scan(spark, monkeypatch):
    monkeypatch.setattr(journal, "CHUNK", 16)
    r = random.Random(2)
    rows = [(i * 7, r.choice("ab"), ["cursor"] if r.random() < 0.2 else [], r.choice(["p", None]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "at_unix long, tool string, argument_keys array<string>, project string, seq int")
    got = {x.seq: x.followed for x in journal.followed(journal.numbered(df)).collect()}
    for i, row in enumerate(rows):
        run = itertools.takewhile(lambda n: n[1] == row[1] and n[3] == row[3], rows[i + 1 : i + 8])
        assert got[i] == any("cursor" in n[2] for n in run)


def test_reach_equals_a_model(spark):
    r = random.Random(9)
    e = {(r.randint(1, 40), r.randint(1, 40)) for _ in range(70)}
    edges = spark.createDataFrame([(i, a, b, "CALLS") for i, (a, b) in enumerate(e)] + [(999, 1, 0, "CALL_UNRESOLVED")], "id long, src long, dst long, edge_type string")
    starts = spark.createDataFrame([(1,), (2,)], "id long")
    for way in (graph.OUT, graph.IN):
        hop, front = {1: 0, 2: 0}, {1, 2}
        for k in range(1, 6):
            front = {(b if way == graph.OUT else a) for a, b in e if (a if way == graph.OUT else b) in front} - set(hop)
            hop.update(dict.fromkeys(front, k))
        assert {x.id: x.hop for x in graph.reach(starts, edges, way, 5).collect()} == {k: v for k, v in hop.items() if v}


def test_narrowest_span(spark):
    spans = spark.createDataFrame([(1, "f", 1, 40), (2, "f", 10, 20), (3, "f", 25, 30)], "id long, file_path string, start_line int, end_line int")
    points = spark.createDataFrame([("a", "f", 15), ("b", "f", 5), ("c", "f", 99)], "id string, file_path string, line int")
    assert {r.id: r.span_id for r in graph.innermost(points, spans).collect()} == {"a": 2, "b": 1, "c": None}


def names(language, path, text):
    f = extract(language, path, text)
    return SimpleNamespace(d=[(x[0], x[2]) for x in f.definitions], c=[(x[0], x[1], x[2]) for x in f.calls], i=[x[0] for x in f.imports], t=[x[1:3] for x in f.relations], r=[x[:4] for x in f.routes], e=f.errors)


def test_extractors():
    x = names("java", "A.java", "package p;\nimport java.util.List;\npublic class A extends B implements C, D {\n  A() {}\n  int f(int x) throws E { return g(x); }\n  abstract int h();\n}\n")
    assert x.d == [("Class", "A.A"), ("Method", "A.A.A"), ("Method", "A.A.f"), ("Method", "A.A.h")] and x.c == [("A.A.f", "g", None)] and x.i == ["java.util.List"] and x.t == [("B", "INHERITS"), ("C", "IMPLEMENTS"), ("D", "IMPLEMENTS")]
    x = names("cpp", "a.cpp", '#include "a.h"\n#include <vector>\nnamespace n {\nclass K : public B {\n public:\n  K();\n  void run() const { go(); }\n};\nvoid K::out(int x) { p->call(x); }\n}\n')
    assert ("Module", "a.n") in x.d and ("Method", "a.n.K.run") in x.d and ("Method", "a.n.K.out") in x.d and x.i == ["a.h", "vector"] and ("a.n.K.out", "call", "p") in x.c
    x = names("c", "a.c", "struct s { int a; };\nstatic int f(int x);\nint f(int x) { if (x) return g(x); return 0; }\n")
    assert x.d == [("Struct", "a.s"), ("Function", "a.f"), ("Function", "a.f")] and x.c == [("a.f", "g", None)]
    x = names("dart", "a.dart", "import 'b.dart';\nclass A extends B with M implements I {\n  void f() { g(); }\n  int h() => k();\n}\nenum E { a }\nvoid main() { A(); }\n")
    assert ("Method", "a.A.f") in x.d and ("Method", "a.A.h") in x.d and ("Function", "a.main") in x.d and x.i == ["b.dart"] and x.t == [("B", "INHERITS"), ("M", "IMPLEMENTS"), ("I", "IMPLEMENTS")]
    x = names("javascript", "a.js", "import x from './b.js';\nclass A extends B { run(y) { this.go(y); } }\nconst f = async (a) => { await g(a); };\nfunction* h() {}\nrouter.get('/p', mid, ctl.show);\n")
    assert x.d == [("Class", "a.A"), ("Method", "a.A.run"), ("Function", "a.f"), ("Function", "a.h")] and x.r == [("GET", "/p", "show", "ctl")] and ("a.A.run", "go", "this") in x.c
    x = names("bash", "s/a.sh", "source ./lib.sh\n. ../../etc/x\nf() {\n  g 1\n}\nfunction h { f; }\n")
    assert x.i == ["s/lib.sh", "../../etc/x"] and x.d == [("Function", "s.a.f"), ("Function", "s.a.h")] and x.c == [("s.a.f", "g", None), ("s.a.h", "f", None)]
    x = names("make", "Makefile", "include a.mk\nCC ?= gcc\nall: build test\n\techo\nexport: all\n")
    assert x.i == ["a.mk"] and ("Field", "Makefile.CC") in x.d and ("Function", "Makefile.export") in x.d and ("Makefile.all", "test", None) in x.c
    x = names("cmake", "CMakeLists.txt", "# c\nfunction(my_fn a)\n  message(x)\nendfunction()\nadd_subdirectory(lib)\nINCLUDE(cmake/x.cmake)\n")
    assert x.d == [("Function", "CMakeLists.my_fn")] and x.c == [("CMakeLists.my_fn", "message", None)] and x.i == ["lib", "cmake/x.cmake"]
    x = names("yaml", "c.yml", "a:\n  b: 1\n  c:\n    - d: 2\nrun: |\n  x: y\n")
    assert ("Module", "c.a") in x.d and ("Field", "c.a.b") in x.d and ("Field", "c.run") in x.d and not any("x" == n.split(".")[-1] for _, n in x.d)
    x = names("ini", "u.service", "[Unit]\nDescription=x\n[Service]\nExecStart = /bin/y\n")
    assert x.d == [("Field", "u.Unit.Description"), ("Field", "u.Service.ExecStart"), ("Module", "u.Unit"), ("Module", "u.Service")]
    x = names("python", "p.py", "class A(:\n  def f(self):\n    pass\n")
    assert x.e and x.d == [("Class", "p.A"), ("Method", "p.A.f")]


def test_answers_upgrade_unresolved_calls(spark):
    """The narrowest callable or class around the answered line; the unresolved edge stays."""
    e = spark.createDataFrame([(5, 1, 0, "CALL_UNRESOLVED", "run", 3)], "id long, src long, dst long, edge_type string, target_name string, line int")
    n = spark.createDataFrame([(1, "Function", "a.py", 1, 9), (2, "Class", "b.py", 1, 40), (3, "Method", "b.py", 10, 20), (4, "Field", "b.py", 15, 15)], "id long, label string, file_path string, start_line int, end_line int")
    a = spark.createDataFrame([(5, "b.py", 15)], "edge_id long, file_path string, line int")
    r = resolve.apply_answers(e, a, n).collect()
    assert [(x.src, x.dst, x.edge_type, x.source, x.confidence, x.line) for x in r] == [(1, 3, "CALLS", "lsp", 1.0, 3)]


def test_answers_equal_a_model_and_join_on_equal_keys(spark):
    r = random.Random(4)
    spans = [(i, "Function", r.choice("ab"), a := r.randint(-3, 70), a + r.choice([-1, 0, 1, 2, 3, 7, 8, 30, 64, 200])) for i in range(60)] + [(99, "Function", "a", None, 5), (98, "Field", "a", 5, 5)]
    answers = [(i, r.choice("abc"), r.choice([None, *range(-5, 300)])) for i in range(400)] + [(1, "a", 40), (2, "b", 33), (2, "b", 33), (None, "a", 40)]
    n = spark.createDataFrame(spans, "id long, label string, file_path string, start_line int, end_line int")
    a = spark.createDataFrame(answers, "edge_id long, file_path string, line int")
    e = spark.createDataFrame([(i, i * 2, 0, "CALL_UNRESOLVED", None if i % 3 else "t", 7) for i in range(0, 390)] + [(5, 10, 0, "CALL_UNRESOLVED", "t", 7)] * 2, "id long, src long, dst long, edge_type string, target_name string, line int")
    got = resolve.apply_answers(e, a, n)
    want = {}
    for edge, path, line in answers:
        for i, label, f, x, z in spans:
            if edge is not None and line is not None and x is not None and label == "Function" and f == path and x <= line <= z:
                want[edge] = min(want.get(edge, (1000, 0)), (z - x, i))
    asked = {(x.id, x.src, x.target_name) for x in e.collect()}
    assert sorted((x.edge_id, x.src, x.target_name or "", x.dst) for x in got.collect()) == sorted((i, s, t or "", want[i][1]) for i, s, t in asked if i in want)
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert joins and not any("<=" in x for x in joins)
    none = resolve.apply_answers(e, a, n.where("false"))
    assert none.count() == 0


def test_strings(spark):
    import textwrap

    from strandgraph.functions import strings

    text = "a  bb ccc\n dddd eeeeeeeeeeee f g" * 3
    df = spark.createDataFrame([(text, "a=%41%zz%&b&a=2&%C3%A9=x+y"), ("", "")], "t string, q string")
    got = df.select(strings.fold(F.col("t"), 9).alias("f"), strings.query_arguments(F.col("q")).alias("m"), strings.percent_decode(F.col("q")).alias("p")).collect()
    assert got[0].f == textwrap.wrap(" ".join(text.split()), 9, break_long_words=False) and got[1].f == []
    assert got[0].m == {"a": "2", "b": "", "é": "x y"} and got[1].m == {} and got[0].p.startswith("a=A%zz%&b")


def test_links_do_not_escape(tmp_path):
    import os

    from strandgraph.schema import GraphError
    from strandgraph.sources.repo import safe_relative

    (tmp_path / "root/in").mkdir(parents=True)
    (tmp_path / "out").mkdir()
    os.symlink(tmp_path / "out", tmp_path / "root/away")
    os.symlink(tmp_path / "root/in", tmp_path / "root/near")
    root = str(tmp_path / "root")
    assert [safe_relative(p, root) for p in ("in/x.py", "near/x.py", "not/there")] == ["in/x.py", "near/x.py", "not/there"]
    for bad in ("away/x.py", "../x", "/etc/passwd", "a/../../x"):
        with pytest.raises(GraphError):
            safe_relative(bad, f"file:{root}")


def test_listing(spark, tmp_path, monkeypatch):
    """Folders that executors list give what those of the driver give."""
    import os

    from strandgraph.sources import repo

    for p in ("a/x.py", "a/b/c/y.py", "a/b/.hidden/z.py", ".github/w.yml", "d/e/f/g/h.py", "top.py", "a/.x.py.crc"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    os.symlink(tmp_path / "a", tmp_path / "link")
    whole = {r.path: r.size for r in repo.listing(spark, str(tmp_path)).collect()}
    monkeypatch.setattr(repo, "FOLDERS_FIRST", 1)
    assert {r.path: r.size for r in repo.listing(spark, f"file://{tmp_path}").collect()} == whole
    assert set(whole) == {"a/x.py", "a/b/c/y.py", ".github/w.yml", "d/e/f/g/h.py", "top.py"}
    with pytest.raises(GraphError, match="path_not_found"):
        repo.listing(spark, f"{tmp_path}/none")


def test_walk_without_a_limit_is_whole(spark, monkeypatch):
    from strandgraph.plans import catalog

    n = 1_000_100
    leaves = spark.range(2, n + 2)
    nodes = leaves.select("id", F.lit("Class").alias("label"), F.lit("c").alias("qualified_name")).unionByName(spark.createDataFrame([(1, "Module", "m")], "id long, label string, qualified_name string"))
    edges = leaves.select(F.lit(1).cast("long").alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("edge_type"))
    monkeypatch.setattr(catalog.views, "g_nodes", lambda *_: nodes)
    monkeypatch.setattr(catalog.views, "g_edges", lambda *_: edges)
    assert catalog.walk_nodes(spark, "-").groupBy("hop").count().orderBy("hop").collect() == [(0, 1), (1, n)]
    seen, inside = graph.walk(nodes.where("id = 1"), nodes.where("id < 400"), edges, ["CONTAINS"], None, 2, 100)
    assert (seen.count(), inside.count()) == (100, 99)
