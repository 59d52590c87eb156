"""Registered queries of the operators that work on files, facts and snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandgraph import schema as s
from strandgraph.functions.patterns import Ignore
from strandgraph.operators import build, coverage, graph, mutate, resolve, search
from strandgraph.sources import manifests, repo, views
from strandgraph.storage import Store, checkpoint_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


_OWNERS = """ret AS (SELECT DISTINCT 'New' || p_size AS name, CASE WHEN p_size % 3 = 0 THEN 'T' || (p_partkey % 2) ELSE 'T' || (p_size % 7) END AS returns FROM part),
one AS (SELECT name, min(returns) AS owner FROM ret GROUP BY name HAVING count(*) = 1),
bound AS (SELECT DISTINCT 'f' || c_nationkey AS file_path, 'v' || (c_custkey % 500) AS variable, owner FROM customer JOIN one ON name = 'New' || (c_custkey % 60)),
typed AS (SELECT file_path, variable, min(owner) AS owner FROM bound GROUP BY 1, 2 HAVING count(*) = 1)"""


def _owners(spark, d):
    p, c = views.load(spark, d, "part"), views.load(spark, d, "customer")
    size, key = F.col("p_size"), F.col("c_custkey")
    returns = p.select(_text("New", size).alias("name"), F.when(size % 3 == 0, _text("T", F.col("p_partkey") % 2)).otherwise(_text("T", size % 7)).alias("returns"))
    bindings = c.select(_text("f", F.col("c_nationkey")).alias("file_path"), _text("v", key % 500).alias("variable"), _text("New", key % 60).alias("constructor"))
    return resolve.receiver_types(bindings, returns)


@query(f"WITH {_OWNERS} SELECT * FROM typed")
def receiver_types(spark, d):
    """Types of variables that constructors with one known return type fill."""
    return _owners(spark, d)


@query(f"""WITH {_OWNERS}, n AS (SELECT 'T' || (s_suppkey % 12) AS owner, 'run' || (s_suppkey % 3) AS name, count(*) AS n, min(s_suppkey) AS id FROM supplier GROUP BY 1, 2),
site AS (SELECT c_custkey, 'f' || c_nationkey AS file_path, 'v' || (c_custkey % 500) AS receiver, 'run' || (c_custkey % 3) AS name FROM customer),
r AS (SELECT site.c_custkey, CASE WHEN n.n = 1 THEN n.id END AS a, (SELECT count(*) FROM supplier WHERE 'run' || (s_suppkey % 3) = site.name) AS p, (SELECT min(s_suppkey) FROM supplier WHERE 'run' || (s_suppkey % 3) = site.name) AS pid
FROM site LEFT JOIN typed t ON t.file_path = site.file_path AND t.variable = site.receiver LEFT JOIN n ON n.owner = t.owner AND n.name = site.name)
SELECT c_custkey, CAST(coalesce(a, CASE WHEN p = 1 THEN pid END, 0) AS BIGINT) AS dst,
CASE WHEN a IS NOT NULL THEN 'receiver_type_match' WHEN p = 1 THEN 'unique_callable_name_in_project' WHEN p > 1 THEN 'ambiguous_name_in_project' ELSE 'no_definition_in_index' END AS detail FROM r""")
def resolve_typed_calls(spark, d):
    """Calls whose receiver's type decides."""
    u, c = views.load(spark, d, "supplier"), views.load(spark, d, "customer")
    k = F.col("s_suppkey")
    name = _text("run", k % 3)
    symbols = u.select(k.cast("bigint").alias("id"), name.alias("name"), _text("m", k, ".T", k % 12, ".", name).alias("qualified_name"), _text("s", k).alias("file_path"), F.lit(True).alias("method"))
    key = F.col("c_custkey")
    sites = c.select("c_custkey", (-key).cast("bigint").alias("caller_id"), _text("c", key, ".f").alias("caller_qn"), _text("run", key % 3).alias("callee_name"), _text("v", key % 500).alias("receiver"), _text("f", F.col("c_nationkey")).alias("file_path"))
    return resolve.resolve_calls(sites, symbols, _owners(spark, d)).select("c_custkey", "dst", "detail")


@query("""WITH f AS (SELECT o_orderkey AS id, 'f' || o_custkey AS file_path, o_orderkey % 50 AS a, o_orderkey % 50 + o_orderkey % 20 AS z, o_custkey FROM orders),
h AS (SELECT i.id AS dst, o.id AS src, row_number() OVER (PARTITION BY i.id ORDER BY o.z - o.a, o.id DESC) AS nth FROM f i JOIN f o ON o.file_path = i.file_path AND o.id <> i.id AND o.a <= i.a AND o.z >= i.z
AND (o.z - o.a > i.z - i.a OR o.id < i.id))
SELECT src, dst, 'CONTAINS' AS edge_type FROM h WHERE nth = 1 UNION ALL SELECT -o_custkey, id, 'DEFINES' FROM f WHERE id NOT IN (SELECT dst FROM h)""")
def containment(spark, d):
    """The innermost definition around each, else its file."""
    o = views.load(spark, d, "orders")
    k, path = F.col("o_orderkey").cast("bigint"), _text("f", F.col("o_custkey"))
    defs = o.select(k.alias("id"), F.lit("Function").alias("label"), path.alias("file_path"), (k % 50).cast("int").alias("start_line"), (k % 50 + k % 20).cast("int").alias("end_line"))
    return graph.containment(defs, o.select(path.alias("file_path"), (-F.col("o_custkey")).cast("bigint").alias("id")).distinct())


@query("""WITH f AS (SELECT DISTINCT source, lang FROM documents)
SELECT source || '/' || lang AS dir, CASE WHEN lang = 'en' THEN 'inner.example/' || source ELSE 'example.com/' || source || '/' || lang END AS import_path, CASE WHEN lang = 'en' THEN source ELSE lang END AS name FROM f""")
def go_packages(spark, d):
    """Folders in a module; the innermost module owns one."""
    docs = views.load(spark, d, "documents")
    files = docs.select(_text(F.col("source"), "/", F.col("lang"), "/f", F.col("doc_id"), ".go").alias("path"), F.lit("go").alias("language"))
    each = docs.select("source").distinct()
    modules = each.select(F.col("source").alias("dir"), _text("example.com/", F.col("source")).alias("path")).unionByName(each.select(_text(F.col("source"), "/en").alias("dir"), _text("inner.example/", F.col("source")).alias("path")))
    return resolve.go_packages(files, modules)


_IMPORTS = """f AS (SELECT doc_id, doc_id + 1 AS id, source, lang, max(doc_id) OVER (PARTITION BY source, lang) AS k FROM documents),
p AS (SELECT source, lang, 1000000 + row_number() OVER (ORDER BY source, lang) AS package FROM (SELECT DISTINCT source, lang FROM documents)),
t AS (SELECT id, k, package, doc_id % 4 AS way, CASE doc_id % 4 WHEN 0 THEN '@/' || lang || '/doc_' || k WHEN 1 THEN 'package:pk_' || source || '/' || lang || '/doc_' || k || '.py' WHEN 2 THEN 'example.com/' || source || '/' || lang ELSE 'elsewhere' END AS target FROM f JOIN p USING (source, lang))"""


@query(f"WITH {_IMPORTS} SELECT id AS src, target, CASE WHEN way = 2 THEN package ELSE k + 1 END AS dst FROM t WHERE way = 2 OR way < 2 AND k + 1 <> id")
def resolve_manifest_imports(spark, d):
    """Path aliases, package names and modules give imports a meaning."""
    docs = views.load(spark, d, "documents")
    from pyspark.sql import Window

    k = F.max("doc_id").over(Window.partitionBy("source", "lang"))
    f = docs.select("doc_id", "source", "lang", k.alias("k"), _text(F.col("source"), "/", F.col("lang"), "/doc_", F.col("doc_id"), ".py").alias("path"))
    way = F.col("doc_id") % 4
    target = F.when(way == 0, _text("@/", F.col("lang"), "/doc_", F.col("k"))).when(way == 1, _text("package:pk_", F.col("source"), "/", F.col("lang"), "/doc_", F.col("k"), ".py")).when(way == 2, _text("example.com/", F.col("source"), "/", F.col("lang"))).otherwise("elsewhere")
    imports = f.select(F.col("path").alias("from_file"), target.alias("target"), F.lit(1).alias("line"))
    files = f.select((F.col("doc_id") + 1).alias("id"), "path")
    dirs = docs.select("source", "lang").distinct()
    packages = dirs.select((F.row_number().over(Window.orderBy("source", "lang")) + 1_000_000).cast("bigint").alias("id"), _text(F.col("source"), "/", F.col("lang")).alias("dir"))
    each = docs.select("source").distinct()
    own = F.col("source")
    given = {
        "aliases": each.select(own.alias("dir"), F.lit("@/").alias("prefix"), F.lit("").alias("suffix"), F.lit(True).alias("wildcard"), F.lit("*").alias("alias_target"), F.lit(0).alias("alias_ord")),
        "dart": each.select(_text("pk_", own).alias("name"), own.alias("lib_dir")), "go": each.select(_text("example.com/", own).alias("path"), own.alias("dir")),
    }
    return resolve.resolve_imports(imports, files, packages, **given).select("src", "target", "dst")


@query("""WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS edge_id, l_orderkey AS src, 'f' || (l_partkey % 50) AS file_path, l_partkey % 90 AS line FROM lineitem WHERE l_returnflag = 'R'),
n AS (SELECT p_partkey AS id, 'f' || (p_partkey % 50) AS file_path, p_partkey % 70 AS a, p_partkey % 70 + p_size AS z FROM part),
h AS (SELECT edge_id, src, id, row_number() OVER (PARTITION BY edge_id ORDER BY z - n.a, id) AS nth FROM a JOIN n ON n.file_path = a.file_path AND a.line BETWEEN n.a AND n.z)
SELECT edge_id, src, id AS dst, 'CALLS' AS edge_type, 'lsp' AS source FROM h WHERE nth = 1""")
def apply_answers(spark, d):
    """Answers of language servers become calls to the innermost definition."""
    line, part = views.load(spark, d, "lineitem").where("l_returnflag = 'R'"), views.load(spark, d, "part")
    edge = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint")
    edges = line.select(edge.alias("id"), F.col("l_orderkey").cast("bigint").alias("src"), F.lit("CALL_UNRESOLVED").alias("edge_type"), F.lit("x").alias("target_name"), F.lit(1).alias("line"))
    answers = line.select(edge.alias("edge_id"), _text("f", F.col("l_partkey") % 50).alias("file_path"), (F.col("l_partkey") % 90).alias("line"))
    k = F.col("p_partkey").cast("bigint")
    nodes = part.select(k.alias("id"), F.lit("Function").alias("label"), _text("f", k % 50).alias("file_path"), (k % 70).alias("start_line"), (k % 70 + F.col("p_size")).alias("end_line"))
    return resolve.apply_answers(edges, answers, nodes).select("edge_id", "src", "dst", "edge_type", "source")


@query("SELECT p_brand AS qualified_name, max(p_partkey) AS id FROM part GROUP BY 1")
def latest_by_name(spark, d):
    p = views.load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("qualified_name"), F.lit("f").alias("file_path"), F.col("p_partkey").alias("start_line"))
    return graph.ranked_by_name(p).select("qualified_name", "id")


@query("""WITH n AS (SELECT 'q' || (o_orderkey % 400) AS qualified_name, max(o_orderkey) AS caller_id FROM orders GROUP BY 1)
SELECT l_orderkey, l_linenumber, caller_id FROM lineitem JOIN n ON qualified_name = 'q' || (l_orderkey % 500)""")
def known_callers(spark, d):
    """Calls from symbols that are not indexed are dropped."""
    o, line = views.load(spark, d, "orders"), views.load(spark, d, "lineitem")
    nodes = o.select(F.col("o_orderkey").alias("id"), _text("q", F.col("o_orderkey") % 400).alias("qualified_name"), F.lit("f").alias("file_path"), F.col("o_orderkey").alias("start_line"))
    calls = line.select("l_orderkey", "l_linenumber", _text("q", F.col("l_orderkey") % 500).alias("from_qualified_name"))
    return resolve.call_sites(calls, nodes).select("l_orderkey", "l_linenumber", "caller_id")


def _graph_sql():
    from strandgraph.plans import catalog

    return catalog.NODES_SQL, catalog.EDGES_SQL


@query("""WITH f AS (SELECT p_brand AS path, p_type || '.' || p_name AS q FROM part), r AS (SELECT DISTINCT path, q FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY q) AS nth FROM r)
SELECT path, 'modified' AS change, string_agg(q, '|' ORDER BY q) AS symbols FROM k WHERE nth <= 50 AND path LIKE '%1' GROUP BY path UNION ALL SELECT 'new.py', 'added', ''""")
def changed_symbols(spark, d):
    """Changed files with fifty of their symbols at most."""
    p = views.load(spark, d, "part").select(F.lit("Type").alias("label"), F.col("p_brand").alias("file_path"), F.concat_ws(".", "p_type", "p_name").alias("qualified_name"))
    paths = p.select(F.col("file_path").alias("path")).distinct()
    change = paths.select("path", F.when(F.col("path").endswith("1"), "modified").otherwise("unchanged").alias("change")).unionByName(spark.createDataFrame([("new.py", "added")], "path string, change string"))
    return coverage.changed_symbols(change, p).select("path", "change", F.array_join("symbols", "|").alias("symbols"))


@query("""WITH r AS (SELECT doc_id, range(1, doc_id % 40) AS l FROM documents)
SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 40 >= 2 THEN 'parse_partial' ELSE 'indexed' END AS status, CASE WHEN doc_id % 40 >= 2 THEN 'parse_error' END AS reason,
CASE WHEN doc_id % 40 >= 2 THEN array_to_string(list_transform(l[1:20], lambda x: x || '-' || (x + 1)), ',') END AS detail FROM r""")
def parse_coverage(spark, d):
    """Files that did not parse whole, with twenty ranges of lines at most."""
    k = F.col("doc_id")
    docs = views.load(spark, d, "documents")
    none = F.lit(None).cast("string")
    files = docs.select(_text("f", k).alias("path"), F.lit("indexed").alias("status"), none.alias("reason"), none.alias("detail"))
    errors = F.when(k % 40 >= 2, F.transform(F.sequence(F.lit(1), (k % 40).cast("int") - 1), lambda x: F.struct(x.alias("first_line"), (x + 1).alias("last_line")))).otherwise(F.array())
    return build.coverage(files, docs.select(_text("f", k).alias("path"), errors.alias("errors"))).select("path", "status", "reason", "detail")


@query("""WITH k AS (SELECT doc_id, doc_id % 6 AS w FROM documents)
SELECT CASE w WHEN 1 THEN 'a/t' || doc_id || '.txt' WHEN 5 THEN 'bin/run' || doc_id ELSE 'a/f' || doc_id || '.py' END AS path, CASE w WHEN 1 THEN NULL WHEN 5 THEN 'bash' ELSE 'python' END AS language,
CASE WHEN w IN (0, 5) THEN 'indexed' ELSE 'skipped' END AS status, CASE w WHEN 1 THEN 'unsupported_language' WHEN 2 THEN 'binary' WHEN 3 THEN 'oversized' WHEN 4 THEN 'read_error' END AS reason FROM k""")
def classified_files(spark, d):
    """Language by name or first line, and the checks that leave a file out."""
    k = F.col("doc_id")
    w = k % 6
    path = F.when(w == 1, _text("a/t", k, ".txt")).when(w == 5, _text("bin/run", k)).otherwise(_text("a/f", k, ".py"))
    content = F.when(w == 2, F.lit(bytearray(b"x\x00y"))).when(w == 5, F.lit(bytearray(b"#!/usr/bin/env -S bash -e\necho"))).when(w != 4, F.lit(bytearray(b"x = 1\n")))
    tree = views.load(spark, d, "documents").select(path.alias("path"), F.when(w == 3, s.MAX_FILE_BYTES + 1).otherwise(6).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("mtime_ns"), content.alias("content"))
    return repo.classified(tree).select("path", "language", "status", "reason")


@query("""WITH p AS (SELECT CASE doc_id % 7 WHEN 0 THEN 'logs/' || doc_id || '.log' WHEN 1 THEN 'keep' || doc_id || '.log' WHEN 2 THEN 'a/build/x' || doc_id || '.py' WHEN 3 THEN 'top' || doc_id || '.txt' WHEN 4 THEN 'a/top' || doc_id || '.txt'
WHEN 5 THEN '.hidden/' || doc_id || '.py' ELSE 'src/' || doc_id || '.py' END AS path, doc_id % 7 AS w FROM documents) SELECT path FROM p WHERE w IN (1, 4, 6)""")
def ignored_files(spark, d):
    """Files that ignore rules and hidden folders leave."""
    k = F.col("doc_id")
    w = k % 7
    path = F.when(w == 0, _text("logs/", k, ".log")).when(w == 1, _text("keep", k, ".log")).when(w == 2, _text("a/build/x", k, ".py")).when(w == 3, _text("top", k, ".txt")).when(w == 4, _text("a/top", k, ".txt"))
    path = path.when(w == 5, _text(".hidden/", k, ".py")).otherwise(_text("src/", k, ".py"))
    rules = Ignore().add("*.log\n!keep*.log\nbuild/\n/top*.txt\n# none\n")
    return repo.candidates(views.load(spark, d, "documents").select(path.alias("path")), rules).select("path")


@query("""WITH s AS (SELECT DISTINCT source FROM documents) SELECT 'go' AS kind, 'example.com/' || source AS name, source || '/g' AS dir FROM s UNION ALL SELECT 'dart', 'pk_' || source, source || '/d/lib' FROM s
UNION ALL SELECT 'alias', '@' || source || '/|src/*', source || '/t' FROM s UNION ALL SELECT 'alias', 'long/prefix/|other/*', source || '/t' FROM s""")
def manifests_found(spark, d):
    """Modules, packages and path aliases from manifests, comments and a base file read."""
    src = views.load(spark, d, "documents").select("source").distinct()
    own = F.col("source")
    files = [
        (_text(own, "/g/go.mod"), _text("// m\nmodule example.com/", own, "\n\ngo 1.20\n")), (_text(own, "/d/pubspec.yaml"), _text("name: pk_", own, "\nversion: 1\n")),
        (_text(own, "/t/tsconfig.json"), _text('{ /* a */ "extends": "./tsconfig.base.json", "compilerOptions": {"baseUrl": "src",}, }', F.lit(""))),
        (_text(own, "/t/tsconfig.base.json"), _text('{"compilerOptions": {"baseUrl": ".", "paths": {"@', own, '/*": ["*"], // b\n "long/prefix/*": ["../other/*"]}}}')),
    ]
    tree = None
    for path, text in files:
        part = src.select(path.alias("path"), text.cast("binary").alias("content"))
        tree = part if tree is None else tree.unionByName(part)
    m = manifests.discover(spark, tree)
    out = m["go"].select(F.lit("go").alias("kind"), F.col("path").alias("name"), "dir").unionByName(m["dart"].select(F.lit("dart").alias("kind"), "name", F.col("lib_dir").alias("dir")))
    return out.unionByName(m["aliases"].select(F.lit("alias").alias("kind"), _text(F.col("prefix"), "|", F.col("alias_target")).alias("name"), "dir"))


@query("SELECT DISTINCT 'en' AS language, 0 AS n WHERE false UNION ALL SELECT lang, count(*) FROM documents WHERE source < 'src5' GROUP BY 1")
def language_counts(spark, d):
    docs = views.load(spark, d, "documents")
    nodes = docs.select(F.when(F.col("source") < "src5", "File").otherwise("Class").alias("label"), F.col("lang").alias("language"), _text(F.col("source"), "/x").alias("file_path"))
    return graph.language_counts(nodes)


@query("SELECT p_partkey AS id FROM part WHERE starts_with(lower(p_name), 'l') AND regexp_matches(p_name, 'l.*[aeiou]$')")
def prefix_compatible_search(spark, d):
    """A pattern's literal prefix binds names from their beginning."""
    p = views.load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return search.search(p, name_pattern="l.*[aeiou]$", prefix_compat=True).select("id")


@query("SELECT p_partkey AS id, lower(p_name) AS name_key, p_brand AS qualified_name FROM part UNION ALL SELECT -1, 'second', 'v2'")
def snapshot_round_trip(spark, d):
    """A version is written, another follows, one that is not complete does not count."""
    store = Store(spark, f"{checkpoint_folder(spark)}/round-{uuid.uuid4().hex}")
    p = views.load(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("qualified_name"))
    store.write("g", nodes=p)
    store.write("g", nodes=store.current("g").get("nodes").drop("name_key").unionByName(spark.createDataFrame([(-1, "Second", "v2")], "id long, name string, qualified_name string")))
    store.begin("g").put("nodes", p.limit(0))
    return store.current("g").get("nodes").select("id", "name_key", "qualified_name")


@query("SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN -doc_id ELSE doc_id END AS mtime_ns FROM documents")
def set_times(spark, d):
    k = F.col("doc_id")
    docs = views.load(spark, d, "documents")
    return mutate.set_times(docs.select(_text("f", k).alias("path"), k.alias("mtime_ns")), docs.where("doc_id % 3 = 0").select(_text("f", k).alias("path"), (-k).alias("mtime_ns")))


@query("SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (event_type <> 'error') AS ok FROM events WHERE event_id % 10 <> 3 GROUP BY 1")
def journal_lines(spark, d):
    """A journal of JSON lines; malformed ones are skipped."""
    from strandgraph.api import Engine

    home = f"{checkpoint_folder(spark)}/journal-{uuid.uuid4().hex}"
    e = views.load(spark, d, "events")
    row = F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("at_unix"), F.col("event_type").alias("tool"), (F.col("event_type") != "error").alias("ok"))
    e.select(F.when(F.col("event_id") % 10 == 3, '{"at_unix": 1, "tool": "cut').otherwise(F.to_json(row)).alias("value")).write.text(f"{home}/journal")
    return Engine(spark, home).journal().groupBy("tool").agg(F.count("*").alias("calls"), F.count_if("ok").alias("ok"))


_USERS = """RECURSIVE p AS (SELECT user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS nxt FROM events WHERE event_type = 'purchase'),
e AS (SELECT DISTINCT user_id + 1 AS src, nxt + 1 AS dst FROM p WHERE nxt IS NOT NULL AND nxt <> user_id), s AS (SELECT min(src) AS id FROM e),
w AS (SELECT id, 0 AS hop FROM s UNION SELECT e.dst, w.hop + 1 FROM w JOIN e ON e.src = w.id WHERE w.hop < 3),
v AS (SELECT id, 0 AS hop FROM s UNION SELECT e.src, v.hop + 1 FROM v JOIN e ON e.dst = v.id WHERE v.hop < 3)"""


@query(f"""WITH {_USERS} SELECT 'callees' AS side, CAST(min(hop) AS INTEGER) AS hop, 'u' || id AS qualified_name FROM w WHERE id <> (SELECT id FROM s) GROUP BY id
UNION ALL SELECT 'callers', CAST(min(hop) AS INTEGER), 'u' || id FROM v WHERE id <> (SELECT id FROM s) GROUP BY id""")
def trace_levels(spark, d):
    """Callers and callees in three levels of a graph with cycles."""
    base = checkpoint_folder(spark)
    Store(spark, base)
    e = views.u_calls(spark, d).checkpoint()
    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    nodes = ids.select("id", _text("u", F.col("id")).alias("qualified_name"), F.lit("Function").alias("label"), F.lit("f").alias("file_path"), F.lit(1).alias("start_line"))
    return graph.trace(e.agg(F.min("src").alias("id")), nodes, e, graph.BOTH, 3).select("side", "hop", "qualified_name")


@query(f"""WITH {_USERS}, b AS (SELECT src AS id, dst AS other FROM e UNION SELECT dst, src FROM e), one AS (SELECT DISTINCT other AS id FROM b JOIN s USING (id) WHERE other <> (SELECT id FROM s)),
two AS (SELECT DISTINCT other AS id FROM b JOIN one USING (id) WHERE other NOT IN (SELECT id FROM one) AND other <> (SELECT id FROM s)),
a AS (SELECT id, 0 AS hop FROM s UNION ALL SELECT id, 1 FROM one UNION ALL SELECT id, 2 FROM two)
SELECT id, hop FROM (SELECT CAST(id AS BIGINT) AS id, hop, row_number() OVER (ORDER BY hop, 'u' || lpad(CAST(id AS VARCHAR), 9, '0')) AS nth FROM a) WHERE nth <= 30""")
def walk_truncated(spark, d):
    """A walk that ends at its limit of nodes."""
    checkpoint_folder(spark)
    e = views.u_calls(spark, d).checkpoint()
    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    nodes = ids.select("id", F.concat(F.lit("u"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("qualified_name"), F.lit("Function").alias("label"))
    return graph.walk(e.agg(F.min("src").alias("id")), nodes, e, ["CALLS"], None, 2, 30)[0]


@query("""SELECT DISTINCT 'f' || (p_partkey % 40) AS file_path, p_name AS name FROM part""")
def distinct_facts(spark, d):
    """A fact that a file states several times counts once."""
    from strandgraph.extract.files import extracted, facts

    p = views.load(spark, d, "part").select(_text("f", F.col("p_partkey") % 40, ".ini").alias("path"), "p_name")
    text = F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("import "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(";")))), " ")
    files = p.groupBy("path").agg(text.alias("text")).select(F.regexp_replace("path", "ini$", "java").alias("path"), F.lit("java").alias("language"), "text")
    return facts(extracted(files), "imports").select(F.regexp_replace("file_path", r"\.java$", "").alias("file_path"), F.replace("target", F.lit("_"), F.lit(" ")).alias("name"))


@query("""SELECT doc_id, 'a b/' || lang || '%' AS q, '' AS flag, 'x' || doc_id AS last FROM documents""")
def query_strings(spark, d):
    """Percent-decoded arguments of query strings."""
    from strandgraph.functions.strings import query_arguments

    k = F.col("doc_id")
    text = _text("q=a+b%2F", F.col("lang"), "%&flag&n=1&last=no&&last=x", k)
    got = views.load(spark, d, "documents").select("doc_id", query_arguments(text).alias("m"))
    return got.select("doc_id", F.col("m")["q"].alias("q"), F.col("m")["flag"].alias("flag"), F.col("m")["last"].alias("last"))


@query("""WITH e AS (SELECT event_type AS key, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), l AS (SELECT *, lag(t) OVER (PARTITION BY key ORDER BY t) AS b FROM e),
s AS (SELECT *, sum(CASE WHEN b IS NULL OR t - b > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM l)
SELECT key, min(t) AS first_at_unix, max(t) AS last_at_unix, count(*) AS calls FROM s GROUP BY key, n HAVING max(t) + 1800 <= (SELECT max(t) FROM e) - 3600""")
def stream_sessions(spark, d):
    """Sessions of a stream, by tool, that the watermark has passed."""
    from strandgraph.streaming import usage

    plain = views.load(spark, d, "events")
    stream = spark.readStream.schema(plain.schema).parquet(f"{d}/events.parque[t]")
    unix = views.epoch(stream, "ts")
    stream = stream.select(unix.alias("at_unix"), F.timestamp_seconds(unix).alias("at"), F.col("event_type").alias("tool"))
    base = f"{checkpoint_folder(spark)}/sessions-{uuid.uuid4().hex}"
    out = usage.sessions(stream, "1 hour", "tool")
    out.writeStream.outputMode("append").format("parquet").trigger(availableNow=True).option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def _add_fingerprint():
    nodes_sql, edges_sql = _graph_sql()

    @query(f"""WITH {nodes_sql}, {edges_sql}, n AS (SELECT id, concat_ws('|', label, qualified_name, file_path, start_line, end_line) AS k FROM g_nodes)
SELECT k FROM n UNION ALL SELECT concat_ws(' ', a.k, edge_type, coalesce(b.k, '?'), '', '', coalesce(CAST(line AS VARCHAR), '')) FROM g_edges e JOIN n a ON a.id = e.src LEFT JOIN n b ON b.id = e.dst""")
    def fingerprint(spark, d):
        """What is equal after any way of building a graph."""
        none = F.lit(None).cast("string")
        e = views.g_edges(spark, d).withColumns({"target_name": none, "detail": none})
        return build.fingerprint(build.Graph(None, None, views.g_nodes(spark, d), e))
