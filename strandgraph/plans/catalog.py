"""One registered query for each operator that plain tables can exercise."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.functions import paths
from strandgraph.operators import coverage, graph, journal, mutate, paging, resolve, search
from strandgraph.plans import engine, extraction, operators
from strandgraph.sources import views
from strandgraph.storage import checkpoint_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}

_KIND = "CASE kind WHEN 'region' THEN 1 WHEN 'nation' THEN 2 WHEN 'customer' THEN 3 WHEN 'supplier' THEN 4 WHEN 'part' THEN 5 ELSE 6 END"
NODES_SQL = f"""
raw_nodes AS (
    SELECT 'region' AS kind, 'Package' AS label, CAST(r_regionkey AS BIGINT) AS k, r_name AS name, r_name AS qualified_name, 'world' AS p FROM region
    UNION ALL SELECT 'nation', 'Module', n_nationkey, n_name, r_name || '.' || n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'customer', 'Class', c_custkey, c_name, r_name || '.' || n_name || '.' || c_name, n_name
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'supplier', 'Interface', s_suppkey, s_name, r_name || '.' || n_name || '.' || s_name, n_name
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'part', 'Type', p_partkey, p_name, p_brand || '.' || p_type || '.' || p_name, p_brand FROM part
    UNION ALL SELECT 'orders', 'Function', o_orderkey, 'order_' || o_orderkey, r_name || '.' || n_name || '.' || c_name || '.order_' || o_orderkey, c_name
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), g_nodes AS (
    SELECT ({_KIND}) * 1000000000000 + k + 1 AS id, label, name, qualified_name, kind || '/' || p AS file_path,
        CAST(k % 500 + 1 AS INTEGER) AS start_line, CAST(k % 500 + 1 + k % 37 AS INTEGER) AS end_line FROM raw_nodes
)"""
EDGES_SQL = """
g_edges AS (
    SELECT 1000000000001 + n_regionkey AS src, 2000000000001 + n_nationkey AS dst, 'CONTAINS' AS edge_type, CAST(NULL AS INTEGER) AS line FROM nation
    UNION ALL SELECT 2000000000001 + c_nationkey, 3000000000001 + c_custkey, 'CONTAINS', NULL FROM customer
    UNION ALL SELECT 2000000000001 + s_nationkey, 4000000000001 + s_suppkey, 'CONTAINS', NULL FROM supplier
    UNION ALL SELECT 3000000000001 + o_custkey, 6000000000001 + o_orderkey, 'DEFINES', NULL FROM orders
    UNION ALL SELECT 6000000000001 + l_orderkey, 5000000000001 + l_partkey, 'CALLS', l_linenumber FROM lineitem
    UNION ALL SELECT DISTINCT 5000000000001 + l_partkey, 4000000000001 + l_suppkey, 'CALLS', CAST(NULL AS INTEGER) FROM lineitem
    UNION ALL SELECT 6000000000001 + l_orderkey, 0, 'CALL_UNRESOLVED', l_linenumber FROM lineitem WHERE l_returnflag = 'R'
)"""
JOURNAL_SQL = """
j AS (
    SELECT CAST(floor(epoch(ts)) AS BIGINT) AS at_unix, event_type AS tool, CAST(user_id % 10 AS VARCHAR) AS project, CAST(trunc(value) AS BIGINT) AS duration_ms,
        event_type <> 'error' AS ok, CAST(json_extract(props, '$.k') AS INTEGER) AS k, row_number() OVER (ORDER BY ts, event_id) AS n FROM events
), jj AS (
    SELECT *, k % 3 = 0 AS cur, k % 2 = 0 AS has_more, CASE WHEN NOT ok THEN 'e' || (k % 4) END AS error_code FROM j
)"""
FOLLOW_SQL = (
    JOURNAL_SQL
    + """, isl AS (
    SELECT *, sum(CASE WHEN tool IS DISTINCT FROM lt OR project IS DISTINCT FROM lp THEN 1 ELSE 0 END) OVER (ORDER BY n) AS isle
    FROM (SELECT *, lag(tool) OVER (ORDER BY n) AS lt, lag(project) OVER (ORDER BY n) AS lp FROM jj)
), f AS (
    SELECT *, coalesce(bool_or(cur) OVER (PARTITION BY isle ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING), false) AS followed FROM isl
)"""
)
SYMBOLS_SQL = """
sym AS (
    SELECT p_partkey AS id, p_name || '_' || (p_partkey % 997) AS name, p_type || '.' || p_name || '_' || (p_partkey % 997) AS qualified_name,
        p_brand AS file_path, p_size % 2 = 0 AS method FROM part
), calls AS (
    SELECT l_orderkey, l_linenumber, l_partkey AS caller_id, (l_partkey * 7 + l_linenumber) % (SELECT count(*) FROM part) AS callee_key,
        CASE l_returnflag WHEN 'N' THEN 'self' WHEN 'R' THEN 'obj' END AS receiver FROM lineitem
), sites AS (
    SELECT c.*, s.qualified_name AS caller_qn, s.file_path, t.name AS callee_name FROM calls c JOIN sym s ON s.id = c.caller_id JOIN sym t ON t.id = c.callee_key
)"""
FILES_SQL = """
files AS (
    SELECT d.doc_id, source || '/' || lang || '/doc_' || d.doc_id || '.txt' AS path, sha256(d.text) AS hash, n_chars AS size,
        CASE WHEN n_chars > 8000 THEN 'skipped' WHEN b.doc_id IS NOT NULL THEN 'parse_partial' ELSE 'indexed' END AS status,
        CASE WHEN n_chars > 8000 THEN 'oversized' WHEN b.doc_id IS NOT NULL THEN 'parse_error' END AS reason, d.text
    FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) b ON b.doc_id = d.doc_id
)"""
LINES_SQL = (
    FILES_SQL
    + """, lines AS (
    SELECT path, CAST(i AS INTEGER) AS line, parts[i] AS text
    FROM (SELECT path, string_split(regexp_replace(text, '\\r?\\n$', ''), chr(10)) AS parts FROM files WHERE length(text) > 0), unnest(range(1, len(parts) + 1)) AS u(i)
)"""
)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {NODES_SQL}, {EDGES_SQL}, i AS (SELECT dst AS id, count(*) AS n FROM g_edges WHERE dst <> 0 GROUP BY 1), o AS (SELECT src AS id, count(*) AS n FROM g_edges GROUP BY 1)
SELECT qualified_name, label, file_path, start_line, CAST(coalesce(i.n, 0) AS BIGINT) AS in_degree, CAST(coalesce(o.n, 0) AS BIGINT) AS out_degree
FROM g_nodes LEFT JOIN i USING (id) LEFT JOIN o USING (id) WHERE regexp_matches(name, '[13579]$') AND label IN ('Type', 'Interface')
ORDER BY in_degree DESC, qualified_name, file_path, start_line, id LIMIT 200""")
def top_symbols(spark, d):
    """Flagship: the most used types and interfaces whose name matches a pattern."""
    nodes = search.search(views.g_nodes(spark, d), name_pattern="[13579]$").where(F.col("label").isin("Type", "Interface"))
    out = graph.degrees(nodes, views.g_edges(spark, d)).orderBy(F.desc("in_degree"), *search.SEARCH_ORDER).limit(200)
    return out.select("qualified_name", "label", "file_path", "start_line", "in_degree", "out_degree")


@query(f"""WITH {NODES_SQL}, {EDGES_SQL}, i AS (SELECT dst AS id, count(*) AS n FROM g_edges WHERE dst <> 0 GROUP BY 1), o AS (SELECT src AS id, count(*) AS n FROM g_edges GROUP BY 1)
SELECT id, CAST(coalesce(i.n, 0) AS BIGINT) AS in_degree, CAST(coalesce(o.n, 0) AS BIGINT) AS out_degree FROM g_nodes LEFT JOIN i USING (id) LEFT JOIN o USING (id)""")
def degrees(spark, d):
    return graph.degrees(views.g_nodes(spark, d), views.g_edges(spark, d)).select("id", "in_degree", "out_degree")


@query(f"WITH {NODES_SQL} SELECT label, count(*) AS n FROM g_nodes WHERE file_path = 'customer' OR file_path LIKE 'customer/%' OR file_path LIKE 'orders/%' GROUP BY label")
def label_counts(spark, d):
    n = views.g_nodes(spark, d)
    return graph.label_counts(n, "customer").unionByName(graph.label_counts(n, "orders"))


@query(f"WITH {NODES_SQL} SELECT file_path, count(*) AS symbols FROM g_nodes GROUP BY 1 ORDER BY symbols DESC, file_path LIMIT 15")
def largest_files(spark, d):
    return graph.largest_files(views.g_nodes(spark, d))


@query(f"""WITH {EDGES_SQL} SELECT 'type' AS kind, edge_type AS key, count(*) AS n FROM g_edges GROUP BY 2
UNION ALL SELECT 'calls', CASE WHEN line IS NULL THEN '-' ELSE 'line ' || line END, count(*) FROM g_edges WHERE edge_type = 'CALLS' GROUP BY 2""")
def edge_census(spark, d):
    return graph.edge_census(views.g_edges(spark, d).withColumn("detail", F.concat(F.lit("line "), F.col("line").cast("string"))))


@query(f"WITH {NODES_SQL}, {EDGES_SQL} SELECT id, qualified_name FROM g_nodes WHERE label IN ('Function', 'Method') AND id NOT IN (SELECT dst FROM g_edges WHERE edge_type = 'CALLS' AND dst <> 0)")
def entry_points(spark, d):
    return graph.entry_points(views.g_nodes(spark, d), views.g_edges(spark, d)).select("id", "qualified_name")


@query(f"WITH {NODES_SQL}, {EDGES_SQL} SELECT id, label FROM g_nodes WHERE label NOT IN ('File', 'Package') AND id NOT IN (SELECT dst FROM g_edges WHERE edge_type IN ('CONTAINS', 'DEFINES'))")
def orphans(spark, d):
    return graph.orphans(views.g_nodes(spark, d), views.g_edges(spark, d)).select("id", "label")


@query(f"""WITH {NODES_SQL} SELECT id, qualified_name, file_path, start_line, end_line FROM g_nodes
WHERE label = 'Function' AND regexp_matches(name, '^order_1[0-9]*7$') AND regexp_matches(file_path, 'orders/.*[02468]$') ORDER BY qualified_name, file_path, start_line, id LIMIT 50 OFFSET 20""")
def search_page(spark, d):
    hits = search.search(views.g_nodes(spark, d), label="Function", name_pattern="^order_1[0-9]*7$", file_pattern="orders/.*[02468]$")
    return paging.page(hits, search.SEARCH_ORDER, paging.clamp(None, 50), paging.offset_of("20")).select("id", "qualified_name", "file_path", "start_line", "end_line")


@query(f"WITH {NODES_SQL} SELECT id, qualified_name FROM g_nodes WHERE lower(name) = 'asia' OR qualified_name = 'EUROPE' OR lower(name) = 'order_77'")
def lookups(spark, d):
    n = views.g_nodes(spark, d)
    parts = [search.search(n, name="aSiA"), search.search(n, qualified_name="EUROPE"), search.search(n, name="ORDER_77")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("id", "qualified_name")


@query(f"WITH {NODES_SQL} SELECT id, name FROM g_nodes WHERE starts_with(lower(name), 'order_12') ORDER BY lower(name), id LIMIT 20000")
def name_prefix(spark, d):
    return search.by_name_prefix(views.g_nodes(spark, d), "Order_12").select("id", "name")


@query(f"WITH {NODES_SQL} SELECT qualified_name, file_path, start_line FROM g_nodes WHERE lower(name) = (SELECT min(lower(p_name)) FROM part) AND qualified_name <> (SELECT min(p_name) FROM part)")
def symbol_candidates(spark, d):
    name = views.load(spark, d, "part").agg(F.min(F.lower("p_name"))).first()[0]
    return search.resolve_symbol(views.g_nodes(spark, d), name.upper()).select("qualified_name", "file_path", "start_line")


@query(f"""WITH {NODES_SQL}, {EDGES_SQL} SELECT DISTINCT a.qualified_name AS q0, b.qualified_name AS q1, c.qualified_name AS q2, x.qualified_name AS q3
FROM g_nodes a JOIN g_edges e ON e.src = a.id AND e.edge_type = 'CONTAINS' JOIN g_nodes b ON b.id = e.dst AND b.label = 'Class'
JOIN g_edges f ON f.src = b.id AND f.edge_type = 'DEFINES' JOIN g_nodes c ON c.id = f.dst
JOIN g_edges g ON g.src = c.id AND g.edge_type = 'CALLS' JOIN g_nodes x ON x.id = g.dst WHERE a.label = 'Module'""")
def path_pattern(spark, d):
    n, e = views.g_nodes(spark, d), views.g_edges(spark, d)
    hops = [{"edge": "CONTAINS", "label": "Class"}, {"edge": "DEFINES", "direction": "out"}, {"edge": "CALLS"}]
    out = graph.pattern(n.where("label = 'Module'"), n, e, hops)
    return out.select(*[F.col(f"n{i}.qualified_name").alias(f"q{i}") for i in range(4)])


@query(f"""WITH {NODES_SQL}, {EDGES_SQL} SELECT DISTINCT a.qualified_name AS callee, b.qualified_name AS caller FROM g_nodes a
JOIN g_edges e ON e.dst = a.id AND e.edge_type = 'CALLS' JOIN g_nodes b ON b.id = e.src WHERE a.label = 'Interface'""")
def inbound_pattern(spark, d):
    n, e = views.g_nodes(spark, d), views.g_edges(spark, d)
    out = graph.pattern(n.where("label = 'Interface'"), n, e, [{"edge": "CALLS", "direction": "in"}])
    return out.select(F.col("n0.qualified_name").alias("callee"), F.col("n1.qualified_name").alias("caller"))


@query(f"""WITH {NODES_SQL}, {EDGES_SQL} SELECT a.id AS start, e.dst AS other, e.edge_type, count(*) AS n FROM g_nodes a JOIN g_edges e ON e.src = a.id
WHERE a.label = 'Class' AND e.dst <> 0 GROUP BY 1, 2, 3""")
def neighbours(spark, d):
    starts = views.g_nodes(spark, d).where("label = 'Class'")
    return graph.neighbours(starts, views.g_edges(spark, d)).groupBy("start", "other", "edge_type").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE p AS (SELECT user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS nxt FROM events WHERE event_type = 'purchase'),
e AS (SELECT DISTINCT user_id + 1 AS src, nxt + 1 AS dst FROM p WHERE nxt IS NOT NULL AND nxt <> user_id),
s AS (SELECT min(src) AS id FROM e),
w AS (SELECT id, 0 AS hop FROM s UNION SELECT e.dst, w.hop + 1 FROM w JOIN e ON e.src = w.id WHERE w.hop < 6)
SELECT CAST(id AS BIGINT) AS id, CAST(min(hop) AS INTEGER) AS hop FROM w WHERE id <> (SELECT id FROM s) GROUP BY id""")
def reach_on_cycles(spark, d):
    checkpoint_folder(spark)
    e = views.u_calls(spark, d).checkpoint()
    return graph.reach(e.agg(F.min("src").alias("id")), e, graph.OUT, 6)


@query(f"""WITH {NODES_SQL}, {EDGES_SQL}, r AS (SELECT min(id) AS id FROM g_nodes WHERE label = 'Type'),
down AS (SELECT DISTINCT e.dst AS id FROM g_edges e JOIN r ON e.src = r.id WHERE e.edge_type = 'CALLS' AND dst <> 0),
up AS (SELECT DISTINCT e.src AS id FROM g_edges e JOIN r ON e.dst = r.id WHERE e.edge_type = 'CALLS')
SELECT 'callees' AS side, 1 AS hop, qualified_name, label, file_path, start_line FROM g_nodes JOIN down USING (id)
UNION ALL SELECT 'callers', 1, qualified_name, label, file_path, start_line FROM g_nodes JOIN up USING (id)""")
def trace_both_ways(spark, d):
    checkpoint_folder(spark)
    n = views.g_nodes(spark, d)
    return graph.trace(n.where("label = 'Type'").agg(F.min("id").alias("id")), n, views.g_edges(spark, d), graph.BOTH, 3)


@query(f"""WITH {NODES_SQL}, {EDGES_SQL} SELECT a.qualified_name AS from_qualified_name, '' AS callee_name, e.line, 'unresolved' AS reason
FROM g_edges e JOIN g_nodes a ON a.id = e.src WHERE e.edge_type = 'CALL_UNRESOLVED'""")
def unresolved_calls(spark, d):
    n, e = views.g_nodes(spark, d), views.g_edges(spark, d).withColumns({"target_name": F.lit(None).cast("string"), "detail": F.lit(None).cast("string")})
    return graph.unresolved_of(n, n, e)


@query(f"""WITH {NODES_SQL}, {EDGES_SQL}, s AS (SELECT id FROM g_nodes WHERE label = 'Module'),
b AS (SELECT src AS id, dst AS other FROM g_edges WHERE edge_type IN ('CONTAINS', 'DEFINES') UNION SELECT dst, src FROM g_edges WHERE edge_type IN ('CONTAINS', 'DEFINES')),
one AS (SELECT DISTINCT other AS id FROM b JOIN s USING (id) WHERE other NOT IN (SELECT id FROM s)),
two AS (SELECT DISTINCT other AS id FROM b JOIN one USING (id) WHERE other NOT IN (SELECT id FROM s) AND other NOT IN (SELECT id FROM one))
SELECT id, 0 AS hop FROM s UNION ALL SELECT id, 1 FROM one UNION ALL SELECT id, 2 FROM two""")
def walk_nodes(spark, d):
    checkpoint_folder(spark)
    n = views.g_nodes(spark, d)
    return graph.walk(n.where("label = 'Module'"), n, views.g_edges(spark, d), ["CONTAINS", "DEFINES"], None, 2, None)[0]


@query(f"""WITH {NODES_SQL}, {EDGES_SQL}, e AS (SELECT * FROM g_edges WHERE edge_type = 'CALLS'), t AS (SELECT id, count(*) AS score FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id)
SELECT id, CAST(coalesce(score, 0) AS BIGINT) AS score FROM g_nodes LEFT JOIN t USING (id) WHERE label IN ('Type', 'Function') ORDER BY score DESC, qualified_name, id LIMIT 220""")
def hubs(spark, d):
    return graph.hubs(views.g_nodes(spark, d), views.g_edges(spark, d), ["Type", "Function"], ["CALLS"]).select("id", "score")


@query(f"""WITH {NODES_SQL}, {EDGES_SQL}, h AS (SELECT src AS id, min(dst) AS handler_id FROM g_edges WHERE src BETWEEN 5000000000001 AND 6000000000000 GROUP BY src)
SELECT r.id, r.qualified_name, x.qualified_name AS handler FROM g_nodes r LEFT JOIN h ON h.id = r.id LEFT JOIN g_nodes x ON x.id = h.handler_id WHERE r.label = 'Type'""")
def route_handlers(spark, d):
    n = views.g_nodes(spark, d).withColumn("label", F.when(F.col("label") == "Type", "Route").otherwise(F.col("label")))
    e = views.g_edges(spark, d).where("src between 5000000000001 and 6000000000000").withColumns({"edge_type": F.lit("ROUTES_TO"), "id": F.col("dst")})
    return graph.route_handlers(n, e).select("id", "qualified_name", "handler")


@query(f"""WITH {NODES_SQL}, p AS (SELECT DISTINCT file_path, start_line + 3 AS line FROM g_nodes WHERE label = 'Function'),
r AS (SELECT p.file_path, p.line, n.id, row_number() OVER (PARTITION BY p.file_path, p.line ORDER BY n.end_line - n.start_line, n.id) AS nth
FROM p LEFT JOIN g_nodes n ON n.file_path = p.file_path AND p.line BETWEEN n.start_line AND n.end_line)
SELECT file_path, CAST(line AS INTEGER) AS line, id AS span_id FROM r WHERE nth = 1""")
def innermost_spans(spark, d):
    n = views.g_nodes(spark, d)
    points = n.where("label = 'Function'").select("file_path", (F.col("start_line") + 3).alias("line")).distinct().withColumn("id", F.concat_ws(":", "file_path", "line"))
    return graph.innermost(points, n).select("file_path", "line", "span_id")


_LEVEL = "CASE WHEN other THEN CASE WHEN {p}_nm = 1 THEN {p}_idm END ELSE CASE WHEN {p}_n = 1 THEN {p}_id END END"
_AGG = "count(*) AS {p}_n, min(id) AS {p}_id, count(CASE WHEN method THEN 1 END) AS {p}_nm, min(CASE WHEN method THEN id END) AS {p}_idm"


@query(f"""WITH {SYMBOLS_SQL}, sc AS (SELECT *, regexp_extract(qualified_name, '^(.*)\\.[^.]*$', 1) AS scope FROM sym),
f AS (SELECT file_path, name, {_AGG.format(p='f')} FROM sc GROUP BY 1, 2), m AS (SELECT scope, name, {_AGG.format(p='m')} FROM sc GROUP BY 1, 2), p AS (SELECT name, {_AGG.format(p='p')} FROM sc GROUP BY 1),
x AS (SELECT s.*, receiver IS NOT NULL AND receiver NOT IN ('self', 'this') AS other, f.* EXCLUDE (file_path, name), m.* EXCLUDE (scope, name), p.* EXCLUDE (name)
FROM sites s LEFT JOIN f ON f.file_path = s.file_path AND f.name = s.callee_name LEFT JOIN m ON m.scope = regexp_extract(s.caller_qn, '^(.*)\\.[^.]*$', 1) AND m.name = s.callee_name LEFT JOIN p ON p.name = s.callee_name),
y AS (SELECT *, {_LEVEL.format(p='f')} AS a, {_LEVEL.format(p='m')} AS b, {_LEVEL.format(p='p')} AS c FROM x)
SELECT l_orderkey, l_linenumber, caller_id, coalesce(a, b, c, 0) AS dst, CASE WHEN coalesce(a, b, c) IS NULL THEN 'CALL_UNRESOLVED' ELSE 'CALLS' END AS edge_type,
CASE WHEN coalesce(a, b, c) IS NULL THEN CASE WHEN coalesce(p_n, 0) > 1 THEN 'ambiguous_name_in_project' WHEN p_n = 1 AND other THEN 'receiver_type_unknown_no_matching_method' WHEN p_n = 1 THEN 'name_known_but_scope_mismatch' ELSE 'no_definition_in_index' END
WHEN coalesce(a, b, c) = caller_id THEN 'recursive_self_call' WHEN a IS NOT NULL THEN 'same_file_name_match' WHEN b IS NOT NULL THEN 'same_module_name_match' ELSE 'unique_callable_name_in_project' END AS detail,
CAST(CASE WHEN coalesce(a, b, c) IS NULL THEN 0.0 WHEN coalesce(a, b, c) = caller_id OR a IS NOT NULL THEN 1.0 WHEN b IS NOT NULL THEN 0.9 ELSE 0.7 END AS DOUBLE) AS confidence FROM y""")
def resolve_calls(spark, d):
    out = resolve.resolve_calls(views.sites(spark, d), views.symbols(spark, d))
    return out.select("l_orderkey", "l_linenumber", "caller_id", "dst", "edge_type", "detail", "confidence")


@query(f"""WITH {NODES_SQL}, r AS (SELECT id, name AS supertype_name FROM g_nodes WHERE label IN ('Module', 'Package', 'Interface') UNION ALL SELECT id, regexp_extract(qualified_name, '^[^.]*\\.(.*)$', 1) FROM g_nodes WHERE label = 'Class'),
k AS (SELECT DISTINCT supertype_name FROM r),
e AS (SELECT k.supertype_name, max(n.id) AS x FROM k JOIN g_nodes n ON n.qualified_name = k.supertype_name GROUP BY 1),
c AS (SELECT id, list_aggregate(list_slice(string_split(qualified_name, '.'), i, len(string_split(qualified_name, '.'))), 'string_agg', '.') AS s FROM g_nodes, unnest(range(2, len(string_split(qualified_name, '.')) + 1)) AS u(i)),
f AS (SELECT k.supertype_name, min(c.id) AS x FROM k JOIN c ON c.s = k.supertype_name GROUP BY 1 HAVING count(DISTINCT c.id) = 1)
SELECT r.id, r.supertype_name, coalesce(e.x, f.x, 0) AS dst FROM r LEFT JOIN e USING (supertype_name) LEFT JOIN f USING (supertype_name)""")
def resolve_types(spark, d):
    n = views.g_nodes(spark, d)
    r = n.where(F.col("label").isin("Module", "Package", "Interface")).select("id", F.col("name").alias("supertype_name"))
    r = r.unionByName(n.where("label = 'Class'").select("id", F.regexp_extract("qualified_name", r"^[^.]*\.(.*)$", 1).alias("supertype_name")))
    return resolve.resolve_types(r, n).select("id", "supertype_name", "dst")


@query("""WITH n AS (SELECT count(*) AS c FROM documents), f AS (SELECT doc_id + 1 AS id, source, lang, doc_id FROM documents),
i AS (SELECT f.id, f.doc_id, (f.doc_id * 7 + 3) % c AS k FROM f, n),
t AS (SELECT i.*, CASE WHEN i.doc_id % 5 = 0 THEN './gone' WHEN i.doc_id % 5 = 1 THEN g.source || '.' || g.lang || '.doc_' || k ELSE '../../' || g.source || '/' || g.lang || '/doc_' || k END AS target FROM i JOIN f g ON g.doc_id = i.k)
SELECT id AS src, target, k + 1 AS dst FROM t WHERE doc_id % 5 <> 0 AND doc_id <> k""")
def resolve_imports(spark, d):
    """Relative imports, dotted modules, and some that lead nowhere."""
    docs = views.load(spark, d, "documents")
    n = docs.agg(F.count("*").alias("c"))
    stem = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"))
    files = docs.select((F.col("doc_id") + 1).alias("id"), F.concat(stem, F.lit(".py")).alias("path"))
    own = docs.crossJoin(F.broadcast(n)).select("doc_id", F.concat(stem, F.lit(".py")).alias("from_file"), ((F.col("doc_id") * 7 + 3) % F.col("c")).alias("k"))
    other = docs.select(F.col("doc_id").alias("k"), stem.alias("stem"))
    way = F.col("doc_id") % 5
    target = F.when(way == 0, "./gone").when(way == 1, F.replace("stem", F.lit("/"), F.lit("."))).otherwise(F.concat(F.lit("../../"), "stem"))
    imports = own.join(other, "k").select("from_file", target.alias("target"), F.lit(1).alias("line"))
    return resolve.resolve_imports(imports, files).select("src", "target", "dst")


@query("""WITH b AS (SELECT source || '/' || lang AS parent, CASE WHEN doc_id % 3 = 0 THEN 'index' ELSE 'doc_' || doc_id END AS base FROM documents),
p AS (SELECT *, parent || '/' || base || '.ts' AS path FROM b)
SELECT path, 0 AS rank, path AS spelling FROM p UNION ALL SELECT path, 1, parent || '/' || base FROM p UNION ALL SELECT path, 101, parent FROM p WHERE base = 'index'""")
def import_spellings(spark, d):
    base = F.when(F.col("doc_id") % 3 == 0, "index").otherwise(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
    p = views.load(spark, d, "documents").select(F.concat("source", F.lit("/"), "lang", F.lit("/"), base, F.lit(".ts")).alias("path"))
    return p.select("path", F.explode(paths.spellings(F.col("path"))).alias("s")).select("path", "s.rank", "s.spelling")


@query(f"""WITH {FILES_SQL} SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '[^/]*$') AS base, replace(regexp_extract(path, '^(.*)\\.[^.]*$', 1), '/', '.') AS module,
CASE WHEN path LIKE '%src/%' THEN 2 ELSE 0 END AS score FROM files""")
def path_functions(spark, d):
    p = F.col("path")
    return views.files(spark, d).select("path", paths.parent_dir(p).alias("dir"), paths.basename(p).alias("base"), paths.module_prefix(p).alias("module"), paths.source_score(p).alias("score"))


@query(f"WITH {FILES_SQL} SELECT count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'parse_partial') AS parse_partial, count(*) FILTER (status = 'skipped') AS skipped, count(*) AS total FROM files")
def coverage_summary(spark, d):
    return coverage.summary(views.files(spark, d))


@query(f"""WITH {FILES_SQL} SELECT min(path) AS path, coalesce(reason, '') AS reason, count(*) - 1 AS others_like_it FROM files WHERE status <> 'indexed'
GROUP BY regexp_extract(path, '^(.*)/[^/]*$', 1), coalesce(reason, '') ORDER BY others_like_it DESC, path LIMIT 25""")
def coverage_sample(spark, d):
    return coverage.sample(views.files(spark, d).where("status <> 'indexed'"))


@query(f"WITH {FILES_SQL} SELECT path, status, reason FROM files WHERE path LIKE 'src1/%'")
def coverage_scope(spark, d):
    return coverage.in_scope(views.files(spark, d), "src1/").select("path", "status", "reason")


@query(f"""WITH {FILES_SQL}, a AS (SELECT path, doc_id % 2 = 0 AS excluded FROM files), k AS (SELECT * FROM files WHERE doc_id % 6 = 0)
SELECT a.path, coalesce(k.status, CASE WHEN excluded THEN 'excluded' ELSE 'skipped' END) AS status, CASE WHEN k.path IS NULL THEN CASE WHEN excluded THEN 'gitignore' ELSE 'not_found' END ELSE k.reason END AS reason
FROM a LEFT JOIN k ON k.path = a.path""")
def classify_paths(spark, d):
    f = views.files(spark, d).withColumns({"detail": F.lit(None).cast("string"), "language": F.lit(None).cast("string")})
    asked = f.select("path", (F.col("doc_id") % 2 == 0).alias("excluded"), F.lit(False).alias("present"))
    return coverage.classify_paths(asked, f.where("doc_id % 6 = 0")).select("path", "status", "reason")


_CHANGES = f"""WITH {FILES_SQL}, t AS (SELECT path, CASE WHEN doc_id % 11 = 5 THEN '' ELSE hash END AS h FROM files WHERE doc_id % 10 <> 4),
r AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE hash END AS h FROM files WHERE doc_id % 10 <> 3),
c AS (SELECT coalesce(t.path, r.path) AS path, CASE WHEN r.path IS NULL THEN 'added' WHEN t.path IS NULL THEN 'removed' WHEN t.h <> '' AND t.h = r.h THEN 'unchanged' ELSE 'modified' END AS change FROM t FULL JOIN r ON t.path = r.path)"""


def _changed(spark, d):
    f = views.files(spark, d)
    tree = f.where("doc_id % 10 <> 4").select("path", F.when(F.col("doc_id") % 11 == 5, "").otherwise(F.col("hash")).alias("hash"))
    recorded = f.where("doc_id % 10 <> 3").select("path", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("hash")).alias("hash"))
    return coverage.changes(tree, recorded)


@query(_CHANGES + " SELECT path, change FROM c")
def changes(spark, d):
    return _changed(spark, d)


@query(_CHANGES + " SELECT " + ", ".join(f"count(*) FILTER (change = '{x}') AS {x}" for x in ("added", "modified", "removed", "unchanged")) + " FROM c")
def change_counts(spark, d):
    return coverage.change_counts(_changed(spark, d))


@query(f"""WITH {FILES_SQL} SELECT path FROM files WHERE doc_id % 9 = 1 OR doc_id % 10 = 3""")
def stale_files(spark, d):
    f = views.files(spark, d).withColumn("mtime_ns", F.col("doc_id"))
    now = f.withColumn("size", F.when(F.col("doc_id") % 9 == 1, -1).otherwise(F.col("size")))
    return coverage.stale(now, f.where("doc_id % 10 <> 3"))


@query(f"WITH {LINES_SQL} SELECT path, line, substr(regexp_replace(text, '\\s+$', ''), 1, 400) AS text FROM lines WHERE contains(text, 'token')")
def search_text(spark, d):
    return search.search_lines(search.lines_of(views.files(spark, d)), "token")


@query(f"WITH {LINES_SQL} SELECT path, line, substr(regexp_replace(text, '\\s+$', ''), 1, 400) AS text FROM lines WHERE regexp_matches(text, '^[A-Z][a-z]+ [a-z]*tion') AND regexp_matches(path, '/en/')")
def search_regex(spark, d):
    return search.search_lines(search.lines_of(views.files(spark, d)), "^[A-Z][a-z]+ [a-z]*tion", regex=True, file_pattern="/en/")


@query(f"WITH {LINES_SQL} SELECT path, line, substr(regexp_replace(text, '\\s+$', ''), 1, 400) AS text FROM lines WHERE contains(lower(text), 'licensed under')")
def search_any_case(spark, d):
    return search.search_lines(search.lines_of(views.files(spark, d)), "LICENSED Under", case_sensitive=False)


@query(f"""WITH {FILES_SQL}, n AS (SELECT doc_id AS id, path, string_split(regexp_replace(text, '\\r?\\n$', ''), chr(10)) AS b, CAST(doc_id % 3 + 1 AS INTEGER) AS s FROM files)
SELECT id, greatest(s - 2, 1) AS from_line, CAST(least(s + 3, len(b)) AS INTEGER) AS to_line, coalesce(array_to_string(list_slice(b, greatest(s - 2, 1), least(s + 3, len(b))), chr(10)), '') AS source FROM n""")
def snippets(spark, d):
    f = views.files(spark, d)
    start = (F.col("doc_id") % 3 + 1).cast("int")
    n = f.select(F.col("doc_id").alias("id"), F.col("path").alias("qualified_name"), F.col("path").alias("file_path"), start.alias("start_line"), (start + 1).alias("end_line"))
    return search.snippet(f, n, 2).select("id", "from_line", "to_line", "source")


@query(f"""WITH {FOLLOW_SQL}, g AS (SELECT *, duration_ms % 3 <> 0 AS good, duration_ms % 6 = 0 AS lost FROM f)
SELECT count(*) AS total_calls, count(*) FILTER (good) AS ok, count(*) FILTER (NOT good) AS fail, min_by(at_unix, n) AS first_at_unix, max_by(at_unix, n) AS last_at_unix,
count(*) FILTER (cur) AS pages_requested, count(*) FILTER (has_more) AS truncated_responses, count(*) FILTER (has_more AND followed) AS paged_followthrough,
count(*) FILTER (tool IN ('click', 'purchase')) AS graph_calls, count(*) FILTER (tool = 'signup') AS text_search_calls, count(*) FILTER (tool IN ('click', 'purchase')) AS walk_calls,
count(*) FILTER (tool IN ('click', 'purchase') AND NOT good) AS walk_failures, count(*) FILTER (tool = 'error') AS detect_changes, count(*) FILTER (tool = 'view') AS check_index_coverage, count(*) FILTER (lost) AS project_not_found FROM g""")
def journal_totals(spark, d):
    """All totals; the events are given the names of calls."""
    named = {"click": "query_graph", "purchase": "trace_path", "view": "check_index_coverage", "signup": "search_code", "error": "detect_changes"}
    tool = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])[F.col("tool")]
    bad = F.col("duration_ms") % 3 == 0
    code = F.when(bad, F.when(F.col("duration_ms") % 2 == 0, "project_not_found").otherwise("other"))
    return journal.totals(views.journal(spark, d).withColumns({"tool": tool, "ok": ~bad, "error_code": code}))


@query(f"WITH {JOURNAL_SQL} SELECT 'tool' AS kind, tool AS key, count(*) AS n FROM jj GROUP BY 2 UNION ALL SELECT 'error', error_code, count(*) FROM jj WHERE error_code IS NOT NULL GROUP BY 2")
def journal_counts(spark, d):
    j = views.journal(spark, d)
    named = lambda kind, c: journal.counts(j, c).select(F.lit(kind).alias("kind"), F.col(c).alias("key"), "n")
    return named("tool", "tool").unionByName(named("error", "error_code"))


@query(f"""WITH {JOURNAL_SQL}, s AS (SELECT tool, ok, duration_ms, row_number() OVER (PARTITION BY tool ORDER BY duration_ms) - 1 AS i, count(*) OVER (PARTITION BY tool) AS c FROM jj)
SELECT tool, count(*) AS calls, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS fail, max(duration_ms) FILTER (i = round((c - 1) * 0.5)) AS duration_p50_ms,
max(duration_ms) FILTER (i = round((c - 1) * 0.95)) AS duration_p95_ms, max(duration_ms) AS duration_max_ms FROM s GROUP BY tool""")
def tool_stats(spark, d):
    return journal.tool_stats(views.journal(spark, d))


@query(f"""WITH {FOLLOW_SQL}, a AS (SELECT *, CASE WHEN project IN ('1', '2') THEN 'one' ELSE project END AS canonical FROM f),
m AS (SELECT canonical, string_agg(tool || '=' || c, ',' ORDER BY tool) AS tools FROM (SELECT canonical, tool, count(*) AS c FROM a GROUP BY 1, 2) GROUP BY 1)
SELECT canonical AS project, count(*) AS calls, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS fail, count(*) FILTER (cur) AS pages_requested, count(*) FILTER (has_more AND followed) AS paged_followthrough,
min(at_unix) AS first_at_unix, max(at_unix) AS last_at_unix, any_value(m.tools) AS tools FROM a JOIN m USING (canonical) GROUP BY canonical""")
def projects(spark, d):
    aliases = spark.createDataFrame([("1", "one"), ("2", "one")], "alias string, canonical string")
    p = journal.projects(views.journal(spark, d), aliases)
    tools = F.array_join(F.transform(F.map_entries("by_tool"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return p.select("project", "calls", "ok", "fail", "pages_requested", "paged_followthrough", "first_at_unix", "last_at_unix", tools.alias("tools"))


@query(f"""WITH {JOURNAL_SQL}, l AS (SELECT *, lag(at_unix) OVER (ORDER BY n) AS b FROM jj), s AS (SELECT *, sum(CASE WHEN b IS NULL OR at_unix - b > 1800 THEN 1 ELSE 0 END) OVER (ORDER BY n) AS session FROM l)
SELECT CAST(session AS BIGINT) AS session, min(at_unix) AS first_at_unix, max(at_unix) AS last_at_unix, count(*) AS calls, min_by(tool, n) AS first_tool, string_agg(DISTINCT project, ',' ORDER BY project) AS projects FROM s GROUP BY session""")
def sessions(spark, d):
    return journal.sessions(views.journal(spark, d)).select("session", "first_at_unix", "last_at_unix", "calls", "first_tool", F.array_join("projects", ",").alias("projects"))


@query(f"""WITH {JOURNAL_SQL}, l AS (SELECT tool || ' -> ' || lead(tool) OVER (ORDER BY n) AS sequence FROM jj) SELECT sequence, count(*) AS n FROM l WHERE sequence IS NOT NULL GROUP BY 1 ORDER BY n DESC, sequence LIMIT 10""")
def sequences(spark, d):
    return journal.sequences(views.journal(spark, d))


@query(f"""WITH {JOURNAL_SQL} SELECT count(*) AS calls, min(at_unix) AS first_at_unix FROM jj WHERE at_unix >= (SELECT max(at_unix) FROM jj) - 86400""")
def day_window(spark, d):
    j = views.journal(spark, d)
    now = j.agg(F.max("at_unix")).first()[0]
    return journal.window(j, "day", now).agg(F.count("*").alias("calls"), F.min("at_unix").alias("first_at_unix"))


@query(f"""WITH {NODES_SQL}, o AS (SELECT 'order_' || l_orderkey AS caller, p_brand || '.' || p_type || '.' || p_name AS callee, count(*) AS c FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
SELECT caller, callee, a.id AS src, CASE WHEN b.n = 1 THEN b.id END AS dst, 'observed ' || c || ' time(s)' AS detail FROM o LEFT JOIN (SELECT name, min(id) AS id FROM g_nodes GROUP BY name HAVING count(*) = 1) a ON a.name = o.caller
LEFT JOIN (SELECT qualified_name, min(id) AS id, count(*) AS n FROM g_nodes GROUP BY 1) b ON b.qualified_name = o.callee""")
def trace_links(spark, d):
    line, part = views.load(spark, d, "lineitem"), views.load(spark, d, "part")
    seen = line.join(part, F.col("p_partkey") == F.col("l_partkey")).select(F.concat(F.lit("order_"), F.col("l_orderkey").cast("string")).alias("caller"), F.concat_ws(".", "p_brand", "p_type", "p_name").alias("callee"))
    seen = seen.groupBy("caller", "callee").agg(F.count("*").alias("count"))
    return resolve.link_traces(seen, views.g_nodes(spark, d)).select("caller", "callee", "src", "dst", "detail")


@query("""WITH l AS (SELECT page_id, u.i, 'p' || page_id AS n FROM pages, unnest(range(0, 8)) AS u(i))
SELECT page_id, CASE i WHEN 0 THEN 'js/' || n || '.js' WHEN 1 THEN './img/' || n || '.png' WHEN 2 THEN '../css/' || n || '.css' END AS target FROM l WHERE i < 3""")
def page_assets(spark, d):
    """Local files that pages pull in, by tag; links, other hosts and data are none."""
    n = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    html = [
        F.concat(F.lit('<p><script async src="js/'), n, F.lit('.js"></script>')), F.concat(F.lit('<IMG alt="" SRC = "./img/'), n, F.lit('.png">')),
        F.concat(F.lit('<link rel="stylesheet" href="../css/'), n, F.lit('.css">')), F.lit('<a href="next.html">n</a>'), F.lit('<script src="https://cdn.example/x.js"></script>'),
        F.lit('<img src="//cdn.example/y.png">'), F.lit('<img src="data:image/png;base64,AA">'), F.lit('<iframe src="#top"></iframe>'),
    ]
    p = views.load(spark, d, "pages").select("page_id", F.concat(*html).alias("html"))
    tags = F.expr(r"""regexp_extract_all(html, '(?i)<(?:script|img|link|iframe|source|embed)\\b[^>]*?\\b(?:src|href)\\s*=\\s*"([^"]*)"', 1)""")
    return p.select("page_id", F.explode(tags).alias("t")).select("page_id", paths.shipped_asset(F.col("t")).alias("target")).where("target is not null")


@query(f"""WITH {NODES_SQL}, {EDGES_SQL}, gone AS (SELECT id FROM g_nodes WHERE file_path LIKE 'part/%3') SELECT edge_type, count(*) AS n FROM g_edges
WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) GROUP BY 1 UNION ALL SELECT 'nodes', count(*) FROM g_nodes WHERE id NOT IN (SELECT id FROM gone)""")
def remove_files(spark, d):
    n, e = views.g_nodes(spark, d), views.g_edges(spark, d)
    gone = n.where("file_path like 'part/%3'").select(F.col("file_path").alias("path")).distinct()
    nodes, edges = mutate.remove_files(n, e, gone)
    return edges.groupBy("edge_type").agg(F.count("*").alias("n")).unionByName(nodes.agg(F.lit("nodes").alias("edge_type"), F.count("*").alias("n")))


@query(f"""WITH {NODES_SQL}, {EDGES_SQL} SELECT edge_type, count(*) AS n FROM g_edges WHERE NOT (edge_type IN ('CALLS', 'CALL_UNRESOLVED') AND src IN (SELECT id FROM g_nodes WHERE file_path LIKE 'orders/%1')) GROUP BY 1""")
def clear_resolved(spark, d):
    n, e = views.g_nodes(spark, d), views.g_edges(spark, d)
    files = n.where("file_path like 'orders/%1'").select(F.col("file_path").alias("path")).distinct()
    return mutate.clear_resolved(n, e, files).groupBy("edge_type").agg(F.count("*").alias("n"))


@query(f"""WITH {EDGES_SQL} SELECT edge_type, count(*) AS n FROM g_edges WHERE edge_type NOT IN ('CALLS', 'DEFINES') GROUP BY 1""")
def clear_types(spark, d):
    return mutate.clear_types(views.g_edges(spark, d), ["CALLS", "DEFINES"]).groupBy("edge_type").agg(F.count("*").alias("n"))


@query(f"""WITH {FILES_SQL} SELECT path, CASE WHEN doc_id % 5 = 0 THEN -1 ELSE size END AS size FROM files UNION ALL SELECT 'new.txt', 7""")
def upsert_files(spark, d):
    f = views.files(spark, d)
    new = f.where("doc_id % 5 = 0").select("path", F.lit(-1).cast("bigint").alias("size")).unionByName(spark.createDataFrame([("new.txt", 7)], "path string, size long"))
    return mutate.upsert(f.select("path", "size"), new, "path")


@query("""SELECT DISTINCT p_name AS name FROM part WHERE p_brand LIKE '%2' UNION SELECT DISTINCT 'new_' || p_name FROM part WHERE p_brand LIKE '%2' AND p_partkey % 2 = 0""")
def touched_names(spark, d):
    p = views.load(spark, d, "part").select(F.col("p_brand").alias("file_path"), F.col("p_name").alias("name"), "p_partkey")
    after = p.where("p_partkey % 2 = 0").withColumn("name", F.concat(F.lit("new_"), "name"))
    return mutate.touched_names(p, after, p.where("file_path like '%2'").select(F.col("file_path").alias("path")).distinct())


@query("""WITH p AS (SELECT source || '/doc_' || doc_id AS file_path, 'f' || (doc_id % 50) AS callee, 'm.T' || (doc_id % 40) AS super, 'lib' || (doc_id % 30) AS spelling FROM documents)
SELECT file_path FROM p WHERE callee IN ('f3', 'f7') OR super = 'm.T3' OR spelling = 'lib9' UNION SELECT 'changed.py'""")
def affected_files(spark, d):
    k = F.col("doc_id")
    p = views.load(spark, d, "documents").select(F.concat("source", F.lit("/doc_"), k.cast("string")).alias("file_path"), F.concat(F.lit("f"), (k % 50).cast("string")).alias("callee_name"), F.concat(F.lit("m.T"), (k % 40).cast("string")).alias("supertype_name"), F.concat(F.lit("lib"), (k % 30).cast("string")).alias("candidate"))
    names = spark.createDataFrame([("f3",), ("f7",), ("T3",)], "name string")
    spelled = spark.createDataFrame([("lib9",)], "spelling string")
    changed = spark.createDataFrame([("changed.py",)], "path string")
    return coverage.affected(changed, p, p.withColumnRenamed("file_path", "from_file"), p, names, spelled)


@query("""SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS from_unix, event_type AS tool, count(*) AS calls, count(*) FILTER (event_type = 'error') AS fail, CAST(sum(trunc(value)) AS BIGINT) AS duration_ms FROM events GROUP BY 1, 2""")
def stream_tool_rates(spark, d):
    """Tumbling windows by Structured Streaming, run until the input is read."""
    from strandgraph.streaming import usage

    plain = views.load(spark, d, "events")
    stream = spark.readStream.schema(plain.schema).parquet(f"{d}/events.parque[t]")
    at = F.timestamp_seconds(views.epoch(stream, "ts"))
    stream = stream.select(at.alias("at"), F.col("event_type").alias("tool"), (F.col("event_type") != "error").alias("ok"), F.col("value").cast("bigint").alias("duration_ms"))
    base = f"{checkpoint_folder(spark)}/rates-{uuid.uuid4().hex}"
    rates = usage.tool_rates(stream, "1 hour").drop("to_unix")
    writer = rates.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{base}/state")
    writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).start().awaitTermination()
    return spark.read.schema(rates.schema).parquet(f"{base}/out")


operators._add_fingerprint()


def queries():
    return {**QUERIES, **operators.QUERIES, **extraction.QUERIES, **engine.QUERIES}


def oracle_sql():
    return {**SQL, **operators.SQL, **extraction.SQL, **engine.SQL}


def entry(spark: SparkSession) -> DataFrame:
    return top_symbols(spark, os.environ.get("ENTRY_SF_DIR", "/root/testdata/sf0.001"))
