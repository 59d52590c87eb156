"""Degrees, neighbours, path patterns, reachability, walks and architecture.

Graphs are two frames: nodes(id, label, name, qualified_name, file_path,
start_line, end_line, ...) and edges(id, src, dst, edge_type, ...); dst 0 means
unresolved. Loops over levels checkpoint each level in the session's checkpoint
folder, and stop when a level is empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.functions.paths import under
from strandgraph.schema import CALLABLES, EDGE_TYPES, NODE_LABELS, UNRESOLVED, GraphError

OUT, IN, BOTH = "out", "in", "both"
_DIRECTIONS = {None: OUT, "out": OUT, "outbound": OUT, "callees": OUT, "in": IN, "inbound": IN, "callers": IN, "both": BOTH}

# What the atlas views show.
VIEW_EDGES = {
    "overview": ("IMPORTS", "CONTAINS"), "imports": ("IMPORTS",), "calls": ("CALLS",), "routes": ("ROUTES_TO", "CALLS"),
    "neighborhood": ("CONTAINS", "DEFINES", "CALLS", "IMPORTS", "INHERITS", "IMPLEMENTS", "ROUTES_TO", "IMPACTS"),
}
VIEW_LABELS = {"overview": ("File", "Module", "Package", "Class", "Interface", "Trait", "Struct"), "imports": ("File", "Package", "Module"), "calls": CALLABLES, "routes": ("Route", "Function", "Method"), "neighborhood": None}


def direction(name: str | None) -> str:
    if name not in _DIRECTIONS:
        raise GraphError("invalid_argument", f"direction must be 'in' or 'out'; got '{name}'")
    return _DIRECTIONS[name]


def of_types(edges: DataFrame, types) -> DataFrame:
    for t in types or ():
        if t not in EDGE_TYPES:
            raise GraphError("invalid_argument", f"unknown edge type '{t}'")
    return edges.where(F.col("edge_type").isin(*types)) if types else edges


def degrees(nodes: DataFrame, edges: DataFrame, types=None, few: bool = False) -> DataFrame:
    """``nodes`` with in_degree and out_degree; parallel edges count, and
    unresolved ones count only where they leave. ``few``: nodes are a page of
    bounded size, so edges elsewhere are left out before they are counted."""
    e = of_types(edges, types).select("src", "dst")
    if few:
        own = F.broadcast(nodes.select("id"))
        out = e.join(own.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"))
        in_ = e.join(own.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))
        d = out.unionByName(in_).groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
        return _with_degrees(nodes, d)
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    d = e.select(ends.alias("e")).select("e.*").where(F.col("id") != UNRESOLVED).groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return _with_degrees(nodes, d)


def _with_degrees(nodes: DataFrame, d: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return nodes.join(d, "id", "left").select(nodes["*"], zero("in_degree"), zero("out_degree"))


def neighbours(starts: DataFrame, edges: DataFrame, way: str = OUT, types=None) -> DataFrame:
    """(start, other, edge_type, edge_id) for the ids of ``starts``."""
    e = of_types(edges, types).where(F.col("dst") != UNRESOLVED)
    near, far = ("src", "dst") if way == OUT else ("dst", "src")
    e = e.select(F.col(near).alias("start"), F.col(far).alias("other"), "edge_type", F.col("id").alias("edge_id"))
    return e.join(starts.select(F.col("id").alias("start")).distinct(), "start", "left_semi")


def pattern(starts: DataFrame, nodes: DataFrame, edges: DataFrame, hops: list[dict]) -> DataFrame:
    """Paths that follow ``hops`` ({"edge", "direction", "label"}) from
    ``starts``: columns n0, n1, ... of (qualified_name, label, file_path,
    start_line, end_line, via_edge). One row for each tuple of qualified names;
    of several, the one with the least places."""
    # paths are ids until the end; those that parallel edges repeat are one after each hop
    paths = starts.select(F.col("id").alias("i0")).distinct()
    for k, hop in enumerate(hops, 1):
        if hop.get("label") is not None and hop["label"] not in NODE_LABELS:
            raise GraphError("invalid_argument", f"unknown label '{hop['label']}'")
        e = of_types(edges, [hop["edge"]]).where(F.col("dst") != UNRESOLVED)
        near, far = ("src", "dst") if direction(hop.get("direction")) == OUT else ("dst", "src")
        e = e.select(F.col(near).alias(f"i{k - 1}"), F.col(far).alias(f"i{k}"))
        paths = paths.join(e, f"i{k - 1}").distinct()
        if hop.get("label") is not None:
            paths = paths.join(nodes.where(F.col("label") == hop["label"]).select(F.col("id").alias(f"i{k}")), f"i{k}", "left_semi")
    cells = [f"n{i}" for i in range(len(hops) + 1)]
    for k, name in enumerate(cells):
        via = F.lit(hops[k - 1]["edge"] if k else None).cast("string").alias("via_edge")
        cell = F.struct("qualified_name", "label", "file_path", "start_line", "end_line", via)
        paths = paths.join((starts if not k else nodes).select(F.col("id").alias(f"i{k}"), cell.alias(name)), f"i{k}").drop(f"i{k}")
    names = [F.col(f"{c}.qualified_name").alias(f"q{i}") for i, c in enumerate(cells)]
    least = paths.select(*names, F.struct(*cells).alias("cells")).groupBy(*[f"q{i}" for i in range(len(cells))]).agg(F.min("cells").alias("cells"))
    return least.select("cells.*")


def reach(starts: DataFrame, edges: DataFrame, way: str = OUT, depth: int = 3, types=("CALLS",), by: str | None = None) -> DataFrame:
    """(id, hop): nodes within ``depth`` edges of ``starts``, by fewest edges;
    starts are not in it. ``by`` names a column of ``starts`` that keeps
    several searches apart."""
    key = [by] if by else []
    near, far = ("src", "dst") if way == OUT else ("dst", "src")
    # parallel edges are left in: making a level distinct is less than making all edges so
    e = of_types(edges, types).where(F.col("dst") != UNRESOLVED).select(F.col(near).alias("id"), F.col(far).alias("other"))
    seen = starts.select(*key, "id").distinct().withColumn("hop", F.lit(0)).checkpoint()
    front = seen.drop("hop")
    for hop in range(1, depth + 1):
        step = front.join(e, "id").select(*key, F.col("other").alias("id")).distinct()
        front = step.join(seen, [*key, "id"], "left_anti").checkpoint()
        if front.isEmpty():
            break
        seen = seen.unionByName(front.withColumn("hop", F.lit(hop)))
    return seen.where("hop > 0")


def unresolved_of(roots: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Unresolved calls out of ``roots``, by callee and line."""
    e = edges.where((F.col("edge_type") == "CALL_UNRESOLVED") & (F.col("dst") == UNRESOLVED))
    e = e.join(roots.select(F.col("id").alias("src"), F.col("qualified_name").alias("from_qualified_name")), "src")
    return e.select("from_qualified_name", F.coalesce("target_name", F.lit("")).alias("callee_name"), "line", F.coalesce("detail", F.lit("unresolved")).alias("reason"))


def trace(root: DataFrame, nodes: DataFrame, edges: DataFrame, way: str = BOTH, depth: int = 3) -> DataFrame:
    """Callers and callees of ``root``: (side, hop, qualified_name, label,
    file_path, start_line)."""
    depth = max(1, min(10, depth))
    out = None
    for side, d in (("callers", IN), ("callees", OUT)):
        if way in (BOTH, d):
            part = reach(root, edges, d, depth).join(nodes, "id").select(F.lit(side).alias("side"), "hop", "qualified_name", "label", "file_path", "start_line")
            out = part if out is None else out.unionByName(part)
    return out


def walk(starts: DataFrame, nodes: DataFrame, edges: DataFrame, types, labels=None, depth: int = 2, limit: int | None = 220) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges around ``starts``, both ways, at most ``limit`` nodes, or
    all where it is None: (id, hop) and (src, dst, edge_type) between them. Starts
    count first, then nodes by level and qualified name."""
    e = of_types(edges, types).where(F.col("dst") != UNRESOLVED).select("src", "dst", "edge_type")
    both = e.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(e.select(F.col("dst").alias("id"), F.col("src").alias("other")))
    allowed = nodes if labels is None else nodes.where(F.col("label").isin(*labels))
    allowed = allowed.select(F.col("id").alias("other"), "qualified_name")
    seen = starts.select("id").distinct().withColumn("hop", F.lit(0)).checkpoint()
    front, left = seen.select("id"), None if limit is None else limit - seen.count()
    for hop in range(1, depth + 1):
        if left is not None and left <= 0:
            break
        step = front.join(both, "id").select("other").distinct().join(allowed, "other").select(F.col("other").alias("id"), "qualified_name")
        front = step.join(seen, "id", "left_anti")
        if left is not None:
            front = front.orderBy("qualified_name", "id").limit(left)
        front = front.select("id").checkpoint()
        n = front.count()
        if not n:
            break
        left = None if left is None else left - n
        seen = seen.unionByName(front.withColumn("hop", F.lit(hop)))
    kept = seen.select("id")
    inside = e.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return seen, inside.select("src", "dst", "edge_type").distinct()


def hubs(nodes: DataFrame, edges: DataFrame, labels, types, limit: int = 220) -> DataFrame:
    """The nodes of ``labels`` with the most edges of ``types``."""
    n = nodes.where(F.col("label").isin(*labels)) if labels else nodes
    scored = degrees(n, edges.where(F.col("dst") != UNRESOLVED), types).withColumn("score", F.col("in_degree") + F.col("out_degree"))
    return scored.orderBy(F.desc("score"), "qualified_name", "id").limit(limit)


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Callables that no call reaches; one that calls itself is reached."""
    called = edges.where((F.col("edge_type") == "CALLS") & (F.col("dst") != UNRESOLVED)).select(F.col("dst").alias("id"))
    return nodes.where(F.col("label").isin(*CALLABLES)).join(called.distinct(), "id", "left_anti")


def route_handlers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Routes with their first handler by edge id, or none."""
    first = edges.where((F.col("edge_type") == "ROUTES_TO") & (F.col("dst") != UNRESOLVED)).groupBy(F.col("src").alias("id")).agg(F.min_by("dst", "id").alias("handler_id"))
    h = nodes.select(F.col("id").alias("handler_id"), F.col("qualified_name").alias("handler"))
    routes = nodes.where(F.col("label") == "Route")
    return routes.join(first, "id", "left").join(h, "handler_id", "left").drop("handler_id")


def label_counts(nodes: DataFrame, scope: str = "") -> DataFrame:
    return nodes.where(under(F.col("file_path"), scope)).groupBy("label").agg(F.count("*").alias("n"))


def language_counts(nodes: DataFrame, scope: str = "") -> DataFrame:
    files = nodes.where((F.col("label") == "File") & F.col("language").isNotNull())
    return files.where(under(F.col("file_path"), scope)).groupBy("language").agg(F.count("*").alias("n"))


def largest_files(nodes: DataFrame, scope: str = "", limit: int = 15) -> DataFrame:
    n = nodes.where((F.col("label") != "File") & under(F.col("file_path"), scope)).groupBy("file_path").agg(F.count("*").alias("symbols"))
    return n.orderBy(F.desc("symbols"), "file_path").limit(limit)


def edge_census(edges: DataFrame) -> DataFrame:
    """Edges by type, and calls by how they were resolved, in one pass."""
    detail = F.when(F.col("edge_type") == "CALLS", F.coalesce("detail", F.lit("-")))
    by = edges.groupBy("edge_type", detail.alias("detail")).agg(F.count("*").alias("n"))
    types = by.groupBy("edge_type").agg(F.sum("n").alias("n")).select(F.lit("type").alias("kind"), F.col("edge_type").alias("key"), "n")
    return types.unionByName(by.where("detail is not null").select(F.lit("calls").alias("kind"), F.col("detail").alias("key"), "n"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes other than files and packages without a parent."""
    held = edges.where(F.col("edge_type").isin("CONTAINS", "DEFINES")).select(F.col("dst").alias("id")).distinct()
    return nodes.where(~F.col("label").isin("File", "Package")).join(held, "id", "left_anti")


def innermost(points: DataFrame, spans: DataFrame, key: str = "file_path") -> DataFrame:
    """(point columns, span_id): the shortest span of the same file that holds
    each point's ``line``; of equal ones the least id. ``points`` needs ``key``,
    ``line`` and an ``id`` of its own; spans have id, start_line, end_line."""
    s = spans.select(F.col(key).alias("k"), F.col("id").alias("span_id"), "start_line", "end_line")
    held = points.join(s, (points[key] == s["k"]) & points["line"].between(s["start_line"], s["end_line"]))
    best = held.groupBy(points["id"]).agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("size"), "span_id")).alias("best"))
    return points.join(best.select("id", F.col("best.span_id").alias("span_id")), "id", "left")


def narrowest(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(file_path, line, size, span_id): for each ``file_path`` and ``line`` of
    ``points`` the shortest of ``spans(file_path, id, start_line, end_line)`` around
    it, of equal ones the least id. A span is cut into aligned blocks of 2**level
    lines, two a level at most, and a line looks up the one block of each level that
    holds it: the joins are on equal keys and their rows grow with points and spans,
    not with their product."""
    a, z = (F.col(c).cast("bigint") for c in ("start_line", "end_line"))
    one = spans.groupBy("file_path", a.alias("a"), z.alias("z")).agg(F.min("id").alias("id")).where("a <= z")
    top = F.length(F.bin(F.expr("z - a + 1"))) - 1
    blocks = one.select("file_path", F.expr("z - a").alias("size"), "id", "a", "z", F.explode(F.sequence(F.lit(0), top)).alias("level"))
    blocks = blocks.withColumns({"l": F.expr("shiftright(a + shiftleft(1L, level) - 1, level)"), "r": F.expr("shiftright(z + 1, level)")}).where("l < r")
    ends = F.filter(F.array(F.when(F.col("l") % 2 != 0, F.col("l")), F.when(F.col("r") % 2 != 0, F.col("r") - 1)), lambda b: b.isNotNull())
    blocks = blocks.select("file_path", "level", F.explode(ends).alias("block"), F.struct("size", F.col("id").alias("span_id")).alias("b"))
    blocks = blocks.groupBy("file_path", "level", "block").agg(F.min("b").alias("b"))
    most = one.agg(F.max(top).alias("top"))
    at = points.select("file_path", "line").distinct().crossJoin(F.broadcast(most)).where("top is not null")
    at = at.select("file_path", "line", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("level"))
    at = at.withColumn("block", F.expr("shiftright(cast(line as bigint), level)"))
    best = at.join(blocks, ["file_path", "level", "block"]).groupBy("file_path", "line").agg(F.min("b").alias("b"))
    return best.select("file_path", "line", "b.size", "b.span_id")


def containment(definitions: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, edge_type): CONTAINS from the innermost definition around each
    definition, else DEFINES from its file. ``files`` has id and file_path."""
    inner = definitions.select(F.col("id").alias("dst"), "file_path", F.col("start_line").alias("a"), F.col("end_line").alias("z"))
    outer = definitions.where(F.col("label") != "Field").select(F.col("id").alias("src"), F.col("file_path").alias("f"), "start_line", "end_line")
    wider = (F.col("start_line") <= F.col("a")) & (F.col("end_line") >= F.col("z")) & (F.col("src") != F.col("dst"))
    wider = wider & ((F.col("end_line") - F.col("start_line") > F.col("z") - F.col("a")) | (F.col("src") < F.col("dst")))
    held = inner.join(outer, (F.col("file_path") == F.col("f")) & wider)
    # of equally long ones the last is the innermost
    best = held.groupBy("dst").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("size"), (-F.col("src")).alias("minus"))).alias("best"))
    best = best.select("dst", (-F.col("best.minus")).alias("src"))
    roots = inner.join(best, "dst", "left_anti").join(files.select("file_path", F.col("id").alias("src")), "file_path")
    return best.select("src", "dst", F.lit("CONTAINS").alias("edge_type")).unionByName(roots.select("src", "dst", F.lit("DEFINES").alias("edge_type")))


def ranked_by_name(df: DataFrame) -> DataFrame:
    """Latest of several nodes with one qualified name, by (file, line)."""
    w = Window.partitionBy("qualified_name").orderBy(F.desc("file_path"), F.desc("start_line"), F.desc("id"))
    return df.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
