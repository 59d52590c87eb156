"""Graph-shaped views over plain star-schema tables, for tests and benches."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.sources.times import epoch
from strandgraph.storage import Store, Version, checkpoint_folder

KINDS = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "orders": 6}
SHIFT = 10**12
_snapshots: dict[tuple[str, str], Version] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(kind: str, key) -> F.Column:
    return (F.lit(KINDS[kind]) * F.lit(SHIFT).cast("bigint") + F.col(key).cast("bigint") + 1) if isinstance(key, str) else F.lit(KINDS[kind]) * F.lit(SHIFT).cast("bigint") + key.cast("bigint") + 1


def snapshot(spark: SparkSession, d: str, table: str) -> DataFrame:
    """``nodes`` or ``edges`` of the graph over the tables of ``d``, as an index
    holds them: built once a session, kept in the shared folder, in the layout of a
    project's snapshot."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _snapshots:
        store = Store(spark, f"{checkpoint_folder(spark)}/views")
        v = store.begin(f"g{zlib.crc32(d.encode()):08x}-{uuid.uuid4().hex[:8]}")
        v.put("nodes", _nodes(spark, d))
        v.put("edges", _edges(spark, d))
        _snapshots[key] = v.commit()
    return _snapshots[key].get(table)


def g_nodes(spark: SparkSession, d: str) -> DataFrame:
    return snapshot(spark, d, "nodes")


def g_edges(spark: SparkSession, d: str) -> DataFrame:
    return snapshot(spark, d, "edges")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    region, nation, customer, supplier, part, orders = (load(spark, d, t) for t in KINDS)
    rn = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    cust = customer.join(rn, F.col("c_nationkey") == F.col("n_nationkey"))

    def rows(df, kind, label, key, name, qn, path):
        k = F.col(key).cast("bigint")
        start = (k % 500 + 1).cast("int")
        return df.select(
            node_id(kind, key).alias("id"), F.lit(label).alias("label"), name.alias("name"), qn.alias("qualified_name"), F.concat(F.lit(kind + "/"), path).alias("file_path"),
            start.alias("start_line"), (start + (k % 37).cast("int")).alias("end_line"),
        )

    dot = lambda *c: F.concat_ws(".", *c)
    order_name = F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"))
    out = [
        rows(region, "region", "Package", "r_regionkey", F.col("r_name"), F.col("r_name"), F.lit("world")),
        rows(rn, "nation", "Module", "n_nationkey", F.col("n_name"), dot("r_name", "n_name"), F.col("r_name")),
        rows(cust, "customer", "Class", "c_custkey", F.col("c_name"), dot("r_name", "n_name", "c_name"), F.col("n_name")),
        rows(supplier.join(rn, F.col("s_nationkey") == F.col("n_nationkey")), "supplier", "Interface", "s_suppkey", F.col("s_name"), dot("r_name", "n_name", "s_name"), F.col("n_name")),
        rows(part, "part", "Type", "p_partkey", F.col("p_name"), dot("p_brand", "p_type", "p_name"), F.col("p_brand")),
        rows(orders.join(cust, F.col("o_custkey") == F.col("c_custkey")), "orders", "Function", "o_orderkey", order_name, F.concat_ws(".", "r_name", "n_name", "c_name", order_name), F.col("c_name")),
    ]
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def _edges(spark: SparkSession, d: str) -> DataFrame:
    region, nation, customer, supplier, part, orders = (load(spark, d, t) for t in KINDS)
    line = load(spark, d, "lineitem")

    def rows(df, src, dst, kind, line_=None):
        return df.select(src.alias("src"), dst.cast("bigint").alias("dst"), F.lit(kind).alias("edge_type"), (F.lit(None) if line_ is None else F.col(line_)).cast("int").alias("line"))

    i = node_id
    out = rows(nation, i("region", "n_regionkey"), i("nation", "n_nationkey"), "CONTAINS")
    out = out.unionByName(rows(customer, i("nation", "c_nationkey"), i("customer", "c_custkey"), "CONTAINS"))
    out = out.unionByName(rows(supplier, i("nation", "s_nationkey"), i("supplier", "s_suppkey"), "CONTAINS"))
    out = out.unionByName(rows(orders, i("customer", "o_custkey"), i("orders", "o_orderkey"), "DEFINES"))
    out = out.unionByName(rows(line, i("orders", "l_orderkey"), i("part", "l_partkey"), "CALLS", "l_linenumber"))
    out = out.unionByName(rows(line.select("l_partkey", "l_suppkey").distinct(), i("part", "l_partkey"), i("supplier", "l_suppkey"), "CALLS"))
    out = out.unionByName(rows(line.where("l_returnflag = 'R'"), i("orders", "l_orderkey"), F.lit(0), "CALL_UNRESOLVED", "l_linenumber"))
    return out.withColumn("id", F.xxhash64("src", "dst", "edge_type", "line"))


def u_calls(spark: SparkSession, d: str) -> DataFrame:
    """Users of purchases in a row: a graph with cycles."""
    from strandgraph.operators.journal import _next_to, numbered

    e = load(spark, d, "events").where("event_type = 'purchase'")
    e = e.select(epoch(e, "ts").alias("at_unix"), F.struct("ts", "event_id").alias("seq"), F.col("user_id").cast("bigint").alias("src"))
    e = _next_to(numbered(e), 0, 1, dst=lambda w: F.lead("src").over(w)).where("dst is not null and src <> dst")
    return e.select((F.col("src") + 1).alias("src"), (F.col("dst") + 1).alias("dst")).distinct().withColumn("edge_type", F.lit("CALLS")).withColumn("id", F.xxhash64("src", "dst"))


def symbols(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part")
    name = F.concat("p_name", F.lit("_"), (F.col("p_partkey") % 997).cast("string"))
    return p.select(F.col("p_partkey").alias("id"), name.alias("name"), F.concat_ws(".", "p_type", name).alias("qualified_name"), F.col("p_brand").alias("file_path"), (F.col("p_size") % 2 == 0).alias("method"))


def sites(spark: SparkSession, d: str) -> DataFrame:
    sym = symbols(spark, d)
    n = load(spark, d, "part").agg(F.count("*").alias("parts"))
    line = load(spark, d, "lineitem").crossJoin(F.broadcast(n))
    receiver = F.when(F.col("l_returnflag") == "N", "self").when(F.col("l_returnflag") == "R", "obj")
    line = line.select(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey").alias("caller_id"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % F.col("parts")).alias("callee_key"), receiver.alias("receiver"))
    caller = sym.select(F.col("id").alias("caller_id"), F.col("qualified_name").alias("caller_qn"), "file_path")
    callee = sym.select(F.col("id").alias("callee_key"), F.col("name").alias("callee_name"))
    return line.join(caller, "caller_id").join(callee, "callee_key").drop("callee_key")


def files(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = load(spark, d, "documents"), load(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("bad"))
    j = docs.join(labels, "doc_id", "left")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    big = F.col("n_chars") > 8000
    status = F.when(big, "skipped").when(F.col("bad"), "parse_partial").otherwise("indexed")
    reason = F.when(big, "oversized").when(F.col("bad"), "parse_error")
    return j.select("doc_id", path.alias("path"), F.sha2("text", 256).alias("hash"), F.col("n_chars").alias("size"), status.alias("status"), reason.alias("reason"), "text")


def journal(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    keys = F.when(k % 3 == 0, F.array(F.lit("cursor"), F.lit("project"))).otherwise(F.array(F.lit("project")))
    ok = F.col("event_type") != "error"
    return e.select(
        epoch(e, "ts").alias("at_unix"), F.struct("ts", "event_id").alias("seq"), F.col("event_type").alias("tool"), keys.alias("argument_keys"),
        (F.col("user_id") % 10).cast("string").alias("project"), F.col("value").cast("bigint").alias("duration_ms"), ok.alias("ok"),
        F.when(~ok, F.concat(F.lit("e"), (k % 4).cast("string"))).alias("error_code"), (k % 2 == 0).alias("has_more"),
    )
