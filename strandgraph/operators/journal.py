"""Usage analytics over an append-only call journal.

Order matters in a journal: sessions, pairs of calls and follow-ups look at the
rows next to a row. Rows are therefore numbered once over the whole journal
(counts per time slice, then numbers within it), and neighbours are looked up
in chunks of ``CHUNK`` numbers that overlap by as many rows as a question looks
ahead or back, so no step puts the journal into one task.

Journals have JOURNAL's columns and ``seq``, which orders rows of one second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP_SECONDS = 1800
LOOK_AHEAD = 7
CHUNK = 65_536
SLICE_SECONDS = 60
DAY = 86_400

# Calls that use the graph, and those that walk it.
GRAPH_TOOLS = ("search_graph", "query_graph", "trace_path", "get_architecture")
WALK_TOOLS = ("query_graph", "trace_path")


def window(journal: DataFrame, name: str = "all", now: int | None = None) -> DataFrame:
    """The whole journal, or the day before ``now``."""
    return journal if name == "all" else journal.where(F.col("at_unix") >= F.lit(now) - DAY)


def resolved(journal: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``journal`` with ``canonical``, the project that a recorded name means."""
    if aliases is None:
        return journal.withColumn("canonical", F.col("project"))
    a = aliases.select(F.col("alias").alias("project"), F.col("canonical").alias("known"))
    return journal.join(a, "project", "left").withColumn("canonical", F.coalesce("known", "project")).drop("known")


def numbered(journal: DataFrame) -> DataFrame:
    """``journal`` with ``n``, its row number from 0 by (at_unix, seq)."""
    j = journal.withColumn("slice", F.floor(F.col("at_unix") / SLICE_SECONDS))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = j.groupBy("slice").agg(F.count("*").alias("c")).select("slice", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    w = Window.partitionBy("slice").orderBy("at_unix", "seq")
    return j.join(base, "slice").withColumn("n", F.col("base") + F.row_number().over(w) - 1).drop("slice", "base")


def _chunked(rows: DataFrame, back: int, ahead: int) -> DataFrame:
    """Rows by chunk, those near its ends in the next chunks too; ``own`` is true
    in the chunk that a row belongs to."""
    own = F.floor(F.col("n") / CHUNK)
    near = F.array_distinct(F.array(own, F.floor((F.col("n") + back) / CHUNK), F.floor(F.greatest(F.col("n") - ahead, F.lit(0)) / CHUNK)))
    return rows.withColumn("chunk", F.explode(near)).withColumn("own", F.col("chunk") == own)


def _next_to(rows: DataFrame, back: int, ahead: int, **columns: Column) -> DataFrame:
    """``rows`` with columns over the window of their neighbours."""
    w = Window.partitionBy("chunk").orderBy("n")
    c = _chunked(rows, back, ahead)
    return c.select("*", *[f(w).alias(k) for k, f in columns.items()]).where("own").drop("chunk", "own")


def followed(rows: DataFrame) -> DataFrame:
    """Numbered rows with ``followed``: among the next ``LOOK_AHEAD`` rows, as
    long as tool and project stay the same, one has a cursor."""
    same = F.lit(False)
    w = Window.partitionBy("chunk").orderBy("n")
    c = _chunked(rows, 0, LOOK_AHEAD).withColumn("cursor", F.array_contains("argument_keys", "cursor"))
    going = F.lit(True)
    for k in range(1, LOOK_AHEAD + 1):
        alike = F.coalesce((F.lead("tool", k).over(w) == F.col("tool")) & F.lead("project", k).over(w).eqNullSafe(F.col("project")) & F.lead(F.lit(True), k).over(w), F.lit(False))
        going = going & alike
        same = same | (going & F.coalesce(F.lead("cursor", k).over(w), F.lit(False)))
    return c.withColumn("followed", same).where("own").drop("chunk", "own", "cursor")


def totals(journal: DataFrame) -> DataFrame:
    """One row of totals."""
    j = followed(numbered(journal))
    at = lambda f: f("at_unix", F.col("n"))
    is_, cut = F.col("tool"), F.col("has_more") == True  # noqa: E712
    return j.agg(
        F.count("*").alias("total_calls"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("fail"),
        at(F.min_by).alias("first_at_unix"), at(F.max_by).alias("last_at_unix"),
        F.count_if(is_.isin(*GRAPH_TOOLS)).alias("graph_calls"), F.count_if(is_ == "search_code").alias("text_search_calls"),
        F.count_if(F.array_contains("argument_keys", "cursor")).alias("pages_requested"),
        F.count_if(cut).alias("truncated_responses"), F.count_if(cut & F.col("followed")).alias("paged_followthrough"),
        F.count_if(is_.isin(*WALK_TOOLS)).alias("walk_calls"), F.count_if(is_.isin(*WALK_TOOLS) & ~F.col("ok")).alias("walk_failures"),
        F.count_if(is_ == "detect_changes").alias("detect_changes"), F.count_if(is_ == "check_index_coverage").alias("check_index_coverage"),
        F.count_if(F.col("error_code") == "project_not_found").alias("project_not_found"),
    )


def counts(journal: DataFrame, column: str) -> DataFrame:
    return journal.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def tool_stats(journal: DataFrame) -> DataFrame:
    """Calls, failures and nearest-rank percentiles of duration for each tool.
    Durations are counted by value first, so a busy tool is no large group."""
    by = journal.groupBy("tool", "duration_ms").agg(F.count("*").alias("c"), F.count_if("ok").alias("good"))
    w = Window.partitionBy("tool")
    upto = w.orderBy("duration_ms").rowsBetween(Window.unboundedPreceding, 0)
    by = by.withColumn("total", F.sum("c").over(w)).withColumn("upto", F.sum("c").over(upto))
    rank = lambda p: F.round((F.col("total") - 1) * p).cast("bigint") + 1
    at = lambda p: F.min(F.when(F.col("upto") >= rank(p), F.col("duration_ms")))
    return by.groupBy("tool").agg(F.sum("c").alias("calls"), F.sum("good").alias("ok"), (F.sum("c") - F.sum("good")).alias("fail"), at(0.5).alias("duration_p50_ms"), at(0.95).alias("duration_p95_ms"), F.max("duration_ms").alias("duration_max_ms"))


def projects(journal: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Usage of each project, most calls first, with counts by tool and error."""
    j = followed(numbered(resolved(journal, aliases)))
    cut = F.col("has_more") == True  # noqa: E712
    # one row for each (project, tool, error); everything else is sums of these
    by = j.groupBy("canonical", "tool", "error_code").agg(
        F.count("*").alias("calls"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("fail"),
        F.count_if(F.array_contains("argument_keys", "cursor")).alias("pages_requested"), F.count_if(cut).alias("truncated_responses"),
        F.count_if(cut & F.col("followed")).alias("paged_followthrough"), F.min("at_unix").alias("first_at_unix"), F.max("at_unix").alias("last_at_unix"),
    )
    of_tools = lambda *t: F.coalesce(F.sum(F.when(F.col("tool").isin(*t), F.col("calls"))), F.lit(0))
    sums = [F.sum(c).alias(c) for c in ("calls", "ok", "fail", "pages_requested", "truncated_responses", "paged_followthrough")]
    main = by.groupBy(F.coalesce("canonical", F.lit("")).alias("key")).agg(
        F.min("canonical").alias("project"), *sums, of_tools(*GRAPH_TOOLS).alias("graph_calls"), of_tools("search_code").alias("text_search_calls"),
        F.min("first_at_unix").alias("first_at_unix"), F.max("last_at_unix").alias("last_at_unix"),
        F.collect_list(F.struct("tool", "error_code", "calls")).alias("each"),
    )

    def counted(column: str):
        """Calls by a column: a project has few tools and errors."""
        some = F.array_sort(F.array_distinct(F.filter(F.transform("each", lambda x: x[column]), lambda v: v.isNotNull())))
        total = lambda v: F.aggregate(F.filter("each", lambda x: x[column] == v), F.lit(0).cast("bigint"), lambda a, x: a + x["calls"])
        return F.map_from_entries(F.transform(some, lambda v: F.struct(v, total(v))))

    out = main.select("*", counted("tool").alias("by_tool"), counted("error_code").alias("by_error_code"))
    names = ["project", "calls", "ok", "fail", "graph_calls", "text_search_calls", "pages_requested", "truncated_responses", "paged_followthrough", "first_at_unix", "last_at_unix", "by_tool", "by_error_code"]
    return out.select(*names).orderBy(F.desc("calls"), F.asc_nulls_first("project"))


def sequences(journal: DataFrame, limit: int = 10) -> DataFrame:
    """The most frequent pairs of calls in a row."""
    j = _next_to(numbered(journal).select("n", "tool"), 0, 1, next=lambda w: F.lead("tool").over(w))
    pairs = j.where("next is not null").groupBy(F.concat_ws(" -> ", "tool", "next").alias("sequence")).agg(F.count("*").alias("n"))
    return pairs.orderBy(F.desc("n"), "sequence").limit(limit)


def in_sessions(journal: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """Numbered rows with ``session`` from 1: a pause of more than ``gap``
    seconds begins a new one."""
    j = _next_to(numbered(journal), 1, 0, before=lambda w: F.lag("at_unix").over(w))
    j = j.withColumn("starts", F.when(F.col("before").isNull() | (F.col("at_unix") - F.col("before") > gap), 1).otherwise(0)).drop("before")
    j = j.withColumn("chunk", F.floor(F.col("n") / CHUNK))
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = j.groupBy("chunk").agg(F.sum("starts").alias("s")).select("chunk", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    upto = Window.partitionBy("chunk").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return j.join(base, "chunk").withColumn("session", F.col("base") + F.sum("starts").over(upto)).drop("chunk", "base", "starts")


def sessions(journal: DataFrame, aliases: DataFrame | None = None, gap: int = GAP_SECONDS) -> DataFrame:
    """One row a session."""
    j = in_sessions(resolved(journal, aliases), gap)
    first = F.min_by("tool", "n")
    return j.groupBy("session").agg(
        F.min("at_unix").alias("first_at_unix"), F.max("at_unix").alias("last_at_unix"), F.count("*").alias("calls"), first.alias("first_tool"),
        (first == "list_projects").alias("list_projects_first"), F.sort_array(F.collect_set("canonical")).alias("projects"),
    )
