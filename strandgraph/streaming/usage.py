"""Live forms: usage of a growing journal, and refresh of an index by batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph import schema as s
from strandgraph.operators.journal import GAP_SECONDS


def journal_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Rows of a journal folder as they come; malformed lines are skipped."""
    df = spark.readStream.schema(s.JOURNAL).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_batch).json(folder)
    return df.withColumn("at", F.timestamp_seconds("at_unix"))


def sessions(stream: DataFrame, late: str = "1 hour", by: str | None = None) -> DataFrame:
    """Sessions that end with a pause of more than ``GAP_SECONDS``, once the
    watermark has passed them. ``by`` names a column that keeps sessions
    apart; without it all rows are one sequence."""
    # a constant key would be folded away, and session windows need a key
    key = F.col(by).alias("key") if by else F.concat(F.substring("tool", 1, 0), F.lit("all")).alias("key")
    w = F.session_window("at", f"{GAP_SECONDS} seconds")
    g = stream.withWatermark("at", late).groupBy(w, key).agg(F.count("*").alias("calls"), F.min("at_unix").alias("first_at_unix"), F.max("at_unix").alias("last_at_unix"))
    return g.select("key", "first_at_unix", "last_at_unix", "calls")


def tool_rates(stream: DataFrame, size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Calls, failures and time spent of each tool by tumbling or sliding window."""
    w = F.window("at", size, slide) if slide else F.window("at", size)
    g = stream.withWatermark("at", late).groupBy(w, "tool").agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("fail"), F.sum("duration_ms").alias("duration_ms"))
    return g.select(F.unix_seconds("window.start").alias("from_unix"), F.unix_seconds("window.end").alias("to_unix"), "tool", "calls", "fail", "duration_ms")


def refresh_on_change(engine, folder: str, checkpoint: str, available_now: bool = True):
    """Indexes each project that a change notice names. Notices are JSON lines
    {"repo_path": ...}; a batch may be replayed, and indexing twice gives the
    same snapshot, so the effect is once. Returns the query."""
    notices = engine.spark.readStream.schema("repo_path string").json(folder)

    def batch(df: DataFrame, _: int):
        for r in df.select("repo_path").where("repo_path is not null").distinct().collect():
            engine.index_repository(repo_path=r["repo_path"])

    w = notices.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()
