"""Streams of access and feedback logs.

The batch functions of ``operators.logs`` that need no order run on streams as they are; sessions
and find contexts use event time with watermarks, so state is bounded and late lines are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import logs
from loomgraph.sources import log_io


def access_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Access-log lines of new files in a folder."""
    return log_io.parse_access(spark.readStream.text(folder))


def feedback_stream(spark: SparkSession, folder: str) -> DataFrame:
    return log_io.parse_feedback_log(spark.readStream.text(folder))


def sessions(stream: DataFrame, gap: str = "5 minutes", late: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """start, end, queries of sessions; a step of exactly the gap stays in the session.

    Sessions of a stream need a key besides their window: columns ``by``, or one key for all lines.
    """
    w = F.session_window("ts", gap)
    keys = by or ["stream_key"]
    if not by:  # not a literal: a constant key would be folded away
        stream = stream.withColumn("stream_key", F.when(F.col("ts").isNotNull(), "all"))
    out = stream.withWatermark("ts", late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("ts", "query"))).alias("steps"))
    return out.select(*(by or []), F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", F.transform("steps", lambda s: s["query"]).alias("queries"))


def windowed_access(stream: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Finds, reads and empty finds by window."""
    find = F.col("op") == "FIND"
    out = stream.withWatermark("ts", late).groupBy(F.window("ts", window)).agg(F.count_if(find).alias("finds"), F.count_if(~find).alias("gets"), F.count_if(find & (F.col("results") == 0)).alias("empty"))
    return out.select(F.col("window.start").alias("start"), "finds", "gets", "empty")


def find_context(finds: DataFrame, feedback: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Stream-stream interval join of feedback with its find."""
    return logs.find_context(finds.withWatermark("ts", late), feedback.withWatermark("ts", late))


def query_feedback(stream: DataFrame) -> DataFrame:
    """Running statistics by query, for update mode."""
    return logs.query_stats(stream)


def idempotent_append(stream: DataFrame, path: str, keys: list[str], checkpoint: str):
    """Appends lines once each, whatever batches are repeated: a batch drops keys that the table holds."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        try:
            fresh = fresh.join(spark.read.schema(batch.schema).parquet(path).select(*keys), keys, "left_anti")
        except Exception as e:  # the table does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.select(*batch.columns).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
