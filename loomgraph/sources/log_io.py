"""Readers and writers of log lines; malformed lines are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_access(lines: DataFrame) -> DataFrame:
    """ts, op, query, results, duration_ms of ``ts TAB FIND|GET TAB query TAB results TAB <n>ms``."""
    p = F.split("value", "\t")
    out = lines.where(F.size(p) == 5).select(F.try_to_timestamp(p[0], F.lit("yyyy-MM-dd HH:mm:ss.SSS")).alias("ts"), p[1].alias("op"), p[2].alias("query"), F.expr("try_cast(split(value, '\t')[3] as bigint)").alias("results"), F.expr("try_cast(regexp_extract(split(value, '\t')[4], '^([0-9]+)ms$', 1) as bigint)").alias("duration_ms"))
    return out.where("ts is not null and op in ('FIND', 'GET') and results is not null and duration_ms is not null")


def parse_feedback_log(lines: DataFrame) -> DataFrame:
    """Lines of k=v parts between tabs; a part without = drops the line."""
    parts = F.split("value", "\t")
    m = F.map_from_entries(F.transform(parts, lambda x: F.struct(F.regexp_extract(x, "^([^=]*)=", 1), F.regexp_extract(x, "^[^=]*=(.*)$", 1))))
    ok = lines.where((F.trim("value") != "") & ~F.exists(parts, lambda x: ~F.contains(x, F.lit("=")))).withColumn("m", m)
    get = lambda k: F.try_element_at("m", F.lit(k))
    return ok.select(get("ts_ms").try_cast("long").alias("ts_ms"), *[get(k).alias(k) for k in ("uid", "action")], *[F.nullif(get(k), F.lit("-")).alias(k) for k in ("pick", "selected")], *[F.coalesce(get(k), F.lit("")).alias(k) for k in ("graph", "queries", "source")]).where("ts_ms is not null")


def parse_sidecar(lines: DataFrame) -> DataFrame:
    """utc, uid, kind (H, F or W), node_id, payload."""
    p = r"^(\S+) (\S+) ([HFW]) (\S+)(?: (.*))?$"
    return lines.where(F.col("value").rlike(p)).select(*[F.regexp_extract("value", p, i).alias(n) for i, n in enumerate(("utc", "uid", "kind", "node_id", "payload"), 1)])


def read_access(spark: SparkSession, path: str) -> DataFrame:
    return parse_access(spark.read.text(path))


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return parse_feedback_log(spark.read.text(path))


def access_lines(log: DataFrame) -> DataFrame:
    return log.select(F.concat_ws("\t", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), "op", F.translate("query", "\t\n", "  "), F.col("results").cast("string"), F.concat(F.col("duration_ms").cast("string"), F.lit("ms"))).alias("value"))


def feedback_lines(log: DataFrame) -> DataFrame:
    kv = lambda k: F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("-")))
    return log.select(F.concat_ws("\t", *map(kv, ("ts_ms", "uid", "action", "pick", "selected", "graph", "queries"))).alias("value"))


def append(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").text(path)
