"""Snapshots: as-of, history, timeline and differences over time.

An event frame has ts_ms, ord (place in the log), action, detail and a graph; here snapshots are
rows of nodes and edges with a version column, so one state is a filter and not a nested value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import setops


def latest(events: DataFrame, ts_ms: int) -> DataFrame:
    """The last event, in order of the log, at or before a time (one row or none)."""
    return events.where(F.col("ts_ms") <= ts_ms).agg(F.max_by(F.struct(*events.columns), "ord").alias("e")).where("e is not null").select("e.*")


def as_of(versions: DataFrame, keys: list[str], ts_ms: int) -> DataFrame:
    """State of rows at a time, from a change log with ts_ms, ord and deleted: the last change of each key."""
    last = versions.where(F.col("ts_ms") <= ts_ms).groupBy(*keys).agg(F.max_by(F.struct(*[c for c in versions.columns if c not in keys]), F.struct("ts_ms", "ord")).alias("s"))
    return last.select(*keys, "s.*").where("not deleted").drop("deleted")


def history(backups: DataFrame, limit: int = 20) -> DataFrame:
    return backups.orderBy(F.desc("ts"), "path").limit(limit)


def timeline(events: DataFrame, since: int | None = None, until: int | None = None, limit: int | None = None) -> DataFrame:
    """Events of a span, newest first."""
    out = events
    out = out.where(F.col("ts_ms") >= since) if since is not None else out
    out = out.where(F.col("ts_ms") <= until) if until is not None else out
    out = out.orderBy(F.desc("ts_ms"), F.desc("ord"))
    return out.limit(limit) if limit else out


def diff_as_of(versions: DataFrame, keys: list[str], before: int, after: int) -> DataFrame:
    return setops.diff(as_of(versions, keys, before).drop("ts_ms"), as_of(versions, keys, after).drop("ts_ms"), keys)


def append_snapshot(graph, path: str, ts_ms: int, action: str, detail: str = "") -> None:
    """Adds one event line with the full graph to a JSON-lines event log."""
    from loomgraph.sources.json_io import to_document

    doc = to_document(graph)
    doc.select(F.lit(ts_ms).cast("long").alias("ts_ms"), F.lit(action).alias("action"), F.lit(detail).alias("detail"), F.struct(*doc.columns).alias("graph")).write.mode("append").json(path)
