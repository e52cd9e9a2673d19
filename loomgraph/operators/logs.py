"""Analytics over access and feedback logs; each works on batch frames and, where marked, on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as X


def page(log: DataFrame, limit: int = 50, **equal: str) -> DataFrame:
    """Newest lines first, with equality filters on columns."""
    for name, value in equal.items():
        log = log.where(F.col(name) == value)
    return log.orderBy(F.desc("ord")).limit(limit)


def access_stats(log: DataFrame) -> DataFrame:
    """total, finds, gets, empty_find_percent, mean_ms (also on streams, in complete mode)."""
    find = F.col("op") == "FIND"
    finds = F.count_if(find)
    return log.agg(F.count("*").alias("total"), finds.alias("finds"), F.count_if(F.col("op") == "GET").alias("gets"), F.round(F.coalesce(100.0 * F.count_if(find & (F.col("results") == 0)) / F.when(finds > 0, finds), F.lit(0.0)), 6).alias("empty_find_percent"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"))


def top_queries(log: DataFrame, n: int = 10, column: str = "query") -> DataFrame:
    return log.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def sessions(log: DataFrame, gap_minutes: int = 5, by: list[str] | None = None) -> DataFrame:
    """Rows with a session number: a new one after more than the gap.  A gap of exactly that stays."""
    start = lambda before: F.when(before.isNull() | (F.unix_micros("ts") - F.unix_micros(before) > gap_minutes * 60_000_000), 1).otherwise(0)
    if by:
        w = Window.partitionBy(*by).orderBy("ts", "ord")
        return log.withColumn("new", start(F.lag("ts").over(w))).withColumn("session", F.sum("new").over(w)).drop("new")
    # One sequence over the whole log: days run by themselves, and a row a day joins them.
    log = log.withColumn("day", F.to_date("ts"))
    days = log.groupBy("day").agg(F.max("ts").alias("last"))
    before = days.select("day", F.lag("last").over(Window.orderBy("day")).alias("eve"))
    w = Window.partitionBy("day").orderBy("ts", "ord")
    marked = log.join(F.broadcast(before), "day").withColumn("new", start(F.coalesce(F.lag("ts").over(w), F.col("eve"))))
    sums = marked.groupBy("day").agg(F.sum("new").alias("n"))
    base = sums.select("day", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return marked.join(F.broadcast(base), "day").withColumn("session", F.col("base") + F.sum("new").over(w)).drop("new", "base", "eve", "day")


def access_paths(log: DataFrame, gap_minutes: int = 5, by: list[str] | None = None) -> DataFrame:
    """Steps of sessions with more than one query; a step more than 0.3 alike the last is a refinement."""
    keys = [*(by or []), "session"]
    s = sessions(log, gap_minutes, by)
    w = Window.partitionBy(*keys).orderBy("ts", "ord")
    s = s.withColumn("n", F.count("*").over(Window.partitionBy(*keys))).where("n > 1").withColumn("step", F.row_number().over(w)).withColumn("was", F.lag("query").over(w))
    return s.select(*keys, "step", "query", F.coalesce(X.dice(F.col("was"), F.col("query")) > 0.3, F.lit(False)).alias("refines"))


def feedback_metrics(log: DataFrame) -> DataFrame:
    n = F.count("*")
    rate = lambda a: F.round(F.coalesce(F.count_if(F.col("action") == a) / F.when(n > 0, n), F.lit(0.0)), 6).alias(f"{a.lower()}_rate")
    return log.agg(n.alias("total"), *[F.count_if(F.col("action") == a).alias(a.lower()) for a in ("YES", "NO", "PICK", "NIL")], *map(rate, ("YES", "NO", "PICK", "NIL")))


def feedback_summary(log: DataFrame, top: int = 10) -> DataFrame:
    """kind, key, n: actions, most picked nodes, most frequent queries and the verdict."""
    counts = log.groupBy("action").agg(F.count("*").alias("n"))
    picked = log.where("action = 'PICK' and selected is not null").groupBy("selected").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "selected").limit(top)
    queries = log.groupBy("queries").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "queries").limit(top)
    yes, no = F.count_if(F.col("action") == "YES"), F.count_if(F.col("action") == "NO")
    verdict = log.agg(F.when(yes > 3 * no, "positive").when(no > yes, "negative").otherwise("mixed").alias("key"), F.count("*").alias("n"))
    return counts.select(F.lit("action").alias("kind"), F.col("action").alias("key"), "n").union(picked.select(F.lit("picked"), "selected", "n")).union(queries.select(F.lit("query"), "queries", "n")).union(verdict.select(F.lit("verdict"), "key", "n"))


def cost(access: DataFrame, feedback: DataFrame) -> DataFrame:
    """find_ops, feedback_events, feedback_per_1000_find_ops."""
    f = access.agg(F.count_if(F.col("op") == "FIND").alias("find_ops"))
    return f.join(feedback.agg(F.count("*").alias("feedback_events"))).select("*", F.round(F.coalesce(F.col("feedback_events") * 1000.0 / F.when(F.col("find_ops") > 0, F.col("find_ops")), F.lit(0.0)), 6).alias("feedback_per_1000_find_ops"))


def query_stats(log: DataFrame) -> DataFrame:
    """key, events, positive, negative of each query (also on streams, in update mode)."""
    key = F.lower(F.trim("queries"))
    return log.groupBy(key.alias("key")).agg(F.count("*").alias("events"), F.count_if(F.col("action").isin("YES", "PICK")).alias("positive"), F.count_if(F.col("action").isin("NO", "NIL")).alias("negative"))


def nudge(stats: DataFrame, base: int = 20) -> DataFrame:
    """key, percent: how often to ask for feedback, by the query's and the whole log's record."""
    whole = stats.agg(F.sum("events").alias("all_events"), F.sum("negative").alias("all_negative"))
    neg, pos = F.col("negative") / F.col("events"), F.col("positive") / F.col("events")
    p = F.lit(base) + F.when((F.col("events") >= 3) & (neg >= 0.5), 25).otherwise(0) - F.when((F.col("events") >= 5) & (pos >= 0.8), 20).otherwise(0) + F.when((F.col("all_events") >= 20) & (F.col("all_negative") / F.col("all_events") >= 0.4), 10).otherwise(0)
    return stats.join(whole).select("key", F.least(F.lit(100), F.greatest(F.lit(0), p)).cast("long").alias("percent"))


def sampled(log: DataFrame, percent: int) -> DataFrame:
    """Deterministic choice by uid."""
    return log.where(F.pmod(F.xxhash64("uid"), F.lit(100)) < percent)


def auto_skip(results: DataFrame, top: int = 800) -> DataFrame:
    """Finds that need no question: a sure first result, or at most one."""
    return results.where((F.col("top_score") >= top) | (F.col("total") <= 1))


def find_context(finds: DataFrame, feedback: DataFrame, minutes: int = 10) -> DataFrame:
    """Feedback with the find of its uid at most ten minutes before, and the node it means.

    finds: uid, ts, candidates; feedback: uid, ts, action, pick.  An equi-join on uid with a bound
    on time, so it also runs between two streams with watermarks.
    """
    f = finds.select("uid", F.col("ts").alias("find_ts"), "candidates")
    j = feedback.join(f, (feedback.uid == f.uid) & (feedback.ts >= F.col("find_ts")) & (feedback.ts <= F.col("find_ts") + F.expr(f"interval {minutes} minutes"))).drop(f.uid)
    chosen = F.when(F.col("action") == "PICK", F.try_element_at("candidates", F.expr("try_cast(pick as int)"))).when((F.col("action") == "YES") & (F.size("candidates") == 1), F.get("candidates", F.lit(0)))
    return j.select("uid", "ts", "action", "find_ts", chosen.alias("selected"))


def passive_picks(finds: DataFrame, gets: DataFrame) -> DataFrame:
    """graph, uid, idx: reads of a node among the candidates of the graph's last find before it."""
    both = finds.select("graph", "ts", "ord", "uid", "candidates", F.lit(None).cast("string").alias("id")).union(gets.select("graph", "ts", "ord", F.lit(None).cast("string"), F.lit(None).cast("array<string>"), "id"))
    w = Window.partitionBy("graph").orderBy("ts", "ord").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("candidates", ignorenulls=True).over(w)
    out = both.withColumn("cands", last).withColumn("find_uid", F.last("uid", ignorenulls=True).over(w)).where("id is not null")
    return out.withColumn("idx", F.array_position("cands", F.col("id"))).where("idx > 0").select("graph", F.col("find_uid").alias("uid"), "id", "idx")


def parse_feedback(lines: DataFrame) -> DataFrame:
    """uid, action, pick of lines ``uid=x YES|NO|NIL`` and ``uid=x PICK n``; others are dropped."""
    p = r"^uid=(\S+)\s+(YES|NO|NIL|PICK)(?:\s+(\d+))?\s*$"
    g = lambda i: F.regexp_extract("value", p, i)
    out = lines.select(g(1).alias("uid"), g(2).alias("action"), F.expr("nullif(regexp_extract(value, '^uid=(\\\\S+)\\\\s+PICK\\\\s+([0-9]+)\\\\s*$', 2), '')").alias("pick"))
    return out.where((F.col("uid") != "") & ((F.col("action") != "PICK") | F.col("pick").isNotNull()))
