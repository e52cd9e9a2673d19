"""Differences, merges and mutations of graphs; frames in, frames out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.model import EDGE_RULES, META_TYPE, NODE_TYPES, RELATIONS, SIMILAR, Graph
from loomgraph.session import cut_lineage

KEYS = {"nodes": ["id"], "edges": ["source_id", "relation", "target_id"], "notes": ["id"]}
_LOCAL = {"ord"}


def _payload(df: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in df.columns if c not in keys and c not in _LOCAL]


def _text(c: Column, kind: str) -> Column:
    return F.to_json(F.struct(c.alias("v"))) if kind.startswith(("array", "map", "struct")) else c.cast("string")


def diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status: added, removed or changed rows from left to right."""
    cols = _payload(left, keys)
    mark = lambda df, n: df.select(*keys, F.struct(*cols).alias(n))
    same = F.to_json("l").eqNullSafe(F.to_json("r"))
    both = mark(left, "l").join(mark(right, "r"), keys, "full")
    status = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed").when(~same, "changed")
    return both.select(*keys, status.alias("status")).where("status is not null")


def field_diff(left: DataFrame, right: DataFrame, keys: list[str], width: int = 160) -> DataFrame:
    """keys, path, old, new of each field that differs in rows of both sides; lists compare whole as path[]."""
    kinds = dict(left.dtypes)
    cols = _payload(left, keys)
    r = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in cols])
    j = left.join(r, keys)
    cell = lambda c: F.struct(F.lit(f"{c}[]" if kinds[c].startswith("array") else c).alias("path"), F.substring(_text(F.col(c), kinds[c]), 1, width).alias("old"), F.substring(_text(F.col(f"r_{c}"), kinds[c]), 1, width).alias("new"), (~_text(F.col(c), kinds[c]).eqNullSafe(_text(F.col(f"r_{c}"), kinds[c]))).alias("differs"))
    return j.select(*keys, F.explode(F.array(*map(cell, cols))).alias("x")).where("x.differs").select(*keys, "x.path", "x.old", "x.new")


def merge(target: DataFrame, source: DataFrame, keys: list[str], prefer: str = "new") -> DataFrame:
    """Upsert by key: the source's row wins with "new", the target's with "old"."""
    first, second = (source, target) if prefer == "new" else (target, source)
    return first.unionByName(second.join(first.select(*keys), keys, "left_anti").select(*first.columns))


def merge_graphs(target: Graph, source: Graph, prefer: str = "new", metadata: bool = False) -> Graph:
    """Merges all three frames; metadata nodes of the source stay out unless asked for."""
    nodes = source.nodes if metadata else source.nodes.where(F.col("type") != META_TYPE)
    return Graph(merge(target.nodes, nodes, KEYS["nodes"], prefer), merge(target.edges, source.edges, KEYS["edges"], prefer), merge(target.notes, source.notes, KEYS["notes"], prefer), target.metadata)


def merge_summary(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """status, n: added, conflict (both sides differ), existing (both sides agree); a row counts once."""
    found = diff(target, source, keys).where("status <> 'removed'")
    status = found.select(F.when(F.col("status") == "added", "added").otherwise("conflict").alias("status"))
    same = source.join(target.select(*keys), keys, "left_semi").join(found.select(*keys), keys, "left_anti").select(F.lit("existing").alias("status"))
    return status.union(same).groupBy("status").agg(F.count("*").alias("n"))


def merge_conflicts(target: DataFrame, source: DataFrame, keys: list[str], prefer: str = "new") -> DataFrame:
    """keys, path, kept, dropped of every field in which both sides differ, whichever side wins."""
    fields = field_diff(target, source, keys)
    kept, dropped = ("new", "old") if prefer == "new" else ("old", "new")
    return fields.select(*keys, "path", F.col(kept).alias("kept"), F.col(dropped).alias("dropped"))


def import_edges(graph: Graph, edges: DataFrame, prefer: str = "new") -> tuple[Graph, DataFrame]:
    """Upserts edges whose ends exist; the second value holds the skipped ones."""
    ids = graph.nodes.select("id")
    ok = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(*edges.columns)
    skipped = edges.join(ok.select(*KEYS["edges"]), KEYS["edges"], "left_anti")
    return graph.with_(edges=merge(graph.edges, ok, KEYS["edges"], prefer)), skipped


def add_nodes(graph: Graph, rows: DataFrame, mode: str = "best_effort", on_conflict: str = "skip", dry_run: bool = False) -> tuple[Graph, DataFrame]:
    """(graph, problems): batch addition with the defaults of single additions.

    best_effort keeps the valid rows; atomic adds all or nothing; dry_run only reports.
    """
    filled = with_defaults(rows)
    known = filled.join(graph.nodes.select("id"), "id", "left_semi").select("id", F.lit("exists").alias("problem"))
    w = Window.partitionBy("id")
    twice = filled.withColumn("n", F.count("*").over(w)).where("n > 1").select("id", F.lit("repeated").alias("problem")).distinct()
    bad = filled.where((F.trim("name") == "") | ~F.col("importance").between(0, 1) | ~F.coalesce(F.col("confidence").between(0, 1), F.lit(True)) | F.col("type").rlike("^G.+")).select("id", F.lit("invalid").alias("problem"))
    problems = cut_lineage(twice.union(bad) if on_conflict == "skip" else known.union(twice).union(bad))
    if dry_run or (mode == "atomic" and problems.limit(1).count()):
        return graph, problems
    fresh = filled.join(problems.select("id"), "id", "left_anti").join(graph.nodes.select("id"), "id", "left_anti").select(*graph.nodes.columns)
    return graph.with_(nodes=graph.nodes.unionByName(fresh)), problems


def with_defaults(rows: DataFrame) -> DataFrame:
    """Defaults of an added node: description its name, domain its type, provenance U, confidence 0.8."""
    from loomgraph.model import NODE_SCHEMA, conform

    out = conform(rows, NODE_SCHEMA)
    return out.select(*[
        {"description": F.when(F.col("description") == "", F.col("name")).otherwise(F.col("description")), "domain_area": F.when(F.col("domain_area") == "", F.lower("type")).otherwise(F.col("domain_area")), "provenance": F.when(F.col("provenance") == "", "U").otherwise(F.col("provenance")), "confidence": F.coalesce("confidence", F.lit(0.8)), "source_files": F.when(F.size("source_files") == 0, F.array(F.lit("DOC graph node add"))).otherwise(F.col("source_files"))}.get(c, F.col(c)).alias(c)
        for c in out.columns
    ])


def modify_node(nodes: DataFrame, node_id: str, scalars: dict, lists: dict | None = None) -> DataFrame:
    """Overwrites scalars and appends to lists what they do not hold."""
    hit = F.col("id") == node_id
    return nodes.select(*[
        F.when(hit, F.lit(scalars[c]).cast(k)).otherwise(F.col(c)).alias(c) if c in scalars
        else F.when(hit, F.array_union(c, F.array(*map(F.lit, lists[c])))).otherwise(F.col(c)).alias(c) if lists and c in lists
        else F.col(c)
        for c, k in nodes.dtypes
    ])


def rename_node(graph: Graph, old: str, new: str) -> Graph:
    swap = lambda c: F.when(F.col(c) == old, F.lit(new)).otherwise(F.col(c))
    return Graph(graph.nodes.withColumn("id", swap("id")), graph.edges.withColumns({"source_id": swap("source_id"), "target_id": swap("target_id")}), graph.notes.withColumn("node_id", swap("node_id")), graph.metadata)


def remove_node(graph: Graph, node_id: str) -> Graph:
    """Incident edges go; notes stay."""
    return graph.with_(nodes=graph.nodes.where(F.col("id") != node_id), edges=graph.edges.where((F.col("source_id") != node_id) & (F.col("target_id") != node_id)))


def orphan_notes(graph: Graph) -> DataFrame:
    return graph.notes.join(graph.nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti").select("id", "node_id")


def edge_problems(graph: Graph, rows: DataFrame) -> DataFrame:
    """source_id, relation, target_id, problem of new edges, the first that holds: as additions check it.

    generated (relations of scans), relation (unknown), similarity (``~`` goes both ways and others do
    not), rule (the ends' types do not fit), source and target (no such node), exists, repeated.
    """
    t = graph.nodes.select("id", "type").dropDuplicates(["id"])
    e = rows.select(*KEYS["edges"], *(F.col(c) if c in rows.columns else F.lit(False).alias(c) for c in ("bidirectional",)))
    j = e.join(t.select(F.col("id").alias("source_id"), F.col("type").alias("st")), "source_id", "left").join(t.select(F.col("id").alias("target_id"), F.col("type").alias("tt")), "target_id", "left")
    known = graph.edges.select(*KEYS["edges"]).distinct().withColumn("known", F.lit(True))
    j = j.join(known, KEYS["edges"], "left").withColumn("times", F.count("*").over(Window.partitionBy(*KEYS["edges"])))
    allowed = lambda k: F.try_element_at(F.create_map(*[x for r, ends in EDGE_RULES.items() for x in (F.lit(r), F.array(*map(F.lit, ends[k])))]), F.col("relation"))
    built = F.col("st").isin(NODE_TYPES) & F.col("tt").isin(NODE_TYPES)
    fits = F.coalesce(F.array_contains(allowed(0), F.col("st")), F.lit(True)) & F.coalesce(F.array_contains(allowed(1), F.col("tt")), F.lit(True))
    problem = (
        F.when(F.col("relation").rlike("^G[A-Z_]+") & ~F.col("relation").isin(RELATIONS), "generated").when(~F.col("relation").isin([*RELATIONS, SIMILAR]), "relation")
        .when((F.col("relation") == SIMILAR) != F.coalesce("bidirectional", F.lit(False)), "similarity").when(built & ~fits, "rule")
        .when(F.col("st").isNull(), "source").when(F.col("tt").isNull(), "target").when(F.col("known"), "exists").when(F.col("times") > 1, "repeated")
    )
    return j.select(*KEYS["edges"], problem.alias("problem")).where("problem is not null").distinct()


def add_edges(graph: Graph, rows: DataFrame, mode: str = "best_effort") -> tuple[Graph, DataFrame]:
    """(graph, problems): edges that pass are added; atomic adds all or none."""
    from loomgraph.model import EDGE_SCHEMA, conform

    problems = edge_problems(graph, rows)
    if mode == "atomic" and problems.limit(1).count():
        return graph, problems
    fresh = conform(rows, EDGE_SCHEMA).join(problems.select(*KEYS["edges"]), KEYS["edges"], "left_anti").select(*graph.edges.columns)
    return graph.with_(edges=graph.edges.unionByName(fresh)), problems


def add_notes(graph: Graph, rows: DataFrame) -> tuple[Graph, DataFrame]:
    """(graph, problems): notes with a new id, a known node and a body are added."""
    from loomgraph.model import NOTE_SCHEMA, conform

    new = conform(rows, NOTE_SCHEMA)
    j = new.join(graph.nodes.select(F.col("id").alias("node_id"), F.lit(True).alias("on")).distinct(), "node_id", "left").join(graph.notes.select("id", F.lit(True).alias("known")).distinct(), "id", "left")
    j = j.withColumn("times", F.count("*").over(Window.partitionBy("id")))
    why = F.when(F.trim("id") == "", "no id").when(F.trim("body") == "", "empty").when(F.col("on").isNull(), "unknown node").when(F.col("known"), "exists").when(F.col("times") > 1, "repeated")
    j = j.withColumn("problem", why)
    return graph.with_(notes=graph.notes.unionByName(j.where("problem is null").select(*graph.notes.columns))), j.where("problem is not null").select("id", "problem").distinct()


def remove_note(graph: Graph, note_id: str) -> Graph:
    return graph.with_(notes=graph.notes.where(F.col("id") != note_id))


def remove_edges(graph: Graph, rows: DataFrame) -> Graph:
    return graph.with_(edges=graph.edges.join(rows.select(*KEYS["edges"]), KEYS["edges"], "left_anti").select(*graph.edges.columns))


def sync_subtree(graph: Graph, seen: Graph, stale: DataFrame) -> Graph:
    """Upserts generated nodes and edges that a scan saw; drops stale ids with their notes and edges."""
    gone = stale.select("id").join(seen.nodes.select("id"), "id", "left_anti")
    end = lambda e, c: e.join(gone.withColumnRenamed("id", c), c, "left_anti").select(*graph.edges.columns)
    kept = Graph(graph.nodes.join(gone, "id", "left_anti").select(*graph.nodes.columns), end(end(graph.edges, "source_id"), "target_id"), graph.notes.join(gone.withColumnRenamed("id", "node_id"), "node_id", "left_anti").select(*graph.notes.columns))
    return merge_graphs(kept, seen)


def apply_feedback(nodes: DataFrame, feedback: DataFrame) -> DataFrame:
    """YES +1, NO -1, PICK +2 to the selected node's score; counts and the last time follow."""
    delta = F.when(F.col("action") == "YES", 1.0).when(F.col("action") == "NO", -1.0).when(F.col("action") == "PICK", 2.0)
    per = feedback.where("selected is not null").withColumn("delta", delta).where("delta is not null").groupBy(F.col("selected").alias("id")).agg(F.sum("delta").alias("d"), F.count("*").alias("c"), F.max("ts_ms").alias("t"))
    j = nodes.join(per, "id", "left")
    return j.withColumns({"feedback_score": F.col("feedback_score") + F.coalesce("d", F.lit(0.0)), "feedback_count": F.col("feedback_count") + F.coalesce("c", F.lit(0).cast("long")), "feedback_last_ts_ms": F.coalesce(F.greatest("t", "feedback_last_ts_ms"), "t", "feedback_last_ts_ms")}).select(*nodes.columns)


def dedup_list(c: Column) -> Column:
    """Sorted without regard to case, one of each, the first spelling in byte order."""
    ordered = F.array_sort(F.transform(c, lambda x: F.struct(F.lower(x).alias("k"), x.alias("v"))))
    return F.transform(F.filter(ordered, lambda x, i: (i == 0) | (F.get(ordered, i - 1)["k"] != x["k"])), lambda x: x["v"])


def graph_diff(left: Graph, right: Graph) -> DataFrame:
    """kind, key, status over all three frames."""
    parts = []
    for kind, keys in KEYS.items():
        d = diff(getattr(left, kind), getattr(right, kind), keys)
        parts.append(d.select(F.lit(kind).alias("kind"), F.concat_ws(" ", *keys).alias("key"), "status"))
    return reduce(DataFrame.union, parts)
