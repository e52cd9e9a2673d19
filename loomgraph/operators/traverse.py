"""Graph traversals as frontier joins.

Each hop is one join of the frontier with the edges.  Frontiers are written to the checkpoint
folder, so that plans stay short and a lost executor costs one hop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.model import Graph
from loomgraph.session import cut_lineage

DIRECTIONS = ("out", "in", "both")


def adjacency(edges: DataFrame, direction: str = "both") -> DataFrame:
    """a, b: steps that a direction allows."""
    out = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    back = edges.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))
    return {"out": out, "in": back, "both": out.union(back)}[direction]


def bfs(graph: Graph, starts: DataFrame, hops: int | None, direction: str = "both", inside: bool = True) -> DataFrame:
    """id, depth of all nodes within ``hops`` (None: all reachable), starts at depth 0.

    starts: column id.  With ``inside``, only ids of nodes are walked to.
    """
    adj = adjacency(graph.edges, direction)
    if inside:
        adj = adj.join(graph.nodes.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    seen = starts.select("id").distinct().withColumn("depth", F.lit(0))
    frontier, depth = seen.select("id"), 0
    while hops is None or depth < hops:
        depth += 1
        step = frontier.join(adj, frontier.id == adj.a).select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti")
        step = cut_lineage(step)  # each hop reads the edges once
        if not step.take(1):
            break
        frontier = step
        seen = seen.union(step.withColumn("depth", F.lit(depth)))
    return seen


def neighbors(graph: Graph, node_id: str, hops: int = 1, direction: str = "both") -> DataFrame:
    """Nodes within hops of a node, without it."""
    start = graph.nodes.where(F.col("id") == node_id).select("id")
    reached = bfs(graph, start, hops, direction).where((F.col("depth") > 0) & (F.col("id") != node_id))
    return graph.nodes.join(reached.select("id"), "id", "left_semi")


def layers(graph: Graph, node_id: str, caps: tuple[int, ...] = (6, 4, 3)) -> DataFrame:
    """id, depth of the neighbours shown around a node: the most important of each layer."""
    reached = bfs(graph, graph.nodes.where(F.col("id") == node_id).select("id"), len(caps) - 1).where("depth > 0")
    w = Window.partitionBy("depth").orderBy(F.desc("importance"), "id")
    ranked = reached.join(graph.nodes.select("id", "importance"), "id").withColumn("r", F.row_number().over(w))
    cap = F.element_at(F.array(*map(F.lit, caps)), F.col("depth"))
    return ranked.where(F.col("r") <= cap).select("id", "depth", "r")


def shortest_path(graph: Graph, start: str, end: str, hops: int = 3, compat: bool = False) -> DataFrame:
    """step, id of a shortest undirected path of at most ``hops`` edges (compat: hops nodes).

    Among paths of equal length the one whose ids come first is taken.  No path gives no rows.
    """
    hops = hops - 1 if compat else hops
    adj = adjacency(graph.edges).join(graph.nodes.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    frontier = graph.nodes.where(F.col("id") == start).select("id", F.array("id").alias("path"))
    found, seen = frontier.where(F.col("id") == end), frontier.select("id")
    for _ in range(hops):
        if found.take(1):
            break
        step = frontier.join(adj, frontier.id == adj.a).select(F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path"))
        step = cut_lineage(step.join(seen, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")))
        if not step.take(1):
            break
        seen, frontier = seen.union(step.select("id")), step
        found = step.where(F.col("id") == end)
    return found.limit(1).select(F.posexplode("path").alias("step", "id"))


def subgraph(graph: Graph, focus: str | None = None, depth: int = 1, types: tuple[str, ...] = ()) -> Graph:
    """Nodes around a focus (or all), of the types (the focus stays), and the edges among them."""
    nodes = graph.nodes
    if focus:
        nodes = nodes.join(bfs(graph, nodes.where(F.col("id") == focus).select("id"), depth).select("id"), "id", "left_semi")
    if types:
        keep = F.lower("type").isin([t.lower() for t in types])
        nodes = nodes.where(keep | (F.col("id") == focus) if focus else keep)
    return graph.with_(nodes=nodes, edges=induced(graph.edges, nodes))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are among the nodes."""
    ids = nodes.select("id")
    out = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    return out.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def degree(edges: DataFrame) -> DataFrame:
    """id, degree: incident edges, a loop twice."""
    ends = edges.select(F.col("source_id").alias("id")).union(edges.select(F.col("target_id").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def hubs(graph: Graph, n: int = 10) -> DataFrame:
    return graph.nodes.select("id", "ord").join(degree(graph.edges), "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"), "ord").orderBy(F.desc("degree"), "ord").limit(n).drop("ord")


def relation_summary(edges: DataFrame, top: int = 3) -> DataFrame:
    """id, direction, relation, n: the first relations of each node and direction."""
    out = edges.select(F.col("source_id").alias("id"), F.lit("out").alias("direction"), "relation")
    both = out.union(edges.select(F.col("target_id").alias("id"), F.lit("in").alias("direction"), "relation"))
    counted = both.groupBy("id", "direction", "relation").agg(F.count("*").alias("n"))
    w = Window.partitionBy("id", "direction").orderBy("relation")
    return counted.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).drop("r")


def generated_subtree(graph: Graph, root: str) -> DataFrame:
    """Generated nodes reachable from a root along containment edges."""
    inside = graph.with_(nodes=graph.nodes.where(F.col("type").rlike("^G.+") | (F.col("id") == root)), edges=graph.edges.where(F.col("relation").isin("GHAS", "GDEF", "HAS", "GDEFINES")))
    reached = bfs(inside, inside.nodes.where(F.col("id") == root).select("id"), None, "out")
    return graph.nodes.join(reached.where("depth > 0").select("id"), "id", "left_semi")


def incident(graph: Graph, node_id: str, query: tuple[str, ...]) -> DataFrame:
    """Edges of a node, by the weight of the query tokens that the other end and the edge hold."""
    from loomgraph.functions import text as X

    e = graph.edges.where((F.col("source_id") == node_id) | (F.col("target_id") == node_id))
    e = e.withColumn("other", F.when(F.col("source_id") == node_id, F.col("target_id")).otherwise(F.col("source_id")))
    q = F.array(*map(F.lit, query)) if query else F.array().cast("array<string>")
    hits = lambda c: F.size(F.array_intersect(X.tokens(c), q))
    j = e.join(graph.nodes.select(F.col("id").alias("other"), "name", "alias", "description"), "other")
    score = hits(F.col("other")) * 6 + hits(F.col("name")) * 5 + hits(F.array_join("alias", " ")) * 4 + (hits(F.col("description")) + hits(F.col("relation")) + hits(F.col("detail"))) * 2
    return j.select("source_id", "relation", "target_id", score.cast("long").alias("relevance")).orderBy(F.desc("relevance"), "relation", "source_id", "target_id")


def clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """cluster, size, relevance and members of materialised clusters."""
    members = edges.where((F.col("relation") == "HAS") & F.col("source_id").startswith("@:cluster_")).select(F.col("source_id").alias("cluster"), F.col("target_id").alias("id"), F.expr("try_cast(detail as double)").alias("strength"))
    out = members.groupBy("cluster").agg(F.count("*").alias("size"), F.avg("strength").alias("relevance"), F.array_sort(F.collect_list("id")).alias("members"))
    return out.join(nodes.where("type = '@'").select(F.col("id").alias("cluster")), "cluster", "left_semi").orderBy(F.desc("relevance"), F.desc("size"), "cluster")
