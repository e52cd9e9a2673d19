"""Exports as frames of lines: DOT, Mermaid, GraphML, Markdown, JSON parts, HTML."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.model import Graph
from loomgraph.operators import traverse


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _lines(head: list[str], nodes: DataFrame, edges: DataFrame, tail: list[str]) -> DataFrame:
    """part, key, value; nodes and edges come with columns key and value."""
    spark = nodes.sparkSession
    fixed = lambda part, xs: spark.createDataFrame([(part, f"{i:04d}", x) for i, x in enumerate(xs)], "part int, key string, value string")
    return fixed(0, head).union(nodes.select(F.lit(1), "key", "value")).union(edges.select(F.lit(2), "key", "value")).union(fixed(3, tail)).orderBy("part", "key")


def _part(graph: Graph, focus: str | None, depth: int, types: tuple[str, ...]) -> Graph:
    return traverse.subgraph(graph, focus, depth, types) if focus or types else graph



def _edge_key() -> Column:
    return F.concat_ws(" ", "source_id", "relation", "target_id").alias("key")


def dot(graph: Graph, focus: str | None = None, depth: int = 1, types: tuple[str, ...] = ()) -> DataFrame:
    g = _part(graph, focus, depth, types)
    n = g.nodes.select(F.col("id").alias("key"), F.concat(F.lit("  "), _quoted(F.col("id")), F.lit(" [label="), _quoted(F.concat("name", F.lit("\\n("), "type", F.lit(")"))), F.lit("];")).alias("value"))
    e = g.edges.select(_edge_key(), F.concat(F.lit("  "), _quoted(F.col("source_id")), F.lit(" -> "), _quoted(F.col("target_id")), F.lit(" [label="), _quoted(F.col("relation")), F.lit("];")).alias("value"))
    return _lines(["digraph G {"], n, e, ["}"])


def mermaid(graph: Graph, focus: str | None = None, depth: int = 1, types: tuple[str, ...] = ()) -> DataFrame:
    g = _part(graph, focus, depth, types)
    ident = lambda c: F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
    n = g.nodes.select(F.col("id").alias("key"), F.concat(F.lit("  "), ident("id"), F.lit('["'), F.replace(F.col("name"), F.lit('"'), F.lit("'")), F.lit('"]')).alias("value"))
    e = g.edges.select(_edge_key(), F.concat(F.lit("  "), ident("source_id"), F.lit(" -->|"), "relation", F.lit("| "), ident("target_id")).alias("value"))
    return _lines(["graph LR"], n, e, [])


def graphml(graph: Graph, focus: str | None = None, depth: int = 1, types: tuple[str, ...] = ()) -> DataFrame:
    g = _part(graph, focus, depth, types)
    n = g.nodes.select(F.col("id").alias("key"), F.concat(F.lit('    <node id="'), _xml(F.col("id")), F.lit('"><data key="name">'), _xml(F.col("name")), F.lit('</data><data key="type">'), _xml(F.col("type")), F.lit("</data></node>")).alias("value"))
    e = g.edges.select(_edge_key(), F.concat(F.lit('    <edge source="'), _xml(F.col("source_id")), F.lit('" target="'), _xml(F.col("target_id")), F.lit('"><data key="relation">'), _xml(F.col("relation")), F.lit("</data></edge>")).alias("value"))
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '  <key id="name" for="node" attr.name="name" attr.type="string"/>', '  <key id="type" for="node" attr.name="type" attr.type="string"/>', '  <key id="relation" for="edge" attr.name="relation" attr.type="string"/>', '  <graph edgedefault="directed">']
    return _lines(head, n, e, ["  </graph>", "</graphml>"])


def markdown(graph: Graph) -> DataFrame:
    """file, text: a page a node with its relations and backlinks, and an index."""
    out = graph.edges.groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_list(F.concat(F.lit("- "), "relation", F.lit(" → [["), "target_id", F.lit("]]")))).alias("rel"))
    back = graph.edges.groupBy(F.col("target_id").alias("id")).agg(F.array_sort(F.collect_list(F.concat(F.lit("- [["), "source_id", F.lit("]] "), "relation"))).alias("back"))
    j = graph.nodes.join(out, "id", "left").join(back, "id", "left")
    block = lambda title, c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.concat(F.lit(f"\n## {title}\n\n"), F.array_join(c, "\n"), F.lit("\n"))).otherwise("")
    text = F.concat(F.lit("# "), "name", F.lit("\n\n`"), "id", F.lit("` "), "type", F.lit("\n\n"), "description", F.lit("\n"), block("Facts", F.transform("key_facts", lambda x: F.concat(F.lit("- "), x))), block("Relations", F.col("rel")), block("Backlinks", F.col("back")))
    name = F.concat(F.regexp_replace("id", "[^A-Za-z0-9_]", "_"), F.lit(".md"))
    return j.select(name.alias("file"), text.alias("text"))


def index_lines(graph: Graph) -> DataFrame:
    """key, value: the lines of the Markdown index."""
    return graph.nodes.select(F.col("id").alias("key"), F.concat(F.lit("- [["), "id", F.lit("]] "), "name").alias("value")).orderBy("key")


def split(graph: Graph) -> DataFrame:
    """file, text: one JSON document a node, edge and note."""
    one = lambda df, kind, key: df.select(F.concat(F.lit(f"{kind}/"), F.regexp_replace(key, "[^A-Za-z0-9_]", "_"), F.lit(".json")).alias("file"), F.to_json(F.struct(*df.columns)).alias("text"))
    return one(graph.nodes, "nodes", F.col("id")).union(one(graph.edges, "edges", F.concat_ws("__", "source_id", "relation", "target_id"))).union(one(graph.notes, "notes", F.col("id")))


def write_files(files: DataFrame, folder: str) -> None:
    """Writes (file, text) rows as files of a folder that all executors share."""

    def put(rows) -> None:
        import os

        for r in rows:
            path = os.path.join(folder, r["file"])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(f"{path}.{os.getpid()}", "w", encoding="utf-8") as f:
                f.write(r["text"])
            os.replace(f"{path}.{os.getpid()}", path)

    files.foreachPartition(put)


def html(graph: Graph, title: str = "Graph", focus: str | None = None, depth: int = 1) -> str:
    """A page with the part of the graph around a focus, its types, relations and hubs, as plain JSON and script.

    A page is for looking at: whole large graphs are for the other exports.
    """
    g = _part(graph, focus, depth, ())
    rows = lambda df: [r.asDict() for r in df.collect()]
    data = {
        "nodes": rows(g.nodes.select("id", "type", "name", "description").orderBy("id")), "edges": rows(g.edges.select("source_id", "relation", "target_id").orderBy("source_id", "relation", "target_id")),
        "types": [r[0] for r in g.nodes.select("type").distinct().orderBy("type").collect()], "relations": [r[0] for r in g.edges.select("relation").distinct().orderBy("relation").collect()], "hubs": rows(traverse.hubs(g)),
    }
    body = json.dumps(data, ensure_ascii=False).replace("</", "<\\/")
    script = "const d=JSON.parse(document.getElementById('data').textContent);const show=()=>{const on=new Set([...document.querySelectorAll('input:checked')].map(x=>x.value));document.getElementById('nodes').innerHTML='';for(const n of d.nodes)if(on.has(n.type)){const li=document.createElement('li');li.textContent=n.name+' ('+n.id+')';li.title=n.description;document.getElementById('nodes').append(li)}};for(const t of d.types){const l=document.createElement('label');l.innerHTML='<input type=checkbox checked>';l.firstChild.value=t;l.append(t);l.onchange=show;document.getElementById('types').append(l)}show();"
    safe = title.replace("&", "&amp;").replace("<", "&lt;")
    return f"<!doctype html><meta charset=utf-8><title>{safe}</title><h1>{safe}</h1><div id=types></div><ul id=nodes></ul><script type=application/json id=data>{body}</script><script>{script}</script>"
