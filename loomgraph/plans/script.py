"""A thin script language over graphs: one command a line, with quotes and ``use``."""

from __future__ import annotations

import shlex
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from loomgraph.model import EDGE_SCHEMA, NODE_SCHEMA, Graph, conform
from loomgraph.operators import kql, quality, search, setops

VERBS = {"search": "find", "create": "add", "link": "connect"}


class ScriptError(ValueError):
    def __init__(self, category: str, message: str):
        super().__init__(f"{category}: {message}")
        self.category = category


@dataclass
class Command:
    verb: str
    words: list[str]
    options: dict[str, str] = field(default_factory=dict)


def parse_line(line: str) -> Command | None:
    try:
        words = shlex.split(line, comments=True)
    except ValueError as e:
        raise ScriptError("syntax", str(e)) from e
    if not words:
        return None
    verb = words[0].lower()
    plain = [w for w in words[1:] if "=" not in w]
    options = dict(w.split("=", 1) for w in words[1:] if "=" in w)
    return Command(VERBS.get(verb, verb), plain, options)


class Session:
    """Graphs by name, and the one in use; commands return frames or change the graph."""

    def __init__(self, spark: SparkSession, graphs: dict[str, Graph]):
        self.spark, self.graphs, self.name = spark, dict(graphs), next(iter(graphs), "")

    @property
    def graph(self) -> Graph:
        if self.name not in self.graphs:
            raise ScriptError("graph", f"no graph {self.name!r}")
        return self.graphs[self.name]

    def run(self, script: str) -> list[DataFrame | None]:
        return [self.execute(c) for c in map(parse_line, script.splitlines()) if c]

    def execute(self, c: Command) -> DataFrame | None:
        g, w, o = self.graphs.get(self.name), c.words, c.options
        need = lambda n: len(w) >= n or (_ for _ in ()).throw(ScriptError("arguments", f"{c.verb} needs {n} arguments"))
        if c.verb == "use":
            need(1)
            self.name = w[0]
            return self.graph.nodes.limit(0)
        if g is None:
            raise ScriptError("graph", f"no graph {self.name!r}")
        if c.verb == "find":
            need(1)
            return search.find(g, [" ".join(w)], o.get("mode", "bm25"), int(o.get("limit", 10)))
        if c.verb == "get":
            need(1)
            return kql.get_node(g.nodes, w[0])
        if c.verb == "list":
            return kql.list_nodes(g.nodes, o.get("type"), o.get("since"), int(o.get("limit", 50)))
        if c.verb == "stats":
            return quality.stats(g)
        if c.verb == "kql":
            return kql.run(g, " ".join([*w, *(f"{k}={v}" for k, v in o.items())]))
        if c.verb == "add":
            need(3)
            row = self.spark.createDataFrame([(w[1], w[0], w[2], o.get("description", ""), "A", 0.7, 0.5, [f"OTHER {w[1]}"])], "id string, type string, name string, description string, provenance string, confidence double, importance double, source_files array<string>")
            changed, problems = setops.add_nodes(g, conform(row, NODE_SCHEMA), "atomic", "error")
            if problems.limit(1).count():
                raise ScriptError("conflict", f"cannot add {w[1]}")
            self.graphs[self.name] = changed
        elif c.verb == "modify":
            need(1)
            self.graphs[self.name] = g.with_(nodes=setops.modify_node(g.nodes, w[0], o))
        elif c.verb == "remove":
            need(1)
            self.graphs[self.name] = setops.remove_node(g, w[0])
        elif c.verb in ("connect", "disconnect"):
            need(3)
            row = conform(self.spark.createDataFrame([(w[0], w[1], w[2], o.get("detail", ""))], "source_id string, relation string, target_id string, detail string"), EDGE_SCHEMA)
            self.graphs[self.name] = setops.import_edges(g, row)[0] if c.verb == "connect" else setops.remove_edges(g, row)
        else:
            raise ScriptError("verb", f"unknown command {c.verb}")
        return None
