"""The filter, traverse and aggregate query language: parser and compiler to DataFrames.

``nodes|edges|notes key(= ~ ^ != >= <= > <)value ... sort=[-]key limit=N``,
``neighbors <id> [hops=N] [out|in|both] [limit=N]``, ``path <from> <to> [hops=N]`` and
``count <kind> [by=key] filters``.  Filters are ANDed; unknown keys match nothing; list keys match
if any element does.  Singular kinds are accepted everywhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.model import Graph

OPERATORS = ("!=", ">=", "<=", "=", "~", "^", ">", "<")
_TOKEN = re.compile(r"^([A-Za-z_]+)(!=|>=|<=|=|~|\^|>|<)(.*)$")
KINDS = {"node": "nodes", "nodes": "nodes", "edge": "edges", "edges": "edges", "note": "notes", "notes": "notes"}

#: key -> (column, kind): s text, l list of texts, n number compared by its text.
KEYS = {
    "nodes": {"id": ("id", "s"), "type": ("type", "s"), "name": ("name", "s"), "description": ("description", "s"), "domain": ("domain_area", "s"), "domain_area": ("domain_area", "s"), "provenance": ("provenance", "s"), "alias": ("alias", "l"), "fact": ("key_facts", "l"), "key_fact": ("key_facts", "l"), "source": ("source_files", "l"), "source_file": ("source_files", "l"), "confidence": ("confidence", "n"), "importance": ("importance", "n"), "created_at": ("created_at", "s"), "valid_from": ("valid_from", "s"), "valid_to": ("valid_to", "s")},
    "edges": {"source": ("source_id", "s"), "source_id": ("source_id", "s"), "relation": ("relation", "s"), "target": ("target_id", "s"), "target_id": ("target_id", "s"), "detail": ("detail", "s")},
    "notes": {"id": ("id", "s"), "node": ("node_id", "s"), "node_id": ("node_id", "s"), "body": ("body", "s"), "tag": ("tags", "l"), "tags": ("tags", "l"), "author": ("author", "s"), "provenance": ("provenance", "s"), "source": ("source_files", "l"), "created_at": ("created_at", "s")},
}
SORTS = {
    "nodes": {"name": "name", "type": "type", "id": "id", "created_at": "created_at", "importance": "importance", "updated_at": "feedback_last_ts_ms"},
    "edges": {"source": "source_id", "relation": "relation", "target": "target_id"},
    "notes": {"id": "id", "node": "node_id", "created": "created_at", "created_at": "created_at"},
}
GROUPS = {
    "nodes": {"type": "type", "domain": "domain_area", "source": "source_files", "provenance": "provenance", "importance": "importance"},
    "edges": {"relation": "relation", "source": "source_id", "target": "target_id"},
    "notes": {"node": "node_id", "author": "author", "tag": "tags"},
}


@dataclass(frozen=True)
class Filter:
    key: str
    op: str
    value: str


@dataclass(frozen=True)
class Query:
    verb: str  # select, neighbors, path, count
    kind: str = "nodes"
    filters: list[Filter] = field(default_factory=list)
    sort: str | None = None
    descending: bool = False
    limit: int | None = None
    args: dict = field(default_factory=dict)


def parse(text: str) -> Query:
    parts = text.split()
    if not parts:
        raise ValueError("empty query")
    head, rest = parts[0].lower(), parts[1:]
    if head == "neighbors":
        args: dict = {"id": "", "hops": 1, "direction": "both"}
        limit = None
        for p in rest:
            if p.startswith(("from=", "id=")):
                args["id"] = p.split("=", 1)[1]
            elif p.startswith("hops="):
                args["hops"] = int(p[5:])
            elif p in ("out", "in", "both"):
                args["direction"] = p
            elif p.startswith("limit="):
                limit = int(p[6:])
            elif not args["id"]:
                args["id"] = p
        if not args["id"]:
            raise ValueError("neighbors requires a node id")
        return Query("neighbors", limit=limit, args=args)
    if head == "path":
        ends = [p.split("=", 1)[1] if p.startswith(("from=", "to=")) else p for p in rest if not p.startswith("hops=")]
        if len(ends) < 2:
            raise ValueError("path requires two node ids")
        hops = next((int(p[5:]) for p in rest if p.startswith("hops=")), 3)
        return Query("path", args={"from": ends[0], "to": ends[1], "hops": hops})
    if head in ("count", "aggregate"):
        kind = next((KINDS[p.lower()] for p in rest if p.lower() in KINDS), "nodes")
        by = next((p[3:] for p in rest if p.startswith("by=")), None)
        return Query("count", kind, [f for f in map(_filter, rest) if f and f.key != "by"], args={"by": by})
    if head not in KINDS:
        raise ValueError(f"unknown query kind: {parts[0]}")
    sort = limit = None
    filters = []
    for p in rest:
        if p.startswith("limit="):
            limit = int(p[6:])
        elif p.startswith("sort="):
            sort = p[5:]
        elif f := _filter(p):
            filters.append(f)
        else:
            raise ValueError(f"cannot read filter: {p}")
    return Query("select", KINDS[head], filters, sort.lstrip("-") if sort else None, bool(sort and sort.startswith("-")), limit)


def _filter(token: str) -> Filter | None:
    m = _TOKEN.match(token)
    return Filter(m[1], m[2], m[3].strip('"')) if m else None


def _test(c: Column, op: str, v: str) -> Column:
    return {"=": c == v, "~": c.contains(v), "^": c.startswith(v), "!=": c != v, ">=": c >= v, "<=": c <= v, ">": c > v, "<": c < v}[op]


def predicate(f: Filter, kind: str) -> Column:
    known = KEYS[kind].get(f.key)
    if known is None:
        return F.lit(False)
    name, sort = known
    if sort == "l":
        return F.exists(F.col(name), lambda x: _test(x, f.op, f.value))
    c = X.display_number(F.col(name)) if sort == "n" else F.col(name)
    return F.coalesce(_test(c, f.op, f.value), F.lit(False))


def select(df: DataFrame, q: Query) -> DataFrame:
    """Filter, sort (ties in storage order) and limit; unknown sort keys are ignored."""
    out = df.where(X.all_of([predicate(f, q.kind) for f in q.filters]))
    key = SORTS[q.kind].get(q.sort or "")
    if key:
        out = out.orderBy(F.col(key).desc() if q.descending else F.col(key).asc(), "ord")
    elif q.limit is not None:
        out = out.orderBy("ord")
    return out.limit(q.limit) if q.limit is not None else out


def count_by(df: DataFrame, kind: str, by: str | None) -> DataFrame:
    """key, count; empty keys are (none); an unknown key groups by the kind's first one."""
    groups = GROUPS[kind]
    if kind == "notes" and by not in groups:
        key: Column = F.lit("(all)")
    else:
        name = groups.get(by or "", next(iter(groups.values())))
        c = F.col(name)
        key = F.get(c, F.lit(0)) if dict(df.dtypes)[name].startswith("array") else X.display_number(c) if name == "importance" else c
    key = F.when(F.coalesce(key, F.lit("")) == "", "(none)").otherwise(key)
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "key")


def run(graph: Graph, text: str) -> DataFrame:
    from loomgraph.operators import traverse

    q = parse(text)
    if q.verb == "neighbors":
        out = traverse.neighbors(graph, q.args["id"], q.args["hops"], q.args["direction"]).orderBy("id")
        return out.limit(q.limit) if q.limit is not None else out
    if q.verb == "path":
        return traverse.shortest_path(graph, q.args["from"], q.args["to"], q.args["hops"])
    frame = {"nodes": graph.nodes, "edges": graph.edges, "notes": graph.notes}[q.kind]
    if q.verb == "count":
        return count_by(frame.where(X.all_of([predicate(f, q.kind) for f in q.filters])), q.kind, q.args["by"])
    return select(frame, q)


def total(graph: Graph, text: str) -> DataFrame:
    """Rows that match before the limit."""
    q = parse(text)
    frame = {"nodes": graph.nodes, "edges": graph.edges, "notes": graph.notes}[q.kind]
    return frame.where(X.all_of([predicate(f, q.kind) for f in q.filters])).agg(F.count("*").alias("total"))


def valid_on(df: DataFrame, day: str) -> DataFrame:
    """Rows valid on a day: valid_from <= day and (valid_to empty or > day)."""
    return df.where((F.col("valid_from") <= day) & ((F.col("valid_to") == "") | (F.col("valid_to") > day)))


def searchable(nodes: DataFrame, types: list[str] | None = None, features: bool = True, metadata: bool = False) -> DataFrame:
    out = nodes if metadata else nodes.where("type <> '^'")
    out = out if features else out.where("type <> 'Feature'")
    return out.where(F.col("type").isin(types)) if types else out


def get_node(nodes: DataFrame, node_id: str) -> DataFrame:
    from loomgraph.functions.ids import normalize_id

    return nodes.where(F.col("id").isin(node_id, normalize_id(node_id)))


def list_nodes(nodes: DataFrame, type_: str | None = None, since: str | None = None, limit: int = 50, fields: tuple[str, ...] = ("id", "name", "type", "created_at")) -> DataFrame:
    out = nodes.where(X.all_of(([F.col("type") == type_] if type_ else []) + ([F.col("created_at") >= since] if since else [])))
    return out.orderBy(F.desc("created_at"), "id").limit(limit).select(*fields)


def list_notes(notes: DataFrame, node_id: str | None = None, limit: int = 50) -> DataFrame:
    out = notes.where(F.col("node_id") == node_id) if node_id else notes
    return out.orderBy("created_at", "id").limit(limit)
