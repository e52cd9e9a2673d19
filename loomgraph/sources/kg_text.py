"""The line-oriented text format of graphs: reader, writer and dictionary decompression.

Blocks begin with ``@ TYPE:id`` (node) or ``! id node_id`` (note).  Node fields: N name, D
description, A alias, F fact, E created, C confidence, V importance, P provenance, S source and
``- key value``.  Edges follow their source: ``> REL target`` or ``= ~ target`` (both ways), with
fields d, i, x and ``-``.  Note fields: b, t, a, e, p, s.  # begins a comment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.ids import normalize_id_column
from loomgraph.model import EDGE_SCHEMA, META_ID, META_TYPE, NODE_SCHEMA, NOTE_SCHEMA, Graph, conform

# Fixed values of the format.
TYPE_OF = {"F": "Feature", "K": "Concept", "I": "Interface", "P": "Process", "D": "DataStore", "A": "Attribute", "Y": "Entity", "N": "Note", "R": "Rule", "C": "Convention", "B": "Bug", "Z": "Decision", "O": "OpenQuestion", "Q": "Claim", "W": "Insight", "M": "Reference", "T": "Term", "S": "Status", "L": "Doubt"}
RELATION_OF = {"D": "DOCUMENTED_IN", "H": "HAS", "T": "TRIGGERS", "A": "AFFECTED_BY", "R": "READS_FROM", "G": "GOVERNED_BY", "O": "DEPENDS_ON", "I": "AVAILABLE_IN", "S": "SUPPORTS", "U": "SUMMARIZES", "L": "RELATED_TO", "V": "CONTRADICTS", "C": "CREATED_BY"}
LIMITS = {"N": 120, "D": 200, "F": 200, "S": 200, "A": 80, "d": 200}
ORDER, EDGE_ORDER = "NDAFECVP-S", "dix-"
_CODE_OF = {v: k for k, v in TYPE_OF.items()}
_REL_CODE = {v: k for k, v in RELATION_OF.items()}


def decode(text: str) -> str:
    return re.sub(r"\\(n|r|\\)", lambda m: {"n": "\n", "r": "\r", "\\": "\\"}[m[1]], text)


def encode(text: str) -> str:
    return text.replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r")


def expand_dictionary(raw: str) -> str:
    """Lines `` `N text`` define tokens; `` `N` `` stands for them."""
    words: dict[str, str] = {}
    lines = []
    for line in raw.split("\n"):
        m = re.match(r"^`(\d+) (.*)$", line)
        if m:
            words[m[1]] = m[2]
        else:
            lines.append(line)
    return re.sub(r"`(\d+)`", lambda m: words.get(m[1], m[0]), "\n".join(lines)) if words else raw


def _in_order(key: str, rank: int, edge_rank: int, on_edge: bool, bad) -> tuple[int, int]:
    """The ranks of node and edge fields after a field, which must not come after a later one."""
    here = (EDGE_ORDER if on_edge else ORDER).index(key)
    if here < (edge_rank if on_edge else rank):
        bad(f"{key} is out of order")
    return (rank, max(edge_rank, here)) if on_edge else (max(rank, here), edge_rank)


def _number(text: str, kind: type, default):
    try:
        return kind(text.strip())
    except ValueError:
        return default


def _custom(target: dict, name: str, text: str) -> None:
    """A field of the form ``- key value``; unknown keys and values are passed over."""
    if name == "domain_area":
        target[name] = text
    elif name in ("scan", "scan_ignore_unknown"):
        word = text.strip().lower()
        target[name] = True if word in ("1", "true", "yes", "on") else False if word in ("0", "false", "no", "off") else None
    elif name == "feedback_score":
        target[name] = _number(text, float, 0.0)
    elif name in ("feedback_count", "feedback_last_ts_ms"):
        target[name] = _number(text, int, 0 if name == "feedback_count" else None)


def compress_dictionary(raw: str, least: int = 7) -> str:
    """Phrases that come back in generated nodes (types G...) as dictionary tokens, if that is shorter.

    The reader's ``expand_dictionary`` undoes it.  Works on one file, whose text is in memory anyway:
    runs of up to eight words are counted, and the one that saves most is replaced, again and again.
    """
    lines, inside, generated = raw.split("\n"), [], False
    for i, line in enumerate(lines):
        if line.startswith("@ ") or not line.strip():
            generated = bool(re.match(r"@ G\w", line))
        elif generated:
            inside.append(i)
    words: dict[str, str] = {}
    if "`" in raw:
        return raw  # the mark is in use
    while True:
        seen: dict[str, int] = {}
        for i in inside:
            parts = re.split(r"(?<= )", lines[i][2:])
            for a in range(len(parts)):
                for b in range(a + 1, min(len(parts), a + 8) + 1):
                    phrase = "".join(parts[a:b]).rstrip(" ")
                    if len(phrase) >= least and "`" not in phrase:
                        seen[phrase] = seen.get(phrase, 0) + 1
        token = f"`{len(words) + 1}`"
        gain = {p: (n - 1) * len(p) - (n + 1) * len(token) - 2 for p, n in seen.items() if n > 1}
        best = max(gain, key=lambda p: (gain[p], p), default=None)
        if best is None or gain[best] <= 0:
            break
        words[token] = best
        for i in inside:
            lines[i] = lines[i][:2] + lines[i][2:].replace(best, token)
    out = "\n".join([f"{t[:-1]} {p}" for t, p in words.items()] + lines)
    return out if words and len(out) < len(raw) else raw


def parse(raw: str, strict: bool = False) -> tuple[list[dict], list[dict], list[dict], list[str]]:
    """(nodes, edges, notes, warnings); in strict mode any bad line is an error."""
    nodes, edges, notes, warnings = [], [], [], []
    node = edge = note = None
    rank = edge_rank = -1

    def bad(no: int, why: str) -> None:
        if strict:
            raise ValueError(f"line {no}: {why}")
        warnings.append(f"line {no}: {why}")

    for no, line in enumerate(expand_dictionary(raw).split("\n"), 1):
        line = line.rstrip("\r")
        if not line.strip() or line.startswith("#"):
            continue
        key, _, value = line.partition(" ")
        value = decode(value.strip())
        if key == "@":
            kind, _, tail = value.partition(":")
            if not tail:
                bad(no, "a node needs TYPE:id")
                node = edge = note = None
                continue
            type_ = kind[1:] if kind.startswith("=") else TYPE_OF.get(kind, kind)
            node, edge, note, rank = {"id": value.lstrip("="), "type": type_, "alias": [], "key_facts": [], "source_files": [], "ord": len(nodes)}, None, None, -1
            nodes.append(node)
            edge_rank = -1
        elif key == "!":
            parts = value.split()
            if len(parts) != 2:
                bad(no, "a note needs an id and a node")
                node = edge = note = None
                continue
            node, edge, note = None, None, {"id": parts[0], "node_id": parts[1], "tags": [], "source_files": [], "ord": len(notes)}
            notes.append(note)
        elif key in (">", "=") and node is not None:
            parts = value.split()
            if len(parts) != 2:
                bad(no, "an edge needs a relation and a target")
                continue
            a, b = node["id"], parts[1]
            both = key == "="
            edge = {"source_id": min(a, b) if both else a, "relation": parts[0] if both else RELATION_OF.get(parts[0], parts[0]), "target_id": max(a, b) if both else b, "bidirectional": both, "score_components": {}, "ord": len(edges)}
            edges.append(edge)
            edge_rank = -1
        elif key == "-" and (edge if value.startswith("edge_feedback_") else node) is not None:
            name, _, rest = value.partition(" ")
            on_edge = name.startswith("edge_feedback_")
            if strict:
                rank, edge_rank = _in_order("-", rank, edge_rank, on_edge, lambda why, no=no: bad(no, why))
            target, name = (edge, name.removeprefix("edge_")) if on_edge else (node, name)
            _custom(target, name, rest)
        elif edge is not None and key in ("d", "i", "x"):
            if strict:
                rank, edge_rank = _in_order(key, rank, edge_rank, True, lambda why, no=no: bad(no, why))
            parts = value.split()
            if key == "d" and len(parts) == 2 and re.fullmatch(r"C\d+", parts[0]):
                try:
                    edge["score_components"][parts[0]] = float(parts[1])
                except ValueError:
                    raise ValueError(f"line {no}: a score component needs a number") from None
                continue
            if strict and key == "d" and len(value) > LIMITS["d"]:
                bad(no, "detail is too long")
            edge[{"d": "detail", "i": "valid_from", "x": "valid_to"}[key]] = value
        elif note is not None and key in ("b", "t", "a", "e", "p", "s"):
            if key in ("t", "s"):
                note[{"t": "tags", "s": "source_files"}[key]].append(value)
            else:
                note[{"b": "body", "a": "author", "e": "created_at", "p": "provenance"}[key]] = value
        elif node is not None and key in ORDER:
            if strict:
                if len(value) > LIMITS.get(key, 10**9):
                    bad(no, f"{key} is too long")
                if ORDER.index(key) < rank:
                    bad(no, f"{key} is out of order")
                rank = max(rank, ORDER.index(key))
            if key in "AFS":
                node[{"A": "alias", "F": "key_facts", "S": "source_files"}[key]].append(value)
            elif key in "CV":
                try:
                    node[{"C": "confidence", "V": "importance"}[key]] = float(value)
                except ValueError:
                    bad(no, f"{key} is no number")
            else:
                node[{"N": "name", "D": "description", "E": "created_at", "P": "provenance"}[key]] = value
        else:
            bad(no, "unknown line")
    return nodes, edges, notes, warnings


_ROW = "kind string, row string, path string"


def read(spark: SparkSession, path: str, strict: bool = False) -> Graph:
    """Graph files as frames: one parse a file in Arrow batches, and explicit schemas."""
    import json

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, raw in zip(pdf.path, pdf.value, strict=True):
                for kind, rows in zip(("node", "edge", "note", "warning"), parse(raw, strict), strict=True):
                    out += [(kind, json.dumps(r if isinstance(r, dict) else {"warning": r}), p) for r in rows]
            yield pd.DataFrame(out, columns=["kind", "row", "path"])

    rows = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path")).mapInPandas(run, _ROW)
    part = lambda kind, schema: conform(rows.where(F.col("kind") == kind).select(F.from_json("row", schema).alias("r")).select("r.*"), schema)
    graph = Graph(part("node", NODE_SCHEMA), part("edge", EDGE_SCHEMA), part("note", NOTE_SCHEMA), {"path": path})
    return normalize_ids(graph)


def normalize_ids(graph: Graph) -> Graph:
    """Long prefixes everywhere; ends of bidirectional edges in order."""
    n = lambda c: normalize_id_column(F.col(c))
    e = graph.edges.withColumns({"source_id": n("source_id"), "target_id": n("target_id")})
    a, b = F.least("source_id", "target_id"), F.greatest("source_id", "target_id")
    e = e.select(*[F.when(F.col("bidirectional"), {"source_id": a, "target_id": b}[c]).otherwise(F.col(c)).alias(c) if c in ("source_id", "target_id") else F.col(c) for c in e.columns])
    return Graph(graph.nodes.withColumn("id", n("id")), e, graph.notes.withColumn("node_id", n("node_id")), graph.metadata)


def with_metadata_node(graph: Graph, uuid: str) -> Graph:
    """Adds the metadata node if there is none; the uuid is the caller's, so that reads are pure."""
    spark = graph.nodes.sparkSession
    row = spark.createDataFrame([(META_ID, META_TYPE, "Graph metadata", [f"graph_uuid={uuid}", "schema_version=2"])], "id string, type string, name string, key_facts array<string>")
    missing = conform(row, NODE_SCHEMA).join(graph.nodes.select("id"), "id", "left_anti").select(*graph.nodes.columns)
    return graph.with_(nodes=graph.nodes.unionByName(missing))


def lines(graph: Graph) -> DataFrame:
    """ord, value: the file's lines in order.  Edges of unknown sources, and node validity, are not written."""
    code = lambda m, c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), c), c)
    enc = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    n = graph.nodes
    kind = code(_CODE_OF, F.col("type"))
    kind = F.when((kind == F.col("type")) & F.col("type").isin(*TYPE_OF), F.concat(F.lit("="), F.col("type"))).otherwise(kind)
    head = F.concat(F.lit("@ "), kind, F.lit(":"), F.regexp_replace("id", "^[^:]*:", ""))
    one = lambda k, c: F.when(F.col(c) != "", F.array(F.concat(F.lit(f"{k} "), enc(F.col(c))))).otherwise(F.array().cast("array<string>"))
    many = lambda k, c: F.transform(c, lambda x: F.concat(F.lit(f"{k} "), enc(x)))
    num = lambda k, c: F.when(F.col(c).isNotNull(), F.array(F.concat(F.lit(f"{k} "), F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")))).otherwise(F.array().cast("array<string>"))
    generated = F.col("type").rlike("^G.+")
    none = F.array().cast("array<string>")
    keyed = lambda k, c, when: F.when(when, F.array(F.concat(F.lit(f"- {k} "), c))).otherwise(none)
    short = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    custom = F.concat(
        keyed("domain_area", enc(F.col("domain_area")), F.col("domain_area") != ""), keyed("scan", F.col("scan").cast("string"), F.col("scan").isNotNull()), keyed("scan_ignore_unknown", F.col("scan_ignore_unknown").cast("string"), F.col("scan_ignore_unknown").isNotNull()),
        keyed("feedback_score", short(F.col("feedback_score")), F.col("feedback_score") != 0), keyed("feedback_count", F.col("feedback_count").cast("string"), F.col("feedback_count") != 0), keyed("feedback_last_ts_ms", F.col("feedback_last_ts_ms").cast("string"), F.col("feedback_last_ts_ms").isNotNull()),
    )
    by_case = lambda c: F.transform(F.array_sort(F.transform(c, lambda x: F.struct(F.lower(x).alias("k"), x.alias("v")))), lambda x: x["v"])
    tail = F.when(generated, none).otherwise(F.concat(one("E", "created_at"), num("C", "confidence"), num("V", "importance"), one("P", "provenance"), custom, many("S", by_case("source_files"))))
    block = F.concat(F.array(head), one("N", "name"), one("D", "description"), many("A", by_case("alias")), many("F", by_case("key_facts")), tail)
    parts = F.array_sort(F.transform(F.map_entries("score_components"), lambda x: F.struct(x["key"].alias("k"), F.format_string("d %s %.6f", x["key"], x["value"]).alias("v"))))
    e = graph.edges.select(F.col("source_id").alias("id"), F.struct("relation", "target_id", "bidirectional", "detail", "valid_from", "valid_to", "feedback_score", "feedback_count", "feedback_last_ts_ms", F.coalesce(parts, F.array().cast("array<struct<k:string,v:string>>")).alias("parts")).alias("e"))
    per = e.groupBy("id").agg(F.array_sort(F.collect_list("e")).alias("edges"))
    each = lambda x: F.concat(
        F.array(F.when(x["bidirectional"] & (x["relation"] == "~"), F.concat(F.lit("= ~ "), x["target_id"])).otherwise(F.concat(F.lit("> "), code(_REL_CODE, x["relation"]), F.lit(" "), x["target_id"]))),
        F.transform(x["parts"], lambda c: c["v"]),
        F.filter(F.array(
            F.when(x["detail"] != "", F.concat(F.lit("d "), enc(x["detail"]))), F.when(x["valid_from"] != "", F.concat(F.lit("i "), x["valid_from"])), F.when(x["valid_to"] != "", F.concat(F.lit("x "), x["valid_to"])),
            F.when(x["feedback_score"] != 0, F.concat(F.lit("- edge_feedback_score "), short(x["feedback_score"]))), F.when(x["feedback_count"] != 0, F.concat(F.lit("- edge_feedback_count "), x["feedback_count"].cast("string"))), F.when(x["feedback_last_ts_ms"].isNotNull(), F.concat(F.lit("- edge_feedback_last_ts_ms "), x["feedback_last_ts_ms"].cast("string"))),
        ), lambda v: v.isNotNull()),
    )
    nodes = n.join(per, "id", "left").select(F.lit(0).alias("part"), "id", F.concat(block, F.coalesce(F.flatten(F.transform("edges", each)), F.array().cast("array<string>")), F.array(F.lit(""))).alias("ls"))
    t = graph.notes
    note = F.concat(F.array(F.concat(F.lit("! "), "id", F.lit(" "), "node_id")), one("b", "body"), many("t", by_case("tags")), one("a", "author"), one("e", "created_at"), one("p", "provenance"), many("s", by_case("source_files")), F.array(F.lit("")))
    both = nodes.union(t.select(F.lit(1), "id", note))
    return both.select("part", "id", F.posexplode("ls").alias("line", "value"))


def write(graph: Graph, path: str) -> None:
    """One sorted text file (the format is one file a graph)."""
    lines(graph).orderBy("part", "id", "line").select("value").coalesce(1).write.mode("overwrite").text(path)


def save(graph: Graph, path: str, now_ms: int, keep_ms: int = 300_000) -> str:
    """Writes a graph as a new version of a folder and moves the pointer to it, so readers see the old or the new one.

    Versions are named by their time; ``current`` names the one that counts, ``previous`` the backup,
    which is replaced at most every ``keep_ms``, and ``hourly`` folders hold a gzip copy an hour.
    """
    spark = graph.nodes.sparkSession
    ordered = lines(graph).orderBy("part", "id", "line").select("value").coalesce(1)
    name = f"{path}/versions/{now_ms}"
    ordered.write.text(name)
    was = _pointer(spark, path, "current")
    if was and now_ms - int(_pointer(spark, path, "previous_at") or -keep_ms) >= keep_ms:
        _point(spark, path, "previous", was)
        _point(spark, path, "previous_at", str(now_ms))
    hour = f"{path}/hourly/{now_ms // 3_600_000}"
    spark.read.text(name).coalesce(1).write.mode("ignore").option("compression", "gzip").text(hour)
    _point(spark, path, "current", name)
    return name


def _point(spark: SparkSession, path: str, which: str, name: str) -> None:
    spark.createDataFrame([(name,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{which}")


def _pointer(spark: SparkSession, path: str, which: str) -> str | None:
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.text(f"{path}/{which}").first()
    except AnalysisException:  # not written yet
        return None
    return row["value"] if row else None


def load(spark: SparkSession, path: str, which: str = "current") -> Graph:
    """The current or previous version of a saved graph; older ones are read from ``hourly`` with ``read``."""
    name = _pointer(spark, path, which)
    if name is None:
        raise FileNotFoundError(f"no {which} version in {path}")
    return read(spark, name)

