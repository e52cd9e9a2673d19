"""CSV and Markdown imports, legacy migration, file scans."""

from __future__ import annotations

import ast
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.ids import escape_name
from loomgraph.model import EDGE_SCHEMA, NODE_SCHEMA, NOTE_SCHEMA, Graph, conform

_REQUIRED = {"nodes": ("id", "type", "name"), "edges": ("source_id", "relation", "target_id"), "notes": ("id", "node_id")}
_SCHEMAS = {"nodes": NODE_SCHEMA, "edges": EDGE_SCHEMA, "notes": NOTE_SCHEMA}


def read_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of a CSV with header; lists are parted by |.  A missing column or value is an error."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    lost = [c for c in _REQUIRED[kind] if c not in raw.columns]
    if lost:
        raise ValueError(f"{kind} CSV has no column {', '.join(lost)}")
    cols = []
    for f in _SCHEMAS[kind].fields:
        if f.name not in raw.columns:
            continue
        c = F.trim(F.coalesce(F.col(f.name), F.lit("")))
        if f.name in _REQUIRED[kind]:
            c = F.when(c == "", F.raise_error(F.lit(f"{kind} CSV: empty {f.name}")).cast("string")).otherwise(c)
        elif f.dataType.simpleString() == "array<string>":
            c = F.filter(F.transform(F.split(c, r"\|"), F.trim), lambda x: x != "")
        elif f.dataType.simpleString() != "string":
            c = c.try_cast(f.dataType)
        cols.append(c.alias(f.name))
    return conform(raw.select(*cols), _SCHEMAS[kind])


def edge_batch(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a CSV without header: source, relation, target, detail; rows that lack a part are skipped."""
    raw = spark.read.schema("source_id string, relation string, target_id string, detail string").csv(path, mode="PERMISSIVE")
    return conform(raw.where("source_id is not null and relation is not null and target_id is not null and trim(target_id) <> ''"), EDGE_SCHEMA)


def front_matter(raw: str) -> tuple[dict, str]:
    """(fields, body) of a Markdown file with a YAML block of scalars and lists."""
    m = re.match(r"^---\s*\n(.*?)\n---\s*\n?(.*)$", raw, re.S)
    if not m:
        return {}, raw
    out: dict = {}
    key = None
    for line in m[1].split("\n"):
        item = re.match(r"^\s*-\s+(.*)$", line)
        pair = re.match(r"^([A-Za-z_]+):\s*(.*)$", line)
        if item and key:
            out.setdefault(key, [])
            if isinstance(out[key], list):
                out[key].append(item[1].strip().strip("\"'"))
        elif pair:
            key, value = pair[1], pair[2].strip()
            if value.startswith("["):
                out[key] = [x.strip().strip("\"'") for x in value.strip("[]").split(",") if x.strip()]
            elif value:
                out[key] = value.strip("\"'")
    return out, m[2].strip()


def read_markdown(spark: SparkSession, path: str, notes_as_nodes: bool = False) -> Graph:
    """Nodes and notes of all *.md files below a folder."""
    import json

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for raw in pdf.value:
                f, body = front_matter(raw)
                for k in ("alias", "key_facts", "source_files", "tags"):
                    f[k] = f[k] if isinstance(f.get(k), list) else [f[k]] if f.get(k) else []
                note = str(f.get("note", "")).lower() == "true" or "node_id" in f or "note_id" in f
                for k in ("confidence", "importance"):
                    if k in f:
                        f[k] = float(f[k])
                if note and not notes_as_nodes:
                    rows.append(("note", json.dumps({**f, "id": f.get("note_id", f.get("id", "")), "body": body})))
                else:
                    facts = [*f["key_facts"], body] if notes_as_nodes and body else f["key_facts"]
                    rows.append(("node", json.dumps({**f, "key_facts": facts})))
            yield pd.DataFrame(rows, columns=["kind", "row"])

    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select("value").mapInPandas(run, "kind string, row string")
    part = lambda kind, schema: conform(rows.where(F.col("kind") == kind).select(F.from_json("row", schema).alias("r")).select("r.*"), schema).where("id <> ''")
    return Graph(part("node", NODE_SCHEMA), conform(spark.createDataFrame([], EDGE_SCHEMA), EDGE_SCHEMA), part("note", NOTE_SCHEMA))


# Fixed values of the migration: names of types and relations in older documents, in lower case
# without anything but letters and digits.
TYPE_ALIASES = {
    "feature": "Feature", "features": "Feature", "concept": "Concept", "concepts": "Concept", "interface": "Interface", "interfaces": "Interface", "iface": "Interface",
    "process": "Process", "processes": "Process", "datastore": "DataStore", "datastores": "DataStore", "data": "DataStore", "datastorage": "DataStore",
    "attribute": "Attribute", "attributes": "Attribute", "entity": "Entity", "entities": "Entity", "note": "Note", "notes": "Note", "rule": "Rule", "rules": "Rule",
    "convention": "Convention", "conventions": "Convention", "bug": "Bug", "bugs": "Bug", "decision": "Decision", "decisions": "Decision",
    "openquestion": "OpenQuestion", "question": "OpenQuestion", "questions": "OpenQuestion", "claim": "Claim", "claims": "Claim", "insight": "Insight", "insights": "Insight",
    "reference": "Reference", "references": "Reference", "ref": "Reference", "refs": "Reference", "term": "Term", "terms": "Term", "status": "Status", "statuses": "Status",
    "doubt": "Doubt", "doubts": "Doubt",
}
RELATION_ALIASES = {
    "documentedin": "DOCUMENTED_IN", "documents": "DOCUMENTED_IN", "has": "HAS", "triggers": "TRIGGERS", "affectedby": "AFFECTED_BY", "affects": "AFFECTED_BY",
    "readsfrom": "READS_FROM", "reads": "READS_FROM", "governedby": "GOVERNED_BY", "governs": "GOVERNED_BY", "dependson": "DEPENDS_ON", "depends": "DEPENDS_ON",
    "availablein": "AVAILABLE_IN", "supports": "SUPPORTS", "summarizes": "SUMMARIZES", "relatedto": "RELATED_TO", "doubtd": "RELATED_TO",
    "contradicts": "CONTRADICTS", "contradictsx": "CONTRADICTS", "createdby": "CREATED_BY", "creates": "CREATED_BY", "decidedby": "DECIDED_BY", "uses": "USES",
    "transitions": "TRANSITIONS", "available": "AVAILABLE_IN", "storedin": "STORED_IN",
}


def _known(names: dict[str, str], c: str):
    """The present name of a type or relation; unknown ones stay."""
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.regexp_replace(F.lower(c), "[^a-z0-9]", "")), F.col(c))


def migrate(graph: Graph, compat: bool = False) -> tuple[Graph, DataFrame]:
    """(graph, report): old names of types and relations mapped, edges marked ``<-`` before or behind turned, doubles dropped.

    compat also maps STORED_IN to READS_FROM, as older migrations did.
    """
    e = graph.edges
    back = F.col("relation").startswith("<-") | F.col("relation").endswith("<-")
    named = e.withColumns({"back": back, "bare": F.trim(F.regexp_replace("relation", "^<-|<-$", "")), "was": F.col("relation")})
    plain = F.when(F.col("bare") == "?", "DEPENDS_ON").otherwise(_known({**RELATION_ALIASES, **({"storedin": "READS_FROM"} if compat else {})}, "bare"))
    turn = lambda a, b: F.when(F.col("back"), F.col(b)).otherwise(F.col(a))
    out = named.select(*[{"source_id": turn("source_id", "target_id"), "target_id": turn("target_id", "source_id"), "relation": plain}.get(c, F.col(c)).alias(c) for c in e.columns], "back", "was")
    types = graph.nodes.withColumn("was", F.col("type")).withColumn("type", _known(TYPE_ALIASES, "type"))
    report = out.agg(F.count("*").alias("edges"), F.count_if(F.col("was") != F.col("relation")).alias("renamed"), F.count_if("back").alias("turned")).join(types.agg(F.count_if(F.col("was") != F.col("type")).alias("types")))
    return graph.with_(nodes=types.drop("was"), edges=out.dropDuplicates(["source_id", "relation", "target_id", "detail"]).select(*e.columns)), report


def sections(text: str, kind: str = "md") -> list[tuple[list[str], str, int, int, str]]:
    """(path, title, level, ordinal, content) of headings: # and underlined ones, = in AsciiDoc; fences are skipped."""
    out: list[list] = []
    stack: list[tuple[int, str]] = []
    seen: dict[tuple, int] = {}
    fence, body, lines = None, [], text.split("\n")

    def close() -> None:
        if out:
            out[-1][4] = "\n".join(body).strip()
        body.clear()

    def head(level: int, title: str) -> None:
        close()
        while stack and stack[-1][0] >= level:
            stack.pop()
        path = [t for _, t in stack] + [title]
        key = tuple(path)
        seen[key] = seen.get(key, 0) + 1
        stack.append((level, title))
        out.append([path, title, level, seen[key], ""])

    i = 0
    while i < len(lines):
        line = lines[i]
        mark = re.match(r"^\s*(```+|~~~+|----+$)", line) if kind == "md" or line.startswith("----") else None
        if fence:
            if line.strip().startswith(fence):
                fence = None
            body.append(line)
        elif mark and (kind == "adoc" or mark[1][0] in "`~"):
            fence = mark[1][:3]
            body.append(line)
        elif m := re.match(r"^(#{1,6})\s+(.+?)\s*#*\s*$" if kind == "md" else r"^(={1,6})\s+(.+?)\s*$", line):
            head(len(m[1]), m[2])
        elif kind == "md" and line.strip() and i + 1 < len(lines) and re.match(r"^(=+|-+)\s*$", lines[i + 1]) and not line.startswith(("-", "*", ">")):
            head(1 if lines[i + 1][0] == "=" else 2, line.strip())
            i += 1
        else:
            body.append(line)
        i += 1
    close()
    return [tuple(x) for x in out]  # type: ignore[misc]


_PATTERNS = {
    "rs": [("function", r"\bfn\s+(\w+)"), ("struct", r"\bstruct\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("trait", r"\btrait\s+(\w+)"), ("module", r"\bmod\s+(\w+)"), ("macro", r"\bmacro_rules!\s*(\w+)")],
    "java": [("class", r"\bclass\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("method", r"(?:public|private|protected|static)[\w<>\[\], ]*\s(\w+)\s*\([^;{]*\)\s*(?:throws [\w, ]+)?\{")],
    "js": [("function", r"\bfunction\s*\*?\s+(\w+)"), ("class", r"\bclass\s+(\w+)"), ("function", r"\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:function|\([^)]*\)\s*=>)")],
    "c": [("struct", r"\bstruct\s+(\w+)\s*\{"), ("class", r"\bclass\s+(\w+)"), ("function", r"^[A-Za-z_][\w\s\*&:<>,]*?\b(\w+)\s*\([^;]*\)\s*\{")],
}
LANGUAGES = {"rs": "rs", "java": "java", "py": "py", "js": "js", "mjs": "js", "jsx": "js", "c": "c", "h": "c", "cc": "c", "cpp": "c", "hpp": "c"}


def symbols(path: str, text: str) -> list[tuple[str, str]]:
    """Distinct (kind, name) of definitions: the parser's for Python, patterns for other languages."""
    lang = LANGUAGES.get(path.rsplit(".", 1)[-1].lower())
    if lang == "py":
        try:
            tree = ast.parse(text)
        except SyntaxError:
            return []
        kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
        return sorted({(kinds[type(n)], n.name) for n in ast.walk(tree) if type(n) in kinds})  # type: ignore[attr-defined]
    return sorted({(kind, name) for kind, p in _PATTERNS.get(lang or "", ()) for name in re.findall(p, text, re.M)})


SKIPPED = (".git", "node_modules", "target", "dist", "build", "out", ".cache")


def scan(spark: SparkSession, root: str, root_id: str, known_only: bool = False) -> Graph:
    """Generated nodes and edges of a file tree: directories, files, documents, sections and symbols."""
    base = root.rstrip("/")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for path, content in zip(pdf.path, pdf.content, strict=True):
                rel = path.split("://")[-1].replace("file:", "")
                rel = rel[rel.index(base) + len(base) + 1 :]
                parts = rel.split("/")
                if any(p in SKIPPED for p in parts[:-1]):
                    continue
                ext = rel.rsplit(".", 1)[-1].lower()
                doc = ext in ("md", "adoc")
                if known_only and not doc and ext not in LANGUAGES:
                    continue
                name, parent = escape_name(rel), root_id
                for i in range(1, len(parts)):
                    here = "GDIR:" + escape_name("/".join(parts[:i]))
                    rows.append((here, "GDIR", parts[i - 1], parent, "GHAS"))
                    parent = here
                own = ("GDOC:" if doc else "GFIL:") + name
                rows.append((own, own[:4], parts[-1], parent, "GHAS"))
                text = bytes(content).decode("utf-8", "replace")
                if doc:
                    ids: dict[tuple, str] = {}
                    for p, title, _, ordinal, _ in sections(text, ext):
                        sid = f"GSEC:{name}/__section__/" + "/".join(escape_name(x) for x in p) + (f":{ordinal}" if ordinal > 1 else "")
                        rows.append((sid, "GSEC", title, ids.get(tuple(p[:-1]), own), "GHAS"))
                        ids[tuple(p)] = sid
                rows += [(f"GSYM:{name}/{k}/{escape_name(s)}", "GSYM", s, own, "GDEF") for k, s in symbols(rel, text)]
            yield pd.DataFrame(rows, columns=["id", "type", "name", "parent", "relation"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    rows = files.mapInPandas(run, "id string, type string, name string, parent string, relation string").distinct()
    nodes = conform(rows.select("id", "type", "name").distinct().withColumn("provenance", F.lit("G")), NODE_SCHEMA)
    edges = conform(rows.select(F.col("parent").alias("source_id"), "relation", F.col("id").alias("target_id")).distinct(), EDGE_SCHEMA)
    return Graph(nodes, edges, conform(spark.createDataFrame([], NOTE_SCHEMA), NOTE_SCHEMA))


def catalogue(folders: list[str], names: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """(name, path) of graphs: configured names first, then files of the folders; .kg before .json."""
    out = dict(names or {})
    for folder in folders:
        for ext in (".kg", ".json"):
            for f in sorted(os.listdir(folder)) if os.path.isdir(folder) else ():
                if f.endswith(ext):
                    out.setdefault(f[: -len(ext)], os.path.join(folder, f))
    return sorted(out.items())


def resolve(name: str, folders: list[str], names: dict[str, str] | None = None) -> str:
    known = dict(catalogue(folders, names))
    if name in known:
        return known[name]
    if os.path.exists(name):
        return name
    raise FileNotFoundError(name)


def backups(spark: SparkSession, folder: str) -> DataFrame:
    """path, ts of snapshot files ``<stem>.<ext>.bck.<seconds>.gz``."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.bck.*.gz").load(folder).select("path")
    return f.withColumn("ts", F.regexp_extract("path", r"\.bck\.(\d+)\.gz$", 1).try_cast("long")).where("ts is not null")


def events(spark: SparkSession, path: str) -> DataFrame:
    """ts_ms, action, detail, graph of an event log; a malformed line is an error."""
    from pyspark.sql import types as T

    from loomgraph.sources.json_io import DOCUMENT

    schema = T.StructType([T.StructField("ts_ms", T.LongType()), T.StructField("action", T.StringType()), T.StructField("detail", T.StringType()), T.StructField("graph", DOCUMENT)])
    return spark.read.schema(schema).json(path, mode="FAILFAST")
