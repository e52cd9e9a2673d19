"""Graphs as JSON documents, Parquet folders and generated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.model import EDGE_SCHEMA, NODE_SCHEMA, NOTE_SCHEMA, VECTOR_SCHEMA, Graph, conform

_NODE_TOP, _EDGE_TOP = ("id", "type", "name", "source_files"), ("source_id", "relation", "target_id")


def _nested(schema: T.StructType, top: tuple[str, ...]) -> T.StructType:
    inner = T.StructType([f for f in schema.fields if f.name not in (*top, "ord")])
    return T.StructType([*(f for f in schema.fields if f.name in top), T.StructField("properties", inner)])


DOCUMENT = T.StructType([
    T.StructField("metadata", T.StructType([T.StructField("name", T.StringType()), T.StructField("version", T.StringType()), T.StructField("description", T.StringType()), T.StructField("schema_version", T.IntegerType())])),
    T.StructField("nodes", T.ArrayType(_nested(NODE_SCHEMA, _NODE_TOP))), T.StructField("edges", T.ArrayType(_nested(EDGE_SCHEMA, _EDGE_TOP))),
    T.StructField("notes", T.ArrayType(T.StructType([f for f in NOTE_SCHEMA.fields if f.name != "ord"]))),
])


def from_document(doc: DataFrame) -> Graph:
    """Frames of one document row; ord is the place in its array, missing fields get defaults."""
    part = lambda name: doc.select(F.posexplode(name).alias("ord", "x"))
    nodes = part("nodes").select(*[f"x.{c}" for c in _NODE_TOP], "x.properties.*", "ord")
    edges = part("edges").select(*[f"x.{c}" for c in _EDGE_TOP], "x.properties.*", "ord")
    return Graph(conform(nodes, NODE_SCHEMA), conform(edges, EDGE_SCHEMA), conform(part("notes").select("x.*", "ord"), NOTE_SCHEMA))


def read(spark: SparkSession, path: str) -> Graph:
    from loomgraph.sources.kg_text import normalize_ids

    return normalize_ids(from_document(spark.read.schema(DOCUMENT).json(path, multiLine=True)))


def to_document(graph: Graph) -> DataFrame:
    """One row of the document schema.  A document is one value by its format; tables go to Parquet."""
    def shape(df: DataFrame, schema: T.StructType, top: tuple[str, ...]) -> DataFrame:
        inner = [f.name for f in schema.fields if f.name not in (*top, "ord")]
        return df.select("ord", F.struct(*top, *([F.struct(*inner).alias("properties")] if inner and top else inner)).alias("x"))

    gather = lambda df, name: df.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "x"))), lambda s: s["x"]).alias(name))
    edge_columns = EDGE_SCHEMA.fieldNames()
    edges = graph.edges.select(*edge_columns).withColumn("score_components", F.col("score_components"))
    key = lambda df, k: df.withColumn("ord", F.concat_ws(" ", *k))  # noqa: E731  maps cannot be ordered, keys can
    n = gather(shape(key(graph.nodes, ["id"]), NODE_SCHEMA, _NODE_TOP), "nodes")
    e = shape(key(edges, ["source_id", "relation", "target_id"]), EDGE_SCHEMA, _EDGE_TOP).groupBy().agg(F.map_values(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("ord", F.to_json("x").alias("x")))))).alias("edges"))
    e = e.select(F.transform("edges", lambda s: F.from_json(s, DOCUMENT["edges"].dataType.elementType)).alias("edges"))
    t = gather(graph.notes.select(F.col("id").alias("ord"), F.struct(*[f.name for f in NOTE_SCHEMA.fields if f.name != "ord"]).alias("x")), "notes")
    meta = F.struct(F.lit(graph.metadata.get("name", "graph")).alias("name"), F.lit("1.0").alias("version"), F.lit(graph.metadata.get("description", "")).alias("description"), F.lit(2).alias("schema_version"))
    return n.join(e).join(t).select(meta.alias("metadata"), "nodes", "edges", "notes")


def write(graph: Graph, path: str) -> None:
    to_document(graph).coalesce(1).write.mode("overwrite").json(path)


def write_tables(graph: Graph, path: str) -> None:
    """The store for large graphs: nodes by type, edges by relation, notes."""
    graph.nodes.write.mode("overwrite").partitionBy("type").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").partitionBy("relation").parquet(f"{path}/edges")
    graph.notes.write.mode("overwrite").parquet(f"{path}/notes")


def read_tables(spark: SparkSession, path: str) -> Graph:
    read_ = lambda name, schema: conform(spark.read.schema(schema).parquet(f"{path}/{name}"), schema)
    return Graph(read_("nodes", NODE_SCHEMA), read_("edges", EDGE_SCHEMA), read_("notes", NOTE_SCHEMA))


def read_vectors(spark: SparkSession, path: str, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors, problems) of {"id", "vector"} lines: empty, other dimension, unknown node."""
    raw = spark.read.schema("id string, vector array<float>").json(path)
    dim = raw.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).select("d")
    j = raw.join(F.broadcast(dim)).join(nodes.select("id", F.lit(True).alias("known")), "id", "left")
    why = F.when(F.coalesce(F.size("vector"), F.lit(0)) <= 0, "empty").when(F.size("vector") != F.col("d"), "dimension").when(F.col("known").isNull(), "unknown node")
    j = j.withColumn("problem", why)
    return conform(j.where("problem is null").select(F.col("id").alias("node_id"), "vector"), VECTOR_SCHEMA), j.where("problem is not null").select("id", "problem")


def write_vectors(vectors: DataFrame, path: str) -> None:
    """The vector store as lines of {"id", "vector"}, which ``read_vectors`` reads."""
    vectors.select(F.col("node_id").alias("id"), "vector").write.mode("overwrite").json(path)


def export_as_of(nodes: DataFrame, edges: DataFrame, notes: DataFrame, ts_ms: int, path: str) -> Graph:
    """Writes the graph as it was at a time, from versioned rows (ts_ms, ord, deleted besides the schemas), and returns it."""
    from loomgraph.operators import setops, temporal

    at = lambda df, kind, schema: conform(temporal.as_of(df, setops.KEYS[kind], ts_ms), schema)
    graph = Graph(at(nodes, "nodes", NODE_SCHEMA), at(edges, "edges", EDGE_SCHEMA), at(notes, "notes", NOTE_SCHEMA), {"as_of": ts_ms})
    write(graph, path)
    return graph


def synthetic(spark: SparkSession, n: int, k: int = 5) -> Graph:
    """A deterministic graph of n nodes with k edges each, for benchmarks."""
    types = F.array(*map(F.lit, ["Concept", "Process", "DataStore", "Interface", "Rule", "Feature", "Decision"]))
    rels = F.array(*map(F.lit, ["HAS", "STORED_IN", "TRIGGERS", "DEPENDS_ON", "USES"]))
    node = lambda i: F.concat(F.lower(F.get(types, (i % 7).cast("int"))), F.lit(":"), i.cast("string"))
    i = F.col("id")
    base = spark.range(n)
    nodes = base.select(node(i).alias("id"), F.get(types, (i % 7).cast("int")).alias("type"), F.concat(F.lit("Node "), i.cast("string")).alias("name"), F.concat(F.lit("cache and storage index of node "), i.cast("string")).alias("description"), F.when(i % 2 == 0, "core").otherwise("infra").alias("domain_area"), F.array(*[F.concat(F.lit(f"fact {f} of "), i.cast("string")) for f in range(3)]).alias("key_facts"), F.array(*[F.concat(F.lit(f"alias {a} "), i.cast("string")) for a in range(2)]).alias("alias"), i.alias("ord"))
    e = base.select(i, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("e")).withColumn("t", (i + 1 + (F.col("e") * 97) % n) % n).where("t <> id")
    edges = e.select(node(i).alias("source_id"), F.get(rels, ((i + F.col("e")) % 5).cast("int")).alias("relation"), node(F.col("t")).alias("target_id"), (i * k + F.col("e")).alias("ord"))
    return Graph(conform(nodes, NODE_SCHEMA), conform(edges, EDGE_SCHEMA), conform(spark.createDataFrame([], NOTE_SCHEMA), NOTE_SCHEMA))
