"""A property graph derived from relational tables, as frames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.model import EDGE_SCHEMA, NODE_SCHEMA, NOTE_SCHEMA, Graph, conform


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table; timestamps without zone are taken as UTC, the session's zone."""
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def _id(prefix: str, key: str):
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def _empty():
    return F.array().cast("array<string>")


def nodes(spark: SparkSession, d: str, parts: tuple[str, ...] = ("region", "nation", "supplier", "customer", "part", "orders")) -> DataFrame:
    """Nodes of the given tables; ord is a base of the table plus its key."""
    made = {
        "region": lambda t: t.select(_id("concept:region_", "r_regionkey").alias("id"), F.lit("Concept").alias("type"), F.col("r_name").alias("name"), F.concat(F.lit("Region "), F.col("r_name")).alias("description"), F.lit("geo").alias("domain_area"), F.lit("U").alias("provenance"), F.lit(0.9).alias("confidence"), F.lit("").alias("created_at"), F.lit(0.5).alias("importance"), _empty().alias("key_facts"), _empty().alias("alias"), F.lit("").alias("valid_from"), (F.col("r_regionkey")).cast("long").alias("ord")),
        "nation": lambda t: t.select(_id("concept:nation_", "n_nationkey").alias("id"), F.lit("Concept").alias("type"), F.col("n_name").alias("name"), F.lit("").alias("description"), F.lit("geo").alias("domain_area"), F.lit("D").alias("provenance"), F.lit(None).cast("double").alias("confidence"), F.lit("").alias("created_at"), F.lit(0.5).alias("importance"), F.array(F.concat(F.lit("region "), F.col("n_regionkey").cast("string"))).alias("key_facts"), _empty().alias("alias"), F.lit("").alias("valid_from"), (F.col("n_nationkey") + 1000).cast("long").alias("ord")),
        "supplier": lambda t: t.select(_id("interface:supplier_", "s_suppkey").alias("id"), F.lit("Interface").alias("type"), F.col("s_name").alias("name"), F.concat(F.lit("supplier of nation "), F.col("s_nationkey").cast("string")).alias("description"), F.lit("supply").alias("domain_area"), F.lit("A").alias("provenance"), F.lit(0.8).alias("confidence"), F.lit("").alias("created_at"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("s_acctbal") / 10000)).alias("importance"), F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("ships goods"))).otherwise(_empty()).alias("key_facts"), _empty().alias("alias"), F.lit("").alias("valid_from"), (F.col("s_suppkey") + 1_000_000_000).alias("ord")),
        "customer": lambda t: t.select(_id("process:customer_", "c_custkey").alias("id"), F.lit("Process").alias("type"), F.col("c_name").alias("name"), F.lit("").alias("description"), F.col("c_mktsegment").alias("domain_area"), F.lit("U").alias("provenance"), F.lit(None).cast("double").alias("confidence"), F.lit("").alias("created_at"), F.lit(0.5).alias("importance"), _empty().alias("key_facts"), F.array(F.concat(F.lit("client "), F.col("c_custkey").cast("string"))).alias("alias"), F.lit("").alias("valid_from"), (F.col("c_custkey") + 2_000_000_000).alias("ord")),
        "part": lambda t: t.select(_id("datastore:part_", "p_partkey").alias("id"), F.lit("DataStore").alias("type"), F.col("p_name").alias("name"), F.concat(F.lit("part of "), F.col("p_brand")).alias("description"), F.lit("stock").alias("domain_area"), F.lit("D").alias("provenance"), F.lit(0.7).alias("confidence"), F.lit("").alias("created_at"), F.lit(0.5).alias("importance"), F.array(F.col("p_type"), F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("key_facts"), F.array("p_brand").alias("alias"), F.lit("").alias("valid_from"), (F.col("p_partkey") + 3_000_000_000).alias("ord")),
        "orders": lambda t: t.select(_id("decision:order_", "o_orderkey").alias("id"), F.lit("Decision").alias("type"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderstatus").alias("description"), F.col("o_orderpriority").alias("domain_area"), F.lit("U").alias("provenance"), F.lit(1.0).alias("confidence"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.when(F.col("o_orderpriority").startswith("1"), 0.9).otherwise(0.4).alias("importance"), _empty().alias("key_facts"), _empty().alias("alias"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("valid_from"), (F.col("o_orderkey") + 4_000_000_000).alias("ord")),
    }
    out = None
    for name in parts:
        t = made[name](table(spark, d, name))
        out = t if out is None else out.unionByName(t)
    return conform(out.withColumn("source_files", F.array(F.lit("DOC tables"))), NODE_SCHEMA)


def edges(spark: SparkSession, d: str, parts: tuple[str, ...] = ("nation", "supplier", "customer", "orders", "available", "uses")) -> DataFrame:
    made = {
        "nation": lambda: table(spark, d, "nation").select(_id("concept:region_", "n_regionkey").alias("source_id"), F.lit("HAS").alias("relation"), _id("concept:nation_", "n_nationkey").alias("target_id"), F.lit("").alias("detail")),
        "supplier": lambda: table(spark, d, "supplier").select(_id("concept:nation_", "s_nationkey").alias("source_id"), F.lit("HAS").alias("relation"), _id("interface:supplier_", "s_suppkey").alias("target_id"), F.lit("").alias("detail")),
        "customer": lambda: table(spark, d, "customer").select(_id("concept:nation_", "c_nationkey").alias("source_id"), F.lit("HAS").alias("relation"), _id("process:customer_", "c_custkey").alias("target_id"), F.lit("").alias("detail")),
        "orders": lambda: table(spark, d, "orders").select(_id("process:customer_", "o_custkey").alias("source_id"), F.lit("DECIDED_BY").alias("relation"), _id("decision:order_", "o_orderkey").alias("target_id"), F.col("o_orderstatus").alias("detail")),
        "available": lambda: table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().select(_id("datastore:part_", "l_partkey").alias("source_id"), F.lit("AVAILABLE_IN").alias("relation"), _id("interface:supplier_", "l_suppkey").alias("target_id"), F.lit("").alias("detail")),
        "uses": lambda: table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct().select(_id("decision:order_", "l_orderkey").alias("source_id"), F.lit("USES").alias("relation"), _id("datastore:part_", "l_partkey").alias("target_id"), F.lit("").alias("detail")),
    }
    out = None
    for name in parts:
        t = made[name]()
        out = t if out is None else out.unionByName(t)
    return conform(out, EDGE_SCHEMA)


def notes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    out = t.select(_id("note:doc_", "doc_id").alias("id"), F.concat(F.lit("concept:nation_"), (F.col("doc_id") % 25).cast("string")).alias("node_id"), F.col("text").alias("body"), F.array("lang", "source").alias("tags"), F.col("source").alias("author"), F.lit("").alias("created_at"), F.lit("D").alias("provenance"), F.col("doc_id").alias("ord"))
    return conform(out, NOTE_SCHEMA)


def graph(spark: SparkSession, d: str) -> Graph:
    return Graph(nodes(spark, d), edges(spark, d), notes(spark, d), {"name": "derived"})


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.concat(F.lit("datastore:part_"), F.col("vec_id").cast("string")).alias("node_id"), F.col("embedding").alias("vector"))


def access_log(spark: SparkSession, d: str) -> DataFrame:
    """ts, op, query, results, duration_ms, ord: views are searches, clicks are reads."""
    return table(spark, d, "events").select("ts", F.when(F.col("event_type") == "click", "GET").otherwise("FIND").alias("op"), F.concat("event_type", F.lit(" user "), F.col("user_id").cast("string")).alias("query"), F.when(F.col("event_type") == "error", 0).otherwise(F.col("event_id") % 7).cast("long").alias("results"), (F.col("event_id") % 100).alias("duration_ms"), F.col("event_id").alias("ord"))


def feedback_log(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    action = F.when(t == "purchase", "PICK").when(t == "signup", "YES").when(t == "error", "NO").otherwise("NIL")
    return table(spark, d, "events").select(F.unix_millis("ts").alias("ts_ms"), F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("uid"), action.alias("action"), F.when(t == "purchase", "1").alias("pick"), F.when(t == "purchase", F.concat(F.lit("process:customer_"), F.col("user_id").cast("string"))).alias("selected"), F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")).alias("graph"), t.alias("queries"), F.col("event_id").alias("ord"))


# --- the same in SQL -------------------------------------------------------------------------

_N = {
    "region": "SELECT 'concept:region_' || r_regionkey AS id, 'Concept' AS type, r_name AS name, 'Region ' || r_name AS description, 'geo' AS domain_area, 'U' AS provenance, 0.9::DOUBLE AS confidence, '' AS created_at, 0.5::DOUBLE AS importance, []::VARCHAR[] AS key_facts, []::VARCHAR[] AS alias, '' AS valid_from, r_regionkey::BIGINT AS ord FROM region",
    "nation": "SELECT 'concept:nation_' || n_nationkey, 'Concept', n_name, '', 'geo', 'D', NULL, '', 0.5, ['region ' || n_regionkey], [], '', n_nationkey + 1000 FROM nation",
    "supplier": "SELECT 'interface:supplier_' || s_suppkey, 'Interface', s_name, 'supplier of nation ' || s_nationkey, 'supply', 'A', 0.8, '', least(1.0::DOUBLE, greatest(0.0::DOUBLE, s_acctbal / 10000)), CASE WHEN s_suppkey % 2 = 0 THEN ['ships goods'] ELSE [] END, [], '', s_suppkey + 1000000000 FROM supplier",
    "customer": "SELECT 'process:customer_' || c_custkey, 'Process', c_name, '', c_mktsegment, 'U', NULL, '', 0.5, [], ['client ' || c_custkey], '', c_custkey + 2000000000 FROM customer",
    "part": "SELECT 'datastore:part_' || p_partkey, 'DataStore', p_name, 'part of ' || p_brand, 'stock', 'D', 0.7, '', 0.5, [p_type, 'size ' || p_size], [p_brand], '', p_partkey + 3000000000 FROM part",
    "orders": "SELECT 'decision:order_' || o_orderkey, 'Decision', 'Order ' || o_orderkey, o_orderstatus, o_orderpriority, 'U', 1.0, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ'), CASE WHEN o_orderpriority LIKE '1%' THEN 0.9 ELSE 0.4 END, [], [], strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ'), o_orderkey + 4000000000 FROM orders",
}
_E = {
    "nation": "SELECT 'concept:region_' || n_regionkey AS source_id, 'HAS' AS relation, 'concept:nation_' || n_nationkey AS target_id, '' AS detail FROM nation",
    "supplier": "SELECT 'concept:nation_' || s_nationkey, 'HAS', 'interface:supplier_' || s_suppkey, '' FROM supplier",
    "customer": "SELECT 'concept:nation_' || c_nationkey, 'HAS', 'process:customer_' || c_custkey, '' FROM customer",
    "orders": "SELECT 'process:customer_' || o_custkey, 'DECIDED_BY', 'decision:order_' || o_orderkey, o_orderstatus FROM orders",
    "available": "SELECT DISTINCT 'datastore:part_' || l_partkey, 'AVAILABLE_IN', 'interface:supplier_' || l_suppkey, '' FROM lineitem",
    "uses": "SELECT DISTINCT 'decision:order_' || l_orderkey, 'USES', 'datastore:part_' || l_partkey, '' FROM lineitem",
}


def _ctes(nodes_of: tuple[str, ...], edges_of: tuple[str, ...]) -> str:
    n = " UNION ALL ".join(_N[x] for x in nodes_of)
    e = " UNION ALL ".join(_E[x] for x in edges_of)
    return (
        f"WITH RECURSIVE nodes AS ({n}), edges AS ({e}), "
        "notes AS (SELECT 'note:doc_' || doc_id AS id, 'concept:nation_' || (doc_id % 25) AS node_id, coalesce(text, '') AS body, [lang, source] AS tags, source AS author, doc_id AS ord FROM documents), "
        "access_log AS (SELECT ts, CASE WHEN event_type = 'click' THEN 'GET' ELSE 'FIND' END AS op, event_type || ' user ' || user_id AS query, CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 7 END::BIGINT AS results, event_id % 100 AS duration_ms, event_id AS ord FROM events), "
        "feedback_log AS (SELECT epoch_us(ts) // 1000 AS ts_ms, 'u' || event_id AS uid, CASE event_type WHEN 'purchase' THEN 'PICK' WHEN 'signup' THEN 'YES' WHEN 'error' THEN 'NO' ELSE 'NIL' END AS action, CASE WHEN event_type = 'purchase' THEN '1' END AS pick, CASE WHEN event_type = 'purchase' THEN 'process:customer_' || user_id END AS selected, 'g' || (user_id % 3) AS graph, event_type AS queries, event_id AS ord FROM events)"
    )


SQL = _ctes(tuple(_N), tuple(_E))
