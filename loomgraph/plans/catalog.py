"""All registered queries of the graph engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.model import EDGE_RULES, NODE_TYPES, RELATIONS, STOPWORDS, SUFFIXES, SYNONYMS, TYPE_PREFIX
from loomgraph.operators import kql, logs, quality, search, setops, similarity, temporal, traverse
from loomgraph.plans import derive as D
from loomgraph.session import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

SEARCHES = ["red widget", "supplier nation", "region africa"]


def _add(name: str, sql: str | None, base: str | None = D.SQL) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = f"{base} {sql}" if base else sql
        return f

    return put


def _kql(name: str, text: str, columns: str, sql: str) -> None:
    @_add(name, sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return kql.run(D.graph(spark, d), text).select(*columns.split())


# --- query language ----------------------------------------------------------------------------
_kql("kql_sort_limit", "nodes type=Concept name~NATION sort=-name limit=5", "id name type", "SELECT id, name, type FROM nodes WHERE type = 'Concept' AND contains(name, 'NATION') ORDER BY name DESC, ord LIMIT 5")
_kql("kql_prefix", "nodes name^Customer domain=BUILDING", "id name", "SELECT id, name FROM nodes WHERE starts_with(name, 'Customer') AND domain_area = 'BUILDING'")
_kql("kql_not_equal", "nodes type!=Decision provenance!=U", "id type", "SELECT id, type FROM nodes WHERE type <> 'Decision' AND provenance <> 'U'")
_kql("kql_range", "nodes created_at>=1997-01-01 created_at<1997-02-01", "id created_at", "SELECT id, created_at FROM nodes WHERE created_at >= '1997-01-01' AND created_at < '1997-02-01'")
_kql("kql_list_any", "nodes fact~size", "id name", "SELECT id, name FROM nodes WHERE len(list_filter(key_facts, lambda x: contains(x, 'size'))) > 0")
_kql("kql_number_text", "nodes confidence=1", "id", "SELECT id FROM nodes WHERE confidence = 1")
_kql("kql_unknown_key", "nodes colour=red", "id", "SELECT id FROM nodes WHERE false")
_kql("kql_edges", "edges relation=DECIDED_BY detail=F sort=target limit=20", "source_id relation target_id", "SELECT source_id, relation, target_id FROM edges WHERE relation = 'DECIDED_BY' AND detail = 'F' ORDER BY target_id LIMIT 20")
_kql("kql_notes", "notes tag=de sort=-id limit=30", "id node_id", "SELECT id, node_id FROM notes WHERE list_contains(tags, 'de') ORDER BY id DESC LIMIT 30")
_kql("kql_notes_body", "notes body~the author!=src0", "id author", "SELECT id, author FROM notes WHERE contains(body, 'the') AND author <> 'src0'")
_kql("kql_neighbors_out", "neighbors concept:nation_3 hops=2 out", "id", "SELECT DISTINCT n.id FROM nodes n JOIN (SELECT target_id AS id FROM edges WHERE source_id = 'concept:nation_3' UNION SELECT b.target_id FROM edges a JOIN edges b ON a.target_id = b.source_id WHERE a.source_id = 'concept:nation_3') r ON r.id = n.id WHERE n.id <> 'concept:nation_3'")
_kql("kql_neighbors_both", "neighbors id=interface:supplier_7 limit=40", "id", "SELECT id FROM nodes WHERE id IN (SELECT source_id FROM edges WHERE target_id = 'interface:supplier_7' UNION SELECT target_id FROM edges WHERE source_id = 'interface:supplier_7') ORDER BY id LIMIT 40")
_kql("kql_neighbors_in", "neighbors datastore:part_5 in", "id", "SELECT id FROM nodes WHERE id IN (SELECT source_id FROM edges WHERE target_id = 'datastore:part_5')")
for _kind, _by, _key in (("node", "type", "type"), ("node", "domain", "domain_area"), ("node", "provenance", "provenance")):
    _kql(f"kql_count_{_kind}_{_by}", f"count {_kind} by={_by}", "key count", f"SELECT CASE WHEN {_key} = '' THEN '(none)' ELSE {_key} END AS key, count(*) AS count FROM nodes GROUP BY 1")
_kql("kql_count_edge_relation", "count edge by=relation", "key count", "SELECT relation AS key, count(*) AS count FROM edges GROUP BY 1")
_kql("kql_count_note_tag", "count note by=tag", "key count", "SELECT CASE WHEN coalesce(tags[1], '') = '' THEN '(none)' ELSE tags[1] END AS key, count(*) AS count FROM notes GROUP BY 1")
_kql("kql_count_filtered", "count nodes type=Process by=domain", "key count", "SELECT domain_area AS key, count(*) AS count FROM nodes WHERE type = 'Process' GROUP BY 1")


@_add("kql_total", "SELECT count(*) AS total FROM nodes WHERE type = 'DataStore' AND len(list_filter(alias, lambda x: x = 'Brand#7')) > 0")
def _total(spark: SparkSession, d: str) -> DataFrame:
    return kql.total(D.graph(spark, d), "nodes type=DataStore alias=Brand#7 limit=3")


@_add("list_since", "SELECT id, name, created_at FROM nodes WHERE type = 'Decision' AND created_at >= '1998-01-01' ORDER BY created_at DESC, id LIMIT 50")
def _list(spark: SparkSession, d: str) -> DataFrame:
    return kql.list_nodes(D.nodes(spark, d), "Decision", "1998-01-01", 50, ("id", "name", "created_at"))


@_add("valid_on", "SELECT id FROM nodes WHERE valid_from <= '1996-06-01'")
def _valid(spark: SparkSession, d: str) -> DataFrame:
    return kql.valid_on(D.nodes(spark, d), "1996-06-01").select("id")


@_add("note_list", "SELECT id, node_id FROM notes WHERE node_id = 'concept:nation_4' ORDER BY id LIMIT 50")
def _notes(spark: SparkSession, d: str) -> DataFrame:
    return kql.list_notes(D.notes(spark, d), "concept:nation_4").select("id", "node_id")


@_add("node_get", "SELECT id, name, domain_area FROM nodes WHERE id = 'concept:region_2'")
def _get(spark: SparkSession, d: str) -> DataFrame:
    return kql.get_node(D.nodes(spark, d), "K:region_2").select("id", "name", "domain_area")


# --- traversal ---------------------------------------------------------------------------------
@_add("path", "SELECT * FROM (VALUES (0, 'concept:region_0'), (1, 'concept:nation_0')) t(step, id) WHERE EXISTS (SELECT 1 FROM edges WHERE source_id = 'concept:region_0' AND target_id = 'concept:nation_0')")
def _path(spark: SparkSession, d: str) -> DataFrame:
    return traverse.shortest_path(D.graph(spark, d), "concept:region_0", "concept:nation_0")


@_add("reachable", ", reach AS (SELECT 'concept:region_1' AS id UNION SELECT e.target_id FROM reach r JOIN edges e ON e.source_id = r.id) SELECT id FROM reach")
def _reach(spark: SparkSession, d: str) -> DataFrame:
    g = D.graph(spark, d)
    return traverse.bfs(g, g.nodes.where("id = 'concept:region_1'").select("id"), None, "out").select("id")


@_add("bfs_depth", ", step AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges), one AS (SELECT DISTINCT b AS id FROM step WHERE a = 'interface:supplier_1'), two AS (SELECT DISTINCT b AS id FROM step JOIN one ON a = one.id), reach AS (SELECT 'interface:supplier_1' AS id, 0 AS depth UNION ALL SELECT id, 1 FROM one UNION ALL SELECT id, 2 FROM two) SELECT id, min(depth) AS depth FROM reach GROUP BY id")
def _depth(spark: SparkSession, d: str) -> DataFrame:
    g = D.graph(spark, d)
    return traverse.bfs(g, g.nodes.where("id = 'interface:supplier_1'").select("id"), 2)


@_add("subgraph_edges", ", keep AS (SELECT id FROM nodes WHERE type IN ('Interface', 'DataStore')) SELECT source_id, relation, target_id FROM edges WHERE source_id IN (SELECT id FROM keep) AND target_id IN (SELECT id FROM keep)")
def _sub(spark: SparkSession, d: str) -> DataFrame:
    return traverse.subgraph(D.graph(spark, d), types=("interface", "datastore")).edges.select("source_id", "relation", "target_id")


_DEGREE = ", ends AS (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges), degree AS (SELECT id, count(*) AS degree FROM ends GROUP BY id)"


@_add("degree", f"{_DEGREE} SELECT id, degree FROM degree")
def _degree(spark: SparkSession, d: str) -> DataFrame:
    return traverse.degree(D.edges(spark, d))


@_add("hubs", f"{_DEGREE} SELECT n.id, coalesce(g.degree, 0) AS degree FROM nodes n LEFT JOIN degree g ON g.id = n.id ORDER BY degree DESC, n.ord LIMIT 10")
def _hubs(spark: SparkSession, d: str) -> DataFrame:
    return traverse.hubs(D.graph(spark, d))


@_add("relation_summary", ", r AS (SELECT source_id AS id, 'out' AS direction, relation FROM edges UNION ALL SELECT target_id, 'in', relation FROM edges), c AS (SELECT id, direction, relation, count(*) AS n FROM r GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id, direction ORDER BY relation) <= 3")
def _relations(spark: SparkSession, d: str) -> DataFrame:
    return traverse.relation_summary(D.edges(spark, d))


@_add("symmetric_neighbors", ", s AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges) SELECT a AS id, count(*) AS neighbors FROM s GROUP BY a")
def _symmetric(spark: SparkSession, d: str) -> DataFrame:
    return traverse.adjacency(D.edges(spark, d)).distinct().groupBy(F.col("a").alias("id")).agg(F.count("*").alias("neighbors"))


@_add("notes_by_node", "SELECT n.id, count(t.id) AS notes FROM nodes n LEFT JOIN notes t ON t.node_id = n.id GROUP BY n.id")
def _by_node(spark: SparkSession, d: str) -> DataFrame:
    per = D.notes(spark, d).groupBy("node_id").agg(F.count("*").alias("notes"))
    return D.nodes(spark, d).join(per, F.col("id") == per.node_id, "left").select("id", F.coalesce("notes", F.lit(0).cast("long")).alias("notes"))


# --- quality -----------------------------------------------------------------------------------
@_add("missing_descriptions", "SELECT id, type, name FROM nodes WHERE trim(description) = ''")
def _no_desc(spark: SparkSession, d: str) -> DataFrame:
    return quality.missing_descriptions(D.nodes(spark, d), limit=None)


@_add("missing_facts", f"{_DEGREE} SELECT n.id, n.type, n.name, coalesce(g.degree, 0) AS edges FROM nodes n LEFT JOIN degree g ON g.id = n.id WHERE len(key_facts) = 0")
def _no_facts(spark: SparkSession, d: str) -> DataFrame:
    return quality.missing_facts(D.graph(spark, d), limit=None)


_PAIRS = (
    ", pairs AS (SELECT a.type, a.id AS left_id, b.id AS right_id, contains(lower(a.name), lower(b.name)) OR contains(lower(b.name), lower(a.name)) AS holds, "
    "1 - levenshtein(lower(a.name), lower(b.name)) / greatest(length(a.name), length(b.name))::DOUBLE AS s FROM nodes a JOIN nodes b ON a.type = b.type AND a.ord < b.ord), "
    "dups AS (SELECT type, left_id, right_id, round(s, 6) AS similarity FROM pairs WHERE holds OR s >= 0.85)"
)
_GAPS = ", gaps AS (SELECT type, id, name FROM nodes WHERE type = 'DataStore' AND id NOT IN (SELECT target_id FROM edges WHERE relation = 'STORED_IN') UNION ALL SELECT type, id, name FROM nodes WHERE type = 'Process' AND id NOT IN (SELECT target_id FROM edges))"


@_add("duplicates", f"{_PAIRS} SELECT * FROM dups")
def _dups(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicates(D.nodes(spark, d), limit=None)


@_add("edge_gaps", f"{_GAPS} SELECT * FROM gaps")
def _gaps(spark: SparkSession, d: str) -> DataFrame:
    return quality.edge_gaps(D.graph(spark, d))


@_add("gap_summary", f"{_PAIRS} {_GAPS} SELECT 'missing_description' AS kind, id, '' AS other FROM nodes WHERE trim(description) = '' UNION ALL SELECT 'missing_facts', id, '' FROM nodes WHERE len(key_facts) = 0 UNION ALL SELECT 'edge_gap', id, '' FROM gaps UNION ALL SELECT 'duplicate', left_id, right_id FROM dups")
def _gap_summary(spark: SparkSession, d: str) -> DataFrame:
    return quality.gap_summary(D.graph(spark, d))


@_add("stats", "SELECT 'nodes' AS kind, '' AS key, count(*) AS n FROM nodes UNION ALL SELECT 'edges', '', count(*) FROM edges WHERE source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes) UNION ALL SELECT 'type', type, count(*) FROM nodes GROUP BY type UNION ALL SELECT 'relation', relation, count(*) FROM edges WHERE source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes) GROUP BY relation UNION ALL SELECT 'sources', '', 1")
def _stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.stats(D.graph(spark, d))


_COUNTS = (
    f"{_PAIRS} {_GAPS}, counts AS (SELECT count(*) AS total_nodes, count(*) FILTER (trim(description) = '') AS missing_descriptions, count(*) FILTER (len(key_facts) = 0) AS missing_facts, count(*) FILTER (type = 'DataStore') AS storage_candidates, count(*) FILTER (type = 'Process') AS process_candidates, "
    "(SELECT count(*) FROM gaps WHERE type = 'DataStore') AS storage_gaps, (SELECT count(*) FROM gaps WHERE type = 'Process') AS process_gaps, (SELECT count(*) FROM dups) AS duplicate_pairs FROM nodes)"
)


@_add("quality_snapshot", f"{_COUNTS} SELECT * FROM counts")
def _snapshot(spark: SparkSession, d: str) -> DataFrame:
    return quality.snapshot(D.graph(spark, d))


@_add("quality_score", f"{_COUNTS} SELECT *, round(100 * (0.35 * (1 - missing_descriptions / total_nodes) + 0.35 * (1 - missing_facts / total_nodes) + 0.15 * (1 - duplicate_pairs / (total_nodes * (total_nodes - 1) / 2)) + 0.15 * (1 - least(1.0, (storage_gaps + process_gaps) / (storage_candidates + process_candidates)))), 6) AS quality_score FROM counts")
def _score(spark: SparkSession, d: str) -> DataFrame:
    return quality.score(quality.snapshot(D.graph(spark, d)))


@_add("schema_dump", " UNION ALL ".join(
    [f"SELECT 'type' AS kind, '{t}' AS name, '{TYPE_PREFIX.get(t, '-')}' AS detail" for t in NODE_TYPES] + [f"SELECT 'relation', '{r}', ''" for r in RELATIONS]
    + [f"SELECT 'rule', '{r}', '{' -> '.join(', '.join(x) or 'any' for x in ends)}'" for r, ends in EDGE_RULES.items()]
), None)
def _schema(spark: SparkSession, d: str) -> DataFrame:
    return quality.schema_dump(spark).drop("ord")


def _rules_sql() -> str:
    rows = [f"('{r}', '{side}', '{t}')" for r, ends in EDGE_RULES.items() for side, types in zip(("source", "target"), ends, strict=True) for t in types]
    ruled = ", ".join(f"'{r}'" for r in EDGE_RULES)
    built = ", ".join(f"'{t}'" for t in NODE_TYPES)
    one = "SELECT e.source_id, e.relation, e.target_id, '{0}' AS side, {0}.type FROM edges e JOIN nodes source ON source.id = e.source_id JOIN nodes target ON target.id = e.target_id WHERE e.relation IN (" + ruled + ") AND source.type IN (" + built + ") AND target.type IN (" + built + ") AND NOT EXISTS (SELECT 1 FROM rules r WHERE r.relation = e.relation AND r.side = '{0}' AND r.type = {0}.type)"
    return f", rules(relation, side, type) AS (VALUES {', '.join(rows)}) {one.format('source')} UNION ALL {one.format('target')}"


@_add("edge_rules", _rules_sql())
def _rules(spark: SparkSession, d: str) -> DataFrame:
    return quality.edge_rule_violations(D.graph(spark, d))


@_add("validate", "SELECT 'error' AS severity, 'edge_rule' AS code, count(*) AS n FROM edges WHERE source_id LIKE 'concept:nation%' AND target_id LIKE 'process:%' UNION ALL SELECT 'error', 'orphan', count(*) FROM nodes WHERE id NOT IN (SELECT source_id FROM edges UNION SELECT target_id FROM edges) HAVING count(*) > 0")
def _validate(spark: SparkSession, d: str) -> DataFrame:
    return quality.validate(D.graph(spark, d)).groupBy("severity", "code").agg(F.count("*").alias("n"))


# --- text --------------------------------------------------------------------------------------
def _list_sql(xs: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in xs)


_STEM = "CASE " + " ".join(f"WHEN ends_with(t, '{s}') AND strlen(t) > {len(s) + 2} THEN left(t, length(t) - {len(s)})" for s in SUFFIXES) + " ELSE t END"
_SYN = "CASE s " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SYNONYMS.items()) + " ELSE s END"


def _tokens_sql(source: str, keep: str, text: str) -> str:
    """Rows (keep..., token) of normalised tokens of a text column."""
    raw = f"SELECT {keep}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS t FROM {source}"
    stem = f"SELECT *, {_STEM} AS s FROM ({raw}) WHERE NOT regexp_full_match(t, '\\p{{N}}*') AND t NOT IN ({_list_sql(STOPWORDS)})"
    return f"SELECT * EXCLUDE (t, s), {_SYN} AS token FROM ({stem}) WHERE s NOT IN ({_list_sql(STOPWORDS)})"


@_add("token_counts", f", toks AS ({_tokens_sql('notes', 'id', 'body')}) SELECT token, count(*) AS n, count(DISTINCT id) AS docs FROM toks GROUP BY token")
def _token_counts(spark: SparkSession, d: str) -> DataFrame:
    return search.token_counts(D.notes(spark, d).select("id", F.col("body").alias("text")))


@_add("normalize_text", f", toks AS ({_tokens_sql('(SELECT id, name, description, ord FROM nodes)', 'id', 'description')}) SELECT n.id, coalesce(t.text, '') AS text FROM nodes n LEFT JOIN (SELECT id, string_agg(token, ' ') AS text FROM toks GROUP BY id) t ON t.id = n.id")
def _normalize(spark: SparkSession, d: str) -> DataFrame:
    return D.nodes(spark, d).select("id", X.normalize_text(F.col("description")).alias("text"))


@_add("boosts", "SELECT id, CAST(sign(importance - 0.5) * floor(abs((importance - 0.5) * 2 * 66) + 0.5) AS BIGINT) AS boost FROM nodes")
def _boosts(spark: SparkSession, d: str) -> DataFrame:
    return D.nodes(spark, d).select("id", X.importance_boost(F.col("importance")).alias("boost"))


@_add("fact_volume", "SELECT id, round(CASE WHEN coalesce(list_sum(list_transform(key_facts, lambda x: length(x))), 0) = 0 THEN 1.0 ELSE least(1.0, greatest(0.35, sqrt(500.0) / sqrt(list_sum(list_transform(key_facts, lambda x: length(x))))) ) END, 6) AS factor FROM nodes")
def _volume(spark: SparkSession, d: str) -> DataFrame:
    return D.nodes(spark, d).select("id", F.round(X.fact_volume(F.col("key_facts")), 6).alias("factor"))


# --- search ------------------------------------------------------------------------------------
def _bm25_sql(final: str) -> str:
    terms = ", ".join(f"({q}, '{t}', {p})" for q, text in enumerate(SEARCHES) for p, t in enumerate(search.query_terms(text)))
    fields = (
        "fields AS (SELECT id, 0 AS rank, 0::BIGINT AS place, id AS text, 5 AS weight, true AS short FROM nodes UNION ALL SELECT id, 1, 0, name, 4, true FROM nodes UNION ALL SELECT id, 2, 0, description, 2, true FROM nodes "
        "UNION ALL SELECT id, 3, i, alias[i], 4, true FROM nodes, LATERAL (SELECT unnest(range(1, len(alias) + 1)) AS i) UNION ALL SELECT id, 4, i, key_facts[i], 2, false FROM nodes, LATERAL (SELECT unnest(range(1, len(key_facts) + 1)) AS i) "
        "UNION ALL SELECT node_id, 5, ord * 1000, body, 1, false FROM notes UNION ALL SELECT node_id, 5, ord * 1000 + i, tags[i], 1, false FROM notes, LATERAL (SELECT unnest(range(1, len(tags) + 1)) AS i))"
    )
    k = "tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest((SELECT avgdl FROM size), 1)))"
    return (
        f", terms(q, term, p) AS (VALUES {terms}), {fields}, toks AS MATERIALIZED ({_tokens_sql('fields', 'id, rank, place, weight, short', 'text')}), "
        "lens AS (SELECT id, sum(weight) AS dl FROM toks GROUP BY id), size AS (SELECT (SELECT sum(dl) FROM lens) / count(*) AS avgdl, count(*) AS docs FROM nodes), "
        "tf AS (SELECT q, id, term, sum(weight) AS tf FROM toks JOIN terms ON term = token GROUP BY ALL), "
        "idf AS (SELECT t.q, t.term, ln(1 + ((SELECT docs FROM size) - count(f.id) + 0.5) / (count(f.id) + 0.5)) AS idf FROM terms t LEFT JOIN tf f ON f.q = t.q AND f.term = t.term GROUP BY ALL), "
        f"own AS (SELECT q, id, sum(idf * {k}) AS own, count(*) AS hits, sum(idf) AS matched FROM tf JOIN idf USING (q, term) JOIN lens USING (id) GROUP BY q, id), "
        "nlen AS (SELECT id, count(*) AS dl FROM toks WHERE short GROUP BY id), ntf AS (SELECT q, id, term, count(*) AS tf FROM toks JOIN terms ON term = token WHERE short GROUP BY ALL), "
        f"ns AS (SELECT q, id, sum(idf * {k}) AS s FROM ntf JOIN idf USING (q, term) JOIN nlen USING (id) GROUP BY q, id), "
        "adj AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges), near AS (SELECT q, a AS id, max(s) AS near FROM ns JOIN adj ON b = ns.id GROUP BY q, a), "
        "fv AS (SELECT id, CASE WHEN coalesce(list_sum(list_transform(key_facts, lambda x: length(x))), 0) = 0 THEN 1.0 ELSE least(1.0, greatest(0.35, sqrt(500.0) / sqrt(list_sum(list_transform(key_facts, lambda x: length(x)))))) END AS fv FROM nodes), "
        "base AS (SELECT q, id, (3 * coalesce(own, 0) + coalesce(near, 0)) * fv AS base, hits, matched FROM own FULL JOIN near USING (q, id) JOIN fv USING (id)), "
        f"{final}"
    )


@_add("bm25_base", _bm25_sql("dummy AS (SELECT 1) SELECT q, id, round(base, 6) AS base FROM base WHERE base > 0"))
def _bm25_base(spark: SparkSession, d: str) -> DataFrame:
    raw = search.bm25_raw(D.graph(spark, d), SEARCHES)
    return raw.select("q", "id", F.round((F.col("raw") - F.col("boost")) / 100, 6).alias("base"))


@_add("bm25_find", None)
def _bm25_find(spark: SparkSession, d: str) -> DataFrame:
    return search.find(D.graph(spark, d), SEARCHES, "bm25", 20)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return _bm25_find(spark, d)


@_add("corpus_stats", _bm25_sql("dummy AS (SELECT 1) SELECT q, term, round(idf, 6) AS idf FROM idf"))
def _corpus(spark: SparkSession, d: str) -> DataFrame:
    g = D.graph(spark, d)
    return search.corpus(g, g.nodes, search.term_table(spark, SEARCHES))[1].select("q", "term", F.round("idf", 6).alias("idf"))


@_add("fuzzy_find", None)
def _fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return search.find(D.graph(spark, d), ["red widget"], "fuzzy", 20)


@_add("hybrid_find", None)
def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    return search.find(D.graph(spark, d), ["red widget"], "hybrid", 20)


_INDEX = (
    ", f AS (SELECT id, id AS text FROM nodes UNION ALL SELECT id, name FROM nodes UNION ALL SELECT id, description FROM nodes UNION ALL SELECT id, unnest(alias) FROM nodes UNION ALL SELECT id, unnest(key_facts) FROM nodes), "
    "post AS (SELECT DISTINCT id, term FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM f) WHERE strlen(term) > 2)"
)


@_add("index_stats", f"{_INDEX} SELECT term, count(*) AS df, round(ln(1 + ((SELECT count(*) FROM nodes) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM post GROUP BY term")
def _index(spark: SparkSession, d: str) -> DataFrame:
    return search.build_index(D.graph(spark, d))[1].select("term", "df", F.round("idf", 6).alias("idf"))


@_add("vector_pairs", "SELECT 'datastore:part_' || a.vec_id AS node_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = 0", None)
def _vectors(spark: SparkSession, d: str) -> DataFrame:
    v = D.vectors(spark, d)
    one = v.where("node_id = 'datastore:part_0'").select(F.col("vector").alias("q"))
    return v.join(F.broadcast(one)).select("node_id", F.round(X.cosine(F.col("vector"), F.col("q")), 6).alias("similarity"))


@_add("facts", None)
def _facts(spark: SparkSession, d: str) -> DataFrame:
    return search.facts(D.graph(spark, d), "economy part of size 11")


@_add("annotate", None)
def _annotate(spark: SparkSession, d: str) -> DataFrame:
    from loomgraph.operators.annotate import annotate

    g = D.graph(spark, d)
    texts = D.table(spark, d, "documents").select(F.concat(F.lit("note:doc_"), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    return annotate(g, texts.union(g.nodes.select("id", "description")))


@_add("golden_metrics", "SELECT doc_id % 10 AS q, min(r) AS first_rank, 1::BIGINT AS hit, (min(r) = 1)::BIGINT AS top1, 1 / min(r) AS rr FROM (SELECT *, row_number() OVER (PARTITION BY doc_id % 10 ORDER BY doc_id) AS r FROM labels) WHERE quality = 1 AND r <= 10 GROUP BY 1", None)
def _golden(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    t = D.table(spark, d, "labels").withColumn("q", F.col("doc_id") % 10).withColumn("id", F.col("doc_id").cast("string"))
    ranked = t.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("doc_id")))
    out = search.golden_metrics(ranked.select("q", "id", "rank"), ranked.where("quality = 1").select("q", "id"))
    return out.where("hit = 1").select("q", F.col("first_rank").cast("long").alias("first_rank"), "hit", "top1", "rr")


# --- set operations, mutations, time -----------------------------------------------------------
def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The nodes, and a later state: orders gone that are finished, parts renamed, importance raised."""
    n = D.nodes(spark, d)
    later = n.where("not (type = 'Decision' and description = 'F')").withColumn("name", F.when(F.col("type") == "DataStore", F.upper("name")).otherwise(F.col("name")))
    return n, later


_LATER = ", later AS (SELECT * REPLACE (CASE WHEN type = 'DataStore' THEN upper(name) ELSE name END AS name) FROM nodes WHERE NOT (type = 'Decision' AND description = 'F'))"


@_add("diff_nodes", f"{_LATER} SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS status FROM nodes a FULL JOIN later b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.name <> b.name")
def _diff(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    return setops.diff(a, b, ["id"])


@_add("diff_fields", f"{_LATER} SELECT a.id, 'name' AS path, a.name AS old, b.name AS new FROM nodes a JOIN later b ON a.id = b.id WHERE a.name <> b.name")
def _fields(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    return setops.field_diff(a, b, ["id"])


@_add("merge_new", f"{_LATER} SELECT id, name FROM later UNION ALL SELECT id, name FROM nodes WHERE id NOT IN (SELECT id FROM later)")
def _merge(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    return setops.merge(a, b, ["id"]).select("id", "name")


@_add("merge_old", f"{_LATER} SELECT id, name FROM nodes UNION ALL SELECT id, name FROM later WHERE id NOT IN (SELECT id FROM nodes)")
def _merge_old(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    return setops.merge(a, b, ["id"], "old").select("id", "name")


@_add("rename_node", "SELECT CASE WHEN source_id = 'concept:nation_1' THEN 'concept:first' ELSE source_id END AS source_id, relation, target_id FROM edges WHERE target_id <> 'concept:nation_1' UNION ALL SELECT source_id, relation, 'concept:first' FROM edges WHERE target_id = 'concept:nation_1'")
def _rename(spark: SparkSession, d: str) -> DataFrame:
    return setops.rename_node(D.graph(spark, d), "concept:nation_1", "concept:first").edges.select("source_id", "relation", "target_id")


@_add("remove_node", "SELECT source_id, relation, target_id FROM edges WHERE 'concept:nation_1' NOT IN (source_id, target_id)")
def _remove(spark: SparkSession, d: str) -> DataFrame:
    return setops.remove_node(D.graph(spark, d), "concept:nation_1").edges.select("source_id", "relation", "target_id")


@_add("apply_feedback", "SELECT n.id, coalesce(sum(CASE f.action WHEN 'YES' THEN 1.0 WHEN 'NO' THEN -1.0 WHEN 'PICK' THEN 2.0 END), 0)::DOUBLE AS feedback_score, count(f.uid) AS feedback_count, max(f.ts_ms) AS feedback_last_ts_ms FROM nodes n LEFT JOIN feedback_log f ON f.selected = n.id GROUP BY n.id")
def _apply(spark: SparkSession, d: str) -> DataFrame:
    return setops.apply_feedback(D.nodes(spark, d), D.feedback_log(spark, d)).select("id", "feedback_score", "feedback_count", "feedback_last_ts_ms")


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """A change log of decisions: an order's row changes with each order of its customer."""
    return D.table(spark, d, "orders").select(F.concat(F.lit("process:customer_"), F.col("o_custkey").cast("string")).alias("id"), F.unix_millis("o_orderdate").alias("ts_ms"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("state"), (F.col("o_orderpriority") == "5-LOW").alias("deleted"))


_VERSIONS = ", versions AS (SELECT 'process:customer_' || o_custkey AS id, epoch_us(o_orderdate) // 1000 AS ts_ms, o_orderkey AS ord, o_orderstatus AS state, o_orderpriority = '5-LOW' AS deleted FROM orders), cur AS (SELECT * FROM versions WHERE ts_ms <= {0} QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts_ms DESC, ord DESC) = 1)"


@_add("as_of", _VERSIONS.format(852076800000) + " SELECT id, ts_ms, ord, state FROM cur WHERE NOT deleted")
def _as_of(spark: SparkSession, d: str) -> DataFrame:
    return temporal.as_of(_versions(spark, d), ["id"], 852076800000)


@_add("diff_as_of", _VERSIONS.format(852076800000) + ", at2 AS (SELECT * FROM versions WHERE ts_ms <= 883612800000 QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts_ms DESC, ord DESC) = 1), l AS (SELECT * FROM cur WHERE NOT deleted), r AS (SELECT * FROM at2 WHERE NOT deleted) SELECT coalesce(l.id, r.id) AS id, CASE WHEN l.id IS NULL THEN 'added' WHEN r.id IS NULL THEN 'removed' ELSE 'changed' END AS status FROM l FULL JOIN r ON l.id = r.id WHERE l.id IS NULL OR r.id IS NULL OR l.state <> r.state")
def _diff_as_of(spark: SparkSession, d: str) -> DataFrame:
    return temporal.diff_as_of(_versions(spark, d), ["id"], 852076800000, 883612800000)


@_add("timeline", "SELECT event_id AS ord, epoch_us(ts) // 1000 AS ts_ms, event_type AS action FROM events WHERE (epoch_us(ts) // 1000) BETWEEN 1704500000000 AND 1705000000000 ORDER BY ts_ms DESC, ord DESC LIMIT 100", None)
def _timeline(spark: SparkSession, d: str) -> DataFrame:
    e = D.table(spark, d, "events").select(F.col("event_id").alias("ord"), F.unix_millis("ts").alias("ts_ms"), F.col("event_type").alias("action"))
    return temporal.timeline(e, 1704500000000, 1705000000000, 100)


# --- logs --------------------------------------------------------------------------------------
@_add("access_stats", "SELECT count(*) AS total, count(*) FILTER (op = 'FIND') AS finds, count(*) FILTER (op = 'GET') AS gets, round(100.0 * count(*) FILTER (op = 'FIND' AND results = 0) / count(*) FILTER (op = 'FIND'), 6) AS empty_find_percent, round(avg(duration_ms), 6) AS mean_ms FROM access_log")
def _access(spark: SparkSession, d: str) -> DataFrame:
    return logs.access_stats(D.access_log(spark, d))


@_add("top_queries", "SELECT query, count(*) AS n FROM access_log GROUP BY query ORDER BY n DESC, query LIMIT 10")
def _top(spark: SparkSession, d: str) -> DataFrame:
    return logs.top_queries(D.access_log(spark, d))


@_add("log_page", "SELECT ord, op, query FROM access_log WHERE op = 'GET' ORDER BY ord DESC LIMIT 50")
def _page(spark: SparkSession, d: str) -> DataFrame:
    return logs.page(D.access_log(spark, d), 50, op="GET").select("ord", "op", "query")


@_add("sessions", "SELECT session, count(*) AS n, min(ord) AS first FROM (SELECT *, sum(new) OVER (ORDER BY ts, ord ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (SELECT *, CASE WHEN lag(ts) OVER (ORDER BY ts, ord) IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, ord)) > 300000000 THEN 1 ELSE 0 END AS new FROM access_log)) GROUP BY session")
def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return logs.sessions(D.access_log(spark, d)).groupBy("session").agg(F.count("*").alias("n"), F.min("ord").alias("first"))


_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_-]+'))"


@_add("access_paths", "SELECT session, step, query, coalesce(2.0 * len(list_intersect(" + _WORDS.format("was") + ", " + _WORDS.format("query") + ")) / (len(" + _WORDS.format("was") + ") + len(" + _WORDS.format("query") + ")) > 0.3, false) AS refines FROM (SELECT *, row_number() OVER w AS step, lag(query) OVER w AS was FROM (SELECT *, count(*) OVER (PARTITION BY session) AS n FROM (SELECT *, sum(new) OVER (ORDER BY ts, ord ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (SELECT *, CASE WHEN lag(ts) OVER (ORDER BY ts, ord) IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, ord)) > 300000000 THEN 1 ELSE 0 END AS new FROM access_log))) WHERE n > 1 WINDOW w AS (PARTITION BY session ORDER BY ts, ord))")
def _paths(spark: SparkSession, d: str) -> DataFrame:
    return logs.access_paths(D.access_log(spark, d)).withColumn("step", F.col("step").cast("long"))


@_add("feedback_metrics", "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (action = '{a}') AS {a.lower()}, round(count(*) FILTER (action = '{a}') / count(*), 6) AS {a.lower()}_rate" for a in ("YES", "NO", "PICK", "NIL")) + " FROM feedback_log")
def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return logs.feedback_metrics(D.feedback_log(spark, d))


@_add("feedback_summary", "SELECT 'action' AS kind, action AS key, count(*) AS n FROM feedback_log GROUP BY action UNION ALL (SELECT 'picked', selected, count(*) AS n FROM feedback_log WHERE action = 'PICK' GROUP BY selected ORDER BY n DESC, selected LIMIT 10) UNION ALL (SELECT 'query', queries, count(*) AS n FROM feedback_log GROUP BY queries ORDER BY n DESC, queries LIMIT 10) UNION ALL SELECT 'verdict', CASE WHEN count(*) FILTER (action = 'YES') > 3 * count(*) FILTER (action = 'NO') THEN 'positive' WHEN count(*) FILTER (action = 'NO') > count(*) FILTER (action = 'YES') THEN 'negative' ELSE 'mixed' END, count(*) FROM feedback_log")
def _summary(spark: SparkSession, d: str) -> DataFrame:
    return logs.feedback_summary(D.feedback_log(spark, d))


@_add("cost", "SELECT count(*) FILTER (op = 'FIND') AS find_ops, (SELECT count(*) FROM feedback_log) AS feedback_events, round((SELECT count(*) FROM feedback_log) * 1000.0 / count(*) FILTER (op = 'FIND'), 6) AS feedback_per_1000_find_ops FROM access_log")
def _cost(spark: SparkSession, d: str) -> DataFrame:
    return logs.cost(D.access_log(spark, d), D.feedback_log(spark, d))


_QS = ", qs AS (SELECT lower(trim(queries)) AS key, count(*) AS events, count(*) FILTER (action IN ('YES', 'PICK')) AS positive, count(*) FILTER (action IN ('NO', 'NIL')) AS negative FROM feedback_log GROUP BY 1)"


@_add("query_stats", f"{_QS} SELECT * FROM qs")
def _qs(spark: SparkSession, d: str) -> DataFrame:
    return logs.query_stats(D.feedback_log(spark, d))


@_add("nudge", f"{_QS} SELECT key, least(100, greatest(0, 20 + CASE WHEN events >= 3 AND negative / events >= 0.5 THEN 25 ELSE 0 END - CASE WHEN events >= 5 AND positive / events >= 0.8 THEN 20 ELSE 0 END + CASE WHEN (SELECT sum(events) FROM qs) >= 20 AND (SELECT sum(negative) / sum(events) FROM qs) >= 0.4 THEN 10 ELSE 0 END))::BIGINT AS percent FROM qs")
def _nudge(spark: SparkSession, d: str) -> DataFrame:
    return logs.nudge(logs.query_stats(D.feedback_log(spark, d)))


@_add("find_context", "SELECT 'u' || f.event_id AS uid, count(*) AS n FROM events f JOIN events c ON c.user_id = f.user_id AND c.event_type = 'view' AND f.event_type = 'purchase' AND f.ts >= c.ts AND f.ts <= c.ts + INTERVAL 10 MINUTE GROUP BY f.event_id", None)
def _context(spark: SparkSession, d: str) -> DataFrame:
    e = D.table(spark, d, "events").withColumn("uid", F.col("user_id").cast("string"))
    finds = e.where("event_type = 'view'").select("uid", "ts", F.array(F.lit("a")).alias("candidates"))
    picks = e.where("event_type = 'purchase'").select("uid", "ts", F.lit("PICK").alias("action"), F.lit("1").alias("pick"), "event_id")
    j = picks.join(finds.select(F.col("uid").alias("u"), F.col("ts").alias("find_ts")), (F.col("uid") == F.col("u")) & (F.col("ts") >= F.col("find_ts")) & (F.col("ts") <= F.col("find_ts") + F.expr("interval 10 minutes")))
    return j.groupBy(F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("uid")).agg(F.count("*").alias("n"))


# --- similarity --------------------------------------------------------------------------------
@_add("score_all", None)
def _score_all(spark: SparkSession, d: str) -> DataFrame:
    return similarity.score_all(D.graph(spark, d))


@_add("communities", None)
def _communities(spark: SparkSession, d: str) -> DataFrame:
    s = cut_lineage(similarity.score_all(D.graph(spark, d), least=0.5))  # three readers
    return similarity.materialize(cut_lineage(similarity.communities(s, 0.5)), s)


@_add("expand_terms", None)
def _expand(spark: SparkSession, d: str) -> DataFrame:
    return D.nodes(spark, d).select("id", F.array_join(X.expand_terms(F.col("name")), " ").alias("terms"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
