"""Ranked search: BM25 with neighbour context, boosts, composition, hybrid, vectors, facts.

All searches take a list of queries at once; the number of a query is a column, so one pass over the
tokens serves all of them.  Documents are token counts, never token lists: only nodes that hold all
terms of a query are looked at for phrases, and only fields with two terms for proximity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.model import EXPANSIONS, Graph
from loomgraph.operators import kql, traverse
from loomgraph.session import cut_lineage

K1, B = 1.5, 0.75
WEIGHTS = {"id": 5, "name": 4, "description": 2, "alias": 4, "key_facts": 2, "body": 1, "tags": 1}


def query_terms(text: str) -> list[str]:
    """The expanded terms of a query, computed as ``expand_terms`` does for columns."""
    import re

    def toks(s: str) -> list[str]:
        return [n for n in (X.normal_word(t) for t in re.findall(r"[^\W_]+", s.lower())) if n]

    def expand(s: str) -> list[str]:
        return list(dict.fromkeys(x for t in toks(s) for x in (t, *EXPANSIONS.get(t, ()))))

    return expand(" ".join(expand(text)))


def term_table(spark: SparkSession, queries: list[str]) -> DataFrame:
    """q, term: as long as the caller's queries."""
    rows = [(i, t) for i, text in enumerate(queries) for t in query_terms(text)]
    return spark.createDataFrame(rows, "q int, term string")


def fields(graph: Graph, nodes: DataFrame) -> DataFrame:
    """id, field, place, text, weight of all searchable texts."""
    one = lambda c: nodes.select("id", F.lit(c).alias("field"), F.lit(0).cast("long").alias("place"), F.col(c).alias("text"))
    many = lambda c: nodes.select("id", F.lit(c).alias("field"), F.posexplode(c).alias("place", "text")).withColumn("place", F.col("place").cast("long"))
    notes = graph.notes.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    body = notes.select(F.col("node_id").alias("id"), F.lit("body").alias("field"), (F.col("ord") * 1000).alias("place"), F.col("body").alias("text"))
    tags = notes.select(F.col("node_id").alias("id"), F.lit("tags").alias("field"), F.posexplode("tags").alias("p", "text"), "ord").select("id", "field", (F.col("ord") * 1000 + 1 + F.col("p")).alias("place"), "text")
    out = one("id").union(one("name")).union(one("description")).union(many("alias")).union(many("key_facts")).union(body).union(tags).where("text <> ''")
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    return out.withColumn("weight", weight[F.col("field")].cast("long"))


def token_counts(df: DataFrame) -> DataFrame:
    """token, n, docs of columns id, text.  Words are counted first and only distinct ones are stemmed."""
    raw = df.select("id", F.explode(X.raw_tokens(F.col("text"))).alias("raw")).where(X.is_token(F.col("raw")))
    per = raw.groupBy("raw", "id").agg(F.count("*").alias("c"))
    token = per.select("raw").distinct().select("raw", X.normal_token(F.col("raw")).alias("token"))
    one = per.join(token, "raw").groupBy("token", "id").agg(F.sum("c").alias("c"))
    return one.groupBy("token").agg(F.sum("c").alias("n"), F.count("*").alias("docs"))


def asked_words(terms: DataFrame) -> DataFrame:
    """raw, token: the words that stand for a term of the caller's queries."""
    rows = sorted(X.words_of({r["term"] for r in terms.select("term").distinct().collect()}).items())
    return terms.sparkSession.createDataFrame(rows, "raw string, token string")


def counted(df: DataFrame, asked: DataFrame, weight: Column) -> DataFrame:
    """id, term, n of column text: asked terms by themselves, all other tokens together under null.

    Nothing is stemmed: whether a word counts, and which term it stands for, are lookups.
    """
    raw = df.select("id", weight.alias("w"), F.explode(X.raw_tokens(F.col("text"))).alias("raw")).where(X.is_token(F.col("raw")))
    per = raw.join(F.broadcast(asked), "raw", "left").groupBy("id", F.col("token").alias("term")).agg(F.sum("w").alias("n"))
    return cut_lineage(per)  # every figure comes from these counts


def _bm25(tf: Column, dl: Column, idf: Column, avgdl: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.greatest(avgdl, F.lit(1.0))))


def corpus(graph: Graph, nodes: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(q, id, term, tf, dl), (q, term, df, idf) and one row (docs, avgdl)."""
    per = counted(fields(graph, nodes), asked_words(terms), F.col("weight"))
    lengths = per.groupBy("id").agg(F.sum("n").alias("dl"))
    size = nodes.agg(F.count("*").alias("docs")).join(lengths.agg(F.sum("dl").alias("total"))).select("docs", (F.col("total") / F.greatest(F.col("docs"), F.lit(1))).alias("avgdl"))
    tf = per.where("term is not null").withColumnRenamed("n", "tf").join(lengths, "id")
    found = tf.join(F.broadcast(terms), "term")
    df = terms.join(found.groupBy("q", "term").agg(F.count("*").alias("df")), ["q", "term"], "left").select("q", "term", F.coalesce("df", F.lit(0).cast("long")).alias("df"))
    idf = df.join(F.broadcast(size)).select("q", "term", "df", F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    return found, idf, size


def bm25_raw(graph: Graph, queries: list[str], features: bool = True) -> DataFrame:
    """q, id, raw, boost: (3 self + best neighbour) * fact volume * 100 + lexical + proximity."""
    spark = graph.nodes.sparkSession
    nodes = kql.searchable(graph.nodes, features=features)
    terms = term_table(spark, queries)
    found, idf, size = corpus(graph, nodes, terms)
    scored = found.join(F.broadcast(idf.drop("df")), ["q", "term"]).join(F.broadcast(size))
    own = scored.groupBy("q", "id").agg(F.sum(_bm25(F.col("tf"), F.col("dl"), F.col("idf"), F.col("avgdl"))).alias("own"), F.count("*").alias("hits"), F.sum("idf").alias("matched"))
    # Neighbours count with their id, name, description and aliases, once each.
    short = fields(graph.with_(notes=graph.notes.limit(0)), graph.nodes).where("field in ('id', 'name', 'description', 'alias')")
    nper = counted(short, asked_words(terms), F.lit(1).cast("long"))
    nlen = nper.groupBy("id").agg(F.sum("n").alias("dl"))
    nscore = nper.where("term is not null").withColumnRenamed("n", "tf").join(nlen, "id").join(F.broadcast(terms), "term").join(F.broadcast(idf.drop("df")), ["q", "term"]).join(F.broadcast(size))
    nscore = nscore.groupBy("q", F.col("id").alias("b")).agg(F.sum(_bm25(F.col("tf"), F.col("dl"), F.col("idf"), F.col("avgdl"))).alias("s"))
    near = traverse.adjacency(graph.edges).join(nscore, "b").groupBy("q", F.col("a").alias("id")).agg(F.max("s").alias("near")).join(nodes.select("id"), "id", "left_semi")
    base = own.join(near, ["q", "id"], "full").join(nodes.select("id", "key_facts"), "id")
    base = base.withColumn("base", (3 * F.coalesce("own", F.lit(0.0)) + F.coalesce("near", F.lit(0.0))) * X.fact_volume(F.col("key_facts"))).where("base > 0")
    totals = idf.groupBy("q").agg(F.sum("idf").alias("all_idf"), F.count("*").alias("n_terms"))
    base = base.join(F.broadcast(totals), "q")
    boosts = _field_boosts(graph, nodes, terms, base.where("hits >= 2").select("q", "id", "hits", "n_terms"))
    token = F.when(F.col("hits").isNull(), 0).otherwise(F.round(F.col("matched") / F.greatest(F.col("all_idf"), F.lit(1.0)) * 45))
    out = base.join(boosts, ["q", "id"], "left")
    boost = F.when(F.col("phrase"), 120).otherwise(token) + F.coalesce("proximity", F.lit(0))
    return out.select("q", "id", (F.col("base") * 100 + boost).alias("raw"), boost.cast("long").alias("boost"))


def _field_boosts(graph: Graph, nodes: DataFrame, terms: DataFrame, candidates: DataFrame) -> DataFrame:
    """q, id, phrase, proximity of nodes that hold at least two terms.

    Token lists are made only of fields with two terms, and of nodes with all terms.
    """
    lists: dict[int, list[str]] = {}
    for r in terms.collect():  # the caller's queries
        lists.setdefault(r["q"], []).append(r["term"])
    ordered = F.broadcast(terms.sparkSession.createDataFrame(list(lists.items()), "q int, qt array<string>"))
    f = fields(graph, nodes)
    place = ["id", "field", "place"]
    raw = f.select(*place, F.explode(X.raw_tokens(F.col("text"))).alias("raw")).join(F.broadcast(asked_words(terms)), "raw")
    hit = raw.join(F.broadcast(terms.withColumnRenamed("term", "token")), "token")
    two = hit.groupBy("q", *place).agg(F.countDistinct("token").alias("n")).where("n >= 2").drop("n")
    near = X.proximity_hits(X.tokens(F.col("text")), F.col("qt"))
    spans = two.join(f, place).join(ordered, "q").groupBy("q", "id").agg(F.max(near).alias("near"))
    whole = candidates.where("hits = n_terms and n_terms > 1").select("q", "id")
    rank = F.create_map(*[F.lit(x) for k, i in (("id", 0), ("name", 1), ("description", 2), ("alias", 3), ("key_facts", 4), ("body", 5), ("tags", 5)) for x in (k, i)])
    part = F.struct(rank[F.col("field")].alias("r"), F.col("place").alias("p"), F.flatten(F.array_repeat(X.tokens(F.col("text")), F.col("weight").cast("int"))).alias("t"))
    docs = whole.join(f, "id").groupBy("q", "id").agg(F.array_sort(F.collect_list(part)).alias("parts")).join(ordered, "q")
    phrase = docs.select("q", "id", X.contains_phrase(F.flatten(F.transform("parts", lambda p: p["t"])), F.col("qt")).alias("phrase"))
    both = candidates.select("q", "id").join(phrase, ["q", "id"], "left").join(spans, ["q", "id"], "left")
    return both.select("q", "id", F.coalesce("phrase", F.lit(False)).alias("phrase"), F.when(F.col("near") >= 2, 80 + 20 * (F.col("near") - 2)).otherwise(0).alias("proximity"))


def compose(raw: DataFrame, nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """q, id, score and its parts: log-normalised relevance and bounded authority, one row an id."""
    from loomgraph.functions.ids import normalize_id_column

    w, raw = Window.partitionBy("q"), cut_lineage(raw)
    best = raw.groupBy("q").agg(F.max("raw").alias("top"))
    j = raw.where("raw > 0").join(F.broadcast(best), "q").join(nodes.select("id", "name", "type", "importance", "feedback_score", "feedback_count"), "id")
    j = j.withColumn("relevance", F.round(F.log1p("raw") / F.log1p("top") * 1000).cast("long"))
    authority = X.feedback_boost(F.col("feedback_score"), F.col("feedback_count")) + X.importance_boost(F.col("importance"))
    cap = F.least(F.lit(240), F.greatest(F.lit(30), F.round(F.col("relevance") * 0.35))).cast("long")
    j = j.withColumn("authority", F.least(cap, F.greatest(-cap, authority))).withColumn("score", F.col("relevance") + F.col("authority"))
    j = j.withColumn("key", F.lower(normalize_id_column(F.col("id"))))
    first = Window.partitionBy("q", "key").orderBy(F.desc("score"), "id")
    j = j.withColumn("r", F.row_number().over(first)).where("r = 1")
    if limit:
        j = j.withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), "id"))).where(F.col("r") <= limit)
    return j.select("q", "id", "name", "type", "score", "relevance", "authority", "boost")


def find(graph: Graph, queries: list[str], mode: str = "bm25", limit: int = 10, features: bool = True, weights: tuple[float, float] = (0.35, 0.55)) -> DataFrame:
    """Ranked nodes of each query: mode bm25, fuzzy or hybrid."""
    return compose(raw_scores(graph, queries, mode, features, weights), graph.nodes, limit)


def raw_scores(graph: Graph, queries: list[str], mode: str, features: bool = True, weights: tuple[float, float] = (0.35, 0.55)) -> DataFrame:
    if mode == "bm25":
        return bm25_raw(graph, queries, features)
    from loomgraph.operators.fuzzy import fuzzy_raw

    fuzzy = fuzzy_raw(graph, queries, features)
    if mode == "fuzzy":
        return fuzzy
    return hybrid(fuzzy, bm25_raw(graph, queries, features), weights)


def hybrid(fuzzy: DataFrame, bm25: DataFrame, weights: tuple[float, float] = (0.35, 0.55)) -> DataFrame:
    """Weighted mean of both log-normalised scores, times 1000."""
    wf, wb = weights

    def norm(df: DataFrame, name: str) -> DataFrame:
        df = cut_lineage(df)
        top = df.groupBy("q").agg(F.max("raw").alias("top"))
        return df.join(F.broadcast(top), "q").select("q", "id", F.when(F.col("top") > 0, F.log1p("raw") / F.log1p("top")).otherwise(0.0).alias(name), F.col("boost").alias(f"{name}_boost"))

    both = norm(fuzzy, "f").join(norm(bm25, "b"), ["q", "id"], "full")
    raw = (wf * F.coalesce("f", F.lit(0.0)) + wb * F.coalesce("b", F.lit(0.0))) / max(wf + wb, 0.0001) * 1000
    return both.select("q", "id", raw.alias("raw"), F.coalesce("b_boost", F.lit(0).cast("long")).alias("boost")).where("raw > 0")


def build_index(graph: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(term, node_id), (term, df, idf) and one row (docs, avgdl) of the persisted index.

    Index tokens are lower-cased runs of letters and digits of more than two bytes, unstemmed, of
    the nodes' own fields (notes are left out), and count once a document.
    """
    f = fields(graph.with_(notes=graph.notes.limit(0)), graph.nodes)
    t = f.select("id", F.explode(X.raw_tokens(F.col("text"))).alias("term")).where(F.octet_length("term") > 2).distinct()
    size = t.groupBy("id").agg(F.count("*").alias("dl")).agg(F.sum("dl").alias("total")).join(graph.nodes.agg(F.count("*").alias("docs"))).select("docs", (F.col("total") / F.greatest("docs", F.lit(1))).alias("avgdl"))
    df = t.groupBy("term").agg(F.count("*").alias("df"))
    stats = df.join(F.broadcast(size)).select("term", "df", F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    return t.select("term", F.col("id").alias("node_id")), stats, size


def save_index(index: tuple[DataFrame, DataFrame, DataFrame], path: str, buckets: int = 64) -> None:
    """Writes an index: postings and figures by a hash of their term, so a search reads few files."""
    by = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    for df, name in zip(index[:2], ("postings", "terms"), strict=True):
        df.withColumn("bucket", by).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
    index[0].groupBy("node_id").agg(F.count("*").alias("dl")).write.mode("overwrite").parquet(f"{path}/lengths")
    index[2].withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{path}/size")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A written index, as ``build_index`` gives it."""
    read = lambda name, *c: spark.read.parquet(f"{path}/{name}").select(*c)
    return read("postings", "term", "node_id"), read("terms", "term", "df", "idf"), read("size", "docs", "avgdl")


def stored_search(spark: SparkSession, path: str, queries: list[str]) -> DataFrame:
    """``indexed_search`` of a written index: only the buckets of the queries' terms are read."""
    size = spark.read.parquet(f"{path}/size")
    terms = term_table(spark, queries)
    buckets = size.first()["buckets"]
    wanted = [r[0] for r in terms.select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).distinct().collect()]  # the caller's terms
    part = lambda name: spark.read.parquet(f"{path}/{name}").where(F.col("bucket").isin(wanted)).drop("bucket")
    hits = part("postings").join(F.broadcast(terms), "term").join(part("terms"), "term").join(spark.read.parquet(f"{path}/lengths"), "node_id").join(F.broadcast(size))
    return _index_scores(hits)


def _index_scores(hits: DataFrame) -> DataFrame:
    return hits.groupBy("q", F.col("node_id").alias("id")).agg(F.sum(_bm25(F.lit(1.0), F.col("dl"), F.col("idf"), F.col("avgdl"))).alias("raw"))


def indexed_search(index: tuple[DataFrame, DataFrame, DataFrame], queries: list[str]) -> DataFrame:
    """q, id, raw by the index: binary frequencies."""
    postings, stats, size = index
    terms = term_table(postings.sparkSession, queries)
    lengths = postings.groupBy("node_id").agg(F.count("*").alias("dl"))
    return _index_scores(postings.join(F.broadcast(terms), "term").join(stats, "term").join(lengths, "node_id").join(F.broadcast(size)))


def vector_search(vectors: DataFrame, nodes: DataFrame, query: list[float], limit: int = 10, least: float = 0.0) -> DataFrame:
    """node_id, similarity of the stored vectors of nodes that are most like the query."""
    q = F.array(*[F.lit(float(x)) for x in query])
    known = vectors.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    return known.select("node_id", X.cosine(F.col("vector"), q).alias("similarity")).where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "node_id").limit(limit)


def facts(graph: Graph, text: str, limit: int = 20, index: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """node_id, fact, score: facts of the best nodes, by the words they share with the text.

    Blank facts and facts without a token are left out.
    """
    index = index or build_index(graph)
    top = indexed_search(index, [text]).orderBy(F.desc("raw"), "id").limit(max(20, 4 * limit))
    q = F.array(*map(F.lit, query_terms(text))) if query_terms(text) else F.array().cast("array<string>")
    f = top.join(graph.nodes.select("id", "key_facts"), "id").select("id", "raw", F.explode(F.array_distinct("key_facts")).alias("fact")).withColumn("t", X.tokens(F.col("fact"))).where(F.size("t") > 0)
    overlap = F.size(F.filter("t", lambda x: F.array_contains(q, x)))
    score = F.when(overlap > 0, F.col("raw") * (1 + overlap + overlap / F.greatest(F.size("t"), F.lit(1)))).otherwise(F.col("raw") * 0.25)
    return f.select(F.col("id").alias("node_id"), "fact", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "node_id", "fact").limit(limit)


def golden_metrics(ranked: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """q, first_rank, hit, top1, rr, ndcg of ranked results (q, id, rank) against (q, id)."""
    hits = expected.distinct().join(ranked.where(F.col("rank") <= k), ["q", "id"], "left")
    shown = ranked.where(F.col("rank") <= k).groupBy("q").agg(F.count("*").alias("shown"))
    per = hits.groupBy("q").agg(F.min("rank").alias("first_rank"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.count("*").alias("n_expected")).join(shown, "q", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n_expected"), F.coalesce("shown", F.lit(0).cast("long"))), F.lit(1).cast("long"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    hit = F.col("first_rank").isNotNull()
    return per.select("q", "first_rank", hit.cast("long").alias("hit"), F.coalesce(F.col("first_rank") == 1, F.lit(False)).cast("long").alias("top1"), F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("rr"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"))
