"""Data quality: missing data, duplicates, structural gaps, validation, statistics."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import ids as I
from loomgraph.functions import text as X
from loomgraph.model import CLUSTER_TYPE, EDGE_RULES, META_TYPE, NODE_TYPES, PROVENANCE_CODES, RELATIONS, Graph
from loomgraph.operators import kql, traverse
from loomgraph.operators import names as short_names


def missing_descriptions(nodes: DataFrame, types: list[str] | None = None, limit: int | None = 30) -> DataFrame:
    out = kql.searchable(nodes, types).where(F.trim("description") == "").select("id", "type", "name").orderBy("type", "id")
    return out.limit(limit) if limit else out


def missing_facts(graph: Graph, types: list[str] | None = None, by: str = "edges", limit: int | None = 30) -> DataFrame:
    out = kql.searchable(graph.nodes, types).where(F.size("key_facts") == 0).select("id", "type", "name").join(traverse.degree(graph.edges), "id", "left")
    out = out.select("id", "type", "name", F.coalesce("degree", F.lit(0).cast("long")).alias("edges"))
    out = out.orderBy(F.desc("edges"), "id") if by == "edges" else out.orderBy("id")
    return out.limit(limit) if limit else out


def _shorter_by_one(t: Column) -> Column:
    """All texts that lack one character of t."""
    n = F.char_length(t)
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1))))


def _edits(length: Column, threshold: float) -> Column:
    """Edits that leave a text of this length (the longer of two) at the threshold."""
    return F.floor(length * (1 - threshold) + 1e-9).cast("int")


def _masked(names: DataFrame, holes: int) -> DataFrame:
    """type, name, len, at (places from 1), key (the name without them) and the characters lost, one row for each choice of one or two places."""
    c = F.col("name")
    df = names.where(F.col("k") >= holes).where(F.col("len") >= holes).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("len") - holes + 1)))
    if holes == 1:
        return df.select("type", "name", "len", F.col("i").alias("at"), F.concat(F.substr(c, F.lit(1), F.col("i") - 1), F.substr(c, F.col("i") + 1)).alias("key"), F.substr(c, F.col("i"), F.lit(1)).alias("x"), F.lit("").alias("y"))
    df = df.withColumn("j", F.explode(F.sequence(F.col("i") + 1, "len")))
    rest = F.concat(F.substr(c, F.lit(1), F.col("i") - 1), F.substr(c, F.col("i") + 1, F.col("j") - F.col("i") - 1), F.substr(c, F.col("j") + 1))
    return df.select("type", "name", "len", (F.col("i") * 10000 + F.col("j")).alias("at"), rest.alias("key"), F.substr(c, F.col("i"), F.lit(1)).alias("x"), F.substr(c, F.col("j"), F.lit(1)).alias("y"))


def _few_edits(few: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(type, a, b, edits of pairs that one character more, or one or two other ones, tell apart, each once; type, a, b candidates of the rest).

    Names (type, name, len, k) may be at most two edits apart, and a pair as many as its longer name.
    """
    again = lambda df: df.withColumnsRenamed({"name": "n2", "len": "l2", "x": "x2", "y": "y2", "k": "k2"})
    pair = lambda df, *more: df.select("type", F.least("name", "n2").alias("a"), F.greatest("name", "n2").alias("b"), *more)
    one, two = _masked(few, 1), _masked(few, 2)
    by = ["type", "len", "at", "key"]
    swaps = one.join(one.withColumnsRenamed({"name": "n2", "x": "x2", "y": "y2"}), by).where("name < n2")
    both = two.join(two.withColumnsRenamed({"name": "n2", "x": "x2", "y": "y2"}), by).where("name < n2 AND x <> x2 AND y <> y2")
    less = one.select("type", "name", "len", "key").distinct()
    longer = again(less).withColumnRenamed("key", "name").join(few.select("type", "name"), ["type", "name"])
    known = pair(swaps, F.lit(1).alias("edits")).union(pair(both, F.lit(2).alias("edits"))).union(pair(longer, F.lit(1).alias("edits")))
    # Two edits that move the characters between them, or change the length.
    two_of = few.where("k = 2").select("type", "name")
    short = less.join(two_of, ["type", "name"])
    differ = lambda x, y, n: F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.substr(x, i, F.lit(1)) != F.substr(y, i, F.lit(1))))
    moved = short.join(again(short), ["type", "key"]).where("len = l2 AND name < n2").where(differ(F.col("name"), F.col("n2"), F.col("len")) > 2)
    gone = two.select("type", "name", "len", "key").distinct()
    uneven = again(gone).join(less, ["type", "key"]).where("l2 = len + 1")
    twice = again(gone).withColumnRenamed("key", "name").join(few.select("type", "name"), ["type", "name"])
    return known, pair(moved).union(pair(uneven)).union(pair(twice))


def _far_names(names: DataFrame, threshold: float) -> DataFrame:
    """type, a, b candidates of names (type, name, len) of which the longer one may have over two edits.

    The longer name is cut into one part more than edits, so one part occurs in the other name, moved by
    no more places than edits.  A candidate may come several times.
    """

    def parts(df: DataFrame) -> DataFrame:
        """Adds place i, start p (from 0) and width w of the parts of a name of length L."""
        df = df.withColumn("k", _edits(F.col("L"), threshold)).where("k > 2").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
        base, wide = F.floor(F.col("L") / (F.col("k") + 1)).cast("int"), F.col("L") % (F.col("k") + 1)
        late = F.greatest(F.lit(0), F.col("i") - (F.col("k") + 1 - wide))
        return df.withColumn("p", F.col("i") * base + late).withColumn("w", base + F.when(F.col("i") >= F.col("k") + 1 - wide, 1).otherwise(0))

    longer = parts(names.withColumn("L", F.col("len"))).select("type", F.col("name").alias("n2"), "L", "i", F.substr("name", F.col("p") + 1, F.col("w")).alias("key"))
    reach = F.floor(F.col("len") / threshold + 1e-9).cast("int")
    asks = parts(names.withColumn("L", F.explode(F.sequence("len", reach))))
    first, last = F.greatest(F.lit(0), F.col("p") - F.col("k")), F.least(F.col("len") - F.col("w"), F.col("p") + F.col("k"))
    asks = asks.where(first <= last).withColumn("at", F.explode(F.sequence(first, last))).select("type", "name", "L", "i", F.substr("name", F.col("at") + 1, F.col("w")).alias("key")).distinct()
    return asks.join(longer, ["type", "L", "i", "key"]).where("name <> n2").select("type", F.least("name", "n2").alias("a"), F.greatest("name", "n2").alias("b"))


def _other_pairs(names: DataFrame, threshold: float) -> DataFrame | None:
    """type, a, b, similarity of pairs of stored names that ``short_names`` does not find; None if there are no such names."""
    most = names.agg(F.max("len")).first()[0] or 0
    la, lb = F.char_length("a"), F.char_length("b")
    longer = F.greatest(la, lb, F.lit(1))
    out = []
    if threshold < 0.5:  # so many edits that names need not share anything
        other = names.select(F.col("type").alias("t2"), F.col("name").alias("n2"))
        near = names.join(other, (F.col("type") == F.col("t2")) & (F.col("name") < F.col("n2"))).select("type", F.col("name").alias("a"), F.col("n2").alias("b"))
    else:
        near = _far_names(names.select("type", "name", "len"), threshold) if short_names.edits(most, threshold) > 2 else None
    if near is not None:
        edits = _edits(longer, threshold)
        apart = F.call_function("levenshtein", F.col("a"), F.col("b"), edits)  # stops early
        near = near.withColumn("edits", apart).where("edits >= 0").distinct()
        out.append(near.withColumn("similarity", 1 - F.col("edits") / longer).where(F.col("similarity") >= threshold).drop("edits"))
    if threshold < 0.5 or most > short_names.LONGEST:
        lengths = names.groupBy("type").agg(F.collect_set("len").alias("lengths"))  # a row a type, no longer than the longest name
        cuts = F.transform(F.filter("lengths", lambda n: n < F.col("len")), lambda n: F.transform(F.sequence(F.lit(0), F.col("len") - n), lambda i: F.substr(F.col("name"), i + 1, n)))
        long = names if threshold < 0.5 else names.where(F.col("len") > short_names.LONGEST)
        pieces = long.join(F.broadcast(lengths), "type").select("type", F.col("name").alias("n2"), F.explode(F.array_distinct(F.flatten(cuts))).alias("name"))
        holds = pieces.join(names, ["type", "name"]).select("type", F.least("name", "n2").alias("a"), F.greatest("name", "n2").alias("b"))
        # A name in another is as many edits away as it is shorter: those within the threshold are alike already.
        out.append(holds.withColumn("similarity", 1 - F.abs(la - lb) / longer).where(F.col("similarity") < threshold))
    return reduce(DataFrame.union, out) if out else None


def _name_pairs(nodes: DataFrame, threshold: float) -> DataFrame:
    """type, a, b, similarity of different lower-case names that are alike or of which one holds the other."""
    names = short_names.table(nodes)
    other = _other_pairs(names, threshold)
    if threshold < 0.5:
        return other
    out = short_names.met(names, threshold, "names")
    return out if other is None else out.union(other)


def duplicates(nodes: DataFrame, threshold: float = 0.85, limit: int | None = 50, ordered: bool = True) -> DataFrame:
    """Pairs of one type whose names are alike or of which one holds the other.

    Distinct names are compared once (``short_names``, ``_other_pairs``).  Names of few nodes carry their
    nodes and give pairs of nodes where they meet; nodes of the others are joined to the pairs found.
    """
    n = nodes.where((F.col("type") != META_TYPE) & F.col("name").isNotNull()).select("type", F.lower("name").alias("a"), F.col("id").alias("left_id"), F.col("ord").alias("lo"))
    other = n.withColumnsRenamed({"a": "b", "left_id": "right_id", "lo": "ro"})
    names = short_names.table(nodes.where(F.col("type") != META_TYPE), ids=True)
    each = names.where("n > 1").select("type", "ords", "ids", F.explode(F.arrays_zip("ords", "ids")).alias("x")).select("type", "x", F.explode(F.arrays_zip("ords", "ids")).alias("y"))
    same = each.where("x.ords < y.ords").select("type", F.col("x.ids").alias("left_id"), F.col("y.ids").alias("right_id"), F.lit(1.0).alias("similarity"))
    many = bool(names.where("ids IS NULL").take(1))
    if many:
        held = n.join(names.where("ids IS NULL").select("type", F.col("name").alias("a")), ["type", "a"], "left_semi")
        far = held.withColumnsRenamed({"left_id": "right_id", "lo": "ro"})
        same = same.union(held.join(far, ["type", "a"]).where("lo < ro").select("type", "left_id", "right_id", F.lit(1.0)))
    rare = _other_pairs(names, threshold)
    if threshold >= 0.5:
        out = short_names.met(names, threshold, "nodes").union(same)
        if many:
            heavy = short_names.met(names, threshold, "heavy")
            rare = heavy if rare is None else rare.union(heavy)
    else:
        out = same
    if rare is not None:
        cross = rare.join(n, ["type", "a"]).join(other, ["type", "b"])
        out = out.union(cross.select("type", F.when(F.col("lo") < F.col("ro"), F.col("left_id")).otherwise(F.col("right_id")).alias("left_id"), F.when(F.col("lo") < F.col("ro"), F.col("right_id")).otherwise(F.col("left_id")).alias("right_id"), "similarity"))
    out = out.select("type", "left_id", "right_id", F.round("similarity", 6).alias("similarity"))
    if ordered:
        out = out.orderBy(F.desc("similarity"), "left_id", "right_id")
    return out.limit(limit) if limit else out


def duplicate_count(nodes: DataFrame, threshold: float = 0.85) -> DataFrame:
    """One row: the number of duplicates, from distinct names and their numbers of nodes."""
    names = short_names.table(nodes.where(F.col("type") != META_TYPE))
    pairs = names.select((F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"))
    if threshold >= 0.5:
        pairs = pairs.union(short_names.met(names, threshold, "count"))
    rare = _other_pairs(names, threshold)
    if rare is not None:
        side = lambda c, n: names.select("type", F.col("name").alias(c), F.col("n").alias(n))
        pairs = pairs.union(rare.join(side("a", "n"), ["type", "a"]).join(side("b", "m"), ["type", "b"]).select((F.col("n") * F.col("m")).alias("pairs")))
    return pairs.agg(F.coalesce(F.sum("pairs"), F.lit(0).cast("long")).alias("duplicate_pairs"))


#: type -> incoming relation without which a node is a gap (None: any).
GAPS = {"DataStore": "STORED_IN", "Process": None}


def edge_gaps(graph: Graph, relation: str | None = None, limit: int | None = None) -> DataFrame:
    """type, id, name of nodes without the incoming edge their type should have."""
    out = []
    for type_, need in GAPS.items():
        need = relation or need
        into = graph.edges.where(F.col("relation") == need) if need else graph.edges
        out.append(graph.nodes.where(F.col("type") == type_).select("type", "id", "name").join(into.select(F.col("target_id").alias("id")), "id", "left_anti").select("type", "id", "name"))
    both = reduce(DataFrame.union, out).orderBy("type", "id")
    return both.limit(limit) if limit else both


def gap_summary(graph: Graph, threshold: float = 0.85) -> DataFrame:
    """kind, id, other of everything the four reports find."""
    return (
        missing_descriptions(graph.nodes, limit=None).select(F.lit("missing_description").alias("kind"), "id", F.lit("").alias("other"))
        .union(missing_facts(graph, limit=None).select(F.lit("missing_facts"), "id", F.lit("")))
        .union(edge_gaps(graph).select(F.lit("edge_gap"), "id", F.lit("")))
        .union(duplicates(graph.nodes, threshold, None, ordered=False).select(F.lit("duplicate"), "left_id", "right_id"))
    )


def stats(graph: Graph) -> DataFrame:
    """kind, key, n: totals, nodes by type, edges by relation inside the graph, distinct sources."""
    nodes = kql.searchable(graph.nodes)
    inside = traverse.induced(graph.edges, nodes)
    return (
        nodes.agg(F.lit("nodes").alias("kind"), F.lit("").alias("key"), F.count("*").alias("n"))
        .union(inside.agg(F.lit("edges"), F.lit(""), F.count("*")))
        .union(nodes.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("type"), "type", "n"))
        .union(inside.groupBy("relation").agg(F.count("*").alias("n")).select(F.lit("relation"), "relation", "n"))
        .union(nodes.select(F.explode("source_files").alias("s")).agg(F.lit("sources"), F.lit(""), F.countDistinct("s")))
    )


def snapshot(graph: Graph, threshold: float = 0.85) -> DataFrame:
    """One row of eight counters."""
    nodes = kql.searchable(graph.nodes)
    one = nodes.agg(F.count("*").alias("total_nodes"), F.count_if(F.trim("description") == "").alias("missing_descriptions"), F.count_if(F.size("key_facts") == 0).alias("missing_facts"), F.count_if(F.col("type") == "DataStore").alias("storage_candidates"), F.count_if(F.col("type") == "Process").alias("process_candidates"))
    gaps = edge_gaps(graph).agg(F.count_if(F.col("type") == "DataStore").alias("storage_gaps"), F.count_if(F.col("type") == "Process").alias("process_gaps"))
    pairs = duplicate_count(nodes, threshold)
    return one.join(gaps).join(pairs)


def score(counts: DataFrame) -> DataFrame:
    """Quality 0..100 of the counters: coverage of descriptions and facts, duplicates and gaps."""
    ratio = lambda part, whole, empty: F.when(whole > 0, part / F.when(whole > 0, whole).otherwise(1)).otherwise(F.lit(empty))
    n = F.col("total_nodes").cast("double")
    desc, fact = 1 - ratio(F.col("missing_descriptions"), n, 0.0), 1 - ratio(F.col("missing_facts"), n, 0.0)
    dup = 1 - F.least(F.lit(1.0), ratio(F.col("duplicate_pairs"), n * (n - 1) / 2, 0.0))
    candidates = (F.col("storage_candidates") + F.col("process_candidates")).cast("double")
    gap = 1 - F.least(F.lit(1.0), ratio(F.col("storage_gaps") + F.col("process_gaps"), candidates, 0.0))
    total = 100 * (0.35 * desc + 0.35 * fact + 0.15 * dup + 0.15 * gap)
    return counts.select("*", F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), total)), 6).alias("quality_score"))


def baseline(graph: Graph, access: DataFrame, feedback: DataFrame, golden: DataFrame | None = None, threshold: float = 0.85) -> DataFrame:
    """One row: the snapshot and its score, feedback rates, cost of finds and, with per-query golden metrics, their means."""
    from loomgraph.operators import logs

    fb = logs.feedback_metrics(feedback).withColumnRenamed("total", "feedback_entries")
    out = score(snapshot(graph, threshold)).join(fb).join(logs.cost(access, feedback))
    if golden is not None:
        out = out.join(golden.agg(F.count("*").alias("cases"), F.avg("hit").alias("hit_rate"), F.avg("top1").alias("top1_rate"), F.avg("rr").alias("mrr"), F.avg("ndcg").alias("ndcg_at_k")))
    return out


def schema_dump(spark) -> DataFrame:
    """kind, name, detail, ord of the built-in types with their prefixes, relations and edge rules."""
    from loomgraph.model import TYPE_PREFIX

    rows = [("type", t, TYPE_PREFIX.get(t, "-")) for t in NODE_TYPES] + [("relation", r, "") for r in RELATIONS]
    rows += [("rule", r, " -> ".join(", ".join(x) or "any" for x in ends)) for r, ends in EDGE_RULES.items()]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "kind string, name string, detail string, ord long")


def _issue(df: DataFrame, severity: str, code: str, message: Column, when: Column | None = None) -> DataFrame:
    df = df if when is None else df.where(when)
    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"))


def _say(text: str, *columns: str) -> Column:
    return F.format_string(text, *map(F.col, columns))


def edge_rule_violations(graph: Graph) -> DataFrame:
    """source_id, relation, target_id, side, type of edges whose ends the rules do not allow.

    Rules apply where both ends have built-in types.
    """
    t = graph.nodes.where(F.col("type").isin(NODE_TYPES)).select("id", "type")
    e = graph.edges.select("source_id", "relation", "target_id")
    both = e.join(t.withColumnsRenamed({"id": "source_id", "type": "st"}), "source_id").join(t.withColumnsRenamed({"id": "target_id", "type": "tt"}), "target_id")
    lists = lambda k: F.create_map(*[x for r, ends in EDGE_RULES.items() for x in (F.lit(r), F.array(*map(F.lit, ends[k])))])
    bad = lambda k, c: ~F.coalesce(F.array_contains(F.try_element_at(lists(k), F.col("relation")), F.col(c)), F.lit(True))
    left = both.where(bad(0, "st")).select("source_id", "relation", "target_id", F.lit("source").alias("side"), F.col("st").alias("type"))
    return left.union(both.where(bad(1, "tt")).select("source_id", "relation", "target_id", F.lit("target"), "tt"))


def validate(graph: Graph, compat: bool = False) -> DataFrame:
    """severity, code, message of all findings; compat also counts metadata nodes as orphans."""
    n, e = graph.nodes, graph.edges
    plain = n.where(~F.col("type").isin(META_TYPE, CLUSTER_TYPE))
    ids = n.select("id")
    ends = e.select(F.col("source_id").alias("id")).union(e.select(F.col("target_id").alias("id")))
    known_type = F.col("type").isin(NODE_TYPES) | F.col("type").isin(META_TYPE, CLUSTER_TYPE) | F.col("type").rlike("^[!-~]{1,48}$")
    known_rel = F.col("relation").isin(RELATIONS) | F.col("relation").rlike("^[!-~]{1,64}$")
    similar = e.where("relation = '~'")
    parts = [
        _issue(n, "error", "empty_name", _say("node %s has no name", "id"), F.trim("name") == ""),
        _issue(plain, "error", "no_source", _say("node %s has no source", "id"), F.size("source_files") == 0),
        _issue(plain, "error", "bad_id", _say("node %s has an invalid id", "id"), ~I.valid_id(F.col("id"), F.col("type"))),
        _issue(n, "error", "bad_type", _say("node %s has invalid type %s", "id", "type"), ~known_type),
        _issue(e, "error", "bad_relation", _say("edge %s %s %s has an invalid relation", "source_id", "relation", "target_id"), ~known_rel),
        _issue(n.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "error", "duplicate_id", _say("duplicate node id %s", "id")),
        _issue(e.groupBy("source_id", "relation", "target_id").agg(F.count("*").alias("n")).where("n > 1"), "error", "duplicate_edge", _say("duplicate edge %s %s %s", "source_id", "relation", "target_id")),
        _issue(e.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti"), "error", "dangling_source", _say("edge source %s is missing", "source_id")),
        _issue(e.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti"), "error", "dangling_target", _say("edge target %s is missing", "target_id")),
        _issue((n if compat else plain).join(ends, "id", "left_anti"), "error", "orphan", _say("node %s has no edges", "id")),
        _issue(n, "error", "importance_range", _say("node %s has importance outside 0..1", "id"), ~F.col("importance").between(0, 1) & ~F.col("importance").between(1, 6)),
        _issue(n, "warning", "importance_legacy", _say("node %s has importance on the scale 1..6", "id"), F.col("importance").between(1.000001, 6)),
        _issue(n, "error", "confidence_range", _say("node %s has confidence outside 0..1", "id"), ~F.coalesce(F.col("confidence").between(0, 1), F.lit(True))),
        _issue(n, "error", "bad_provenance", _say("node %s has provenance %s", "id", "provenance"), (F.col("provenance") != "") & ~F.col("provenance").isin(PROVENANCE_CODES)),
        _issue(n, "warning", "bad_created_at", _say("node %s has created_at %s", "id", "created_at"), (F.col("created_at") != "") & ~X.valid_timestamp(F.col("created_at"))),
        _issue(plain.select("id", F.explode("source_files").alias("s")), "warning", "bad_source", _say("node %s has source %s", "id", "s"), ~X.valid_source(X.normalize_source(F.col("s")))),
        _issue(similar, "error", "similarity_direction", _say("edge %s ~ %s must be bidirectional with ordered ends", "source_id", "target_id"), ~F.col("bidirectional") | (F.col("source_id") > F.col("target_id"))),
        _issue(similar, "error", "similarity_score", _say("edge %s ~ %s has score %s", "source_id", "target_id", "detail"), ~F.coalesce(F.expr("try_cast(detail as double)").between(0, 1), F.lit(False))),
        _issue(edge_rule_violations(graph), "error", "edge_rule", _say("%s cannot be %s of %s (%s -> %s)", "type", "side", "relation", "source_id", "target_id")),
    ]
    return reduce(DataFrame.union, parts)


def missing_sources(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """id, source of file references that a listing (column path) does not have."""
    refs = nodes.select("id", F.explode("source_files").alias("source")).withColumn("path", F.regexp_extract("source", r"^(?:SOURCECODE|DOC)\s+(\S+)", 1)).where("path <> ''")
    return refs.join(files.select("path"), "path", "left_anti").select("id", "source")


@dataclass(frozen=True)
class ProjectSchema:
    """Rules of one project, read from TOML."""

    types: tuple[str, ...] = ()
    required: dict[str, tuple[str, ...]] = field(default_factory=dict)
    relations: tuple[str, ...] = ()
    edge_rules: tuple[dict, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    prefixes: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_toml(cls, text: str) -> ProjectSchema:
        import tomllib

        t = tomllib.loads(text)
        kinds = t.get("node_types", {})
        return cls(
            tuple(kinds.get("allowed", ())), {k: tuple(v) for k, v in kinds.get("required_fields", {}).items()}, tuple(t.get("relations", {}).get("allowed", ())),
            tuple(t.get("edge_rules", ())), tuple(tuple(u.get("fields", ())) for u in t.get("uniqueness", ())), dict(t.get("id_patterns", {})),
        )


def validate_project(graph: Graph, schema: ProjectSchema) -> DataFrame:
    n, e = graph.nodes.where(F.col("type") != META_TYPE), graph.edges
    kinds = dict(n.dtypes)
    parts = [n.limit(0).select(F.lit("").alias("severity"), F.lit("").alias("code"), F.lit("").alias("message"))]
    if schema.types:
        parts.append(_issue(n, "error", "type_not_allowed", _say("node %s: type %s is not allowed", "id", "type"), ~F.col("type").isin(*schema.types)))
    for type_, names in schema.required.items():
        for name in names:
            empty = F.size(name) == 0 if kinds[name].startswith("array") else F.coalesce(F.trim(F.col(name).cast("string")), F.lit("")) == ""
            parts.append(_issue(n, "error", "required_field", _say(f"node %s: {name} is required", "id"), (F.col("type") == type_) & empty))
    if schema.relations:
        parts.append(_issue(e, "error", "relation_not_allowed", _say("edge %s %s %s is not allowed", "source_id", "relation", "target_id"), ~F.col("relation").isin(*schema.relations)))
    t = n.select("id", "type")
    typed = e.join(t.withColumnsRenamed({"id": "source_id", "type": "st"}), "source_id").join(t.withColumnsRenamed({"id": "target_id", "type": "tt"}), "target_id")
    for rule in schema.edge_rules:
        ok = (F.col("st").isin(*rule["source_types"]) if rule.get("source_types") else F.lit(True)) & (F.col("tt").isin(*rule["target_types"]) if rule.get("target_types") else F.lit(True))
        parts.append(_issue(typed, "error", "edge_rule", _say("edge %s %s %s breaks a project rule", "source_id", "relation", "target_id"), (F.col("relation") == rule["relation"]) & ~ok))
    for names in schema.unique:
        w = Window.partitionBy(*names).orderBy("ord", "id")
        parts.append(_issue(n.withColumn("r", F.row_number().over(w)), "error", "not_unique", _say(f"node %s repeats {', '.join(names)}", "id"), F.col("r") > 1))
    for type_, prefix in schema.prefixes.items():
        parts.append(_issue(n, "error", "id_prefix", _say(f"node %s must begin with {prefix}:", "id"), (F.col("type") == type_) & ~F.col("id").startswith(prefix + ":")))
    return reduce(DataFrame.union, parts)
