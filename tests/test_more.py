"""Lossless text format, versions, additions, reports, migration and the stored index."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.model import EDGE_SCHEMA, NODE_SCHEMA, NOTE_SCHEMA, Graph, conform
from loomgraph.operators import annotate, quality, search, setops, similarity
from loomgraph.sources import imports, json_io, kg_text

KG = """@ K:a
N Alpha store
D line one\\nline two
A first
A Second
F size 3
E 2024-01-01T00:00:00Z
C 0.25
V 0.5
P U
- domain_area geo
- scan true
- scan_ignore_unknown false
- feedback_score 2.5
- feedback_count 4
- feedback_last_ts_ms 5
S DOC x
= ~ concept:b
d C1 0.500000
d C2 0.250000
d 0.75
> H concept:b
d why
i 2024-01-01
x 2024-02-01
- edge_feedback_score -1
- edge_feedback_count 2
- edge_feedback_last_ts_ms 7

@ K:b
N Beta
V 0.9

! note:1 concept:a
b a note
t x
a me
e 2024
p U
s DOC y
"""


def dump(df):
    return sorted(str(sorted(r.asDict(recursive=True).items())) for r in df.drop("ord").collect())


def test_text_format_is_lossless(spark, tmp_path):
    (tmp_path / "g.kg").write_text(KG)
    g = kg_text.read(spark, str(tmp_path / "g.kg"))
    a = g.nodes.where("id = 'concept:a'").first()
    assert (a.domain_area, a.scan, a.scan_ignore_unknown, a.feedback_score, a.feedback_count, a.feedback_last_ts_ms) == ("geo", True, False, 2.5, 4, 5)
    e = {r.relation: r for r in g.edges.collect()}
    assert e["~"].score_components == {"C1": 0.5, "C2": 0.25} and e["~"].detail == "0.75" and e["~"].bidirectional
    assert (e["HAS"].feedback_score, e["HAS"].feedback_count, e["HAS"].feedback_last_ts_ms, e["HAS"].valid_to) == (-1.0, 2, 7, "2024-02-01")
    kg_text.write(g, str(tmp_path / "out"))
    again = kg_text.read(spark, str(tmp_path / "out"))
    for kind in ("nodes", "edges", "notes"):
        assert dump(getattr(again, kind)) == dump(getattr(g, kind))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert text.index("d C1 0.500000") < text.index("d C2") < text.index("d 0.75") and text.index("A first") < text.index("A Second")
    with pytest.raises(ValueError, match="out of order"):
        kg_text.parse("@ K:a\nN a\n> H concept:b\nx 2024\nd late", strict=True)
    assert kg_text.parse("@ K:a\nN a\n- feedback_count many\n- scan maybe\n- colour red")[0][0].get("feedback_count") == 0


def test_dictionary_compression():
    raw = "@ GSYM:a\nD the very long description of a generated thing\n\n@ GSYM:b\nD the very long description of a generated thing\n\n@ K:c\nD the very long description of a generated thing\n"
    small = kg_text.compress_dictionary(raw)
    assert len(small) < len(raw) and kg_text.expand_dictionary(small) == raw and small.endswith("@ K:c\nD the very long description of a generated thing\n")
    assert kg_text.compress_dictionary("@ K:c\nD nothing generated\n") == "@ K:c\nD nothing generated\n" and kg_text.compress_dictionary("") == ""


def test_versions(spark, tmp_path):
    (tmp_path / "g.kg").write_text(KG)
    g = kg_text.read(spark, str(tmp_path / "g.kg"))
    path = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        kg_text.load(spark, path)
    kg_text.save(g, path, 1_000_000)
    kg_text.save(setops.remove_note(g, "note:1"), path, 2_000_000)
    assert kg_text.load(spark, path).notes.count() == 0 and kg_text.load(spark, path, "previous").notes.count() == 1
    kg_text.save(setops.remove_node(g, "concept:b"), path, 2_000_001)  # too soon for another backup
    assert kg_text.load(spark, path).nodes.count() == 1 and kg_text.load(spark, path, "previous").notes.count() == 1
    assert kg_text.read(spark, f"{path}/hourly/0").nodes.count() == 2


@pytest.fixture(scope="module")
def small(spark):
    n = spark.createDataFrame([("concept:a", "Concept", "Alpha"), ("process:p", "Process", "Run"), ("datastore:d", "DataStore", "Disk"), ("custom:x", "Custom", "Odd")], "id string, type string, name string")
    e = spark.createDataFrame([("concept:a", "STORED_IN", "datastore:d")], "source_id string, relation string, target_id string")
    t = spark.createDataFrame([("note:1", "concept:a", "old")], "id string, node_id string, body string")
    return Graph(conform(n, NODE_SCHEMA), conform(e, EDGE_SCHEMA), conform(t, NOTE_SCHEMA))


def test_additions(spark, small):
    rows = [
        ("concept:a", "STORED_IN", "datastore:d", False, "exists"), ("concept:a", "FLIES", "datastore:d", False, "relation"), ("datastore:d", "STORED_IN", "concept:a", False, "rule"), ("concept:a", "~", "process:p", False, "similarity"),
        ("concept:a", "HAS", "process:p", True, "similarity"), ("concept:z", "USES", "concept:a", False, "source"), ("concept:a", "USES", "concept:z", False, "target"), ("custom:x", "STORED_IN", "custom:x", False, None), ("process:p", "USES", "concept:a", False, None), ("concept:a", "~", "process:p2", True, "target"),
    ]
    new = spark.createDataFrame([r[:4] for r in rows], "source_id string, relation string, target_id string, bidirectional boolean")
    got, problems = setops.add_edges(small, new)
    want = {}
    for s, r, t, _, why in rows:
        if why and (s, r, t) not in want:
            want[s, r, t] = why
    assert {(r.source_id, r.relation, r.target_id): r.problem for r in problems.collect()} == want and got.edges.count() == 3
    assert setops.add_edges(small, new, "atomic")[0].edges.count() == 1
    notes = spark.createDataFrame([("note:2", "concept:a", "new"), ("note:1", "concept:a", "again"), ("note:3", "concept:z", "lost"), ("note:4", "concept:a", " ")], "id string, node_id string, body string")
    got, problems = setops.add_notes(small, notes)
    assert {r.id: r.problem for r in problems.collect()} == {"note:1": "exists", "note:3": "unknown node", "note:4": "empty"} and got.notes.count() == 2
    assert setops.remove_note(got, "note:1").notes.first().id == "note:2"
    later = small.nodes.withColumn("name", F.when(F.col("id") == "concept:a", "New").otherwise(F.col("name")))
    assert {r.status: r.n for r in setops.merge_summary(small.nodes, later, ["id"]).collect()} == {"conflict": 1, "existing": 3}
    assert [(r.id, r.path, r.kept) for r in setops.merge_conflicts(small.nodes, later, ["id"], "old").collect()] == [("concept:a", "name", "Alpha")]


def test_reports(spark, small, tmp_path):
    access = spark.createDataFrame([("FIND", 1), ("GET", 1)], "op string, results int")
    feedback = spark.createDataFrame([("YES",), ("NIL",)], "action string")
    golden = spark.createDataFrame([(0, 1, 1, 1.0, 1.0), (1, 0, 0, 0.0, 0.0)], "q int, hit long, top1 long, rr double, ndcg double")
    r = quality.baseline(small, access, feedback, golden).first()
    assert (r.total_nodes, r.feedback_entries, r.yes, r.feedback_per_1000_find_ops, r.cases, r.hit_rate, r.mrr) == (4, 2, 1, 2000.0, 2, 0.5, 0.5) and 0 < r.quality_score < 100
    dump_ = {(x.kind, x.name): x.detail for x in quality.schema_dump(spark).collect()}
    assert dump_["type", "DataStore"] == "datastore" and dump_["rule", "CREATED_BY"] == "Concept, DataStore, Interface, Decision -> Process"
    vectors = spark.createDataFrame([("concept:a", [1.0, 0.0]), ("gone", [1.0, 2.0])], "node_id string, vector array<float>")
    json_io.write_vectors(vectors, str(tmp_path / "v"))
    good, bad = json_io.read_vectors(spark, str(tmp_path / "v"), small.nodes)
    assert [r.node_id for r in good.collect()] == ["concept:a"] and [r.id for r in bad.collect()] == ["gone"]
    old = lambda df: df.withColumns({"ts_ms": F.lit(5), "deleted": F.lit(False)})
    gone = old(small.nodes).union(small.nodes.where("id = 'custom:x'").withColumns({"ts_ms": F.lit(8), "deleted": F.lit(True)}))
    assert json_io.export_as_of(gone, old(small.edges), old(small.notes), 6, str(tmp_path / "x")).nodes.count() == 4
    assert json_io.export_as_of(gone, old(small.edges), old(small.notes), 9, str(tmp_path / "y")).nodes.count() == 3 and json_io.read(spark, str(tmp_path / "y")).nodes.count() == 3


def test_migration(spark):
    n = spark.createDataFrame([("a", "data-stores", "x"), ("b", "Refs", "y"), ("c", "Strange", "z")], "id string, type string, name string")
    e = spark.createDataFrame([("a", "reads", "b"), ("a", "affects<-", "b"), ("b", "<-depends on", "c"), ("a", "?", "c"), ("a", "stored-in", "c"), ("a", "odd", "c")], "source_id string, relation string, target_id string")
    g = Graph(conform(n, NODE_SCHEMA), conform(e, EDGE_SCHEMA), conform(spark.createDataFrame([], NOTE_SCHEMA), NOTE_SCHEMA))
    got, report = imports.migrate(g)
    assert {r.id: r.type for r in got.nodes.collect()} == {"a": "DataStore", "b": "Reference", "c": "Strange"}
    assert {(r.source_id, r.relation, r.target_id) for r in got.edges.collect()} == {("a", "READS_FROM", "b"), ("b", "AFFECTED_BY", "a"), ("c", "DEPENDS_ON", "b"), ("a", "DEPENDS_ON", "c"), ("a", "STORED_IN", "c"), ("a", "odd", "c")}
    r = report.first()
    assert (r.edges, r.renamed, r.turned, r.types) == (6, 5, 2, 2)
    assert {r.relation for r in imports.migrate(g, compat=True)[0].edges.collect()} == {"READS_FROM", "AFFECTED_BY", "DEPENDS_ON", "odd"}


def test_stored_index(spark, tmp_path):
    g = json_io.synthetic(spark, 200, 2)
    index = search.build_index(g)
    search.save_index(index, str(tmp_path / "ix"), 8)
    asked = ["node cache 17", "storage fact"]
    rows = lambda df: {(r.q, r.id): round(r.raw, 9) for r in df.collect()}
    want = rows(search.indexed_search(index, asked))
    assert want and rows(search.stored_search(spark, str(tmp_path / "ix"), asked)) == want == rows(search.indexed_search(search.load_index(spark, str(tmp_path / "ix")), asked))


def test_annotation_rules(spark):
    n = spark.createDataFrame(
        [("datastore:c", "DataStore", "Gamma database", [], []), ("concept:k", "Concept", "Key", ["token service"], ["rotates every signing key weekly"]), ("concept:l", "Concept", "Long name of things", [], [])],
        "id string, type string, name string, alias array<string>, key_facts array<string>",
    )
    g = Graph(conform(n, NODE_SCHEMA), conform(spark.createDataFrame([], EDGE_SCHEMA), EDGE_SCHEMA), conform(spark.createDataFrame([], NOTE_SCHEMA), NOTE_SCHEMA))
    docs = spark.createDataFrame([
        (1, "see the Gamma database now"),  # raw terms agree without the article
        (2, "gamma um database"),  # a filler ends the span
        (3, "they sign keys"),  # one token, and it is the whole name
        (4, "every signing key"),  # the name scores more than the run inside a fact
        (5, "signing weekly"),  # not contiguous in the fact
        (6, None),
    ], "doc_id long, text string")
    got = {(r.doc_id, r.span, r.node_id) for r in annotate.annotate(g, docs).collect()}
    assert {x for x in got if x[0] == 1} == {(1, "Gamma database", "datastore:c")} and not {x for x in got if x[0] in (2, 6)}
    assert (3, "keys", "concept:k") in got and {x for x in got if x[0] == 4} == {(4, "key", "concept:k"), (4, "every signing", "concept:k")} and not {x for x in got if x[0] == 5}


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("threshold", [0.85, 0.7, 0.4])
def test_duplicates_against_brute_force(spark, threshold):
    rng = random.Random(7)
    names = ["", "", "a", "Ä", "order 1", "order 12", "order 12", None]
    for length in (3, 6, 7, 13, 14, 19, 20, 21, 27, 34, 41):
        base = [rng.choice("abcd ") for _ in range(length)]
        for _ in range(9):
            t = list(base)
            for _ in range(rng.randint(0, length // 5 + 1)):
                at, kind = rng.randrange(len(t) + 1), rng.randrange(3)
                t[at : at + (kind > 0)] = [rng.choice("abcd ")] if kind < 2 else []
            names.append("".join(t))
    rows = [(f"n:{i:03d}", rng.choice(["Concept", "Process"]), x, i) for i, x in enumerate(names)]
    want = set()
    for i, (a, kind, x, _) in enumerate(rows):
        for b, other, y, _ in rows[i + 1 :]:
            if kind == other and x is not None and y is not None:
                x1, y1 = x.lower(), y.lower()
                s = 1.0 if x1 == y1 else 1 - _distance(x1, y1) / max(len(x1), len(y1))
                if s >= threshold or x1 in y1 or y1 in x1:
                    want.add((kind, a, b, round(s, 6)))
    nodes = spark.createDataFrame(rows, "id string, type string, name string, ord long")
    got = [tuple(r) for r in quality.duplicates(nodes, threshold, None).select("type", "left_id", "right_id", "similarity").collect()]
    assert len(got) == len(set(got)) and {(*r[:3], round(r[3], 6)) for r in got} == want
    assert quality.duplicate_count(nodes, threshold).first()[0] == len(want)
    none = nodes.limit(0)
    assert quality.duplicates(none, threshold, None).count() == 0 and quality.duplicate_count(none, threshold).first()[0] == 0


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8])
def test_least_scores_against_all_pairs(spark, least):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(words[: 3 + i % 28]) for i in range(n))
    copies = [text(45) for _ in range(4)]
    n = [(f"concept:{i}", rng.choice(["Concept", "Process"]), text(3), rng.choice([*copies, text(45), "short"]), [text(4)], i) for i in range(60)]
    nodes = conform(spark.createDataFrame(n, "id string, type string, name string, description string, key_facts array<string>, ord long"), NODE_SCHEMA)
    e = [(f"concept:{rng.randrange(60)}", "HAS", f"concept:{rng.randrange(60)}") for _ in range(90)]
    g = Graph(nodes, conform(spark.createDataFrame(e, "source_id string, relation string, target_id string"), EDGE_SCHEMA), None)
    every = {(r.source_id, r.target_id): r for r in similarity.score_all(g, zeros=True).collect()}
    some = {(r.source_id, r.target_id): r for r in similarity.score_all(g, least=least).collect()}
    assert len(every) == 60 * 59 // 2 and any(r.C1 > 0 for r in every.values())
    assert set(some) == {k for k, r in every.items() if r.score >= least}
    assert all(abs(some[k][c] - every[k][c]) < 2e-6 for k in some for c in ("score", "C1", "C2"))


def test_least_scores_of_odd_nodes(spark):
    """Rows of one id are one set (before: its pairs came several times), and null values take nothing from their node."""
    n = [(f"concept:{i}", "Concept", f"red w{i % 4}", [None, f"a{i % 3}"], [None] if i % 2 else [f"fact {i % 3}"], [None, "DOC x"], i) for i in range(12)]
    n += [(i, t, "blue", a, f, x, o + 50) for i, t, _, a, f, x, o in n[:3]]
    nodes = conform(spark.createDataFrame(n, "id string, type string, name string, alias array<string>, key_facts array<string>, source_files array<string>, ord long"), NODE_SCHEMA)
    g = Graph(nodes, conform(spark.createDataFrame([("concept:1", "HAS", "concept:2")], "source_id string, relation string, target_id string"), EDGE_SCHEMA), None)
    every = {(r.source_id, r.target_id): r.score for r in similarity.score_all(g, zeros=True).collect()}
    got = [(r.source_id, r.target_id, r.score) for r in similarity.score_all(g, least=0.5).collect()]
    some = {(a, b): s for a, b, s in got}
    assert len(some) == len(got) and set(some) == {k for k, s in every.items() if s >= 0.5} and ("concept:0", "concept:6") in some
    assert 12 < len(some) < 66 and all(abs(every[k] - s) < 2e-6 for k, s in some.items())


def test_score_all_has_all_pairs(spark, tmp_path, monkeypatch):
    """The registered query has each pair that shares a token, whatever its score (before: from 0.5 up), in blocks of few nodes as well."""
    from loomgraph.plans import catalog
    from loomgraph.plans import derive as D

    tables = {
        "region": ("r_regionkey long, r_name string", [(0, "AFRICA"), (1, "ASIA")]), "nation": ("n_nationkey long, n_name string, n_regionkey long", [(0, "KENYA", 0), (1, "CHINA", 1)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey long, s_acctbal double", [(i, f"Supplier#{i}", i % 2, 5.0) for i in range(3)]), "customer": ("c_custkey long, c_name string, c_nationkey long, c_mktsegment string", [(i, f"Customer#{i}", i % 2, "M") for i in range(4)]),
        "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int", [(0, "red rod", "B", "BIG", 1), (1, "red rod", None, None, 1)]), "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate timestamp", [(i, i % 4, "O", "1-HIGH", None) for i in range(5)]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long", [(i, i % 2, i % 3) for i in range(5)]), "documents": ("doc_id long, text string, lang string, source string", [(0, "a", "en", "x")]),
    }
    for name, (kind, rows) in tables.items():
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(similarity, "BLOCK", 4)
    got = [tuple(r) for r in catalog.queries()["score_all"](spark, str(tmp_path)).collect()]
    want = {(r.source_id, r.target_id): (r.score, r.C1, r.C2) for r in similarity.score_all(D.graph(spark, str(tmp_path)), zeros=True).collect()}
    assert len(got) == len(want) == 18 * 17 // 2 and {r[:2] for r in got} == set(want)  # all have the tables as their source
    assert all(abs(x - y) < 2e-6 for r in got for x, y in zip(r[2:], want[r[:2]], strict=True)) and min(r[2] for r in got) < 0.2


def test_name_pairs_have_small_plans(spark):
    """Pairs of names with many and few nodes, from plans of few leaves (before: the nodes were read again for each kind of edit, and such plans filled the driver)."""
    names = ["red rod"] * 20 + ["red rods", "red rod", "rod"] + [f"Customer#{i:09d}" for i in (1, 2, 12, 21, 345)] * 2
    rows = [(f"n:{i:02d}", "Process", x, i) for i, x in enumerate(names)]
    nodes = spark.createDataFrame(rows, "id string, type string, name string, ord long")
    leaves = lambda df: df._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    pairs, count = quality.duplicates(nodes, 0.85, None, ordered=False), quality.duplicate_count(nodes, 0.85)
    assert leaves(pairs) <= 10 and leaves(count) <= 3
    want = set()
    for i, (a, _, x, _) in enumerate(rows):
        for b, _, y, _ in rows[i + 1 :]:
            s = 1 - _distance(x.lower(), y.lower()) / max(len(x), len(y))
            if s >= 0.85 or x in y or y in x:
                want.add((a, b, round(s, 6)))
    got = [(r.left_id, r.right_id, round(r.similarity, 6)) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and count.first()[0] == len(want)


@pytest.mark.parametrize("threshold", [0.7, 0.85])
def test_each_pair_of_names_once(spark, threshold):
    """Pairs of distinct names against all pairs, each with one row, and no more meetings than a few a pair."""
    rng = random.Random(4)
    names = {"".join(rng.choice("ab0") for _ in range(rng.choice([3, 7, 12, 14, 15, 18, 22]))) for _ in range(60)}
    for w in sorted(names):  # one to three edits of any kind, and longer ones
        for _ in range(3):
            v = list(w)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(v))
                v[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "0"])
            names.add("".join(v) or "a")
        names.add(w + "0b0b0b")
    names |= {f"customer#{i:09d}" for i in range(0, 3000, 25)}
    df = spark.createDataFrame([("Process", w) for w in sorted(names)], "type string, name string")
    got = [(r.a, r.b, round(r.similarity, 9)) for r in quality._name_pairs(df, threshold).collect()]

    def distance(x: str, y: str) -> int:
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, e in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
        return row[-1]

    want = []
    for a in names:
        for b in names:
            s = 1 - distance(a, b) / max(len(a), len(b)) if a < b else 0
            if a < b and (s >= threshold or a in b or b in a):
                want.append((a, b, round(s, 9)))
    assert sorted(got) == sorted(want)
    few = df.select("type", "name", F.char_length("name").alias("len"), F.lit(2).alias("k")).where("name like 'customer%'")
    known, rest = quality._few_edits(few)  # before: pairs met on each choice of lost characters
    assert rest.distinct().count() * 40 > rest.count() and known.count() == known.distinct().count()


def test_candidates_share_enough(spark):
    """Two sets of equal weights that share their heaviest token, and too little with it, are no candidates."""
    part = similarity._least_shared(0.5)
    assert abs(0.35 * part / (2 - part) + 0.65 * part - 0.5) < 1e-9 and 0.55 < part < 0.57
    # The ninth token leaves 0.53 of the set: less than equal sets must share, more than half.
    weights = [0.47 / 8] * 8 + [0.0530] * 10
    rows = [(i, f"{i}t{j}" if j < 8 else f"t{j}", w) for i in "ab" for j, w in enumerate(weights)]
    df = spark.createDataFrame([(i, t, float(w)) for i, t, w in rows], "id string, token string, w double")
    assert similarity._candidates(df, 0.5).count() == 0
    assert similarity._candidates(df, 0.45).count() == 1


def test_annotation_of_many_alike(spark):
    """Nodes that the index cannot tell apart are one row with the first twelve of them, and only spans of some field are kept."""
    names = [(f"decision:order_{i}", "Decision", f"Order {i}") for i in range(400)] + [("concept:book", "Concept", "order book"), ("concept:o", "Concept", "Ⅷ 12")]
    nodes = conform(spark.createDataFrame(names, "id string, type string, name string"), NODE_SCHEMA)
    g = Graph(nodes, conform(spark.createDataFrame([], EDGE_SCHEMA), EDGE_SCHEMA), conform(spark.createDataFrame([], NOTE_SCHEMA), NOTE_SCHEMA))
    docs = spark.createDataFrame([(1, "an order of some order books, ORDER 7 and nothing else " * 3), (2, None), (3, "")], "doc_id long, text string")
    index = search.build_index(g)
    got = sorted(annotate.annotate(g, docs).collect())
    assert got and got == sorted(annotate.annotate(g, docs, index).collect())
    assert {(r.span, r.node_id) for r in got} >= {("order", "decision:order_0"), ("order books", "concept:book")}
    for classes, stats, size in (annotate.index_classes(g, None), annotate.index_classes(g, index)):
        rows = classes.collect()  # before: a posting for each word of each node
        assert sum(r.n for r in rows) == 402 and len(rows) < 10
        orders = next(r for r in rows if r.n > 12 and r.dl == 3)
        assert orders.words == "decision order" and orders.ids == sorted(f"decision:order_{i}" for i in range(100, 400))[:12]
        assert {r.term: round(r.idf, 9) for r in stats.collect() if r.term in ("order", "book")} == {r.term: round(r.idf, 9) for r in index[1].collect() if r.term in ("order", "book")}
        assert abs(size.first().avgdl - index[2].first().avgdl) < 1e-9
    terms = annotate.run_terms(nodes)
    assert {r.terms for r in terms.collect()} == {"order", "order book", "book", "o"}
    assert {r.terms for r in annotate.span_rows(docs, annotate.term_bits(terms)).collect()} <= {"order", "order book", "book", "o"}


def test_packed_sets_meet(spark):
    """All pairs that reach the least blend are met, in sets of 1 to 150 tokens, and of large sets few that share one rare token."""
    import math

    rng = random.Random(5)
    sets = []
    for i in range(240):
        size = rng.choice([1, 2, 5, 6, 40, 150])
        base = list(rng.choice(sets)) if sets and i % 2 else []
        own = set(rng.sample(base, int(len(base) * rng.choice([0.4, 0.6, 0.8, 1.0]))))
        sets.append(own | {rng.randrange(3000) for _ in range(rng.choice([0, 1, size // 3, size]))} | {3000 + i % 2})
    own = spark.createDataFrame([(i, t) for i, s in enumerate(sets) for t in s if t >= 3000], "k long, t long")
    far = spark.createDataFrame([(i, t) for i, s in enumerate(sets) for t in s if t < 3000], "k long, t long")
    h = lambda df: df.select("k", F.xxhash64("t").alias("t"))
    count = {}
    for t in (t for s in sets for t in s):
        count[t] = count.get(t, 0) + 1
    w = {t: max(0.05, math.log((len(sets) + 1) / (c + 1)) + 1) for t, c in count.items()}
    total = [sum(w[t] for t in s) for s in sets]
    rare, want = 0, {}
    for i, x in enumerate(sets):
        for j in range(i + 1, len(sets)):
            inter = sum(w[t] for t in x & sets[j])
            want[i, j] = 0.35 * inter / (total[i] + total[j] - inter) + 0.65 * inter / min(total[i], total[j])
            rare += min(len(x), len(sets[j])) >= 30 and any(t < 3000 for t in x & sets[j])
    packed = similarity._packed(h(own), h(far), "test-sets")
    met = {(min(r.a, r.b), max(r.a, r.b)) for r in similarity._met(packed, 0.5).collect()}
    good = {p for p, v in want.items() if v >= 0.5}
    assert len(good) > 60 and good <= met
    assert 2 * sum(min(len(sets[i]), len(sets[j])) >= 30 for i, j in met) < rare  # one shared token is too little
    got = {(r.a, r.b): r.C for r in similarity._blended(spark.createDataFrame(sorted(good), "a long, b long"), packed, "C").collect()}
    assert got.keys() == good and all(abs(got[p] - want[p]) < 1e-9 for p in good)
