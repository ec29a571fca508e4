"""Hand-computed cases of the operators."""

import pytest
from pyspark.sql import functions as F

from cairn.functions import columns as C
from cairn.operators import fusion, graph, ingest, knowledge
from cairn.sources import stores


def cands(spark, rows):
    return spark.createDataFrame([(l, r, "t", i, "", s) for l, r, i, s in rows], "lane string, lane_rank long, target_type string, target_id string, content string, raw_score double")


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_rrf(spark):
    got = fusion.rrf(cands(spark, [("graph", 1, "A", 0.5), ("graph", 2, "B", 0.4), ("vector", 1, "A", 0.9)])).collect()
    assert [(r.target_id, round(r.score, 6)) for r in got] == [("A", round(2 / 61, 6)), ("B", round(1 / 62, 6))]
    assert got[0].sources == "graph+vector"
    got = fusion.rrf(cands(spark, [("graph", 1, "G", 0.1), ("vector", 1, "V", 0.9)]), weights={"graph": 3.0}).collect()
    assert [r.target_id for r in got] == ["G", "V"]
    for bad in ({"k": 0}, {"weights": {"graph": -1.0}}, {"weights": {"nope": 1.0}}):
        with pytest.raises(ValueError):
            fusion.rrf(cands(spark, []), **bad)


def test_recency(spark):
    got = spark.range(1).select(*(C.recency(F.lit(float(d))).alias(str(d)) for d in (0, 14, 28, -3))).first()
    assert list(got) == [1.0, 0.5, 0.25, 1.0]


def test_identifier_text(spark):
    df = spark.createDataFrame([("parseError",), ("parse_error",), ("parse-error",)], "x string")
    assert {r[0] for r in df.select(C.identifier_text(F.col("x"))).collect()} == {"parse error"}


def test_pagerank(spark):
    r = {x.id: x.rank for x in graph.pagerank(edges(spark, [("a", "b"), ("b", "c"), ("c", "a")]), rounds=20).collect()}
    assert all(abs(v - 1 / 3) < 1e-6 for v in r.values()) and abs(sum(r.values()) - 1) < 1e-9
    r = {x.id: x.rank for x in graph.pagerank(edges(spark, [("a", "c"), ("b", "c")]), rounds=20).collect()}
    assert max(r, key=r.get) == "c"
    r = {x.id: x.rank for x in graph.pagerank(edges(spark, [("a", "b"), ("b", "c"), ("c", "d")]), rounds=40, seeds=["a"]).collect()}
    assert r["a"] > r["b"] > r["c"] > r["d"]
    assert graph.pagerank(edges(spark, [("a", "b")]), seeds=[]).count() == 0


def test_betweenness(spark):
    r = {x.id: x.score for x in graph.betweenness(edges(spark, [("a", "b"), ("b", "c")])).collect()}
    assert r == {"a": 0.0, "b": 1.0, "c": 0.0}
    r = {x.id: x.score for x in graph.betweenness(edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])).collect()}
    assert r == {"a": 0.0, "b": 0.5, "c": 0.5, "d": 0.0}


def test_communities_and_components(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("z", "x")])
    lab = {r.id: r.label for r in graph.communities(e).collect()}
    assert len(set(lab.values())) == 2 and lab["a"] == lab["b"] == lab["c"] and lab["x"] == lab["y"] == lab["z"]
    comp = {r.id: r.component for r in graph.components(e).collect()}
    assert comp["c"] == "a" and comp["z"] == "x"


def test_reach_and_paths(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    assert {r.id for r in graph.reach(e, ["d"], 5, reverse=True).collect()} == {"a", "b", "c"}
    assert {r.id for r in graph.reach(e, ["d"], 1, reverse=True).collect()} == {"c"}
    short = edges(spark, [("a", "b"), ("b", "c"), ("a", "c")])
    assert [r.id for r in graph.shortest_path(short, "a", "c").orderBy("step").collect()] == ["a", "c"]
    assert graph.shortest_path(short, "c", "a").count() == 0
    assert [r.id for r in graph.shortest_path(short, "a", "a").collect()] == ["a"]
    assert {r.id: r.in_degree for r in graph.in_degree(short).collect()} == {"b": 1, "c": 2}


def test_reconcile(spark):
    ddl = "id string, subject_key string, predicate string, object string, authority_level string, confidence double, from_s long, until_s long, asserted_s long"
    a = spark.createDataFrame([("1", "s", "p", "x", "primary", 0.9, None, None, 5), ("2", "s", "p", "y", "primary", 0.9, None, None, 5)], ddl)
    b, c = knowledge.reconcile(a, 10)
    row = c.first()
    assert b.count() == 0 and row.severity == 0.9 and row.note == "2 distinct claims"
    a = spark.createDataFrame([("1", "s", "p", "x", "primary", None, None, None, 5), ("2", "s", "p", "y", "secondary", 0.9, None, None, 9)], ddl)
    b, c = knowledge.reconcile(a, 10)
    assert c.count() == 0 and b.first().confidence == 1.0 and b.first().source_id == "1"
    with pytest.raises(ValueError):
        knowledge.reconcile(a, 10, ("primary", "primary"))


def test_chunkers():
    md = ingest.markdown("---\nt: 1\n---\n# A\ntext\n\n```py\nx\n```\npara")
    assert [c["kind"] for c in md] == ["section", "code_block", "paragraph"]
    assert ingest.pack_lines("aaaa\nbbbb\ncccc", 9)[0]["text"] == "aaaa\nbbbb" and ingest.pack_lines(None) == []
    assert [c["kind"] for c in ingest.code_symbols("use x\nfn a() {}\nfn b() {}")] == ["symbol", "symbol"]
    assert ingest.capitalized("We met Ada Lovelace, and Alan Turing. ada lovelace") == ["Ada Lovelace", "Alan Turing"]
    assert ingest.cargo_dependencies("[package]\nname = 'x'\n[dependencies]\nserde = '1'\n[dev-dependencies]\nfoo.workspace = true") == ["foo", "serde"]
    assert ingest.openapi_operations({"paths": {"/a/{id}/": {"get": {"summary": "s"}}}}) == [("GET /a/{}", "s")]


def test_mmr_prefers_variety(spark):
    rows = [("q", "a", 1.0, [1.0, 0.0]), ("q", "b", 0.99, [1.0, 0.0]), ("q", "c", 0.5, [0.0, 1.0]), ("q", "d", 0.1, None)]
    df = spark.createDataFrame(rows, "query string, target_id string, score double, embedding array<double>")
    assert [r.target_id for r in fusion.mmr(df, 0.5).orderBy("mmr_rank").collect()][:2] == ["a", "c"]
    assert [r.target_id for r in fusion.mmr(df, 1.0).orderBy("mmr_rank").collect()] == ["a", "b", "c", "d"]


def test_scalars(spark):
    df = spark.createDataFrame([("http://h/api/12/a?x=1", "/src/.env", "Fix  the\n line")], "u string, p string, t string")
    r = df.select(C.route(F.col("u")).alias("u"), C.secret_file(F.col("p")).alias("p"), C.normalize_name(F.col("t")).alias("t"), C.label(F.col("t")).alias("l"), C.query_shape(F.lit("a::b() fn_x call")).alias("q")).first()
    assert (r.u, r.p, r.t, r.l, r.q) == ("/api/{param}/a", True, "fix the line", "Fix  the", "code")


def test_stores(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x")
    (tmp_path / ".env").write_text("secret")
    got = stores.read_files(spark, f"file://{tmp_path}").collect()
    assert [r.text for r in got] == ["x"]
    v = spark.createDataFrame([("1", [1.0])], "id string, embedding array<double>")
    stores.write_vectors(v, f"file://{tmp_path}/v", {"model": "m", "dimensions": "1"})
    assert stores.read_vectors(spark, f"file://{tmp_path}/v", {"model": "m"}).count() == 1
    with pytest.raises(stores.SpaceMismatch):
        stores.read_vectors(spark, f"file://{tmp_path}/v", {"model": "n"})


def test_stream_matches_batch(spark, tmp_path):
    from cairn.streaming import events

    ddl = events.SCHEMA.replace("ts timestamp_ntz", "t string")
    rows = [(i, f"2024-01-01 0{i % 3}:10:00", i % 2, "k", 1.0, "{}") for i in range(30)]
    spark.createDataFrame(rows, ddl).selectExpr("event_id", "cast(t as timestamp_ntz) ts", "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/in/0")
    s = events.read(spark, f"{tmp_path}/in/*")
    got = events.run_once(events.windows(s, "1 hour"), "w_test", "complete", f"{tmp_path}/c1")
    assert sorted(r.n for r in got.collect()) == [10, 10, 10]
    once = events.run_once(events.once(events.read(spark, f"{tmp_path}/in/*")), "o_test", "append", f"{tmp_path}/c2")
    assert once.count() == 30
