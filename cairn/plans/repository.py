"""Queries of the write path, identity, repository reads and deletes, consolidation, ingestion look-ups and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import fusion, graph, ingest, lanes
from cairn.operators import repository as R
from cairn.plans.graphs import E, HUBS, SINKS, hubs, sinks
from cairn.plans.retrieval import BM, BM25, QVEC, VEC, L2, vectors
from cairn.sources.domain import call_edges, chunks, entities, memories, table, views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


# -- filters and search steps
@query("scope_or_global", views("memories") + " SELECT id FROM memories WHERE tenant = 't1' AND (expires_s IS NULL OR session = '5') AND confidence IS NULL")
def scope_or_global(spark, sf):
    m = memories(spark, sf).withColumn("session", F.when(F.col("expires_s").isNotNull(), F.col("session"))).withColumn("workspace", F.col("confidence").cast("string"))
    return m.filter(R.scope_or_global("t1", session="5", workspace=None)).select("id")


@query("repository_filter", "SELECT page_id FROM pages WHERE contains(lower('[GitHub.com/Org' || (page_id % 7) || '/Repo' || (page_id % 5) || '] ' || url), 'org3/repo2')")
def repository_filter(spark, sf):
    k = F.col("page_id")
    prov = F.concat(F.lit("[GitHub.com/Org"), (k % 7).cast("string"), F.lit("/Repo"), (k % 5).cast("string"), F.lit("] "), F.col("url"))
    return table(spark, sf, "pages").filter(R.repository_matches(prov, "git@github.com:Org3/Repo2.git")).select("page_id")


@query("target_type_filter", "SELECT event_type, count(*) AS n FROM (SELECT CASE event_type WHEN 'click' THEN 'entity' WHEN 'view' THEN 'chunk' ELSE 'memory' END AS t, event_type FROM events) WHERE t IN ('entity', 'chunk') GROUP BY 1")
def target_type_filter(spark, sf):
    kind = F.when(F.col("event_type") == "click", "entity").when(F.col("event_type") == "view", "chunk").otherwise("memory")
    return table(spark, sf, "events").filter(R.target_allowed(kind, True)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("score_threshold", "SELECT count(*) FILTER (value / 100 >= 0.3) AS kept, count(*) FILTER (NOT coalesce(value / 100 >= 0.3, false)) AS dropped FROM events")
def score_threshold(spark, sf):
    kept, dropped = R.threshold(table(spark, sf, "events").select((F.col("value") / 100).alias("score")), 0.3)
    return kept.agg(F.count(F.lit(1)).alias("kept")).crossJoin(dropped)  # one row each


@query("concept_link_filter", "SELECT p_partkey AS id FROM part WHERE lower(trim(p_name)) IN ('part 1', 'part 2') OR (strlen(lower(trim(p_name))) > 8 AND lower(trim(p_name)) NOT IN ('part 1000', 'part 1001'))")
def concept_link_filter(spark, sf):
    return table(spark, sf, "part").filter(R.concept_links(F.col("p_name"), ["part 1", "part 2"], ["part 1000", "part 1001"])).select(F.col("p_partkey").alias("id"))


@query("lexical_results", f"WITH {BM25} SELECT target_id, lane_rank, text AS content FROM lex JOIN documents ON cast(doc_id AS varchar) = target_id")
def lexical_results(spark, sf):
    d = table(spark, sf, "documents")
    hits = lanes.bm25(d, BM, "doc_id", "text", 20).drop("content")
    docs = d.select(F.col("doc_id").cast("string").alias("id"), "text")
    return R.resolve_content(hits, docs, entities(spark, sf)).select("target_id", "lane_rank", "content")


@query("entity_search", views("entities") + " SELECT id, name FROM entities WHERE contains(lower(concat_ws(' ', name, kind, type)), 'brand#3') OR contains(lower(concat_ws(' ', name, kind, type)), 'steel') ORDER BY id LIMIT 40")
def entity_search(spark, sf):
    return R.entity_search(entities(spark, sf), "Brand#3 steel x", 40, ("name", "kind", "type")).select("id", "name")


@query("cross_encoder_rerank", "SELECT item_id, score FROM (SELECT item_id, item_id AS lane_rank, round((contains(lower(text), 'the')::int * 2 + contains(lower(text), 'a')::int) / (1 + ln(length(text))), 6) AS score FROM benchmark) ORDER BY score DESC, lane_rank LIMIT 15")
def cross_encoder_rerank(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.col("item_id").alias("lane_rank"), F.col("text").alias("content"))
    has = lambda t, w: F.lower(t).contains(w).cast("int")
    return R.cross_rerank(b, lambda t: F.round((has(t, "the") * 2 + has(t, "a")) / (1 + F.log(F.length(t))), 6), 15).select("item_id", "score")


@query("degraded_recall", f"WITH {VEC.format(s=L2)} SELECT 'vector' AS lane, 'ok' AS severity, count(*) AS n FROM vec UNION ALL SELECT 'lexical', 'degraded', 0 UNION ALL SELECT 'sparse', 'warning', 0")
def degraded_recall(spark, sf):
    """The vector lane answers, the lexical lane's column doesn't exist, no lane is called sparse."""
    run = {"vector": lambda: lanes.vector(vectors(spark, sf), QVEC, 20), "lexical": lambda: lanes.bm25(table(spark, sf, "documents"), BM, "doc_id", "no_such_column", 20)}
    got, failures = R.recall(run, ["semantic", "lexical", "sparse"])
    bad = spark.createDataFrame([(lane, severity, 0) for lane, severity, _ in failures], "lane string, severity string, n long")
    return got.groupBy("lane").agg(F.count(F.lit(1)).alias("n")).select("lane", F.lit("ok").alias("severity"), "n").unionByName(bad)


# -- graph
def _reach_sql(start: str, a: str, b: str, depth: int, name: str) -> str:
    return f"{name} AS (SELECT {b} AS id, 1 AS hops FROM e WHERE {a} IN ({start}) UNION SELECT e.{b}, {name}.hops + 1 FROM {name} JOIN e ON e.{a} = {name}.id WHERE {name}.hops < {depth})"


WALK = E.replace("WITH ", "WITH RECURSIVE ") + ", e AS (SELECT DISTINCT src, dst FROM edges), "
HUB = HUBS.replace("LIMIT 3", "LIMIT 1")
SINK = SINKS.replace("LIMIT 3", "LIMIT 1")


@query("symbol_context", WALK + _reach_sql(HUB, "dst", "src", 2, "u") + ", " + _reach_sql(HUB, "src", "dst", 2, "d") + " SELECT 'caller' AS side, id, min(hops) AS hops FROM u GROUP BY id UNION ALL SELECT 'callee', id, min(hops) FROM d GROUP BY id")
def symbol_context(spark, sf):
    e = call_edges(spark, sf)
    return R.symbol_context(e, hubs(e)[0], 2)


@query("process_flow", WALK + _reach_sql(HUB, "src", "dst", 3, "d") + f", h AS ({HUB}) SELECT src AS id, true AS is_entry FROM h UNION ALL SELECT DISTINCT id, false FROM d WHERE id NOT IN (SELECT src FROM h)")
def process_flow(spark, sf):
    e = call_edges(spark, sf)
    return R.process_flow(e, hubs(e)[0], 3)


@query("bounded_reach", WALK + _reach_sql(SINK, "dst", "src", 4, "u") + " SELECT id, hops, (SELECT count(DISTINCT id) FROM u) > 10 AS truncated FROM (SELECT id, min(hops) AS hops FROM u GROUP BY id) ORDER BY hops, id LIMIT 10")
def bounded_reach(spark, sf):
    e = call_edges(spark, sf)
    return graph.reach_bounded(e, sinks(e)[0], 4, 10)


@query("dependency_path", WALK + f"h AS ({HUB}), " + _reach_sql("SELECT src FROM h", "src", "dst", 12, "w").replace("UNION SELECT e.dst, w.hops + 1 FROM w JOIN e ON e.src = w.id WHERE w.hops < 12", "UNION SELECT e.dst, w.hops + 1 FROM w JOIN e ON e.src = w.id WHERE w.hops < 6")
  + """, d AS (SELECT id, min(hops) AS hops FROM w WHERE id NOT IN (SELECT src FROM h) GROUP BY id UNION ALL SELECT src, 0 FROM h), far AS (SELECT id, hops FROM d ORDER BY hops DESC, id LIMIT 1),
  p AS (SELECT id, hops AS step FROM far UNION ALL SELECT (SELECT min(e.src) FROM e JOIN d ON d.id = e.src WHERE e.dst = p.id AND d.hops = p.step - 1), p.step - 1 FROM p WHERE p.step > 0) SELECT cast(step AS integer) AS step, id FROM p""")
def dependency_path(spark, sf):
    """From the largest hub to the node that is farthest from it within six hops."""
    e = call_edges(spark, sf)
    start = hubs(e)[0]
    far = graph.reach(e, [start], 6).filter(F.col("id") != start).orderBy(F.desc("hops"), "id").first()
    return graph.shortest_path(e, start, far["id"])


SNAP = "a AS (SELECT p_partkey AS id, p_brand AS h FROM part WHERE p_partkey % 10 <> 0), b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN 'x' ELSE p_brand END AS h FROM part WHERE p_partkey % 9 <> 0)"


@query("whats_changed", E + f", {SNAP}, c AS (SELECT id, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b USING (id) WHERE a.h IS NULL OR b.h IS NULL OR a.h <> b.h) SELECT id, change, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM c LEFT JOIN (SELECT dst AS id, count(*) AS i FROM edges GROUP BY 1) USING (id) LEFT JOIN (SELECT src AS id, count(*) AS o FROM edges GROUP BY 1) USING (id)")
def whats_changed(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    old = p.filter(k % 10 != 0).select(k.alias("id"), F.col("p_brand").alias("hash"))
    new = p.filter(k % 9 != 0).select(k.alias("id"), F.when(k % 6 == 0, "x").otherwise(F.col("p_brand")).alias("hash"))
    return R.whats_changed(call_edges(spark, sf), old, new)


def _brands(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"))


@query("label_overview", "SELECT count(*) AS n_communities, max(n) AS largest FROM (SELECT count(*) AS n FROM part GROUP BY p_brand)")
def label_overview(spark, sf):
    return R.overview(_brands(spark, sf))


@query("member_index", "SELECT p_brand AS label, p_partkey AS id FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 5")
def member_index(spark, sf):
    return R.member_index(_brands(spark, sf), 5)


@query("community_of", "SELECT p_partkey AS id, p_brand AS label FROM part WHERE p_partkey = 7")
def community_of(spark, sf):
    return R.community_of(_brands(spark, sf), 7)


@query("community_members", E + ", m AS (SELECT p_partkey AS id FROM part WHERE p_brand = 'Brand#11' ORDER BY 1 LIMIT 200 OFFSET 2) SELECT DISTINCT src, dst FROM edges WHERE src IN (SELECT id FROM m) AND dst IN (SELECT id FROM m) ORDER BY src, dst LIMIT 300")
def community_members(spark, sf):
    return R.community_page(_brands(spark, sf), call_edges(spark, sf), "Brand#11", 2, 200)[1]


@query("endpoint_projection", E + " SELECT 'part-' || src AS subject_id, a.p_name AS subject_name, 'part-' || dst AS object_id, b.p_name AS object_name FROM edges JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst")
def endpoint_projection(spark, sf):
    p = table(spark, sf, "part")
    side = lambda c, n: p.select(F.col("p_partkey").alias(c), F.concat(F.lit("part-"), "p_partkey").alias(f"{n}_id"), R.entity_key(F.col("p_name"), F.col("p_partkey").cast("string")).alias(f"{n}_name"))
    return R.endpoints_only(call_edges(spark, sf).join(side("src", "subject"), "src").join(side("dst", "object"), "dst"))


@query("calls_in_spans", """WITH s AS (SELECT user_id, event_id AS first, event_id + 400 AS last, 'f' || (event_id % 50) AS caller FROM events WHERE value > 90), c AS (SELECT user_id, event_id AS line, 'f' || (event_id % 60) AS callee FROM events WHERE event_type = 'click'),
  k AS (SELECT DISTINCT 'f' || (event_id % 50) AS name FROM events) SELECT DISTINCT caller, callee FROM (SELECT c.*, s.caller, row_number() OVER (PARTITION BY c.user_id, c.line, c.callee ORDER BY s.first, s.caller) AS r FROM c JOIN s ON c.user_id = s.user_id AND c.line BETWEEN s.first AND s.last WHERE c.callee IN (SELECT name FROM k)) WHERE r = 1 AND caller <> callee""")
def calls_in_spans(spark, sf):
    e = table(spark, sf, "events")
    name = lambda n: F.concat(F.lit("f"), (F.col("event_id") % n).cast("string"))
    spans = e.filter("value > 90").select("user_id", F.col("event_id").alias("first"), (F.col("event_id") + 400).alias("last"), name(50).alias("caller"))
    calls = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("line"), name(60).alias("callee"))
    return R.calls_in_spans(calls, spans, e.select(name(50).alias("name")), "user_id")


# -- repository
def _graphs(spark, sf):
    n = table(spark, sf, "nation")
    return n.select(F.concat(F.lit("g"), "n_nationkey").alias("graph_id"), F.concat(F.lit("host/org/r"), "n_regionkey").alias("stable_source_key"))


def _owned(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("g"), "c_nationkey").alias("graph_id"))


def _related(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("g"), "s_nationkey").alias("graph_id"))


@query("entities_by_source", "SELECT c_custkey AS id FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2")
def entities_by_source(spark, sf):
    return R.by_source(_owned(spark, sf), _graphs(spark, sf), "host/org/r2").select("id")


@query("graphs_by_source", "SELECT 'g' || n_nationkey AS graph_id FROM nation WHERE n_regionkey = 3")
def graphs_by_source(spark, sf):
    return R.graphs_of(_graphs(spark, sf), "host/org/r3").select("graph_id")


@query("chunks_by_document", views("chunks") + " SELECT position, text FROM chunks WHERE doc_id = 3")
def chunks_by_document(spark, sf):
    return R.chunks_of(chunks(spark, sf), 3).select(F.col("position").cast("long").alias("position"), "text")


@query("delete_graph", """SELECT 'graph' AS kind, count(*) AS n FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'entity', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1
  UNION ALL SELECT 'relationship', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 1""")
def delete_graph(spark, sf):
    g = _graphs(spark, sf)
    left = R.delete_graphs(g, _owned(spark, sf), _related(spark, sf), R.graphs_of(g, "host/org/r1"))
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, t in zip(("graph", "entity", "relationship"), left)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("delete_entities", views("entities") + " SELECT id FROM entities WHERE kind <> 'Brand#12'")
def delete_entities(spark, sf):
    e = entities(spark, sf)
    return R.delete(e, e.filter("kind = 'Brand#12'")).select("id")


@query("retract_prior_graphs", "SELECT 'chunk' AS kind, doc_id FROM documents WHERE NOT (doc_id % 3 = 0 AND source IN (SELECT source FROM documents WHERE doc_id % 30 = 0)) UNION ALL SELECT DISTINCT 'graph', doc_id FROM documents WHERE NOT (doc_id % 3 = 0 AND source IN (SELECT source FROM documents WHERE doc_id % 30 = 0))")
def retract_prior_graphs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("source_key"), (F.col("doc_id") % 3).alias("path"))
    g, c = R.retract_prior(d, d, d.filter("doc_id % 30 = 0").select("source_key", "path"))
    return c.select(F.lit("chunk").alias("kind"), "doc_id").unionByName(g.select(F.lit("graph").alias("kind"), "doc_id").distinct())


@query("repository_gc", "SELECT r_regionkey AS id FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey % 5 = 0)")
def repository_gc(spark, sf):
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_regionkey").alias("source_key"))
    return R.gc_repositories(r, table(spark, sf, "nation").filter("n_nationkey % 5 = 0").select(F.col("n_regionkey").alias("source_key"))).select("id")


@query("concepts_of_scheme", views("concepts") + " SELECT id, pref_label FROM concepts WHERE scheme_id = 'Brand#13'")
def concepts_of_scheme(spark, sf):
    from cairn.sources.domain import concepts

    return concepts(spark, sf).filter("scheme_id = 'Brand#13'").orderBy("id").select("id", "pref_label")


# -- identity and writes
@query("put_contradictions", "WITH x AS (SELECT event_id AS id, cast(user_id % 3 AS varchar) AS scope, event_id % 40 AS a, user_id % 40 AS b FROM events), o AS (SELECT * FROM x WHERE id % 10 = 0), n AS (SELECT *, least(a, b) AS p, greatest(a, b) AS q FROM x WHERE id % 10 <> 0) SELECT id FROM o UNION ALL SELECT min(id) FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.scope = n.scope AND least(o.a, o.b) = p AND greatest(o.a, o.b) = q) GROUP BY scope, p, q")
def put_contradictions(spark, sf):
    x = table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 3).cast("string").alias("scope"), (F.col("event_id") % 40).alias("a"), (F.col("user_id") % 40).alias("b"))
    return R.put_contradictions(x.filter("id % 10 = 0"), x.filter("id % 10 <> 0")).select("id")


@query("merge_memory_entities", "SELECT p_partkey AS id, upper(p_name) || ';' || p_type || CASE WHEN lower(p_brand) IN (lower(p_name), lower(p_type)) THEN '' ELSE ';' || p_brand END AS names FROM part")
def merge_memory_entities(spark, sf):
    p = table(spark, sf, "part")
    got = R.merge_memory_entities(F.array(F.upper("p_name"), F.col("p_type")), F.array("p_name", "p_brand"))
    return p.select(F.col("p_partkey").alias("id"), F.array_join(got, ";").alias("names"))


@query("resolve_entities", """WITH x AS (SELECT p_brand AS key, list_sort(list_distinct(list(p_type))) AS aliases FROM part WHERE p_partkey % 4 = 0 AND p_brand < 'Brand#4' GROUP BY 1), n AS (SELECT p_brand AS key, list_sort(list_distinct(list(p_type))) AS new FROM part WHERE p_partkey % 4 <> 1 OR p_brand < 'Brand#2' GROUP BY 1)
  SELECT key, CASE WHEN aliases IS NULL THEN 'created' WHEN list_has_all(aliases, new) THEN 'matched' ELSE 'merged' END AS outcome, array_to_string(list_sort(list_distinct(list_concat(coalesce(aliases, []), new))), ';') AS aliases FROM n LEFT JOIN x USING (key)""")
def resolve_entities(spark, sf):
    p = table(spark, sf, "part")
    old = p.filter("p_partkey % 4 = 0 and p_brand < 'Brand#4'").groupBy(F.col("p_brand").alias("key")).agg(F.array_sort(F.collect_set("p_type")).alias("aliases"))
    new = p.filter("p_partkey % 4 <> 1 or p_brand < 'Brand#2'").select(F.col("p_brand").alias("key"), F.col("p_type").alias("alias"))
    return R.resolve_entities(old, new).withColumn("aliases", F.array_join("aliases", ";"))


@query("resolve_relationships", E + """, o AS (SELECT src, dst, list(DISTINCT order_id) AS ev, NULL::double AS c FROM edges WHERE order_id % 2 = 0 GROUP BY 1, 2), n AS (SELECT src, dst, list(DISTINCT order_id) AS nv, max((order_id % 10) / 10.0::double) AS nc FROM edges WHERE order_id % 3 = 0 GROUP BY 1, 2)
  SELECT src, dst, len(list_distinct(list_concat(coalesce(ev, []), coalesce(nv, [])))) AS n_evidence, coalesce(c, nc) AS confidence FROM o FULL JOIN n USING (src, dst)""")
def resolve_relationships(spark, sf):
    e = call_edges(spark, sf)
    old = e.filter("order_id % 2 = 0").groupBy("src", "dst").agg(F.collect_set("order_id").alias("evidence"), F.lit(None).cast("double").alias("confidence"))
    new = e.filter("order_id % 3 = 0").select("src", "dst", F.col("order_id").alias("target_id"), ((F.col("order_id") % 10) / F.lit(10.0)).alias("confidence"))
    return R.resolve_relationships(old, new, ["src", "dst"]).select("src", "dst", F.size("evidence").cast("long").alias("n_evidence"), "confidence")


WRITES = """r AS (SELECT event_id AS id, CASE WHEN event_id % 17 = 0 THEN ' ' ELSE 't' || (user_id % 3) END AS tenant, cast(user_id AS varchar) AS subject, CASE WHEN event_id % 5 <> 0 THEN event_type END AS idem, CASE WHEN event_id % 23 = 0 THEN '' ELSE event_type END AS text, CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END AS export FROM events),
  s AS (SELECT tenant, subject, idem, min(id) AS had FROM r WHERE id % 11 = 0 AND idem IS NOT NULL AND tenant <> ' ' GROUP BY 1, 2, 3), v AS (SELECT *, CASE WHEN trim(tenant) = '' THEN 'tenant_blank' WHEN text = '' THEN 'text_blank' WHEN export = 1 THEN 'training_export' WHEN subject = '3' THEN 'policy_denied' END AS reason FROM r WHERE id % 11 <> 0),
  f AS (SELECT tenant, subject, idem, min(id) AS first FROM v WHERE reason IS NULL AND idem IS NOT NULL GROUP BY 1, 2, 3)"""


def _requests(spark, sf):
    k = F.col("event_id")
    return table(spark, sf, "events").select(
        k.alias("id"), F.when(k % 17 == 0, " ").otherwise(F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string"))).alias("tenant"), F.col("user_id").cast("string").alias("subject"),
        F.when(k % 5 != 0, F.col("event_type")).alias("idem"), F.when(k % 23 == 0, "").otherwise(F.col("event_type")).alias("text"), F.lit("log").alias("source"),
        F.when(k % 29 == 0, F.array(F.lit("training_export"))).otherwise(F.array().cast("array<string>")).alias("allowed_uses"),
    )


@query("write_memory", f"WITH {WRITES} SELECT id, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN idem IS NULL OR (had IS NULL AND id = first) THEN 'stored' ELSE 'deduplicated' END AS outcome, reason, CASE WHEN reason IS NULL THEN CASE WHEN idem IS NULL THEN id ELSE coalesce(had, first) END END AS stored_id FROM v LEFT JOIN s USING (tenant, subject, idem) LEFT JOIN f USING (tenant, subject, idem)")
def write_memory(spark, sf):
    """A batch of requests against what is stored: blank fields, exports and subject 3 are refused, repeats are answered with the first."""
    r = _requests(spark, sf)
    key = ["tenant", "subject", "idem"]
    stored = r.filter("id % 11 = 0 and idem is not null and tenant <> ' '").groupBy(*key).agg(F.min("id").alias("id"))
    return R.write_memories(r.filter("id % 11 <> 0"), stored, key, "id", F.col("subject") != "3")[0]


@query("update_status", views("memories") + " SELECT id, CASE WHEN session = '4' THEN 'archived' ELSE status END AS status FROM memories")
def update_status(spark, sf):
    m = memories(spark, sf)
    return R.update_status(m, m.filter("session = '4'").select("id"), "archived").select("id", "status")


# -- consolidation and evaluation
@query("composite_executor", "SELECT event_type AS task, coalesce(arg_min(s, event_id) FILTER (s <> 'skipped'), 'skipped') AS status, cast(sum(CASE WHEN value > 20 THEN 1 END) AS bigint) AS n_read, cast(sum(CASE WHEN value > 1000 THEN 1 END) AS bigint) AS n_written FROM (SELECT *, CASE user_id % 3 WHEN 0 THEN 'skipped' WHEN 1 THEN 'done' ELSE 'failed' END AS s FROM events) GROUP BY 1")
def composite_executor(spark, sf):
    u = F.col("user_id") % 3
    e = table(spark, sf, "events").select(F.col("event_type").alias("task"), F.col("event_id").alias("executor"), F.when(u == 0, "skipped").when(u == 1, "done").otherwise("failed").alias("status"),
                                          F.when(F.col("value") > 20, 1).alias("n_read"), F.when(F.col("value") > 1000, 1).alias("n_written"))
    return R.composite(e)


@query("evaluation_gate", "SELECT item_id AS case_id, 'case failed: ' || item_id AS error FROM benchmark WHERE item_id % 4 = 0")
def evaluation_gate(spark, sf):
    return R.evaluation_gate(table(spark, sf, "benchmark").select(F.col("item_id").alias("case_id"), F.when(F.col("item_id") % 4 == 0, 2).otherwise(0).alias("failures")))


@query("capability_coverage", "SELECT DISTINCT p_type AS capability FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_size > 45)")
def capability_coverage(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_type").alias("capability"), "p_size")
    return R.uncovered(p, p.filter("p_size > 45"))


@query("pass_summary", "SELECT user_id % 3 AS pass, count(*) AS n, round(avg(value), 4) AS avg_ms, round(avg((value > 10)::int), 6) AS coverage, round(avg((event_type = 'click')::int), 6) AS hit_rate FROM events GROUP BY 1")
def pass_summary(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 3).alias("pass"), F.col("value").alias("ms"), (F.col("value") > 10).alias("covered"), (F.col("event_type") == "click").alias("hit"))
    return R.pass_summary(e).select("pass", "n", F.round("avg_ms", 4).alias("avg_ms"), F.round("coverage", 6).alias("coverage"), F.round("hit_rate", 6).alias("hit_rate"))


# -- ingestion
EXT = "['rs', 'md', 'png', 'py', 'toml', 'so']"


@query("file_classes", f"SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 3) THEN 'code' WHEN doc_id % 6 IN (1, 4) THEN 'text' WHEN doc_id % 7 = 0 THEN 'code' ELSE 'none' END AS kind FROM (SELECT doc_id, 'src/x' || doc_id || '.' || ({EXT})[doc_id % 6 + 1] AS p FROM documents)")
def file_classes(spark, sf):
    k = F.col("doc_id")
    ext = F.element_at(F.array(*map(F.lit, ("rs", "md", "png", "py", "toml", "so"))), (k % 6 + 1).cast("int"))
    path = F.when((k % 7 == 0) & (k % 6).isin(2, 5), "deploy/Dockerfile").otherwise(F.concat(F.lit("src/x"), k.cast("string"), F.lit("."), ext))
    return table(spark, sf, "documents").select("doc_id", R.classify_file(path).alias("kind"))


@query("source_keys", "SELECT p_partkey AS id, 'github.com/org' || (p_partkey % 4) || '/' || lower(p_brand) AS key FROM part")
def source_keys(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey") % 4
    tail = F.concat(F.lit("Org"), k.cast("string"), F.lit("/"), F.col("p_brand"))
    url = F.when(k == 0, F.concat(F.lit("git@GitHub.com:"), tail, F.lit(".git"))).when(k == 1, F.concat(F.lit("https://user:pw@github.com/"), tail, F.lit("/"))).when(k == 2, F.concat(F.lit("ssh://git@github.com:22/"), tail, F.lit(".git"))).otherwise(F.concat(F.lit("github.com/"), tail))
    return p.select(F.col("p_partkey").alias("id"), R.source_key(url).alias("key"))


OPS = "ops AS (SELECT upper(['get', 'put', 'post'][p_partkey % 3 + 1]) || ' /' || (p_size % 12) || '/{}' AS key, p_brand AS ref, p_name AS meta, p_partkey AS ts FROM part)"


def _operations(spark, sf):
    p = table(spark, sf, "part")
    method = F.element_at(F.array(F.lit("get"), F.lit("put"), F.lit("post")), (F.col("p_partkey") % 3 + 1).cast("int"))
    path = F.concat(F.lit("/"), (F.col("p_size") % 12).cast("string"), F.lit("/{id}/"))
    return p.select(R.contract_key(method, path).alias("key"), F.col("p_brand").alias("source_ref"), F.col("p_name").alias("metadata"), F.col("p_partkey").alias("ts"))


@query("api_entities", f"WITH {OPS} SELECT key, string_agg(DISTINCT ref, ';' ORDER BY ref) AS refs, arg_max(meta, ts) AS metadata FROM ops GROUP BY 1")
def api_entities(spark, sf):
    return R.api_entities(_operations(spark, sf)).select("key", F.array_join("source_refs", ";").alias("refs"), "metadata")


@query("api_retract", f"WITH {OPS} SELECT key, string_agg(DISTINCT ref, ';' ORDER BY ref) AS refs FROM ops WHERE ref <> 'Brand#11' GROUP BY 1")
def api_retract(spark, sf):
    return R.retract_source(R.api_entities(_operations(spark, sf)), "Brand#11").select("key", F.array_join("source_refs", ";").alias("refs"))


@query("exposes_edges", f"WITH {OPS} SELECT DISTINCT sha256('exposes' || chr(31) || ref || chr(31) || key) AS id, ref AS source_ref, key, 0.95::double AS confidence FROM ops")
def exposes_edges(spark, sf):
    return R.exposes(_operations(spark, sf))


@query("yaml_faults", r"SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'indent' WHEN doc_id % 4 = 1 THEN 'anchor' END AS fault FROM documents")
def yaml_faults(spark, sf):
    k = F.col("doc_id") % 4
    text = F.when(k == 0, F.concat(F.lit("a:\n"), F.repeat(F.lit(" "), F.lit(80)), F.lit("b: 1"))).when(k == 1, "a: &x 1\nb: *x").otherwise("a: 1\nb:\n  - c & d\n")
    return table(spark, sf, "documents").select("doc_id", R.yaml_fault(text).alias("fault"))


@query("repo_labels", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'org/r' || (page_id % 9) ELSE 'scan' END AS label FROM pages")
def repo_labels(spark, sf):
    k = F.col("page_id")
    prov = F.when(k % 2 == 0, F.concat(F.lit("scan [org/r"), (k % 9).cast("string"), F.lit("] x"))).otherwise(F.concat(F.lit("scan:"), F.col("url")))
    return table(spark, sf, "pages").select("page_id", R.repo_label(prov).alias("label"))


@query("evidence_of_relationship", E + " SELECT DISTINCT unnest(['order-' || order_id, 'scan-' || (order_id % 5)]) AS ref FROM (SELECT order_id FROM edges ORDER BY order_id, src, dst LIMIT 1)")
def evidence_of_relationship(spark, sf):
    e = call_edges(spark, sf).orderBy("order_id", "src", "dst").limit(1)
    r = e.select(F.lit("rel").alias("id"), F.array(F.concat(F.lit("order-"), "order_id")).alias("evidence"), F.array(F.concat(F.lit("scan-"), (F.col("order_id") % 5).cast("string"))).alias("provenance"))
    return R.evidence_for("relationship", "rel", r, r, r)


@query("embed_stub", "WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark), a AS (SELECT item_id, list_transform(ws, lambda x: cast(cast('0x' || substr(sha256(x), 1, 8) AS bigint) % 8 AS integer)) AS b FROM w) SELECT item_id, CASE WHEN len(b) > 0 THEN array_to_string(list_transform(range(0, 8), lambda d: len(list_filter(b, lambda x: x = d))), ',') END AS embedding FROM a")
def embed_stub(spark, sf):
    e = R.embed(table(spark, sf, "benchmark"), "text", 8)
    return e.select("item_id", F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), ",").alias("embedding"))


@query("co_mentions", views("chunks") + ", n AS (SELECT DISTINCT regexp_extract(text, '[A-Za-z0-9_$]+') AS name FROM benchmark) SELECT DISTINCT doc_id || ':' || position AS chunk_id, name FROM (SELECT doc_id, position, unnest(regexp_extract_all(text, '[A-Za-z0-9_$]+')) AS name FROM chunks) WHERE name IN (SELECT name FROM n)")
def co_mentions(spark, sf):
    c = chunks(spark, sf).select(F.concat_ws(":", "doc_id", "position").alias("chunk_id"), "text")
    names = table(spark, sf, "benchmark").select(F.regexp_extract("text", r"[A-Za-z0-9_$]+", 0).alias("name")).distinct()
    return ingest.co_mentions(c, names)


@query("seeded_associative", E + ", v AS (SELECT p_partkey AS id FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_name), 'blue')) SELECT cast(id AS varchar) AS id FROM v")
def seeded_associative(spark, sf):
    """The seeds that a query's words name; associative ranking starts from these."""
    e = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return lanes.resolve_seeds(e, "(Red) blue!").select(F.col("id").cast("string").alias("id"))


@query("lane_type_filter", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def lane_type_filter(spark, sf):
    from cairn.operators import filters

    kind = F.when(F.col("event_type") == "click", "entity").when(F.col("event_type") == "view", "chunk").otherwise("belief")
    return table(spark, sf, "events").filter(kind.isin(filters.lane_types(["code", "docs", "nothing"]))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("rrf_of_id_lists", "WITH l AS (SELECT p_partkey AS id, 'a' AS lane, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS r FROM part QUALIFY r <= 30 UNION ALL SELECT p_partkey, 'b', row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part QUALIFY r <= 30) SELECT cast(id AS varchar) AS target_id, round(sum(1.0::double / (60 + r)), 6) AS score FROM l GROUP BY 1")
def rrf_of_id_lists(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("target_id"), F.lit("").alias("content"), "p_size", "p_retailprice")
    a = lanes.candidates(p.withColumn("raw_score", F.col("p_size").cast("double")), "vector", "entity", 30)
    b = lanes.candidates(p.withColumn("raw_score", F.col("p_retailprice").cast("double")), "lexical", "entity", 30)
    return fusion.rrf(a.unionByName(b)).select(F.col("target_id").cast("string").alias("target_id"), F.round("score", 6).alias("score"))
