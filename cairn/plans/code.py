"""Queries of code scanners, look-ups, evidence and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import columns as C
from cairn.operators import codegraph as G
from cairn.sources.domain import call_edges, chunks, entities, table, views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


CODE_SQL = """code AS (SELECT doc_id, 'app.get("/api/' || (doc_id % 7) || '/items")' || chr(10) || 'fetch("http://svc/api/' || (doc_id % 9) || '/items?q=1")' || chr(10) || CASE WHEN doc_id % 5 = 0 THEN 'fn main() {' ELSE 'fn other() {' END AS text FROM documents),
  ln AS (SELECT doc_id, cast(i AS integer) AS line, l[i] AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM code)))"""


def _lines(spark, sf):
    k = F.col("doc_id")
    text = F.concat(F.lit('app.get("/api/'), (k % 7).cast("string"), F.lit('/items")\nfetch("http://svc/api/'), (k % 9).cast("string"), F.lit('/items?q=1")\n'), F.when(k % 5 == 0, "fn main() {").otherwise("fn other() {"))
    return G.lines(table(spark, sf, "documents").select("doc_id", text.alias("text")), "doc_id", "text")


@query("endpoints", f"WITH {CODE_SQL} SELECT doc_id, line, upper(regexp_extract(text, '(?i)(?:^|[^A-Za-z0-9])(get|post|put|delete|patch|head|options)\\(\\s*[\"''`](/[^\"''`]*)', 1)) AS method, regexp_extract(text, '(?i)(?:^|[^A-Za-z0-9])(get|post|put|delete|patch|head|options)\\(\\s*[\"''`](/[^\"''`]*)', 2) AS path FROM ln WHERE line = 1")
def endpoints(spark, sf):
    return G.endpoints(_lines(spark, sf), "doc_id")


@query("api_calls", f"WITH {CODE_SQL} SELECT doc_id, line, regexp_extract(text, 'fetch\\(\"([^\"]+)', 1) AS url FROM ln WHERE line = 2")
def api_calls(spark, sf):
    return G.api_calls(_lines(spark, sf), "doc_id")


@query("entry_points", f"WITH {CODE_SQL} SELECT doc_id, line FROM ln WHERE contains(text, 'fn main(')")
def entry_points(spark, sf):
    return G.entry_points(_lines(spark, sf), "doc_id")


@query("api_topology", """SELECT c.p AS path, c.n AS n_calls, e.n AS n_endpoints, c.least AS first_call, e.least AS first_endpoint, c.n * e.n AS n_links FROM
  (SELECT '/api/' || (doc_id % 9) || '/items' AS p, count(*) AS n, min(doc_id) AS least FROM documents GROUP BY 1) c JOIN (SELECT '/api/' || (doc_id % 7) || '/items' AS p, count(*) AS n, min(doc_id) AS least FROM documents GROUP BY 1) e ON c.p = e.p""")
def api_topology(spark, sf):
    """Links of all calls and endpoints, told by path: a path's calls and endpoints are all linked, so the pairs are not spelt out."""
    ln = _lines(spark, sf)
    return G.topology_paths(G.api_calls(ln, "doc_id").select("doc_id", "url"), G.endpoints(ln, "doc_id").select("doc_id", "path"), "doc_id")


@query("resolve_entity", views("entities") + " SELECT id, name FROM entities WHERE contains(lower(name), 'red') ORDER BY id LIMIT 1")
def resolve_entity(spark, sf):
    return G.resolve_entity(entities(spark, sf).select("id", "name"), "RED")


@query("resolve_call_targets", "SELECT a.p_partkey AS subject, b.id AS object_id FROM part a LEFT JOIN (SELECT p_name, min(p_partkey) AS id FROM part WHERE p_size < 20 GROUP BY 1) b ON a.p_name = b.p_name")
def resolve_call_targets(spark, sf):
    p = table(spark, sf, "part")
    e = p.select(F.col("p_partkey").alias("subject"), F.col("p_name").alias("object_name"), F.lit(None).cast("long").alias("object_id"))
    return G.resolve_targets(e, p.filter("p_size < 20").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))).select("subject", "object_id")


@query("symbol_substring", views("entities") + " SELECT id, name FROM entities WHERE contains(lower(name || ' ' || kind), 'brand#1') ORDER BY id LIMIT 30")
def symbol_substring(spark, sf):
    return G.substring_scan(entities(spark, sf), "Brand#1", 30).select("id", "name")


@query("service_diagram", "SELECT 'graph LR' || chr(10) || string_agg(a || ' --> ' || b, chr(10) ORDER BY a || ' --> ' || b) AS text FROM (SELECT DISTINCT r_name AS a, n_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY 1, 2 LIMIT 50)")
def service_diagram(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return G.diagram(n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("a"), F.col("n_name").alias("b")))


TERMS = ["part", "red"]


@query("evidence_bundle", views("edges", "chunks") + """, n AS (SELECT p_partkey AS id, CASE WHEN lower(p_name) IN ('part', 'red') THEN 3 WHEN starts_with(lower(p_name), 'part') OR ends_with(lower(p_name), 'part') OR starts_with(lower(p_name), 'red') OR ends_with(lower(p_name), 'red') THEN 2 WHEN contains(lower(p_name), 'part') OR contains(lower(p_name), 'red') THEN 1 ELSE 0 END AS score FROM part),
  e AS (SELECT id, score FROM n WHERE score > 0 ORDER BY score DESC, id LIMIT 20), r AS (SELECT DISTINCT src, dst FROM edges WHERE src IN (SELECT id FROM e) OR dst IN (SELECT id FROM e) ORDER BY src, dst LIMIT 30),
  c AS (SELECT doc_id || ':' || position AS id, contains(lower(text), 'part')::int + contains(lower(text), 'red')::int AS score FROM chunks)
  SELECT 'entity' AS kind, cast(id AS varchar) AS id, cast(score AS integer) AS score FROM e UNION ALL SELECT 'relationship', src || '->' || dst, 1 FROM r UNION ALL (SELECT 'chunk', id, cast(score AS integer) FROM c WHERE score > 0 ORDER BY score DESC, id LIMIT 8)""")
def evidence_bundle(spark, sf):
    e = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    c = chunks(spark, sf).select(F.concat_ws(":", "doc_id", "position").alias("id"), "text")
    return G.evidence(e, call_edges(spark, sf), c, TERMS)


@query("predict_terms", "SELECT DISTINCT term FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM benchmark) WHERE term <> ''")
def predict_terms(spark, sf):
    return G.predict_terms(table(spark, sf, "benchmark"), "text")


@query("attach_evidence", "SELECT p_partkey AS id, 'base' || coalesce(',' || refs, '') AS evidence FROM part LEFT JOIN (SELECT l_partkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS refs FROM lineitem WHERE l_quantity > 48 GROUP BY 1) ON l_partkey = p_partkey")
def attach_evidence(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array(F.lit("base")).alias("evidence"))
    ev = table(spark, sf, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("ref"))
    return G.attach_evidence(p, ev).select("id", F.array_join("evidence", ",").alias("evidence"))


@query("evidence_by_scope", "SELECT id, kind FROM (SELECT r_regionkey AS id, 'region' AS kind, 0 AS p FROM region UNION ALL SELECT n_nationkey, 'nation', 1 FROM nation) ORDER BY p, id LIMIT 12")
def evidence_by_scope(spark, sf):
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.lit("region").alias("kind"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.lit("nation").alias("kind"))
    return G.evidence_by_scope([r, n], 12)


@query("diagnostics", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'vectors', count(*) FROM embeddings")
def diagnostics(spark, sf):
    return G.diagnostics({"documents": table(spark, sf, "documents"), "events": table(spark, sf, "events"), "vectors": table(spark, sf, "embeddings")})


@query("batch_status", "SELECT CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'partial' ELSE 'complete' END AS status FROM events")
def batch_status(spark, sf):
    return G.aggregate_status(table(spark, sf, "events").select(F.when(F.col("event_type") == "purchase", "failed").otherwise("ok").alias("status")))


@query("graph_view", views("edges") + ", d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50) SELECT DISTINCT src, dst FROM edges WHERE src IN (SELECT id FROM d) AND dst IN (SELECT id FROM d)")
def graph_view(spark, sf):
    return G.ranked_view(call_edges(spark, sf), 50)[1]


@query("most_complex", "SELECT doc_id, cast(len(regexp_extract_all(text, 'th')) AS bigint) AS score FROM documents ORDER BY score DESC, doc_id LIMIT 15")
def most_complex(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit("th")).cast("long").alias("score")).orderBy(F.desc("score"), "doc_id").limit(15)


@query("concept_names", "SELECT doc_id, substr(trim(regexp_replace(regexp_replace(string_split(text, chr(10))[1], '^[# ]+', ''), '\\s+', ' ', 'g')), 1, 48) AS name FROM documents")
def concept_names(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.concept_name(F.col("text")).alias("name"))
