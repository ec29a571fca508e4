"""Queries of beliefs, identity, hierarchy, taxonomy, ingestion, lifecycle, evaluation and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import columns as C
from cairn.operators import codegraph, ingest, knowledge as K
from cairn.sources.domain import assertions, call_edges, chunks, concepts, hierarchy_nodes, memories, memory_events, table, views
from cairn.sources.stores import fingerprint, gc_orphans, latest_versions
from cairn.streaming import events as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
AT = 820454400  # 1996-01-01


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


# -- beliefs
LIVE = views("assertions") + f""", l AS (SELECT *, CASE authority_level WHEN 'primary' THEN 0 WHEN 'secondary' THEN 1 ELSE 2 END AS tier FROM assertions WHERE from_s <= {AT} AND {AT} < until_s),
  b AS (SELECT * FROM (SELECT *, min(tier) OVER (PARTITION BY subject_key, predicate) AS best FROM l) WHERE tier = best),
  g AS (SELECT subject_key, predicate, count(*) AS n, count(DISTINCT object) AS objects, max(coalesce(confidence, 1)) AS most FROM b GROUP BY 1, 2),
  w AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY subject_key, predicate ORDER BY coalesce(confidence, 0) DESC, asserted_s DESC, id) = 1)"""
KEY = "strlen(subject_key) || ':' || subject_key || strlen(predicate) || ':' || predicate"


@query("reconcile_beliefs", LIVE + f" SELECT 'belief:' || {KEY} AS id, subject_key, predicate || ' \"' || object || '\"' AS content, coalesce(confidence, 1.0) AS confidence, w.id AS source_id, n AS live_count FROM w JOIN g USING (subject_key, predicate) WHERE objects = 1")
def reconcile_beliefs(spark, sf):
    return K.reconcile(assertions(spark, sf), AT)[0].select("id", "subject_key", "content", "confidence", "source_id", "live_count")


@query("reconcile_contradictions", LIVE + f" SELECT 'contradiction:' || {KEY} AS id, subject_key, most AS severity, objects || ' distinct claims' AS note, n AS targets FROM g WHERE objects > 1")
def reconcile_contradictions(spark, sf):
    return K.reconcile(assertions(spark, sf), AT)[1]


def _beliefs(spark, sf):
    a = assertions(spark, sf)
    return a.select("id", "subject_key", F.col("object").alias("content"), "confidence", "from_s", "until_s", F.lit("active").alias("status"))


@query("detect_contradictions", views("assertions") + " SELECT 'contradiction-' || substr(sha256(subject_key), 1, 16) AS id, subject_key, max(coalesce(confidence, 1)) AS severity, count(*) AS n FROM assertions GROUP BY subject_key HAVING count(*) >= 2 AND count(DISTINCT object) >= 2")
def detect_contradictions(spark, sf):
    return K.detect(_beliefs(spark, sf))


@query("belief_live_as_of", views("assertions") + f" SELECT subject_key, id, object AS content FROM (SELECT *, row_number() OVER (PARTITION BY subject_key ORDER BY from_s DESC, id DESC) AS r FROM assertions WHERE from_s <= {AT} AND {AT} < until_s) WHERE r = 1")
def belief_live_as_of(spark, sf):
    b = _beliefs(spark, sf).filter(C.live_at(F.col("from_s"), F.col("until_s"), F.lit(AT)))
    return K.latest(b, ["subject_key"]).select("subject_key", "id", "content")


@query("belief_supersede", views("assertions") + f" SELECT id, CASE WHEN object = 'F' AND from_s < {AT} THEN {AT} ELSE until_s END AS until_s, CASE WHEN object = 'F' AND from_s < {AT} THEN 'superseded' ELSE 'active' END AS status FROM assertions")
def belief_supersede(spark, sf):
    return K.supersede(_beliefs(spark, sf), (F.col("content") == "F") & (F.col("from_s") < AT), AT).select("id", "until_s", "status")


@query("belief_sources_semi", views("assertions") + " SELECT id FROM assertions WHERE subject_key IN (SELECT cast(c_custkey AS varchar) FROM customer WHERE c_mktsegment = 'BUILDING')")
def belief_sources_semi(spark, sf):
    c = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("subject_key"))
    return _beliefs(spark, sf).join(c, "subject_key", "left_semi").select("id")


QV = [((i * 29) % 13 - 6) / 6.0 for i in range(64)]


@query("belief_embedding_rank", f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, list_cosine_similarity(embedding::double[], [{', '.join(f'{x}::double' for x in QV)}]) AS s FROM embeddings) WHERE s >= 0.05 ORDER BY s DESC, vec_id LIMIT 25")
def belief_embedding_rank(spark, sf):
    s = C.cosine(F.col("embedding"), F.array(*map(F.lit, QV)))
    return table(spark, sf, "embeddings").select("vec_id", s.alias("s")).filter("s >= 0.05").orderBy(F.desc("s"), "vec_id").limit(25).select("vec_id", F.round("s", 6).alias("score"))


# -- identity
PKEY = "lower(trim(p_brand)) || '|' || lower(trim(p_type))"


def _parts(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type", "p_name")


def _pkey():
    return F.concat_ws("|", C.normalize_name(F.col("p_brand")), C.normalize_name(F.col("p_type")))


@query("identity_collisions", f"SELECT {PKEY} AS identity_key, count(*) AS n, min(p_partkey) AS canonical FROM part GROUP BY 1 HAVING count(*) > 1")
def identity_collisions(spark, sf):
    return K.collisions(_parts(spark, sf), _pkey())


@query("merge_aliases", f"SELECT {PKEY} AS identity_key, string_agg(DISTINCT lower(p_name), ';' ORDER BY lower(p_name)) AS aliases FROM part GROUP BY 1")
def merge_aliases(spark, sf):
    return _parts(spark, sf).groupBy(_pkey().alias("identity_key")).agg(F.array_join(F.array_sort(F.collect_set(C.normalize_name(F.col("p_name")))), ";").alias("aliases"))


MOVED = f"m AS (SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY {PKEY}) AS canonical FROM part)"


@query("redirect_edges", views("edges") + f", {MOVED} SELECT DISTINCT a.canonical AS src, b.canonical AS dst FROM edges JOIN m a ON a.id = src JOIN m b ON b.id = dst")
def redirect_edges(spark, sf):
    return K.redirect(call_edges(spark, sf), K.merge_map(_parts(spark, sf), _pkey()))


@query("relationship_coalesce", views("edges") + " SELECT src, dst, count(*) AS n_evidence, min(order_id) AS first_order FROM edges GROUP BY 1, 2")
def relationship_coalesce(spark, sf):
    return call_edges(spark, sf).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_evidence"), F.min("order_id").alias("first_order"))


@query("idempotent_writes", "SELECT event_id AS id, min(event_id) OVER (PARTITION BY user_id, event_type) AS stored_id, event_id <> min(event_id) OVER (PARTITION BY user_id, event_type) AS deduplicated FROM events")
def idempotent_writes(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", F.col("event_id").alias("seq"))
    return K.first_writes(e, ["user_id", "event_type"], "seq").select("id", "stored_id", "deduplicated")


@query("upsert_latest", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark, sf):
    return latest_versions(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id")


@query("gc_orphans", "SELECT cast(vec_id AS varchar) AS id FROM embeddings WHERE vec_id IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def gc_orphans_query(spark, sf):
    live = table(spark, sf, "part").filter("p_size > 25").select(F.col("p_partkey").cast("string").alias("id"))
    return gc_orphans(table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id")), live)


# -- hierarchy, taxonomy, ontology
PATHS = views("nodes").replace("WITH ", "WITH RECURSIVE ") + ", p AS (SELECT id AS seed, id, 0 AS up FROM nodes WHERE id IN ('c1', 'c2', 's1', 'c3') UNION ALL SELECT p.seed, n.parent_id, p.up + 1 FROM p JOIN nodes n ON n.id = p.id WHERE n.parent_id IS NOT NULL)"


def _paths(spark, sf, ids=("c1", "c2", "s1", "c3")):
    n = hierarchy_nodes(spark, sf)
    return K.path_to_root(n, n.filter(F.col("id").isin(*ids)).select("id"))


@query("hierarchy_path", PATHS + " SELECT seed, id, up FROM p")
def hierarchy_path(spark, sf):
    return _paths(spark, sf)


@query("hierarchy_lca", PATHS.replace("('c1', 'c2', 's1', 'c3')", "(SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 1)") + " SELECT id FROM p GROUP BY id HAVING count(DISTINCT seed) = (SELECT count(*) FROM nation WHERE n_regionkey = 1) ORDER BY min(up), id LIMIT 1")
def hierarchy_lca(spark, sf):
    ids = [f"n{r[0]}" for r in table(spark, sf, "nation").filter("n_regionkey = 1").select("n_nationkey").collect()]  # 25 nations
    return K.lca(_paths(spark, sf, ids), len(ids))


@query("validate_parentage", views("nodes") + """, x AS (SELECT id, layer, CASE WHEN id LIKE 'c%7' THEN id WHEN id LIKE 'c%8' THEN 'zz' WHEN id LIKE 'c%99' THEN 'c1' ELSE parent_id END AS parent_id FROM nodes)
  SELECT x.id, CASE WHEN x.id = x.parent_id THEN 'self_parent' WHEN p.id IS NULL THEN 'missing_parent' ELSE 'layer_order' END AS finding FROM x LEFT JOIN x p ON p.id = x.parent_id WHERE x.parent_id IS NOT NULL AND (x.id = x.parent_id OR p.id IS NULL OR p.layer >= x.layer)""")
def validate_parentage(spark, sf):
    n = hierarchy_nodes(spark, sf)
    bad = F.when(F.col("id").like("c%7"), F.col("id")).when(F.col("id").like("c%8"), "zz").when(F.col("id").like("c%99"), "c1").otherwise(F.col("parent_id"))
    return K.parentage_findings(n.select("id", "layer", bad.alias("parent_id")))


@query("duplicate_labels", views("concepts") + " SELECT id, previous_id FROM (SELECT id, lag(id) OVER (PARTITION BY scheme_id, lower(trim(split_part(pref_label, ' ', 1))) ORDER BY position, id) AS previous_id FROM concepts WHERE status <> 'rejected') WHERE previous_id IS NOT NULL")
def duplicate_labels(spark, sf):
    return K.duplicate_labels(concepts(spark, sf), [F.col("scheme_id"), C.normalize_name(F.split("pref_label", " ")[0])])


@query("dangling_relations", views("edges") + ", k AS (SELECT p_partkey AS id FROM part WHERE p_size <= 40) SELECT DISTINCT src || '-' || dst AS id, 'subject' AS missing FROM edges WHERE src NOT IN (SELECT id FROM k) UNION ALL SELECT DISTINCT src || '-' || dst, 'object' FROM edges WHERE dst NOT IN (SELECT id FROM k)")
def dangling_relations(spark, sf):
    r = call_edges(spark, sf).select(F.concat_ws("-", "src", "dst").alias("id"), F.col("src").alias("subject_id"), F.col("dst").alias("object_id"))
    return K.dangling(r, table(spark, sf, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("id"))).distinct()


@query("broader_cycle")
def broader_cycle(spark, sf):
    return K.on_cycles(call_edges(spark, sf).select(F.col("src").alias("child"), F.col("dst").alias("parent")))


@query("undeclared_predicates", "SELECT id, severity FROM (SELECT event_id AS id0, cast(event_id AS varchar) AS id, 'warning' AS severity, row_number() OVER (ORDER BY event_id) AS r, event_type FROM events) WHERE r <= 5000 AND lower(event_type) NOT IN ('click', 'view') UNION ALL SELECT 'truncated', 'info' WHERE (SELECT count(*) FROM events) > 5000")
def undeclared_predicates(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("predicate"))
    d = spark.createDataFrame([("CLICK",), ("View",)], "label string")
    return K.undeclared(e, d).select(F.col("id").cast("string").alias("id"), "severity")


# -- ingestion
@query("line_chunks", views("chunks") + " SELECT doc_id, position, sha256(text) AS hash FROM chunks")
def line_chunks(spark, sf):
    return chunks(spark, sf).select("doc_id", F.col("position").cast("long").alias("position"), F.sha2("text", 256).alias("hash"))


@query("content_hashes", "SELECT doc_id, 'sha256:' || sha256(coalesce(text, '')) AS hash FROM documents")
def content_hashes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.content_hash(F.coalesce("text", F.lit(""))).alias("hash"))


CODE = "concat('fn main() {', chr(10), '// if skipped', chr(10), 'if a && b || c { while d { } }', chr(10), text)"


@query("cyclomatic", f"""SELECT doc_id, cast(1 + sum(len(regexp_extract_all(l, '\\b(if|for|while|case|catch|match|elif|except|when|switch|loop|unless|until)\\b')) + len(regexp_extract_all(l, '&&|\\|\\|'))) AS integer) AS complexity
  FROM (SELECT doc_id, unnest(string_split({CODE}, chr(10))) AS l FROM documents) WHERE NOT regexp_matches(ltrim(l), '^(//|#|\\*|/\\*)') GROUP BY 1""")
def cyclomatic(spark, sf):
    code = F.concat(F.lit("fn main() {\n// if skipped\nif a && b || c { while d { } }\n"), F.coalesce("text", F.lit("")))
    return table(spark, sf, "documents").select("doc_id", C.cyclomatic(code).cast("int").alias("complexity"))


@query("link_edges", "SELECT page_id, cast(i - 1 AS integer) AS position, h[i] AS href FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), 'href=\"([^\"]*)\"', 1) AS h FROM pages))")
def link_edges(spark, sf):
    return ingest.links(table(spark, sf, "pages"))


@query("path_normalize", r"""SELECT page_id, array_to_string(list_transform(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/'), lambda s: CASE WHEN regexp_matches(s, '^[0-9]+$') OR regexp_matches(s, '^[:{]') OR length(s) > 20 THEN '{param}' ELSE s END), '/') AS path FROM pages""")
def path_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", C.route(F.col("url")).alias("path"))


@query("incremental_diff", "WITH a AS (SELECT doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 0), b AS (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0) SELECT path, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (path) WHERE a.h IS NULL OR b.h IS NULL OR a.h <> b.h")
def incremental_diff(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text")
    a = d.filter("path % 10 <> 0").select("path", F.sha2("text", 256).alias("hash"))
    b = d.filter("path % 11 <> 0").select("path", F.sha2(F.when(F.col("path") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return ingest.manifest_diff(a, b)


@query("describes_bridge", "SELECT a.p_partkey AS concept_id, b.symbol_id, 0.8::double AS confidence FROM part a JOIN (SELECT lower(p_name) AS k, min(p_partkey) AS symbol_id FROM part WHERE p_size > 20 GROUP BY 1) b ON lower(a.p_name) = b.k WHERE a.p_size <= 20")
def describes_bridge(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_size")
    return ingest.describes(p.filter("p_size <= 20"), p.filter("p_size > 20"))


@query("enclosing_asof", "SELECT event_id, last_value(CASE WHEN value > 50 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS enclosing FROM events")
def enclosing_asof(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    return ingest.enclosing(e, ["user_id"], "event_id", F.when(F.col("value") > 50, F.col("event_id"))).select("event_id", "enclosing")


@query("cross_file_edges", "SELECT a.p_partkey AS src, b.p_partkey AS dst FROM part a JOIN part b ON lower(a.p_name) = lower(b.p_name) AND a.p_brand <> b.p_brand AND a.p_partkey < b.p_partkey")
def cross_file_edges(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("src"), F.lower("p_name").alias("k"), "p_brand")
    return codegraph.ordered_pairs(p.filter("k is not null"), "src", "k").filter("p_brand <> b_p_brand").select("src", F.col("b_src").alias("dst"))


@query("plain_text_chunks")
def plain_text_chunks(spark, sf):
    return ingest.chunk(table(spark, sf, "documents"), "doc_id", "text", "plain")


@query("markdown_chunks")
def markdown_chunks(spark, sf):
    return ingest.chunk(table(spark, sf, "documents"), "doc_id", "text", "markdown")


@query("code_symbol_chunks")
def code_symbol_chunks(spark, sf):
    return ingest.chunk(table(spark, sf, "documents"), "doc_id", "text", "code")


@query("capitalized_entities")
def capitalized_entities(spark, sf):
    return ingest.extract_names(table(spark, sf, "documents"), "doc_id", "text")


# -- operations
@query("scope_counts_rollup", views("memories") + " SELECT tenant, kind, count(*) AS n FROM memories GROUP BY ROLLUP (tenant, kind)")
def scope_counts_rollup(spark, sf):
    return memories(spark, sf).rollup("tenant", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("procedure_stats", "SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS success, count(*) FILTER (value <= 50) AS failure FROM events GROUP BY 1")
def procedure_stats(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("success"), F.count_if(F.col("value") <= 50).alias("failure"))


@query("reflection_digest", views("memories") + """ SELECT tenant, count(*) || ' active memories: ' || string_agg(CASE WHEN r <= 3 THEN substr(text, 1, 40) END, '; ' ORDER BY r) AS content, 0.5::double AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY id) AS r FROM memories WHERE status = 'active') GROUP BY 1""")
def reflection_digest(spark, sf):
    return K.reflection(memories(spark, sf), ["tenant"]).select("tenant", "content", "confidence")


@query("forget_redact", views("memories") + " SELECT id, CASE WHEN tenant = 't2' THEN '' ELSE text END AS text, CASE WHEN tenant = 't2' THEN 'redacted' ELSE status END AS status FROM memories")
def forget_redact(spark, sf):
    return K.forget(memories(spark, sf), F.col("tenant") == "t2", "redact").select("id", "text", "status")


@query("redact_values", r"SELECT page_id, regexp_replace('https://u:p@' || substr(url, 9), '://[^/@\s]+@', '://[REDACTED]@', 'g') AS value FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, '[REDACTED]' FROM pages WHERE page_id % 2 <> 0")
def redact_values(spark, sf):
    key = F.when(F.col("page_id") % 2 == 0, "url").otherwise("api_token")
    return table(spark, sf, "pages").select("page_id", C.redact(key, F.concat(F.lit("https://u:p@"), F.substring("url", 9, 100000))).alias("value"))


@query("memory_roles", views("memories") + " SELECT CASE WHEN kind = 'observation' THEN 'episodic' ELSE 'semantic' END AS role, count(*) AS n FROM memories GROUP BY 1")
def memory_roles(spark, sf):
    return memories(spark, sf).groupBy(K.role().alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query("eval_cases", "SELECT item_id AS case_id, cast(CASE WHEN item_id % 4 = 0 THEN 1 WHEN item_id % 4 = 1 AND length(text) % 3 = 0 THEN 1 ELSE 0 END AS bigint) AS failures FROM benchmark")
def eval_cases(spark, sf):
    b = table(spark, sf, "benchmark")
    k = F.col("item_id") % 4
    want = b.select(F.col("item_id").alias("case_id"), F.lit("x").alias("target_id"), F.when(k == 0, "exclude").otherwise("include").alias("must"), F.when(k == 1, 0.5).otherwise(0.0).alias("min_score"))
    got = b.select(F.col("item_id").alias("case_id"), F.lit("x").alias("target_id"), F.when((k == 1) & (F.length("text") % 3 == 0), 0.1).otherwise(0.9).alias("score"))
    return K.evaluate(want, got)


@query("qa_score", "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'not found') THEN 'no_answer' WHEN h * 2 >= 3 THEN 'correct' WHEN h > 0 THEN 'partial' ELSE 'wrong' END AS verdict FROM (SELECT *, contains(lower(text), 'the')::int + contains(lower(text), 'une')::int + contains(lower(text), 'ing')::int AS h FROM conversations)")
def qa_score(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text", F.array(F.lit("the"), F.lit("une"), F.lit("ing")).alias("kw"))
    return c.select("conv_id", "turn", K.qa_score("text", "kw").alias("verdict"))


@query("manifest_fingerprint", "SELECT count(*) AS n_rows, bit_xor(cast('0x' || substr(sha256(cast(doc_id AS varchar)), 1, 12) AS bigint)) AS digest FROM documents")
def manifest_fingerprint(spark, sf):
    return fingerprint(table(spark, sf, "documents"), "doc_id")


# -- event windows (batch forms of the streams)
def _secs(df):
    return df.withColumn("start", F.unix_timestamp("start"))


@query("events_tumbling", "SELECT cast(floor(epoch(ts) / 3600) * 3600 AS bigint) AS start, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf):
    return _secs(S.windows(memory_events(spark, sf), "1 hour")).withColumn("total", F.round("total", 4))


@query("events_sliding", "SELECT cast((floor(epoch(ts) / 1800) - k) * 1800 AS bigint) AS start, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2")
def events_sliding(spark, sf):
    return _secs(S.windows(memory_events(spark, sf), "1 hour", "30 minutes")).withColumn("total", F.round("total", 4))


@query("events_session", "SELECT subject, cast(floor(epoch(min(ts))) AS bigint) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY subject ORDER BY ts, event_id) AS s FROM (SELECT cast(user_id AS varchar) AS subject, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR > ts THEN 0 ELSE 1 END AS new FROM events)) GROUP BY subject, s")
def events_session(spark, sf):
    return _secs(S.sessions(memory_events(spark, sf), "2 hours"))


@query("events_dedup", "SELECT DISTINCT event_id AS sequence FROM events")
def events_dedup(spark, sf):
    e = memory_events(spark, sf)
    return e.unionByName(e).dropDuplicates(["sequence"]).select("sequence")


@query("threshold_triggers", "SELECT cast(user_id AS varchar) AS subject, cast(floor(count(*) / 5) AS bigint) AS fired FROM events GROUP BY 1 HAVING floor(count(*) / 5) > 0")
def threshold_triggers(spark, sf):
    return S.triggers(memory_events(spark, sf), 5)
