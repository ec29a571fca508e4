"""Queries of filters, lanes and fusion, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import columns as C
from cairn.operators import filters, fusion, lanes
from cairn.sources.domain import NOW, chunks, entities, memories, table, views

Q = "the ones"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


REASON = f"""CASE WHEN expires_s <= {NOW} THEN 'expired' WHEN status IN ('redacted', 'forgotten') THEN 'redacted' WHEN status = 'archived' THEN 'archived'
  WHEN len(allowed_uses) > 0 AND NOT list_contains(allowed_uses, 'retrieval') THEN 'policy_denied' END"""
KEYWORD = """CASE WHEN contains(lower(text), 'the ones') THEN least(1.0, 0.85 + 0.15 * coalesce(confidence, 1.0))
  WHEN contains(lower(text), 'the') OR contains(lower(text), 'ones') THEN
    least(1.0, 0.85 * ((contains(lower(text), 'ones')::int + contains(lower(text), 'the')::int) / 2.0::double) + 0.15 * coalesce(confidence, 1.0)) END"""
CUE = """CASE WHEN (kind = 'fact')::int + (starts_with(session, '1'))::int > 0 THEN ((kind = 'fact')::int + (starts_with(session, '1'))::int) / 2.0::double END"""
CUES = [("kind", "equals", " Fact "), ("entity", "starts_with", "1"), ("colour", "equals", "red")]
FIELDS = {"kind": "kind", "entity": "session"}


def _facts_oracle(score: str) -> str:
    return views("memories") + f""", s AS (SELECT *, {score} AS total, {REASON} AS reason FROM memories),
      r AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY reason IS NULL ORDER BY total DESC, created_s DESC, id) END AS rk FROM s WHERE total IS NOT NULL AND (reason IS NULL OR reason <> 'archived'))
      SELECT id, round(total, 6) AS total, CASE WHEN rk <= 20 THEN rk END AS rank, CASE WHEN rk > 20 THEN 'budget_exceeded' ELSE reason END AS reason FROM r"""


def _facts(mode):
    def run(spark, sf):
        out = lanes.facts(memories(spark, sf), Q, NOW, 20, cues=CUES, fields=FIELDS, mode=mode)
        return out.select("id", F.round("total", 6).alias("total"), "rank", "reason")

    return run


QUERIES["facts_keyword"], ORACLES["facts_keyword"] = _facts("keyword"), _facts_oracle(KEYWORD)
QUERIES["facts_cue"], ORACLES["facts_cue"] = _facts("cue"), _facts_oracle(CUE)
QUERIES["facts_both_max"], ORACLES["facts_both_max"] = _facts("both"), _facts_oracle(f"greatest({KEYWORD}, {CUE})")


@query("omitted_reasons", views("memories") + f" SELECT coalesce({REASON}, 'kept') AS reason, count(*) AS n FROM memories GROUP BY 1")
def omitted_reasons(spark, sf):
    return memories(spark, sf).groupBy(F.coalesce(filters.omit_reason(NOW), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("scope_visible", views("memories") + " SELECT id, tenant, session FROM memories WHERE tenant = 't1' AND session = '5'")
def scope_visible(spark, sf):
    return memories(spark, sf).filter(filters.scope_allows("t1", session="5", workspace=None)).select("id", "tenant", "session")


@query("policy_gauntlet", views("memories") + f" SELECT id, kind, confidence FROM memories WHERE {REASON} IS NULL AND kind IN ('fact', 'preference') AND created_s BETWEEN 1704067200 AND 1708000000 AND coalesce(confidence, 0) >= 0.7")
def policy_gauntlet(spark, sf):
    keep = filters.omit_reason(NOW).isNull() & filters.memory_filter(["fact", "preference"], 1704067200, 1708000000, 0.7)
    return memories(spark, sf).filter(keep).select("id", "kind", "confidence")


@query("keyset_page", "SELECT event_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def keyset_page(spark, sf):
    return filters.keyset_page(table(spark, sf, "events").select("event_id", "event_type"), "event_id", 500, 100)


@query("decay_due", views("memories") + f" SELECT id, 'expired' AS status FROM memories WHERE status = 'active' AND retention <> 'legal_hold' AND expires_s <= {NOW}")
def decay_due(spark, sf):
    return memories(spark, sf).filter(filters.decay_due(NOW)).select("id", F.lit("expired").alias("status"))


@query("as_of_entities", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 <> 0 AND epoch(o_orderdate) <= 820454400 AND (o_orderkey % 3 = 0 OR 820454400 < epoch(o_orderdate) + 31536000)")
def as_of_entities(spark, sf):
    s = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 != 0, s).alias("f"), F.when(F.col("o_orderkey") % 3 != 0, s + 31536000).alias("u"))
    return o.filter(C.as_of(F.col("f"), F.col("u"), F.lit(820454400))).select("id")


@query("time_window_provenance", "SELECT event_id, event_type FROM events WHERE ts >= (SELECT min(ts) + INTERVAL 1 DAY FROM events) AND ts < (SELECT min(ts) + INTERVAL 3 DAY FROM events)")
def time_window_provenance(spark, sf):
    e = table(spark, sf, "events")
    start = F.lit(e.agg(F.min("ts")).first()[0]).cast(e.schema["ts"].dataType)  # one value, so that the window reaches the scan
    return e.filter((F.col("ts") >= start + F.expr("interval 1 day")) & (F.col("ts") < start + F.expr("interval 3 day"))).select("event_id", "event_type")


TEMPORAL = views("memories") + f"""SELECT 'temporal' AS lane, row_number() OVER (ORDER BY created_s DESC, id) AS lane_rank, 'memory' AS target_type, id AS target_id, text AS content,
  round(pow(0.5, greatest(({NOW} - created_s) / 86400.0::double, 0) / 14.0), 6) AS raw_score FROM memories WHERE status = 'active' QUALIFY lane_rank <= {{k}}"""


@query("temporal_recency", TEMPORAL.format(k=20))
def temporal_recency(spark, sf):
    return lanes.temporal(memories(spark, sf), NOW, 20).withColumn("raw_score", F.round("raw_score", 6))


def _terms_sql(words: list[str], col: str) -> str:
    return " + ".join(f"CASE WHEN lower({col}) = '{w}' THEN 3 WHEN starts_with(lower({col}), '{w}') OR ends_with(lower({col}), '{w}') THEN 2 WHEN contains(lower({col}), '{w}') THEN 1 ELSE 0 END" for w in words)


@query("graph_term_rank", views("entities") + f""" SELECT 'graph' AS lane, row_number() OVER (ORDER BY s DESC, id) AS lane_rank, 'entity' AS target_type, id AS target_id, name AS content, s::double AS raw_score
  FROM (SELECT *, {_terms_sql(C.graph_terms('part red blue'), 'name')} AS s FROM entities) WHERE s > 0 QUALIFY lane_rank <= 20""")
def graph_term_rank(spark, sf):
    return lanes.graph_terms(entities(spark, sf), "part red blue", 20)


BM = ["the", "ones", "thre"]
BM25 = """t AS (SELECT doc_id, list_filter(string_split(lower(regexp_replace(regexp_replace(coalesce(text, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS t FROM documents),
  bc AS (SELECT doc_id, len(t) AS len, """ + ", ".join(f"len(list_filter(t, lambda x: x = '{q}')) AS tf{i}" for i, q in enumerate(BM)) + """ FROM t),
  st AS (SELECT count(*) AS n, avg(len) AS al, """ + ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(BM))) + """ FROM bc),
  b AS (SELECT cast(doc_id AS varchar) AS target_id, round(""" + " + ".join(f"ln(1 + (n - df{i} + 0.5::double) / (df{i} + 0.5::double)) * tf{i} * 2.2::double / (tf{i} + 1.2::double * (0.25::double + 0.75::double * len / al))" for i in range(len(BM))) + """, 9) AS s FROM bc, st WHERE tf0 + tf1 + tf2 > 0),
  lex AS (SELECT 'lexical' AS lane, row_number() OVER (ORDER BY s DESC, target_id) AS lane_rank, 'chunk' AS target_type, target_id, '' AS content, s AS raw_score FROM b QUALIFY lane_rank <= 20)"""


@query("bm25_topk", f"WITH {BM25} SELECT lane, lane_rank, target_type, target_id, content, round(raw_score, 6) AS raw_score FROM lex")
def bm25_topk(spark, sf):
    return lanes.bm25(table(spark, sf, "documents"), BM, "doc_id", "text", 20).withColumn("raw_score", F.round("raw_score", 6))


QVEC = [((i * 37) % 11 - 5) / 5.0 for i in range(64)]
QSQL = "[" + ", ".join(f"{x}::double" for x in QVEC) + "]"


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding", "label")


VEC = "vec AS (SELECT 'vector' AS lane, row_number() OVER (ORDER BY s DESC, id) AS lane_rank, 'chunk' AS target_type, id AS target_id, '' AS content, s AS raw_score FROM (SELECT cast(vec_id AS varchar) AS id, round({s}, 9) AS s FROM embeddings) QUALIFY lane_rank <= 20)"
L2 = f"1 / (1 + list_distance(embedding::double[], {QSQL}))"
COS = f"list_cosine_similarity(embedding::double[], {QSQL})"


@query("vector_l2_topk", f"WITH {VEC.format(s=L2)} SELECT * REPLACE (round(raw_score, 6) AS raw_score) FROM vec")
def vector_l2_topk(spark, sf):
    return lanes.vector(vectors(spark, sf), QVEC, 20, "l2").withColumn("raw_score", F.round("raw_score", 6))


@query("vector_cosine_topk", f"WITH {VEC.format(s=COS)} SELECT * REPLACE (round(raw_score, 6) AS raw_score) FROM vec")
def vector_cosine_topk(spark, sf):
    return lanes.vector(vectors(spark, sf), QVEC, 20, "cosine").withColumn("raw_score", F.round("raw_score", 6))


def two_lanes(spark, sf):
    return lanes.bm25(table(spark, sf, "documents"), BM, "doc_id", "text", 20).unionByName(lanes.vector(vectors(spark, sf), QVEC, 20))


TWO = f"WITH {BM25}, {VEC.format(s=L2)}, c AS (SELECT * FROM lex UNION ALL SELECT * FROM vec)"
RRF = """, f AS (SELECT target_type, target_id, round(sum(w / (60 + lane_rank)), 9) AS score, string_agg(lane, '+' ORDER BY lane_rank, lane) AS sources, count(*) AS n_lanes FROM (SELECT *, {w} AS w FROM c) GROUP BY 1, 2)"""


def _fused(df):
    return df.select("target_type", "target_id", F.round("score", 6).alias("score"), "sources")


@query("rrf_two_lanes", TWO + RRF.format(w="1.0::double") + " SELECT target_type, target_id, round(score, 6) AS score, sources FROM f")
def rrf_two_lanes(spark, sf):
    return _fused(fusion.rrf(two_lanes(spark, sf)))


@query("rrf_weighted_lanes", TWO + RRF.format(w="CASE lane WHEN 'lexical' THEN 3.0::double ELSE 1.0::double END") + " SELECT target_type, target_id, round(score, 6) AS score, sources FROM f")
def rrf_weighted_lanes(spark, sf):
    return _fused(fusion.rrf(two_lanes(spark, sf), weights={"lexical": 3.0}))


@query("weighted_sum_fusion", TWO + " SELECT target_type, target_id, round(sum(raw_score * CASE lane WHEN 'vector' THEN 10.0 ELSE 1.0 END), 6) AS score FROM c GROUP BY 1, 2")
def weighted_sum_fusion(spark, sf):
    return fusion.weighted_sum(two_lanes(spark, sf), {"vector": 10.0}).select("target_type", "target_id", F.round("score", 6).alias("score"))


@query("compose_budget_split", TWO + RRF.format(w="1.0::double") + " SELECT target_id, rank, CASE WHEN rank > 12 THEN 'budget_exceeded' END AS omitted FROM (SELECT *, row_number() OVER (ORDER BY score DESC, target_id) AS rank FROM f)")
def compose_budget_split(spark, sf):
    return fusion.compose(fusion.rrf(two_lanes(spark, sf)), 15, 12).select("target_id", "rank", "omitted")


@query("score_normalize", TWO + RRF.format(w="1.0::double") + " SELECT target_id, round(score / max(score) OVER (), 6) AS score FROM f")
def score_normalize(spark, sf):
    return fusion.normalize(fusion.rrf(two_lanes(spark, sf))).select("target_id", F.round("score", 6).alias("score"))


@query("search_dedup", "SELECT p_partkey, p_brand, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1")
def search_dedup(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    return fusion.first_per(p, ["p_brand", "p_type"], [F.desc("p_retailprice"), F.asc("p_partkey")]).drop("p_retailprice")


@query("per_file_cap", views("chunks") + " SELECT doc_id, position FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, position) AS r FROM chunks) WHERE r <= 2")
def per_file_cap(spark, sf):
    c = chunks(spark, sf).select("doc_id", F.col("position").cast("long").alias("position"), F.length("text").alias("n"))
    return fusion.first_per(c, ["doc_id"], [F.desc("n"), F.asc("position")], 2, keep_null="doc_id").drop("n")


SHAPE = """CASE (CASE WHEN regexp_matches(q, '[a-z][A-Z]') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(q, '[A-Za-z0-9]_[A-Za-z0-9]') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(q, '::|->|\\(\\)') THEN 1 ELSE 0 END
  + CASE WHEN regexp_matches(q, '\\.[a-z]{1,4}\\b') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(q, '(?i)\\b(function|class|method|module|struct|impl|call|import)\\b') THEN 1 ELSE 0 END) WHEN 0 THEN 'doc' WHEN 1 THEN 'mixed' WHEN 2 THEN 'mixed' ELSE 'code' END"""


@query("lane_budget_by_shape", f"""SELECT item_id, shape, cast(CASE shape WHEN 'code' THEN 24 WHEN 'mixed' THEN 14 ELSE 6 END AS bigint) AS entity_cap, cast(CASE shape WHEN 'code' THEN 10 WHEN 'mixed' THEN 14 ELSE 16 END AS bigint) AS chunk_cap
  FROM (SELECT item_id, {SHAPE} AS shape FROM (SELECT item_id, CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN 'call the parse_text method' ELSE 'class FooBar::run() in main.rs' END AS q FROM benchmark))""")
def lane_budget_by_shape(spark, sf):
    q = F.when(F.col("item_id") % 3 == 0, F.col("text")).when(F.col("item_id") % 3 == 1, "call the parse_text method").otherwise("class FooBar::run() in main.rs")
    b = table(spark, sf, "benchmark").select("item_id", C.query_shape(q).alias("shape"))
    cap = fusion.lane_caps(F.col("shape"), 40)
    return b.select("item_id", "shape", cap["entity"].cast("long").alias("entity_cap"), cap["chunk"].cast("long").alias("chunk_cap"))


@query("exact_match_injection", views("entities") + """, m AS (SELECT name AS q FROM entities ORDER BY id LIMIT 1), g AS (SELECT id AS target_id, name, (length(kind) + length(type)) / 100.0::double AS score FROM entities WHERE kind = 'Brand#12'),
  a AS (SELECT greatest(coalesce(max(score), 0), 0.05) AS a FROM g)
  SELECT target_id, name, round(score, 6) AS score, coalesce(length(name) >= 3 AND contains(lower(name), 'part 1'), false) AS is_exact FROM (SELECT * FROM g UNION ALL
  SELECT id, name, CASE WHEN lower(name) = 'part 1' THEN a ELSE a * 0.8 END FROM entities, a WHERE length(name) >= 3 AND (contains(lower(name), 'part 1') OR contains('part 1', lower(name))) AND id NOT IN (SELECT target_id FROM g))""")
def exact_match_injection(spark, sf):
    e = entities(spark, sf)
    g = e.filter("kind = 'Brand#12'").select(F.col("id").alias("target_id"), "name", ((F.length("kind") + F.length("type")) / 100.0).alias("score"))
    return fusion.inject_exact(g, e, "part 1").select("target_id", "name", F.round("score", 6).alias("score"), "is_exact")


@query("pack_by_chars", "SELECT item_id, used FROM (SELECT item_id, cast(sum(strlen(CASE WHEN length(text) <= 100 THEN text ELSE substr(text, 1, 100) || chr(10) || '... [truncated]' END)) OVER (ORDER BY item_id) AS bigint) AS used FROM benchmark) WHERE used <= 3000")
def pack_by_chars(spark, sf):
    return fusion.pack(table(spark, sf, "benchmark"), "text", [F.asc("item_id")], 100, 3000).select("item_id", "used")


HYBRID = f"""{views("memories")}, {BM25}, {VEC.format(s=L2)}, fk AS (SELECT 'facts' AS lane, row_number() OVER (ORDER BY total DESC, created_s DESC, id) AS lane_rank, 'memory' AS target_type, id AS target_id FROM
  (SELECT *, {KEYWORD} AS total FROM memories WHERE {REASON} IS NULL) WHERE total IS NOT NULL QUALIFY lane_rank <= 20),
  te AS (SELECT 'temporal' AS lane, row_number() OVER (ORDER BY created_s DESC, id) AS lane_rank, 'memory' AS target_type, id AS target_id FROM memories WHERE status = 'active' QUALIFY lane_rank <= 20),
  c AS (SELECT * FROM fk UNION ALL SELECT * FROM te UNION ALL SELECT lane, lane_rank, target_type, target_id FROM lex UNION ALL SELECT lane, lane_rank, target_type, target_id FROM vec)
  {RRF.format(w="1.0::double")} SELECT target_type, target_id, round(score, 6) AS score, sources, rank, CASE WHEN rank > 25 THEN 'budget_exceeded' END AS omitted FROM (SELECT *, row_number() OVER (ORDER BY score DESC, target_id) AS rank FROM f)"""


@query("hybrid_recall", HYBRID)
def hybrid_recall(spark, sf):
    """Facts, temporal, lexical and vector lanes, fused by reciprocal rank and cut to a budget with omissions kept."""
    m = memories(spark, sf)
    all_lanes = {"facts": lanes.facts_lane(m, Q, NOW, 20), "temporal": lanes.temporal(m, NOW, 20), "lexical": lanes.bm25(table(spark, sf, "documents"), BM, "doc_id", "text", 20), "vector": lanes.vector(vectors(spark, sf), QVEC, 20)}
    cands, _ = fusion.route(all_lanes, [])
    return fusion.compose(fusion.rrf(cands), 30, 25).select("target_type", "target_id", F.round("score", 6).alias("score"), "sources", "rank", "omitted")


@query("mmr_rerank")
def mmr_rerank(spark, sf):
    """The 60 nearest of all embeddings, reranked to 20."""
    v = vectors(spark, sf)
    near = lanes.vector(v, QVEC, 60).select("target_id", F.col("raw_score").alias("score"))
    cands = v.select(F.col("id").alias("target_id"), "embedding").join(F.broadcast(near), "target_id")
    return fusion.mmr(cands.select(F.lit("q").alias("query"), "target_id", "score", "embedding"), 0.5, 20)

