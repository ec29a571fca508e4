"""Retrieval lanes: each returns candidates with lane, lane_rank, target_type, target_id, content, raw_score.

lane_rank is made in the lane with a total order, since arrival order means nothing in a distributed plan. Where only the
best k are wanted, a plain ordered limit comes first (top-k per partition), and the rank is numbered over those k rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import columns as C
from cairn.operators import filters
from cairn.operators.graph import durable
from cairn.sources.domain import spread


def candidates(df: DataFrame, lane: str, target_type: str, k: int, *order) -> DataFrame:
    """The k first rows of df(target_id, content, raw_score, ...) in candidate form."""
    order = order or (F.desc("raw_score"), F.asc("target_id"))
    top = df.orderBy(*order).limit(k)
    rank = F.row_number().over(Window.orderBy(*order))  # over k rows
    return top.select(F.lit(lane).alias("lane"), rank.cast("long").alias("lane_rank"), F.lit(target_type).alias("target_type"), "target_id", "content", F.col("raw_score").cast("double").alias("raw_score"))


def keyword_score(query: str, text: str = "text", confidence: str = "confidence") -> F.Column:
    """min(1, 0.85 rel + 0.15 confidence), rel 1 for the whole query contained, else the share of terms; null for no hit."""
    terms = C.facts_terms(query)
    hay = F.lower(F.coalesce(F.col(text), F.lit("")))
    exact = hay.contains(query.strip().lower()) if query.strip() else F.lit(False)
    hit = sum((F.when(hay.contains(t), 1).otherwise(0) for t in terms), F.lit(0))
    rel = F.when(exact, F.lit(1.0)).otherwise(hit / F.lit(float(max(1, len(terms)))))
    return F.when(exact | (hit > 0), F.least(F.lit(1.0), 0.85 * rel + 0.15 * F.coalesce(confidence, F.lit(1.0))))


def cue_score(cues: list[tuple[str, str, str]], fields: dict[str, str]) -> F.Column:
    """Share of the recognised cues (slot, operator, value) that match; null without a match."""
    known = [c for c in cues if c[0] in fields]
    hit = sum((F.when(filters.cue_matches(F.col(fields[s]), op, v), 1).otherwise(0) for s, op, v in known), F.lit(0))
    return F.when(hit > 0, hit / F.lit(float(len(known)))) if known else F.lit(None).cast("double")


def facts(memories: DataFrame, query: str, now: int, limit: int, budget: int | None = None, cues: list | None = None, fields: dict | None = None, mode: str = "keyword") -> DataFrame:
    """Every scored record with its rank and omit_reason: policy first, then score order, then budget_exceeded."""
    kw = keyword_score(query) if mode in ("keyword", "both") else F.lit(None).cast("double")
    cue = cue_score(cues or [], fields or {}) if mode in ("cue", "both") else F.lit(None).cast("double")
    scored = memories.withColumn("total", F.greatest(kw, cue)).filter("total is not null").withColumn("reason", filters.omit_reason(now)).filter("reason is null or reason != 'archived'")
    k = min(limit, budget or limit)
    ok = scored.filter("reason is null")
    order = (F.desc("total"), F.desc("created_s"), F.asc("id"))
    # the k best alone are ranked; the rest need no order
    best = ok.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    out = scored.join(F.broadcast(best.select("id", "rank")), "id", "left")  # k rows
    return out.withColumn("reason", F.when(F.col("reason").isNull() & F.col("rank").isNull(), "budget_exceeded").otherwise(F.col("reason"))).select(*scored.columns, "rank")


def facts_lane(memories: DataFrame, query: str, now: int, k: int = 20) -> DataFrame:
    """The k best records by keyword score as candidates; records left out by policy take no place."""
    ok = memories.withColumn("raw_score", keyword_score(query)).filter(F.col("raw_score").isNotNull() & filters.omit_reason(now).isNull())
    s = ok.select(F.col("id").alias("target_id"), F.col("text").alias("content"), "raw_score", "created_s")
    return candidates(s, "facts", "memory", k, F.desc("raw_score"), F.desc("created_s"), F.asc("target_id"))


def temporal(memories: DataFrame, now: int, k: int = 20, half_life: float = 14.0) -> DataFrame:
    age = (F.lit(now) - F.col("created_s")) / F.lit(86400.0)
    s = memories.filter("status = 'active'").select(F.col("id").alias("target_id"), F.col("text").alias("content"), C.recency(age, half_life).alias("raw_score"), "created_s")
    return candidates(s, "temporal", "memory", max(1, k), F.desc("created_s"), F.asc("target_id"))


def graph_term_score(query: str, text: F.Column) -> F.Column:
    """Sum over terms: 3 equal, 2 at either end, 1 contained."""
    t = F.lower(text)
    return sum((F.when(t == w, 3).when(t.startswith(w) | t.endswith(w), 2).when(t.contains(w), 1).otherwise(0) for w in C.graph_terms(query)), F.lit(0))


def graph_terms(entities: DataFrame, query: str, k: int = 20, lane: str = "graph") -> DataFrame:
    s = entities.select(F.col("id").alias("target_id"), F.col("name").alias("content"), graph_term_score(query, F.col("name")).alias("raw_score")).filter("raw_score > 0")
    return candidates(s, lane, "entity", k)


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, term, tf, len: the lexical index of identifier-normalised text."""
    tok = docs.select(F.col(id_col).alias("doc"), F.filter(F.split(C.identifier_text(F.coalesce(F.col(text_col), F.lit(""))), " "), lambda x: x != "").alias("t"))
    return tok.select("doc", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("doc", "term", "len").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, query: list[str], id_col: str, text_col: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Any-term BM25. The texts are read once: length and counts of the query's terms are written as short rows, which the
    statistics and the scores then read. Terms are counted by replacement, so no text is split into an array."""
    text = F.trim(C.identifier_text(F.coalesce(F.col(text_col), F.lit(""))))
    tok = spread(docs.select(F.col(id_col).cast("string").alias("target_id"), F.col(text_col))).select("target_id", F.concat(F.lit(" "), F.replace(text, F.lit(" "), F.lit("  ")), F.lit(" ")).alias("t"))
    gap = F.length("t") - F.length(F.replace("t", F.lit("  "), F.lit("")))
    n_of = lambda q: ((F.length("t") - F.length(F.replace("t", F.lit(f" {q} "), F.lit("")))) / (len(q) + 2)).cast("int")
    counted = durable(tok.select("target_id", F.when(F.length("t") > 2, (gap / 2).cast("int") + 1).otherwise(0).alias("len"), *(n_of(q).alias(f"tf{i}") for i, q in enumerate(query))))
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(query))))
    hit = counted.filter(" or ".join(f"tf{i} > 0" for i in range(len(query)))).join(F.broadcast(stats))  # one row
    part = lambda i: F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    s = hit.select("target_id", F.lit("").alias("content"), F.round(sum((part(i) for i in range(1, len(query))), part(0)), 9).alias("raw_score"))
    return candidates(s, "lexical", "chunk", k)


def vector(vectors: DataFrame, query: list[float], k: int, metric: str = "l2") -> DataFrame:
    q = F.array(*(F.lit(float(x)) for x in query))
    v = F.col("embedding")
    s = 1 / (1 + F.greatest(C.l2(v, q), F.lit(0.0))) if metric == "l2" else C.cosine(v, q)
    rows = vectors.filter(F.size(v) == len(query)).select(F.col("id").alias("target_id"), F.lit("").alias("content"), F.round(s, 9).alias("raw_score"))
    return candidates(rows, "vector", "chunk", k)


def belief(beliefs: DataFrame, subject_key: str, at: int) -> DataFrame:
    """The latest valid live belief of a subject, if any."""
    live = beliefs.filter((F.col("subject_key") == subject_key) & (F.col("status") == "active") & C.live_at(F.col("from_s"), F.col("until_s"), F.lit(at)))
    s = live.select(F.col("id").alias("target_id"), F.col("content"), F.coalesce("confidence", F.lit(1.0)).alias("raw_score"), "from_s")
    return candidates(s, "belief", "belief", 1, F.desc("from_s"), F.asc("target_id"))


def resolve_seeds(entities: DataFrame, query: str) -> DataFrame:
    """Entities whose name equals or contains a query token."""
    tokens = [w.strip("".join(c for c in w if not c.isalnum())).lower() for w in query.split()]
    name = F.lower("name")
    hit = F.lit(False)
    for t in (t for t in tokens if t):
        hit |= name.contains(t)
    return entities.filter(hit)
