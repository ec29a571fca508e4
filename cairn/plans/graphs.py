"""Queries of graph analytics and symbol scores, with oracles where SQL can say them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.operators import graph
from cairn.sources.domain import call_edges, entities, table, views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ROUNDS = 5


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


E = views("edges")


@query("in_degree", E + " SELECT dst AS id, count(*) AS in_degree FROM edges GROUP BY 1")
def in_degree(spark, sf):
    return graph.in_degree(call_edges(spark, sf))


@query("dead_code", E + " SELECT DISTINCT src AS id FROM edges WHERE src NOT IN (SELECT dst FROM edges)")
def dead_code(spark, sf):
    return graph.dead_code(call_edges(spark, sf))


@query("repository_stats", E + " SELECT (SELECT count(DISTINCT x) FROM (SELECT src AS x FROM edges UNION ALL SELECT dst FROM edges)) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges")
def repository_stats(spark, sf):
    e = call_edges(spark, sf)
    return e.select(F.explode(F.array(F.struct("src", F.lit(1).alias("n")), F.struct(F.col("dst").alias("src"), F.lit(0).alias("n")))).alias("x")).agg(F.count_distinct("x.src").alias("n_nodes"), F.sum("x.n").alias("n_edges"))


def _walk(a: str, b: str, start: str, depth: int, out: str) -> str:
    return E.replace("WITH ", "WITH RECURSIVE ") + f", e AS (SELECT DISTINCT {a} AS a, {b} AS b FROM edges), w AS (SELECT b AS id, 1 AS hops FROM e WHERE a IN ({start}) UNION SELECT e.b, w.hops + 1 FROM w JOIN e ON e.a = w.id WHERE w.hops < {depth}) {out}"


HUBS = "SELECT src FROM (SELECT src, count(*) AS n FROM edges GROUP BY 1 ORDER BY n DESC, src LIMIT 3)"


def hubs(e):
    return [r["src"] for r in e.groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").limit(3).collect()]


SINKS = HUBS.replace("src", "dst")


def sinks(e):
    return [r["dst"] for r in e.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dst").limit(3).collect()]


@query("descendants_k", _walk("src", "dst", HUBS, 4, "SELECT id, cast(min(hops) AS bigint) AS hops FROM w GROUP BY 1"))
def descendants_k(spark, sf):
    e = call_edges(spark, sf)
    return graph.reach(e, hubs(e), 4).select("id", F.col("hops").cast("long").alias("hops"))


@query("ancestors_k", _walk("dst", "src", SINKS, 4, "SELECT id, cast(min(hops) AS bigint) AS hops FROM w GROUP BY 1"))
def ancestors_k(spark, sf):
    e = call_edges(spark, sf)
    return graph.reach(e, sinks(e), 4, reverse=True).select("id", F.col("hops").cast("long").alias("hops"))


def _rank_sql(tele: str) -> str:
    sql = E + ", v AS MATERIALIZED (SELECT id, deg FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges) LEFT JOIN (SELECT src AS id, count(*) AS deg FROM edges GROUP BY 1) USING (id))"
    sql += f", t AS MATERIALIZED (SELECT id, deg, {tele} AS tele FROM v), r0 AS MATERIALIZED (SELECT id, deg, tele, 1.0::double / (SELECT count(*) FROM t) AS rank FROM t)"
    for r in range(1, ROUNDS + 1):
        p = f"r{r - 1}"
        sql += f""", r{r} AS MATERIALIZED (SELECT t.id, t.deg, t.tele, 0.15::double * t.tele + 0.85::double * (coalesce(g.got, 0) + d.dangling * t.tele) AS rank FROM t
          LEFT JOIN (SELECT dst AS id, sum(rank / deg) AS got FROM edges JOIN {p} ON {p}.id = edges.src GROUP BY 1) g USING (id), (SELECT coalesce(sum(rank), 0) AS dangling FROM {p} WHERE deg IS NULL) d)"""
    return sql + f" SELECT id, round(rank, 6) AS rank FROM r{ROUNDS}"


@query("pagerank_fixed_n", _rank_sql("1.0::double / (SELECT count(*) FROM v)"))
def pagerank_fixed_n(spark, sf):
    return graph.pagerank(call_edges(spark, sf), rounds=ROUNDS).select("id", F.round("rank", 6).alias("rank"))


@query("ppr_fixed_n", _rank_sql(f"CASE WHEN id IN ({HUBS}) THEN 1.0::double / 3 ELSE 0.0::double END"))
def ppr_fixed_n(spark, sf):
    e = call_edges(spark, sf)
    return graph.pagerank(e, rounds=ROUNDS, seeds=hubs(e)).select("id", F.round("rank", 6).alias("rank"))


NODE = "(SELECT src FROM edges GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 1)"


@query("neighbors", E + f" SELECT DISTINCT src, dst FROM edges WHERE src = {NODE} OR dst = {NODE} ORDER BY src, dst LIMIT 100")
def neighbors(spark, sf):
    e = call_edges(spark, sf)
    return graph.neighbors(e, hubs(e)[0], 100)


@query("subgraph_k", E.replace("WITH ", "WITH RECURSIVE ") + f""", b AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), w AS (SELECT {NODE} AS id, 0 AS hops UNION SELECT b.b, w.hops + 1 FROM w JOIN b ON b.a = w.id WHERE w.hops < 2)
  SELECT DISTINCT src, dst FROM edges WHERE src IN (SELECT id FROM w) OR dst IN (SELECT id FROM w) ORDER BY src, dst LIMIT 200""")
def subgraph_k(spark, sf):
    e = call_edges(spark, sf)
    return graph.subgraph(e, hubs(e)[0], 2, 200)


@query("shortest_path_length", _walk("src", "dst", "SELECT src FROM edges GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 1", 8, "SELECT cast(hops AS bigint) AS hops, count(*) AS n FROM (SELECT id, min(hops) AS hops FROM w GROUP BY 1) GROUP BY 1"))
def shortest_path_length(spark, sf):
    e = call_edges(spark, sf)
    return graph.reach(e, hubs(e)[:1], 8).groupBy(F.col("hops").cast("long").alias("hops")).agg(F.count(F.lit(1)).alias("n"))


@query("shortest_path_nodes")
def shortest_path_nodes(spark, sf):
    e = graph.durable(call_edges(spark, sf).select("src", "dst"))
    return graph.farthest_path(e, hubs(e)[0], 6)


@query("bounded_ancestors")
def bounded_ancestors(spark, sf):
    e = call_edges(spark, sf)
    return graph.reach_bounded(e, sinks(e)[0], 4, 10)


@query("betweenness")
def betweenness(spark, sf):
    return graph.betweenness(call_edges(spark, sf)).select("id", F.round("score", 6).alias("score"))


@query("communities")
def communities(spark, sf):
    return graph.communities(call_edges(spark, sf))


def _labels(spark, sf):
    e = call_edges(spark, sf)
    return e, graph.communities(e, 2)


@query("community_overview")
def community_overview(spark, sf):
    e, lab = _labels(spark, sf)
    return graph.community_overview(e, lab, 20)[0]


@query("community_summary_lane")
def community_summary_lane(spark, sf):
    e = call_edges(spark, sf)
    lab = graph.communities(e)
    names = entities(spark, sf).select(F.regexp_extract("id", r"(\d+)", 1).cast("long").alias("id"), "name")
    s = graph.community_summary(lab, e.withColumn("predicate", F.lit("calls")), names)
    score = sum((F.col("summary").contains(w).cast("int") for w in ("Part", "12", "calls")), F.lit(0))
    best = s.orderBy(F.desc(score), "label").limit(1)
    return lab.join(F.broadcast(best.select("label")), "label").select(F.col("id").cast("string").alias("target_id"), F.lit(1.0).alias("raw_score"))


@query("hierarchy_nodes")
def hierarchy_nodes(spark, sf):
    """One layer-0 node per community: id, layer, n_members, members (the first twenty), by the same labels as hierarchy_build."""
    _, lab = _labels(spark, sf)
    first = lab.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("id"))).filter("r <= 20").groupBy("label").agg(F.array_sort(F.collect_list("id")).alias("members"))
    n = lab.groupBy("label").agg(F.count(F.lit(1)).alias("n_members"))
    return n.join(first, "label").select(F.col("label").alias("id"), F.lit(0).alias("layer"), "n_members", "members")


@query("hierarchy_build")
def hierarchy_build(spark, sf):
    """Directed links between the nodes of hierarchy_nodes, strength by calls."""
    e, lab = _labels(spark, sf)
    a, b = lab.select(F.col("id").alias("src"), F.col("label").alias("source_id")), lab.select(F.col("id").alias("dst"), F.col("label").alias("target_id"))
    return e.join(a, "src").join(b, "dst").filter("source_id != target_id").groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("strength"))


@query("associative_lane")
def associative_lane(spark, sf):
    e = graph.durable(call_edges(spark, sf).select("src", "dst"))
    both = e.select("src", "dst").union(e.filter("src != dst").select("dst", "src")).toDF("src", "dst")
    r = graph.pagerank(both, rounds=20, tol=1e-6, seeds=hubs(e))
    return r.orderBy(F.desc("rank"), "id").limit(20).select(F.col("id").cast("string").alias("target_id"), F.round("rank", 6).alias("raw_score"))


SYM_NOW = 852076800
SYM = E + f""", s AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN {SYM_NOW} - p_size * 86400 END AS f, CASE WHEN p_partkey % 7 = 0 THEN {SYM_NOW} - 1 END AS u, p_size % 4 AS changes FROM part),
  d AS (SELECT id, changes, CASE WHEN f IS NOT NULL AND f <= {SYM_NOW} AND NOT coalesce(u <= {SYM_NOW}, false) THEN pow(2.0::double, -(({SYM_NOW} - f) / 86400.0::double) / 14) ELSE 0.0::double END AS recent,
    pow(coalesce(i, 0)::double, 0.7) * pow(1.0::double + coalesce(o, 0), 0.3) AS impact FROM s LEFT JOIN (SELECT dst AS id, count(*) AS i FROM edges GROUP BY 1) USING (id) LEFT JOIN (SELECT src AS id, count(*) AS o FROM edges GROUP BY 1) USING (id)),
  x AS (SELECT id, recent, impact, 0.5 * recent / max(recent) OVER () + 0.5 * impact / max(impact) OVER () AS compound, 1 / (1.0::double + changes) AS novel FROM d)"""


def _scores(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    s = p.select(k.alias("id"), F.when(k % 5 != 0, SYM_NOW - F.col("p_size") * 86400).alias("from_s"), F.when(k % 7 == 0, SYM_NOW - 1).alias("until_s"), (F.col("p_size") % 4).alias("changes"))
    return graph.symbol_scores(s, call_edges(spark, sf), SYM_NOW)


def _symbol(col: str):
    @query(f"symbol_{col}", SYM + f" SELECT id, round({col}, 6) AS {col} FROM x")
    def run(spark, sf):
        return _scores(spark, sf).select("id", F.round(col, 6).alias(col))


for _c in ("recent", "impact", "compound", "novel"):
    _symbol(_c)


@query("symbol_directional", "WITH a AS (SELECT p_partkey AS id, p_brand AS h FROM part WHERE p_partkey % 10 <> 0), b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN 'x' ELSE p_brand END AS h FROM part WHERE p_partkey % 9 <> 0) SELECT count(*) FILTER (a.h IS NULL) AS added, count(*) FILTER (b.h IS NULL) AS removed, count(*) FILTER (a.h <> b.h) AS modified FROM a FULL JOIN b USING (id)")
def symbol_directional(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    return graph.directional(p.filter(k % 10 != 0).select(k.alias("id"), F.col("p_brand").alias("hash")), p.filter(k % 9 != 0).select(k.alias("id"), F.when(k % 6 == 0, "x").otherwise(F.col("p_brand")).alias("hash")))

