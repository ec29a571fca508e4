"""Graph analytics over edge tables (src, dst) of any id type.

Where a value per node fits an array, iterations step over blocks of links (dense.py). Else they are plans over DataFrames; a round's
result is written to the shared folder every few rounds, so lineage stays short and a lost executor costs at most those rounds.
Sequential algorithms (single-level Louvain) run per connected group while a group fits a task; betweenness runs one breadth-first search per source over broadcast adjacency of checked size.
"""

from __future__ import annotations

import atexit
import itertools
import shutil
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators import dense

MAX_ADJACENCY_EDGES = 1_000_000  # and as many bytes of ids as 64 an edge
MAX_TASK_EDGES = 8_000_000  # edges of a component that a task of betweenness holds
MAX_COMPONENT_EDGES = 2_000_000  # edges of a component that one task holds


def durable(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder and read again."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="cairn-graph-")
        atexit.register(shutil.rmtree, base, True)
        base = f"file://{base}"
    path = f"{base.rstrip('/')}/cairn-graph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def arrays(edges: DataFrame, both: bool, more: list | None = None) -> tuple | None:
    """(dense.Dense over edges and more nodes, a function that turns its numbers in columns of a table back into ids).

    None if there are more than dense.MAX_NODES nodes, or null ids. Ids that are no integers are numbered in their order first.
    """
    spark, kind = edges.sparkSession, edges.schema["src"].dataType.simpleString()
    if edges.schema["dst"].dataType.simpleString() != kind:
        return None
    e = durable(edges.select("src", "dst"))
    every = nodes(e)
    if more:
        every = every.unionByName(spark.createDataFrame([(x,) for x in more], f"id {kind}")).distinct()
    every = durable(every)
    if every.count() > dense.MAX_NODES or not every.filter("id is null").isEmpty():
        return None
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return dense.Dense(e, every.toArrow().column("id").to_numpy(), both), lambda df, *cols: df
    named = durable(every.orderBy("id").withColumn("n", F.monotonically_increasing_id()))
    for c in ("src", "dst"):
        e = e.join(named.select(F.col("id").alias(c), F.col("n").alias(f"{c}_n")), c)
    e = durable(e.select(F.col("src_n").alias("src"), F.col("dst_n").alias("dst")))

    def back(df: DataFrame, *cols: str) -> DataFrame:
        order = df.columns
        for c in cols:
            df = df.join(named.select(F.col("n").alias(c), F.col("id").alias("__id")), c).drop(c).withColumnRenamed("__id", c)
        return df.select(order)

    return dense.Dense(e, named.select("n").toArrow().column("n").to_numpy(), both), back


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))


def dead_code(edges: DataFrame) -> DataFrame:
    """Nodes that nothing points to."""
    return edges.select(F.col("src").alias("id")).distinct().join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def reach(edges: DataFrame, start: list, depth: int, reverse: bool = False) -> DataFrame:
    """id, hops: nodes within depth hops of any start; a start node itself only if a cycle leads back to it."""
    e = edges.select(F.col("dst").alias("a"), F.col("src").alias("b")) if reverse else edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    e = durable(e.distinct())
    spark = edges.sparkSession
    front = spark.createDataFrame([(x,) for x in start], "a " + e.schema["a"].dataType.simpleString())
    seen = None
    for hop in range(1, depth + 1):
        nxt = e.join(front, "a", "left_semi").select(F.col("b").alias("id")).distinct()
        if seen is not None:
            nxt = nxt.join(seen, "id", "left_anti")
        nxt = nxt.withColumn("hops", F.lit(hop))
        if hop % 3 == 0:
            nxt = durable(nxt)
            if nxt.isEmpty():
                break
        seen = nxt if seen is None else seen.unionByName(nxt)
        front = nxt.select(F.col("id").alias("a"))
    return seen if seen is not None else spark.createDataFrame([], f"id {e.schema['a'].dataType.simpleString()}, hops int")


def reach_bounded(edges: DataFrame, start, depth: int, cap: int, reverse: bool = True) -> DataFrame:
    """The first cap nodes in (hops, id) order, and whether more were reachable."""
    r = reach(edges, [start], depth, reverse)
    ranked = r.orderBy("hops", "id").limit(cap + 1)
    n = F.count(F.lit(1)).over(Window.partitionBy())  # cap + 1 rows at most
    rn = F.row_number().over(Window.orderBy("hops", "id"))
    return ranked.withColumn("truncated", n > cap).withColumn("__r", rn).filter(F.col("__r") <= cap).drop("__r")


def shortest_path(edges: DataFrame, a, b) -> DataFrame:
    """step, id of a shortest path from a to b, both included; of equal ones that with the smallest parents. No rows if none.

    The search ends at b or when no new node is reached, whatever the length.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    if a == b:
        return spark.createDataFrame([(0, a)], f"step int, id {kind}")
    if kind in ("tinyint", "smallint", "int", "bigint") and (found := arrays(edges, both=False, more=[a, b])):
        return spark.createDataFrame(list(enumerate(dense.path(found[0], a, b))), f"step int, id {kind}")
    e = durable(edges.select("src", "dst").distinct())
    seen = spark.createDataFrame([(a, None, 0)], f"id {kind}, parent {kind}, hops int")
    front = seen
    for hop in itertools.count(1):
        nxt = e.join(front.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        nxt = durable(nxt.join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(hop)))
        if nxt.isEmpty():
            return spark.createDataFrame([], f"step int, id {kind}")
        seen, front = seen.unionByName(nxt), nxt
        if not nxt.filter(F.col("id") == b).isEmpty():
            path, at = [], b
            for step in range(hop, -1, -1):  # one row a hop
                path.append((step, at))
                row = seen.filter((F.col("id") == at) & (F.col("hops") == step)).select("parent").first()
                at = row["parent"]
            return spark.createDataFrame(sorted(path), f"step int, id {kind}")


def farthest_path(edges: DataFrame, start, depth: int) -> DataFrame:
    """shortest_path from start to the node that reach() finds farthest within depth hops, the least of equal ones."""
    kind = edges.schema["src"].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint") and (found := arrays(edges, both=False, more=[start])):
        g = found[0]
        return edges.sparkSession.createDataFrame(list(enumerate(dense.path(g, start, dense.farthest(g, start, depth)))), f"step int, id {kind}")
    e = durable(edges.select("src", "dst"))
    far = reach(e, [start], depth).orderBy(F.desc("hops"), "id").first()
    return shortest_path(e, start, far["id"] if far else start)


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20, tol: float | None = None, seeds: list | None = None, every: int = 5) -> DataFrame:
    """id, rank. Parallel edges count; dangling mass spreads evenly, or to the seeds, to which teleports then go too.

    The first vector is uniform over all nodes in either form. Seeds without edges take part; no seed gives no rows.
    With tol the loop ends when no rank moves by more, looked at each `every` rounds.
    """
    spark = edges.sparkSession
    all_nodes = nodes(edges)
    if seeds is not None:
        if not seeds:
            return spark.createDataFrame([], f"id {edges.schema['src'].dataType.simpleString()}, rank double")
    if edges.schema["src"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") and (found := arrays(edges, both=False, more=seeds)):
        return found[0].table(dense.ranks(found[0], damping, rounds, tol, seeds, every), "rank", "double")
    if seeds is not None:
        s = spark.createDataFrame([(x,) for x in seeds], f"id {edges.schema['src'].dataType.simpleString()}")
        all_nodes = all_nodes.unionByName(s).distinct()
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    v = durable(all_nodes.join(out.withColumnRenamed("src", "id"), "id", "left"))
    n = v.count()
    if seeds is not None:
        tele = F.when(F.col("id").isin(seeds), 1.0 / len(set(seeds))).otherwise(0.0)
    else:
        tele = F.lit(1.0 / max(n, 1))
    v = v.withColumn("tele", tele)
    weighted = durable(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")))
    rank = v.withColumn("rank", F.lit(1.0 / max(n, 1)))
    old = rank
    for r in range(1, rounds + 1):
        gone = rank.filter("deg is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("dangling"))
        sent = weighted.join(rank.filter("deg is not null").select(F.col("id").alias("src"), (F.col("rank") / F.col("deg")).alias("share")), "src")
        got = sent.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("m")).alias("got"))
        rank = v.join(got, "id", "left").join(F.broadcast(gone)).select(
            "id", "deg", "tele", ((1 - damping) * F.col("tele") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("dangling") * F.col("tele"))).alias("rank")
        )
        if r % every == 0 or r == rounds:
            rank = durable(rank)
            if tol is not None:
                move = rank.join(old.select("id", F.col("rank").alias("was")), "id").agg(F.max(F.abs(F.col("rank") - F.col("was")))).first()[0]
                if move is not None and move < tol:
                    break
            old = rank
    return rank.select("id", "rank")


def betweenness(edges: DataFrame) -> DataFrame:
    """id, score: Brandes over directed, unweighted edges (parallel ones multiply paths), not normalised.

    A task holds one component of up to MAX_TASK_EDGES edges and searches from some of its nodes, many at once. Of larger components
    the adjacency is broadcast after a check of its size; sources are spread over tasks, each adding up its own scores.
    """
    if found := arrays(edges, both=True):
        scores = dense.betweenness(found[0], MAX_TASK_EDGES)
        if scores is not None:
            return found[1](found[0].table(scores, "score", "double"), "id")
    spark = edges.sparkSession
    n, size = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col("src").cast("string")) + F.octet_length(F.col("dst").cast("string"))), F.lit(0))).first()
    if n > MAX_ADJACENCY_EDGES or size > 64 * MAX_ADJACENCY_EDGES:
        raise ValueError(f"{n} edges, {size} bytes of ids: betweenness needs the adjacency in memory; take a subgraph of at most {MAX_ADJACENCY_EDGES} edges")
    adj: dict = {}
    for r in edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")).collect():  # bounded above
        adj.setdefault(r["src"], []).append((r["dst"], r["m"]))
    shared = spark.sparkContext.broadcast(adj)
    kind = edges.schema["src"].dataType.simpleString()

    def run(it):
        from collections import defaultdict, deque

        graph = shared.value
        total: dict = defaultdict(float)
        for pdf in it:
            for s in pdf["id"]:
                sigma, dist, pred, order, todo = defaultdict(float), {s: 0}, defaultdict(list), [], deque([s])
                sigma[s] = 1.0
                while todo:
                    v = todo.popleft()
                    order.append(v)
                    for w, m in graph.get(v, ()):
                        if w not in dist:
                            dist[w] = dist[v] + 1
                            todo.append(w)
                        if dist[w] == dist[v] + 1:
                            sigma[w] += sigma[v] * m
                            pred[w].append((v, m))
                delta: dict = defaultdict(float)
                for w in reversed(order):
                    for v, m in pred[w]:
                        delta[v] += sigma[v] * m / sigma[w] * (1 + delta[w])
                    if w != s:
                        total[w] += delta[w]
        if total:
            yield pd.DataFrame({"id": list(total), "score": list(total.values())})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = nodes(edges)
    got = every.repartition(parts).mapInPandas(run, f"id {kind}, score double").groupBy("id").agg(F.sum("score").alias("score"))
    return every.join(got, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """id, component (its least id): labels fall to the least neighbour's and jump to their label's label until they rest."""
    if found := arrays(edges, both=True):
        g, back = found
        return back(g.table(g.components(), "component", "", named=True), "id", "component")
    both = durable(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    lab = durable(nodes(edges).select("id", F.col("id").alias("c")))
    for _ in range(rounds):
        low = both.join(lab.select(F.col("id").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("c").alias("m"))
        near = lab.join(low, "id", "left").select("id", "c", F.least("c", F.coalesce("m", "c")).alias("d"))
        jump = near.join(near.select(F.col("id").alias("d"), F.col("d").alias("e")), "d").select("id", "c", F.least("d", "e").alias("d"))
        jump = durable(jump)
        moved = not jump.filter("c != d").isEmpty()
        lab = jump.select("id", F.col("d").alias("c"))
        if not moved:
            return lab.select("id", F.col("c").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def communities(edges: DataFrame, passes: int = 20) -> DataFrame:
    """id, label: Louvain local moving, labels are the least member's id. Self-loops count for nothing.

    Connected components of up to MAX_COMPONENT_EDGES edges are moved node by node, edges sorted by src and dst, each
    component one task. Larger ones would not fit a task: their nodes move side by side (moved_together), which is the same
    rule in another order.
    """
    if found := arrays(edges, both=True):
        g, back = found
        return durable(back(g.table(dense.communities(g, passes, MAX_COMPONENT_EDGES), "label", "", named=True), "id", "label"))
    kind = edges.schema["src"].dataType.simpleString()
    comp = components(edges)
    e = edges.join(comp.withColumnRenamed("id", "src"), "src").select("component", "src", "dst")
    size = durable(e.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    large = size.filter(F.col("n") > MAX_COMPONENT_EDGES).select("component")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x = np.unique(pdf[["src", "dst"]].to_numpy().ravel(), return_inverse=True)
        a, b = x.reshape(-1, 2).T
        o = np.lexsort((b, a))
        node, head = dense.local_moving(a[o], b[o], passes)
        return pd.DataFrame({"id": ids[node], "head": ids[head]})

    small = durable(e.join(large, "component", "left_anti").groupBy("component").applyInPandas(run, f"id {kind}, head {kind}")).select("id", F.col("head").alias("label"))
    if large.isEmpty():
        return small
    return small.unionByName(moved_together(e.join(large, "component", "left_semi"), passes))


def moved_together(e: DataFrame, passes: int) -> DataFrame:
    """id, label of e(component, src, dst): each pass moves first one half of the nodes, then the other, drawn anew by hash.

    Nodes of a half see the other half at rest, so pairs don't swap for ever. A node goes to the neighbouring community of
    the largest gain, ties to the lower one. Every step is joins and aggregations that combine before they shuffle.
    """
    both = e.filter("src != dst").select("component", "src", "dst").union(e.filter("src != dst").select("component", F.col("dst"), F.col("src"))).toDF("component", "src", "dst")
    w = durable(both.groupBy("component", "src", "dst").agg(F.count(F.lit(1)).alias("w")))
    deg = w.groupBy("component", "src").agg(F.sum("w").alias("deg"))
    total = w.groupBy("component").agg(F.sum("w").alias("m2"))
    lab = durable(deg.join(total, "component").select(F.col("src").alias("id"), F.col("src").alias("com"), "deg", "m2"))
    for p in range(passes):
        moved = 0
        for half in (0, 1):
            tot = lab.groupBy("com").agg(F.sum("deg").alias("tot"))
            link = w.join(lab.select(F.col("id").alias("dst"), "com"), "dst").groupBy(F.col("src").alias("id"), "com").agg(F.sum("w").alias("k"))
            turn = lab.filter(F.pmod(F.xxhash64("id", F.lit(p)), F.lit(2)) == half).select("id", F.col("com").alias("own"), "deg", "m2")
            stay = turn.select("id", F.col("own").alias("com"), F.lit(0).cast("long").alias("k"))  # the own community counts without a link too
            cand = link.join(turn.select("id"), "id", "left_semi").unionByName(stay).groupBy("id", "com").agg(F.sum("k").alias("k")).join(turn, "id").join(tot, "com")
            rest = F.col("tot") - F.when(F.col("com") == F.col("own"), F.col("deg")).otherwise(0)
            gain = F.round(F.col("k") - rest * F.col("deg") / F.col("m2"), 9)
            best = cand.withColumn("gain", gain).groupBy("id").agg(F.min(F.struct((-F.col("gain")).alias("loss"), (F.col("com") != F.col("own")).alias("away"), "com")).alias("b"))
            nxt = durable(lab.join(best.select("id", F.col("b.com").alias("to")), "id", "left").select("id", F.coalesce("to", "com").alias("com"), "deg", "m2", F.coalesce(F.col("to") != F.col("com"), F.lit(False)).alias("went")))
            moved += nxt.filter("went").count()
            lab = nxt.drop("went")
        if not moved:
            break
    least = lab.groupBy("com").agg(F.min("id").alias("label"))
    return lab.join(least, "com").select("id", "label")


def community_overview(edges: DataFrame, labels: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(label, size) of the largest communities, and (a, b, weight) of undirected edges between them, at most 4 per node."""
    top = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "label").limit(limit)
    e = edges.join(labels.select(F.col("id").alias("src"), F.col("label").alias("x")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("y")), "dst").filter("x != y")
    pair = e.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))
    ids = top.select("label")
    meta = pair.join(ids.withColumnRenamed("label", "a"), "a", "left_semi").join(ids.withColumnRenamed("label", "b"), "b", "left_semi")
    return top, meta.orderBy(F.desc("weight"), "a", "b").limit(4 * limit)


def community_summary(labels: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """label, summary: member names and the distinct predicates inside."""
    who = labels.join(names, "id").groupBy("label").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("who"))
    inside = edges.join(labels.withColumnRenamed("id", "src"), "src").groupBy("label").agg(F.array_join(F.array_sort(F.collect_set("predicate")), ", ").alias("preds"))
    return who.join(inside, "label", "left").select("label", F.concat(F.lit("Community: "), "who", F.lit("; edges: "), F.coalesce("preds", F.lit(""))).alias("summary"))


def subgraph(edges: DataFrame, start, depth: int, limit: int) -> DataFrame:
    """Edges met by an undirected walk of depth + 1 expansions, at most limit in (src, dst) order."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).toDF("src", "dst")
    inner = reach(both, [start], depth).select("id") if depth else None
    kind = edges.schema["src"].dataType.simpleString()
    own = edges.sparkSession.createDataFrame([(start,)], f"id {kind}")
    ids = (own if inner is None else inner.unionByName(own)).distinct()
    hit = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns))
    return hit.select("src", "dst").distinct().orderBy("src", "dst").limit(limit)


def neighbors(edges: DataFrame, node, limit: int) -> DataFrame:
    """Both directions, the first limit (1..1000) in order."""
    e = edges.filter(F.col("src") == node).select("src", "dst").union(edges.filter(F.col("dst") == node).select("src", "dst"))
    return e.distinct().orderBy("src", "dst").limit(max(1, min(limit, 1000)))


def symbol_scores(symbols: DataFrame, edges: DataFrame, now: int, half_life_days: float = 14.0) -> DataFrame:
    """id, recent, impact, compound, novel of symbols(id, from_s, until_s, changes)."""
    i = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("i"))
    o = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("o"))
    current = F.col("from_s").isNotNull() & (F.col("from_s") <= now) & ~F.coalesce(F.col("until_s") <= now, F.lit(False))
    age = (F.lit(now) - F.col("from_s")) / F.lit(86400.0)
    recent = F.when(current, F.pow(F.lit(2.0), -age / half_life_days)).otherwise(0.0) if half_life_days > 0 else F.lit(0.0)
    s = symbols.join(i, "id", "left").join(o, "id", "left").fillna(0, ["i", "o"])
    s = s.select("id", "changes", recent.alias("recent"), (F.pow(F.col("i").cast("double"), F.lit(0.7)) * F.pow(1.0 + F.col("o"), F.lit(0.3))).alias("impact"))
    top = s.agg(F.max("recent").alias("mr"), F.max("impact").alias("mi"))
    part = lambda x, m: F.when(F.col(m) > 0, F.col(x) / F.col(m)).otherwise(0.0)
    return s.join(F.broadcast(top)).select("id", "recent", "impact", (0.5 * part("recent", "mr") + 0.5 * part("impact", "mi")).alias("compound"), (1 / (1.0 + F.col("changes"))).alias("novel"))


def directional(old: DataFrame, new: DataFrame) -> DataFrame:
    """added, removed, modified between two snapshots (id, hash)."""
    j = old.select("id", F.col("hash").alias("h0")).join(new.select("id", F.col("hash").alias("h1")), "id", "full")
    return j.agg(F.count_if(F.col("h0").isNull()).alias("added"), F.count_if(F.col("h1").isNull()).alias("removed"), F.count_if(F.col("h0") != F.col("h1")).alias("modified"))
