"""Orchestration and edge cases that the catalogue's oracles don't reach."""

import pytest
from pyspark.sql import functions as F

from cairn.operators import graph, knowledge, lanes
from cairn.operators import repository as R

DDL = "lane string, lane_rank long, target_type string, target_id string, content string, raw_score double"


def test_recall_goes_on_without_a_lane(spark):
    good = spark.createDataFrame([("facts", 1, "memory", "a", "x", 1.0)], DDL)
    lane = {"facts": lambda: good, "broken": lambda: good.select("nothing"), "vector": lambda: good}
    got, failures = R.recall(lane, ["facts", "broken", "other"])
    assert got.count() == 1 and [(n, s) for n, s, _ in failures] == [("broken", "degraded"), ("other", "warning")]
    assert R.recall(lane, ["semantic"])[1] == [] and R.recall({}, ["x"])[0] is None


def test_gated_run(spark):
    cases = lambda n: spark.createDataFrame([(i, int(i < n)) for i in range(5)], "case_id int, failures int")
    out = spark.range(3)
    assert R.gated_run(cases(2), lambda: 1 / 0, lambda _: cases(0)) == ("rejected", None, [0, 1])
    assert R.gated_run(cases(0), lambda: 1 / 0, lambda _: cases(0), lambda: False)[0] == "skipped"
    assert R.gated_run(cases(0), lambda: out, lambda x: cases(0))[0] == "complete"
    status, df, failing = R.gated_run(cases(0), lambda: out, lambda x: cases(1))
    assert (status, df.count(), failing) == ("partial", 3, [0])


def test_requests_are_checked():
    R.check_retrieval("q", None, 5)
    R.check_consolidation("t", "a", 1, 2, False, True)
    for bad in ((" ", 1, 1), ("q", 0, 1), ("q", 1, 0)):
        with pytest.raises(ValueError):
            R.check_retrieval(*bad)
    for bad in (("", "a", 1, 2, False, True), ("t", " ", 1, 2, False, True), ("t", "a", 3, 2, False, True), ("t", "a", 1, 2, True, True), ("t", "a", 1, 2, False, False)):
        with pytest.raises(ValueError):
            R.check_consolidation(*bad)
    assert R.trigger_of(None) == "manual" and R.trigger_of("event_count") == "event_threshold"


def test_writes_are_idempotent_within_and_across_batches(spark):
    ddl = "id long, tenant string, idem string, text string, source string, allowed_uses array<string>"
    rows = [(1, "t", "k", "x", "s", []), (2, "t", "k", "y", "s", None), (3, "t", None, "x", "s", []), (4, "t", None, "x", "s", []), (5, None, "k", "x", "s", []), (6, "t", "old", "x", "s", []), (7, "t", "z", "x", "s", ["training_export"])]
    stored = spark.createDataFrame([("t", "old", 0)], "tenant string, idem string, id long")
    answers, new, events = R.write_memories(spark.createDataFrame(rows, ddl), stored, ["tenant", "idem"], "id")
    assert {r.id: (r.outcome, r.reason, r.stored_id) for r in answers.collect()} == {
        1: ("stored", None, 1), 2: ("deduplicated", None, 1), 3: ("stored", None, 3), 4: ("stored", None, 4), 5: ("rejected", "tenant_blank", None), 6: ("deduplicated", None, 0), 7: ("rejected", "training_export", None),
    }
    assert {r.id for r in new.collect()} == {1, 3, 4} == {r.memory_id for r in events.collect()}
    assert R.write_memories(spark.createDataFrame([], ddl), stored, ["tenant", "idem"], "id")[0].count() == 0


def test_snapshots_last_until_a_write(spark):
    calls = []
    cache = R.SnapshotCache()
    load = lambda: (calls.append(1), spark.range(3))[1]
    assert cache.get(("t",), load) is cache.get(("t",), load) and len(calls) == 1
    cache.invalidate(("t",))
    assert cache.get(("t",), load).count() == 3 and len(calls) == 2
    cache.invalidate(("t",))


def test_cycles_against_brute_force(spark):
    import random

    r = random.Random(6)
    pairs = sorted({(r.randrange(30), r.randrange(30)) for _ in range(34)})
    reach = {a: {b for x, b in pairs if x == a} for a in range(30)}
    for _ in range(30):
        reach = {a: s | {c for b in s for c in reach[b]} for a, s in reach.items()}
    on = {a for a in reach if a in reach[a]}
    want = {n for n in range(30) if n in on or (any(n in reach[c] for c in on) and any(c in reach[n] for c in on))}
    got = {x.id for x in knowledge.on_cycles(spark.createDataFrame(pairs, "child int, parent int")).collect()}
    assert got == want


def test_long_chains_are_neither_cycles_nor_cut(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "src long, dst long")
    assert knowledge.on_cycles(chain.toDF("child", "parent")).count() == 0
    assert [x.id for x in graph.shortest_path(chain, 0, 20).orderBy("step").collect()] == list(range(21))
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent_id string")
    with pytest.raises(ValueError):
        knowledge.path_to_root(loop, loop.select("id"), 4)


def test_bm25_counts_terms_as_tokens(spark):
    docs = spark.createDataFrame([(1, "the the other theThe"), (2, ""), (3, None), (4, "other words, THE")], "id long, text string")
    got = {r.target_id for r in lanes.bm25(docs, ["the"], "id", "text", 10).collect()}
    assert got == {"1", "4"}
    one = lanes.bm25(docs.filter("id = 1"), ["the", "other"], "id", "text", 10).first()
    k = lambda tf: tf * 2.2 / (tf + 1.2)  # noqa: E731  one document: length equals the average
    import math

    assert abs(one.raw_score - math.log(1 + 0.5 / 1.5) * (k(4) + k(1))) < 1e-6
    assert R.threshold(spark.createDataFrame([(0.5,), (None,)], "score double"), 0.1)[1].first().dropped == 1


def test_entity_merge_keeps_given_names(spark):
    df = spark.createDataFrame([(["Ann"], ["ANN", "Bo"])], "a array<string>, b array<string>")
    assert df.select(R.merge_memory_entities(F.col("a"), F.col("b"))).first()[0] == ["Ann", "Bo"]


def test_large_components_move_together(spark, monkeypatch):
    import random

    r = random.Random(4)
    pairs = [(a, b) for g in range(6) for a in range(10 * g, 10 * g + 10) for b in range(10 * g, a) if r.random() < 0.7] + [(10 * g + 1, (10 * g + 12) % 60) for g in range(6)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    want = {x.id: x.label for x in graph.communities(e).collect()}
    monkeypatch.setattr(graph, "MAX_COMPONENT_EDGES", 10)
    got = {x.id: x.label for x in graph.communities(e).collect()}

    def modularity(lab):
        m, deg, tot = len(pairs), dict.fromkeys(lab, 0), {}
        for a, b in pairs:
            deg[a] += 1
            deg[b] += 1
        for n, c in lab.items():
            tot[c] = tot.get(c, 0) + deg[n]
        return sum(lab[a] == lab[b] for a, b in pairs) / m - sum((t / (2 * m)) ** 2 for t in tot.values())

    assert set(got) == set(want) and modularity(got) >= 0.95 * modularity(want)


def _local_moving(pairs, passes):
    """Local moving node by node, as the rule says: id -> least member."""
    order = list(dict.fromkeys(x for p in pairs for x in p))
    index = {x: i for i, x in enumerate(order)}
    near = [{} for _ in order]
    for a, b in pairs:
        i, j = index[a], index[b]
        if i != j:
            near[i][j] = near[i].get(j, 0.0) + 1
            near[j][i] = near[j].get(i, 0.0) + 1
    deg = [sum(x.values()) for x in near]
    com, tot, m2 = list(range(len(order))), deg[:], sum(deg)
    for _ in range(passes):
        moved = False
        for i, d in enumerate(deg):
            own, link = com[i], {}
            tot[own] -= d
            for j, w in near[i].items():
                link[com[j]] = link.get(com[j], 0.0) + w
            best, gain = own, link.get(own, 0.0) - (tot[own] * d / m2 if m2 else 0.0)
            for c in sorted(link):
                g = link[c] - tot[c] * d / m2
                if g > gain + 1e-12 or (abs(g - gain) <= 1e-12 and c < best):
                    best, gain = c, g
            com[i] = best
            tot[best] += d
            moved |= best != own
        if not moved:
            break
    return {x: min(y for y in order if com[index[y]] == com[index[x]]) for x in order}


def _graph(seed, groups, n, links):
    import random

    r = random.Random(seed)
    return [(g * n + r.randrange(n), g * n + r.randrange(n)) for g in range(groups) for _ in range(links)]


def test_communities_step_over_blocks_without_shuffles(spark, monkeypatch):
    pairs = _graph(3, 3, 40, 130) + [(500, 500)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    comp = {x.id: x.component for x in graph.components(e).collect()}
    want = {}
    for c in set(comp.values()):
        want |= _local_moving(sorted(p for p in pairs if comp[p[0]] == c), 20)
    assert {x.id: x.label for x in graph.communities(e).collect()} == want
    as_text = spark.createDataFrame([(f"{a:04}", f"{b:04}") for a, b in pairs], "src string, dst string")
    assert {int(x.id): int(x.label) for x in graph.communities(as_text).collect()} == want
    monkeypatch.setattr(graph.dense, "LINKS", 16)  # many blocks
    monkeypatch.setattr(graph, "MAX_COMPONENT_EDGES", 10)
    monkeypatch.setattr(graph, "moved_together", lambda *_: 1 / 0)
    got = {x.id: x.label for x in graph.communities(e, 2).collect()}
    monkeypatch.undo()
    monkeypatch.setattr(graph, "MAX_COMPONENT_EDGES", 10)
    monkeypatch.setattr(graph.dense, "MAX_NODES", 0)  # by joins
    assert {x.id: x.label for x in graph.communities(e, 2).collect()} == got
    assert {x.id: x.component for x in graph.components(e).collect()} == comp


def test_pairs_of_a_frequent_key_are_spread(spark, monkeypatch):
    from cairn.operators import codegraph

    rows = [(i, "x" if i % 3 else "y") for i in [*range(200), 7]]
    df = spark.createDataFrame(rows, "id long, k string")
    monkeypatch.setattr(codegraph, "BLOCK", 16)
    got = codegraph.ordered_pairs(df, "id", "k")
    want = sorted((a, b) for a, k in rows for b, m in rows if k == m and a < b)
    assert sorted((r.id, r.b_id) for r in got.collect()) == want
    most = max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
    assert most < len(want) / 4  # one task held them all before


def test_chunkers_take_texts_in_small_batches(spark):
    from cairn.operators import ingest

    old = spark.conf.get(ingest.BATCH, None)
    spark.conf.unset(ingest.BATCH)
    df = spark.range(400, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("fn a() {}\nx\n"), 5000).alias("text"))
    assert ingest.chunk(df, "doc_id", "text", "code").count() == 400 * 5000
    assert int(spark.conf.get(ingest.BATCH)) <= 8 << 20  # 10,000 texts at once before
    spark.conf.set(ingest.BATCH, "1000000") if old is None else spark.conf.set(ingest.BATCH, old)
    keep = spark.conf.get(ingest.BATCH)
    ingest.chunk(df, "doc_id", "text", "code")
    assert spark.conf.get(ingest.BATCH) == keep
    if old is None:
        spark.conf.unset(ingest.BATCH)


def test_paths_and_ranks_over_arrays_equal_the_joins(spark, monkeypatch):
    e = spark.createDataFrame(_graph(5, 2, 60, 90) + [(900, 901), (901, 900)], "src long, dst long")
    calls = [lambda: graph.pagerank(e, rounds=20, tol=1e-6, seeds=[1, 950]), lambda: graph.farthest_path(e, 3, 6), lambda: graph.farthest_path(e, 900, 6), lambda: graph.shortest_path(e, 3, 70)]
    rows = lambda f: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in f().collect())
    with monkeypatch.context() as m:
        m.setattr(graph, "reach", lambda *_: 1 / 0)  # no joins in the rounds
        got = [rows(f) for f in calls]
    monkeypatch.setattr(graph.dense, "MAX_NODES", 0)
    assert got == [rows(f) for f in calls] and got[3] == [] and got[1]


def test_betweenness_by_components_equals_one_search_a_source(spark, monkeypatch):
    e = spark.createDataFrame([*_graph(7, 2, 30, 70), (3, 4), (3, 4), (500, 500)], "src long, dst long")
    get = lambda: {x.id: round(x.score, 8) for x in graph.betweenness(e).collect()}
    with monkeypatch.context() as m:
        m.setattr(graph.dense, "MAX_NODES", 0)
        want = get()
    monkeypatch.setattr(graph, "MAX_ADJACENCY_EDGES", 10)  # refused before
    assert get() == want
