import numpy as np
from pyspark.sql import functions as F

from cairn.llm import neighbours as N

DDL = "vec_id long, embedding array<float>, label int"


def brute(rows, t=0.93):
    ids = [r[0] for r in rows]
    par = {i: i for i in ids}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    n = dict.fromkeys(ids, 0)
    for a in range(len(rows)):
        for b in range(a):
            x, y = np.float32(rows[a][1]).astype(float), np.float32(rows[b][1]).astype(float)
            if rows[a][2] == rows[b][2] and x @ y / np.sqrt((x @ x) * (y @ y)) >= t:
                n[ids[a]] += 1
                n[ids[b]] += 1
                p, q = find(ids[a]), find(ids[b])
                par[max(p, q)] = min(p, q)
    return {i: (n[i], find(i)) for i in ids}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "CHUNK", 16)  # components over a block, leaves in pieces
    monkeypatch.setattr(N, "LEAF", 16)
    rng = np.random.default_rng(1)
    rows, i = [], 0
    for g in range(30):
        base = rng.standard_normal(16)
        for _ in range(1 + g % 4 + (60 if g == 3 else 0)):
            rows.append((i, (base + 0.12 * rng.standard_normal(16)).tolist(), g % 3))
            i += 1
    rows += [(i + k, rows[5][1], rows[5][2]) for k in range(4)]  # copies
    got = {r.vec_id: (r.n_links, r.component_id) for r in N.near_vectors(spark.createDataFrame(rows, DDL)).collect()}
    assert got == brute(rows)


def test_odd(spark):
    one = [1.0, 0.0]
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (6, one, None), (7, one, 1), (8, one, 1), (9, [2.0, 0.0], 1),
            (10, [1.0], 1), (11, [], 1), (12, one, 2), (13, [1e-30, 0.0], 1)]
    df = spark.createDataFrame(rows, DDL).withColumn("node", F.lit("clash")).withColumn("w", F.lit(1)).withColumn("id", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in N.near_vectors(df).collect()}
    assert len(got) == 13
    for i in (1, 2, 3, 4, 5, 6, 10, 11, 12):
        assert got[i] == (0, i, True)
    for i in (7, 8, 9, 13):
        assert got[i] == (3, 7, i == 7)
    assert N.near_vectors(df.limit(0)).count() == 0


def test_isolated_pairs_in_deep_trees(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 8)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 24, 2):  # 12 pairs at cosine 0.935, the others alone: a small sample meets few links
        y = x[i + 1] - (x[i + 1] @ x[i]) * x[i]
        x[i + 1] = 0.935 * x[i] + np.sqrt(1 - 0.935**2) * y / np.linalg.norm(y)
    got = N.near_vectors(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], DDL)).filter("n_links > 0").collect()
    assert sorted(r.vec_id for r in got) == list(range(24))


def test_audit_without_links_is_no_pass(spark, monkeypatch):
    monkeypatch.setattr(N, "AUDIT", 4)
    nodes = spark.createDataFrame([(i, 0, 2, [float(np.cos(i)), float(np.sin(i))]) for i in range(40)], "node long, grp long, dim int, vec array<double>")
    none = spark.createDataFrame([], "node long, root long")
    monkeypatch.setattr(N, "MOST_AUDIT", 8)
    assert not N.audited(nodes, none, 0.999999, 40)[0]
    monkeypatch.setattr(N, "MOST_AUDIT", 100)
    assert N.audited(nodes, none, 0.999999, 40)[0]


def test_failed_audit_compares_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(N, "TARGET", 2.0)  # never met
    monkeypatch.setattr(N, "MAX_ROUNDS", 2)
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "CHUNK", 4)
    monkeypatch.setattr(N, "leaves", lambda nodes, *a, **k: nodes.sparkSession.createDataFrame([], N.EDGE))  # nothing is found
    rng = np.random.default_rng(8)
    base = rng.standard_normal((20, 16))
    rows = [(i, (base[i % 20] + 0.15 * rng.standard_normal(16)).tolist(), i % 2) for i in range(160)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in N.near_vectors(spark.createDataFrame(rows, DDL)).collect()}
    assert got == brute(rows)
